"""Whitening of vectors from an exact covariance.

Entries become integers x. With n vectors and sums S of each dimension, y = n * x - S is centred and whole, and the covariance is the sum of y y'
over n**3. To sum without rounding, each task cuts y into limbs of LIMB bits, whose products over some thousand rows are whole numbers below 2**53,
so that matrix products of doubles are exact; the products of the limbs are put together as big integers, which leave the task as digits of DIGIT
bits. Spark adds up each digit, and the driver gets one row for each pair of dimensions, whatever the number of vectors. What it decomposes is the
exact covariance, rounded once.

Vectors are read four times (sums, products, the check of the result, the result), so their integers are written once. The driver holds matrices of
the dimension squared.

Rows with a null vector or with null or non-finite entries go, and so do vectors of another length than most (vectors.usable). Entries c beyond
2**30 in size count as that. Rows with equal or null ids are rows of their own. A component whose share of the trace is below FLOOR has no variance
that doubles can tell: its whitened values are 0, and identity_error leaves it out. A deviation beyond 2**63 - 1 counts as that. Further columns
have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.store import materialize, text_batches
from paceline.llm.vectors import entries, usable

SCALE, SHIFT, LIMIT = 64.0, 1_000_000, 2.0**36
COMPONENTS, FLOOR = 32, 1e-12
#: Bits of a limb, rows of one product of limbs: 2 * LIMB + log2(ROWS) < 53. Bits of the digits of sums.
LIMB, ROWS, DIGIT = 20, 4096, 40


def integers(vectors: DataFrame, width: int, column: str = "embedding") -> DataFrame:
    """vec_id and x, the integers of each vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.clip(np.floor(entries(batch.column(column), width) * SCALE), -LIMIT, LIMIT).astype("<i8") + SHIFT
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "x"])

    kept = vectors.select("vec_id", column)
    return text_batches(kept).mapInArrow(run, f"vec_id {dict(kept.dtypes)['vec_id']}, x binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), width)


@dataclass(frozen=True)
class Sums:
    """Of the vectors: their number, the sum of each dimension, and a bound of n * x - S."""

    n: int
    sums: tuple[int, ...]
    bound: int

    @property
    def kind(self) -> type:
        return np.int64 if self.bound < 1 << 62 else object

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: of integers of 64 bits where they hold it, of Python's beyond."""
        middle = [s // self.n for s in self.sums]
        rest = np.array([s - self.n * m for s, m in zip(self.sums, middle, strict=True)], np.int64)
        return (x - np.array(middle, np.int64)).astype(self.kind) * self.n - rest

    @property
    def limbs(self) -> int:
        return max(1, -(-(self.bound.bit_length()) // LIMB))

    @property
    def digits(self) -> int:
        return (2 * self.bound.bit_length() + self.n.bit_length()) // DIGIT + 1


def sums_of(rows: DataFrame, width: int) -> Sums | None:
    """None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, low, high = 0, np.zeros(width, np.int64), None, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"), width)
                n, total = n + len(x), total + x.sum(axis=0)
                low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(total), pa.array(low), pa.array(high)], names=["i", "n", "s", "low", "high"])

    found = rows.select("x").mapInArrow(run, "i int, n long, s long, low long, high long")
    got = found.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    if not got:
        return None
    return Sums(got[0].n, tuple(int(r.s) for r in got), got[0].n * max(r.high - r.low for r in got))


def cut(y: np.ndarray, limbs: int) -> list[np.ndarray]:
    """Doubles of LIMB bits with y = sum of limb[k] << LIMB * k; all but the last lie evenly around 0."""
    out, half, mask = [], 1 << (LIMB - 1), (1 << LIMB) - 1
    for _ in range(limbs - 1):
        low = ((y + half) & mask) - half
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return [*out, y.astype(np.float64)]


def products(rows: DataFrame, width: int, sums: Sums) -> np.ndarray:
    """The exact sum of y y' over all rows, as Python's integers."""
    digits, upper = sums.digits, np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = sums.limbs
        total = np.zeros((width, width), object)
        held, steps = [np.zeros((width, width), np.int64) for _ in range(2 * limbs - 1)], 0

        def put_together() -> None:
            for power, part in enumerate(held):
                total[...] += part.astype(object) * (1 << LIMB * power)
                part[...] = 0

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                parts = cut(sums.centred(matrix(batch.column("x").slice(at, ROWS), width)), limbs)
                for i, a in enumerate(parts):
                    for j, b in enumerate(parts[: i + 1]):
                        exact = (a.T @ b).astype(np.int64)
                        held[i + j] += exact if i == j else exact + exact.T
                steps += 1
                if steps % 32 == 0:  # 2 * limbs * 32 products below 2**53
                    put_together()
        if steps:
            put_together()
            left, columns = total[upper], []
            for k in range(digits):
                low = left & ((1 << DIGIT) - 1) if k < digits - 1 else left
                columns.append(pa.array(low.tolist(), pa.int64()))
                left = left >> DIGIT
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), *columns], names=["i", "j", *(f"d{k}" for k in range(digits))])

    found = rows.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"d{k} long" for k in range(digits)))
    out = np.zeros((width, width), object)
    for r in found.groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(digits))).collect():  # a row for each pair of dimensions
        out[r.i, r.j] = out[r.j, r.i] = sum(r[f"d{k}"] << DIGIT * k for k in range(digits))
    return out


@dataclass(frozen=True)
class Whitening:
    """sums; axes: unit eigenvectors as columns, by falling variance; variances; trace of the covariance."""

    sums: Sums
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    @property
    def factors(self) -> np.ndarray:
        known = self.variances > FLOOR * self.trace
        return np.where(known, 1 / np.sqrt(np.where(known, self.variances, 1)), 0)

    def apply(self, y: np.ndarray) -> np.ndarray:
        return (y.astype(np.float64) / self.sums.n) @ self.axes * self.factors


def decomposed(total: np.ndarray, sums: Sums, most: int = COMPONENTS) -> Whitening:
    """total: the sum of y y'. An axis points to where its largest entry (the first of those) is positive."""
    scale = sums.n**3
    covariance = np.array([[x / scale for x in row] for row in total.tolist()])
    variances, axes = np.linalg.eigh(covariance)
    variances, axes = variances[::-1][:most], axes[:, ::-1][:, :most]
    largest = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[largest, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(sums, axes, np.maximum(variances, 0), sum(total.diagonal().tolist()) / scale)


def identity_error(rows: DataFrame, width: int, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity, of components with variance."""
    known = np.flatnonzero(model.factors > 0)
    upper = np.triu_indices(len(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(known), len(known))), 0
        for batch in batches:
            w = model.apply(model.sums.centred(matrix(batch.column("x"), width)))[:, known]  # centred, as y is
            total, n = total + w.T @ w, n + len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "s"])

    if not len(known):
        return 0.0
    found = rows.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    off = F.abs(F.col("s") / model.sums.n - (F.col("i") == F.col("j")).cast("double"))
    return found.agg(F.max(off).alias("most")).head().most


def whiten(vectors: DataFrame, column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable row of vectors (vec_id and the column) and component."""
    kept, width = usable(vectors.select("vec_id", column), column)
    spark, kind = vectors.sparkSession, dict(vectors.dtypes)["vec_id"]
    rows = materialize(integers(kept, width, column), "integers") if width else None
    sums = sums_of(rows, width) if width else None
    if sums is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    model = decomposed(products(rows, width, sums), sums, most)
    error = identity_error(rows, width, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        largest = (1 << 63) - 1
        for batch in batches:
            y = sums.centred(matrix(batch.column("x"), width))
            wide = y if width * sums.bound * sums.bound <= largest else y.astype(object)
            deviation = pa.array([min(int(d), largest) for d in (wide * wide).sum(axis=1)], pa.int64())
            w = model.apply(y)
            ends = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    out = rows.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(v / model.trace) if model.trace else 0.0) for v in model.variances))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(sums.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
