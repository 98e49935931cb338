"""Codes of vectors by product quantisation, fitted on weighted distinct parts.

Vectors become integers and are cut into PARTS consecutive parts. Equal parts of one position become one row with a weight, so what Lloyd's rounds
and the last assignment read has each value once, however often it is repeated; a round is one pass of Python over these rows in batches, which
adds up at most ENTRIES sums a position and task, and one small exchange of them. Codes and errors then come back to the vectors by joins on the
part's bytes. The driver and each task hold the codebooks, PARTS * ENTRIES entries.

Rows with a null vector or with null or non-finite components go, and so do vectors of another length than most (vectors.usable). The integer of
a component is floor(1024 * x), at most 2**40 in size (components beyond 2**30 count as that). If the length is no multiple of PARTS, zeros fill
it up, which changes no distance. Rows with equal ids are rows of their own; the first codebook takes the ENTRIES first rows by id, null ids last,
and rows with equal ids by their bytes. With fewer rows, the codebook is smaller. Errors of a part beyond 2**60 count as that. Further columns
have no effect; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.store import Scratch, materialize, text_batches
from paceline.llm.vectors import entries, usable

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
LIMIT, LARGEST_ERROR = 2.0**40, 1 << 60


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of each component, with zeros up to a multiple of PARTS."""
    whole = np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -whole.shape[1] % PARTS)))


def packed(part: np.ndarray) -> list[bytes]:
    """The bytes of each row of integers: two a component if all of the row fit, else eight. Equal rows have equal bytes."""
    small = (np.abs(part) < 1 << 15).all(axis=1)
    narrow = part.astype("<i2")
    return [(narrow[k] if s else part[k].astype("<i8")).tobytes() for k, s in enumerate(small.tolist())]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    values = column.to_pylist()
    narrow = np.fromiter(map(len, values), np.int64, len(values)) == 2 * width
    out = np.empty((len(values), width), np.int64)
    for mask, kind in ((narrow, "<i2"), (~narrow, "<i8")):
        at = np.flatnonzero(mask)
        if len(at):
            out[at] = np.frombuffer(b"".join([values[k] for k in at.tolist()]), kind).reshape(len(at), width)
    return out


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of book for each row, of equally near ones the first, and the squared distance; both exact."""
    largest = max(int(np.abs(values).max(initial=0)), int(np.abs(book).max(initial=0)))
    # doubles hold every sum as a whole number, or else Python's integers do
    kind = np.float64 if 4 * values.shape[1] * largest * largest < 1 << 53 else object
    v, b = values.astype(kind), book.astype(kind)
    index, error = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    for at in range(0, len(v), 4096):
        x = v[at : at + 4096]
        far = (x * x).sum(axis=1)[:, None] - 2 * (x @ b.T) + (b * b).sum(axis=1)
        found = far.argmin(axis=1)
        least = far[np.arange(len(x)), found]
        index[at : at + 4096], error[at : at + 4096] = found, np.minimum(least, LARGEST_ERROR).astype(np.int64)
    return index, error


def split_up(vectors: DataFrame, width: int, keep: list[str], column: str = "embedding") -> DataFrame:
    """keep, and p0, p1 and so on: the parts of each vector, as bytes."""
    names = [f"p{j}" for j in range(PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.split(integers(entries(batch.column(column), width)), PARTS, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(packed(p), pa.binary()) for p in parts)], names=[*keep, *names])

    kinds = dict(vectors.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"{n} binary" for n in names])
    return text_batches(vectors.select(*keep, column)).mapInArrow(run, schema)


def distinct_parts(rows: DataFrame) -> DataFrame:
    """position, part, n: each distinct part of a position and how many vectors have it."""
    parts = F.array(*(F.struct(F.lit(j).alias("position"), F.col(f"p{j}").alias("part")) for j in range(PARTS)))
    return rows.select(F.inline(parts)).groupBy("position", "part").agg(F.count("*").alias("n"))


def _batched(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, places in the batch and values of the parts of each position."""
    position, values = batch.column("position").to_numpy(), unpacked(batch.column("part"), width)
    for j in np.unique(position).tolist():
        at = np.flatnonzero(position == j)
        yield j, at, values[at]


def step(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round of Lloyd's: weighted means, rounded down; entries without parts stay."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            weights = batch.column("n").to_numpy()
            for j, at, values in _batched(batch, width):
                index, n = nearest(values, books[j])[0], weights[at]
                exact = int(np.abs(values).max(initial=0)) * int(n.sum()) < 1 << 62
                own = np.zeros(books[j].shape, np.int64 if exact else object)
                np.add.at(own, index, values * n[:, None] if exact else values.astype(object) * n.astype(object)[:, None])
                used = np.unique(index)
                sums[j][used] += own[used].astype(object)
                np.add.at(counts[j], index, n)
        for j in range(PARTS):
            used = np.flatnonzero(counts[j])
            if len(used):
                columns = [pa.array(np.full(len(used), j, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[j][used])]
                columns += [pa.array(sums[j][used, i].tolist(), pa.decimal128(38, 0)) for i in range(width)]
                yield pa.RecordBatch.from_arrays(columns, names=["position", "entry", "n", *(f"s{i}" for i in range(width))])

    schema = "position int, entry int, n long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width))
    summed = distinct.select("position", "part", "n").mapInArrow(run, schema).groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(width)))
    out = [b.copy() for b in books]
    for r in summed.collect():  # PARTS * ENTRIES rows at most
        out[r.position][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """position, part, code (two hex digits) and error of each distinct part."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.empty(batch.num_rows, object), np.empty(batch.num_rows, np.int64)
            for j, at, values in _batched(batch, width):
                index, error[at] = nearest(values, books[j])
                code[at] = [f"{k:02x}" for k in index.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(code, pa.string()), pa.array(error)], names=["position", "part", "code", "error"])

    return distinct.select("position", "part").mapInArrow(run, "position int, part binary, code string, error long")


def first_books(rows: DataFrame, width: int, order: str = "vec_id") -> list[np.ndarray]:
    """The parts of the ENTRIES first rows by id."""
    names = [f"p{j}" for j in range(PARTS)]
    first = rows.select(order, *names).orderBy(F.asc_nulls_last(order), *names).limit(ENTRIES).collect()
    return [unpacked(pa.array([bytes(r[p]) for r in first], pa.binary()), width) for p in names]


def digest(books: list[np.ndarray]) -> str:
    """Of all entries' components by part, entry and position within the part."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable row of vectors (vec_id, label and the column)."""
    kept, dimension = usable(vectors.select("vec_id", "label", column), column)
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    if not dimension:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-dimension // PARTS)
    with Scratch(spark) as scratch:
        rows = scratch.table(split_up(kept, dimension, ["vec_id", "label"], column), "parts")
        distinct = scratch.table(distinct_parts(rows), "distinct")
        books = first_books(rows, width)
        for _ in range(ROUNDS):
            books = step(distinct, books)
        coded = scratch.table(assigned(distinct, books), "assigned")
        for j in range(PARTS):
            own = coded.filter(F.col("position") == j).select(F.col("part").alias(f"p{j}"), F.col("code").alias(f"c{j}"), F.col("error").alias(f"e{j}"))
            rows = rows.join(own, f"p{j}").drop(f"p{j}")
        total = sum((F.col(f"e{j}") for j in range(1, PARTS)), F.col("e0"))
        coded = materialize(rows.select("vec_id", "label", F.concat(*(f"c{j}" for j in range(PARTS))).alias("code"), total.alias("error")), "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), F.lit((1 << 63) - 1)).cast("long").alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
