"""Compact columns of chunks: integers over a divisor as first or second differences, with the positions of nulls; or plain numbers.

A column is STRUCT<m, o, d, x, r>. Value i is X[i] / m, where X[0] = d[0], X[1] - X[0] = d[1], and d[i] from there on is a difference (o = 1) or
a difference of differences (o = 2). The running value stays the same at nulls, whose positions x lists in rising order. Columns that no
divisor gives back are plain numbers, r.

Chunks are cut from rows in their order: rows are dealt by key and sorted within their partitions, and Python keeps no more of a key than
one chunk. Each chunk is encoded and decoded with numpy as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

COLUMN = "struct<m:long,o:int,d:array<long>,x:array<int>,r:array<double>>"
CHUNK = 5_000
#: Fixed values of the format: divisors of exact values, the largest divisor, the bound of integers when encoding and when decoding.
DIVISORS = (1, 10, 100, 1_000, 10_000, 100_000, 1_000_000)
LARGEST_DIVISOR = 10**15
ENCODED_BELOW = 9e15
SAFE = 2**53 - 1


@dataclass(frozen=True)
class Plan:
    """How a column becomes integers; see exact(), step(), rounded() and within()."""

    kind: str
    value: float = 0


def exact() -> Plan:
    """Every value as it is: by the least power of ten that gives all of them back, else plain numbers."""
    return Plan("exact")


def step(m: int) -> Plan:
    """Values are rounded to multiples of 1 / m."""
    return Plan("step", max(1, m))


def rounded(decimals: int) -> Plan:
    """Values are rounded to so many decimals (0 to 6), then kept exactly."""
    return Plan("rounded", max(0, min(decimals, 6)))


def within(error: float) -> Plan:
    """The plan of fewest characters among the exact one, powers of ten and the widest step, none of whose values is further off than error.

    Of plans of one size, the exact one comes first, then the lesser divisor.
    """
    return Plan("within", error)


def _nearest(x: np.ndarray) -> np.ndarray:
    """Whole numbers, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def _exact_divisor(known: np.ndarray) -> int | None:
    for m in DIVISORS:
        x = known * m
        if (np.abs(x) < ENCODED_BELOW).all() and (_nearest(x) / m == known).all():
            return m
    return None


def _plain(values: np.ndarray) -> dict:
    return {"r": [None if np.isnan(v) else v for v in values.tolist()]}


def _differences(x: np.ndarray, m: int, nulls: np.ndarray) -> dict | None:
    """The column of integers x; None if a difference is too large."""
    first = np.diff(x, prepend=0)
    second = first.copy()
    second[2:] = first[2:] - first[1:-1]
    cost = [float(np.abs(d[2:]).astype(np.float64).sum()) for d in (first, second)]
    o = 2 if cost[1] < cost[0] else 1
    d = second if o == 2 else first
    if (np.abs(d) >= ENCODED_BELOW).any():
        return None
    return {"m": m, "o": o, "d": d.tolist()} | ({"x": nulls.tolist()} if len(nulls) else {})


def _over(values: np.ndarray, m: int) -> dict | None:
    """The column of values (nan: none) with divisor m; None if it has no such form."""
    known = ~np.isnan(values)
    q = _nearest(values[known] * m)
    if (np.abs(q) >= ENCODED_BELOW).any():
        return None
    place = np.cumsum(known) - 1  # the last known value carries over nulls, and 0 before the first
    x = np.where(place >= 0, q.astype(np.int64)[place], 0) if len(q) else np.zeros(len(values), np.int64)
    return _differences(x, m, np.flatnonzero(~known))


def characters(column: dict) -> int:
    """Length of the column's numbers as text, with a separator each."""
    if "r" in column:
        return sum(len(repr(v)) if v is not None else 4 for v in column["r"]) + len(column["r"])
    return sum(len(str(v)) + 1 for k in ("d", "x") for v in column.get(k, ()))


def encoded(values: np.ndarray, plan: Plan) -> dict:
    """A column of one chunk; nan and infinite values count as null."""
    values = np.where(np.isfinite(values), values, np.nan)
    known = values[~np.isnan(values)]
    if plan.kind == "step":
        return _over(values, int(plan.value)) or _plain(values)
    if plan.kind == "rounded":
        scale = 10.0**plan.value
        values = _nearest(values * scale) / scale
        known = values[~np.isnan(values)]
    m = _exact_divisor(known)
    best = (_over(values, m) if m else None) or _plain(values)
    if plan.kind != "within":
        return best
    widest = int(min(LARGEST_DIVISOR, max(1, np.ceil(0.5 / plan.value)))) if plan.value > 0 else 1
    fewest = characters(best)
    for m in sorted({*DIVISORS, widest}):
        x = known * m
        if (np.abs(x) < ENCODED_BELOW).all() and (np.abs(_nearest(x) / m - known) <= plan.value).all():
            found = _over(values, m)
            if found is not None and (n := characters(found)) < fewest:
                best, fewest = found, n
    return best


def encoded_times(t: np.ndarray) -> dict:
    """Whole milliseconds, never null."""
    return _differences(t.astype(np.int64), 1, np.zeros(0, np.int64))


def _runs(batch: pa.RecordBatch, n: int) -> list[tuple[int, int]]:
    """Ranges of rows with one key, the first n columns."""
    ends = [pc.run_end_encode(c).run_ends.to_numpy() for c in batch.columns[:n]]
    edges = np.unique(np.concatenate([[0], *ends]))
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def encode(points: DataFrame, by: list[str], time: str, plans: dict[str, Plan], size: int = CHUNK) -> DataFrame:
    """by, chunk, n, the time (milliseconds) and each column of plans as compact columns: points of a key in order, size a chunk.

    Points with a null time go. A column without a value in a chunk is null there. Name a day or month in by where one key
    may be more than a task should have.
    """
    values = list(plans)
    made = StructType([*points.select(*by).schema.fields, *StructType.fromDDL(", ".join(["chunk int", "n long", *(f"`{c}` {COLUMN}" for c in (time, *values))])).fields])
    types, k = [to_arrow_type(f.dataType) for f in made.fields], len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        held: list[tuple[np.ndarray, ...]] = []
        count = chunk = 0

        def cut(arrays: tuple[np.ndarray, ...]) -> tuple:
            return (*key, chunk, len(arrays[0]), encoded_times(arrays[0]), *(encoded(a, p) if np.isfinite(a).any() else None for a, p in zip(arrays[1:], plans.values(), strict=True)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=made.names)

        for batch in batches:
            rows = []
            arrays = [batch.column(k).to_numpy(), *(c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns[k + 1 :])]
            for a, b in _runs(batch, k) if batch.num_rows else []:
                now = tuple(c[a].as_py() for c in batch.columns[:k])
                if now != key:
                    if count:
                        rows.append(cut(tuple(map(np.concatenate, zip(*held, strict=True)))))
                    key, held, count, chunk = now, [], 0, 0
                while a < b:
                    take = min(b - a, size - count)
                    held.append(tuple(x[a : a + take] for x in arrays))
                    a, count = a + take, count + take
                    if count == size:
                        rows.append(cut(tuple(map(np.concatenate, zip(*held, strict=True)))))
                        held, count, chunk = [], 0, chunk + 1
            if rows:
                yield batch_of(rows)
        if count:
            yield batch_of([cut(tuple(map(np.concatenate, zip(*held, strict=True))))])

    x = points.filter(F.col(time).isNotNull()).select(*by, F.col(time).cast("long").alias(time), *(F.col(v).cast("double").alias(v) for v in values))
    return x.repartition(*by).sortWithinPartitions(*by, time, *values).mapInArrow(run, made)


def _filled(x: pa.Array, default: int) -> np.ndarray:
    return x.fill_null(default).to_numpy(zero_copy_only=False).astype(np.int64)


def decoded(column: pa.StructArray, n: np.ndarray) -> tuple[pa.ListArray, np.ndarray]:
    """The doubles of a compact column of chunks with n points, null where it is null or no good; and which are no good."""
    m, o, d, x, r = column.flatten()
    has_d, has_r = (np.asarray(a.is_valid()) for a in (d, r))
    length = lambda a: _filled(pc.list_value_length(a), -1)
    m_, o_ = _filled(m, 0), _filled(o, 0)
    plain = has_r & ~has_d & (length(r) == n)
    delta = has_d & ~has_r & (m_ >= 1) & (m_ <= LARGEST_DIVISOR) & ((o_ == 1) | (o_ == 2)) & (length(d) == n)
    rows = np.flatnonzero(delta)
    own, sizes = d.take(pa.array(rows)).flatten(), n[rows]
    begin = np.cumsum(sizes) - sizes
    row, total = np.repeat(np.arange(len(rows)), sizes), int(sizes.sum())
    place = np.arange(total) - begin[row]
    flat = _filled(own, 2 * SAFE + 2)  # a null is no integer

    def running(a: np.ndarray) -> np.ndarray:
        """Sums along each chunk."""
        c = np.cumsum(a)
        return c - np.where(begin > 0, c[begin - 1], 0)[row] if total else c

    def sums(kind: type) -> tuple[np.ndarray, np.ndarray]:
        later = np.where(place == 0, 0, flat).astype(kind)
        steps = np.where(o_[rows][row] == 2, running(later), later)
        return steps, running(np.where(place == 0, flat.astype(kind), steps))

    bad = np.zeros(len(rows), bool)
    # integers wrap around where doubles, which do not, are far too large
    for whole, rough in zip(sums(np.int64), sums(np.float64), strict=True):
        bad[row[(np.abs(rough) > 2.0**60) | (np.abs(whole) > SAFE)]] = True
    values = whole / m_[rows][row]
    own = x.take(pa.array(rows))
    lists = np.maximum(length(own), 0)
    at, of = _filled(own.flatten(), -1), np.repeat(np.arange(len(rows)), lists)
    wrong = (at < 0) | (at >= sizes[of])
    wrong[1:] |= (of[1:] == of[:-1]) & (at[1:] <= at[:-1])
    bad[of[wrong]] = True
    null = np.zeros(total, bool)
    null[(begin[of] + at)[~wrong]] = True
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    first = pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.float64(), mask=null))
    second = r.take(pa.array(np.flatnonzero(plain)))
    index = np.full(len(column), -1)
    index[rows[~bad]] = np.flatnonzero(~bad)
    index[plain] = len(rows) + np.arange(int(plain.sum()))
    out = pa.concat_arrays([first, second.cast(first.type)]).take(pa.array(index, mask=index < 0))
    return out, np.asarray(column.is_valid()) & (index < 0)


def unpacked(chunks: DataFrame, keys: list[str], times: list[str], values: list[str], largest_time: int) -> DataFrame:
    """keys, times (arrays of whole milliseconds, the first one always there) and values (arrays of doubles) of chunks with n points.

    Chunks with a column that is no good, or a time that is null or beyond 0 to largest_time, go.
    """
    names = [*times, *values]
    made = StructType([*chunks.select(*keys).schema.fields, *StructType.fromDDL(", ".join([f"`{c}` array<long>" for c in times] + [f"`{c}` array<double>" for c in values])).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _filled(batch.column("n"), -1)
            good, columns = n >= 0, []
            for c in names:
                found, bad = decoded(batch.column(c), n)
                good &= ~bad
                if c in times:
                    good &= np.asarray(found.is_valid()) if c == times[0] else True
                    given = batch.column(c).flatten()
                    good &= (_filled(given[0], 1) == 1) & np.asarray(given[4].is_null()) & (_filled(pc.list_value_length(given[3]), 0) == 0)
                    flat, of = found.flatten(), np.repeat(np.arange(len(n)), _filled(pc.list_value_length(found), 0))
                    off = np.asarray(pc.or_(pc.less(flat, 0), pc.greater(flat, largest_time)).fill_null(True))
                    good[of[off]] = False
                columns.append(found)
            kept = pa.array(np.flatnonzero(good))
            whole = [c.take(kept).cast(pa.list_(pa.int64())) if name in times else c.take(kept) for name, c in zip(names, columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in keys), *whole], names=made.names)

    return chunks.select(*keys, "n", *names).mapInArrow(run, made)


def sound(column: Column, n: Column, time: bool = False, largest_time: int = SAFE) -> Column:
    """Whether a parsed compact column decodes to n values (of times: whole milliseconds in range), without leaving the JVM."""
    d, x = column["d"], F.coalesce(column["x"], F.array().cast("array<int>"))
    low, high = (0, largest_time) if time else (-SAFE, SAFE)
    start = F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("x"), F.lit(True).alias("ok"))

    def go_on(acc: Column, v: Column) -> Column:
        inside = acc["ok"] & v.isNotNull() & v.between(-2 * SAFE, 2 * SAFE)
        s = F.when(acc["i"] == 0, 0).when((acc["i"] == 1) | (column["o"] == 1), v).otherwise(acc["s"] + v)
        at = F.when(acc["i"] == 0, v).otherwise(acc["x"] + s)
        return F.when(inside, F.struct((acc["i"] + 1).alias("i"), s.cast("long").alias("s"), at.alias("x"), (at.between(low, high) & s.between(-SAFE, SAFE)).alias("ok"))).otherwise(F.struct(acc["i"], acc["s"], acc["x"], F.lit(False).alias("ok")))

    rising = F.aggregate(x, F.struct(F.lit(-1).alias("last"), F.lit(True).alias("ok")), lambda acc, p: F.struct(F.coalesce(p, F.lit(-1)).alias("last"), (acc["ok"] & (F.coalesce(p, F.lit(-1)) > acc["last"]) & (p < n)).alias("ok")))["ok"]
    delta = column["m"].between(1, 1 if time else LARGEST_DIVISOR) & column["o"].isin(1, 2) & (F.size(d) == n) & rising & F.aggregate(d, start, go_on)["ok"]
    if time:
        return F.coalesce(column["r"].isNull() & (F.size(x) == 0) & delta, F.lit(False))
    return F.coalesce(F.when(column["r"].isNotNull(), d.isNull() & (F.size(column["r"]) == n)).otherwise(delta), F.lit(False))
