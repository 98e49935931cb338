"""Folds whose state depends on what they accepted before: one pass over a key's rows in order.

Rows are dealt by key and sorted within their partitions; a state of a few numbers runs along them in Arrow batches. A key's
rows are never gathered, so a key may be as long as its partition's disk allows, and each row is looked at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


class Fold:
    """The state of one key. row() and end() give the rows to put out."""

    def row(self, *values: Any) -> list[tuple]:
        return []

    def end(self) -> list[tuple]:
        return []


def scan(df: DataFrame, by: list[str], columns: list[str], out: str, fold: Callable[[], Fold]) -> DataFrame:
    """by and the columns of out (as in a DDL string): what a fold of each key gives for its rows, in order of columns."""
    made = StructType([*df.select(*by).schema.fields, *StructType.fromDDL(out).fields])
    types, names, n = [to_arrow_type(f.dataType) for f in made.fields], made.names, len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: tuple | None = None
        state = Fold()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[:n] != key:
                    if key is not None:
                        rows += [(*key, *x) for x in state.end()]
                    key, state = values[:n], fold()
                rows += [(*values[:n], *x) for x in state.row(*values[n:])]
            if rows:
                yield batch_of(rows)
        if key is not None and (rows := [(*key, *x) for x in state.end()]):
            yield batch_of(rows)

    return df.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, *columns).mapInArrow(run, made)


class _Climb(Fold):
    def __init__(self, threshold: float):
        self.threshold, self.ref, self.gain, self.loss, self.n = threshold, None, 0.0, 0.0, 0

    def row(self, t: Any, v: float) -> list[tuple]:
        self.n += 1
        if self.ref is None:
            self.ref = v
        elif v - self.ref >= self.threshold:
            self.gain, self.ref = self.gain + (v - self.ref), v
        elif self.ref - v >= self.threshold:
            self.loss, self.ref = self.loss + (self.ref - v), v
        return []

    def end(self) -> list[tuple]:
        return [(self.gain, self.loss) if self.n >= 2 else (None, None)]


def climb(points: DataFrame, by: list[str], threshold: float = 2.0) -> DataFrame:
    """by, gain, loss: sums of rises and falls of v in order of t that reach threshold since the last turn; null under 2 points."""
    x = points.filter("v is not null").withColumn("v", F.col("v").cast("double"))
    return scan(x, by, ["t", "v"], "gain double, loss double", lambda: _Climb(threshold))


class _Grades(Fold):
    def __init__(self, window: float, flat: float):
        self.window, self.flat, self.d, self.a = window, flat, None, None
        self.up, self.level, self.down, self.steepest, self.lowest = 0.0, 0.0, 0.0, None, None

    def row(self, d: float | None, a: float | None) -> list[tuple]:
        if self.d is None:
            self.d, self.a = d, a
        elif d is not None and d - self.d >= self.window:
            dd = d - self.d
            if a is not None and self.a is not None and dd > 0:
                grade = (a - self.a) / dd * 100
                if grade > self.flat:
                    self.up += dd
                elif grade < -self.flat:
                    self.down += dd
                else:
                    self.level += dd
                self.steepest = grade if self.steepest is None else max(self.steepest, grade)
                self.lowest = grade if self.lowest is None else min(self.lowest, grade)
            self.d, self.a = d, a
        return []

    def end(self) -> list[tuple]:
        return [(self.up, self.level, self.down, self.steepest, self.lowest)]


def grades(points: DataFrame, by: list[str], window: float = 100.0, flat: float = 2.0) -> DataFrame:
    """by, up, level, down (distance), steepest, lowest (percent): grades over successive spans of at least window.

    points (by, d, a): distance and altitude. A span begins where the last one ended.
    """
    x = points.select(*by, F.col("d").cast("double").alias("d"), F.col("a").cast("double").alias("a"))
    return scan(x, by, ["d", "a"], "up double, level double, down double, steepest double, lowest double", lambda: _Grades(window, flat))


class _Spaced(Fold):
    def __init__(self, spacing: int):
        self.spacing, self.kept, self.last = spacing, None, None

    def row(self, t: int | None) -> list[tuple]:
        if t is None:
            return []
        self.last = t
        if self.kept is None or t - self.kept >= self.spacing:
            self.kept = t
            return [(t,)]
        return []

    def end(self) -> list[tuple]:
        return [(self.last,)] if self.last != self.kept else []


def spaced(points: DataFrame, by: list[str], spacing: int) -> DataFrame:
    """by, t of points at least spacing after the last one kept; the first and the last stay."""
    return scan(points.select(*by, F.col("t").cast("long").alias("t")), by, ["t"], "t long", lambda: _Spaced(spacing))


class _Chains(Fold):
    """Only members that have not ended yet can overlap with what follows."""

    def __init__(self, fraction: float):
        self.fraction, self.open, self.chains = fraction, [], 0

    def row(self, s: int, e: int, id: int) -> list[tuple]:
        self.open = [m for m in self.open if m[1] > s]
        for ms, me, chain in self.open:
            if min(me, e) - max(ms, s) > self.fraction * min(me - ms, e - s):
                break
        else:
            self.chains += 1
            chain = self.chains
        self.open.append((s, e, chain))
        return [(s, e, id, chain)]


def duplicate_chains(runs: DataFrame, by: list[str], fraction: float = 0.5) -> DataFrame:
    """runs with chain: in order of start, a run joins the chain of an earlier member that it overlaps by more than fraction of the shorter.

    runs (by, s, e, id) with a start and an end not before it.
    """
    x = runs.select(*by, *(F.col(c).cast("long").alias(c) for c in ("s", "e", "id")))
    return scan(x, by, ["s", "e", "id"], "s long, e long, id long, chain int", lambda: _Chains(fraction))


class _Load(Fold):
    def __init__(self, short: float, long: float):
        self.short, self.long, self.atl, self.ctl = short, long, 0.0, 0.0

    def row(self, day: Any, load: float) -> list[tuple]:
        self.atl += (load - self.atl) / self.short
        self.ctl += (load - self.ctl) / self.long
        return [(day, load, self.atl, self.ctl, self.ctl - self.atl)]


def smoothed_load(days: DataFrame, by: list[str], short: float = 7.0, long: float = 42.0) -> DataFrame:
    """by, day, load, atl, ctl, tsb: exponential averages of load over every day of a key's span; missing days are 0."""
    span = days.groupBy(*by).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    spine = span.select(*by, F.explode(F.sequence("a", "b")).alias("day"))
    full = spine.join(days.groupBy(*by, "day").agg(F.sum("load").alias("load")), [*by, "day"], "left").withColumn("load", F.coalesce(F.col("load").cast("double"), F.lit(0.0)))
    return scan(full, by, ["day", "load"], "day date, load double, atl double, ctl double, tsb double", lambda: _Load(short, long))
