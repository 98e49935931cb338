"""Intervals and islands by subject. An interval is [s, e) in milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.dealing import dealt


def merge(intervals: DataFrame, by: list[str], start: str = "s", end: str = "e") -> DataFrame:
    """The union of the intervals of each key; intervals that touch become one, empty ones go."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = intervals.filter(F.col(end) > F.col(start)).withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    x = x.withColumn("_island", F.sum("_new").over(w))
    return x.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def pauses(events: DataFrame, by: list[str], ends: DataFrame) -> DataFrame:
    """Merged pauses from events (by, t, type): 1/2 pause and resume by hand, 5/6 by motion.

    A repeated opening is ignored, an open pause lasts until the end in ends (by, end).
    """
    x = events.filter(F.col("type").isin(1, 2, 5, 6)).withColumns({"_family": F.col("type") >= 5, "_open": F.col("type").isin(1, 5)})
    w = Window.partitionBy(*by, "_family").orderBy("t", "type")
    x = x.withColumn("_before", F.lag("_open").over(w))
    x = x.filter(F.when(F.col("_open"), F.coalesce(~F.col("_before"), F.lit(True))).otherwise(F.coalesce(F.col("_before"), F.lit(False))))
    x = x.withColumn("_next", F.lead("t").over(w)).filter("_open")
    x = x.join(ends, by).select(*by, F.col("t").alias("s"), F.coalesce("_next", "end").alias("e"))
    return merge(x, by)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much two intervals share."""
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def overlap_sums(windows: DataFrame, intervals: DataFrame, by: list[str], name: str = "inside") -> DataFrame:
    """windows (by, a, b and more) with the milliseconds that intervals (by, s, e) cover of [a, b).

    How much was covered until a time is a running sum over the intervals' ends, so both meet in one sort of the key and not in a join.
    """
    keys = windows.columns
    x = windows.withColumn("_row", F.monotonically_increasing_id())
    more = [*keys, "_row"]
    probes = x.select(*more, F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(-1).alias("side")), F.struct(F.col("b").alias("at"), F.lit(1).alias("side")))).alias("p"))
    probes = probes.select(*more, F.col("p.at").alias("_at"), F.col("p.side").alias("_side"), F.lit(0).alias("_sign"))
    kinds = dict(probes.dtypes)
    ends = intervals.filter("e > s").select(*by, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("sign")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("sign")))).alias("p"))
    ends = ends.select(*by, *(F.lit(None).cast(kinds[c]).alias(c) for c in more if c not in by), F.col("p.at").alias("_at"), F.lit(0).alias("_side"), F.col("p.sign").alias("_sign"))
    key = Window.partitionBy(*by)
    so_far = key.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    # times count from the first of their key, which keeps the sums small
    z = dealt(probes.unionByName(ends), by).withColumn("_from", F.col("_at") - F.min("_at").over(key))
    covered = F.sum("_sign").over(so_far) * F.col("_from") - F.sum(F.col("_sign") * F.col("_from")).over(so_far)
    z = z.withColumn("_covered", F.col("_side") * covered).filter("_side <> 0")
    return z.groupBy("_row", *keys).agg(F.greatest(F.sum("_covered"), F.lit(0)).alias(name)).drop("_row")


def covers(intervals: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """by, covered: whether one merged interval of the key contains [a, b]."""
    return merge(intervals, by).groupBy(*by).agg(F.max((F.col("s") <= a) & (F.col("e") >= b)).alias("covered"))


def islands(rows: DataFrame, by: list[str], order: list[str], good: Column) -> DataFrame:
    """rows with island, a number shared by consecutive good rows of a key; rows that are not good go."""
    w = Window.partitionBy(*by).orderBy(*order)
    x = rows.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_n", F.row_number().over(w))
    return x.filter("_good").withColumn("island", F.col("_n") - F.row_number().over(w)).drop("_good", "_n")


def longest_run(rows: DataFrame, by: list[str], order: list[str], good: Column) -> DataFrame:
    """by, longest: the most consecutive good rows of each key that has any."""
    return islands(rows, by, order, good).groupBy(*by, "island").count().groupBy(*by).agg(F.max("count").alias("longest"))


def stretches(rows: DataFrame, by: list[str], order: list[str], good: Column, least: int) -> DataFrame:
    """The rows of islands with at least so many rows."""
    x = islands(rows, by, order, good)
    return x.withColumn("_size", F.count("*").over(Window.partitionBy(*by, "island"))).filter(F.col("_size") >= least).drop("_size")


def episodes(rows: DataFrame, by: list[str], start: str, end: str, gap_ms: int) -> DataFrame:
    """rows with episode: a new one begins where the start lies gap_ms or more behind all ends before."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_new", F.when(F.col(start) - reach < gap_ms, 0).otherwise(1)).withColumn("episode", F.sum("_new").over(w)).drop("_new")


def longest_gap(days: DataFrame, by: list[str], first: Column, last: Column) -> DataFrame:
    """by, gap: the most days between two distinct days of a key in [first, last], the edges included."""
    inside = days.select(*by, "day").filter(F.col("day").between(first, last)).distinct()
    w = Window.partitionBy(*by).orderBy("day")
    x = inside.withColumn("_gap", F.datediff("day", F.coalesce(F.lag("day").over(w), first)))
    return x.groupBy(*by).agg(F.greatest(F.max("_gap"), F.datediff(last, F.max("day"))).alias("gap"))


def in_windows(points: DataFrame, windows: DataFrame, by: list[str], t: str = "t", bucket_ms: int = 86_400_000) -> DataFrame:
    """Points joined to the windows [a, b) of their key that hold them; buckets of time make it an equality join."""
    w = windows.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("a") / bucket_ms), F.floor((F.col("b") - 1) / bucket_ms)))).filter("b > a")
    p = points.withColumn("_bucket", F.floor(F.col(t) / bucket_ms))
    return p.join(w, [*by, "_bucket"]).filter((F.col(t) >= F.col("a")) & (F.col(t) < F.col("b"))).drop("_bucket")
