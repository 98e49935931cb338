"""Sensor series by subject: cumulative distance, weights, zones, splits, efforts, drift, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.numbers import half_up
from paceline.functions.physics import haversine, in_zone
from paceline.operators import asof
from paceline.operators.dealing import dealt
from paceline.operators.intervals import in_windows, overlap_sums


def downsample(points: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Mean, least and greatest v in equal spans of time, the last one closed."""
    w = Window.partitionBy(*by)
    x = points.filter("v is not null").withColumns({"_t0": F.min("t").over(w), "_t1": F.max("t").over(w)})
    width = (F.col("_t1") - F.col("_t0")) / F.lit(float(buckets))
    bucket = F.when(width > 0, F.least(F.lit(buckets - 1), F.floor((F.col("t") - F.col("_t0")) / width).cast("int"))).otherwise(0)
    return x.withColumn("bucket", bucket).groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def distance_from_increments(points: DataFrame, by: list[str], starts: DataFrame) -> DataFrame:
    """by, t, d: the running sum of increments v (null and negative ones skipped), from 0 at the start in starts (by, start)."""
    w = Window.partitionBy(*by).orderBy("t", "v").rowsBetween(Window.unboundedPreceding, 0)
    good = points.filter("v >= 0").join(starts, by)
    run = good.select(*by, F.greatest(F.max("t").over(w), "start").alias("t"), F.sum("v").over(w).alias("d"))
    # dealt by key here: a join or window above must not rely on how the two sides happen to be dealt
    return dealt(run.unionByName(starts.select(*by, F.col("start").alias("t"), F.lit(0.0).alias("d"))), by)


def route_distance(points: DataFrame, by: list[str]) -> DataFrame:
    """points (by, t, lat, lon, ...) that have coordinates, with d: metres along them."""
    order = Window.partitionBy(*by).orderBy("t")
    x = points.filter("lat is not null and lon is not null")
    step = F.coalesce(haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")), F.lit(0.0))
    return x.withColumn("_step", step).withColumn("d", F.sum("_step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def weights(points: DataFrame, by: list[str], cap_ms: int = 30_000, pauses: DataFrame | None = None, end: str | None = None) -> DataFrame:
    """Readings with w: seconds that each stands for, up to the next one, cap_ms or the end; less pauses; only those over 0."""
    order = Window.partitionBy(*by).orderBy("t")
    x = points.filter("v is not null")
    limit = F.least(F.col("t") + cap_ms, F.col(end)) if end else F.col("t") + cap_ms
    x = x.withColumn("_end", F.least(limit, F.coalesce(F.lead("t").over(order), F.col(end) if end else F.col("t"))))
    if pauses is not None:
        x = overlap_sums(x.withColumns({"a": F.col("t"), "b": F.col("_end")}), pauses, by, "_paused").drop("a", "b")
    else:
        x = x.withColumn("_paused", F.lit(0))
    return x.withColumn("w", (F.col("_end") - F.col("t") - F.col("_paused")) / 1000).filter("w > 0").drop("_end", "_paused")


def zones(weighted: DataFrame, by: list[str], bounds: list[float]) -> DataFrame:
    """by, zone, seconds, percent of the measured time."""
    x = weighted.withColumn("zone", in_zone(F.col("v"), bounds)).groupBy(*by, "zone").agg(F.sum("w").alias("_s"))
    share = 100 * F.col("_s") / F.sum("_s").over(Window.partitionBy(*by))
    return x.select(*by, "zone", half_up(F.col("_s"), 1).alias("seconds"), half_up(share, 1).alias("percent"))


def splits(dist: DataFrame, by: list[str], unit: float, least: float = 0.1) -> DataFrame:
    """by, split, from_m, length_m, t0, t1: each unit of distance with the times it begins and ends.

    dist (by, t, d). A last part under least of a unit goes, unless it is the first.
    """
    step = F.lit(float(unit))
    total = dist.groupBy(*by).agg(F.max("d").alias("_total")).filter("_total > 0")
    whole = F.transform(F.sequence(F.lit(0), (F.ceil(F.col("_total") / unit) - 1).cast("int")), lambda k: k * step)
    edges = total.select(*by, F.explode(F.concat(whole, F.array("_total"))).alias("d"))
    w = Window.partitionBy(*by).orderBy("d")
    # each edge but the last begins a part that ends at the next one
    x = asof.at(dist, edges, by, "d", "t", "t0").withColumns({"_to": F.lead("d").over(w), "t1": F.lead("t0").over(w), "split": F.row_number().over(w)})
    length = F.col("_to") - F.col("d")
    x = x.filter(F.col("_to").isNotNull() & ((length >= unit * least) | (F.col("split") == 1)))
    return x.select(*by, "split", F.col("d").alias("from_m"), length.alias("length_m"), "t0", "t1")


def moving(spans: DataFrame, by: list[str], pauses: DataFrame, a: str = "t0", b: str = "t1") -> DataFrame:
    """spans with moving_ms: the time between two columns, less pauses."""
    x = overlap_sums(spans.withColumns({"a": F.col(a), "b": F.col(b)}), pauses, by, "_paused")
    return x.withColumn("moving_ms", F.col("b") - F.col("a") - F.col("_paused")).drop("a", "b", "_paused")


def best_efforts(dist: DataFrame, by: list[str], lengths: list[float], pauses: DataFrame | None = None) -> DataFrame:
    """by, metres, seconds, start, end of the fastest stretch of each length that begins at a point; the first of equals. One pass for all lengths."""
    points = dist.groupBy(*by, "t").agg(F.min("d").alias("d0"))
    starts = points.select(*by, F.col("t").alias("t0"), "d0", F.explode(F.array(*(F.lit(float(m)) for m in lengths))).alias("metres"))
    starts = starts.select(*by, "metres", "t0", (F.col("d0") + F.col("metres")).alias("d"))
    reached = asof.at(dist, starts, by, "d", "t", "t1").filter("t1 is not null")
    spans = reached.withColumn("moving_ms", F.col("t1") - F.col("t0")) if pauses is None else moving(reached, by, pauses)
    best = F.min_by(F.struct("moving_ms", "t0", "t1"), F.struct("moving_ms", "t0")).alias("b")
    x = spans.filter("moving_ms > 0").groupBy(*by, "metres").agg(best)
    return x.select(*by, "metres", (F.col("b.moving_ms") / 1000).alias("seconds"), F.col("b.t0").alias("start"), F.col("b.t1").alias("end"))


def best_effort(dist: DataFrame, by: list[str], length: float, pauses: DataFrame | None = None) -> DataFrame:
    """by, seconds, start, end of the fastest stretch of a length."""
    return best_efforts(dist, by, [length], pauses).drop("metres")


def mean_within(points: DataFrame, spans: DataFrame, by: list[str], out: str = "mean", bucket_ms: int = 3_600_000) -> DataFrame:
    """spans (by, a, b, ...) with the mean v of points in [a, b), null without any; repeated spans are one."""
    spans = spans.distinct()
    inside = in_windows(points.select(*by, F.col("t").alias("_t"), F.col("v").alias("_v")), spans, by, "_t", bucket_ms)
    x = spans.select(*spans.columns, F.lit(None).cast("double").alias("_v")).unionByName(inside.select(*spans.columns, F.col("_v").cast("double").alias("_v")))
    return x.groupBy(*spans.columns).agg(F.avg("_v").alias(out))


def halves(weighted: DataFrame, by: list[str], bounds: DataFrame) -> DataFrame:
    """by, hr1, hr2, change: weighted means before and after mid in bounds (by, start, mid, end); readings are split there."""
    x = weighted.join(bounds, by).withColumns({"_a": F.col("t"), "_b": F.col("t") + F.col("w") * 1000})
    part = lambda a, b: F.greatest(F.least("_b", b) - F.greatest("_a", a), F.lit(0.0)) / 1000
    x = x.withColumns({"_w1": part("start", "mid"), "_w2": part("mid", "end")})
    mean = lambda w: F.when(F.sum(w) > 0, F.sum(F.col(w) * F.col("v")) / F.sum(w))
    x = x.groupBy(*by).agg(mean("_w1").alias("hr1"), mean("_w2").alias("hr2"))
    return x.withColumn("change", 100 * (F.col("hr2") - F.col("hr1")) / F.when(F.col("hr1") != 0, F.col("hr1")))


def decoupling(speed1: Column, hr1: Column, speed2: Column, hr2: Column) -> Column:
    """Loss of speed per heartbeat from the first half to the second, percent."""
    e1, e2 = speed1 / F.when(hr1 != 0, hr1), speed2 / F.when(hr2 != 0, hr2)
    return 100 * (e1 - e2) / F.when(e1 != 0, e1)


def smooth(x: str, by: list[str], order: str, reach: int = 2) -> Column:
    """Centred mean over up to reach rows on each side."""
    return F.avg(x).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach))


def trim_ends(route: DataFrame, by: list[str], metres: float) -> DataFrame:
    """Points of a route (with d) that lie metres or more from both ends."""
    total = F.max("d").over(Window.partitionBy(*by))
    return route.withColumn("_total", total).filter((F.col("d") >= metres) & (F.col("_total") - F.col("d") >= metres)).drop("_total")


def thin(rows: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """At most so many rows of each key, evenly by place, first and last kept."""
    w = Window.partitionBy(*by)
    x = rows.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count("*").over(w)})
    # a place is kept if some k in 0..most-1 rounds to it
    step = (F.col("_n") - 1) / F.lit(float(most - 1))
    k = F.ceil((F.col("_i") - 0.5) / step)
    kept = (F.col("_n") <= most) | ((k >= 0) & (k <= most - 1) & (F.floor(k * (F.col("_n") - 1) / F.lit(float(most - 1)) + 0.5) == F.col("_i")))
    return x.filter(kept).drop("_i", "_n")


def page(rows: DataFrame, by: list[str], order: str, cursor: int, limit: int) -> DataFrame:
    """Rows cursor + 1 to cursor + limit of each key."""
    x = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)))
    return x.filter(F.col("_i").between(cursor + 1, cursor + limit)).drop("_i")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first cap rows of each key, with truncated: whether there were more."""
    w = Window.partitionBy(*by)
    x = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})
    return x.filter(F.col("_i") <= cap).withColumn("truncated", F.col("_n") > cap).drop("_i", "_n")
