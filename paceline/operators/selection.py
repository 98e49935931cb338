"""Which rows count: filters, consent, cleaning and ranked choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARATHON_KM = (41.5, 43.5)


def offset_window(points: DataFrame, starts: DataFrame, by: list[str], first_s: float, last_s: float) -> DataFrame:
    """Points (by, t) from first_s to last_s seconds after the start in starts (by, start), both included."""
    x = points.join(starts, by)
    return x.filter(((F.col("t") - F.col("start")) / 1000).between(first_s, last_s)).drop("start")


def consented(rows: DataFrame, switched_on: DataFrame, category: str = "category") -> DataFrame:
    """Rows of categories that their subject has switched on (subject, category)."""
    return rows.join(switched_on.select("subject", F.col("category").alias(category)).distinct(), ["subject", category], "left_semi")


def valid_points(points: DataFrame) -> DataFrame:
    """One point for each time, with finite values and coordinates on the earth."""
    ok = F.lit(True)
    for c, k in points.dtypes:
        if k == "double":
            ok &= F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < float("inf")))
    if {"lat", "lon"} <= set(points.columns):
        ok &= (F.abs("lat") <= 90) & (F.abs("lon") <= 180)
    keys = [c for c in ("subject", "wid", "stream", "t") if c in points.columns]
    x = points.filter(F.coalesce(ok, F.lit(False)))
    order = [F.asc_nulls_last(c) for c in points.columns if c not in keys]
    return x.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def clean_heart_rate(points: DataFrame, by: list[str], max_hr: Column) -> DataFrame:
    """Points with v null outside 30 to 250, and unreliable: over 5 % of those, over 2 % spikes, or flat for 300 readings."""
    x = points.filter("v is not null").withColumns({"_bad": ~F.col("v").between(30, 250), "_spike": F.col("v") > max_hr + 5})
    good = F.when(~F.col("_bad"), F.col("v"))
    n = F.count("*")
    odd = x.groupBy(*by).agg(((F.avg(F.col("_bad").cast("double")) > 0.05) | (F.avg((F.col("_spike") & ~F.col("_bad")).cast("double")) > 0.02) | ((F.count(good) >= 300) & (F.coalesce(F.stddev_samp(good), F.lit(0.0)) < 1)) | (n == 0)).alias("unreliable"))
    return x.withColumn("v", good).drop("_bad", "_spike").join(odd, by)


def heart_rate_coverage(weighted: DataFrame, moving: DataFrame, by: list[str]) -> DataFrame:
    """by, share of the moving time (seconds) that readings stand for, at most 1, null if nothing moved."""
    x = moving.join(weighted.groupBy(*by).agg(F.sum("w").alias("_w")), by, "left")
    return x.select(*by, F.when(F.col("moving") > 0, F.least(F.lit(1.0), F.coalesce("_w", F.lit(0.0)) / F.col("moving"))).alias("share"))


def clean_splits(splits: DataFrame, by: list[str], factor: float = 2.0) -> DataFrame:
    """Splits without full ones whose pace is more than factor off the median of their workout."""
    full = F.when(~F.col("partial") & (F.col("pace") > 0), F.col("pace"))
    m = splits.groupBy(*by).agg(F.median(full).alias("_m"))
    x = splits.join(m, by)
    keep = F.col("partial") | F.col("_m").isNull() | F.col("pace").between(F.col("_m") / factor, F.col("_m") * factor)
    return x.filter(keep).drop("_m")


def richest(runs: DataFrame, by: list[str]) -> DataFrame:
    """Of each chain of duplicates, the run with the most streams, then the longest, then the least id."""
    w = Window.partitionBy(*by).orderBy(F.desc("streams"), F.desc("km"), "id")
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def prior_marathon(runs: DataFrame, before: Column, since: Column) -> DataFrame:
    """The most recent run of marathon length of each subject in [since, before)."""
    x = runs.filter(F.col("km").between(*MARATHON_KM) & (F.col("day") >= since) & (F.col("day") < before))
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("day"), F.desc("km")))).filter("_n = 1").drop("_n")


def prior_seconds(effort: Column, total: Column, km: Column) -> Column:
    """A marathon's time: the best effort over the distance, or the whole run scaled if it is within 3 % of it."""
    return F.coalesce(effort, F.when(F.abs(km / 42.195 - 1) <= 0.03, total * 42.195 / km))


def next_race(races: DataFrame, today: Column) -> DataFrame:
    """Each subject's next race from today on; a marathon comes before others."""
    x = races.filter(F.col("day") >= today)
    order = [F.desc(F.col("metres").between(41_500, 43_500).cast("int")), F.asc("day"), F.asc("race")]
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(*order))).filter("_n = 1").drop("_n")


def valid_goal(race: Column, day: Column, seconds: Column) -> Column:
    """Whether a race goal is well formed: an id, a real day, 600 to 86400 seconds."""
    from paceline.functions.clock import valid_day

    return F.coalesce(race.rlike("^[0-9A-Za-z_-]{1,64}$") & valid_day(day) & seconds.between(600, 86_400), F.lit(False))


def resolved_max_hr(given: Column, observed: Column, age: Column) -> Column:
    """The runner's own value, else the confirmed observed one, else 208 - 0.7 x age, else 190."""
    return F.coalesce(given, observed, F.floor(208 - 0.7 * age + 0.5), F.lit(190.0))


def shortlist(classes: list[tuple[str, DataFrame, list[Column], int | None]], most: int = 72) -> DataFrame:
    """subject, id, why: runs by class in the order given, each once, with a limit for each class and one for all.

    classes: name, runs (subject, id and what the order needs), order, limit. A run of an earlier class does not count
    against a later one's limit.
    """
    out = None
    for place, (name, runs, order, limit) in enumerate(classes):
        if out is not None:
            runs = runs.join(out.select("subject", "id"), ["subject", "id"], "left_anti")
        x = runs.withColumn("_r", F.row_number().over(Window.partitionBy("subject").orderBy(*order, "id")))
        x = x.filter(F.col("_r") <= limit) if limit else x
        x = x.select("subject", "id", F.lit(name).alias("why"), F.lit(place).alias("_class"), "_r")
        out = x if out is None else out.unionByName(x)
    w = Window.partitionBy("subject").orderBy("_class", "_r")
    return out.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).select("subject", "id", "why")


def skipped(runs: DataFrame) -> DataFrame:
    """subject, reason, n of runs left out."""
    return runs.filter("reason is not null").groupBy("subject", "reason").count().withColumnRenamed("count", "n")


def unscaled(column: Column, divisor: Column) -> Column:
    """A stored scaled integer as the double it was."""
    return column.cast("double") / F.coalesce(divisor, F.lit(1))
