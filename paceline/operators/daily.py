"""Days, weeks and personal baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.clock import bed_day, day_start_ms, local_day, monday
from paceline.functions.numbers import half_up

#: Groups of daily metrics by name. They decide which stored metrics belong to a group.
GROUPS = {
    "sleep": "^sleep",
    "heart": "^(restingHr|hr[A-Z]|hrv|walkingHrAvg|vo2max|spo2|respiratory|perfusion)",
    "activity": "^(steps|flights|activeKcal|basalKcal|exerciseMin|standMin|moveMin|daylightMin|physicalEffort|ring|nikeFuel|swimStrokes|pushCount|uvExposure|mindful)|DistanceM$",
    "mobility": "^(walking(?!HrAvg$)|stair|sixMinute|timesFallen)",
    "body": "^(bodyMass|bodyFat|leanMass|bmi|height|waist|bodyTemp)",
    "nutrition": "^(dietaryKcal|proteinG|carbsG|fatG|sugarG|fiberG|sodiumG|waterL|caffeineG|alcoholBeverages)$",
    "cycle": "^(basalBodyTempC$|cycle[A-Z])",
    "audio": "^(envAudio|headphoneAudio|soundReduction)",
}


def in_groups(metric: Column, groups: list[str], metrics: list[str] = ()) -> Column:
    """Whether a metric belongs to one of the groups or is named."""
    found = metric.isin(list(metrics)) if metrics else F.lit(False)
    for g in groups:
        found |= metric.rlike(GROUPS[g])
    return found


def hourly_to_daily(hours: DataFrame, by: list[str], tz: str = "UTC") -> DataFrame:
    """by, day, mean, total, low, high, hours from rows (by, s, v, v2, v3): mean or sum, least and greatest of hours."""
    x = hours.withColumn("day", local_day(F.col("s"), tz))
    return x.groupBy(*by, "day").agg(F.avg("v").alias("mean"), F.sum("v").alias("total"), F.min("v2").alias("low"), F.max("v3").alias("high"), F.count("*").alias("hours"))


def period_means(metrics: DataFrame, by: list[str], unit: str) -> DataFrame:
    """by, metric, start, mean, days: over the days of a week (from Monday) or month that have the metric."""
    start = monday(F.col("day")) if unit == "week" else F.to_date(F.date_trunc(unit, "day"))
    return metrics.filter("value is not null").groupBy(*by, "metric", start.alias("start")).agg(F.avg("value").alias("mean"), F.count("*").alias("days"))


def baselines(metrics: DataFrame, by: list[str], days: int = 60, enough: int = 14) -> DataFrame:
    """Each day's value with mean, sd and n of the days before it in a window, change (percent), z and status."""
    w = Window.partitionBy(*by).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-days, -1)
    x = metrics.withColumns({"mean": F.avg("value").over(w), "sd": F.stddev_samp("value").over(w), "n": F.count("value").over(w)})
    z = (F.col("value") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))
    status = F.when(z.isNull() | (F.col("n") < enough), "not enough baseline").when(z <= -1, "below baseline").when(z >= 1, "above baseline").otherwise("within baseline range")
    return x.withColumns({"change": half_up(100 * (F.col("value") - F.col("mean")) / F.when(F.col("mean") != 0, F.col("mean")), 1), "z": half_up(z, 2), "status": status})


def nights(days: DataFrame, tz: str = "UTC") -> DataFrame:
    """subject, day, a, b: [bedtime - 59 min, wake time) of days with bed and wake (HH:mm)."""

    def at(day: Column, clock: Column) -> Column:
        return day_start_ms(day, tz) + (F.substring(clock, 1, 2).cast("long") * 60 + F.substring(clock, 4, 2).cast("long")) * 60_000

    x = days.filter("bed is not null and wake is not null")
    return x.select("subject", "day", (at(bed_day(F.col("day"), F.col("bed")), F.col("bed")) - 3_540_000).alias("a"), at(F.col("day"), F.col("wake")).alias("b"))


def weekly_totals(days: DataFrame, by: list[str], value: str) -> DataFrame:
    return days.groupBy(*by, monday(F.col("day")).alias("week")).agg(F.sum(value).alias(value))


def ramp(load: DataFrame, by: list[str], rows: int = 7) -> Column:
    """ctl now less ctl some rows before."""
    return F.col("ctl") - F.lag("ctl", rows).over(Window.partitionBy(*by).orderBy("day"))


def entries_by_minute(rows: DataFrame, by: list[str], kinds: list[str]) -> DataFrame:
    """One row for each minute and source, a column for each kind: its last value in that minute."""
    x = rows.withColumn("minute", F.floor(F.col("s") / 60_000))
    last = [F.max_by(F.when(F.col("agg") == k, F.col("v")), F.when(F.col("agg") == k, F.struct("s", "v"))).alias(k) for k in kinds]
    return x.groupBy(*by, "minute").agg(*last)


def trailing_mean(metrics: DataFrame, by: list[str], days: int = 28) -> Column:
    """Mean value over the days up to and including a row's."""
    return F.avg("value").over(Window.partitionBy(*by).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0))


def confirmed_max(peaks: DataFrame, by: list[str], low: float = 140, high: float = 230, agree: float = 3, others: int = 1) -> DataFrame:
    """by, peak: the highest plausible value that others of the same key lie within agree of (a frame of values, not a join)."""
    w = Window.partitionBy(*by).orderBy("v").rangeBetween(-agree, agree)
    x = peaks.filter(F.col("v").between(low, high)).withColumn("_near", F.count("*").over(w))
    return x.filter(F.col("_near") >= others + 1).groupBy(*by).agg(F.max("v").alias("peak"))


def missing_hours(times: DataFrame, by: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """by, hour of the hours in a range without any row of the key."""
    spine = times.select(*by).distinct().withColumn("hour", F.explode(F.sequence(F.lit(start_ms // 3_600_000), F.lit((end_ms - 1) // 3_600_000))))
    return spine.join(times.select(*by, F.floor(F.col("t") / 3_600_000).alias("hour")).distinct(), [*by, "hour"], "left_anti")


def freshness(checks: DataFrame, by: list[str], now_ms: int, stale_ms: int = 86_400_000) -> DataFrame:
    """by, as_of, stale: the oldest check among the types read, and whether any is stale."""
    return checks.groupBy(*by).agg(F.min("checked_at").alias("as_of"), F.max(F.coalesce(now_ms - F.col("checked_at") > stale_ms, F.lit(True))).alias("stale"))


def percentile_ranks(rows: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each name of shares: the value at place floor((n - 1) * share) of a key's sorted values, without interpolation."""
    w = Window.partitionBy(*by)
    x = rows.filter(F.col(column).isNotNull()).withColumns({"_place": F.row_number().over(w.orderBy(column)) - 1, "_n": F.count("*").over(w)})
    return x.groupBy(*by).agg(*(F.max(F.when(F.col("_place") == F.floor((F.col("_n") - 1) * share), F.col(column))).alias(name) for name, share in shares.items()))
