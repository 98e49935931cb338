"""Questions about days: context, hours, recovery, load, nutrition, profile and goals, over all subjects at once.

rows: stored rows as in paceline.sources.batches. days: subject, day, metric, value (daily_metrics()).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.functions.clock import age_at, day_start_ms, local_day
from paceline.functions.numbers import half_up, pace, tidy
from paceline.functions.physics import load
from paceline.operators import daily, dedup, folds, intervals, series
from paceline.sources.batches import PROFILE

RECOVERY = ("restingHr", "hrvSdnn", "sleepAsleepMin", "respiratoryRate", "spo2", "wristTemp", "sleepHrAvg", "sleepHrMin", "hrvOvernight")


def daily_metrics(rows: DataFrame) -> DataFrame:
    """subject, day, metric, value (text): the latest value of each metric of each day's uploads."""
    m = rows.filter("k = 'day'").select("subject", F.try_to_date("id", "yyyy-MM-dd").alias("day"), "seq", "batch", F.from_json(F.get_json_object("extra", "$.m"), "map<string,string>").alias("m"))
    return dedup.latest_metrics(m, ["subject", "day"], ["seq", "batch"])


def numeric(days: DataFrame) -> DataFrame:
    return days.withColumn("value", F.col("value").try_cast("double")).filter("value is not null")


def daily_context(days: DataFrame, first: str, last: str, groups: list[str] = (), metrics: list[str] = (), rollup: str | None = None) -> DataFrame:
    """Metrics of a range of days by group or name (all by default), tidied; rollup (week, month): their means and days."""
    x = days.filter(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    if groups or metrics:
        x = x.filter(daily.in_groups(F.col("metric"), list(groups), list(metrics)))
    if rollup:
        return daily.period_means(numeric(x), ["subject"], rollup).withColumn("mean", tidy(F.col("mean")))
    number = F.col("value").try_cast("double")
    return x.withColumn("value", F.coalesce(tidy(number).cast("string"), "value"))


def hourly(rows: DataFrame, name: str, first: str, last: str, tz: str = "UTC", by_day: bool = False, total: bool = False) -> DataFrame:
    """A series by hour, or by local day: mean of hours (or their sum), least, greatest and hours with data."""
    a, b = day_start_ms(F.lit(first).cast("date"), tz), day_start_ms(F.date_add(F.lit(last).cast("date"), 1), tz)
    x = rows.filter((F.col("k") == "hs") & (F.col("agg") == name) & (F.col("s") >= a) & (F.col("s") < b))
    if not by_day:
        return x.select("subject", "s", *(tidy(F.col(c)).alias(c) for c in ("v", "v2", "v3")))
    d = daily.hourly_to_daily(x, ["subject"], tz)
    return d.select("subject", "day", tidy(F.col("total" if total else "mean")).alias("value"), tidy(F.col("low")).alias("low"), tidy(F.col("high")).alias("high"), "hours")


def recovery(days: DataFrame, rows: DataFrame, window: int = 60, tz: str = "UTC") -> DataFrame:
    """subject, metric, day and how the day's value stands against the days before it, heart rate of the night included."""
    clocks = days.filter(F.col("metric").isin("sleepBedtime", "sleepWakeTime")).groupBy("subject", "day").agg(F.max(F.when(F.col("metric") == "sleepBedtime", F.col("value"))).alias("bed"), F.max(F.when(F.col("metric") == "sleepWakeTime", F.col("value"))).alias("wake"))
    hours = rows.filter("k = 'hs'").select("subject", "agg", "s", "v", "v2")
    at_night = intervals.in_windows(hours, daily.nights(clocks, tz), ["subject"], "s")
    hr = F.col("agg") == "HeartRate"
    n = at_night.groupBy("subject", "day").agg(F.avg(F.when(hr, F.col("v"))).alias("sleepHrAvg"), F.min(F.when(hr, F.col("v2"))).alias("sleepHrMin"), F.avg(F.when(F.col("agg") == "HeartRateVariabilitySDNN", F.col("v"))).alias("hrvOvernight"))
    extra = n.select("subject", "day", F.explode(F.create_map(*(x for c in ("sleepHrAvg", "sleepHrMin", "hrvOvernight") for x in (F.lit(c), F.col(c))))).alias("metric", "value")).filter("value is not null")
    x = numeric(days).filter(F.col("metric").isin(*RECOVERY)).unionByName(extra)
    return daily.baselines(x, ["subject", "metric"], window)


def training_load(workouts: DataFrame, days: DataFrame, tz: str = "UTC") -> DataFrame:
    """subject, day, load, atl, ctl, tsb, ramp: daily load of workouts and its averages over 7 and 42 days.

    workouts: subject, s, dur (s), hr_avg, hr_max, effort, sex (or null). The resting rate is the mean of the days, else 60;
    the greatest is the highest seen from 120 on, else 190.
    """
    rest = numeric(days).filter("metric = 'restingHr'").groupBy("subject").agg(F.avg("value").alias("rest"))
    top = workouts.groupBy("subject").agg(F.max("hr_max").alias("top"))
    x = workouts.join(rest, "subject", "left").join(top, "subject", "left")
    greatest = F.when(F.col("top") >= 120, F.col("top")).otherwise(190.0)
    l = load(F.col("dur") / 60, F.col("hr_avg"), F.coalesce("rest", F.lit(60.0)), greatest, F.coalesce(F.col("sex") == "female", F.lit(False)), F.col("effort"))  # noqa: E741
    d = x.select("subject", local_day(F.col("s"), tz).alias("day"), l.alias("load")).groupBy("subject", "day").agg(F.sum("load").alias("load"))
    out = folds.smoothed_load(d, ["subject"])
    return out.withColumn("ramp", daily.ramp(out, ["subject"]))


def nutrition_log(rows: DataFrame, nutrients: list[str], most: int = 300) -> DataFrame:
    """One entry for each minute and source with its nutrients; the first most of a subject, and whether there are more."""
    x = rows.filter((F.col("k") == "ev") & F.col("agg").isin(*nutrients)).select("subject", "src", "agg", "s", "v")
    return series.first_rows(daily.entries_by_minute(x, ["subject", "src"], nutrients), ["subject"], [F.asc("minute"), F.asc("src")], most)


def profile(rows: DataFrame, today: str) -> DataFrame:
    """subject, birth, sex, age, expected_max_hr from the latest profile event."""
    x = rows.filter((F.col("type") == PROFILE) & (F.col("k") == "ev") & (F.col("agg") == "Profile")).groupBy("subject").agg(F.max_by("extra", F.struct("s", "seq")).alias("extra"))
    x = x.select("subject", F.try_to_date(F.get_json_object("extra", "$.dob"), "yyyy-MM-dd").alias("birth"), F.get_json_object("extra", "$.sex").alias("sex"))
    age = age_at(F.col("birth"), F.lit(today).cast("date"))
    return x.withColumns({"age": age, "expected_max_hr": F.floor(208 - 0.7 * age + 0.5)})


def race_goals(goals: DataFrame, today: str) -> DataFrame:
    """goals (subject, race, day, metres, seconds) with days to go and even pace per km and mile."""
    per = lambda m: pace(F.col("seconds") / F.col("metres") * m)
    return goals.withColumns({"days_to_go": F.datediff("day", F.lit(today).cast("date")), "per_km": per(1000.0), "per_mile": per(1609.344)})


def with_raw_index(workouts: DataFrame, index: DataFrame) -> DataFrame:
    """workouts with what raw data there is of them (subject, wid, complete)."""
    return workouts.join(index, ["subject", "wid"], "left").withColumn("complete", F.coalesce("complete", F.lit(False)))


def block_comparison(now: DataFrame, prior: DataFrame, metrics: list[str]) -> DataFrame:
    """subject and for each metric its value now, before, and the change in percent."""
    x = now.join(prior.select("subject", *(F.col(m).alias(f"{m}_prior") for m in metrics)), "subject", "left")
    return x.withColumns({f"{m}_change": half_up(100 * (F.col(m) - F.col(f"{m}_prior")) / F.when(F.col(f"{m}_prior") != 0, F.col(f"{m}_prior")), 1) for m in metrics})
