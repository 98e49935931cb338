"""Totals of all that a subject has recorded, and samples of events in chunks of their source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.clock import local_day
from paceline.operators import dedup
from paceline.operators.codec import CHUNK

#: Metres of a unit of length.
METRES = {"m": 1.0, "cm": 0.01, "km": 1000.0, "ft": 0.3048, "in": 0.0254, "mi": 1609.344}
DAILY = {"steps": "steps", "walk_run_metres": "walkRunDistanceM", "cycling_metres": "cyclingDistanceM", "swim_metres": "swimDistanceM", "sleep_minutes": "sleepAsleepMin", "active_kcal": "activeKcal"}


def metres(text: Column) -> Column:
    """Metres of a length as text, like '1250 cm'; null if it has no known unit or no number."""
    parts = F.filter(F.split(text, " "), lambda p: p != "")
    unit = F.create_map(*(F.lit(x) for pair in METRES.items() for x in pair))
    return F.try_multiply(F.get(parts, F.lit(0)).try_cast("double"), F.try_element_at(unit, F.lower(F.get(parts, F.lit(1)))))


def current_workouts(workouts: DataFrame, deleted: DataFrame) -> DataFrame:
    """The last version (by seq) of each workout whose last sign is no deletion: one that is sent again after it counts."""
    gone = deleted.select("subject", "id", F.col("seq").alias("_gone")).groupBy("subject", "id").agg(F.max("_gone").alias("_gone"))
    last = dedup.latest(workouts.filter("id is not null"), ["subject", "id"], ["seq"])
    return last.join(gone, ["subject", "id"], "left").filter("_gone is null or seq > _gone").drop("_gone")


def totals(workouts: DataFrame, deleted: DataFrame, days: DataFrame, details: DataFrame, timezone: str = "UTC") -> DataFrame:
    """A row for each subject with anything: counts and sums over its current workouts, days and raw data; 0 where it has none.

    workouts: subject, id, seq, s (ms), activity, seconds, climb (text), hr_avg. deleted: subject, id, seq. days: subject, day, seq,
    m (map of text). details: subject, id, seq, hr_points, gps_points; the last positive count of each stays, unless its workout is deleted after.
    """
    w = current_workouts(workouts, deleted)
    duration = F.greatest(F.coalesce("seconds", F.lit(0.0)), F.lit(0.0))
    climb = F.greatest(F.coalesce(metres(F.col("climb")), F.lit(0.0)), F.lit(0.0))
    beats = F.when(F.col("hr_avg") > 0, F.col("hr_avg") * duration / 60).otherwise(0.0)
    own = w.groupBy("subject").agg(
        F.count("*").alias("workouts"), F.sum(duration).alias("training_seconds"), F.sum(climb).alias("climbed_metres"), F.sum(beats).alias("beats"),
        F.count_distinct(local_day(F.col("s"), timezone)).alias("workout_days"), F.count_distinct(F.when(F.col("activity") != "", F.col("activity"))).alias("activities"),
    )
    last_day = dedup.latest(days.filter("day is not null and m is not null"), ["subject", "day"], ["seq"])
    number = lambda k: F.try_element_at("m", F.lit(k)).try_cast("double")
    daily = last_day.groupBy("subject").agg(*(F.sum(F.coalesce(number(k), F.lit(0.0))).alias(name) for name, k in DAILY.items()), F.count_if(number("hrv").isNotNull()).alias("hrv_days"))
    gone = deleted.groupBy("subject", "id").agg(F.max("seq").alias("_gone"))
    came = details.join(gone, ["subject", "id"], "left").filter("_gone is null or seq > _gone").groupBy("subject", "id")
    points = lambda c: F.max_by(F.when(F.col(c) > 0, F.col(c)), F.when(F.col(c) > 0, F.col("seq"))).alias(c)
    raw = came.agg(points("hr_points"), points("gps_points")).groupBy("subject").agg(F.sum("hr_points").alias("hr_points"), F.sum("gps_points").alias("gps_points"))
    x = own.join(daily, "subject", "full").join(raw, "subject", "full")
    return x.select("subject", *(F.coalesce(F.col(c), F.lit(0).cast(k)).alias(c) for c, k in x.dtypes if c != "subject"))


def event_samples(samples: DataFrame) -> DataFrame:
    """samples (subject, type, unit, bundle, source, start, end, value, category, id) as they are stored: percents as hundredths of one times 100, no value that is not finite."""
    v = F.when(F.col("unit") == "%", F.col("value") * 100).otherwise(F.col("value"))
    return samples.withColumn("value", v).filter("value is not null or category is not null").filter(F.col("value").isNull() | (~F.isnan("value") & (F.abs("value") < float("inf"))))


def event_chunks(samples: DataFrame, size: int = CHUNK) -> DataFrame:
    """subject, type, unit, bundle, source, chunk, n, start, end, value, category, ids (arrays): a source's samples in chunks of size, by start and id.

    end, value and category are null where a chunk has none that says anything (all ends equal starts); ids where one is missing.
    """
    by = ["subject", "type", "unit", "bundle", "source"]
    n = F.row_number().over(Window.partitionBy(*by).orderBy("start", F.coalesce("id", F.lit("")), "end", "value", "category")) - 1
    x = event_samples(samples).withColumns({"_n": n, "chunk": F.floor(n / size).cast("int")})
    rows = F.sort_array(F.collect_list(F.struct("_n", "start", "end", "value", "category", "id")))  # at most size of them
    x = x.groupBy(*by, "chunk").agg(rows.alias("_r"))
    of = lambda c: F.transform("_r", lambda r: r[c])
    some = lambda c: F.when(F.exists("_r", lambda r: r[c].isNotNull()), of(c)).alias(c)
    ends = F.when(F.exists("_r", lambda r: r["end"] != r["start"]), of("end")).alias("end")
    ids = F.when(F.forall("_r", lambda r: r["id"].isNotNull()), of("id")).alias("ids")
    return x.select(*by, "chunk", F.size("_r").alias("n"), of("start").alias("start"), ends, some("value"), some("category"), ids)
