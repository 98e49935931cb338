"""What the forecast needs of each run, from its streams, over all runs at once; and what follows from many runs.

Tables as in paceline.plans.workouts. info: subject, wid, max_hr, indoor, temp of the runs that are to be analysed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.numbers import coefficient_of_variation
from paceline.operators import asof, selection, series
from paceline.operators.intervals import islands
from paceline.plans import workouts
from paceline.plans.forecast import CONFIG, Config, distance_class
from paceline.plans.workouts import KEY
from paceline.sources.shared import written

#: Fixed values of the durability checks: kilometres, share of goal pace, and what a steady long run is.
LONG_KM, GOAL_KM, LATE_KM, PACE_SHARE, STEADY_CV, FLAT_GAIN, MILD_TEMP, LAST = 25.0, 20.0, 25, 0.03, 0.08, 10.0, 22.0, 3


def cleaned_streams(streams: DataFrame, info: DataFrame) -> tuple[DataFrame, DataFrame]:
    """streams with implausible heart rates left out, and subject, wid, unreliable of those that have any."""
    hr = workouts.points(streams, "HeartRate").join(info.select(*KEY, "max_hr"), KEY)
    x = selection.clean_heart_rate(hr, KEY, F.col("max_hr"))
    kept = x.filter("v is not null").select(*streams.columns)
    return streams.filter("stream <> 'HeartRate'").unionByName(kept), x.groupBy(*KEY).agg(F.max("unreliable").alias("unreliable"))


def run_splits(w: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame, info: DataFrame) -> DataFrame:
    """Splits of a kilometre without those of lost signal; indoors, an unknown climb is none."""
    x = workouts.splits(w, streams, routes, events).join(info.select(*KEY, "indoor"), KEY)
    x = x.withColumn("gain", F.when(F.col("indoor") & F.col("gain").isNull(), 0.0).otherwise(F.col("gain"))).drop("indoor")
    return selection.clean_splits(x, KEY)


def run_efforts(w: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame, lengths: tuple[float, ...]) -> DataFrame:
    """subject, wid, metres, seconds, hr: best efforts and the mean heart rate in them, both ends included."""
    x = workouts.best_efforts(w, streams, routes, events, lengths)
    spans = x.select(*KEY, "metres", "seconds", F.col("start").cast("long").alias("a"), (F.col("end").cast("long") + 1).alias("b"))
    return series.mean_within(workouts.points(streams, "HeartRate"), spans, KEY, "hr").drop("a", "b")


def analysed(w: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame, info: DataFrame, lengths: tuple[float, ...] | None = None, c: Config = CONFIG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(runs, splits, efforts) of the workouts in info.

    runs: subject, wid, reason (why a run is left out, else null), distance_m, moving, hr_coverage, unreliable, decoupling,
    gain_per_km, first_half, second_half (moving seconds). Splits and efforts are those of runs without a reason.
    Each part is small beside the streams and is written once to the shared folder (sources.shared), so that no plan holds them all.
    """
    w = w.join(info.select(*KEY), KEY, "left_semi")
    clean, doubt = cleaned_streams(streams, info)
    dist = workouts.distances(streams, routes, w).join(w.select(*KEY), KEY, "left_semi")
    any_raw = streams.select(*KEY).unionByName(routes.select(*KEY)).distinct().withColumn("_raw", F.lit(True))
    total = dist.groupBy(*KEY).agg(F.max("d").alias("distance_m"))
    x = w.select(*KEY).join(any_raw, KEY, "left").join(total, KEY, "left")
    reason = F.when(F.col("_raw").isNull(), "no raw data").when(F.col("distance_m").isNull(), "no distance").when(F.col("distance_m") < 1000, "shorter than 1 km")
    x = written(x.withColumn("reason", reason).drop("_raw"), "reasons")
    usable = w.join(x.filter("reason is null").select(*KEY), KEY, "left_semi")
    stops = workouts.pauses(events, usable)
    moving = workouts.moving_seconds(usable, stops).drop("paused")
    splits = written(run_splits(usable, clean, routes, events, info), "splits")
    efforts = written(run_efforts(usable, clean, routes, events, lengths or (c.five_k, c.ten_k, c.half, c.marathon)), "efforts")

    readings = workouts.points(clean, "HeartRate").join(usable.select(*KEY, F.col("e").alias("end")), KEY)
    share = selection.heart_rate_coverage(series.weights(readings, KEY, pauses=stops, end="end"), moving, KEY).join(doubt.select(*KEY), KEY, "left_semi")
    fall = workouts.hr_drift(usable, clean, routes, events).select(*KEY, "decoupling")
    full = splits.filter(~F.col("partial")).groupBy(*KEY).agg(F.when(F.count("*") == F.count("gain"), F.avg("gain")).alias("gain_per_km"))
    # the moving time until half the distance is done
    middle = asof.at(dist, x.filter("reason is null").select(*KEY, (F.col("distance_m") / 2).alias("d")), KEY, "d", "t", "t1").filter("t1 is not null")
    middle = middle.join(usable.select(*KEY, F.col("s").alias("t0")), KEY)
    halves = series.moving(middle, KEY, stops).select(*KEY, (F.col("moving_ms") / 1000).alias("first_half"))

    for part in (moving, share.withColumnRenamed("share", "hr_coverage"), doubt, fall, full, halves):
        x = x.join(written(part, "part"), KEY, "left")
    odd = F.coalesce("unreliable", F.lit(False))
    x = x.withColumns({"unreliable": odd, "decoupling": F.when(~odd, F.col("decoupling")), "second_half": F.col("moving") - F.col("first_half")})
    return x.select(*KEY, "reason", "distance_m", "moving", "hr_coverage", "unreliable", "decoupling", "gain_per_km", "first_half", "second_half"), splits, efforts


def race_efforts(runs: DataFrame, efforts: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, wid, kind, metres, seconds, hr_fraction, tagged, run_m, age_weeks, temp: what may be a race, for forecast.assess().

    runs: subject, wid, run_m, run_s (whole run), tagged, age_weeks, temp, max_hr, unreliable. A tagged race of about a usual distance
    counts with its best effort over it, any other with its whole length; other runs with each best effort.
    """
    usual = F.when(F.col("run_m") < (c.five_k + c.ten_k) / 2, c.five_k).when(F.col("run_m") < (c.ten_k + c.half) / 2, c.ten_k).otherwise(c.half)
    tagged = F.coalesce("tagged", F.lit(False))
    runs = runs.withColumns({"tagged": tagged, "_usual": usual})
    about = F.coalesce(F.abs(F.col("_usual") - F.col("run_m")) / F.col("_usual") <= c.tolerance, F.lit(False))
    races = runs.filter(F.col("tagged") & F.col("run_m").between(*c.tagged_range))
    hr = F.when(F.col("max_hr") > 0, F.col("hr") / F.col("max_hr"))
    best = efforts.filter(F.col("metres").isin(c.five_k, c.ten_k, c.half)).select(*KEY, "metres", "seconds", "hr")
    out = [*KEY, distance_class(F.col("metres")).alias("kind"), "metres", "seconds", "hr_fraction", "tagged", "run_m", "age_weeks", "temp"]
    of_races = races.filter(about).join(best, KEY).filter("metres = _usual").withColumn("hr_fraction", hr).select(*out)
    whole = races.join(of_races.select(*KEY), KEY, "left_anti").filter("run_s is not null")
    whole = whole.withColumns({"metres": F.col("run_m"), "seconds": F.col("run_s"), "hr_fraction": F.lit(None).cast("double")}).select(*out)
    others = runs.filter(~F.col("tagged")).join(best, KEY).withColumn("hr_fraction", F.when(~F.coalesce("unreliable", F.lit(False)), hr)).select(*out)
    return of_races.unionByName(whole).unionByName(others)


def durability(runs: DataFrame, splits: DataFrame, goals: DataFrame) -> DataFrame:
    """subject, decoupling, n_decoupling, goal_km, late_hr for forecast.modifiers(), null where no run can tell; a row for each goal.

    runs: the analysed runs of a window: subject, wid, s, km, temp, max_hr, unreliable, decoupling, gain_per_km. goals: subject, goal (seconds).
    """
    goal_pace = F.col("goal") / (CONFIG.marathon / 1000)
    full = splits.filter(~F.col("partial") & (F.col("pace") > 0))
    steady = full.groupBy(*KEY).agg(coefficient_of_variation(F.col("pace")).alias("_cv")).filter(F.col("_cv") < STEADY_CV)
    fit = runs.filter((F.col("km") >= LONG_KM) & ~F.col("unreliable") & F.col("decoupling").isNotNull() & (F.col("gain_per_km") < FLAT_GAIN) & (F.col("temp").isNull() | (F.col("temp") < MILD_TEMP)))
    last = fit.join(steady, KEY, "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("s"), "wid"))).filter(F.col("_n") <= LAST)
    falls = last.groupBy("subject").agg(F.median("decoupling").alias("decoupling"), F.count("*").cast("int").alias("n_decoupling"))

    paced = splits.join(goals.select("subject", goal_pace.alias("_goal")), "subject").join(runs.select(*KEY, "km", "max_hr", "unreliable"), KEY)
    long = paced.filter(F.col("km") >= GOAL_KM)
    at_pace = ~F.col("partial") & (F.col("pace") > 0) & (F.col("pace") <= F.col("_goal") / (1 - PACE_SHARE))
    longest = islands(long, KEY, ["split"], at_pace).groupBy(*KEY, "island").agg(F.count("*").alias("_km")).groupBy("subject").agg(F.max("_km").alias("_km"))
    stretch = long.select("subject").distinct().join(longest, "subject", "left").select("subject", F.coalesce("_km", F.lit(0)).cast("double").alias("goal_km"))

    late = paced.filter((F.col("km") >= LATE_KM) & ~F.col("unreliable") & ~F.col("partial") & (F.col("split") > LATE_KM) & F.col("hr").isNotNull() & (F.abs(F.col("pace") - F.col("_goal")) <= PACE_SHARE * F.col("_goal")))
    late = late.groupBy("subject").agg(F.avg(F.col("hr") / F.col("max_hr")).alias("late_hr"))
    return goals.select("subject").distinct().join(falls, "subject", "left").join(stretch, "subject", "left").join(late, "subject", "left").withColumn("n_decoupling", F.coalesce("n_decoupling", F.lit(0)))
