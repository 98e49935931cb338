"""A marathon forecast from training data, with its uncertainty: estimators, modifiers and their combination as columns.

Every function works on all runners at once. The published formulas and thresholds are in Config.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.clock import monday
from paceline.functions.numbers import coefficient_of_variation, half_up, normal_cdf
from paceline.operators.intervals import longest_gap, stretches


@dataclass(frozen=True)
class Config:
    """Fixed values of the model; distances in metres, sigma and penalties in percent, times in weeks unless named otherwise."""

    marathon: float = 42_195.0
    half: float = 21_097.5
    ten_k: float = 10_000.0
    five_k: float = 5_000.0
    r_default: float = math.log2(2.19)
    r_clamp: tuple[float, float] = (1.04, 1.22)
    r_below_half: float = 1.06
    high_km: float = 90.0
    high_long_runs: int = 3
    high_delta: float = -0.02
    low_km: float = 50.0
    low_delta: float = 0.02
    sigma_half_fresh: float = 3.5
    sigma_half: float = 5.0
    sigma_ten_k: float = 5.0
    sigma_five_k: float = 7.0
    sigma_training: float = 12.0
    personal_sigma: float = -1.0
    effort_hr: dict = field(default_factory=lambda: {"half": 0.88, "ten_k": 0.9, "five_k": 0.9})
    max_age: float = 16.0
    fresh: float = 8.0
    tolerance: float = 0.06
    tagged_range: tuple[float, float] = (4_500.0, 23_000.0)
    earlier_sigma: float = 6.5
    earlier_sigma_per_week: float = 0.1
    earlier_lapse_sigma: float = 2.0
    earlier_no_fit_sigma: float = 1.0
    earlier_credit: float = 5.0
    mass_per_percent: float = 0.5
    mass_cap: float = 4.0
    prior_sigma: float = 4.0
    prior_odd_sigma: float = 2.0
    blend: float = 0.5
    disagreement: float = 3.0
    disagreement_sigma: float = 1.0
    fit_band: tuple[float, float] = (0.65, 0.82)
    fit_at: float = 0.75
    fit_splits: int = 15
    fit_hr_sd: float = 0.02
    fit_gain: float = 10.0
    fit_cv: float = 0.1
    fit_temp: float = 22.0
    marathon_band: tuple[float, float] = (0.82, 0.92)
    marathon_at: float = 0.87
    marathon_hr_sd: float = 0.015
    marathon_stretch: int = 3
    training: tuple[float, float, float, float, float, float] = (11.03, 98.46, -0.0053, 0.387, 0.1, 0.23)
    training_fat: float = 15.0
    training_sigma: tuple[float, float] = (7.0, 9.0)
    training_weeks: int = 6
    sigma_floor: float = 0.85
    race_day_sigma: float = 2.0
    far_sigma: float = 1.0
    near_weeks: float = 6.0
    z80: float = 1.2816
    modifier_cap: float = 5.0
    heat: tuple[float, float, float] = (15.0, 0.4, 8.0)
    course: dict = field(default_factory=lambda: {"flat": 0.0, "rolling": 1.0, "hilly": 2.5})
    shoes: float = -1.0
    labels: tuple = ((2, "very unlikely"), (4, "unlikely"), (6, "toss-up"), (8, "likely"), (10, "very likely"))


CONFIG = Config()


def converted(seconds: Column, metres: Column | float, r: Column | float, target: float) -> Column:
    return seconds * F.pow(F.lit(target) / metres, r if isinstance(r, Column) else F.lit(r))


def to_marathon(seconds: Column, metres: Column, r: Column, c: Config = CONFIG) -> Column:
    """A race time as a marathon time; below the half, the usual exponent leads to the half first."""
    at_half = converted(converted(seconds, metres, c.r_below_half, c.half), F.lit(c.half), r, c.marathon)
    return F.when(metres >= c.half, converted(seconds, metres, r, c.marathon)).otherwise(at_half)


def volume_r(weekly_km: Column, long_runs: Column, c: Config = CONFIG) -> Column:
    """The exponent for a training volume."""
    return c.r_default + F.when((weekly_km >= c.high_km) & (long_runs >= c.high_long_runs), c.high_delta).when(weekly_km < c.low_km, c.low_delta).otherwise(0.0)


def personal_r(marathon_s: Column, race_s: Column, metres: Column, c: Config = CONFIG) -> Column:
    """A runner's own exponent from a marathon and a shorter race, within limits; null where it makes no sense."""
    half_s = F.when(metres < c.half, converted(race_s, metres, c.r_below_half, c.half)).otherwise(race_s)
    r = F.log(marathon_s / half_s) / F.log(F.lit(c.marathon) / F.greatest(metres, F.lit(c.half)))
    sane = (marathon_s > 0) & (race_s > 0) & (metres > 0) & (metres < c.marathon)
    return F.when(sane, F.least(F.lit(c.r_clamp[1]), F.greatest(F.lit(c.r_clamp[0]), r)))


def distance_class(metres: Column) -> Column:
    return F.when(metres >= 18_000, "half").when(metres >= 8_000, "ten_k").otherwise("five_k")


def qualifies(kind: Column, hr_fraction: Column, tagged: Column, run_m: Column, metres: Column, c: Config = CONFIG) -> Column:
    """Whether an effort is race quality: tagged, or hard enough in a run of about its length."""
    need = F.when(kind == "half", c.effort_hr["half"]).when(kind == "ten_k", c.effort_hr["ten_k"]).otherwise(c.effort_hr["five_k"])
    return tagged | F.coalesce((hr_fraction >= need) & (run_m <= metres * (1 + c.tolerance)), F.lit(False))


def race_source(efforts: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Of each runner's qualifying efforts (age_weeks up to the limit): a half, else 10 km, else 5 km, the most recent."""
    place = F.when(F.col("kind") == "half", 0).when(F.col("kind") == "ten_k", 1).otherwise(2)
    x = efforts.filter(F.col("qualifies") & (F.col("age_weeks") <= c.max_age)).withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(place, "age_weeks", "seconds")))
    return x.filter("_n = 1").drop("_n")


def lower_bound(efforts: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, seconds: the fastest marathon implied by efforts that do not qualify."""
    x = efforts.filter(~F.col("qualifies") & (F.col("age_weeks") <= c.max_age))
    return x.groupBy("subject").agg(F.min(to_marathon(F.col("seconds"), F.col("metres"), F.lit(c.r_default), c)).alias("seconds"))


def heat_percent(temp: Column, c: Config = CONFIG) -> Column:
    """What warmth costs, percent of the time."""
    return F.coalesce(F.least(F.greatest((temp - c.heat[0]) * c.heat[1], F.lit(0.0)), F.lit(c.heat[2])), F.lit(0.0))


def race_estimate(source: DataFrame, c: Config = CONFIG, training: bool = False) -> DataFrame:
    """subject, seconds, sigma from race efforts with weekly_km, long_runs and own_r (or null)."""
    r = F.coalesce("own_r", volume_r(F.col("weekly_km"), F.col("long_runs"), c))
    mild = F.col("seconds") / (1 + heat_percent(F.col("temp"), c) / 100)
    by_class = F.when(F.col("kind") == "half", F.when(F.col("age_weeks") <= c.fresh, c.sigma_half_fresh).otherwise(c.sigma_half)).when(F.col("kind") == "ten_k", c.sigma_ten_k).otherwise(c.sigma_five_k)
    sigma = F.lit(c.sigma_training) if training else by_class + F.when(F.col("own_r").isNotNull(), c.personal_sigma).otherwise(0.0)
    return source.select("subject", to_marathon(mild, F.col("metres"), r, c).alias("seconds"), sigma.alias("sigma"))


def earlier_race_estimate(source: DataFrame, c: Config = CONFIG) -> DataFrame:
    """As race_estimate() for an older race, with fit_ratio (speed now over then), volume_ratio, maintained, mass_now, mass_then and block_weeks."""
    base = race_estimate(source, c).withColumnsRenamed({"seconds": "_s", "sigma": "_sigma"})
    x = source.join(base, "subject")
    credit = 1 + c.earlier_credit / 100
    fit = F.least(F.lit(credit), F.greatest(F.lit(1 / credit), F.col("fit_ratio")))
    by_volume = F.col("maintained") & F.col("volume_ratio").isNotNull()
    moved = F.when(F.col("fit_ratio").isNotNull(), F.col("_s") / fit).when(by_volume, F.col("_s") * F.greatest(F.lit(1 / credit), F.col("volume_ratio"))).otherwise(F.col("_s"))
    mass = c.mass_per_percent * 100 * (F.col("mass_now") - F.col("mass_then")) / F.when(F.col("mass_then") > 0, F.col("mass_then"))
    lighter = F.when(F.col("fit_ratio").isNull(), F.greatest(F.lit(-c.mass_cap), F.least(F.lit(c.mass_cap), F.coalesce(mass, F.lit(0.0))))).otherwise(0.0)
    sigma = c.earlier_sigma + c.earlier_sigma_per_week * F.greatest(F.lit(0.0), F.col("age_weeks") - F.col("block_weeks")) + F.when(~F.col("maintained"), c.earlier_lapse_sigma).otherwise(0.0) + F.when(F.col("fit_ratio").isNull(), c.earlier_no_fit_sigma).otherwise(0.0)
    return x.select("subject", (moved * (1 + lighter / 100)).alias("seconds"), sigma.alias("sigma"))


def efficiency_points(splits: DataFrame, runs: DataFrame, band: tuple[float, float], least: int = 1, c: Config = CONFIG) -> DataFrame:
    """subject, block, hr (fraction of the maximum), speed of full splits in steady, flat, mild runs inside a heart-rate band.

    splits: subject, block, wid, split, pace, hr, gain, partial. runs: subject, wid, max_hr, temp, gain_per_km.
    The first split is a warm-up; only stretches of at least so many splits count.
    """
    full = splits.filter(~F.col("partial") & (F.col("split") > 1))
    steady = full.groupBy("subject", "wid").agg(coefficient_of_variation(F.col("pace")).alias("cv")).filter(F.col("cv") <= c.fit_cv)
    good = runs.filter((F.col("temp").isNull() | (F.col("temp") < c.fit_temp)) & (F.col("gain_per_km") < c.fit_gain))
    x = full.join(steady.select("subject", "wid"), ["subject", "wid"]).join(good.select("subject", "wid", "max_hr"), ["subject", "wid"])
    x = x.withColumn("_f", F.col("hr") / F.col("max_hr"))
    ok = F.col("_f").between(*band) & (F.col("gain") < c.fit_gain) & (F.col("pace") > 0)
    x = stretches(x, ["subject", "wid"], ["split"], ok, least)
    return x.select("subject", "block", F.col("_f").alias("hr"), (1000 / F.col("pace")).alias("speed"))


def speed_at(points: DataFrame, at: float, splits: int, hr_sd: float) -> DataFrame:
    """subject, block, n, speed: least squares of speed on heart rate, read at a fraction; null under the guards."""
    a = points.groupBy("subject", "block").agg(F.count("*").alias("n"), F.stddev_samp("hr").alias("_sd"), F.regr_slope("speed", "hr").alias("_b"), F.regr_intercept("speed", "hr").alias("_a"))
    ok = (F.col("n") >= splits) & (F.col("_sd") >= hr_sd) & (F.col("_b") > 0)
    return a.select("subject", "block", "n", F.when(ok, F.col("_a") + F.col("_b") * at).alias("speed"))


def prior_marathon_estimate(x: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, seconds, sigma from prior_seconds, r75 and r87 (speeds now over then, either may be null) and representative."""
    both = F.col("r75").isNotNull() & F.col("r87").isNotNull()
    ratio = F.when(both, (1 - c.blend) * F.col("r75") + c.blend * F.col("r87")).otherwise(F.coalesce("r75", "r87"))
    apart = F.abs(F.col("r87") / F.col("r75") - 1) * 100 > c.disagreement
    sigma = c.prior_sigma + F.when(F.col("representative"), 0.0).otherwise(c.prior_odd_sigma) + F.when(both & apart, c.disagreement_sigma).otherwise(0.0)
    return x.filter(F.col("prior_seconds").isNotNull() & ratio.isNotNull()).select("subject", (F.col("prior_seconds") / ratio).alias("seconds"), sigma.alias("sigma"))


def training_minutes(weekly_km: Column, pace: Column, fat: Column, c: Config = CONFIG) -> Column:
    a, b, k, d, e, f = c.training
    return a + b * F.exp(k * weekly_km) + d * pace + e * F.exp(f * fat)


def training_estimate(x: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, seconds, sigma from weekly_km, pace, fat (or null), weeks and sex."""
    fat = F.coalesce("fat", F.lit(c.training_fat))
    sigma = F.when(F.col("sex") == "female", c.training_sigma[1]).otherwise(c.training_sigma[0])
    return x.filter(F.col("weeks") >= c.training_weeks).select("subject", (60 * training_minutes(F.col("weekly_km"), F.col("pace"), fat, c)).alias("seconds"), sigma.alias("sigma"))


def volume_repeat(prior_s: Column, km: Column, pace: Column, prior_km: Column, prior_pace: Column, c: Config = CONFIG) -> Column:
    """The prior marathon scaled by the training formula then and now; a cross-check."""
    fat = F.lit(c.training_fat)
    sane = (km > 0) & (pace > 0) & (prior_km > 0) & (prior_pace > 0)
    return F.when(sane, prior_s * training_minutes(km, pace, fat, c) / training_minutes(prior_km, prior_pace, fat, c))


def training_indices(runs: DataFrame, end: Column, weeks: int) -> DataFrame:
    """subject, weekly_km, pace, weeks (with runs), long_runs (30 km or more), gap (days) over the weeks that end with a day.

    runs: subject, day, km, seconds, indoor. The pace is that of outdoor runs where there are any.
    """
    first = F.date_add(end, 1 - 7 * weeks)
    x = runs.filter(F.col("day").between(first, end))
    out = ~F.coalesce("indoor", F.lit(False))
    per_km = lambda cond: F.sum(F.when(cond, F.col("seconds"))) / F.sum(F.when(cond, F.col("km")))
    a = x.groupBy("subject").agg((F.sum("km") / weeks).alias("weekly_km"), F.coalesce(per_km(out), per_km(F.lit(True))).alias("pace"), F.countDistinct(monday(F.col("day"))).alias("weeks"), F.count(F.when(F.col("km") >= 30, 1)).alias("long_runs"))
    return a.join(longest_gap(runs, ["subject"], first, end), "subject", "left")


def representative(splits: DataFrame, runs: DataFrame) -> DataFrame:
    """subject, wid, representative of marathons: not hot, not fading, not walked, not paced for another."""
    half = F.when(F.col("split") <= 21, "a").otherwise("b")
    sums = splits.filter(~F.col("partial")).withColumn("_h", half)
    median = sums.groupBy("subject", "wid").agg(F.median("pace").alias("_m"))
    x = sums.join(median, ["subject", "wid"]).groupBy("subject", "wid").agg(
        F.avg(F.when(F.col("_h") == "a", F.col("pace"))).alias("a"), F.avg(F.when(F.col("_h") == "b", F.col("pace"))).alias("b"), F.avg((F.col("pace") > 1.5 * F.col("_m")).cast("double")).alias("walked"), F.avg("hr").alias("hr")
    )
    x = x.join(runs.select("subject", "wid", "temp", "max_hr"), ["subject", "wid"])
    odd = (F.col("temp") > 18) | (F.col("b") > 1.05 * F.col("a")) | (F.col("walked") >= 0.2) | ((F.col("b") <= 0.95 * F.col("a")) & (F.col("hr") < 0.75 * F.col("max_hr")))
    return x.select("subject", "wid", (~F.coalesce(odd, F.lit(False))).alias("representative"))


CHECKS = ("p_decoupling", "p_long_runs", "p_goal", "p_late")


def modifiers(x: DataFrame, c: Config = CONFIG) -> DataFrame:
    """x with penalty (percent, capped) and its parts from decoupling (median of the last three), n_decoupling, long_runs, goal_km and late_hr (share).

    A part is null where its check can't be made.
    """
    parts = {
        "p_decoupling": F.when(F.col("n_decoupling") >= 2, F.when(F.col("decoupling") > 10, 2.0).when(F.col("decoupling") >= 5, 1.0).otherwise(0.0)),
        "p_long_runs": F.when(F.col("long_runs") < 2, 2.0).when(F.col("long_runs") == 2, 1.0).otherwise(0.0),
        "p_goal": F.when(F.col("goal_km").isNotNull(), F.when(F.col("goal_km") < 10, 1.0).otherwise(0.0)),
        "p_late": F.when(F.col("late_hr").isNotNull(), F.when(F.col("late_hr") > 0.9, 1.0).otherwise(0.0)),
    }
    return x.withColumns(parts).withColumn("penalty", _capped(c))


def _capped(c: Config) -> Column:
    return F.least(sum((F.coalesce(p, F.lit(0.0)) for p in CHECKS), F.lit(0.0)), F.lit(c.modifier_cap))


def relative_modifiers(now: DataFrame, then: DataFrame, weights: DataFrame, c: Config = CONFIG) -> DataFrame:
    """now (modifiers()) with parts and penalty eased by what the block of the prior marathon (then, the same columns) had as well.

    The prior marathon's time holds the durability of its block, so by the weight (subject, weight) of that estimate only what is
    worse than then counts. A part unknown in either block stays.
    """
    x = now.join(then.select("subject", *(F.col(p).alias(f"_{p}") for p in CHECKS)), "subject", "left").join(weights.select("subject", F.col("weight").alias("_w")), "subject", "left")
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("_w", F.lit(0.0))))
    eased = lambda p: half_up(w * F.greatest(F.lit(0.0), F.col(p) - F.col(f"_{p}")) + (1 - w) * F.col(p), 2)
    x = x.withColumns({p: F.when(F.col(p).isNotNull() & F.col(f"_{p}").isNotNull(), eased(p)).otherwise(F.col(p)) for p in CHECKS})
    return x.withColumn("penalty", half_up(_capped(c), 2)).drop("_w", *(f"_{p}" for p in CHECKS))


def combine(estimates: DataFrame, weeks: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, central, sigma (seconds), n: estimates (subject, seconds, sigma) weighted by inverse variance.

    The estimators share a runner, so sigma has a floor; what they disagree by and the race day are added in quadrature.
    """
    x = estimates.withColumn("_s", F.col("seconds") * F.col("sigma") / 100).withColumn("_w", 1 / (F.col("_s") * F.col("_s")))
    w = Window.partitionBy("subject")
    x = x.withColumn("_c", F.sum(F.col("_w") * F.col("seconds")).over(w) / F.sum("_w").over(w))
    a = x.groupBy("subject").agg(
        F.first("_c").alias("central"), F.greatest(F.sqrt(1 / F.sum("_w")), c.sigma_floor * F.min("_s")).alias("_own"),
        F.sqrt(F.sum(F.col("_w") * F.pow(F.col("seconds") - F.col("_c"), 2)) / F.sum("_w")).alias("_spread"), F.count("*").alias("n"),
    )
    a = a.join(weeks, "subject", "left")
    day = F.col("central") * c.race_day_sigma / 100
    far = F.when(F.col("weeks_to_race") > c.near_weeks, F.col("central") * c.far_sigma / 100).otherwise(0.0)
    spread = F.when(F.col("n") > 1, F.col("_spread")).otherwise(0.0)
    sigma = F.sqrt(F.col("_own") * F.col("_own") + spread * spread + day * day + far * far)
    return a.select("subject", "central", sigma.alias("sigma"), "n")


def adjusted(x: DataFrame, c: Config = CONFIG) -> DataFrame:
    """x (central, sigma, penalty, temp, course, shoes) with the forecast: time and sigma after all adjustments."""
    heat = heat_percent(F.col("temp"), c)
    course = F.when(F.col("course") == "hilly", c.course["hilly"]).when(F.col("course") == "rolling", c.course["rolling"]).otherwise(0.0)
    shoes = F.when(F.col("shoes"), c.shoes).otherwise(0.0)
    factor = (1 + F.col("penalty") / 100) * (1 + heat / 100) * (1 + course / 100) * (1 + shoes / 100)
    doubt = F.sqrt(F.pow(0.5 * heat, 2) + F.pow(0.5 * course, 2) + F.pow(F.abs(shoes), 2)) / 100 * F.col("central")
    return x.withColumns({"forecast": F.col("central") * factor, "forecast_sigma": F.sqrt(F.col("sigma") * F.col("sigma") + doubt * doubt)})


def likelihood(x: DataFrame, c: Config = CONFIG) -> DataFrame:
    """x (forecast, forecast_sigma, goal) with probability, score (0 to 10), label, and the 80 % range."""
    p = normal_cdf((F.col("goal") - F.col("forecast")) / F.col("forecast_sigma"))
    x = x.withColumn("probability", p).withColumn("score", F.floor(p * 100 + 0.5) / 10)
    label = F.lit(c.labels[-1][1])
    for bound, name in reversed(c.labels):
        label = F.when(F.col("score") <= bound, name).otherwise(label)
    return x.withColumns({"label": label, "low": F.col("forecast") - c.z80 * F.col("forecast_sigma"), "high": F.col("forecast") + c.z80 * F.col("forecast_sigma")})


def temperature_scenarios(x: DataFrame, temps: tuple[float, ...] = (10.0, 15.0, 20.0, 25.0)) -> DataFrame:
    """A row for each temperature of the race day."""
    return likelihood(adjusted(x.drop("temp").withColumn("temp", F.explode(F.array(*map(F.lit, temps))))))


def confidence(x: DataFrame) -> DataFrame:
    """x with confidence (percent): the weights of nine kinds of evidence; what is null counts nothing."""
    share = lambda name, full: F.least(F.coalesce(F.col(name), F.lit(0)) / full, F.lit(1.0))
    race = F.when(F.col("source_kind") == "half", F.when(F.col("source_age") <= 8, 25).otherwise(10)).when(F.col("source_kind") == "ten_k", F.when(F.col("source_age") <= 8, 18).otherwise(10)).when(F.col("source_kind").isNotNull(), 10).when(F.col("earlier"), 12).when(F.col("lower_bound"), 5).otherwise(0)
    continuity = 15 * share("weeks", 12) * F.when(F.col("gap") > 10, 0.5).otherwise(1.0)
    long_runs = 15 * share("long_runs", 3)
    coverage = 10 * share("hr_coverage", 0.8)
    prior = F.when(F.col("prior") == "full", 10).when(F.col("prior") == "odd", 5).when(F.col("prior") == "summary", 3).otherwise(0)
    max_hr = F.when(F.col("max_hr_source") == "user", 5).when(F.col("max_hr_source") == "observed", 3).otherwise(0)
    decoupling = 5 * share("n_decoupling", 2)
    fueling = 5 * share("n_fueled", 2)
    near = F.when(F.col("weeks_to_race") <= 6, 10).when(F.col("weeks_to_race") <= 12, 5).otherwise(0)
    return x.withColumn("confidence", F.floor(sum((half_up(F.coalesce(k, F.lit(0)), 1) for k in (race, continuity, long_runs, coverage, prior, max_hr, decoupling, fueling, near)), F.lit(0.0)) + 0.5))


def status(weeks: Column, own_data: Column) -> Column:
    """Whether there is enough: six of sixteen weeks with runs, and an estimate other than the training formula."""
    return F.when(F.coalesce((weeks >= 6) & own_data, F.lit(False)), "ok").otherwise("insufficient_data")


def backtest(forecasts: DataFrame) -> DataFrame:
    """n, error (median absolute percent), inside (share in the 80 % range), pit (mean) of forecasts with actual seconds."""
    error = 100 * F.abs(F.col("forecast") - F.col("actual")) / F.col("actual")
    pit = normal_cdf((F.col("actual") - F.col("forecast")) / F.col("forecast_sigma"))
    return forecasts.agg(F.count("*").alias("n"), F.median(error).alias("error"), F.avg(F.col("actual").between(F.col("low"), F.col("high")).cast("double")).alias("inside"), F.avg(pit).alias("pit"))


def speed_ratios(splits: DataFrame, runs: DataFrame, c: Config = CONFIG) -> DataFrame:
    """subject, r75, r87: speed now over the prior block's at two fractions of the maximum heart rate; null where a fit fails."""
    out = None
    for name, band, at, sd, least in (("r75", c.fit_band, c.fit_at, c.fit_hr_sd, 1), ("r87", c.marathon_band, c.marathon_at, c.marathon_hr_sd, c.marathon_stretch)):
        fit = speed_at(efficiency_points(splits, runs, band, least, c), at, c.fit_splits, sd)
        of = lambda block: F.max(F.when(F.col("block") == block, F.col("speed")))
        x = fit.groupBy("subject").agg((of("now") / of("then")).alias(name))
        out = x if out is None else out.join(x, "subject", "full")
    return out


def training_effort(efforts: DataFrame, c: Config = CONFIG) -> DataFrame:
    """Of each runner's efforts that do not qualify, the one that implies the fastest marathon."""
    x = efforts.filter(~F.col("qualifies") & (F.col("age_weeks") <= c.max_age))
    implied = to_marathon(F.col("seconds"), F.col("metres"), F.lit(c.r_default), c)
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("subject").orderBy(implied, "age_weeks"))).filter("_n = 1").drop("_n")


def assess(runs: DataFrame, efforts: DataFrame, splits: DataFrame, run_info: DataFrame, prior: DataFrame, durability: DataFrame, goals: DataFrame, as_of: str, c: Config = CONFIG, then: DataFrame | None = None) -> DataFrame:
    """One row for each runner with a goal: the forecast, its range, probability and label, and status.

    runs: subject, wid, day, km, seconds, indoor. efforts: subject, kind, metres, seconds, hr_fraction, tagged, run_m, age_weeks,
    temp. splits, run_info: as in efficiency_points(), blocks 'now' and 'then'. prior: subject, prior_seconds, representative.
    durability: subject, decoupling, n_decoupling, goal_km, late_hr. goals: subject, goal (seconds), weeks_to_race, temp,
    course, shoes, fat, sex. then: durability and long_runs of the block before the prior marathon, if known.
    plans.analysis derives efforts, splits and durability from streams.
    """
    day = F.lit(as_of).cast("date")
    block, recent, season = (training_indices(runs, day, n) for n in (16, 8, 12))
    e = efforts.withColumn("qualifies", qualifies(F.col("kind"), F.col("hr_fraction"), F.col("tagged"), F.col("run_m"), F.col("metres"), c))
    volume = season.select("subject", "weekly_km", "long_runs").withColumn("own_r", F.lit(None).cast("double"))
    source = race_source(e, c)
    race = race_estimate(source.join(volume, "subject"), c)
    fallback = training_effort(e.join(source.select("subject"), "subject", "left_anti"), c).join(volume, "subject")
    estimates = race.withColumn("name", F.lit("race")).unionByName(race_estimate(fallback, c, training=True).withColumn("name", F.lit("training effort")))
    repeat = prior_marathon_estimate(prior.join(speed_ratios(splits, run_info, c), "subject"), c)
    estimates = estimates.unionByName(repeat.withColumn("name", F.lit("prior marathon")))
    formula = training_estimate(recent.select("subject", "weekly_km", "pace", "weeks").join(goals.select("subject", "fat", "sex"), "subject"), c)
    estimates = estimates.unionByName(formula.withColumn("name", F.lit("training")))
    used = estimates.groupBy("subject").agg(F.sort_array(F.collect_set("name")).alias("estimators"))
    central = combine(estimates, goals.select("subject", "weeks_to_race"), c)
    x = goals.join(central, "subject", "left").join(used, "subject", "left").join(block.select("subject", "weeks", "gap"), "subject", "left").join(season.select("subject", "long_runs"), "subject", "left")
    x = modifiers(x.join(durability, "subject", "left").withColumns({"long_runs": F.coalesce("long_runs", F.lit(0)), "n_decoupling": F.coalesce("n_decoupling", F.lit(0))}), c)
    if then is not None:
        weight = 1 / F.pow(F.col("seconds") * F.col("sigma"), 2)
        anchored = estimates.groupBy("subject").agg((F.sum(F.when(F.col("name") == "prior marathon", weight).otherwise(0.0)) / F.sum(weight)).alias("weight"))
        x = relative_modifiers(x, modifiers(then, c), anchored, c)
    own = F.arrays_overlap(F.coalesce("estimators", F.array().cast("array<string>")), F.array(F.lit("race"), F.lit("training effort"), F.lit("prior marathon")))
    x = x.withColumn("status", status(F.col("weeks"), own))
    out = likelihood(adjusted(x, c), c)
    ok = F.col("status") == "ok"
    return out.select("subject", "goal", "status", "estimators", "penalty", *(F.when(ok, F.col(k)).alias(k) for k in ("forecast", "forecast_sigma", "low", "high", "probability", "score", "label")))
