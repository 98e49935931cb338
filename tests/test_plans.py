"""Workout questions and the forecast on inputs with known answers."""

import math
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paceline.operators import product
from paceline.plans import forecast, workouts

T0 = 1_718_800_000_000
KEY = ("u", "w1")


@pytest.fixture(scope="module")
def run(spark):
    """6 km at 300 s/km, a pause of 60 s after 900 moving seconds, heart rate 140 then 150, 30 m up and 30 m down."""
    wall = lambda moving: T0 + 1000 * (moving + (60 if moving > 900 else 0))
    w = spark.createDataFrame([(*KEY, T0, T0 + 1_860_000, "Running", 1, "b", 6000.0, 1800.0)], "subject string, wid string, s long, e long, activity string, seq long, batch string, dist double, dur double")
    dist = [(*KEY, "DistanceWalkingRunning", 1, "b", wall(30 * i), 100.0) for i in range(1, 61)]
    hr = [(*KEY, "HeartRate", 1, "b", wall(5 * i), 140.0 if 5 * i < 900 else 150.0) for i in range(361)]
    streams = spark.createDataFrame(dist + hr, "subject string, wid string, stream string, gen long, batch string, t long, v double")
    route = spark.createDataFrame([(*KEY, wall(5 * i), 50 + i * 6000 / 360 / 111_195.08, 8.0, 100 + (i / 6 if i <= 180 else (360 - i) / 6)) for i in range(361)], "subject string, wid string, t long, lat double, lon double, alt double")
    events = spark.createDataFrame([(*KEY, T0 + 900_000, 1), (*KEY, T0 + 960_000, 2)], "subject string, wid string, t long, type int")
    return w, streams, route, events


def test_splits(run):
    w, streams, route, events = run
    rows = workouts.splits(w, streams, route, events).orderBy("split").collect()
    assert [r.seconds for r in rows] == [300.0] * 6 and [r.pace for r in rows] == [300.0] * 6
    assert rows[0].hr == 140.0 and rows[5].hr == 150.0 and not any(r.partial for r in rows)
    assert rows[0].gain == pytest.approx(10.0, abs=2.1)


def test_zones_drift_and_efforts(run):
    w, streams, route, events = run
    z = {r.zone: r for r in workouts.hr_zones(w, streams, events, bounds=[120, 145, 160, 180]).collect()}
    assert z[2].seconds == pytest.approx(900, abs=5) and z[3].seconds == pytest.approx(900, abs=5)
    d = workouts.hr_drift(w, streams, route, events).first()
    assert (d.hr1, d.hr2) == (140.0, 150.0) and d.change == 7.1 and d.decoupling == pytest.approx(6.7, abs=0.1)
    e = {r.metres: r for r in workouts.best_efforts(w, streams, route, events, (1000.0, 5000.0, 10000.0)).collect()}
    assert e[1000.0].seconds == 300.0 and e[5000.0].seconds == 1500.0 and 10000.0 not in e


def test_elevation_and_shown_route(run):
    _, _, route, _ = run
    r = workouts.elevation(route).first()
    assert r.gain == pytest.approx(30, abs=2.5) and r.loss == pytest.approx(30, abs=2.5)
    assert r.up_percent + r.level_percent + r.down_percent == pytest.approx(100, abs=0.2)
    shown = workouts.shown_route(route, most=50)
    assert shown.count() == 50 and shown.agg(F.min("d")).first()[0] >= 300


def test_listing_and_context(spark, run):
    w, _, _, _ = run
    later = w.withColumns({"seq": F.lit(2).cast("long"), "dist": F.lit(6100.0)})
    gone = spark.createDataFrame([], "subject string, wid string")
    now = workouts.current(w.unionByName(later), gone)
    r = workouts.listing(now, T0, T0 + 1, "run").first()
    assert (r.km, r.minutes, r.truncated) == (6.1, 30.0, False)
    assert workouts.listing(now, T0, T0 + 1, "u%n").count() == 0
    entries = spark.createDataFrame([("u", T0 - 3_600_000, 30.0), ("u", T0 - 9_000_000, 5.0), ("u", T0 + 60_000, 20.0)], "subject string, t long, grams double")
    assert [x.grams for x in workouts.before_workouts(entries, now, 2).collect()] == [30.0]
    assert workouts.during_workouts(entries, now).count() == 1


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_a_half_in_1_43_30_is_a_marathon_in_3_46_40(spark):
    s = value(spark, forecast.to_marathon(F.lit(6210.0), F.lit(21_097.5), F.lit(forecast.CONFIG.r_default)))
    assert s == pytest.approx(6210 * 2.19, abs=0.5) and s == pytest.approx(13600, abs=1)
    short = value(spark, forecast.to_marathon(F.lit(2400.0), F.lit(10_000.0), F.lit(1.13)))
    assert short == pytest.approx(2400 * 2.10975**1.06 * 2**1.13, rel=1e-9)


def test_exponents(spark):
    r0 = math.log2(2.19)
    assert value(spark, forecast.volume_r(F.lit(95.0), F.lit(3))) == pytest.approx(r0 - 0.02)
    assert value(spark, forecast.volume_r(F.lit(40.0), F.lit(0))) == pytest.approx(r0 + 0.02)
    assert value(spark, forecast.personal_r(F.lit(20000.0), F.lit(6000.0), F.lit(21_097.5))) == 1.22
    assert value(spark, forecast.personal_r(F.lit(20000.0), F.lit(0.0), F.lit(21_097.5))) is None


def test_race_source_and_estimates(spark):
    rows = [("u", "half", 21_097.5, 6210.0, 10.0, True), ("u", "half", 21_097.5, 6000.0, 3.0, True), ("u", "ten_k", 10_000.0, 2600.0, 1.0, True), ("u", "five_k", 5000.0, 1100.0, 1.0, False)]
    e = spark.createDataFrame(rows, "subject string, kind string, metres double, seconds double, age_weeks double, qualifies boolean")
    source = forecast.race_source(e)
    assert source.first().seconds == 6000.0
    assert forecast.lower_bound(e).count() == 1
    x = source.withColumns({"weekly_km": F.lit(60.0), "long_runs": F.lit(1), "own_r": F.lit(None).cast("double"), "temp": F.lit(25.0)})
    r = forecast.race_estimate(x).first()
    assert r.sigma == 3.5 and r.seconds == pytest.approx(6000 / 1.04 * 2.19)
    t = forecast.training_estimate(spark.createDataFrame([("u", 60.0, 330.0, None, 8, "female")], "subject string, weekly_km double, pace double, fat double, weeks int, sex string")).first()
    assert t.seconds == pytest.approx(60 * (11.03 + 98.46 * math.exp(-0.0053 * 60) + 0.387 * 330 + 0.1 * math.exp(0.23 * 15))) and t.sigma == 9.0


def test_combination_likelihood_and_range(spark):
    e = spark.createDataFrame([("u", 13_000.0, 4.0), ("u", 13_400.0, 7.0)], "subject string, seconds double, sigma double")
    c = forecast.combine(e, spark.createDataFrame([("u", 3.0)], "subject string, weeks_to_race double")).first()
    w = [1 / (13_000 * 0.04) ** 2, 1 / (13_400 * 0.07) ** 2]
    central = (w[0] * 13_000 + w[1] * 13_400) / sum(w)
    spread = math.sqrt((w[0] * (13_000 - central) ** 2 + w[1] * (13_400 - central) ** 2) / sum(w))
    own = max(math.sqrt(1 / sum(w)), 0.85 * 520)
    assert c.central == pytest.approx(central) and c.sigma == pytest.approx(math.sqrt(own**2 + spread**2 + (0.02 * central) ** 2))
    x = spark.createDataFrame([("u", 13_000.0, 500.0, 13_000.0, 0.0, 10.0, "flat", False)], "subject string, central double, sigma double, goal double, penalty double, temp double, course string, shoes boolean")
    r = forecast.likelihood(forecast.adjusted(x)).first()
    assert r.probability == pytest.approx(0.5, abs=1e-6) and r.score == 5.0 and r.label == "toss-up" and r.high - r.low == pytest.approx(2 * 1.2816 * 500)
    warm = {s.temp: s.forecast for s in forecast.temperature_scenarios(x).collect()}
    assert warm[15.0] == 13_000.0 and warm[25.0] == pytest.approx(13_000 * 1.04)


def test_efficiency_fit_and_prior_marathon(spark):
    splits = [("u", b, f"{b}{k}", i, 1000 / (1 + 3 * (0.66 + 0.01 * (i + k)) + d), 190 * (0.66 + 0.01 * (i + k)), 2.0, False) for b, d in (("now", 0.1), ("then", 0.0)) for k in range(3) for i in range(1, 10)]
    s = spark.createDataFrame(splits, "subject string, block string, wid string, split int, pace double, hr double, gain double, partial boolean")
    runs = s.select("subject", "wid").distinct().withColumns({"max_hr": F.lit(190.0), "temp": F.lit(12.0), "gain_per_km": F.lit(2.0)})
    fit = {r.block: r.speed for r in forecast.speed_at(forecast.efficiency_points(s, runs, (0.65, 0.82)), 0.75, 15, 0.02).collect()}
    assert fit["then"] == pytest.approx(3.25) and fit["now"] == pytest.approx(3.35)
    x = spark.createDataFrame([("u", 13_400.0, 3.35 / 3.25, None, True)], "subject string, prior_seconds double, r75 double, r87 double, representative boolean")
    assert forecast.prior_marathon_estimate(x).first().seconds == pytest.approx(13_000)


def test_training_indices_modifiers_and_confidence(spark):
    end = date(2024, 6, 30)
    runs = [("u", end - timedelta(days=7 * i), 30.0 if i < 2 else 10.0, 3000.0 if i else 9000.0, i == 5) for i in range(8)]
    r = forecast.training_indices(spark.createDataFrame(runs, "subject string, day date, km double, seconds double, indoor boolean"), F.lit(end).cast("date"), 8).first()
    assert r.weeks == 8 and r.long_runs == 2 and r.weekly_km == 120 / 8 and r.gap == 7
    m = forecast.modifiers(spark.createDataFrame([("u", 11.0, 3, 1, 5.0, 0.95)], "subject string, decoupling double, n_decoupling int, long_runs int, goal_km double, late_hr double")).first()
    assert m.penalty == 5.0
    c = "source_kind string, source_age double, earlier boolean, lower_bound boolean, weeks int, gap int, long_runs int, hr_coverage double, prior string, max_hr_source string, n_decoupling int, n_fueled int, weeks_to_race double"
    assert forecast.confidence(spark.createDataFrame([("half", 3.0, False, False, 16, 4, 3, 0.9, "full", "user", 2, 2, 4.0)], c)).first().confidence == 100


def test_product_events_are_checked(spark):
    rows = [("sync_finished", "1.2", "success", 500), ("evil", None, None, None), ("sync_finished", "bad version!", None, None), ("connected", None, None, -1)]
    good, bad = product.checked_events(spark.createDataFrame(rows, "name string, app_version string, outcome string, duration_ms long"))
    assert good.count() == 1 and bad.count() == 3


def test_an_assessment_from_tables(spark):
    end = date(2024, 6, 30)
    runs = [("u", f"r{i}", end - timedelta(days=2 * i), 12.0 if i % 4 else 30.0, (12.0 if i % 4 else 30.0) * 310, False) for i in range(50)] + [("new", "n1", end, 5.0, 1500.0, False)]
    r = spark.createDataFrame(runs, "subject string, wid string, day date, km double, seconds double, indoor boolean")
    e = spark.createDataFrame([("u", "half", 21_097.5, 5400.0, 0.9, False, 21_200.0, 4.0, 12.0), ("u", "ten_k", 10_000.0, 2500.0, 0.8, False, 15_000.0, 1.0, None)], "subject string, kind string, metres double, seconds double, hr_fraction double, tagged boolean, run_m double, age_weeks double, temp double")
    s = spark.createDataFrame([], "subject string, block string, wid string, split int, pace double, hr double, gain double, partial boolean")
    info = spark.createDataFrame([], "subject string, wid string, max_hr double, temp double, gain_per_km double")
    prior = spark.createDataFrame([], "subject string, prior_seconds double, representative boolean")
    d = spark.createDataFrame([("u", 4.0, 3, 20.0, 0.85)], "subject string, decoupling double, n_decoupling int, goal_km double, late_hr double")
    g = spark.createDataFrame([(s, 11_900.0, 4.0, 12.0, "flat", False, None, None) for s in ("u", "new")], "subject string, goal double, weeks_to_race double, temp double, course string, shoes boolean, fat double, sex string")
    rows = {x.subject: x for x in forecast.assess(r, e, s, info, prior, d, g, str(end)).collect()}
    assert rows["new"].status == "insufficient_data" and rows["new"].forecast is None
    u = rows["u"]
    assert u.status == "ok" and u.estimators == ["race", "training"] and u.penalty == 0.0
    assert 5400 * 2.0 < u.forecast < 5400 * 2.3 and u.low < u.forecast < u.high and u.label
