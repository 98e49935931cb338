"""Analysis of runs from their streams, race efforts, durability and the plans of one workout, on inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from paceline.operators import daily, series
from paceline.plans import analysis, forecast, workouts
from paceline.sources import maintenance
from paceline.streaming.ingest import over_limit
from tests.test_plans import KEY, T0, run  # noqa: F401

INFO = "subject string, wid string, max_hr double, indoor boolean, temp double"


def test_a_run_from_its_streams(spark, run):  # noqa: F811
    w, streams, route, events = run
    named = lambda df, wid: df.withColumn("wid", F.lit(wid))
    bad = streams.withColumn("v", F.when((F.col("stream") == "HeartRate") & (F.col("t") % 50_000 == 0), 400.0).otherwise(F.col("v")))
    info = spark.createDataFrame([(*KEY, 190.0, False, 12.0), ("u", "w2", 190.0, False, None), ("u", "w3", 190.0, False, None)], INFO)
    of_both = lambda df, more=None: df.unionByName(named(df if more is None else more, "w3"))
    runs, splits, efforts = analysis.analysed(of_both(w).unionByName(named(w, "w2")), of_both(streams, bad), of_both(route), of_both(events), info)
    rows = {r.wid: r for r in runs.collect()}
    r = rows["w1"]
    assert rows["w3"].unreliable and rows["w3"].decoupling is None and rows["w3"].distance_m == 6000.0
    splits, efforts = splits.filter("wid = 'w1'"), efforts.filter("wid = 'w1'")
    assert rows["w2"].reason == "no raw data" and r.reason is None
    assert r.distance_m == 6000.0 and r.moving == 1800.0 and r.first_half == pytest.approx(900, abs=1) and r.second_half == pytest.approx(900, abs=1)
    assert r.hr_coverage == pytest.approx(1.0, abs=0.02) and not r.unreliable and r.decoupling == pytest.approx(6.7, abs=0.1)
    assert r.gain_per_km == pytest.approx(5.0, abs=1.0)
    assert [s.pace for s in splits.orderBy("split").collect()] == [300.0] * 6
    e = efforts.collect()
    assert [(x.metres, x.seconds) for x in e] == [(5000.0, 1500.0)] and 140 < e[0].hr < 150


def test_a_missing_coordinate_or_input_counts_nothing(spark, run):  # noqa: F811
    _, _, route, _ = run
    assert series.route_distance(route, list(("subject", "wid"))).agg(F.min("d")).first()[0] == 0.0
    shown = workouts.shown_route(route, most=50).agg(F.min("d"), F.max("d")).first()
    assert 300 <= shown[0] < 320 and 5680 < shown[1] <= 5700.1
    c = "source_kind string, source_age double, earlier boolean, lower_bound boolean, weeks int, gap int, long_runs int, hr_coverage double, prior string, max_hr_source string, n_decoupling int, n_fueled int, weeks_to_race double"
    assert forecast.confidence(spark.createDataFrame([(None,) * 13], c)).first().confidence == 0
    e = "subject string, kind string, metres double, seconds double, age_weeks double, weekly_km double, long_runs int, own_r double, temp double, fit_ratio double, volume_ratio double, maintained boolean, mass_now double, mass_then double, block_weeks double"
    x = forecast.earlier_race_estimate(spark.createDataFrame([("u", "half", 21_097.5, 6000.0, 30.0, 60.0, 1, None, None, None, None, True, None, None, 16.0)], e)).first()
    assert x.seconds == pytest.approx(6000 * 2.19)


def test_race_efforts(spark):
    rows = [("u", "race", 21_300.0, 6300.0, True, 2.0, 15.0, 190.0, False), ("u", "odd", 14_000.0, 4000.0, True, 2.0, None, 190.0, False), ("u", "long", 30_000.0, 10_000.0, False, 1.0, None, 190.0, False), ("u", "hard", 10_200.0, 2600.0, False, 1.0, None, 190.0, False), ("u", "doubt", 5_000.0, 1300.0, None, 1.0, None, 190.0, True), ("u", "far", 42_200.0, 13_000.0, True, 1.0, None, 190.0, False)]
    runs = spark.createDataFrame(rows, "subject string, wid string, run_m double, run_s double, tagged boolean, age_weeks double, temp double, max_hr double, unreliable boolean")
    best = [("u", "race", 21_097.5, 6210.0, None), ("u", "race", 10_000.0, 2900.0, 170.0), ("u", "long", 10_000.0, 3000.0, 185.0), ("u", "hard", 10_000.0, 2500.0, 174.8), ("u", "doubt", 5_000.0, 1300.0, 185.0), ("u", "far", 21_097.5, 6400.0, 170.0)]
    efforts = spark.createDataFrame(best, "subject string, wid string, metres double, seconds double, hr double")
    x = analysis.race_efforts(runs, efforts)
    x = x.withColumn("q", forecast.qualifies(F.col("kind"), F.col("hr_fraction"), F.col("tagged"), F.col("run_m"), F.col("metres")))
    got = {r.wid: (r.kind, r.seconds, r.q) for r in x.collect()}
    assert got == {"race": ("half", 6210.0, True), "odd": ("ten_k", 4000.0, True), "long": ("ten_k", 3000.0, False), "hard": ("ten_k", 2500.0, True), "doubt": ("five_k", 1300.0, False)}


def test_durability(spark):
    goal = 42.195 * 300.0
    long = [("u", f"r{i}", i, 30.0, 12.0, 190.0, False, float(4 + 2 * i), 2.0) for i in range(4)]
    runs = spark.createDataFrame(long + [("v", "s", 1, 10.0, 12.0, 190.0, False, 1.0, 2.0)], "subject string, wid string, s long, km double, temp double, max_hr double, unreliable boolean, decoupling double, gain_per_km double")
    rows = [("u", f"r{i}", k, 300.0 if k > 18 else 315.0, 171.5 if k > 25 else 150.0, False) for i in range(4) for k in range(1, 31)] + [("v", "s", k, 290.0, 150.0, False) for k in range(1, 11)]
    splits = spark.createDataFrame(rows, "subject string, wid string, split int, pace double, hr double, partial boolean")
    goals = spark.createDataFrame([("u", goal), ("v", goal), ("w", goal)], "subject string, goal double")
    got = {r.subject: r for r in analysis.durability(runs, splits, goals).collect()}
    u = got["u"]
    assert (u.decoupling, u.n_decoupling, u.goal_km) == (8.0, 3, 12.0) and u.late_hr == pytest.approx(171.5 / 190)
    for s in ("v", "w"):
        assert (got[s].decoupling, got[s].n_decoupling, got[s].goal_km, got[s].late_hr) == (None, 0, None, None)


def test_penalties_relative_to_the_prior_block(spark):
    c = "subject string, decoupling double, n_decoupling int, long_runs int, goal_km double, late_hr double"
    now = forecast.modifiers(spark.createDataFrame([("u", 11.0, 3, 1, 5.0, None), ("v", 10.0, 2, 3, 12.0, 0.95)], c))
    then = forecast.modifiers(spark.createDataFrame([("u", 6.0, 2, 2, None, 0.8)], c))
    assert {r.subject: r.penalty for r in now.collect()} == {"u": 5.0, "v": 2.0}
    weights = spark.createDataFrame([("u", 0.5), ("v", 0.5)], "subject string, weight double")
    got = {r.subject: (r.p_decoupling, r.p_long_runs, r.p_goal, r.p_late, r.penalty) for r in forecast.relative_modifiers(now, then, weights).collect()}
    assert got == {"u": (1.5, 1.5, 1.0, None, 4.0), "v": (1.0, 0.0, 0.0, 1.0, 2.0)}


def test_series_of_a_workout(run):  # noqa: F811
    w, streams, _, _ = run
    page = workouts.series_of(w, streams, "hr", 0, 100, most=10, raw=True, cursor=10).orderBy("offset").collect()
    assert [r.offset for r in page] == [5.0 * k for k in range(10, 20)] and {(r.n_range, r.next) for r in page} == {(21, 20)}
    few = workouts.series_of(w, streams, "HeartRate", 0, 20, most=10).collect()
    assert len(few) == 5 and {r.value for r in few} == {140.0}
    many = workouts.series_of(w, streams, "HeartRate", most=10).orderBy("offset").collect()
    assert len(many) == 10 and many[0].value == 140.0 and (many[-1].low, many[-1].high) == (150.0, 150.0) and many[1].offset == 186.0
    with pytest.raises(ValueError):
        workouts.series_of(w, streams, "HeartRate", 5, 1)


def test_detail_of_a_workout(spark, run):  # noqa: F811
    w, streams, _, events = run
    w = w.withColumn("day", F.lit("2024-06-19").cast("date"))
    days = spark.createDataFrame([("u", "2024-06-19", "restingHr", "50"), ("u", "2024-06-18", "steps", "9000"), ("u", "2024-06-01", "steps", "1")], "subject string, day string, metric string, value string").withColumn("day", F.col("day").cast("date"))
    marks = spark.createDataFrame([(*KEY, True)], "subject string, wid string, complete boolean")
    r = workouts.detail(w, events, streams, marks, days).first()
    assert r.paused_seconds == 60.0 and r.event_counts == {"1": 1, "2": 1} and r.streams == {"DistanceWalkingRunning": 60, "HeartRate": 361}
    assert r.raw_status == "complete" and r.same_day == {"restingHr": "50"} and r.previous_day == {"steps": "9000"}
    bare = workouts.detail(w, events.limit(0), streams.limit(0), marks.limit(0), days.limit(0)).first()
    assert bare.raw_status == "none" and bare.same_day is None and bare.paused_seconds == 0.0


def test_sources_of_distance(spark, run):  # noqa: F811
    w, streams, route, _ = run
    top = lambda source, s=streams: workouts.distances(s, route, w, source).agg(F.max("d")).first()[0]
    assert top("distance") == 6000.0 and top("route") == pytest.approx(6000, rel=1e-3) and top("auto") == 6000.0
    assert top("distance", streams.limit(0)) is None
    m = spark.createDataFrame([(*KEY, "DistanceCycling", 7.0), (*KEY, "DistanceWalkingRunning", 5.0)], "subject string, wid string, stream string, metres double")
    assert workouts.totals(m, w).first().metres == 5.0 and workouts.totals(m.limit(0), w).first().metres == 6000.0


def test_groups_limits_and_completeness(spark):
    names = spark.createDataFrame([("proteinG",), ("cycleMenstrualFlow",), ("basalBodyTempC",), ("bodyTemp",), ("steps",)], "m string")
    of = lambda g: {r.m for r in names.filter(daily.in_groups(F.col("m"), [g])).collect()}
    assert of("nutrition") == {"proteinG"} and of("cycle") == {"cycleMenstrualFlow", "basalBodyTempC"}
    n = spark.createDataFrame([("a", 61), ("b", 60)], "uid string, n long")
    assert [(r.uid, r.refused) for r in over_limit(n, 60).collect()] == [("a", 1)]
    claims = spark.createDataFrame([("a", "x", True), ("b", "x", True)], "subject string, type string, complete boolean")
    waiting = spark.createDataFrame([("a", 2)], "subject string, files long")
    assert {(r.subject, r.complete, r.files) for r in maintenance.completeness(claims, waiting).collect()} == {("a", False, 2), ("b", True, 0)}
