"""Daily questions, choices among runs, and upkeep, on small inputs."""

import json
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from paceline.operators import selection
from paceline.plans import health
from paceline.sources import maintenance

T0 = 1_704_067_200_000  # 2024-01-01
H, D = 3_600_000, 86_400_000
ROW = "subject string, type string, k string, id string, s long, e long, v double, v2 double, v3 double, agg string, src string, extra string, seq long, batch string"


@pytest.fixture(scope="module")
def rows(spark):
    days = [("u", "_daily", "day", str(date(2024, 1, 1) + timedelta(i)), T0 + i * D, T0 + i * D + D, None, None, None, None, None, json.dumps({"m": {"steps": 6000 + (i % 7) * 1000, "restingHr": 55 + i % 5, "sleepBedtime": "22:30", "sleepWakeTime": "06:30", "sleepAsleepMin": 420 + 15 * (i % 4)}}), 1, "b") for i in range(30)]
    late = [("u", "_daily", "day", "2024-01-01", T0, T0 + D, None, None, None, None, None, json.dumps({"m": {"steps": 9}}), 2, "c")]
    hours = [("u", "_hourly", "hs", None, T0 + i * H, T0 + i * H + H, 55.0 + i % 24, 50.0 + i % 24, 65.0 + i % 24, "HeartRate", None, None, 1, "b") for i in range(30 * 24)]
    food = [("u", "_events", "ev", f"f{i}", T0 + 12 * H, T0 + 12 * H, float(v), None, None, n, "app", None, 1, "b") for i, (n, v) in enumerate([("DietaryProtein", 20), ("DietaryWater", 300), ("DietaryProtein", 25)])]
    prof = [("u", "_events_profile", "ev", "p", T0, T0, None, None, None, "Profile", None, json.dumps({"dob": "1984-03-01", "sex": "female"}), 1, "b")]
    return spark.createDataFrame(days + late + hours + food + prof, ROW)


def test_daily_context_and_rollup(rows):
    days = health.daily_metrics(rows)
    x = health.daily_context(days, "2024-01-01", "2024-01-07", groups=["activity"])
    assert {(str(r.day), r.metric, r.value) for r in x.collect()} == {("2024-01-01", "steps", "9.0"), *((f"2024-01-0{i + 1}", "steps", f"{6000.0 + i * 1000}") for i in range(1, 7))}
    w = health.daily_context(days, "2024-01-08", "2024-01-21", metrics=["steps"], rollup="week").collect()
    assert {(str(r.start), r["mean"], r.days) for r in w} == {("2024-01-08", 9000.0, 7), ("2024-01-15", 9000.0, 7)}


def test_hours_by_local_day(rows):
    x = health.hourly(rows, "HeartRate", "2024-01-03", "2024-01-03", "Europe/Berlin", by_day=True).first()
    assert (str(x.day), x.hours, x.low, x.high) == ("2024-01-03", 24, 50.0, 88.0)
    assert health.hourly(rows, "HeartRate", "2024-01-03", "2024-01-04").count() == 48


def test_recovery_joins_the_night(rows):
    x = {(r.metric, str(r.day)): r for r in health.recovery(health.daily_metrics(rows), rows).collect()}
    night = x["sleepHrMin", "2024-01-10"]  # from 21:31 on: hours 22 and 23, then 0 to 6
    assert night.value == 50.0
    r = x["restingHr", "2024-01-30"]
    assert r.n == 29 and r.status in {"above baseline", "within baseline range"}
    assert x["restingHr", "2024-01-03"].status == "not enough baseline"


def test_training_load_uses_the_recorded_rest(spark, rows):
    w = spark.createDataFrame([("u", T0 + 10 * H, 3600.0, 150.0, 180.0, None, None), ("u", T0 + 2 * D, 1800.0, None, None, 5.0, None)], "subject string, s long, dur double, hr_avg double, hr_max double, effort double, sex string")
    x = {str(r.day): r for r in health.training_load(w, health.daily_metrics(rows)).collect()}
    f = (150 - 57.0) / (180 - 57.0)
    assert x["2024-01-01"].load == pytest.approx(60 * f * 0.64 * 2.718281828 ** (1.92 * f), rel=1e-6)
    assert x["2024-01-02"].load == 0 and x["2024-01-03"].load == 45.0


def test_nutrition_profile_and_goals(spark, rows):
    n = health.nutrition_log(rows, ["DietaryProtein", "DietaryWater"]).first()
    assert (n.DietaryProtein, n.DietaryWater, n.truncated) == (25.0, 300.0, False)
    p = health.profile(rows, "2024-02-29").first()
    assert (p.age, p.sex, p.expected_max_hr) == (39, "female", 181)
    g = health.race_goals(spark.createDataFrame([("u", "r", date(2024, 4, 1), 42_195.0, 12_600.0)], "subject string, race string, day date, metres double, seconds double"), "2024-03-01").first()
    assert (g.days_to_go, g.per_km, g.per_mile) == (31, "4:59", "8:01")


def test_cleaning(spark):
    hr = spark.createDataFrame([("u", "w", i, v) for i, v in enumerate([120.0] * 95 + [10.0] * 6)], "subject string, wid string, t long, v double")
    assert selection.clean_heart_rate(hr, ["subject", "wid"], F.lit(190)).filter("unreliable").count() == 101
    pts = spark.createDataFrame([("u", "w", 1, 50.0, 8.0), ("u", "w", 1, 50.0, 8.0), ("u", "w", 2, 95.0, 8.0), ("u", "w", 3, float("nan"), 8.0)], "subject string, wid string, t long, lat double, lon double")
    assert selection.valid_points(pts).count() == 1
    s = spark.createDataFrame([("u", i, p, q) for i, (p, q) in enumerate([(300.0, False), (310.0, False), (700.0, False), (900.0, True)])], "subject string, split int, pace double, partial boolean")
    assert sorted(r.split for r in selection.clean_splits(s, ["subject"]).collect()) == [0, 1, 3]
    on = spark.createDataFrame([("u", "sleep")], "subject string, category string")
    assert selection.consented(spark.createDataFrame([("u", "sleep"), ("u", "cycle"), ("x", "sleep")], "subject string, category string"), on).count() == 1


def test_choices(spark):
    runs = spark.createDataFrame([("u", 1, 42.2, date(2023, 4, 1)), ("u", 2, 42.3, date(2023, 10, 1)), ("u", 3, 30.0, date(2024, 1, 1))], "subject string, id long, km double, day date")
    day = lambda t: F.lit(t).cast("date")
    assert selection.prior_marathon(runs, day("2024-02-01"), day("2021-02-01")).first().id == 2
    assert spark.range(1).select(selection.prior_seconds(F.lit(None).cast("double"), F.lit(12000.0), F.lit(43.0))).first()[0] == pytest.approx(12000 * 42.195 / 43)
    races = spark.createDataFrame([("u", "a", date(2024, 3, 1), 10_000.0), ("u", "b", date(2024, 5, 1), 42_195.0), ("u", "c", date(2023, 5, 1), 42_195.0)], "subject string, race string, day date, metres double")
    assert selection.next_race(races, day("2024-01-01")).first().race == "b"
    assert spark.range(1).select(selection.valid_goal(F.lit("r1"), F.lit("2024-02-30"), F.lit(9000))).first()[0] is False
    assert spark.range(1).select(selection.resolved_max_hr(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(40))).first()[0] == 180
    pts = spark.createDataFrame([("u", T0 + 1000 * i) for i in range(10)], "subject string, t long")
    assert selection.offset_window(pts, spark.createDataFrame([("u", T0)], "subject string, start long"), ["subject"], 2, 4).count() == 3


def test_upkeep(spark, tmp_path):
    act = spark.createDataFrame([("a", T0), ("b", T0 + 300 * D)], "subject string, at long")
    assert [r.subject for r in maintenance.inactive(act, T0 + 400 * D).collect()] == ["a"]
    assert maintenance.unexpired(act, T0 + 310 * D).count() == 1
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "subject string, type string").write.parquet(path)
    assert maintenance.purge(spark, path, subject="a").count() == 1 and maintenance.purge(spark, path, "a", "x").count() == 2
    files = spark.createDataFrame([("rows/a", 5), ("old/b", 7), ("old/c", 1)], "path string, size long")
    r = maintenance.by_layout(files, ["rows"]).first()
    assert (r.layout, r.files, r.bytes) == ("old", 2, 8)
