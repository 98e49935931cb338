"""Lifetime totals and chunks of event samples."""

import pytest
from pyspark.sql import functions as F

from paceline.operators import lifetime

W = "subject string, id string, seq long, s long, activity string, seconds double, climb string, hr_avg double"
GONE, DAYS, RAW = "subject string, id string, seq long", "subject string, day string, seq long, m map<string,string>", "subject string, id string, seq long, hr_points long, gps_points long"
DAY = 86_400_000


def test_metres(spark):
    cases = [("12 m", 12.0), ("1250 cm", 12.5), ("2 KM", 2000.0), ("10 ft", 3.048), ("100 in", 2.54), ("1 mi", 1609.344), ("12", None), ("x m", None), ("3 yd", None), ("", None), (None, None), ("4  m extra", 4.0)]
    got = spark.createDataFrame(cases, "t string, want double").select("want", lifetime.metres(F.col("t")).alias("got")).collect()
    assert [r.got if r.got is None else pytest.approx(r.got) for r in got] == [r.want for r in got]


def test_totals_after_replacements_and_deletions(spark):
    w = [("u", "a", 1, 0, "run", 600.0, "100 m", 120.0), ("u", "a", 5, 0, "run", 1200.0, "1250 cm", 150.0), ("u", "b", 2, DAY, "ride", 60.0, "-3 m", None), ("u", "c", 3, DAY + 5, "", -7.0, None, 100.0), ("u", "d", 1, 0, "swim", 9.0, None, None), ("u", "e", 1, 0, "swim", 9.0, None, None), ("u", "e", 8, 9 * DAY, "walk", 30.0, "bad", -1.0), ("u", None, 1, 0, "x", 1.0, None, None)]
    gone = [("u", "d", 4), ("u", "e", 6), ("u", "zz", 1), ("v", "a", 9)]
    days = [("u", "d1", 1, {"steps": "10", "hrv": "40"}), ("u", "d1", 2, {"steps": "30", "sleepAsleepMin": "400"}), ("u", "d2", 1, {"steps": "5", "hrv": "1", "swimDistanceM": "x"}), ("w", "d1", 1, {"activeKcal": "7.5"}), ("u", None, 9, {"steps": "99"})]
    raw = [("u", "a", 1, 100, 50), ("u", "a", 2, 0, 60), ("u", "d", 1, 7, 7), ("u", "e", 1, 7, 7), ("u", "e", 7, 3, 0)]
    f = spark.createDataFrame
    got = {r.subject: r for r in lifetime.totals(f(w, W), f(gone, GONE), f(days, DAYS), f(raw, RAW)).collect()}
    u = got["u"]
    assert (u.workouts, u.training_seconds, u.climbed_metres, u.beats, u.workout_days, u.activities) == (4, 1290.0, 12.5, 3000.0, 3, 3)
    assert (u.steps, u.sleep_minutes, u.swim_metres, u.hrv_days, u.hr_points, u.gps_points) == (35.0, 400.0, 0.0, 1, 103, 60)
    assert set(got) == {"u", "w"} and (got["w"].workouts, got["w"].active_kcal, got["w"].hr_points) == (0, 7.5, 0)
    none = lifetime.totals(f([], W), f([], GONE), f([], DAYS), f([], RAW))
    assert none.count() == 0


def test_event_chunks(spark):
    c = "subject string, type string, unit string, bundle string, source string, start long, end long, value double, category int, id string"
    of = lambda i, v, source="app", **k: ("u", k.get("ty", "ox"), k.get("unit", "%"), "b", source, i, k.get("end", i), v, k.get("c"), k.get("id", f"i{i}"))
    rows = [of(i, i / 100) for i in range(7)] + [of(8, float("nan")), of(9, float("inf")), of(9, None), of(3, 0.5, "watch", id=None), of(3, None, ty="sleep", unit=None, c=2, end=9), of(1, 5.0, ty="hr", unit="bpm")]
    x = lifetime.event_chunks(spark.createDataFrame(rows, c), size=3).orderBy("type", "source", "chunk").collect()
    got = [(r.type, r.source, r.chunk, r.n, r.start, r.end, r.value and [pytest.approx(v) for v in r.value], r.category, r.ids) for r in x]
    assert got == [
        ("hr", "app", 0, 1, [1], None, [5.0], None, ["i1"]), ("ox", "app", 0, 3, [0, 1, 2], None, [0.0, 1.0, 2.0], None, ["i0", "i1", "i2"]), ("ox", "app", 1, 3, [3, 4, 5], None, [3.0, 4.0, 5.0], None, ["i3", "i4", "i5"]),
        ("ox", "app", 2, 1, [6], None, [6.0], None, ["i6"]), ("ox", "watch", 0, 1, [3], None, [50.0], None, None), ("sleep", "app", 0, 1, [3], [9], None, [2], ["i3"]),
    ]
