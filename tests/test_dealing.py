"""Unions under windows and joins are dealt by key in the plan that runs."""

import pytest

from paceline.operators import asof, intervals
from paceline.operators.dealing import dealt
from paceline.plans import workouts

KEY = ["u", "w"]


def windows_on_unions(df):
    """Windows of the plan with no exchange between them and a union below."""
    found, window, exchange = 0, False, False
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        node = line.lstrip(" :+-*()0123456789")
        if node.startswith("Window"):
            window, exchange = True, False
        elif node.startswith("Exchange"):
            exchange = True
        elif node.startswith("Union"):
            found += window and not exchange
            window = False
    return found


def by_key(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(*KEY)


@pytest.mark.parametrize("by", [["u"], ["u", "w"]])
def test_a_union_of_two_sides_of_one_key_is_dealt(spark, by):
    a, b = (spark.createDataFrame([("a", "x", i), ("b", "y", i)], "u string, w string, t long").repartition(*by) for i in (1, 2))
    assert "Union" not in dealt(a.unionByName(b), by)._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    got = dealt(a.unionByName(b), by).groupBy(*by).count()
    assert "Union" not in got._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert sorted(tuple(r)[-1] for r in got.collect()) == [2, 2]


def test_windows_of_operators_do_not_stand_on_unions(spark):
    points = by_key(spark, [("a", "x", 0, 0.0), ("a", "x", 10, 20.0)], "u string, w string, t long, d double")
    probes = by_key(spark, [("a", "x", 5)], "u string, w string, t long")
    x = asof.at(points, probes, KEY, "t", "d", "at")
    assert windows_on_unions(x) == 0 and [tuple(r) for r in x.collect()] == [("a", "x", 5, 10.0)]
    spans = by_key(spark, [("a", "x", 2, 6)], "u string, w string, s long, e long")
    windows = by_key(spark, [("a", "x", 0, 5)], "u string, w string, a long, b long")
    x = intervals.overlap_sums(windows, spans, KEY, "sum")
    assert windows_on_unions(x) == 0 and x.first()["sum"] == 3


def test_zones_of_many_runs_in_a_row(spark):
    """Failed in 13 of 31 runs with "Can't zip RDDs with unequal numbers of partitions: List(4, 8)"."""
    key = ("a", "x")
    w = spark.createDataFrame([(*key, 0, 1_860_000, "Running", 1, "b", 6000.0, 1800.0)], "subject string, wid string, s long, e long, activity string, seq long, batch string, dist double, dur double")
    streams = spark.createDataFrame([(*key, "HeartRate", 1, "b", 5000 * i, 140.0 if i < 180 else 150.0) for i in range(361)], "subject string, wid string, stream string, gen long, batch string, t long, v double")
    events = spark.createDataFrame([(*key, 900_000, 1), (*key, 960_000, 2)], "subject string, wid string, t long, type int")
    x = workouts.hr_zones(w, streams, events, bounds=[120, 145, 160, 180])
    assert windows_on_unions(x) == 0
    runs = [sorted(map(tuple, workouts.hr_zones(w, streams, events, bounds=[120, 145, 160, 180]).collect())) for _ in range(6)]
    assert all(r == runs[0] for r in runs) and len(runs[0]) == 2
