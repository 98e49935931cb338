"""Steps of plans, listed events and pages of routes."""

import json

import pytest
from pyspark.sql import functions as F

from paceline.plans import pages

STEP = {"purpose": "work", "goal": "distance", "value": 400.0, "target": "pace"}


def test_plan_steps_are_an_ordered_tree(spark):
    rest = {"purpose": "recovery", "goal": "time", "value": 60.0}
    plan = {"kind": "custom", "warmup": {"purpose": "warmup", "goal": "open"}, "blocks": [{"iterations": 6, "steps": [STEP, rest]}, {"iterations": 0, "steps": []}, {"steps": [STEP]}], "cooldown": {"purpose": "cooldown"}}
    rows = [("u", "a", json.dumps(plan)), ("u", "b", json.dumps({"kind": "goal"})), ("u", "c", None), ("u", "d", "no json"), ("u", "e", json.dumps({"kind": "pacer", "cooldown": STEP, "more": 1}))]
    x = pages.plan_steps(spark.createDataFrame(rows, "subject string, wid string, plan string")).orderBy("wid", "node")
    got = [(r.node, r.parent, r.depth, r.purpose, r.repeats) for r in x.filter("wid = 'a'").collect()]
    assert got == [(1, None, 1, "warmup", None), (2, None, 1, "block", 6), (3, 2, 2, "work", None), (4, 2, 2, "recovery", None), (5, None, 1, "block", 1), (6, None, 1, "block", 1), (7, 6, 2, "work", None), (8, None, 1, "cooldown", None)]
    rest_of = x.filter("wid <> 'a'").collect()
    assert [(r.wid, r.kind, r.node, r.goal, r.value, r.target) for r in rest_of] == [("e", "pacer", 1, "distance", 400.0, "pace")]


def test_listed_events(spark):
    w = spark.createDataFrame([("u", k, 1000) for k in "abc"], "subject string, wid string, s long")
    rows = [("u", "a", 1000 + 100 * i, "lap", float(i)) for i in range(5)] + [("u", "a", 1000, "segment", None), ("u", "b", 2000, "segment", 1.0), ("u", "b", 3000, "segment", 1.0), ("u", "a", 1050, None, None)]
    x = pages.listed_events(spark.createDataFrame(rows, "subject string, wid string, t long, type string, dur double"), w, most=3).orderBy("wid", "place")
    got = [tuple(r)[1:] for r in x.collect()]
    assert got == [("a", 1, 0.0, "lap", 0.0, True, 1), ("a", 2, 0.1, None, 0.0, True, 1), ("a", 3, 0.1, "lap", 1.0, True, 1), ("b", None, None, None, None, False, 2)]


def test_each_point_once_over_all_pages(spark):
    n = {"a": 23, "b": 10, "c": 1}
    points = spark.createDataFrame([("u", k, 10 * i, 50.0 + i / 1000, 8.0, None) for k in n for i in range(n[k])] + [("u", "a", 0, 50.0, 8.0, None)], "subject string, wid string, t long, lat double, lon double, alt double")
    shown = pages.shown_points(points, full=True)
    asked, seen, cursors = shown.select("subject", "wid").distinct().withColumn("after", F.lit(None).cast("long")), [], set()
    while True:
        rows = pages.page_after(shown, asked, 10).collect()
        if not rows:
            break
        seen += [(r.wid, r.t) for r in rows]
        more = {(r.subject, r.wid, r.next_after) for r in rows if r.next_after is not None}
        cursors |= {(r.wid, r.after, r.next_after) for r in rows}
        if not more:
            break
        asked = spark.createDataFrame(sorted(more), "subject string, wid string, after long")
    assert sorted(seen) == sorted((k, 10 * i) for k in n for i in range(n[k]))
    assert {(r.wid, r.after, r.next_after) for r in pages.pages(shown, 10).collect()} == cursors
    late = shown.unionByName(spark.createDataFrame([("u", "a", 5, 50.0, 8.0, None, 0.0)], shown.schema))
    after = spark.createDataFrame([("u", "a", 90)], "subject string, wid string, after long")
    assert [r.t for r in pages.page_after(late, after, 10).orderBy("t").collect()] == list(range(100, 200, 10))
    assert pages.shown_points(points).filter("wid = 'a'").agg(F.min("d")).first()[0] >= 300
    for bad in (1, 5001):
        with pytest.raises(ValueError):
            pages.pages(shown, bad)
