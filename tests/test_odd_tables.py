"""Queries against their SQL on small tables that hold what the driver's small ones don't."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pytest

from paceline.operators import device
from paceline.plans import readiness, registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL, sorted."""
    c = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df, sql = registry.QUERIES[name](spark, str(folder)), c.sql(registry.ORACLES[name])
    shown = lambda v: repr(round(v, 9) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v)
    got, want = ([dict(zip(names, row, strict=True)) for row in rows] for names, rows in ((df.columns, df.collect()), (sql.columns, sql.fetchall())))
    return (sorted(str(sorted((k, shown(v)) for k, v in r.items())) for r in rows) for rows in (got, want))


def test_days_without_a_value_differ_infinitely(spark, tmp_path):
    pairs = {1: [(0, 5), (2, 3), (4, 9)], 2: [(0, 5), (0, 7)], 3: [(0, 0), (2, 3), (8, 2)], 4: [(0, 0), (0, 6), (3, 3)], 5: [(0, 0)], 6: [(2, 5), (-4, 4), (3, 1)], 7: [(1, 2), (0, 0)], 8: [(1, 4), (0, 2)]}
    rows = [(user * 100 + 10 * d + k, datetime(2024, 1, 1) + timedelta(days=d, hours=k), user, kind, float(v[k]), "{}") for user, days in pairs.items() for d, v in enumerate(days) for k, kind in enumerate(("view", "click"))]
    got, want = both(spark, tmp_path, "shared_day_difference", events=spark.createDataFrame(rows, EVENTS))
    assert got == want
    assert len(got) == len(pairs) and "inf" in str(got) and "nan" in str(got)


def test_device_leaves_out_days_of_nothing(spark):
    a, b = (spark.createDataFrame([("u", d, v) for d, v in enumerate(values)], "subject string, day int, value double") for values in ([100.0, 0.0, -50.0, 0.0], [101.0, 7.0, -55.0, 0.0]))
    [r] = device.shared_day_difference(a, b).collect()
    assert (r.days, r.median, r.greatest) == (2, pytest.approx(0.055), pytest.approx(0.1))


def test_backtest_of_runners_with_many_runs_a_day(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    rows = [(k, k % 2 * 50 + 100 * rng.randrange(9) + k % 3 // 2, "O", rng.randrange(1_000_000) / 100, datetime(2020, 1, 1) + timedelta(days=rng.choice([rng.randrange(500), 7 * rng.randrange(70)])), "p") for k in range(6000)]
    tables = []
    monkeypatch.setattr(readiness, "written", lambda df, name, keep=readiness.written: tables.append((name, x := keep(df, name))) or x)
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string")
    got, want = both(spark, tmp_path, "marathon_backtest", orders=orders)
    assert got == want
    assert len(got) > 200 and "'ok'" in str(got) and "insufficient" in str(got)
    # no intermediate table grows with the product of a runner's marathons and runs, of which 365,272 pairs were written here
    sizes = {name: x.count() for name, x in tables}
    assert max(sizes.values()) <= 2 * len(rows), sizes
