"""State of streams: after any order of files and any cut into micro-batches it is what the batch fold gives."""

import random

import pytest
from pyspark.sql import functions as F

from paceline.operators import product
from paceline.sources import batches
from paceline.streaming import state

HEADS = "path string, subject string, type string, mode string, window struct<start:long,end:long>, caughtUp boolean, checkedAt long, createdAt long, problem string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, state.PROVIDER)
    yield
    spark.conf.set(key, old)


def run(spark, tmp_path, rows, schema, make, parts, name):
    """The rows of make(stream) over rows, read in parts files, one a micro-batch."""
    folder, n = tmp_path / name, -(-len(rows) // parts)
    for k in range(0, len(rows), n):
        spark.createDataFrame(rows[k : k + n], schema).coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    return spark.table(name)


def test_first_times(spark, tmp_path, rocks):
    rng = random.Random(1)
    rows = [(f"u{rng.randrange(4)}", rng.choice("abc"), rng.randrange(1000)) for _ in range(60)] + [("u0", None, 1), ("u1", "a", None)]
    schema = "uid string, name string, at long"
    want = {(r.uid, r.name): r.at for r in product.first_times(spark.createDataFrame(rows, schema).dropna()).collect()}
    for k in range(2):
        rng.shuffle(rows)
        got = run(spark, tmp_path, rows, schema, state.first_times, 4, f"first{k}")
        last = {}
        for r in got.collect():
            last[r.uid, r.name] = min(r.at, last.get((r.uid, r.name), r.at))
        assert last == want


def test_raw_complete(spark, tmp_path, rocks):
    rng = random.Random(2)
    schema = "subject string, wid string, stream string, gen long, n long, expected map<string,long>"
    rows = []
    for w in range(6):
        for gen in (1, 2):
            rows.append(("u", f"w{w}", None, gen, None, {"hr": 6, "gps": 4} if w else {}))
            rows += [("u", f"w{w}", s, gen, 2, None) for s in ("hr", "gps") for _ in range(rng.choice([1, 2, 3]))]
    df = spark.createDataFrame(rows, schema)
    points = df.filter("expected is null").withColumn("t", F.explode(F.sequence(F.lit(1), F.col("n")))).select("subject", "wid", "stream", "gen", "t")
    want = {r.wid: r.complete for r in batches.raw_complete(points, df.filter("expected is not null")).collect()}
    assert set(want.values()) == {True, False}
    for k in range(2):
        rng.shuffle(rows)
        got = run(spark, tmp_path, rows, schema, state.raw_complete, 5, f"raw{k}")
        # a key's last row is its state; rows of one key come in the order of micro-batches
        last = {r.wid: r.complete for r in got.collect()}
        assert last == want


def test_coverage(spark, tmp_path, rocks):
    rng = random.Random(3)
    day = 86_400_000
    heads = []
    for k in range(40):
        a = rng.randrange(0, 50) * day
        heads.append((f"p{k}", f"u{k % 3}", rng.choice(["x", "y"]), rng.choice(["anchored", "recent", "reconcile", "stats"]), (a, a + rng.randrange(0, 4) * day) if rng.random() < 0.8 else None, rng.random() < 0.2, rng.randrange(0, 60) * day, 5 * day, rng.choice([None, None, "bad header"])))
    spans = spark.createDataFrame([], "subject string, type string, s long, e long")
    checked = spark.createDataFrame([], "subject string, type string, at long, caught_up boolean")
    df = spark.createDataFrame(heads, HEADS)
    want = {(r.subject, r.type): ([tuple(i) for i in r.intervals or []], r.caught_up, r.checked_at) for r in batches.coverage(df, checked, spans).collect()}
    for k in range(2):
        rng.shuffle(heads)
        got = run(spark, tmp_path, heads, HEADS, lambda s: state.coverage(state.coverage_facts(s)), 4, f"cover{k}").collect()
        last = {}
        for r in got:
            key = r.subject, r.type
            size = sum(i.e - i.s for i in r.intervals), r.checked_at or 0
            if key not in last or size >= last[key][0]:
                last[key] = size, ([tuple(i) for i in r.intervals], r.caught_up, r.checked_at)
        assert {key: v for key, (_, v) in last.items()} == want


def test_merged():
    assert state.merged([(5, 7), (1, 2), (2, 3), (6, 9), (4, 4)]) == [(1, 3), (5, 9)]
