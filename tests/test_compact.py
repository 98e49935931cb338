"""Compact columns: vectors of each plan, the bound of errors, chunks of streams, and columns that are no good."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from paceline.operators import codec, compact
from paceline.sources import shared, tables

KIND = pa.struct([("m", pa.int64()), ("o", pa.int32()), ("d", pa.list_(pa.int64())), ("x", pa.list_(pa.int32())), ("r", pa.list_(pa.float64()))])
NAN = math.nan
#: Plan, values, the column.
VECTORS = [
    (compact.exact(), [7.0, 8.0, 6.0, 6.0], {"m": 1, "o": 1, "d": [7, 1, -2, 0]}),
    (compact.exact(), [-0.5, NAN, NAN, 1.25], {"m": 100, "o": 1, "d": [-50, 0, 0, 175], "x": [1, 2]}),
    (compact.exact(), [NAN, NAN], {"m": 1, "o": 1, "d": [0, 0], "x": [0, 1]}),
    (compact.exact(), [1 / 7, NAN, 2.0], {"r": [1 / 7, None, 2.0]}),
    (compact.exact(), [1e18, 1.0], {"r": [1e18, 1.0]}),
    (compact.step(4), [0.3, 0.6, 0.9, 1.1], {"m": 4, "o": 1, "d": [1, 1, 2, 0]}),
    (compact.step(1000), [0.0, 1.5, 3.0, 4.5, 6.0], {"m": 1000, "o": 2, "d": [0, 1500, 0, 0, 0]}),
    (compact.step(10), [math.inf, 2.26], {"m": 10, "o": 1, "d": [0, 23], "x": [0]}),
    (compact.rounded(2), [80.00000000000001, 79.9999999, 80.1234], {"m": 100, "o": 1, "d": [8000, 0, 12]}),
    (compact.rounded(0), [9.4, 9.6], {"m": 1, "o": 1, "d": [9, 1]}),
]


def back(column, n):
    out, bad = compact.decoded(pa.array([column], KIND), np.array([n]))
    return None if bad[0] else out.to_pylist()[0]


@pytest.mark.parametrize(("plan", "values", "column"), VECTORS)
def test_vectors_of_each_plan(plan, values, column):
    got = compact.encoded(np.array(values), plan)
    assert got == column
    read = back(got, len(values))
    off = 0 if plan.kind == "exact" else 0.5 / plan.value if plan.kind == "step" else 0.5 / 10**plan.value
    for v, r in zip(values, read, strict=True):
        assert r is None if not math.isfinite(v) else abs(v - r) <= off + 1e-12


def test_within_takes_the_least_that_is_near_enough():
    rng = random.Random(3)
    for error in (0, 0.001, 0.03, 0.2, 0.5, 3):
        for _ in range(30):
            values = np.cumsum([round(rng.uniform(-3, 3), rng.randrange(4)) for _ in range(40)]).round(3) + 0.0
            values[rng.randrange(40)] = NAN
            got = compact.encoded(values, compact.within(error))
            read = back(got, 40)
            assert all((r is None) == math.isnan(v) and (r is None or abs(r - v) <= error) for v, r in zip(values.tolist(), read, strict=True))
            others = [compact.encoded(values, compact.exact()), *(compact.encoded(values, compact.rounded(k)) for k in range(7)), compact.encoded(values, compact.step(math.ceil(0.5 / error) if error else 1))]
            good = [c for c in others if all(r is None or abs(r - v) <= error for v, r in zip(values.tolist(), back(c, 40), strict=True))]
            assert compact.characters(got) == min(map(compact.characters, good))


BAD = [
    {"m": 0, "o": 1, "d": [1, 2]}, {"m": 1, "o": 3, "d": [1, 2]}, {"m": 1, "o": 1, "d": [1]}, {"m": 1, "o": 1, "d": [1, None]}, {"m": 1, "o": 1, "d": [1, 2], "x": [1, 0]}, {"m": 1, "o": 1, "d": [1, 2], "x": [2]},
    {"m": 1, "o": 1, "d": [1, 2], "x": [0, 0]}, {"m": 1, "o": 1, "d": [2**53, 1]}, {"m": 1, "o": 1, "d": [2**62, 2**62]}, {"m": 1, "o": 2, "d": [0, 2**53]}, {"r": [1.0]}, {"m": 1, "o": 1, "d": [1, 2], "r": [1.0, 2.0]}, {"m": 10**16, "o": 1, "d": [1, 2]}, {"m": 1, "o": 1, "d": [1, 2], "x": [-1]}, {},
]


def test_bad_columns_do_not_touch_their_neighbours(spark):
    good = {"m": 10, "o": 2, "d": [5, 5], "x": [1]}
    columns = [c for b in BAD for c in (good, b)] + [good, None]
    out, bad = compact.decoded(pa.array(columns, KIND), np.full(len(columns), 2))
    assert out.to_pylist() == [[0.5, None] if c is good else None for c in columns]
    assert bad.tolist() == [c is not None and c is not good for c in columns]
    rows = [(k, 2, tuple(c.get(f) for f in "modxr") if c else None) for k, c in enumerate(columns)]
    df = spark.createDataFrame(rows, f"k int, n long, c {compact.COLUMN}")
    sound = {r.k: r.ok for r in df.select("k", compact.sound(F.col("c"), F.col("n")).alias("ok")).collect()}
    assert [sound[k] for k in range(len(columns))] == [c is good for c in columns]


def test_times(spark):
    whole = {"m": 1, "o": 2, "d": [10, 5, -1]}
    bad = [{"m": 10, "o": 1, "d": [1, 1, 1]}, {"m": 1, "o": 1, "d": [1, 1, 1], "x": [1]}, {"m": 1, "o": 1, "d": [1, -2, 1]}, {"m": 1, "o": 1, "d": [1, 1, 99]}, {"r": [1.0, 2.0, 3.0]}, None]
    rows = [(k, 3, tuple(c.get(f) for f in "modxr") if c else None) for k, c in enumerate([*bad, whole])]
    df = spark.createDataFrame(rows, f"k int, n long, t {compact.COLUMN}").withColumn("v", F.lit(None).cast(compact.COLUMN))
    assert [tuple(r) for r in compact.unpacked(df, ["k"], ["t"], ["v"], 100).collect()] == [(len(bad), [10, 15, 19], None)]
    assert [r.k for r in df.filter(compact.sound(F.col("t"), F.col("n"), True, 100)).collect()] == [len(bad)]


def test_chunks_of_streams(spark):
    """Chunks of 7 of unsorted points: in order, with ties, nulls, a key with one point, and columns that a chunk lacks."""
    rng = random.Random(4)
    rows = [(k, None if k == 2 else "s", rng.randrange(60), None if rng.random() < 0.2 else round(rng.uniform(-9, 9), 2), 5.0 if t < 3 else None) for k in range(6) for t in range(1 if k == 4 else 40)]
    points = spark.createDataFrame([*rows, (9, "s", None, 1.0, 1.0)], "k int, name string, t long, v double, w double").repartition(7)
    x = compact.encode(points, ["k", "name"], "t", {"v": compact.exact(), "w": compact.step(1)}, 7)
    assert x.columns == ["k", "name", "chunk", "n", "t", "v", "w"]
    chunks = x.collect()
    assert all(c.n == 7 or c.n == 40 % 7 or c.k == 4 for c in chunks) and any(c.w is None for c in chunks)
    assert sorted({(c.k, c.chunk) for c in chunks}) == [(k, c) for k in range(6) for c in range(1 if k == 4 else 6)]
    # whatever the batches are
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, x.collect())) == sorted(map(str, chunks))
        read = codec.rows_of_chunks(compact.unpacked(x, ["k", "name", "chunk"], ["t"], ["v", "w"], compact.SAFE), ["k", "name"], "t", ["v", "w"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(str, map(tuple, read))) == sorted(map(str, rows))
    assert compact.encode(points.limit(0), ["k"], "t", {"v": compact.exact()}).collect() == []


def test_stored_points_are_integers_where_these_suffice(spark, tmp_path):
    rows = [("u", "HeartRate", t, 60 + t % 7 / 10, None if t % 3 else 1 / 3) for t in range(500)] + [("u", "Power", t, t / 7, None) for t in range(50)]
    points = spark.createDataFrame(rows, "subject string, stream string, t long, v double, alt double")
    path = str(tmp_path / "points")
    tables.append(codec.stored(points, ["subject", "stream"], ["v", "alt"]).coalesce(1), path, ["stream"], ["t"])
    stored = spark.read.parquet(path)
    kinds = {r.stream: (r.m, r.plain, r.whole, r.am) for r in stored.groupBy("stream").agg(F.max("v_m").alias("m"), F.count("v").alias("plain"), F.count("v_i").alias("whole"), F.max("alt_m").alias("am")).collect()}
    assert kinds == {"HeartRate": (10, 0, 500, None), "Power": (None, 50, 0, 1)}
    back = codec.restored(stored, ["v", "alt"])
    assert set(back.columns) == {"subject", "stream", "t", "v", "alt"} and codec.restored(stored, ["v"]).columns.count("alt") <= 1
    assert sorted(map(str, (tuple(r) for r in back.select("subject", "stream", "t", "v", "alt").collect()))) == sorted(map(str, rows))
    [file] = (tmp_path / "points" / "stream=HeartRate").glob("*.parquet")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["t"].encodings and columns["v_i"].compression == "ZSTD"


def test_written_tables_are_read_back(spark):
    df = spark.range(5).withColumn("x", F.rand())
    once = shared.written(df, "rows")
    assert sorted(r.x for r in once.collect()) == sorted(r.x for r in once.collect()) and once.dtypes == df.dtypes
    assert shared.new_folder(spark, "a") != shared.new_folder(spark, "a")
