"""Batches from files to rows: replays, bad records, deletions, late versions, generations, and the live path."""

import gzip
import hashlib
import json
import uuid

from pyspark.sql import functions as F

from paceline.operators import dedup
from paceline.plans import health
from paceline.sources import batches, log, tables
from paceline.streaming import ingest


def write(folder, subject, kind, records, seq=1, mode="anchored", batch=None, **more):
    batch = batch or str(uuid.uuid4())
    head = {"kind": "header", "schema": 2, "batchId": batch, "type": kind, "seq": seq, "createdAt": 1_700_000_000_000, "mode": mode} | more
    path = folder / subject
    path.mkdir(parents=True, exist_ok=True)
    with gzip.open(path / f"{uuid.uuid4().hex}.ndjson.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) if not isinstance(x, str) else x for x in [head, *records]))
    return batch


T0 = 1_704_067_200_000  # 2024-01-01


def workout(i, s=T0):
    return {"k": "w", "id": i, "s": s, "e": s + 1000, "act": 37, "dist": 5.0}


def test_ingest_is_idempotent_and_keeps_the_good(spark, tmp_path):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    b = write(landing, "u1", batches.WORKOUT, [workout("a"), workout("b", T0 + 40 * 86_400_000), {"k": "w", "id": "x/y", "s": 1, "e": 0, "act": 1}, "not json", {"k": "day", "day": "2024-01-01", "m": {}}])
    write(landing, "u1", "_nothing", [workout("c")])
    q = ingest.start(spark, str(landing), store, str(tmp_path / "cp"))
    q.awaitTermination()
    assert q.exception() is None
    assert tables.published(spark, store, "rows").count() == 2
    assert tables.published(spark, store, "aside").count() == 3
    # the same batch again, and a newer version with a deletion
    write(landing, "u1", batches.WORKOUT, [workout("a"), workout("b")], batch=b)
    write(landing, "u1", batches.WORKOUT, [workout("a") | {"dist": 9.0}, {"k": "d", "id": "b"}], seq=2)
    ingest.start(spark, str(landing), store, str(tmp_path / "cp")).awaitTermination()
    rows = tables.current_rows(tables.read_rows(spark, store, batches.WORKOUT), tables.published(spark, store, "deleted"))
    assert [(r.id, r.seq) for r in rows.collect()] == [("a", 2)]
    assert tables.read_rows(spark, store, batches.WORKOUT, T0 + 86_400_000, T0 + 60 * 86_400_000).count() == 1
    assert tables.published(spark, store, "commits").count() == 2


def test_a_failed_publication_leaves_nothing_double(spark, tmp_path, monkeypatch):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    write(landing, "u1", batches.WORKOUT, [workout("a"), "not json"])
    lines = batches.read_lines(spark, str(landing))
    append = tables.append
    put = log.put
    for broken in ("deleted", "commits", "log"):
        def failing(df, path, *more, broken=broken):
            if path.endswith(f"/{broken}"):
                raise OSError("lost")
            append(df, path, *more)

        def lost(*_):
            raise OSError("lost")

        monkeypatch.setattr(tables, "append", failing)
        monkeypatch.setattr(log, "put", lost if broken == "log" else put)
        try:
            ingest.publish(lines, store)
            raise AssertionError
        except OSError:
            pass
    monkeypatch.setattr(tables, "append", append)
    monkeypatch.setattr(log, "put", put)
    assert ingest.publish(lines, store) == {"published": 1}
    assert ingest.publish(lines, store) == {"published before": 1}
    assert [tables.published(spark, store, t).count() for t in ("rows", "aside", "commits")] == [1, 1, 1]
    assert spark.read.parquet(f"{store}/rows").count() > 1


def test_nested_keys_of_events_stay(spark, tmp_path):
    write(tmp_path, "u", "_events", [{"k": "ev", "ty": "Note", "src": 'a "s": b', "s": [T0], "v": [1.0], "md": [{"s": 5}]}])
    write(tmp_path, "u", "_events", [{"k": "ev", "ty": "Packed", "enc": 1, "n": 2, "s": {"m": 1, "o": 1, "d": [T0, 5]}, "v": {"m": 10, "o": 1, "d": [15, 5]}, "ids": ["p1", "p2"]}])
    write(tmp_path, "u", batches.PROFILE, [{"k": "ev", "ty": "Profile", "s": [T0], "meta": [{"dob": "1984-03-01", "sex": "female"}]}])
    write(tmp_path, "u", "_daily_cycle", [{"k": "day", "day": "2024-01-01", "m": {"cycleFlow": 1}}])
    heads, good, aside = good_of(spark, tmp_path)
    assert heads.filter("problem is not null").count() == aside.count() == 0
    rows = {(r.agg, r.s - T0): r for r in batches.rows(good).filter("k = 'ev'").collect()}
    assert rows["Note", 0].src == 'a "s": b' and (rows["Packed", 0].v, rows["Packed", 5].v) == (1.5, 2.0)
    assert rows["Packed", 5].id == "p2" and rows["Note", 0].extra is None
    p = health.profile(batches.rows(good), "2024-02-29").first()
    assert (p.subject, p.age, p.sex, p.expected_max_hr) == ("u", 39, "female", 181)


def good_of(spark, landing):
    lines = batches.read_lines(spark, str(landing))
    heads = batches.headers(lines)
    return heads, *batches.records(lines, heads)


def test_days_hours_events_and_streams(spark, tmp_path):
    write(tmp_path, "u", batches.DAILY, [{"k": "day", "day": "2024-02-29", "m": {"steps": 5, "values": [1, 2]}}, {"k": "day", "day": "2024-02-30", "m": {}}])
    write(tmp_path, "u", "_hourly", [{"k": "hs", "st": "HeartRate", "t": [T0, T0 + 3_600_000], "v": [60.0, 61.5], "lo": [50.0, None]}, {"k": "hs", "st": "Steps", "t": [T0], "v": [1.0, 2.0]}])
    packed = {"k": "hs", "st": "Hrv", "enc": 1, "n": 3, "t": {"m": 1, "o": 2, "d": [T0, 3_600_000, 0]}, "v": {"m": 10, "o": 1, "d": [405, 0, 5], "x": [1]}}
    write(tmp_path, "u", "_hourly", [packed])
    write(tmp_path, "u", "_events", [{"k": "ev", "ty": "Glucose", "s": [T0, T0 + 5], "v": [5.5, 6.0], "ids": ["g1", "g2"]}])
    write(tmp_path, "u", batches.STREAM, [{"k": "ws", "wid": "w", "st": "HeartRate", "gen": 5, "t": [T0, T0 + 1], "v": [100.0, 101.0]}, {"k": "wd", "wid": "w", "gen": 5, "expected": {"HeartRate": 2}}, {"k": "ws", "wid": "w", "st": "HeartRate", "gen": 4, "t": [T0], "v": [1.0]}], mode="workoutdata")
    heads, good, aside = good_of(spark, tmp_path)
    assert heads.filter("problem is not null").count() == 0 and aside.count() == 2  # a day that is none, and columns of unequal lengths
    rows = batches.rows(good).collect()
    by = {}
    for r in rows:
        by.setdefault(r.agg or r.k, []).append(r)
    assert by["day"][0].month == "2024-02" and json.loads(by["day"][0].extra)["m"]["values"] == [1, 2]
    assert sorted((r.v, r.v2) for r in by["HeartRate"]) == [(60.0, 50.0), (61.5, None)]
    assert "Steps" not in by  # unequal lengths
    assert [(r.s, r.v) for r in sorted(by["Hrv"], key=lambda r: r.s)] == [(T0, 40.5), (T0 + 3_600_000, None), (T0 + 7_200_000, 41.0)]
    assert {r.id for r in by["Glucose"]} == {"g1", "g2"}
    points = batches.stream_points(good)
    assert [r.v for r in dedup.latest_generation(points, ["subject", "wid", "stream"]).orderBy("t").collect()] == [100.0, 101.0]
    assert batches.raw_complete(points, batches.marks(good)).first().complete is True


def test_checksums_are_of_the_files_as_they_are(spark, tmp_path):
    write(tmp_path, "u", batches.WORKOUT, [workout("a")])
    write(tmp_path, "v", batches.WORKOUT, [])
    want = {(p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.rglob("*.gz")}
    assert {(r.size, r.sha256) for r in batches.checksums(spark, str(tmp_path)).collect()} == want


def test_refused_headers(spark, tmp_path):
    write(tmp_path, "u", batches.DAILY, [], mode="status")
    write(tmp_path, "u", "_unknown", [])
    write(tmp_path, "u", batches.DAILY, [], schema=1)
    write(tmp_path, "u", batches.DAILY, [], schema=7)
    heads, good, _ = good_of(spark, tmp_path)
    assert sorted(r.problem for r in heads.collect()) == ["bad header", "mode and type disagree", "needs schema 2", "unknown type"]
    assert good.count() == 0


def test_coverage_and_completeness(spark, tmp_path):
    now = T0 + 10 * 86_400_000
    write(tmp_path, "u", batches.WORKOUT, [workout("a")], window={"start": T0, "end": T0 + 100}, checkedAt=now)
    write(tmp_path, "u", batches.WORKOUT, [], seq=2, window={"start": T0 + 50, "end": T0 + 500})
    write(tmp_path, "u", batches.STATUS, [{"k": "c", "t": batches.DAILY, "at": now, "cu": True}], mode="status")
    heads, good, _ = good_of(spark, tmp_path)
    cover = batches.coverage(heads, batches.statuses(good), batches.rows(good))
    got = {r.type: r for r in batches.complete(cover, T0 + 10, T0 + 400, now).collect()}
    assert [tuple(i) for i in got[batches.WORKOUT].intervals] == [(T0, T0 + 500)] and got[batches.WORKOUT].complete
    assert got[batches.DAILY].caught_up and got[batches.DAILY].complete
    assert got[batches.WORKOUT].earliest == T0


def test_compaction_changes_no_answer(spark):
    cols = "subject string, type string, k string, id string, s long, e long, v double, v2 double, v3 double, c int, u string, agg string, src string, bid string, dev string, tz string, extra string, seq long, batch string, rid string"
    day = lambda m, seq: ("u", "_daily", "day", "2024-01-01", T0, T0 + 1, *[None] * 10, json.dumps({"m": m}), seq, "b", None)
    ev = lambda i, v, seq: ("u", "_events", "ev", i, T0, T0, v, *[None] * 10, seq, "b", None)
    rows = spark.createDataFrame([day({"a": 1, "b": 2}, 1), day({"a": 3}, 2), ev("x", 1.0, 1), ev("x", 2.0, 2), ev("y", 5.0, 1)], cols)
    gone = spark.createDataFrame([("u", "_events", "y")], "subject string, type string, id string")
    after = tables.compacted(rows, gone)
    assert after.count() == 2
    metrics = lambda df: {(r.metric, str(r.value)) for r in dedup.latest_metrics(df.filter("k = 'day'").withColumn("m", F.from_json(F.get_json_object("extra", "$.m"), "map<string,string>")), ["subject", "id"], ["seq"]).collect()}
    assert metrics(rows) == metrics(after) == {("a", "3"), ("b", "2")}


def test_json_results_have_a_limit(spark):
    assert json.loads(tables.bounded_json(spark.range(3))) == [{"id": 0}, {"id": 1}, {"id": 2}]
    try:
        tables.bounded_json(spark.range(10_000), 500)
        raise AssertionError
    except ValueError:
        pass
