"""The log of a store: one entry a number, publications of two writers, compaction while others read and write, and failures at each step."""

import threading
import uuid

import pytest
from pyspark.sql import functions as F

from paceline.sources import batches, log, tables
from paceline.streaming import ingest
from tests.test_sources import T0, workout, write

MONTH = "2024-01"
COLUMNS = ", ".join(batches.ROW_SCHEMA.split(", "))


def rows(spark, values, month=MONTH):
    """Events with id, value and seq."""
    made = [{c: None for c in batches.ROW} | {"subject": "u", "type": "_events", "k": "ev", "id": i, "s": T0, "e": T0, "v": float(v), "seq": seq, "batch": f"b{seq}", "month": month} for i, v, seq in values]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in made], COLUMNS)


def add(spark, store, values, month=MONTH, publication=None):
    """A publication of rows, as ingest makes it."""
    publication = publication or str(uuid.uuid4())
    named = lambda df: df.withColumn("publication", F.lit(publication))
    tables.append(named(rows(spark, values, month)).coalesce(1), f"{store}/rows", ["type", "month"], ["s"])
    tables.append(named(spark.createDataFrame([], "subject string, type string, id string")), f"{store}/deleted", [], ["id"])
    log.put(spark, store, log.latest(spark, store) + 1, {"kind": "publish", "publication": publication})


def answer(spark, store):
    found = tables.current_rows(tables.read_rows(spark, store, "_events"), tables.published(spark, store, "deleted", "subject string, type string, id string"))
    return sorted((r.id, r.v, r.seq) for r in found.collect())


def stored(spark, store):
    return tables.published(spark, store, "rows", batches.ROW_SCHEMA).count()


def test_an_entry_is_put_once(spark, tmp_path):
    store = str(tmp_path)
    assert log.latest(spark, store) == 0 and log.entries(spark, store).collect() == []
    won, lost = [], []

    def race(k):
        try:
            log.put(spark, store, 1, {"kind": "publish", "publication": f"p{k}"})
            won.append(k)
        except log.Taken:
            lost.append(k)

    threads = [threading.Thread(target=race, args=(k,)) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 11 and [r.publication for r in log.entries(spark, store).collect()] == [f"p{won[0]}"]
    assert [x for x in (tmp_path / "log" / "entries").iterdir() if "json" not in x.name] == []


def test_old_entries_are_read_from_one_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log, "CHECKPOINT_EVERY", 3)
    store = str(tmp_path)
    for n in range(1, 9):
        log.put(spark, store, n, {"kind": "publish", "publication": f"p{n}"})
    assert sorted(x.name for x in (tmp_path / "log" / "checkpoints").iterdir() if x.is_dir()) == ["3", "6"]
    assert sorted((r.number, r.publication) for r in log.entries(spark, store).collect()) == [(n, f"p{n}") for n in range(1, 9)]
    assert sorted(r.number for r in log.entries(spark, store, 4).collect()) == [5, 6, 7, 8] and sorted(r.number for r in log.entries(spark, store, 7).collect()) == [8]
    # a table that was not completed is left aside
    (tmp_path / "log" / "checkpoints" / "6" / "_SUCCESS").unlink()
    assert log.entries(spark, store).count() == 8


def test_compaction_while_others_read_and_write(spark, tmp_path):
    store = str(tmp_path / "store")
    for n in range(1, 11):
        add(spark, store, [("a", n, n), (f"x{n}", n, n)])
    add(spark, store, [("other", 1, 1)], "2024-02")
    before = answer(spark, store)
    assert [(r.type, r.month, r.files) for r in tables.fragmented(spark, store).collect()] == [("_events", MONTH, 10)]
    began = tables.current_rows(tables.read_rows(spark, store, "_events"), tables.published(spark, store, "deleted", "subject string, type string, id string"))
    assert tables.compact(spark, store) == 1
    assert answer(spark, store) == before == sorted((r.id, r.v, r.seq) for r in began.collect())
    assert stored(spark, store) == 12 and tables.fragmented(spark, store).isEmpty() and tables.compact(spark, store) == 0
    # what comes later counts beside the new form, and a second compaction takes both
    for n in range(11, 20):
        add(spark, store, [("a", n, n)])
    assert ("a", 19.0, 19) in answer(spark, store) and stored(spark, store) == 21
    assert tables.compact(spark, store) == 1 and stored(spark, store) == 12
    after = answer(spark, store)
    # files that no longer count go when they are old enough, others stay
    assert tables.swept(spark, store, 0) == []
    gone = tables.swept(spark, store, 4_000_000_000_000)
    assert len(gone) == 20 and answer(spark, store) == after
    assert tables.swept(spark, store, 4_000_000_000_000) == []


def test_what_is_published_during_a_compaction_stays(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    for n in range(1, 11):
        add(spark, store, [("a", n, n), (f"x{n}", n, n)])
    put, between = log.put, []

    def meanwhile(spark_, store_, number, entry):
        if entry["kind"] == "compact" and not between:
            between.append(number)
            monkeypatch.setattr(log, "put", put)
            add(spark, store, [("a", 99, 99), ("late", 1, 1)])  # takes the number
        put(spark_, store_, number, entry)

    monkeypatch.setattr(log, "put", meanwhile)
    assert tables.compact(spark, store) == 1
    assert answer(spark, store) == sorted([("a", 99.0, 99), ("late", 1.0, 1), *((f"x{n}", float(n), n) for n in range(1, 11))])
    assert stored(spark, store) == 13


def test_of_two_compactions_one_counts(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    for n in range(1, 11):
        add(spark, store, [("a", n, n), (f"x{n}", n, n)])
    before, put = answer(spark, store), log.put

    def meanwhile(*args):
        monkeypatch.setattr(log, "put", put)
        assert tables.compact(spark, store) == 1
        put(*args)

    monkeypatch.setattr(log, "put", meanwhile)
    with pytest.raises(log.Taken):
        tables.compact(spark, store)
    assert answer(spark, store) == before and stored(spark, store) == 11


def test_a_compaction_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    for n in range(1, 11):
        add(spark, store, [("a", n, n)])
    before, append, put = answer(spark, store), tables.append, log.put

    def lost(*_):
        raise OSError("lost")

    def half(df, path, *more):
        append(df, path, *more)
        raise OSError("lost")

    for module, name, broken in ((tables, "append", lost), (tables, "append", half), (log, "put", lost)):
        monkeypatch.setattr(module, name, broken)
        with pytest.raises(OSError, match="lost"):
            tables.compact(spark, store)
        monkeypatch.setattr(tables, "append", append)
        monkeypatch.setattr(log, "put", put)
        assert answer(spark, store) == before and stored(spark, store) == 10
    assert tables.compact(spark, store) == 1 and answer(spark, store) == before and stored(spark, store) == 1


def test_two_writers_publish_one_batch_once(spark, tmp_path, monkeypatch):
    landing, store = tmp_path / "in", str(tmp_path / "store")
    one, two = landing / "1", landing / "2"
    batch = write(one, "u1", batches.WORKOUT, [workout("a")])
    write(one, "u1", batches.WORKOUT, [workout("b")])
    write(two, "u1", batches.WORKOUT, [workout("a")], batch=batch)
    write(two, "u1", batches.WORKOUT, [workout("c")])
    put, other = log.put, []

    def meanwhile(*args):
        monkeypatch.setattr(log, "put", put)
        other.append(ingest.publish(batches.read_lines(spark, str(two)), store))  # another writer ends first
        put(*args)

    monkeypatch.setattr(log, "put", meanwhile)
    assert ingest.publish(batches.read_lines(spark, str(one)), store) == {"published": 1, "published before": 1}
    assert other == [{"published": 2}]
    assert sorted(r.id for r in tables.published(spark, store, "rows", batches.ROW_SCHEMA).collect()) == ["a", "b", "c"]
    assert tables.published(spark, store, "commits").count() == 3
