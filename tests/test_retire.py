"""Removal of retired layouts: every object copied and verified before anything goes, and nothing goes if a copy is corrupt."""

import hashlib
import os

import pytest

from paceline.sources import retire


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(root) for f in files}


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "a store"
    for name, data in {"rows/type=x/p.parquet": b"keep", "old/a.bin": b"a" * 9_000_000, "old/deep/er/b.bin": b"", "older/c d.bin": b"c", "rowsmore/e": b"e", "rowsmore/_SUCCESS": b"", "rowsmore/100% é#?.bin": b"ee", "top": b"t"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_plan_back_up_and_remove(spark, store, tmp_path):
    before = tree(store)
    assert {tuple(r) for r in retire.plan(spark, str(store), ["rows"]).collect()} == {("old", 2, 9_000_000), ("older", 1, 1), ("rowsmore", 3, 3)}
    manifest = retire.back_up(spark, str(store), ["rows"], str(tmp_path / "backup"))
    rows = spark.read.parquet(manifest).collect()
    gone = {k: v for k, v in before.items() if k.split("/")[0] in ("old", "older", "rowsmore")}
    assert sorted(r.sha256 for r in rows) == sorted(hashlib.sha256(v).hexdigest() for v in gone.values())
    assert tree(store) == before
    done = {tuple(r) for r in retire.remove(spark, str(store), ["rows"], manifest).collect()}
    assert done == {("old", 2, 9_000_000), ("older", 1, 1), ("rowsmore", 3, 3)}
    assert tree(store) == {k: v for k, v in before.items() if k not in gone}
    folder = manifest.removeprefix("file:").removesuffix("/manifest")
    assert tree(f"{folder}/data") == gone
    assert retire.plan(spark, str(store), ["rows"]).isEmpty()
    assert retire.remove(spark, str(store), ["rows"], manifest).count() == 3  # again: what is gone stays gone


@pytest.mark.parametrize("harm", ["corrupt", "shorter", "missing"])
def test_a_bad_copy_stops_the_removal(spark, store, tmp_path, harm):
    before = tree(store)
    manifest = retire.back_up(spark, str(store), ["rows"], str(tmp_path / "backup"))
    copy = manifest.removeprefix("file:").removesuffix("/manifest") + "/data/old/a.bin"
    if harm == "missing":
        os.remove(copy)
    else:
        data = open(copy, "rb").read()
        open(copy, "wb").write(data[:-1] + (b"b" if harm == "corrupt" else b""))
    with pytest.raises(retire.NotRemoved, match="nothing was removed"):
        retire.remove(spark, str(store), ["rows"], manifest)
    assert tree(store) == before


@pytest.mark.parametrize("change", ["new", "changed"])
def test_what_came_after_the_copy_stops_the_removal(spark, store, tmp_path, change):
    manifest = retire.back_up(spark, str(store), ["rows"], str(tmp_path / "backup"))
    (store / "old" / ("late" if change == "new" else "a.bin")).write_bytes(b"z" * 9_000_000)
    os.utime(store / "old" / ("late" if change == "new" else "a.bin"), (2_000_000_000, 2_000_000_000))
    before = tree(store)
    with pytest.raises(retire.NotRemoved, match="were not copied"):
        retire.remove(spark, str(store), ["rows"], manifest)
    assert tree(store) == before


def test_copies_within_the_store_are_refused(spark, store):
    with pytest.raises(ValueError):
        retire.back_up(spark, str(store), ["rows"], str(store / "old"))
