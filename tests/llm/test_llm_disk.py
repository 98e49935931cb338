"""What near duplicates leave on disk while they work: shuffle files and rounds."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from paceline.llm import minhash
from paceline.llm.store import CLEANUP, Scratch, materialize


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {x for folder in folders for _, _, names in os.walk(folder) for x in names if x.startswith("shuffle_")}


@pytest.mark.parametrize("kept", ["materialize", "scratch"])
def test_shuffle_files_go_when_the_table_is_written(spark, kept):
    before, was = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")).join(spark.range(7).withColumnRenamed("id", "k"), "k")
    with Scratch(spark) as scratch:
        out = materialize(counts, "counts") if kept == "materialize" else scratch.table(counts, "counts")
        end = time.time() + 20
        while (left := shuffle_files(spark) - before) and time.time() < end:
            time.sleep(0.1)
        assert not left
        assert out.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(CLEANUP, None) == was


@pytest.mark.parametrize("setting", ["true", "false"])
def test_the_session_keeps_its_own_setting(spark, setting):
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, setting)
    try:
        materialize(spark.range(3), "three")
        assert spark.conf.get(CLEANUP) == setting
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


@pytest.mark.parametrize(("edges", "tables"), [([], 1), ([(3, 3)], 1), ([(5, 1), (1, 6), (7, 1), (1, 7), (9, 8)], 1), ([(3, 2), (2, 1)], 2)])
def test_stars_need_no_round(spark, edges, tables):
    with Scratch(spark) as scratch:
        got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
        assert len(scratch.paths) == tables
    assert got == {x: min(y for e in edges for y in e if y in ({1, 5, 6, 7} if x in (1, 5, 6, 7) else {8, 9} if x > 7 else {1, 2, 3})) for e in edges if e[0] != e[1] for x in e}


def test_components_of_a_hub_and_random_edges(spark):
    """A hub with many edges, in many tasks, beside random trees and cycles."""
    rng = random.Random(5)
    edges = [(10_000, i) for i in range(1, 400)] + [(rng.randrange(400, 900), rng.randrange(400, 900)) for _ in range(330)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    with Scratch(spark) as scratch:
        got = [(r.node, r.root) for r in minhash.components(spark.createDataFrame(edges, "a long, b long").repartition(16), scratch).collect()]
    assert len(got) == len(dict(got)) and dict(got) == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_least_and_count_of_a_key_in_all_its_parts(spark):
    edges = spark.createDataFrame([(1, i) for i in range(500, 300, -1)] + [(2, 7)], "a long, b long").repartition(8)
    each, whole = minhash._per_key(edges, "a", "b")
    assert {(r.a, r.least, r.n) for r in whole.collect()} == {(1, 301, 200), (2, 7, 1)}
    assert sorted((r.a, r.b, r.least, r.n) for r in each.collect()) == sorted([(1, i, 301, 200) for i in range(301, 501)] + [(2, 7, 7, 1)])
