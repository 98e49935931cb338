"""The log of a store: numbered entries that say which publications count, each put in place once or not at all.

An entry is a small file named by its number. It is written aside and then linked (local files) or renamed without overwriting (other file systems),
so of two writers that want one number, one finds it taken: it looks at what came in between and goes on, or begins anew if that concerns it.
Data is written before its entry, under an id of its own, and counts from the entry on. A failure before that leaves nothing to see.

Kinds: publish (publication), and compact (publication, upto, partitions): in these partitions rows of publications up to a number give way to
those of this publication. Every so many entries they are also kept as one table, so that a reader opens few files.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "number long, kind string, publication string, upto long, partitions array<struct<type:string,month:string>>"
CHECKPOINT_EVERY = 50


class Taken(Exception):
    """Another writer has put an entry with this number."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []


def latest(spark: SparkSession, store: str) -> int:
    """The number of the last entry, 0 in an empty store."""
    return max((int(n[:-5]) for n in _names(spark, f"{store}/log/entries") if re.fullmatch(r"\d+\.json", n)), default=0)


def entries(spark: SparkSession, store: str, after: int = 0) -> DataFrame:
    """The entries with larger numbers than after, as SCHEMA."""
    numbers = sorted(int(n[:-5]) for n in _names(spark, f"{store}/log/entries") if re.fullmatch(r"\d+\.json", n))
    kept = max((int(n) for n in _names(spark, f"{store}/log/checkpoints") if n.isdigit() and "_SUCCESS" in _names(spark, f"{store}/log/checkpoints/{n}")), default=0)
    kept = kept if kept > after else 0
    single = [f"{store}/log/entries/{n:020}.json" for n in numbers if n > max(after, kept)]
    found = spark.read.schema(SCHEMA).json(single) if single else spark.createDataFrame([], SCHEMA)
    if kept:
        found = found.unionByName(spark.read.schema(SCHEMA).parquet(f"{store}/log/checkpoints/{kept}").filter(F.col("number") > after))
    return found


def put(spark: SparkSession, store: str, number: int, entry: dict) -> None:
    """Put an entry under a number, or raise Taken."""
    target, aside = f"{store}/log/entries/{number:020}.json", f"{store}/log/entries/.{uuid.uuid4().hex}"
    fs, where = _fs(spark, aside)
    out = fs.create(where, False)
    out.write(bytearray(json.dumps({"number": number} | entry).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            os.link(spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(where).toString(), spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(_fs(spark, target)[1]).toString())
        elif not fs.rename(where, _fs(spark, target)[1]):  # which does not overwrite
            raise Taken(number)
    except FileExistsError:
        raise Taken(number) from None
    finally:
        if fs.exists(where):
            fs.delete(where, False)
    if number % CHECKPOINT_EVERY == 0:
        entries(spark, store).filter(F.col("number") <= number).coalesce(1).write.mode("ignore").parquet(f"{store}/log/checkpoints/{number}")


def published(spark: SparkSession, store: str) -> DataFrame:
    """publication, number of those that count."""
    return entries(spark, store).select("publication", "number")


def retired(spark: SparkSession, store: str) -> DataFrame:
    """type, month, upto, by of partitions that were rewritten: rows of publications up to that number no longer count, but those of by."""
    x = entries(spark, store).filter("kind = 'compact'").select("number", "publication", "upto", F.inline("partitions"))
    return x.groupBy("type", "month").agg(F.max_by(F.struct("upto", F.col("publication").alias("by")), "number").alias("_l")).select("type", "month", "_l.*")
