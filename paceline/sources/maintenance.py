"""Upkeep of stored tables: expiry, purges, and what has landed but is not published."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.clock import DAY_MS
from paceline.sources import batches


def unexpired(rows: DataFrame, now_ms: int, days: int = 90, at: str = "at") -> DataFrame:
    """Rows younger than their time to live."""
    return rows.filter(F.col(at) >= now_ms - days * DAY_MS)


def purge(spark: SparkSession, path: str, subject: str | None = None, kind: str | None = None) -> DataFrame:
    """The table at path without a subject's rows, or those of a type, to be written anew."""
    gone = F.lit(True)
    if subject is not None:
        gone &= F.col("subject") == subject
    if kind is not None:
        gone &= F.col("type") == kind
    return spark.read.parquet(path).filter(~gone)


def inactive(activity: DataFrame, now_ms: int, days: int = 365) -> DataFrame:
    """subject of those whose last sign (subject, at) is that old."""
    return activity.groupBy("subject").agg(F.max("at").alias("last")).filter(F.col("last") < now_ms - days * DAY_MS).select("subject")


def pending(spark: SparkSession, landing: str, commits: DataFrame) -> DataFrame:
    """subject, files that have landed and whose batch is not published."""
    heads = batches.headers(batches.read_lines(spark, landing))
    x = heads.filter("problem is null").join(commits.select("subject", "batchId").distinct(), ["subject", "batchId"], "left_anti")
    return x.groupBy("subject").agg(F.count("*").alias("files"))


def completeness(claims: DataFrame, waiting: DataFrame) -> DataFrame:
    """claims (subject, type, complete) that hold only where no file of the subject is pending()."""
    x = claims.join(waiting.select("subject", "files"), "subject", "left")
    return x.withColumn("complete", F.col("complete") & F.col("files").isNull()).withColumn("files", F.coalesce("files", F.lit(0)))


def by_layout(files: DataFrame, known: list[str]) -> DataFrame:
    """layout, files, bytes of stored objects (path, size) whose first folder is none of the known ones: what a cleanup would move."""
    layout = F.regexp_extract("path", r"^([^/]+)/", 1)
    return files.withColumn("layout", layout).filter(~F.col("layout").isin(*known)).groupBy("layout").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
