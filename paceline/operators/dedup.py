"""Versions of records: the latest wins, deletions win over all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key() -> Column:
    """id, or else series, start and source, with missing parts left out."""
    return F.coalesce("id", F.concat_ws("|", "agg", F.col("s").cast("string"), "src"))


def latest(rows: DataFrame, by: list[str | Column], order: list[str]) -> DataFrame:
    """The row of each key that is last by the columns of order."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest_metrics(maps: DataFrame, by: list[str], order: list[str], column: str = "m") -> DataFrame:
    """by, metric, value: of the maps of a key, each metric's value in the last map that has it."""
    x = maps.select(*by, *order, F.explode(column).alias("metric", "value")).filter("value is not null")
    return x.groupBy(*by, "metric").agg(F.max_by("value", F.struct(*order)).alias("value"))


def without_deleted(rows: DataFrame, deleted: DataFrame, by: list[str], key: str = "id", strip: bool = False) -> DataFrame:
    """Rows whose key is not among the deleted; rows without a key stay. strip: compare keys up to '#'."""
    d = deleted.select(*by, F.col(key).alias("_id")).distinct()
    own = F.substring_index(F.col(key), "#", 1) if strip else F.col(key)
    x = rows.withColumn("_id", own)
    return x.join(d, [*by, "_id"], "left_anti").drop("_id")


def latest_generation(points: DataFrame, by: list[str]) -> DataFrame:
    """Points of the newest generation of each stream, one for each time: newest generation, then batch."""
    newest = points.withColumn("_g", F.max("gen").over(Window.partitionBy(*by))).filter("gen = _g").drop("_g")
    return latest(newest, [*by, "t"], ["gen", "batch"])


def not_sent_again(rows: DataFrame, by: list[str], pass_start: int, pass_id: str) -> DataFrame:
    """by, id of records that a full pass from sequence pass_start on did not contain: to be deleted."""
    x = rows.filter("id is not null").groupBy(*by, "id").agg(F.max("seq").alias("last"), F.count(F.when(F.col("rid") == pass_id, 1)).alias("again"))
    return x.filter((F.col("last") < pass_start) & (F.col("again") == 0)).select(*by, "id")


def fill_missing(primary: DataFrame, fallback: DataFrame, by: list[str]) -> DataFrame:
    """primary, and fallback rows for keys that it lacks."""
    return primary.unionByName(fallback.join(primary.select(*by).distinct(), by, "left_anti"))


def differences(a: DataFrame, b: DataFrame, digits: int = 9) -> DataFrame:
    """Rows of a that b lacks and the other way round, as multisets, numbers rounded; side says which."""
    rounded = lambda x: x.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in x.dtypes))
    x, y = rounded(a), rounded(b.select(a.columns))
    return x.exceptAll(y).withColumn("side", F.lit("missing")).unionByName(y.exceptAll(x).withColumn("side", F.lit("added")))
