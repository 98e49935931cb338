"""Stored tables: Parquet by type and month, written once for each batch, read with pruning and latest versions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.clock import local_day
from paceline.operators import codec, dedup
from paceline.sources import log
from paceline.sources.batches import ROW_SCHEMA, STREAM_COLUMNS

POINT_KEYS = ("subject string", "wid string", "stream string", "gen long", "batch string", "unit string")
POINT_SCHEMA = ", ".join([*POINT_KEYS, "t long", *(f"{c} double, {c}_i long, {c}_m int" for c in STREAM_COLUMNS)])


#: zstd, and the second version of the format, which stores integers as differences.
PARQUET = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}


def append(df: DataFrame, path: str, partitions: list[str], sort: list[str]) -> None:
    """Append df, sorted within its files; rows of one partition of the table meet before, in tasks of even size."""
    if partitions:
        df = df.hint("rebalance", *partitions)
    df.sortWithinPartitions(*partitions, *sort).write.mode("append").partitionBy(*partitions).options(**PARQUET).parquet(path)


def replace_partitions(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write df in place of the partitions that it has rows of, and only those."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).option("compression", "zstd").parquet(path)


def published(spark: SparkSession, store: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of a store: the rows of publications that the store's log holds. One that failed on its way left rows that nobody sees.

    Of rows, a partition that was rewritten counts in its latest form, with what came after.
    """
    x = spark.read.schema(f"{schema}, publication string") if schema else spark.read
    x = x.parquet(f"{store}/{name}").join(log.published(spark, store), "publication")
    if name == "rows":
        x = x.join(log.retired(spark, store), ["type", "month"], "left").filter(F.col("by").isNull() | (F.col("number") > F.col("upto")) | (F.col("publication") == F.col("by"))).drop("upto", "by")
    return x.drop("publication", "number")


def read_rows(spark: SparkSession, store: str, kind: str, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Published rows of a type in a half-open range; months outside it are not read."""
    x = published(spark, store, "rows", ROW_SCHEMA).filter(F.col("type") == kind)
    if start_ms is not None:
        x = x.filter((F.col("month") >= F.date_format(local_day(F.lit(start_ms)), "yyyy-MM")) & (F.col("s") >= start_ms))
    if end_ms is not None:
        x = x.filter((F.col("month") <= F.date_format(local_day(F.lit(end_ms - 1)), "yyyy-MM")) & (F.col("s") < end_ms))
    return x


def read_points(spark: SparkSession, store: str, columns: list[str] | None = None) -> DataFrame:
    """Published points of raw streams as doubles, whatever they are stored as; all value columns, or those that are named."""
    columns = list(STREAM_COLUMNS) if columns is None else columns
    rows = published(spark, store, "points", POINT_SCHEMA)
    keys = [f.split()[0] for f in POINT_KEYS]
    return codec.restored(rows, columns).select(*keys, "t", *columns)


def current_rows(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """The latest version of each record that is not deleted, whenever it came."""
    x = dedup.without_deleted(rows, deleted, ["subject", "type"])
    return dedup.latest(x, ["subject", "type", dedup.row_key()], ["seq", "batch"])


def compacted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """What a rewritten partition holds: current rows; days keep each metric of all versions, so answers don't change."""
    days = rows.filter("k = 'day'")
    metrics = dedup.latest_metrics(days.withColumn("m", F.from_json(F.get_json_object("extra", "$.m"), "map<string,string>")), ["subject", "type", "id"], ["seq", "batch"])
    merged = metrics.groupBy("subject", "type", "id").agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))).alias("_extra"))
    kept = current_rows(days, deleted).join(merged, ["subject", "type", "id"], "left").withColumn("extra", F.coalesce("_extra", "extra")).drop("_extra")
    others = dedup.without_deleted(rows.filter("k <> 'day'"), deleted, ["subject", "type"], strip=True)
    return dedup.latest(others, ["subject", "type", dedup.row_key()], ["seq", "batch"]).unionByName(kept.select(others.columns))


def files_of(spark: SparkSession, store: str) -> DataFrame:
    """type, month, publication, number, path, bytes of the files of rows that count."""
    x = spark.read.schema(f"{ROW_SCHEMA}, publication string").parquet(f"{store}/rows").select("type", "month", "publication", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
    x = x.join(log.published(spark, store), "publication").join(log.retired(spark, store), ["type", "month"], "left")
    return x.filter(F.col("by").isNull() | (F.col("number") > F.col("upto")) | (F.col("publication") == F.col("by"))).drop("upto", "by")


def fragmented(spark: SparkSession, store: str, files: int = 8, bytes_each: int = 64 << 20) -> DataFrame:
    """type, month, files, bytes of partitions of rows with more files than that, whose mean size is below bytes_each."""
    x = files_of(spark, store).groupBy("type", "month").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    return x.filter((F.col("files") > files) & (F.col("bytes") < F.col("files") * bytes_each))


def compact(spark: SparkSession, store: str, files: int = 8) -> int:
    """Write fragmented partitions of rows anew, without what is superseded or deleted, and let the log take the new form. How many partitions.

    Readers see the old form or the new one, whenever they began; what is published meanwhile counts beside either. Old files stay for readers
    that began before, until swept() is asked to remove them. Of two compactions of one partition, the one that ends first counts; the other
    raises log.Taken and leaves nothing to see.
    """
    base, publication = log.latest(spark, store), str(uuid.uuid4())
    chosen = [r.asDict() for r in fragmented(spark, store, files).select("type", "month").collect()]  # partitions, not rows
    if not chosen:
        return 0
    rows = published(spark, store, "rows", ROW_SCHEMA).join(F.broadcast(spark.createDataFrame(chosen, "type string, month string")), ["type", "month"], "left_semi")
    whole = compacted(rows, published(spark, store, "deleted")).withColumn("publication", F.lit(publication))
    append(whole, f"{store}/rows", ["type", "month"], ["s"])
    entry, number = {"kind": "compact", "publication": publication, "upto": base, "partitions": chosen}, base
    while True:
        number += 1
        try:
            log.put(spark, store, number, entry)
            return len(chosen)
        except log.Taken:
            own = spark.createDataFrame(chosen, "type string, month string")
            if not log.entries(spark, store, base).filter("kind = 'compact'").select(F.inline("partitions")).join(own, ["type", "month"], "left_semi").isEmpty():
                raise
            number = max(number, log.latest(spark, store))


def swept(spark: SparkSession, store: str, before_ms: int) -> list[str]:
    """Remove files of rows that no longer count and are older than that; these paths. Files of publications under way are younger."""
    x = spark.read.schema(f"{ROW_SCHEMA}, publication string").parquet(f"{store}/rows")
    old = x.select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("at")).distinct().filter(F.col("at") < before_ms)
    gone = [r.path for r in old.join(files_of(spark, store).select("path"), "path", "left_anti").toLocalIterator()]
    for path in gone:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    return gone


def bounded_json(df: DataFrame, limit: int = 60_000) -> str:
    """A result as a JSON list, refused beyond limit bytes; no more rows are fetched than could fit."""
    out, size = [], 2
    for (row,) in df.select(F.to_json(F.struct("*"))).toLocalIterator():
        size += len(row.encode()) + 1
        if size > limit:
            raise ValueError(f"the result is larger than {limit} bytes; ask for less")
        out.append(row)
    return "[" + ",".join(out) + "]"
