"""Live ingest: a file stream over the landing folder, each micro-batch published once.

A batch that was published before is left out by its id, so files that arrive again change nothing. All rows of a micro-batch carry the id of
its publication, which the store's log takes last: tables.published() reads what publications in the log wrote, so a failure on
the way leaves nothing to see, and the next run writes all of it anew. Two writers may publish at once: who finds a number of the log taken
looks whether the other published one of its batches, and begins anew if so. Late files need no watermark: versions are settled
when rows are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paceline.operators import codec
from paceline.sources import batches, log, tables


def _batches_after(spark: SparkSession, store: str, after: int = 0) -> DataFrame | None:
    """subject, batchId of batches whose publication has a larger number; None if there is no such publication."""
    found = log.entries(spark, store, after).filter("kind = 'publish'").select("publication")
    if found.isEmpty():
        return None
    return spark.read.parquet(f"{store}/commits").join(found, "publication", "left_semi").select("subject", "batchId")


def publish(lines: DataFrame, store: str) -> dict[str, int]:
    """Parse whole files, append their rows, points, deletions, marks and batches, and publish these. Counts by outcome."""
    lines = lines.persist()
    try:
        while True:
            counts = _publish_once(lines, store)
            if counts is not None:
                return counts
    finally:
        lines.unpersist()


def _publish_once(lines: DataFrame, store: str) -> dict[str, int] | None:
    """None if another writer published one of the batches meanwhile; what was written then is not in the log."""
    spark, publication = lines.sparkSession, str(uuid.uuid4())
    base = log.latest(spark, store)

    def append(df: DataFrame, name: str, partitions: list[str], sort: list[str]) -> None:
        tables.append(df.withColumn("publication", F.lit(publication)), f"{store}/{name}", partitions, sort)

    heads = batches.headers(lines)
    before = _batches_after(spark, store)
    if before is not None:
        heads = heads.join(before.withColumn("done", F.lit(True)), ["subject", "batchId"], "left").withColumn("problem", F.when(F.col("done"), "published before").otherwise(F.col("problem"))).drop("done")
    first = F.row_number().over(Window.partitionBy("subject", "batchId").orderBy("path")) == 1
    heads = heads.withColumn("problem", F.coalesce("problem", F.when(~first, "published before"))).persist()
    good, aside = batches.records(lines, heads)
    good = good.persist()
    append(batches.rows(good), "rows", ["type", "month"], ["s"])
    points = batches.stream_points(good)
    append(codec.stored(points, ["subject", "wid", "stream", "gen", "batch"], list(batches.STREAM_COLUMNS)), "points", ["stream"], ["subject", "wid", "t"])
    append(batches.tombstones(good), "deleted", ["type"], ["id"])
    append(batches.marks(good), "marks", [], ["wid"])
    append(batches.statuses(good), "statuses", [], ["at"])
    append(aside, "aside", [], ["path"])
    kept = good.groupBy("path").agg(F.count("*").alias("kept"))
    done = heads.join(kept, "path", "left").withColumn("problem", F.coalesce("problem", F.when((F.coalesce("kept", F.lit(0)) == 0) & (F.col("n") > 0), "every record was invalid")))
    done = done.persist()
    own = done.filter("problem is null").drop("problem")
    append(own, "commits", [], ["batchId"])
    counts = {r["outcome"]: r["n"] for r in done.groupBy(F.coalesce("problem", F.lit("published")).alias("outcome")).agg(F.count("*").alias("n")).collect()}
    number, placed = base, False
    while not placed:
        number += 1
        try:
            log.put(spark, store, number, {"kind": "publish", "publication": publication})
            placed = True
        except log.Taken:
            others = _batches_after(spark, store, base)
            if others is not None and not own.join(others, ["subject", "batchId"], "left_semi").isEmpty():
                break
            number = max(number, log.latest(spark, store))
    for x in (done, good, heads):
        x.unpersist()
    return counts if placed else None


def start(spark: SparkSession, landing: str, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow the landing folder; once: take what is there and end."""
    lines = spark.readStream.schema("value string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ndjson.gz").format("text").load(landing)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value")
    writer = lines.writeStream.foreachBatch(lambda df, _: publish(df, store) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def live_minutes(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """uid, window, n of a stream of (uid, ts): calls in fixed minutes, closed when the watermark passes."""
    return events.withWatermark("ts", lateness).groupBy("uid", F.window("ts", "1 minute")).agg(F.count("*").alias("n"))


def over_limit(minutes: DataFrame, limit: int) -> DataFrame:
    """uid, window, n, refused of the minutes (live_minutes()) in which someone asked more often than allowed."""
    return minutes.filter(F.col("n") > limit).withColumn("refused", F.col("n") - limit)
