"""The live path: files to minutes with a watermark."""

from pyspark.sql import functions as F

from paceline.streaming import ingest


def test_minutes_close_behind_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [("a", "2024-01-01 00:00:05"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:01:01"), ("a", "2024-01-01 00:30:00")]
    spark.createDataFrame(rows, "uid string, at string").select("uid", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(folder / "1"))
    stream = spark.readStream.schema("uid string, ts timestamp").parquet(str(folder / "*"))
    q = ingest.live_minutes(stream).writeStream.format("memory").queryName("minutes").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        # a late row of a closed minute is dropped, later ones push the watermark on
        more = [("a", "2024-01-01 00:00:10"), ("c", "2024-01-01 01:00:00")]
        spark.createDataFrame(more, "uid string, at string").select("uid", F.to_timestamp("at").alias("ts")).coalesce(1).write.parquet(str(folder / "2"))
        q.processAllAvailable()
        got = {(r.uid, str(r.window.start), r.n) for r in spark.sql("SELECT * FROM minutes").collect()}
    finally:
        q.stop()
    assert {("a", "2024-01-01 00:00:00", 2), ("b", "2024-01-01 00:01:00", 1)} <= got
