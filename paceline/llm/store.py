"""Tables that several jobs of one operator read: written once to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of a batch that goes to Python.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20
#: Whether Spark removes the shuffle files of a query when it has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset on a local master, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _own[key]


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a table and its path; what was shuffled for it goes as soon as it is written. The session's own setting stays as it was."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    Every executor can read the files, so a lost executor costs no recomputation of earlier steps.
    The files go when the application ends.
    """
    out, path = _write(df, name)
    fs, where = _file_system(df.sparkSession, path)
    fs.deleteOnExit(where)
    return out


class Scratch:
    """Tables like materialize()'s that an operator needs only while it works; they go when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            fs, where = _file_system(self.spark, path)
            fs.delete(where, True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        out, path = _write(df, name)
        self.paths.append(path)
        return out


def text_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of ARROW_ROWS and about ARROW_BYTES unless the session has smaller ones.

    Texts are long; batches of the usual 10,000 rows would fill a worker's memory.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        if not 0 < _number(conf.get(key, None)) <= most:
            conf.set(key, most)
    return df


def _number(text: str | None) -> int:
    return int(text) if text and text.isdigit() else 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
