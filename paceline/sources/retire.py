"""Removal of layouts that nothing reads any more: copied with a digest of each object, every copy verified, only then removed.

Objects are copied, digested and removed by tasks, as streams of a few megabytes, so an object's size doesn't matter. What a task does again
after a lost executor ends the same. The manifest stays beside the copies.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.sources.maintenance import by_layout

CHUNK = 4 << 20
OBJECTS = "path string, layout string, name string, bytes long, modified long"
MANIFEST = "path string, copy string, layout string, bytes long, modified long, sha256 string"


class NotRemoved(Exception):
    """Something was not as the manifest says; nothing was removed, unless the message says so."""


def objects(spark: SparkSession, store: str, known: list[str]) -> DataFrame:
    """path, layout, name (below the store), bytes, modified of the store's objects whose first folder is none of the known ones. Reads no content.

    Tasks walk the folders one by one: a file source of Spark would leave out empty and hidden objects. Objects in the store's own folder
    belong to no layout and stay.
    """
    root = _whole(spark, store)
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = [x.getPath().getName() for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where) if x.isDirectory()]
    layouts = sorted(set(found) - set(known))  # folders, not objects

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for layout in part["layout"]:
                yield from _walked(root, layout)

    x = spark.createDataFrame([(n,) for n in layouts], "layout string")
    return x.repartition(max(1, len(layouts))).mapInPandas(walk, OBJECTS)


def _walked(root: str, layout: str) -> Iterator[pd.DataFrame]:
    system, base = _opened(root)
    base = base.rstrip("/")
    folders = [f"{base}/{layout}"]
    while folders:
        rows = []
        for f in system.get_file_info(arrow_fs.FileSelector(folders.pop())):
            if f.type == arrow_fs.FileType.Directory:
                folders.append(f.path)
            else:
                name = f.path[len(base) + 1 :]
                rows.append((f"{root}/{name}", layout, name, f.size, f.mtime_ns // 1_000_000))
        yield pd.DataFrame(rows, columns=["path", "layout", "name", "bytes", "modified"])


def _whole(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def plan(spark: SparkSession, store: str, known: list[str]) -> DataFrame:
    """layout, files, bytes of what would be removed."""
    return by_layout(objects(spark, store, known).select(F.col("name").alias("path"), F.col("bytes").alias("size")), known)


def _opened(uri: str):
    """The file system of a path with a scheme, and the path in it."""
    scheme, _, rest = uri.partition(":")
    return arrow_fs.FileSystem.from_uri(f"{scheme}:{'' if rest.startswith('//') else '//'}{quote(rest, safe='/:@')}")


def _digest(uri: str, copy: str | None = None) -> tuple[int, str]:
    """Bytes and SHA-256 of an object, which is copied on the way if copy is given."""
    system, path = _opened(uri)
    found, size, out = hashlib.sha256(), 0, None
    if copy is not None:
        target, where = _opened(copy)
        target.create_dir(where.rpartition("/")[0], recursive=True)
        out = target.open_output_stream(where)
    try:
        with system.open_input_stream(path) as source:
            while block := source.read(CHUNK):
                found.update(block)
                size += len(block)
                if out is not None:
                    out.write(block)
    finally:
        if out is not None:
            out.close()
    return size, found.hexdigest()


def _copied(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        done = [_digest(p, c) for p, c in zip(part["path"], part["copy"], strict=True)]
        yield part.assign(bytes=[size for size, _ in done], sha256=[found for _, found in done])


def _differing(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        wrong = []
        for r in part.itertuples():
            try:
                found = _digest(r.copy)
            except OSError:
                found = None
            wrong.append(found != (r.bytes, r.sha256))
        yield part[pd.Series(wrong, index=part.index, dtype=bool)][["path"]]


def _removed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        for p in part["path"]:
            system, path = _opened(p)
            if system.get_file_info(path).type != arrow_fs.FileType.NotFound:  # a task that runs again finds its work done
                system.delete_file(path)
        yield part[["path"]]


def back_up(spark: SparkSession, store: str, known: list[str], backup: str) -> str:
    """Copy all objects of unknown layouts below a new folder of backup; the path of the manifest (MANIFEST, Parquet)."""
    folder = f"{_whole(spark, backup)}/{uuid.uuid4().hex}"
    if folder.startswith(_whole(spark, store) + "/"):
        raise ValueError("copies must not be kept within the store")
    x = objects(spark, store, known).select("path", F.concat(F.lit(f"{folder}/data/"), "name").alias("copy"), "layout", "bytes", "modified", F.lit("").alias("sha256"))
    x.mapInPandas(_copied, MANIFEST).write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def remove(spark: SparkSession, store: str, known: list[str], manifest: str) -> DataFrame:
    """Remove what the manifest holds: layout, files, bytes of it. NotRemoved if a copy differs, or the store's objects are others than were copied."""
    listed = spark.read.schema(MANIFEST).parquet(manifest)
    spread = listed.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    bad = [r.path for r in spread.mapInPandas(_differing, "path string").take(5)]
    if bad:
        raise NotRemoved(f"copies differ from what was copied, nothing was removed: {', '.join(bad)}")
    same = ["path", "bytes", "modified"]
    now = objects(spark, store, known).select(*same)
    odd = [r.path for r in now.join(listed.select(*same), same, "left_anti").take(5)]
    if odd:
        raise NotRemoved(f"objects that were not copied, or have changed since, nothing was removed: {', '.join(odd)}")
    spread.mapInPandas(_removed, "path string").write.mode("overwrite").parquet(f"{manifest.rstrip('/')[: -len('/manifest')]}/removed")
    left = [r.path for r in objects(spark, store, known).take(5)]
    if left:
        raise NotRemoved(f"removed, but there are still objects of retired layouts: {', '.join(left)}")
    return listed.groupBy("layout").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
