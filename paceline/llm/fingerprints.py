"""Document fingerprints: a canonical exact digest.

The canonical text has Unicode form NFKC, folded case, and single blanks between words; its fingerprint is the
128-bit xxhash (XXH3) in hexadecimal digits. Documents with equal fingerprints share a bucket, and the bytes in a
bucket are compared: the least and the greatest canonical text of a bucket must be one. Only texts of buckets with
several documents are shuffled for that, and each task sends one text for each bucket and distinct text it holds.
Should a bucket hold different texts, those after the first get a number behind the fingerprint.

Nulls: a null text is an empty one, whose fingerprint is that of no bytes. Ties: rows with equal ids are ordered by
text. An empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.store import materialize, text_batches

#: Least and most bits of the filter that tells which fingerprints are shared; between them, 16 for each.
LEAST_FILTER, MOST_FILTER = 1 << 22, 1 << 27
#: Bytes of texts that a task remembers in order to send equal ones once.
SEEN_BYTES = 32 << 20


def canonical(text: str) -> bytes:
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split()).encode()


def fingerprint(content: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(content)


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by as much of the beginning of the following one, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of docs (doc_id, text); collisions are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(canonical(x.as_py() or "")) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    docs = docs.select("doc_id", "text")
    plain = materialize(text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string"), "prints")
    clashes = collisions(docs, plain)
    if clashes.isEmpty():
        return plain
    told = text_batches(docs).mapInArrow(_contents, f"doc_id {dict(docs.dtypes)['doc_id']}, fingerprint string, content binary")
    told = told.join(clashes.withColumnRenamed("fingerprint", "f"), (F.col("fingerprint") == F.col("f")) & (F.col("content") == F.col("c")))
    numbers = told.select(F.col("doc_id").alias("d"), F.concat("fingerprint", F.lit("-"), "number").alias("longer"), F.col("fingerprint").alias("f2")).distinct()
    x = plain.join(numbers, (F.col("doc_id") == F.col("d")) & (F.col("fingerprint") == F.col("f2")), "left")
    return x.select("doc_id", F.coalesce("longer", "fingerprint").alias("fingerprint"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contents = [canonical(x.as_py() or "") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(fingerprint, contents), pa.string()), pa.array(contents, pa.binary())], names=["doc_id", "fingerprint", "content"])


def collisions(docs: DataFrame, plain: DataFrame) -> DataFrame:
    """fingerprint, c (content), number of the texts after the first in buckets with different texts; as good as always empty."""
    shared = materialize(plain.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").select("fingerprint"), "shared")
    n = shared.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * n).bit_length()))
    place = (F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long") % bits).alias("place")
    words = shared.select(place).groupBy(F.expr("place div 64").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))).alias("bits")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, bytes] = {}
        held = 0
        for batch in batches:
            out = []
            for x in batch.column("text"):
                content = canonical(x.as_py() or "")
                f = fingerprint(content)
                at = int(f[:8], 16) % bits
                if not int(table[at >> 6]) >> (at & 63) & 1 or seen.get(f) == content:
                    continue
                if held > SEEN_BYTES:
                    seen, held = {}, 0
                seen[f] = content
                held += len(content)
                out.append((f, content))
            if out:
                f, content = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(content, pa.binary())], names=["fingerprint", "content"])

    texts = text_batches(docs.select("text")).mapInArrow(run, "fingerprint string, content binary")
    if 16 * n > MOST_FILTER:  # too full to tell much: what it lets through meets the shared ones before its texts are compared
        texts = texts.join(shared, "fingerprint", "left_semi")
    differ = texts.groupBy("fingerprint").agg(F.min("content").alias("lo"), F.max("content").alias("hi")).filter("lo <> hi").select("fingerprint")
    differ = materialize(differ, "differ")
    if differ.isEmpty():
        return differ.withColumn("c", F.lit(None).cast("binary")).withColumn("number", F.lit(0))
    distinct = texts.join(differ, "fingerprint").distinct()
    numbered = distinct.withColumn("number", F.row_number().over(Window.partitionBy("fingerprint").orderBy("content")) - 1)
    return materialize(numbered.filter("number > 0").select("fingerprint", F.col("content").alias("c"), "number"), "clashes")


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text; ids not null) dealt into parts by ranges of doc_id; own is false for the row that follows a part's last one.

    Ranges come from quantiles of doc_id. Each range's first rows are also sent to the range before it, those of the
    first range to the last one. The driver sees the quantiles and one id for each range.
    """
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)})
    # found in two steps: the block of cuts, then the place in it
    size = max(1, math.isqrt(len(cuts)))
    blocks = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    at = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    block = at(_constant([b[0] for b in blocks], "array<bigint>"))
    inner = F.get(_constant(blocks, "array<array<bigint>>"), block - 1)
    part = F.when(block == 0, 0).otherwise((block - 1) * size + at(inner)) if cuts else F.lit(0)
    dealt = docs.select("doc_id", "text", part.cast("long").alias("part"))
    first = dict(dealt.groupBy("part").agg(F.min("doc_id")).collect())
    order = sorted(first)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # in a ring
    every = range(len(cuts) + 1)
    heads, targets = (F.get(_constant([d.get(p) for p in every], "array<bigint>"), F.col("part").cast("int")) for d in (first, before))
    copy = F.when(F.col("doc_id") == heads, F.struct(targets.alias("to"), F.lit(False).alias("own")))
    places = F.array_compact(F.array(F.struct(F.col("part").alias("to"), F.lit(True).alias("own")), copy))
    return dealt.select("doc_id", "text", F.explode(places).alias("c")).select("doc_id", "text", F.col("c.to").alias("part"), F.col("c.own").alias("own"))


def _constant(values: list, kind: str) -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_next() in order; each own row meets the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting = None
    for batch in batches:
        rows = []
        for doc, text, part, own in zip(*(batch.column(c) for c in ("doc_id", "text", "part", "own")), strict=True):
            text, part = text.as_py() or "", part.as_py()
            content = canonical(text)
            if waiting and waiting[0] == part:
                rows.append(_compared(*waiting[1:], text, content))
            elif waiting:
                rows.append(_compared(*waiting[1:], "", b""))
            waiting = (part, doc.as_py(), text, content) if own.as_py() else None
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    if waiting:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(_compared(*waiting[1:], "", b""), types, strict=True)], names=names)


def _compared(doc: int, text: str, content: bytes, following: str, next_content: bytes) -> tuple:
    new = edited(text, following)
    new_content = canonical(new)
    own, other = fingerprint(content), fingerprint(new_content)
    # equal fingerprints count only with equal bytes
    near = float(own == other and content == new_content)
    return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own, other, near, float(content == next_content)


def against_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs (doc_id, text).

    Rows without a doc_id have no place in the order: an empty text follows them, and they follow none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # whole texts move here: twice the usual partitions, and more ranges than that, so that what falls together by hash evens out
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs.filter("doc_id is not null"), 4 * parts)
    dealt = dealt.unionByName(docs.filter("doc_id is null").withColumn("part", -1 - F.spark_partition_id().cast("long")).withColumn("own", F.lit(True)))
    rows = dealt.repartition(parts, "part").sortWithinPartitions("part", F.desc("own"), "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    compared = materialize(text_batches(rows).mapInArrow(_compare, schema), "compared")
    clashes = collisions(docs, compared)
    if clashes.isEmpty():
        return compared
    told = fingerprints(docs).distinct().select(F.col("doc_id").alias("d"), F.col("fingerprint").alias("longer"), F.substring("fingerprint", 1, 32).alias("f"))
    x = compared.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("fingerprint") == F.col("f")))
    return x.withColumn("fingerprint", F.col("longer")).drop("d", "longer", "f")
