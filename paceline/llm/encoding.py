"""BPE encoding and decoding of whole texts; the method is in paceline.llm.bpe.

Nulls count as empty texts, which have no ids. Rows are independent: repeated ids, ties and further columns have no
effect, and an empty table gives an empty result. Special tokens written out in a text are those tokens.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paceline.llm import bpe
from paceline.llm.store import text_batches


def texts_of(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """Ranges of some MB of texts and where they begin."""
    begin, held, out = 0, 0, []
    for i, x in enumerate(column):
        t = x.as_py() or ""
        out.append(t)
        held += len(t)
        if held > size:
            yield begin, out
            begin, held, out = i + 1, 0, []
    if out:
        yield begin, out


def encode(docs: DataFrame, path: str = bpe.DEFAULT) -> DataFrame:
    """docs (doc_id, text) as doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                ids = pa.array(list(v.encode(texts)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str = bpe.DEFAULT) -> DataFrame:
    """encoded (doc_id, ids) as doc_id and text; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for batch in batches:
            texts = pa.array([v.decode(x.as_py() or ()) for x in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], names=["doc_id", "text"])

    encoded = encoded.select("doc_id", "ids")
    return text_batches(encoded).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")


def round_trip(docs: DataFrame, path: str = bpe.DEFAULT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by commas), decoded_sha256 of each text, encoded and decoded.

    Words repeat, so a word's ids are written out, and turned back to bytes, once for each batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                pieces = [v.pieces(t) for t in texts]
                words = v.prepare(pieces)
                shown = {w: ",".join(map(str, v.cache[w])) for w in words}
                back = {w: b"".join(map(v.bytes.__getitem__, v.cache[w])) for w in words}
                n, ids, decoded = [], [], []
                for p in pieces:
                    joined = ",".join(map(shown.__getitem__, p))
                    n.append(joined.count(",") + 1 if joined else 0)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    decoded.append(hashlib.sha256(b"".join(map(back.__getitem__, p)).decode("utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    return text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
