"""Lexical retrieval packing: neighbours from a sharded BM25 inverted index fill the windows of seed documents.

Document frequencies and the mean length are those of all documents. Documents are sorted through a shuffle by their
route: the ROUTE terms that come first in a fixed random order in which a term's chance grows with its squared BM25 weight
(weighted MinHash), so that two documents have the same first term with about the likeness of their weighty terms, wherever
they lie in the input. A shard is a run of about SHARD_TOKENS tokens in that order; it has an inverted index over
all its token ids. Rows with one route stand in order of a hash of their id, so a common route or a large group of copies
fills as many shards as its size asks for. Neighbours with other routes in other shards are not found; the README has
the measured share of those that are.

A document that is not used yet is the next seed. It is cut into full windows, and the rest of
its last one is filled with the unused documents of the shard that BM25 ranks highest for all its
terms, whole if they fit; the one that doesn't is cut, and what is left of it is the next seed. What
is left at the end of a shard makes sequences of powers of two. So no sequence has padding and a shard's memory is
bounded; a single longer document makes a shard of its own.

A document's ids are those of its text (null: empty) and the separator. Rows are packed each for itself, so rows that
repeat are packed as often. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import bisect
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm import bpe, bytewise, fastids
from paceline.llm.store import materialize, text_batches

WINDOW = 1024
SEPARATOR = 0
SHARD_TOKENS = 1_000_000
#: No limit: all terms of a seed are searched.
QUERY_TERMS = sys.maxsize
#: A term of more than 1 / DENSE of a shard's documents has its weights in a matrix; up to PRODUCT documents, scores come from one product.
DENSE, PRODUCT = 8, 2048
K1, B = 1.2, 0.75
_TERM = 21  # bits for the document in an index key
#: Terms of a route, and bits of each.
ROUTE, _ROUTE_BITS = 3, 21
#: Shards of one task of the shuffle, and most tasks; beyond, a task has more shards, one after the other.
TASK_SHARDS, MAX_PARTS = 4, 50_000
#: Rows whose routes give the borders of the tasks: for each task, and in all.
SAMPLE_PART, SAMPLE = 100, 1_000_000


class Ids:
    """The ids of texts: a fast encoder of the same vocabulary for usual characters, the tokenizers library for the rest."""

    def __init__(self, path: str, ranks: str):
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = [x.content for x in self.exact.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        self.plain = fastids.FastIds(self.fast._encode_single_piece)

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """of() for each text; plain ones are encoded together."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if bpe.PLAIN_TEXT.fullmatch(t) and not any(s in t for s in self.special)]
        data, offsets = bytewise.utf8(pa.array([texts[i] for i in plain], pa.string()))
        for a, b in bytewise.chunks(offsets):
            for i, ids in zip(plain[a:b], self.plain.of(data, offsets[a : b + 1]), strict=True):
                out[i] = np.append(ids, np.uint32(SEPARATOR)).astype("<u4")
        return [self.of(t) if x is None else x for t, x in zip(texts, out, strict=True)]

    def of(self, text: str) -> np.ndarray:
        """The ids and the separator."""
        if bpe.PLAIN_TEXT.fullmatch(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_to_numpy(text, disallowed_special=())
        else:
            ids = np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1], out[-1] = ids, SEPARATOR
        return out


_ids: dict[tuple[str, str], Ids] = {}


@dataclass
class Corpus:
    """Of all documents: how many, their mean length, and by term how many have it. Its size is the vocabulary's."""

    n: int
    mean: float
    df: np.ndarray

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[terms]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def weights(self, terms: np.ndarray, tf: np.ndarray, size: int) -> np.ndarray:
        return self.idf(terms) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))

    def route(self, ids: np.ndarray) -> int:
        """The ROUTE terms that weighted MinHash chooses, as one number; terms of no other document are left out."""
        terms, tf = np.unique(ids.astype(np.int64), return_counts=True)
        shared = self.df[terms] > 1
        terms, weights = terms[shared], self.weights(terms, tf, len(ids))[shared]
        uniform = ((bytewise.mix(terms.astype(np.uint64) + np.uint64(0x5D17)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
        at = -np.log(uniform) / weights**2
        first = np.argpartition(at, ROUTE)[:ROUTE] if len(at) > ROUTE else np.arange(len(at))
        out = 0
        for t in [*terms[first[np.argsort(at[first], kind="stable")]].tolist(), *[-1] * ROUTE][:ROUTE]:
            out = out << _ROUTE_BITS | t + 1
        return out


class Index:
    """BM25 postings of a shard's documents, and of each document its terms; without a corpus, the shard is one."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        n, sizes = len(docs), np.array([len(d) for d in docs], np.int64)
        keys = np.concatenate(docs).astype(np.int64) << _TERM
        keys |= np.repeat(np.arange(n), sizes)
        keys.sort()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        tf = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        term, self.doc = keys >> _TERM, keys & ((1 << _TERM) - 1)
        starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        df = np.diff(np.append(starts, len(term)))
        idf = corpus.idf(term[starts]) if corpus else np.log1p((n - df + 0.5) / (df + 0.5))
        mean = corpus.mean if corpus else sizes.mean()
        which = np.repeat(np.arange(len(starts)), df)
        self.weight = idf[which] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (sizes / mean)[self.doc]))
        self.begin, self.end = starts, starts + df
        order = np.argsort(self.doc, kind="stable")
        self.of_doc, self.at = which[order], np.searchsorted(self.doc[order], np.arange(n + 1))
        # terms of many documents: a row of weights each, and which documents have them
        many = DENSE * df > n
        self.rare = ~many
        row = np.cumsum(many) - 1
        entries = np.flatnonzero(many[which])
        self.dense, self.has = np.zeros((int(many.sum()), n)), np.zeros((n, int(many.sum())))
        self.dense[row[which[entries]], self.doc[entries]] = self.weight[entries]
        self.has[self.doc[entries], row[which[entries]]] = 1
        self.scores = self.has @ self.dense if n <= PRODUCT else None
        self.n = n

    def ranked(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first by all its terms, ties in order."""
        terms = self.of_doc[self.at[seed] : self.at[seed + 1]]
        terms = terms[self.rare[terms]]
        sizes = self.end[terms] - self.begin[terms]
        at = np.repeat(self.begin[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n) + (self.scores[seed] if self.scores is not None else self.has[seed] @ self.dense)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-np.round(score[found], 10), kind="stable")]


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; sequences count from 0."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    sequence = at = 0
    held: list[tuple[int, int, int]] = []
    space, seed, start, order = window, -1, 0, 0
    while True:
        if seed < 0:
            while order < len(docs) and not unused[order]:
                order += 1
            if order == len(docs):
                break
            seed, start = order, 0
            unused[seed] = False
        length = len(docs[seed])
        while length - start >= space:
            held.append((seed, start, space))
            start += space
            yield from _placed(held, sequence)
            sequence, held, space = sequence + 1, [], window
        if start == length:
            seed = -1
            continue
        held.append((seed, start, length - start))
        space -= length - start
        rest = -1
        for d in index.ranked(seed, unused).tolist():
            unused[d] = False
            size = len(docs[d])
            if size > space:
                rest = d
                break
            held.append((d, 0, size))
            space -= size
            if not space:
                break
        if not space:
            yield from _placed(held, sequence)
            sequence, held, space = sequence + 1, [], window
        seed, start = rest, 0
    while held:  # the end: a window cut into powers of two
        size = 1 << (sum(n for _, _, n in held).bit_length() - 1)
        now, held, left = held, [], size
        piece = []
        for d, s, n in now:
            take = min(n, left)
            if take:
                piece.append((d, s, take))
            if n > take:
                held.append((d, s + take, n - take))
            left -= take
        yield from _placed(piece, sequence)
        sequence += 1


def _placed(pieces: list[tuple[int, int, int]], sequence: int) -> Iterator[tuple[int, int, int, int, int]]:
    at = 0
    for d, s, n in pieces:
        yield d, s, n, sequence, at
        at += n


def _tokens(docs: DataFrame, path: str, ranks: str) -> DataFrame:
    """A row for each row of docs, and one for each task.

    Rows of docs: doc_id, tie (a hash of it), row (a number of its own) and ids, as their low halves, then their high halves.
    Rows of tasks have no ids but n, total, and terms with df: the counts of the task's documents.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, tie long, row long, ids binary, n long, total long, terms array<int>, df array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, ranks) not in _ids:
            _ids[path, ranks] = Ids(path, ranks)
        encode = _ids[path, ranks].all
        row = first = TaskContext.get().partitionId() << 36
        total, df, made = 0, np.zeros(0, np.int64), None

        def batch_of(columns: list[pa.Array], counts: list[pa.Array]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*columns, *counts], names=["doc_id", "tie", "row", "ids", "n", "total", "terms", "df"])

        for batch in batches:
            made, ids = batch.column("doc_id").type, []
            for own in encode([text or "" for text in batch.column("text").to_pylist()]):
                terms = np.unique(own)
                if len(df) <= terms[-1]:
                    df = np.pad(df, (0, int(terms[-1]) + 1 - len(df)))
                df[terms] += 1
                total += len(own)
                ids.append(own.view("<u2").reshape(-1, 2).T.tobytes())
            none = [pa.nulls(len(ids), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))]
            yield batch_of([batch.column("doc_id"), batch.column("tie"), pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.binary())], none)
            row += len(ids)
        if made is not None:
            terms = np.flatnonzero(df)
            none = [pa.nulls(1, t) for t in (made, pa.int64(), pa.int64(), pa.binary())]
            yield batch_of(none, [pa.array([row - first]), pa.array([total]), pa.array([terms], pa.list_(pa.int32())), pa.array([df[terms]], pa.list_(pa.int64()))])

    return text_batches(docs.select("doc_id", "text", F.xxhash64("doc_id").alias("tie"))).mapInArrow(run, schema)


def _array(ids: bytes) -> np.ndarray:
    """The ids of a row of _tokens()."""
    return np.ascontiguousarray(np.frombuffer(ids, "<u2").reshape(2, -1).T).view("<u4").ravel()


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [_array(x.as_py()) for x in column]


def _corpus(tokens: DataFrame) -> Corpus:
    """The counts of all rows, from those of the tasks: as many numbers as the vocabulary has terms."""
    tasks = tokens.filter("ids is null")
    n, total = tasks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    each = tasks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df")).toPandas()
    df = np.zeros(int(each["terms"].max()) + 1 if len(each) else 0, np.int64)
    df[each["terms"].to_numpy(np.int64)] = each["df"].to_numpy(np.int64)
    return Corpus(n, total / max(n, 1), df)


def _routed(tokens: DataFrame, corpus: Corpus) -> DataFrame:
    """doc_id, ids of the documents of tokens in the order of their route, then tie and row, over all partitions.

    The partitions' borders are quantiles of at most SAMPLE rows, chosen by a hash of their number; every row is routed once.
    """
    tokens = tokens.filter("ids is not null").select("doc_id", "tie", "row", "ids")
    kinds = ", ".join(f"{c} {t}" for c, t in tokens.dtypes)
    parts = max(1, min(MAX_PARTS, -(-int(corpus.n * corpus.mean) // (TASK_SHARDS * SHARD_TOKENS))))

    def routed(rows: DataFrame, borders: list[tuple[int, int]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                route = [corpus.route(d) for d in _arrays(batch.column("ids"))]
                part = [bisect.bisect_right(borders, x) for x in zip(route, batch.column("tie").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route, pa.int64()), pa.array(part, pa.int32())], names=[*batch.schema.names, "route", "part"])

        return text_batches(rows).mapInArrow(run, f"{kinds}, route long, part int")

    borders: list[tuple[int, int]] = []
    if parts > 1:
        share = min(1.0, min(SAMPLE, SAMPLE_PART * parts) / corpus.n)
        some = tokens.filter(F.pmod(F.xxhash64("row", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
        sampled = routed(some, []).select("route", "tie").toPandas()
        pairs = sorted(zip(sampled["route"].tolist(), sampled["tie"].tolist(), strict=True))
        borders = [pairs[len(pairs) * i // parts] for i in range(1, parts)] if pairs else []
    return routed(tokens, borders).repartitionById(parts, "part").sortWithinPartitions("route", "tie", "row").select("doc_id", "ids")


def packed(docs: DataFrame, path: str = bpe.DEFAULT, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of docs (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    most = SHARD_TOKENS
    tokens = materialize(_tokens(docs, path, ranks), "tokens")
    corpus = _corpus(tokens)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        keys, ids, total = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("doc_id"), batch.column("ids"), strict=True):
                keys.append(key)
                ids.append(_array(text.as_py()))
                total += len(ids[-1])
                if total >= most or len(ids) >= 1 << _TERM:
                    yield keys, ids
                    keys, ids, total = [], [], 0
        if ids:
            yield keys, ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        kind = None
        for keys, ids in shards(batches):
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pack(ids, window, corpus), strict=True))
            crc = [zlib.crc32(ids[k][s : s + n]) for k, s, n in zip(d.tolist(), start.tolist(), length.tolist(), strict=True)]
            kind = keys[0].type
            doc_id = pa.array([k.as_py() for k in keys], kind).take(pa.array(d))
            sizes = np.array([len(x) for x in ids], np.int64)[d]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes), pa.array(sequence + base), pa.array(offset)], names=names)
            base += int(sequence[-1]) + 1

    return _routed(tokens, corpus).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names[1:]))
