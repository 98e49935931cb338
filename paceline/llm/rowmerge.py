"""Byte-level BPE by ranks on padded numpy matrices, and back.

The pre-tokens of public_tokenizers.PATTERN that a worker has not met are dealt into buckets by their length in bytes (up to 8, 16, 32 and so on).
A bucket is a matrix with one pre-token a row, padded on the right. In each round every row merges its leftmost pair of minimum rank:
ranks of pairs come from a hashed table, the merged entry takes the pair's place, and the row's rest moves up by one column,
so the matrix is one column narrower after each round. Rows without a pair in the table are done and leave the matrix.
Pre-tokens beyond LONGEST bytes, which would need as many rounds of as many columns, merge the same pairs in the same order from a heap.

Nulls count as empty texts, which have no ids. Rows are independent: repeated ids, ties and further columns have no effect, and an empty
table gives an empty result. No string is a special token: what looks like one is ordinary text. Very long texts are one row of a batch;
what a worker remembers of pre-tokens is bounded by CACHE_WORDS, and matrices by CELLS.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from paceline.llm.bpe import split
from paceline.llm.bytewise import mix
from paceline.llm.encoding import texts_of
from paceline.llm.store import text_batches

DEFAULT = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHE_WORDS = 600_000
#: Bytes of the longest row of a matrix; entries of a matrix.
LONGEST, CELLS = 512, 1 << 20
NONE = np.int32(2**31 - 1)


class PairTable:
    """Ranks of pairs of ids in an open-addressed table at most a quarter full."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        """pairs: distinct keys, left << 32 | right."""
        self.bits = max(4, int(len(pairs) * 4 - 1).bit_length()) if len(pairs) else 4
        self.keys, self.ranks = np.full(1 << self.bits, np.uint64(2**64 - 1)), np.full(1 << self.bits, NONE, np.int32)
        self.probes = 0
        slot, left = self._slots(pairs), np.arange(len(pairs))
        while len(left):
            free = np.flatnonzero(self.ranks[slot[left]] == NONE)
            takes = left[free[np.unique(slot[left[free]], return_index=True)[1]]]
            self.keys[slot[takes]], self.ranks[slot[takes]] = pairs[takes], ranks[takes]
            placed = np.zeros(len(pairs), bool)
            placed[takes] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            self.probes += 1

    def _slots(self, pairs: np.ndarray) -> np.ndarray:
        return (mix(pairs) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE for pairs that do not merge."""
        shape = left.shape
        pairs = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        out, slot, open_ = np.full(len(pairs), NONE, np.int32), self._slots(pairs), np.arange(len(pairs))
        for _ in range(self.probes):
            found = self.keys[slot]
            hit = found == pairs[open_]
            out[open_[hit]] = self.ranks[slot[hit]]
            on = ~hit & (self.ranks[slot] != NONE)
            if not on.any():
                break
            open_, slot = open_[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Ranks:
    """A byte-level vocabulary from a rank file; an id is its token's rank."""

    def __init__(self, path: str = DEFAULT):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.bytes = {i: b for b, i in self.ids.items()}
        self.pad = max(self.bytes, default=0) + 1
        self.of_byte = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        get = self.ids.get
        pairs = {a << 32 | b: i for token, i in self.ids.items() for k in range(1, len(token)) if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None}
        self.table = PairTable(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        #: Each known pre-token's ids as little-endian unsigned 32-bit integers, and the bytes that they stand for.
        self.cache: dict[str, tuple[bytes, bytes]] = {}

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each byte string."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(sizes > LONGEST).tolist():
            out[k] = self._heap(words[k])
        low, width = 0, 8
        while low < LONGEST:
            bucket = np.flatnonzero((sizes > low) & (sizes <= width))
            step = max(1, CELLS // width)
            for at in range(0, len(bucket), step):
                rows = bucket[at : at + step]
                for k, ids in zip(rows.tolist(), self._rounds([words[k] for k in rows.tolist()], sizes[rows]), strict=True):
                    out[k] = ids
            low, width = width, width * 2
        return out

    def _rounds(self, words: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
        """The ids of the byte strings of one bucket, none of them empty."""
        cells = np.full((len(words), int(sizes.max())), self.pad, np.int32)
        cells[np.arange(cells.shape[1]) < sizes[:, None]] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        rows, sizes = np.arange(len(words)), sizes.copy()
        ranks = self.table.look_up(cells[:, :-1], cells[:, 1:])
        while len(rows):
            live = (ranks != NONE).any(axis=1) if ranks.shape[1] else np.zeros(len(rows), bool)
            if not live.all():
                for k in np.flatnonzero(~live).tolist():
                    out[rows[k]] = cells[k, : sizes[k]].copy()
                cells, ranks, rows, sizes = cells[live], ranks[live], rows[live], sizes[live]
                if not len(rows):
                    break
            n, width = cells.shape
            r = np.arange(n)
            at = ranks.argmin(axis=1)  # the first of the least
            cells[r, at] = ranks[r, at]
            keep = np.ones((n, width), bool)
            keep[r, at + 1] = False
            cells = cells[keep].reshape(n, width - 1)
            keep = np.ones((n, width - 1), bool)
            keep[r, at] = False
            ranks = ranks[keep].reshape(n, width - 2)
            sizes -= 1
            for changed, rows_there in ((at - 1, at > 0), (at, at < width - 2)):  # the merged entry with its left and right neighbour
                i, j = r[rows_there], changed[rows_there]
                ranks[i, j] = self.table.look_up(cells[i, j], cells[i, j + 1])
        return out

    def _heap(self, word: bytes) -> np.ndarray:
        """The ids of a long byte string: the leftmost pair of least rank merges until there is none."""
        cells = self.of_byte[np.frombuffer(word, np.uint8)]
        first = self.table.look_up(cells[:-1], cells[1:])
        ids, n = cells.tolist(), len(cells)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        at = np.flatnonzero(first != NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        rank = first.tolist() + [int(NONE)]
        get, token = self.ids.get, self.bytes

        def renew(k: int) -> None:
            there = after[k]
            rank[k] = get(token[ids[k]] + token[ids[there]], int(NONE)) if there < n else int(NONE)
            if rank[k] != NONE:
                heapq.heappush(heap, (rank[k], k))

        while heap:
            low, k = heapq.heappop(heap)
            if ids[k] < 0 or rank[k] != low:
                continue  # it has changed since
            gone = after[k]
            ids[k], ids[gone], after[k] = low, -1, after[gone]
            if after[k] < n:
                before[after[k]] = k
            renew(k)
            if before[k] >= 0:
                renew(before[k])
        return np.array([i for i in ids if i >= 0], np.int32)

    def prepare(self, pieces: Iterable[list[str]]) -> None:
        """Make sure that the cache holds every pre-token of some texts."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = list(set().union(*pieces) - self.cache.keys())
        raw = [w.encode() for w in new]
        inside = [self.ids.get(b) for b in raw]  # a pre-token that is a token needs no merges
        rest = [k for k, i in enumerate(inside) if i is None]
        found = dict(zip(rest, self.merged([raw[k] for k in rest]), strict=True))
        token = self.bytes
        for k, w in enumerate(new):
            ids = found[k] if inside[k] is None else np.array([inside[k]], np.int32)
            self.cache[w] = ids.astype("<u4").tobytes(), b"".join(map(token.__getitem__, ids.tolist()))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, four bytes each."""
        pieces = [split(t) for t in texts]
        self.prepare(pieces)
        for p in pieces:
            yield b"".join([self.cache[w][0] for w in p])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


_loaded: dict[str, Ranks] = {}


def vocabulary(path: str = DEFAULT) -> Ranks:
    """The vocabulary of a path, once per process."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """docs (doc_id, text) as doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                raw = list(v.encode(texts))
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in raw])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), ids], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(encoded: DataFrame, path: str = DEFAULT) -> DataFrame:
    """encoded (doc_id, ids) as doc_id and data, the bytes; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            data = pa.array([v.decode(x.as_py() or ()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), data], names=["doc_id", "data"])

    encoded = encoded.select("doc_id", "ids")
    return text_batches(encoded).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, data binary")


def round_trip(docs: DataFrame, path: str = DEFAULT) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids give)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                pieces = [split(t) for t in texts]
                v.prepare(pieces)
                n, ids, decoded = [], [], []
                for p in pieces:
                    both = [v.cache[w] for w in p]
                    raw = b"".join([x for x, _ in both])
                    n.append(len(raw) // 4)
                    ids.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(b"".join([x for _, x in both])).hexdigest())
                columns = [batch.column("doc_id").slice(at, len(texts)), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select("doc_id", "text")
    return text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
