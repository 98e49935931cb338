"""Token ids of whole batches of plain texts: pre-tokens are found with numpy, and each distinct one is encoded once a worker.

Plain texts are those of bpe.PLAIN_TEXT: ASCII without control characters, and the letters of Latin-1. On their UTF-8 bytes, the classes
letter, digit, blank and other give the runs that the vocabulary's pattern splits at; its rules for the blank before a word and for
contractions move the borders. Ids of known pre-tokens come from a table of fixed size by a hash of 64 bits and the length;
what the table has no room for is encoded again whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from paceline.llm import bytewise

BLANK, LETTER, DIGIT, OTHER = range(4)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = BLANK
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = LETTER
_CLASS[48:58] = DIGIT
SLOTS = 1 << 21


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of rows (bytes and n + 1 offsets, from 0)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = _CLASS[data]
    first = np.ones(n + 1, bool)  # of rows, and of runs
    first[1:n] = kind[1:] != kind[:-1]
    rows = np.zeros(n + 1, bool)
    rows[offsets] = True
    first |= rows
    start = first[:n].copy()
    # runs of blanks with something of the row behind them: the last blank stands alone, or with what follows if it is a space
    behind = np.flatnonzero(first[1:n] & ~rows[1:n] & (kind[: n - 1] == BLANK)) + 1
    start[behind - 1] = True
    start[behind[data[behind - 1] == 32]] = False
    # an apostrophe alone among others, at a start, with letters of the row behind it
    at = np.flatnonzero((data[: n - 1] == 39) & start[: n - 1] & first[1:n] & (kind[1:] == LETTER) & ~rows[1:n])
    if len(at):
        one = data[at + 1]
        two = data[np.minimum(at + 2, n - 1)]
        inside = (at + 2 < n) & ~rows[np.minimum(at + 2, n)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for found, size in ((at[short], 2), (at[long], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class FastIds:
    """encode: the ids of the bytes of one pre-token."""

    def __init__(self, encode: Callable[[bytes], list[int]]):
        self.encode = encode
        self.keys, self.sizes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.place = np.full(SLOTS, -1, np.int32)
        self.begin, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.n = 0  # known pre-tokens; begin[n] is the end of flat

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, int]:
        """Places of new pre-tokens, each in a free slot of its two if there is one, and how many are known from now on."""
        slots = np.full(len(ids), -1, np.int64)
        for shift in (0, 32):
            left = np.flatnonzero(slots < 0)
            slot = (hashes[left] >> np.uint64(shift) & np.uint64(SLOTS - 1)).astype(np.int64)
            pick = np.unique(slot, return_index=True)[1]
            pick = pick[self.place[slot[pick]] < 0]
            slots[left[pick]] = slot[pick]
            self.place[slot[pick]] = 0  # taken; its place follows
        kept = slots >= 0
        order = np.concatenate([np.flatnonzero(kept), np.flatnonzero(~kept)])  # what found no slot comes last, for this call only
        place = np.empty(len(ids), np.int64)
        place[order] = self.n + np.arange(len(ids))
        self.keys[slots[kept]], self.sizes[slots[kept]], self.place[slots[kept]] = hashes[kept], sizes[kept], place[kept]
        ids = [ids[k] for k in order.tolist()]
        ends = self.begin[self.n] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        if ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(ends[-1])), np.uint32)])
        if self.n + len(ids) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(len(self.begin), len(ids) + 1), np.int64)])
        self.flat[self.begin[self.n] : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.uint32)
        self.begin[self.n + 1 : self.n + 1 + len(ids)] = ends
        return place, self.n + int(kept.sum())

    def _known(self, hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Places of pre-tokens, -1 if unknown. Each has two slots."""
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        out = np.where((self.keys[slot] == hashes) & (self.sizes[slot] == sizes), self.place[slot], -1)
        left = np.flatnonzero(out < 0)
        slot = (hashes[left] >> np.uint64(32) & np.uint64(SLOTS - 1)).astype(np.int64)
        out[left] = np.where((self.keys[slot] == hashes[left]) & (self.sizes[slot] == sizes[left]), self.place[slot], -1)
        return out

    def of(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        words = bytewise.Words(data, offsets)
        starts = borders(data, offsets)
        if not len(starts):
            return [np.zeros(0, np.uint32)] * (len(offsets) - 1)
        ends = np.append(starts[1:], len(data))
        hashes, sizes = words.part(starts, ends), ends - starts
        place = self._known(hashes, sizes)
        known, missing = self.n, np.flatnonzero(place < 0)
        if len(missing):
            first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)[1:]
            new, raw = missing[first], data.tobytes()
            ids = [self.encode(raw[a:b]) for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
            added, known = self._add(hashes[new], sizes[new], ids)
            place[missing] = added[inverse]
        begin, n = self.begin[place], self.begin[place + 1] - self.begin[place]
        total = np.cumsum(n)
        out = self.flat[np.repeat(begin - total + n, n) + np.arange(total[-1])]
        self.n = known
        first = np.searchsorted(starts, offsets)  # the first pre-token of each row
        edges = np.append(0, total)[first]
        return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
