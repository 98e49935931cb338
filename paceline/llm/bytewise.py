"""Words, word hashes and shingle hashes of whole Arrow batches, on their UTF-8 bytes with numpy.

A word is a run of bytes of one class. Its hash is a polynomial in the odd base BASE modulo 2**64 over
random byte values, finished with a mixer; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240817))
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[65:91] = _VALUES[97:123]
#: Every byte but the blank and \x09 to \x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: ASCII letters and all bytes of characters outside ASCII.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(19, (n - 1).bit_length())
        out = []
        for base in (BASE, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; h is left as it is."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers, at = column.buffers(), column.offset
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[at : at + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = (1 << 19) - 1) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about size bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: starts, ends (bytes), hashes, and first word of each row (n + 1 places)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True):
        """data, offsets: as utf8() gives them, possibly a range of rows (offsets need not begin at 0)."""
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = inside[data]
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            full = offsets[:-1] < offsets[1:]
            first[offsets[:-1][full]] = inside[offsets[:-1][full]]
            last[offsets[1:][full] - 1] = inside[offsets[1:][full] - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.starts, offsets)
        if hashed:
            p, self._inverse = _power_tables(n + 1)
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((_LOWER_VALUES if lower else _VALUES)[data] * p[:n], out=self._sums[1:])
            self.hashes = self.part(self.starts, self.ends)

    def part(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges."""
        return mix((self._sums[ends] - self._sums[starts]) * self._inverse[starts] + (ends - starts).astype(np.uint64))

    def counts(self, marked: np.ndarray) -> np.ndarray:
        """How many bytes of each row are marked."""
        c = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=c[1:])
        return c[self.offsets[1:]] - c[self.offsets[:-1]]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k entries; k - 1 fewer than entries."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(BASE)
    for j in range(k):
        out = out * factor + hashes[j : j + n]
    return mix(out)


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its runs of k words; fewer words: of the whole sequence; none: empty."""
    runs = windows(words.hashes, k)
    for a, b in zip(words.row[:-1], words.row[1:], strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield windows(words.hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)
