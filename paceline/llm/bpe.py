"""Byte-level BPE by a prefix-sharing trie.

The encoding of a byte string is that of a shorter prefix and one last token: the token is one that ends there
and that BPE would not merge across. So each node of a trie of words keeps its last token only, and a node is
settled by the tokens that end at it and the last tokens of its ancestors. Words that share a prefix share the
work on it. The distinct new words of a batch are inserted in sorted order, which walks the trie depth first: the
path of the word before is the stack of states, and what two neighbours share is kept.

Encodings of words are kept per worker process up to CACHE_WORDS, then dropped, so memory is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import public_tokenizers
import regex

DEFAULT = public_tokenizers.path("byte_bpe_50k.json")
CACHE_WORDS = 600_000
#: What the plain pattern below may be used on: characters whose classes are the same for it and the full one.
PLAIN_TEXT = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7fÀ-ÖØ-öø-ÿ]*")
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s0-9{_L}]+|\s+(?!\S)|\s+")
_FULL = regex.compile(public_tokenizers.PATTERN)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers file."""

    def __init__(self, path: str = DEFAULT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        self.longest = max(map(len, self.ids))
        #: A token's two parts, and the rank of each merge.
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        vocab = spec["model"]["vocab"]
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocab[a], vocab[b]
            self.rank[pair] = rank
            self.parts.setdefault(vocab[a + b], pair)
        self._first = {i: self.rank[p] for i, p in self.parts.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self._fits: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b, side by side, as they are.

        Merges are taken apart from the last made; a merge across the border of what is left, made before both
        sides were, says no.
        """
        key, limit, answer = a << 20 | b, float("inf"), True
        first, parts, rank = self._first, self.parts, self.rank
        while True:
            across = rank.get((a, b))
            if across is not None and across < limit:
                answer = False
                break
            ra, rb = first.get(a, -1), first.get(b, -1)
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = ra, parts[a][1]
                # the right part of a meets b from here on; merges of equal rank go left to right
            else:
                limit, b = rb + 1, parts[b][0]
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[key] = answer
        return answer

    def add(self, words: set[str]) -> None:
        """Settle the words that the cache lacks, in one walk of their trie."""
        new = sorted((w.encode("utf-8"), w) for w in words if w not in self.cache)
        ids, fits, known, longest, cache = self.ids, self.fits, self._fits, self.longest, self.cache
        last: list[int] = [-1]  # the last token of each prefix of path
        size: list[int] = [0]  # and its bytes
        path = b""
        for word, text in new:
            n = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                n += 1
            del last[n + 1 :], size[n + 1 :]
            grown = size[n] + 1
            for end in range(n + 1, len(word) + 1):
                # one token only can be the last, so the order of trying is free: the grown one, then short ones
                begin, k = end - grown, 0
                while True:
                    token = ids.get(word[begin:end])
                    if token is not None:
                        if not begin:
                            break
                        pair = last[begin] << 20 | token
                        fit = known.get(pair)
                        if fit is None:
                            fit = fits(last[begin], token)
                        if fit:
                            break
                    k += 1
                    if k > end or k > longest:
                        raise ValueError(f"no token for {word[:end]!r}")
                    begin = end - k
                last.append(token)
                grown = end - begin
                size.append(grown)
                grown += 1
            path, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= size[end]
            cache[text] = tuple(out[::-1])

    def pieces(self, text: str) -> list[str]:
        """The words that BPE works within, special tokens among them, in order; joined they are the text."""
        if self._special is None or not (found := list(self._special.finditer(text))):
            return split(text)
        out, at = [], 0
        for m in found:
            out += split(text[at : m.start()])
            out.append(m.group())
            at = m.end()
        return out + split(text[at:])

    def prepare(self, pieces: Iterable[list[str]]) -> set[str]:
        """Make sure that the cache holds every word of some texts; these words."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        for s, i in self.added.items():
            self.cache[s] = (i,)
        words = set().union(*pieces)
        self.add(words)
        return words

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        split_up = [self.pieces(t) for t in texts]
        self.prepare(split_up)
        for p in split_up:
            yield list(chain.from_iterable(map(self.cache.__getitem__, p)))

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, special tokens shown; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    @cached_property
    def special_length(self) -> int:
        return max(map(len, self.added), default=0)


def split(text: str) -> list[str]:
    return (_PLAIN if PLAIN_TEXT.fullmatch(text) else _FULL).findall(text)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = DEFAULT) -> Vocabulary:
    """The vocabulary of a path, once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]
