"""Edit-aware token counts: a segment tree over the pre-tokens of each document.

A leaf covers up to LEAF pre-tokens and holds their characters and tokens; inner nodes hold sums, in heap order.
An edit finds its leaves by the character sums, starts over at the border of the leaf that lies CONTEXT characters
before it, splits until a border falls on the end of an old leaf, and encodes only what lies between. How text is
split from a border on depends only on what follows, so all later leaves stay true. The sums on the paths to the
changed leaves are updated; leaves that have grown to more than twice LEAF are split, so that many edits cost as little each as the first.

Nulls: a null text is an empty one, null edits are none, a null insertion is empty. Edits are ranges of the
original text in code points; ranges beyond its end are cut to it. Edits of one document must not overlap; at one
place, insertions keep the order of the list. Empty texts have one empty leaf. Repeated rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm import bpe
from paceline.llm.encoding import texts_of
from paceline.llm.store import text_batches

LEAF = 32
EDITS = "array<struct<at:long,removed:long,inserted:string>>"


class Tree:
    """Sums of characters and of tokens over the leaves of one text."""

    def __init__(self, leaves: int, chars: list[int], tokens: list[int]):
        self.leaves, self.chars, self.tokens = leaves, chars, tokens

    @classmethod
    def of(cls, pieces: list[str], count: dict[str, tuple[int, ...]]) -> Tree:
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        tree = cls(1, [], [])
        tree.grow([sum(map(len, g)) for g in groups], [sum(len(count[p]) for p in g) for g in groups])
        return tree

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (or the last that holds any), and where it begins."""
        k, begin = 1, 0
        while k < self.leaves:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.leaves, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = self.leaves + leaf
        dc, dt = chars - self.chars[k], tokens - self.tokens[k]
        while k and (dc or dt):
            self.chars[k] += dc
            self.tokens[k] += dt
            k //= 2

    def cut(self, text: str) -> list[str]:
        """The text of each leaf."""
        out, at = [], 0
        for n in self.chars[self.leaves :]:
            out.append(text[at : at + n])
            at += n
        return out

    def grow(self, chars: list[int], tokens: list[int]) -> None:
        """Other leaves, whose number may differ."""
        n = 1 << (max(len(chars), 1) - 1).bit_length()
        self.leaves, self.chars, self.tokens = n, [0] * n + chars + [0] * (n - len(chars)), [0] * n + tokens + [0] * (n - len(tokens))
        for k in range(n - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]


def edit(leaves: list[str], tree: Tree, at: int, removed: int, inserted: str, v: bpe.Vocabulary) -> int:
    """How many pre-tokens were encoded anew; tree and leaves (the text of each, see Tree.cut) are updated.

    What was encoded is dealt evenly over the leaves that it replaces. If these get more than 2 * LEAF pre-tokens each, it is cut into leaves
    of LEAF and the sums of the tree are made again, which encodes nothing. So an edit's work does not grow with the edits before it.
    """
    context = v.special_length + 3
    first, start = tree.find(max(0, at - context))
    last, _ = tree.find(at + removed)
    old = "".join(leaves[first : last + 1])
    new = old[: at - start] + inserted + old[at - start + removed :]
    while True:
        follows, k = "", last + 1
        while k < len(leaves) and len(follows) < context:
            follows += leaves[k]
            k += 1
        pieces, size = [], 0
        for p in v.pieces(new + follows[:context]):
            if size >= len(new):
                break
            pieces.append(p)
            size += len(p)
        if size == len(new):
            break
        last += 1
        new += leaves[last]
    v.prepare([pieces])
    n = last - first + 1
    fits = len(pieces) <= 2 * LEAF * n
    groups = [pieces[len(pieces) * i // n : len(pieces) * (i + 1) // n] for i in range(n)] if fits else [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
    texts, tokens = ["".join(g) for g in groups], [sum(len(v.cache[p]) for p in g) for g in groups]
    if fits:
        for i, (text, count) in enumerate(zip(texts, tokens, strict=True)):
            leaves[first + i] = text
            tree.put(first + i, len(text), count)
    else:
        counts = tree.tokens[tree.leaves :]
        leaves[first : last + 1], counts[first : last + 1] = texts, tokens
        full = [(text, count) for text, count in zip(leaves, counts, strict=True) if text]
        tree.grow([len(text) for text, _ in full], [count for _, count in full])
        leaves[:] = [text for text, _ in full] + [""] * (tree.leaves - len(full))
    return len(pieces)


def build(docs: DataFrame, path: str = bpe.DEFAULT) -> DataFrame:
    """docs (doc_id, text, and edits if there) with leaves, chars and tokens, the segment tree of each text, and n_pieces."""
    docs = docs.select("doc_id", "text", *(["edits"] if "edits" in docs.columns else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                pieces = [v.pieces(t) for t in texts]
                v.prepare(pieces)
                trees = [Tree.of(p, v.cache) for p in pieces]
                part = batch.slice(at, len(texts))
                more = [pa.array([len(p) for p in pieces], pa.int64()), pa.array([t.chars for t in trees], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "n_pieces", "chars", "tokens"])

    kinds = dict(docs.dtypes)
    return text_batches(docs).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in docs.columns) + ", n_pieces long, chars array<int>, tokens array<int>")


def apply_edits(trees: DataFrame, path: str = bpe.DEFAULT) -> DataFrame:
    """Trees as build() gives them, with a column edits: doc_id, text (edited), n_tokens, edited_tokens, n_pieces, recoded_pieces, chars, tokens (updated)."""
    kind = dict(trees.dtypes)["doc_id"]
    names = ["doc_id", "text", "n_tokens", "edited_tokens", "n_pieces", "recoded_pieces", "chars", "tokens"]
    types = [pa.string(), *[pa.int64()] * 4, *[pa.list_(pa.int32())] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for batch in batches:
            for at, texts in texts_of(batch.column("text")):
                part = batch.slice(at, len(texts))
                rows = []
                for i, text in enumerate(texts):
                    chars, tokens = part.column("chars")[i].as_py(), part.column("tokens")[i].as_py()
                    tree, before, recoded, n = Tree(len(chars) // 2, chars, tokens), tokens[1], 0, len(text)
                    leaves = tree.cut(text)
                    for e in sorted(part.column("edits")[i].as_py() or [], key=lambda e: e["at"])[::-1]:
                        begin = min(max(e["at"], 0), n)
                        recoded += edit(leaves, tree, begin, min(max(e["removed"], 0), n - begin), e["inserted"] or "", v)
                    rows.append(("".join(leaves), before, tree.tokens[1], part.column("n_pieces")[i].as_py(), recoded, tree.chars, tree.tokens))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=names)

    return text_batches(trees.select("doc_id", "text", "edits", "n_pieces", "chars", "tokens")).mapInArrow(run, f"doc_id {kind}, text string, n_tokens long, edited_tokens long, n_pieces long, recoded_pieces long, chars array<int>, tokens array<int>")


def sample_edits() -> Column:
    """The query's edits of a text: a word in front, a third of the way in nine characters replaced by its first twelve, half way a removal, an ending."""
    t = F.coalesce("text", F.lit(""))
    n = F.length(t)
    at = [F.lit(0), F.floor(n / 3), F.floor(n / 2) + 9, n + 9]
    removed = [F.lit(0), F.lit(9), F.lit(40), F.lit(0)]
    inserted = [F.lit("Draft: "), F.substring(t, 1, 12), F.lit(""), F.lit(" (end)")]
    return F.array(*(F.struct(a.cast("long").alias("at"), r.cast("long").alias("removed"), i.alias("inserted")) for a, r, i in zip(at, removed, inserted, strict=True)))
