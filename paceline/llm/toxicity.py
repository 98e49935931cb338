"""Toxicity by a weighted finite-state pattern grammar.

A clause is a run of words between stops. Small transducers read its words and are composed into one machine, whose
states are the reachable tuples of theirs, made when they are first reached:

    insult          marks the end of an insulting phrase of several words; single words have their weight from the lexicon
    threat          marks words within WINDOW words after an intention (will, going to, ...), where a harming verb is a threat
    target          whether a person or group is addressed in the clause
    negation        marks words within NEAR words after a negation
    reported speech whether a verb of saying stands in the clause or in the one before

A second machine reads clauses with a negation that follows its verb from right to left. The marks decide to which of the CHANNELS a
word's weight goes: insults and threats, plain or negated, what is reported, what is aimed at somebody. The score of a document is a
logistic function of the channels' sums over its clauses and of its highest clause; the weights of the channels are fitted to the labels,
none is less than 0. Isolated words of the lexicon thus count as much as labelled documents with them in such clauses say.

The lexicon holds fixed words of four languages and what fit() learns: words, and beginnings of 4 to 7 letters, that
labelled toxic documents have far more often than others. fit() reads at most about MAX_TRAINING labelled
documents, chosen by a hash of their ids. How pure an entry must be is chosen by cross-validation among them: entries are counted on two
thirds and judged on the third. The lexicon is as long as that bounded sample's words make it.

Nulls: a null text is an empty one; it has no clause and the lowest score. Labels that are null are not used, and
repeated labels of a document count once each. Copies of a text (in small letters) count once for each
label they have. Without labels of both kinds, the fixed lexicon and fixed coefficients are used. How rows are dealt over partitions changes nothing.
Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm import bytewise
from paceline.llm.store import materialize, text_batches

MAX_TRAINING = 10_000
PREFIXES = (4, 5, 6, 7)
#: An entry is learned if at least MIN_DOCS documents and MIN_SHARE of the toxic ones have it, of which a share of at least one of PURITIES is toxic.
MIN_DOCS, MIN_SHARE, PURITIES = 4, 0.008, (0.7, 0.8, 0.9, 0.95, 0.98)
FOLDS = 3
WINDOW, NEAR = 6, 3
CHANNELS = ("insult", "negated", "threat", "negated_threat", "reported", "aimed")

INSULTS = "idiot idiots moron morons stupid loser losers trash scum pathetic worthless disgusting clown clowns fool imbecile dumb ugly filth vermin parasite scumbag jerk creep freak pig idiota estúpido estúpida imbécil basura asqueroso payaso idiote imbécile crétin ordure minable dégoûtant abruti dumm dummkopf trottel abschaum widerlich versager arschloch".split()
PHRASES = ["piece of trash", "waste of space", "pile of garbage", "shut up", "go to hell", "drop dead", "good for nothing", "sack of filth", "hijo de perra", "fils de pute", "halt die klappe", "ta gueule"]
HARM = "kill hurt destroy beat crush shoot stab burn hang murder strangle matar golpear destruir tuer frapper détruire töten schlagen vernichten".split()
INTENT = "will shall gonna going must should deserve deserves voy vas va vais allons werde wirst wird".split()
TARGET = "you your yours he him she her they them their this these those people women men du dich dein ihr euch tu te toi vous votre ustedes usted ellos".split()
NEGATION = "not no never isn't aren't wasn't don't doesn't without nicht kein keine nie ne pas jamais non nunca sin".split()
#: Negations that follow what they negate.
AFTER = "nicht pas jamais".split()
REPORTED = "said says say told wrote writes claimed claims called quoted quote according reported alleged sagte schrieb dit écrit dijo escribió".split()

_STOPS = re.compile(r"[.!?;:,\n()\"“”«»|]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Characters outside ASCII that are no part of a word.
_BREAK = re.compile(r"[^\x00-\x7f](?<![^\W\d_])")
_TABLE = 1 << 20


@dataclass
class Model:
    """Weights of whole words and of beginnings, and the coefficients of the score: a constant, one for each channel, one for the highest clause."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, 2.0))
    beginnings: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-4.0, 2.0, 0.3, 2.0, 0.3, 1.2, 0.5, 1.5)
    purity: float = 1.0

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) >= n:
                found = max(found, self.beginnings.get(word[:n], 0.0))
        return found


#: Classes of words that move the transducers; a word's symbol is the sum of its classes and, times 16, its number among the words of phrases.
NEG, INTEND, AIM, SAY = 1, 2, 4, 8
_PHRASE_WORDS = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for p in PHRASES for w in p.split()))}
#: Marks that transducers put on words.
NEGATED, THREATENING, INSULTING = 1, 2, 4
#: The weight of a phrase and of a harming verb, as the lexicon has for words.
PHRASE, HARMING = 2.0, 2.0


@dataclass(frozen=True)
class Transducer:
    """A small machine over word symbols: step gives the next state and the mark of the word."""

    start: int
    step: Callable[[int, int], tuple[int, int]]


def _negation(since: int, symbol: int) -> tuple[int, int]:
    if symbol & NEG:
        return 0, 0
    return min(since + 1, NEAR + 1), NEGATED if since <= NEAR else 0


def _threat(since: int, symbol: int) -> tuple[int, int]:
    if symbol & NEG:
        return since, 0
    since = 0 if symbol & INTEND else since
    return min(since + 1, WINDOW + 1), THREATENING if since <= WINDOW else 0


def _phrases() -> Callable[[int, int], tuple[int, int]]:
    """The longest beginning of a phrase that the last words make, for all phrases at once."""
    ends = {tuple(_PHRASE_WORDS[w] for w in p.split()) for p in PHRASES}
    nodes = sorted({e[:n] for e in ends for n in range(len(e) + 1)})
    number = {node: i for i, node in enumerate(nodes)}

    def step(state: int, symbol: int) -> tuple[int, int]:
        read = (*nodes[state], symbol >> 4)
        while read not in number:
            read = read[1:]
        return number[read], INSULTING if any(read[-len(e) :] == e for e in ends) else 0

    return step


NEGATION_FIRST = Transducer(NEAR + 1, _negation)
THREAT = Transducer(WINDOW + 1, _threat)
AIMED = Transducer(0, lambda state, symbol: (state | bool(symbol & AIM), 0))
#: State 1: the clause before reported speech; 2: this one does.
SAID = Transducer(0, lambda state, symbol: (state | (2 if symbol & SAY else 0), 0))
INSULT = Transducer(0, _phrases())


class Machine:
    """The composition of transducers: a state for each tuple of theirs that is reached, marks joined."""

    def __init__(self, parts: tuple[Transducer, ...], starts: list[tuple[int, ...]]):
        self.parts, self.states = parts, list(starts)
        self.ids = {s: i for i, s in enumerate(starts)}
        self.moves: list[dict[int, tuple[int, int]]] = [{} for _ in starts]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.moves[state].get(symbol)
        if found is None:
            steps = [t.step(q, symbol) for t, q in zip(self.parts, self.states[state], strict=True)]
            to, mark = tuple(x[0] for x in steps), 0
            for _, m in steps:
                mark |= m
            if to not in self.ids:
                self.ids[to] = len(self.states)
                self.states.append(to)
                self.moves.append({})
            found = self.moves[state][symbol] = (self.ids[to], mark)
        return found


class Grammar:
    """The lexicon's weights through the composed machine: one pass over a clause's words, and one back where a negation may follow."""

    def __init__(self, model: Model):
        self.model = model
        self.harm, self.after = set(HARM), set(AFTER)
        self.symbols = {w: 16 * i for w, i in _PHRASE_WORDS.items()}
        for words, symbol in ((NEGATION, NEG), (INTENT, INTEND), (TARGET, AIM), (REPORTED, SAY)):
            for w in words:
                self.symbols[w] = self.symbols.get(w, 0) | symbol
        start = (NEGATION_FIRST.start, THREAT.start, AIMED.start, SAID.start, INSULT.start)
        self.machine = Machine((NEGATION_FIRST, THREAT, AIMED, SAID, INSULT), [start, (*start[:3], 1, start[4])])
        self.back = Machine((NEGATION_FIRST,), [(NEGATION_FIRST.start,)])

    def clause(self, words: list[str], reported: bool) -> tuple[list[float], bool]:
        """What the clause adds to each channel, and whether it reports speech itself."""
        machine, symbols, model, state = self.machine, self.symbols, self.model, int(reported)
        found: list[tuple[int, bool, float, int]] = []
        for i, w in enumerate(words):
            state, mark = machine.move(state, symbols.get(w, 0))
            gain = model.weight(w) + (PHRASE if mark & INSULTING else 0.0)
            if gain:
                found.append((i, False, gain, mark))
            if mark & THREATENING and w in self.harm:
                found.append((i, True, HARMING, mark))
        out = [0.0] * len(CHANNELS)
        aimed, said = self.machine.states[state][2], self.machine.states[state][3]
        if found:
            later = self._negated_later(words) if not self.after.isdisjoint(words) else None
            for i, threat, gain, mark in found:
                negated = mark & NEGATED or later is not None and later[i]
                out[4 if said else 2 * threat + bool(negated)] += gain
            if aimed and not said:
                out[5] = out[0] + out[2]
        return out, said >= 2

    def _negated_later(self, words: list[str]) -> list[bool]:
        out, state = [False] * len(words), 0
        for i in range(len(words) - 1, -1, -1):
            state, mark = self.back.move(state, NEG if words[i] in self.after else 0)
            out[i] = bool(mark)
        return out

    def document(self, text: str) -> tuple[float, ...]:
        """Logs of one plus each channel's sum, and of one plus the highest plain insult or threat of a clause."""
        total, highest, reported = [0.0] * len(CHANNELS), 0.0, False
        for clause in _STOPS.split(text):
            words = _WORD.findall(clause)
            if words:
                score, reported = self.clause(words, reported)
                if any(score):
                    total = [x + y for x, y in zip(total, score, strict=True)]
                    highest = max(highest, score[0] + score[2])
        return (*map(math.log1p, total), math.log1p(highest))


def _hashes(entries: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(entries), np.uint8)
    return bytewise.Words(data, np.array([0, len(data)])).hashes


class Finder:
    """Which rows of a batch may have a word that the grammar gives a weight, by hashes of words and beginnings; never too few.

    Words are runs of letters here, so of an entry with an apostrophe the part before it is looked for as a whole word.
    """

    def __init__(self, model: Model):
        phrases = [max(p.split(), key=len) for p in PHRASES]
        self.words = self._table([*(e.split("'")[0] for e in (*model.words, *HARM, *phrases)), *(b.split("'")[0] for b in model.beginnings if "'" in b)])
        self.beginnings = {n: self._table([b for b in model.beginnings if "'" not in b and len(b.encode()) == n]) for n in range(4, 29)}
        self.beginnings = {n: t for n, t in self.beginnings.items() if t is not None}

    @staticmethod
    def _table(entries: list[str]) -> np.ndarray | None:
        if not entries:
            return None
        table = np.zeros(_TABLE, bool)
        table[(_hashes([e.encode() for e in entries]) % np.uint64(_TABLE)).astype(np.int64)] = True
        return table

    @staticmethod
    def text(text: str) -> str:
        """What rows() takes: a blank for each character outside ASCII that is in no word."""
        return text if text.isascii() else _BREAK.sub(" ", text)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        w = bytewise.Words(data, offsets, bytewise.LETTER)
        hit = self.words[(w.hashes % np.uint64(_TABLE)).astype(np.int64)]
        for n, table in self.beginnings.items():
            long = np.flatnonzero(w.ends - w.starts >= n)
            hit[long] |= table[(w.part(w.starts[long], w.starts[long] + n) % np.uint64(_TABLE)).astype(np.int64)]
        hits = np.concatenate(([0], np.cumsum(hit)))
        return np.flatnonzero(hits[w.row[1:]] > hits[w.row[:-1]])


def _features(texts: list[str], finder: Finder, grammar: Grammar) -> list[tuple[float, ...]]:
    data, offsets = bytewise.utf8(pa.array(map(finder.text, texts), pa.string()))
    out = [(0.0,) * (len(CHANNELS) + 1)] * len(texts)
    for i, j in bytewise.chunks(offsets):
        for r in (finder.rows(data, offsets[i : j + 1]) + i).tolist():
            out[r] = grammar.document(texts[r])
    return out


def features(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """doc_id and features, what Grammar.document() gives for each text; with carry, also text and the column of that name."""
    names = ["doc_id", *(("text", carry) if carry else ())]
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, grammar = Finder(model), Grammar(model)
        for batch in batches:
            found = _features([(x.as_py() or "").lower() for x in batch.column("text")], finder, grammar)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.list_(pa.float64()))], names=[*names, "features"])

    docs = docs.select("doc_id", "text", *([carry] if carry else []))
    return text_batches(docs).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", features array<double>")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and beginnings with how many toxic and other documents of each fold have them, once for each task."""
    counts: Counter = Counter()
    for batch in batches:
        for text, fold, toxic in zip(batch.column("text"), batch.column("fold").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            entries = {"w" + w for w in words} | {"b" + w[:n] for w in words for n in PREFIXES if len(w) > n}
            counts.update((e, fold, toxic) for e in entries)
    if counts:
        e, f, t = zip(*counts, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(f, pa.int32()), pa.array(t, pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["entry", "fold", "toxic", "n"])


def _learned(counts: list[tuple[str, int, int]], positive: int, purity: float) -> Model:
    """The lexicon of counted entries (entry, toxic, other)."""
    model = Model(purity=purity)
    least = max(MIN_DOCS, int(MIN_SHARE * positive))
    for entry, toxic, other in counts:
        if toxic >= least and toxic >= purity * (toxic + other):
            weight = min(4.0, max(1.0, 0.6 * math.log((toxic + 0.5) / (other + 0.5))))
            (model.words if entry[0] == "w" else model.beginnings)[entry[1:]] = weight
    return model


def _judged(rows: DataFrame, models: list[list[Model]]) -> DataFrame:
    """digest, toxic and found of each row (digest, text, toxic, fold): the features by each model of its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [[(Finder(m), Grammar(m)) for m in own] for own in models]
        for batch in batches:
            texts = [(x.as_py() or "").lower() for x in batch.column("text")]
            fold, found = batch.column("fold").to_numpy(), [None] * len(texts)
            for f, own in enumerate(machines):
                at = np.flatnonzero(fold == f).tolist()
                each = [_features([texts[i] for i in at], *m) for m in own]
                for k, i in enumerate(at):
                    found[i] = [x[k] for x in each]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("toxic"), pa.array(found, pa.list_(pa.list_(pa.float64())))], names=["digest", "toxic", "found"])

    return text_batches(rows).mapInArrow(run, "digest string, toxic int, found array<array<double>>")


def fit(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING) -> Model:
    """The model of labelled documents. docs: doc_id, text; labels: doc_id, toxic (0, 1), only rows that may be learned from."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").distinct()
    n, positive = labels.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not positive or positive == n:
        return Model()
    share = min(1.0, max_training / n)
    some = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "toxic")
    digest = F.sha2(F.lower(F.coalesce("text", F.lit(""))), 256)
    once = sample.groupBy(digest.alias("digest"), "toxic").agg(F.min("text").alias("text"))  # copies say nothing new
    once = materialize(once.withColumn("fold", F.pmod(F.xxhash64("digest"), F.lit(FOLDS)).cast("int")), "sample")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in once.groupBy("fold", "toxic").count().collect()}
    of_fold = [sum(k for (f, t), k in sizes.items() if t == 1 and f == fold) for fold in range(FOLDS)]
    if not sum(of_fold) or not any(t == 0 for _, t in sizes):
        return Model()

    counted = text_batches(once.select("text", "fold", "toxic")).mapInArrow(_entries, "entry string, fold int, toxic int, n long").groupBy("entry")
    cells = [F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}_{t}") for f in range(FOLDS) for t in (0, 1)]
    every = [sum((F.col(f"n{f}_{t}") for f in range(FOLDS)), F.lit(0)) for t in (0, 1)]
    least = min(max(MIN_DOCS, int(MIN_SHARE * (sum(of_fold) - k))) for k in (0, *of_fold))
    may = [every[1] >= least]
    pure = [every[1] >= PURITIES[0] * (every[0] + every[1])]
    for f in range(FOLDS):
        other, toxic = every[0] - F.col(f"n{f}_0"), every[1] - F.col(f"n{f}_1")
        pure.append((toxic >= least) & (toxic >= PURITIES[0] * (toxic + other)))
    any_pure = pure[0]
    for x in pure[1:]:
        any_pure |= x
    entries = sorted(tuple(r) for r in counted.agg(*cells).filter(may[0] & any_pure).collect())

    def without(fold: int) -> list[tuple[str, int, int]]:
        """The counts of all folds but this one; -1: of all."""
        keep = [f for f in range(FOLDS) if f != fold]
        return [(e[0], sum(e[2 + 2 * f] for f in keep), sum(e[1 + 2 * f] for f in keep)) for e in entries]

    models = [[_learned(without(f), sum(of_fold) - of_fold[f], purity) for purity in PURITIES] for f in range(FOLDS)]
    rows = sorted((r["digest"], r["toxic"], r["found"]) for r in _judged(once, models).collect())
    y = np.array([t for _, t, _ in rows], float)
    tried = []
    for k, purity in enumerate(PURITIES):
        x = np.column_stack([np.ones(len(rows)), np.array([found[k] for _, _, found in rows])])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
        tried.append((round(loss, 9), -purity, tuple(float(c) for c in w)))
    _, purity, coefficients = min(tried)
    model = _learned(without(-1), sum(of_fold), -purity)
    model.coefficients = coefficients
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps with a small penalty on all but the constant; slopes are held at 0 or more."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(hessian, gradient)
        w[1:] = np.maximum(w[1:], 0.01)
    return w


def _score(model: Model) -> Column:
    constant, *slopes = model.coefficients
    z = sum((c * F.get("features", F.lit(i)) for i, c in enumerate(slopes)), F.lit(constant))
    return F.round(1 / (1 + F.exp(-z)), 12)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of each row of docs (doc_id, text)."""
    return features(docs, model).select("doc_id", _score(model).alias("score"))


def below(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs with a score under the limit, with their columns, whatever these are called."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    x = docs.select("doc_id", "text", F.struct(*rest, F.lit(None).cast("int").alias("_none")).alias("carried"))
    x = features(x, model, "carried").filter(_score(model) < limit)
    return x.select("doc_id", "text", "carried.*").select(docs.columns)


def held_out() -> Column:
    """Whether labels of a doc_id are kept from fit()."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
