"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the base spans (email, ip, card, phone) and spans of looser patterns: local phone numbers, spelled-out
email addresses, account-like numbers. Regex, gazetteer and context labelers each vote 1 (personal), -1 (not) or 0
(no opinion) on a candidate. How often each combination of kind and votes occurs is counted over all documents;
this table has at most KINDS x 3**LABELERS rows, whatever the input. EM on it estimates, for each labeler, how it
votes on personal and other spans, and the share of personal ones of each kind. The probabilities train the final
span classifier, a logistic regression on kind and votes. Base spans always stay; other candidates stay
if the classifier says 0.5 or more, and do not overlap a base span.

Nulls: a null text is an empty one without spans. Overlapping candidates of looser patterns: the first stays.
Repeated rows are independent. An empty table trains a classifier that knows only its starting values.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from paceline.llm.store import text_batches

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("email_words", "phone_local", "account")
KINDS = BASE_KINDS + MORE_KINDS
SPAN = "array<struct<kind:string,start:long,end:long,base:boolean,score:double>>"

#: What may stand before the @ of an email address, and what must follow it.
_LOCAL = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Digits are taken whole and from the start of a run only, which finds the same and stays linear on long runs.
_PATTERNS = {
    "ip": re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
    "email_words": re.compile(r"[A-Za-z0-9._%+-]{2,64}(?: at |\s?[\[(]at[\])]\s?)[A-Za-z0-9-]{2,63}(?:(?: dot |\s?[\[(]dot[\])]\s?|\.)[A-Za-z]{2,24}){1,3}"),
    "phone_local": re.compile(r"(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{4}"),
    "account": re.compile(r"(?<![A-Za-z0-9-])(?:[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9-])"),
}
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]")

#: What context labelers look for just before a candidate.
_ASKS = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "ring"),
    "card": ("card", "visa", "credit", "debit", "pay", "account"),
    "ip": ("ip", "address", "host", "server", "login", "from"),
    "account": ("iban", "account", "ssn", "social", "tax", "passport", "bank"),
}
_DENIES = ("order", "invoice", "version", "isbn", "sku", "page", "figure", "table", "chapter", "ref", "item", "serial")
_TLDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "at", "ch", "us", "ca", "au", "jp"}
_DIAL = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "7", "81", "82", "84", "86", "90", "91", "92", "94", "98")
_ISSUERS = ("3", "4", "5", "6")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    """Leftmost addresses: for each @ the whole run before it, from the last match on, if a domain follows."""
    found, begin, at = [], 0, text.find("@")
    while at >= 0:
        before = text[begin:at]
        local = len(before) - len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            found.append(("email", at - local, m.end()))
        begin = m.end() if m else at + 1
        at = text.find("@", begin)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans by start, then kind; matches that fail their test are dropped and not tried again."""
    found = []
    if "@" in text:
        found += _emails(text)
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _PATTERNS["ip"].finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _PATTERNS["card"].finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PATTERNS["phone"].finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=_order)


def _order(span: tuple) -> tuple[int, int]:
    return span[1], KINDS.index(span[0])


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, and spans of looser patterns that overlap none before them."""
    base = base_spans(text)
    more = []
    if _DIGIT.search(text):
        more += [(k, *m.span()) for k in ("phone_local", "account") for m in _PATTERNS[k].finditer(text)]
    if " at " in text or "at)" in text or "at]" in text:
        if " dot " in text or "dot)" in text or "dot]" in text or " at " in text and "." in text:
            more += [("email_words", *m.span()) for m in _PATTERNS["email_words"].finditer(text) if "dot" in m[0] or "at)" in m[0] or "at]" in m[0]]
    out = [(k, a, b, True) for k, a, b in base]
    if more:
        starts, ends, end = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max)), 0
        for k, a, b in sorted(more, key=_order):
            before = bisect.bisect_left(starts, b)  # base spans that begin before its end
            if a >= end and (not before or ends[before - 1] <= a):
                end = b
                out.append((k, a, b, False))
    return sorted(out, key=_order)


def _shape(kind: str, s: str, before: str, after: str) -> int:
    """Regex: whether the span stands alone, and is not a piece of a longer run."""
    if before[-1:].isalnum() or after[:1].isalnum():
        return -1
    return 1 if not before or before[-1] in " \n\t(:,;" else 0


def _checksum(kind: str, s: str, before: str, after: str) -> int:
    digits = _NOT_DIGIT.sub("", s)
    if kind == "card":
        return 1 if luhn(digits) else -1
    if kind in ("phone", "phone_local"):
        return 1 if 9 <= len(digits) <= 15 else -1
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.", "255.")) else 1
    return 0


def _gazetteer(kind: str, s: str, before: str, after: str) -> int:
    if kind in ("email", "email_words"):
        return 1 if re.split(r"[^A-Za-z]+", s.rstrip(")]"))[-1].lower() in _TLDS else -1
    if kind == "phone":
        return 1 if _NOT_DIGIT.sub("", s).startswith(_DIAL) else -1
    if kind == "card":
        return 1 if s.startswith(_ISSUERS) else -1
    return 0


def _asked(kind: str, s: str, before: str, after: str) -> int:
    near = before[-32:].lower()
    return int(any(w in near for w in _ASKS[kind.split("_")[0]]))


def _denied(kind: str, s: str, before: str, after: str) -> int:
    near = before[-24:].lower()
    return -int(any(w in near for w in _DENIES))


def _variety(kind: str, s: str, before: str, after: str) -> int:
    """Made-up numbers repeat few digits."""
    digits = _NOT_DIGIT.sub("", s)
    if len(digits) < 7:
        return 0
    return -1 if len(set(digits)) <= 2 else 1 if len(set(digits)) >= 5 else 0


def _bounds(kind: str, s: str, before: str, after: str) -> int:
    """Context: more numbers around make a table of figures likelier than a person's data."""
    around = before[-16:] + after[:16]
    digits = sum(c.isdigit() for c in around)
    return -1 if digits >= 8 else 1 if not digits else 0


#: Penalty on the classifier's weights, against the mean loss of a candidate.
RIDGE = 5e-5
LABELERS = (_shape, _checksum, _gazetteer, _asked, _denied, _variety, _bounds)
#: Before training: what a labeler's vote of -1, 0, 1 is worth to the classifier.
_PRIOR = (-1.0, 0.0, 1.0)


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    before, s, after = text[max(0, start - 40) : start], text[start:end], text[end : end + 20]
    return tuple(f(kind, s, before, after) for f in LABELERS)


@dataclass
class Model:
    """The final classifier: a constant and weight for each kind, and for each labeler's vote; and what EM found."""

    kinds: dict[str, float]
    votes: list[tuple[float, float, float]]
    reliability: list[tuple[float, float]]

    def score(self, kind: str, vote: tuple[int, ...]) -> float:
        z = self.kinds[kind] + sum(w[v + 1] for w, v in zip(self.votes, vote, strict=True))
        return float(1 / (1 + np.exp(-z)))


def vote_counts(docs: DataFrame) -> DataFrame:
    """kind, votes, n over all documents: at most len(KINDS) * 3 ** len(LABELERS) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column("text"):
                text = x.as_py() or ""
                for kind, a, b, _ in candidates(text):
                    counts[kind, votes(text, kind, a, b)] += 1
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "votes", "n"])

    return text_batches(docs.select("text")).mapInArrow(run, "kind string, votes array<int>, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def train(rows: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> Model:
    """EM over counted votes, then the classifier on its probabilities."""
    prior = Model(dict.fromkeys(KINDS, -1.0), [_PRIOR] * len(LABELERS), [(0.5, 0.5)] * len(LABELERS))
    if not rows:
        return prior
    rows = sorted(rows)
    kind = np.array([KINDS.index(k) for k, _, _ in rows])
    vote = np.array([v for _, v, _ in rows]) + 1
    n = np.array([c for _, _, c in rows], float)
    said = [(vote[:, j] == 2, vote[:, j] == 0) for j in range(vote.shape[1])]  # who votes for and against; no opinion says nothing
    p = np.clip(1 / (1 + np.exp(-(vote - 1).sum(1))), 0.02, 0.98)  # start: the majority
    for _ in range(rounds):
        share = np.array([((p * n)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        yes, no = np.log(share)[kind], np.log(1 - share)[kind]
        tables = []
        for up, down in said:
            # the chance of a vote for, on personal and other spans; a tenth of its votes' weight says that a labeler is right four times in five
            own = 0.1 * n[up | down].sum() + 1
            t = [((q * n)[up].sum() + own * guess) / ((q * n)[up | down].sum() + own) for q, guess in ((p, 0.8), (1 - p, 0.2))]
            tables.append(t)
            yes = yes + np.where(up, np.log(t[0]), 0) + np.where(down, np.log(1 - t[0]), 0)
            no = no + np.where(up, np.log(t[1]), 0) + np.where(down, np.log(1 - t[1]), 0)
        p = 1 / (1 + np.exp(np.clip(no - yes, -30, 30)))
    k, j2 = len(KINDS), 2 * len(LABELERS)
    x = np.zeros((len(rows), k + j2))
    x[np.arange(len(rows)), kind] = 1
    for j, (up, down) in enumerate(said):
        x[:, k + 2 * j], x[:, k + 2 * j + 1] = down, up
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (q - p)) + RIDGE * w
        w -= np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + RIDGE * np.eye(len(w)), gradient)
    return Model(dict(zip(KINDS, w[:k].tolist(), strict=True)), [(float(w[k + 2 * j]), 0.0, float(w[k + 2 * j + 1])) for j in range(len(LABELERS))], [(float(t[0]), float(t[1])) for t in tables])


def fit(docs: DataFrame) -> Model:
    """The model of all documents; the driver gets the bounded table of counts."""
    return train([(r["kind"], tuple(r["votes"]), r["n"]) for r in vote_counts(docs).collect()])


def spans_of(text: str, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """kind, start, end, base, score of the spans of a text, by start, then kind."""
    out = []
    for kind, a, b, base in candidates(text):
        s = model.score(kind, votes(text, kind, a, b))
        if base or s >= 0.5:
            out.append((kind, a, b, base, s))
    return out


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "base", "score"), s, strict=True)) for s in spans_of(x.as_py() or "", model)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    docs = docs.select("doc_id", "text")
    return text_batches(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPAN}")


def digests(found: DataFrame) -> DataFrame:
    """The counts of base spans, base_sha256 and spans of each row of found, as detect() gives them."""
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, BASE_KINDS), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans")
    )


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs with each span of text replaced by its kind in brackets, and n_chars, if there, to match; overlapping spans are one."""
    names = docs.columns
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else replaced(t, spans_of(t, model)) for x in batch.column("text")]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = text_batches(docs).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
    return out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"])) if "n_chars" in names else out


def replaced(text: str, spans: list[tuple]) -> str:
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b, *_ in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of base spans, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
