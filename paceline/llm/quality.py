"""Quality rules: robust multivariate outliers by minimum-covariance-determinant (MCD) estimates.

Each document that passes the base rules gives a vector of transformed statistics. The vectors of each language and source
have an MCD centre and covariance, found as deterministic MCD does: from three starts (medians with quartile ranges; the
covariance of hyperbolic tangents; that of spatial signs), concentration steps take the SHARE of vectors with the least distance
and estimate anew, until no group's determinant falls any more (STEPS at most). The least determinant of the three wins, is made consistent
with a normal cloud, and is reweighted: the final estimate is that of all vectors within the REWEIGHT quantile. A document is rejected if its
squared Mahalanobis distance exceeds LIMIT. Languages and sources with fewer than MIN_GROUP such vectors share one estimate for
the language's small sources, or one for all that are smaller still.

Vectors are integers (fixed point), so their sums are exact in any order and a repeated task gives the same
estimates. A step is one aggregation by group, start and distance bucket over the distinct vectors with their counts, whatever
the size of a group; of the bucket in which SHARE is reached, the share that is missing counts. Only sums of buckets, some hundred rows a
group, meet in Python. A statistic whose spread is under its floor (see FEATURES) has the floor as spread; the estimate says how many
do (floored).

Nulls: a null text is an empty one; a null language or source is a group like any other. Empty texts have a zero
vector and fail the base rule. Repeated rows count each. Without any vector there is no estimate, and the base rules alone decide. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm import bytewise
from paceline.llm.store import materialize, text_batches

#: Fixed point: units to one. Sums of squares of 4e10 documents in one group still fit a long.
UNIT = 256
#: The transformed statistics, and the least standard deviation of each, in their own unit; it keeps rules with
#: no spread among usual documents from rejecting a trace.
FEATURES = {"log_words": 0.5, "word_length": 0.6, "symbols": 0.04, "dup_lines": 0.12, "repeats": 0.10, "upper": 0.06, "long_words": 0.12}
P = len(FEATURES)
SHARE, REWEIGHT = 0.75, 0.975
#: Most steps, and what a determinant's logarithm falls by if it falls.
STEPS, FALL = 20, 1e-3
STARTS = ("ranges", "tanh", "signs")
MIN_GROUP = 200


def chi_squared(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_squared(middle, k) < p else (low, middle)
    return high


def consistency(share: float) -> float:
    """What the covariance of the inner share of a normal cloud is multiplied by."""
    return share / chi_squared(quantile(share, P), P + 2)


#: Only gross outliers go.
LIMIT = quantile(1 - 1e-9, P)
#: Code points of a word that is not long yet.
LONG_WORD = 24
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_HEAD = ~((np.arange(256) & 0xC0) == 0x80)
_SPACES = " \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTS = (*BASE, "upper", "long_words")


def repeated_words(words: list[str], k: int = 8) -> int:
    """Words that lie in a run of k words found twice or more."""
    runs = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    seen = Counter(runs)
    total = end = 0
    for i, run in enumerate(runs):
        if seen[run] > 1:
            total += i + k - max(i, end)
            end = i + k
    return total


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def _statistics(batches: Iterator[pa.RecordBatch], drop: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        data, offsets = bytewise.utf8(column)
        for i, j in bytewise.chunks(offsets):
            w = bytewise.Words(data, offsets[i : j + 1])
            counts = np.diff(w.row)
            inside = bytewise.NOT_SPACE[w.data]
            heads = _HEAD[w.data]
            out = {"n_words": counts, "word_chars": w.counts(inside & heads), "n_symbols": w.counts(_SYMBOL[w.data])}
            upper, long_words = w.counts(_UPPER[w.data]), np.zeros(j - i, np.int64)
            points = np.concatenate(([0], np.cumsum(heads)))
            np.add.at(long_words, np.repeat(np.arange(j - i), counts), points[w.ends] - points[w.starts] > LONG_WORD)
            breaks = w.counts(w.data == 10)
            runs = bytewise.windows(w.hashes, 8)
            dup, rep = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
            for r in range(j - i):
                a, b = w.row[r], w.row[r + 1]
                twice = False
                if b - a > 8:
                    s = np.sort(runs[a : b - 7])
                    twice = bool((s[1:] == s[:-1]).any())
                if twice or breaks[r]:
                    text = column[i + r].as_py()
                    dup[r] = duplicate_lines(text) if breaks[r] else 0
                    if twice:  # equal hashes only say where to look
                        rep[r] = repeated_words([x.decode() for x in (w.data[p:q].tobytes() for p, q in zip(w.starts[a:b], w.ends[a:b], strict=True))])
            out |= {"n_dup_lines": dup, "n_repeat_words": rep, "upper": upper, "long_words": long_words}
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in batch.schema.names if c != drop), *(pa.array(x, pa.int64()) for x in out.values())], names=[*(c for c in batch.schema.names if c != drop), *out])


def statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """docs without text, if it isn't to be kept, and the counts of each text. docs: doc_id, lang, source, text and more."""
    rest = [c for c in docs.columns if keep_text or c != "text"]
    kinds = dict(docs.dtypes)
    columns = [f"`{c}` {kinds[c]}" for c in rest] + [f"{n} long" for n in COUNTS]
    return text_batches(docs.select(*rest, *(() if keep_text else ("text",)))).mapInArrow(partial(_statistics, drop="" if keep_text else "text"), ", ".join(columns))


def vector(c: Column | None = None) -> list[Column]:
    """The transformed statistics in fixed point, from columns named as in statistics()."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    parts = {
        "log_words": F.log1p("n_words"),
        "word_length": F.log1p(F.col("word_chars") / words) * 4,
        "symbols": F.log1p(4 * F.col("n_symbols") / chars),
        "dup_lines": F.log1p(8 * F.col("n_dup_lines") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
        "upper": F.sqrt(F.col("upper") / chars),
        "long_words": F.sqrt(F.col("long_words") / words),
    }
    return [F.floor(parts[f] * UNIT + 0.5).cast("long").alias(f"x{i}") for i, f in enumerate(FEATURES)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(P) for j in range(i, P)]


def _distance() -> Column:
    """Squared Mahalanobis distance from columns x*, c* (centre) and m*_* (inverse covariance)."""
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(P)]
    return sum((d[i] * d[j] * F.col(f"m{i}_{j}") * (1 if i == j else 2) for i, j in _pairs()), F.lit(0.0))


_KEYS = ["lang", "source"]
_SHAPE = [*(f"c{i}" for i in range(P)), *(f"m{i}_{j}" for i, j in _pairs())]
_ESTIMATE = f"lang string, source string, start string, {', '.join(f'{n} double' for n in _SHAPE)}, logdet double, fell boolean, floored int"


def _estimate(key: tuple, start: str, centre: np.ndarray, cov: np.ndarray, was: float) -> list:
    """A row of _ESTIMATE."""
    floor = (np.array(list(FEATURES.values())) * UNIT) ** 2
    low = np.diag(cov) < floor
    cov = cov + np.diag(np.maximum(floor - np.diag(cov), 0) + 1.0)
    inverse, logdet = np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])
    return [*key, start, *centre, *(inverse[i, j] for i, j in _pairs()), logdet, was - logdet > FALL, int(low.sum())]


def _moments(n: float, sums: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    centre = np.array([sums[f"s{i}"] / n for i in range(P)])
    cov = np.zeros((P, P))
    for i, j in _pairs():
        cov[i, j] = cov[j, i] = sums[f"q{i}_{j}"] / n - centre[i] * centre[j]
    return centre, cov


def _concentrated(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """The estimates of a group after a step, from the sums of its buckets for each start."""
    rows, names = [], [*(f"s{i}" for i in range(P)), *(f"q{i}_{j}" for i, j in _pairs())]
    for start, f in cells.groupby("start"):
        f = f.sort_values("bucket")
        n = [int(x) for x in f["n"]]
        wanted, seen, sums = SHARE * sum(n), 0.0, dict.fromkeys(names, 0)
        for k, (_, r) in zip(n, f.iterrows(), strict=True):
            take = min(1.0, (wanted - seen) / k)
            for c in names:
                sums[c] += int(r[c]) if take == 1 else take * int(r[c])
            seen += take * k
            if take < 1 or seen >= wanted:
                break
        centre, cov = _moments(seen, sums)
        rows.append(_estimate(key, start, centre, cov * consistency(SHARE), float(f["was"].iloc[0])))
    return pd.DataFrame(rows, columns=_columns())


def _columns() -> list[str]:
    return [*_KEYS, "start", *_SHAPE, "logdet", "fell", "floored"]


def _started(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The three starts of each group, from medians c*, spreads w* and the sums t*_* and u*_*."""
    for f in frames:
        rows = []
        for r in f.to_dict("records"):
            key, centre, w = (r["lang"], r["source"]), np.array([r[f"c{i}"] for i in range(P)]), np.array([r[f"w{i}"] for i in range(P)])
            shapes = [np.eye(P)]
            for kind in "tu":
                m = np.zeros((P, P))
                for i, j in _pairs():
                    m[i, j] = m[j, i] = float(r[f"{kind}{i}_{j}"])
                spread = np.sqrt(np.maximum(np.diag(m), 1e-9))
                m = m / np.outer(spread, spread)
                np.fill_diagonal(m, 1.0)
                shapes.append(0.99 * m + 0.01 * np.eye(P))
            rows += [_estimate(key, name, centre, shape * np.outer(w, w), math.inf) for name, shape in zip(STARTS, shapes, strict=True)]
        yield pd.DataFrame(rows, columns=_columns())


def _reweighted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for r in f.to_dict("records"):
            centre, cov = _moments(float(r["n"]), {c: float(x) for c, x in r.items() if c[0] in "sq" and c not in _KEYS})
            rows.append(_estimate((r["lang"], r["source"]), "final", centre, cov * consistency(REWEIGHT), math.inf))
        yield pd.DataFrame(rows, columns=_columns())


def _sums() -> list[Column]:
    """Sums over vectors that n rows have."""
    one = [F.sum(F.col("n") * F.col(f"x{i}")).alias(f"s{i}") for i in range(P)]
    two = [F.sum(F.col("n") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _pairs()]
    return [F.sum("n").alias("n"), *one, *two]


def _with(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """Each point with its group's estimate; the small table's size, known from its files, decides on a broadcast."""
    e = estimates.withColumnRenamed("lang", "e_lang").withColumnRenamed("source", "e_source")
    return points.join(e, F.col("g_lang").eqNullSafe(F.col("e_lang")) & F.col("g_source").eqNullSafe(F.col("e_source")), "left").drop("e_lang", "e_source")


def groups(points: DataFrame) -> DataFrame:
    """t_lang, t_source, and g_lang, g_source: the group whose estimate documents of that language and source are held against.

    What counts is how many documents pass the base rules, which are those that an estimate is made of.
    """
    sizes = points.groupBy("lang", "source").agg(F.count_if(~base_failed()).alias("n"))
    small = F.lit("\x00small")
    by_lang = sizes.filter(F.col("n") < MIN_GROUP).groupBy("lang").agg(F.sum("n").alias("m"))
    to = sizes.join(by_lang.withColumnRenamed("lang", "b_lang"), F.col("lang").eqNullSafe(F.col("b_lang")), "left")
    alone, pooled = F.col("n") >= MIN_GROUP, F.coalesce(F.col("m") >= MIN_GROUP, F.lit(False))
    return materialize(to.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.when(alone | pooled, F.col("lang")).otherwise(small).alias("g_lang"), F.when(alone, F.col("source")).otherwise(small).alias("g_source")), "groups")


def _in_groups(points: DataFrame, to: DataFrame) -> DataFrame:
    return points.join(to, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source"))).drop("t_lang", "t_source")


def fit(points: DataFrame) -> DataFrame:
    """The MCD estimate of each group of points (g_lang, g_source, x*)."""
    of = [F.col("g_lang").alias("lang"), F.col("g_source").alias("source")]
    cloud = materialize(points.groupBy("g_lang", "g_source", *(f"x{i}" for i in range(P))).agg(F.count("*").alias("n")), "cloud")
    quarters = cloud.groupBy("g_lang", "g_source").agg(*(F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n")).alias(f"p{i}") for i in range(P)))
    spread = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(f * UNIT)) for i, f in enumerate(FEATURES.values())]
    middle = materialize(quarters.select(*of, *(F.col(f"p{i}")[1].alias(f"c{i}") for i in range(P)), *(w.alias(f"w{i}") for i, w in enumerate(spread))), "middle")

    # integers again: a thousandth of a tangent or of a sign
    z = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"w{i}") for i in range(P)]
    x = _with(cloud, middle).withColumns({f"z{i}": z[i] for i in range(P)})
    x = x.withColumn("far", F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-9))))
    x = x.withColumns({f"{k}{i}": F.round(1000 * v).cast("long") for i in range(P) for k, v in (("t", F.tanh(f"z{i}")), ("u", F.col(f"z{i}") / F.col("far")))})
    moments = x.groupBy("g_lang", "g_source").agg(*(F.sum(F.col("n") * F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}_{j}") for k in "tu" for i, j in _pairs()))
    estimates = materialize(_with(moments, middle).select(*of, *(f"{k}{i}" for k in "cw" for i in range(P)), *(f"{k}{i}_{j}" for k in "tu" for i, j in _pairs())).mapInPandas(_started, _ESTIMATE), "start")

    def near(estimates: DataFrame) -> DataFrame:
        return _with(cloud, estimates).withColumn("distance", _distance())

    for _ in range(STEPS):
        bucket = F.floor(F.log2(1 + F.col("distance")) * 16).alias("bucket")
        cells = near(estimates).groupBy(*of, "start", bucket).agg(F.first("logdet").alias("was"), *_sums())
        estimates = materialize(cells.groupBy("lang", "source").applyInPandas(_concentrated, _ESTIMATE), "mcd")
        if estimates.filter("fell").isEmpty():
            break
    best = estimates.groupBy("lang", "source").agg(F.min(F.struct("logdet", "start", *_SHAPE)).alias("e")).select("lang", "source", "e.*")
    sums = near(best).filter(F.col("distance") <= quantile(REWEIGHT, P)).groupBy(*of).agg(*_sums())
    return materialize(sums.mapInPandas(_reweighted, _ESTIMATE).drop("start", "logdet", "fell"), "final")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _points(docs: DataFrame, keep_text: bool) -> DataFrame:
    docs = docs.withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})
    return statistics(docs, keep_text).select("*", *vector())


def _judged(points: DataFrame, estimates: DataFrame) -> DataFrame:
    """points with base_failed, distance (squared; 0 where there is no estimate) and kept."""
    x = _with(points, estimates).withColumns({"distance": F.round(F.coalesce(_distance(), F.lit(0.0)), 6), "base_failed": base_failed()})
    return x.withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= LIMIT))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance and kept of each row of docs (doc_id, text, lang, source)."""
    points = materialize(_points(docs.select("doc_id", "lang", "source", "text"), False), "statistics")
    points = _in_groups(points, groups(points))
    return _judged(points, fit(points.filter(~base_failed()))).select("doc_id", *BASE, "base_failed", "distance", "kept", F.coalesce("floored", F.lit(0)).alias("floored"))


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, with their columns, whatever these are called; texts are read twice but not shuffled."""
    points = materialize(_points(docs.select("doc_id", "lang", "source", "text"), False), "statistics")
    to = groups(points)
    estimates = fit(_in_groups(points.filter(~base_failed()), to))
    rest = [c for c in docs.columns if c not in ("doc_id", "lang", "source", "text")]
    carried = docs.select("doc_id", "lang", "source", "text", F.struct(*rest, F.lit(None).cast("int").alias("_none")).alias("carried"))
    x = _judged(_in_groups(_points(carried, True), to), estimates).filter("kept")
    return x.select("doc_id", "lang", "source", "text", "carried.*").select(docs.columns)
