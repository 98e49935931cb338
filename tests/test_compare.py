"""Comparison of two multisets: against a plain version, copies by their counts, tolerance, nulls."""

import random
from collections import Counter
from itertools import combinations

from paceline.operators import compare

SCHEMA = "k int, x string, y int, v double"
FIELDS = ("x", "y", "v")


def order(r):
    return tuple((c is not None, c) for c in r)


def same(p, q, tolerance):
    return p == q or (p is not None and q is not None and abs(p - q) <= tolerance)


def plain(a, b, tolerance, most):
    """What matched() says of one key's rows, by loops."""
    na, nb = Counter(a), Counter(b)
    left, right = list((na - nb).elements()), list((nb - na).elements())
    values, chain, number = sorted({r[2] for r in left + right if r[2] is not None}), {None: -1}, 0
    for i, v in enumerate(values):
        number += i > 0 and v - values[i - 1] > tolerance
        chain[v] = number
    out = []
    sets = [s for n in range(most + 1) for s in combinations(range(3), n)] + [(0, 1, 2)]
    for s in sets:
        groups = {}
        for side, rows in enumerate((left, right)):
            for r in rows:
                groups.setdefault(tuple((chain[r[2]] if i == 2 else r[i]) for i in range(3) if i not in s), ([], []))[side].append(r)
        for p, q in groups.values():
            for r, t in zip(sorted(p, key=order), sorted(q, key=order), strict=False):
                changed = tuple(i for i in range(3) if not (same(r[i], t[i], tolerance) if i == 2 else r[i] == t[i]))
                if set(changed) <= set(s):
                    left.remove(r)
                    right.remove(t)
                    out.append((r, t, tuple(FIELDS[i] for i in changed)))
    return Counter(out + [(r, None, ()) for r in left] + [(None, r, ()) for r in right])


def rows_of(found):
    out = {}
    for r in found.collect():
        key = (tuple(r.before) if r.before else None, tuple(r.after) if r.after else None, tuple(r.changed))
        out.setdefault(r.k, Counter())[key] += r.n
    return out


def test_matches_equal_the_plain_version(spark):
    rng = random.Random(5)
    row = lambda: (rng.choice("pq") if rng.random() < 0.9 else None, rng.randrange(3), rng.choice([None, 1.0, 1.05, 1.3, 2.0, 2.1, 2.2]))
    cases = {k: ([row() for _ in range(rng.randrange(7))], [row() for _ in range(rng.randrange(7))]) for k in range(60)}
    frame = lambda side: spark.createDataFrame([(k, *r) for k, c in cases.items() for r in c[side]], SCHEMA)
    for most in (1, 2):
        got = rows_of(compare.matched(frame(0), frame(1), ["k"], 0.1, most))
        want = {k: plain(a, b, 0.1, most) for k, (a, b) in cases.items()}
        assert got == {k: w for k, w in want.items() if w}


def test_copies_stay_counts_and_changes_are_reported(spark):
    a = spark.createDataFrame([(1, "p", 1, 1.0)] * 1000 + [(1, "q", 2, 5.0)] * 3 + [(2, "p", 1, None)], SCHEMA)
    b = spark.createDataFrame([(1, "p", 1, 1.0)] * 400 + [(1, "p", 1, 1.0 + 1e-12)] * 100 + [(1, "p", 9, 1.0)] * 450 + [(1, "q", 2, 5.0)] * 3 + [(3, "z", 0, 0.0)], SCHEMA).selectExpr("*", "'x' AS more")
    found = compare.matched(a, b, ["k"])
    assert found.count() == 5  # within tolerance, changed, missing of 1 and 2, added of 3: rows don't grow with copies
    assert [tuple(r) for r in compare.field_changes(found, ["k"]).collect()] == [(1, "y", "1", "9", 450)]
    v = compare.verdict(found).first()
    assert (v.equivalent, v.within, v.changed, v.missing, v.added) == (False, 100, 450, 51, 1) and v.widest < 1e-11


def test_equal_tables_and_empty_tables(spark):
    a, none = spark.createDataFrame([(1, None, None, float("nan")), (None, "p", 1, -0.0)], SCHEMA), spark.createDataFrame([], SCHEMA)
    for x, y, want in ((a, a, (True, 0, 0, 0, 0)), (none, none, (True, 0, 0, 0, 0)), (a, none, (False, 0, 0, 2, 0)), (none, a, (False, 0, 0, 0, 2))):
        v = compare.verdict(compare.matched(x, y, ["k"])).first()
        assert tuple(v)[:5] == want
