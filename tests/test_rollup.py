"""Kept rollups against plain counting: late and repeated events, days that are final, sums and percentiles of spans."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from paceline.functions.clock import DAY_MS
from paceline.operators import product, rollup

STEPS = ["opened", "granted", "synced"]
ACCESS = "uid string, provider string, ok boolean, at long, ms long"
EVENTS = "id long, name string, at long, app_version string, outcome string, duration_ms long"
USERS = "uid string, deleting boolean, opened long, granted long, synced long, activated long, provider string, app_version string"
NOW = 19_800 * DAY_MS + 12_345


def world(rng, days=80):
    at = lambda: NOW - rng.randrange(days * DAY_MS)
    access = [(f"u{rng.randrange(9)}", rng.choice(["a", "b", None]), rng.random() < 0.8, at(), rng.choice([None, -5, rng.randrange(9000)])) for _ in range(400)]
    events = [(k, rng.choice(["sync_finished", "sync_finished", "app_opened"]), at(), rng.choice([None, "1.0", "1.1"]), rng.choice(["success", "failure", None]), rng.choice([None, rng.randrange(70_000)])) for k in range(300)]
    users = []
    for k in range(60):
        t = at()
        users.append((f"u{k}", rng.choice([None, None, None, True]), rng.choice([t, t, None]), rng.choice([t + 5, None]), rng.choice([t + 9, None]), rng.choice([t + 10, None]), rng.choice([None, "a", "b"]), rng.choice([None, "1.0"])))
    return users, access, events


def plain(users, access, events, first_day, last_day):
    out = {}
    def add(day, kind, key, **counts):
        c, b = out.setdefault((day, kind, key), ({}, [0] * len(product.BUCKETS_MS)))
        for k, v in counts.items():
            c[k] = c.get(k, 0) + v
        return b
    put = lambda b, ms: b.__setitem__(i := next((i for i, x in enumerate(product.BUCKETS_MS) if ms <= x), len(b) - 1), b[i] + 1)
    active = {}
    for uid, provider, ok, at, ms in access:
        day = at // DAY_MS
        if first_day <= day <= last_day:
            for kind, key in (("usage", ""), ("provider", provider or "unknown")):
                b = add(day, kind, key, calls=1, successes=int(ok), failures=int(not ok), duration_count=int(ms is not None and ms >= 0), duration_ms=ms if ms is not None and ms >= 0 else 0, active=0)
                if ms is not None and ms >= 0:
                    put(b, ms)
                if ok:
                    active.setdefault((day, kind, key), set()).add(uid)
    for k, ids in active.items():
        out[k][0]["active"] = len(ids)
    for _, name, at, version, outcome, ms in {e[0]: e for e in events}.values():
        if name == "sync_finished" and first_day <= at // DAY_MS <= last_day:
            for kind, key in (("sync", ""), ("version", version)):
                if key is not None:
                    b = add(at // DAY_MS, kind, key, attempts=1, successes=int(outcome == "success"), failures=int(outcome != "success"), duration_count=int(ms is not None), duration_ms=ms or 0)
                    if ms is not None:
                        put(b, ms)
    for uid, deleting, *reached, activated, provider, version in users:
        if deleting:
            continue
        if reached[0] is not None and first_day <= reached[0] // DAY_MS <= last_day:
            for kind, key in (("cohort", ""), ("cohort_provider", provider), ("cohort_version", version)):
                if key is not None:
                    add(reached[0] // DAY_MS, kind, key, **{s: int(r is not None) for s, r in zip(STEPS, reached, strict=True)})
        if activated is not None and first_day <= activated // DAY_MS <= last_day:
            hits = [at for u, _, ok, at, _ in access if u == uid and ok]
            week = lambda a, b: any(activated + a * DAY_MS <= t < activated + b * DAY_MS for t in hits)
            w1, w4 = activated + 14 * DAY_MS <= NOW, activated + 35 * DAY_MS <= NOW
            add(activated // DAY_MS, "retention", "", activated=1, w1_eligible=int(w1), w1_retained=int(w1 and week(7, 14)), w4_eligible=int(w4), w4_retained=int(w4 and week(28, 35)))
    for day in range(first_day, last_day + 1):
        for kind in ("usage", "sync", "cohort", "retention"):
            add(day, kind, "")
    return {(date(1970, 1, 1) + timedelta(d), kind, key): v for (d, kind, key), v in out.items()}


def rows(df):
    return {(r.day, r.kind, r.key): (dict(r.counts), list(r.buckets)) for r in df.collect()}


def test_rollups_are_kept_up_to_date(spark, tmp_path):
    rng, path = random.Random(6), str(tmp_path / "rollup")
    users, access, events = world(rng)
    make = lambda u, a, e: (spark.createDataFrame(u, USERS), spark.createDataFrame(a, ACCESS), spark.createDataFrame(e, EVENTS))
    today = NOW // DAY_MS
    # a first run over everything, without what comes late; then the usual one
    early = [x for x in access if x[3] % 3], [e for e in events if e[0] % 4]
    rollup.rebuild(*make(users, *early), STEPS, path, NOW, days=80)
    before = rows(rollup.stored(spark, path))
    assert before == plain(users, *early, today - 79, today)
    rollup.rebuild(*make(users, access, events + rng.sample(events, 40)), STEPS, path, NOW)
    after = rows(rollup.stored(spark, path))
    full = plain(users, access, events, today - 79, today)
    start = date(1970, 1, 1) + timedelta(today - 39)
    assert {k: v for k, v in after.items() if k[0] >= start} == {k: v for k, v in full.items() if k[0] >= start}
    assert {k: v for k, v in after.items() if k[0] < start} == {k: v for k, v in before.items() if k[0] < start} != {k: v for k, v in full.items() if k[0] < start}
    # the same run again changes nothing
    rollup.rebuild(*make(users, access, events), STEPS, path, NOW)
    assert rows(rollup.stored(spark, path)) == after
    # spans add up, and their percentile is that of all durations
    total = rollup.spans(rollup.stored(spark, path).filter(F.col("day") >= start), "sync").select("*", rollup.percentile(F.col("buckets"), 0.95).alias("p95")).first()
    ms = sorted(e[5] for e in events if e[1] == "sync_finished" and e[5] is not None and today - 39 <= e[2] // DAY_MS <= today)
    reached = ms[-(-len(ms) * 95 // 100) - 1]
    assert total.p95 == next(b for b in product.BUCKETS_MS if reached <= b) and total.days == 40
    assert total.counts["duration_ms"] == sum(ms) and total.counts["duration_count"] == len(ms) == sum(total.buckets)


def test_an_empty_world_is_rolled_up(spark, tmp_path):
    empty = [spark.createDataFrame([], s) for s in (USERS, ACCESS, EVENTS)]
    rollup.rebuild(*empty, STEPS, str(tmp_path / "r"), NOW, days=2)
    got = rows(rollup.stored(spark, str(tmp_path / "r")))
    assert len(got) == 8 and all(v == ({}, [0] * 12) for v in got.values())
    assert rollup.spans(rollup.stored(spark, str(tmp_path / "r")), "sync").select(rollup.percentile(F.col("buckets"), 0.5).alias("p")).first().p is None
