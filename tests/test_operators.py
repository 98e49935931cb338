"""Operators on small inputs with numbers worked out by hand, and against plain sequential twins."""

import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from paceline.functions import clock, numbers, physics
from paceline.operators import asof, codec, daily, dedup, device, folds, intervals, series


def one(df):
    return df.first()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_half_up_goes_towards_positive_infinity(spark):
    got = [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (None,), (float("nan"),), (1.25,)], "x double").select(numbers.half_up(F.col("x"))).collect()]
    assert got == [3.0, -2.0, None, None, 1.0]
    assert value(spark, numbers.half_up(F.lit(1.25), 1)) == 1.3


def test_text_of_durations_and_goals(spark):
    assert value(spark, numbers.hms(F.lit(3723.4))) == "1:02:03"
    assert value(spark, numbers.pace(F.lit(299.6))) == "5:00"
    assert value(spark, numbers.goal_seconds(F.lit("3:46:40"))) == 13600
    assert value(spark, numbers.goal_seconds(F.lit("0:05:00"))) is None
    assert value(spark, numbers.goal_seconds(F.lit("soon"))) is None


def test_normal_cdf(spark):
    for x in (-3.0, -0.5, 0.0, 0.7, 2.5):
        assert value(spark, numbers.normal_cdf(F.lit(x))) == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), abs=2e-7)


def test_haversine_of_a_thousandth_of_a_degree(spark):
    assert value(spark, physics.haversine(F.lit(50.0), F.lit(8.0), F.lit(50.001), F.lit(8.0))) == pytest.approx(111.195, abs=0.01)


def test_weather_and_zones(spark):
    assert value(spark, physics.celsius(F.lit("75 degF"))) == pytest.approx(23.888888)
    assert value(spark, physics.dew_point(F.lit(20.0), F.lit(50.0))) == pytest.approx(9.26, abs=0.05)
    assert value(spark, physics.heat_index(F.lit(20.0), F.lit(50.0))) is None
    assert physics.zone_bounds(max_hr=190) == [114.0, 133.0, 152.0, 171.0]
    with pytest.raises(ValueError):
        physics.zone_bounds(custom=[1, 2, 2, 3])


def test_clock(spark):
    ms = 1719878400000  # 2024-07-02 00:00 UTC
    assert value(spark, clock.local_day(F.lit(ms))) == date(2024, 7, 2)
    assert value(spark, clock.local_day(F.lit(ms - 1), "Europe/Berlin")) == date(2024, 7, 2)
    assert value(spark, clock.local_hour(F.lit(ms), "America/New_York")) == 20
    a, b = clock.local_range(F.lit("2024-07-02").cast("date"), F.lit("2024-07-02").cast("date"), "Europe/Berlin")
    assert value(spark, b - a) == 86_400_000 and value(spark, a) == ms - 7_200_000
    assert value(spark, clock.valid_day(F.lit("2024-02-30"))) is False
    with pytest.raises(ValueError):
        clock.zone("+02:00")
    assert value(spark, clock.months_overlapping(F.lit(ms - 86_400_000 * 40), F.lit(ms))) == ["2024-05", "2024-06", "2024-07"]


def merged_twin(spans):
    out = []
    for s, e in sorted(x for x in spans if x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_merge_is_the_union_of_intervals(spark):
    rng = random.Random(4)
    data = [(k, a, a + rng.randrange(-2, 9)) for k in range(20) for a in (rng.randrange(60) for _ in range(12))]
    got = {(r.k, r.s, r.e) for r in intervals.merge(spark.createDataFrame(data, "k long, s long, e long"), ["k"]).collect()}
    want = {(k, s, e) for k in range(20) for s, e in merged_twin([(a, b) for x, a, b in data if x == k])}
    assert got == want


def pauses_twin(events, end):
    open_, out = {1: None, 5: None}, []
    for t, kind in sorted(events):
        if kind in open_:
            open_[kind] = t if open_[kind] is None else open_[kind]
        elif open_[kind - 1] is not None:
            out.append((open_[kind - 1], t))
            open_[kind - 1] = None
    return merged_twin(out + [(t, end) for t in open_.values() if t is not None])


def test_pauses_match_a_state_machine(spark):
    rng = random.Random(5)
    data = [(k, t, rng.choice([1, 2, 5, 6])) for k in range(40) for t in rng.sample(range(100), 9)]
    df = spark.createDataFrame(data, "k long, t long, type int")
    got = {(r.k, r.s, r.e) for r in intervals.pauses(df, ["k"], spark.range(40).select(F.col("id").alias("k"), F.lit(120).cast("long").alias("end"))).collect()}
    want = {(k, s, e) for k in range(40) for s, e in pauses_twin([(t, y) for x, t, y in data if x == k], 120)}
    assert got == want


def test_streaks_episodes_and_gaps(spark):
    df = spark.createDataFrame([(1, t, t % 4 != 3) for t in range(11)], "k int, t long, ok boolean")
    assert one(intervals.longest_run(df, ["k"], ["t"], F.col("ok"))).longest == 3
    assert intervals.stretches(df, ["k"], ["t"], F.col("ok"), 4).count() == 0
    e = intervals.episodes(spark.createDataFrame([(1, 0, 50), (1, 10, 20), (1, 52, 60), (1, 75, 80)], "k int, s long, e long"), ["k"], "s", "e", 10)
    assert [r.episode for r in e.orderBy("s").collect()] == [1, 1, 1, 2]
    days = spark.createDataFrame([(1, date(2024, 1, 3)), (1, date(2024, 1, 9))], "k int, day date")
    assert one(intervals.longest_gap(days, ["k"], F.lit("2024-01-01").cast("date"), F.lit("2024-01-20").cast("date"))).gap == 11


def at_twin(points, x):
    points = sorted(points)
    for i, (px, py) in enumerate(points):
        if px >= x:
            if px == x:
                return min(y for a, y in points if a == x)
            if i == 0:
                return None
            x0, y0 = points[i - 1]
            return y0 + (x - x0) / (px - x0) * (py - y0)
    return None


def test_interpolation_matches_a_scan(spark):
    rng = random.Random(6)
    points, probes = [], []
    for k in range(15):
        d = t = 0
        for _ in range(12):
            points.append((k, float(d), float(t)))
            d += rng.choice([0, 1, 3, 7])
            t += rng.randrange(1, 9)
        probes += [(k, float(p)) for p in {rng.randrange(-2, 45) for _ in range(9)}]
    got = asof.at(spark.createDataFrame(points, "k long, d double, t double"), spark.createDataFrame(probes, "k long, d double"), ["k"], "d", "t", "y").collect()
    assert len(got) == len(probes)
    for r in got:
        want = at_twin([(d, t) for k, d, t in points if k == r.k], r.d)
        assert (r.y is None) == (want is None) and (want is None or r.y == pytest.approx(want)), r


def test_splits_and_best_effort_of_an_even_run_with_a_pause(spark):
    """3 km at 300 s/km with a pause of 60 s after 1.5 km."""
    rows, t = [], 0
    for i in range(1, 31):
        t += 30_000
        if i == 16:
            t += 60_000
        rows.append((1, t, 100.0))
    dist = series.distance_from_increments(spark.createDataFrame(rows, "k int, t long, v double"), ["k"], spark.createDataFrame([(1, 0)], "k int, start long"))
    stops = spark.createDataFrame([(1, 450_000, 510_000)], "k int, s long, e long")
    x = series.moving(series.splits(dist, ["k"], 1000.0), ["k"], stops).orderBy("split").collect()
    assert [(r.split, r.moving_ms) for r in x] == [(1, 300_000), (2, 300_000), (3, 300_000)]
    best = one(series.best_effort(dist, ["k"], 1000.0, stops))
    assert best.seconds == 300 and best.start == 0


def test_weights_stop_at_the_next_reading_the_cap_and_pauses(spark):
    df = spark.createDataFrame([(1, 0, 100.0), (1, 10_000, None), (1, 20_000, 120.0), (1, 90_000, 130.0)], "k int, t long, v double").withColumn("end", F.lit(100_000).cast("long"))
    stops = spark.createDataFrame([(1, 25_000, 30_000)], "k int, s long, e long")
    got = {r.t: r.w for r in series.weights(df, ["k"], pauses=stops, end="end").collect()}
    assert got == {0: 20.0, 20_000: 25.0, 90_000: 10.0}


def climb_twin(vs, threshold=2.0):
    ref, gain, loss = vs[0], 0.0, 0.0
    for v in vs[1:]:
        if v - ref >= threshold:
            gain, ref = gain + v - ref, v
        elif ref - v >= threshold:
            loss, ref = loss + ref - v, v
    return gain, loss


def test_folds_match_their_twins(spark):
    rng = random.Random(8)
    data = [(k, t, rng.uniform(0, 12)) for k in range(25) for t in range(15)]
    df = spark.createDataFrame(data, "k long, t long, v double")
    for r in folds.climb(df, ["k"]).collect():
        assert (r.gain, r.loss) == pytest.approx(climb_twin([v for k, _, v in data if k == r.k]))
    times = sorted({rng.randrange(200) for _ in range(60)})
    kept = [times[0]]
    for t in times[1:]:
        if t - kept[-1] >= 7:
            kept.append(t)
    got = sorted(r.t for r in folds.spaced(spark.createDataFrame([(1, t) for t in times], "k int, t long"), ["k"], 7).collect())
    assert got == sorted({*kept, times[-1]})


def test_grades_begin_where_the_last_ended(spark):
    pts = [(1, 0.0, 0.0), (1, 60.0, 9.0), (1, 120.0, 6.0), (1, 240.0, 6.0), (1, 350.0, 0.0)]
    r = one(folds.grades(spark.createDataFrame(pts, "k int, d double, a double"), ["k"]))
    assert (r.up, r.level, r.down) == (120.0, 120.0, 110.0)
    assert r.steepest == pytest.approx(5.0) and r.lowest == pytest.approx(-600 / 110)


def test_duplicate_runs_share_a_chain(spark):
    runs = [(1, 1, 0, 100), (1, 2, 40, 130), (1, 3, 120, 300), (1, 4, 500, 600)]
    got = {r.id: r.chain for r in folds.duplicate_chains(spark.createDataFrame(runs, "k int, id long, s long, e long"), ["k"]).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3


def test_smoothed_load_fills_days(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), 70.0), (1, date(2024, 1, 3), 70.0)], "k int, day date, load double")
    rows = folds.smoothed_load(df, ["k"]).orderBy("day").collect()
    assert [r.load for r in rows] == [70.0, 0.0, 70.0]
    assert rows[1].atl == pytest.approx(10 - 10 / 7)


def test_latest_wins_and_deletions(spark):
    rows = spark.createDataFrame([("u", "a", 1, 1.0), ("u", "a", 3, 3.0), ("u", "b#1", 2, 2.0), ("u", None, 1, 9.0)], "subject string, id string, seq long, v double")
    assert {r.v for r in dedup.latest(rows, ["subject", "id"], ["seq"]).collect()} == {3.0, 2.0, 9.0}
    gone = spark.createDataFrame([("u", "b")], "subject string, id string")
    assert {r.v for r in dedup.without_deleted(rows, gone, ["subject"], strip=True).collect()} == {1.0, 3.0, 9.0}
    maps = spark.createDataFrame([(1, 1, {"x": 1.0, "y": 1.0}), (1, 2, {"x": 2.0})], "k int, seq int, m map<string,double>")
    assert {(r.metric, r.value) for r in dedup.latest_metrics(maps, ["k"], ["seq"]).collect()} == {("x", 2.0), ("y", 1.0)}


def test_scales(spark):
    scale = codec.exact_divisor(spark.createDataFrame([(1, 0.25), (1, 3.0), (2, 1 / 3)], "k int, v double"), ["k"])
    assert {r.k: r.divisor for r in scale.collect()} == {1: 100, 2: None}


def test_baseline_labels(spark):
    days = [(1, date(2024, 1, 1 + i), 10.0 + i % 3) for i in range(20)] + [(1, date(2024, 1, 21), 30.0)]
    rows = daily.baselines(spark.createDataFrame(days, "k int, day date, value double"), ["k"]).orderBy("day").collect()
    assert rows[5].status == "not enough baseline" and rows[-1].status == "above baseline" and rows[-1].n == 20


def reading(s, start, end, value, source="app", watch=False, n=1):
    return (s, start, end, float(value), float(value), float(value), float(value), n, source, watch)


SCHEMA = "subject string, start long, end long, value double, low double, high double, last double, n int, source string, watch boolean"


def test_watch_wins_over_phone_and_apps(spark):
    own = device.OWN
    data = [
        reading("u", 0, 300_000, 50, own + ".w", True), reading("u", 0, 300_000, 70, own + ".p"), reading("u", 0, 300_000, 90, "other"),
        reading("u", 1_200_000, 1_500_000, 40, own + ".p"), reading("u", 7_200_000, 7_500_000, 33, "other"),
    ]
    got = {r.slot: r.amount for r in device.cumulative(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == {0: 50.0, 1_200_000: 40.0, 7_200_000: 33.0}


def test_time_weighted_mean_of_one_long_and_one_short_reading(spark):
    data = [reading("u", 600_000, 1_200_000, 60), reading("u", 2_000_000, 2_000_000, 120)]
    r = one(device.time_weighted(spark.createDataFrame(data, SCHEMA)))
    assert r["mean"] == pytest.approx((60 * 645 + 120 * 45) / 690)


def test_sleep_night(spark):
    h = 3_600_000
    seg = lambda a, b, v, src: ("u", int(a * h), int(b * h), v, src)
    data = [seg(22, 23, 0, "p"), seg(22.5, 24, 3, "w"), seg(24, 26, 4, "w"), seg(26, 26.5, 2, "w"), seg(26.5, 29, 5, "w"), seg(22, 30, 1, "p"), seg(38, 39, 3, "w")]
    rows = {str(r.night): r for r in device.sleep_nights(spark.createDataFrame(data, "subject string, start long, end long, value int, source string")).collect()}
    r = rows["1970-01-02"]
    assert (r.core, r.deep, r.rem, r.awake, r.asleep) == (150.0, 120.0, 150.0, 30.0, 420.0)
    assert (r.bed, r.wake, r.in_bed) == ("22:00", "05:00", 60.0)


def test_empty_tables_give_empty_results(spark):
    empty = spark.createDataFrame([], "k int, t long, v double, s long, e long, day date, load double, value double")
    for df in (intervals.merge(empty, ["k"]), series.downsample(empty, ["k"], 5), folds.climb(empty, ["k"]), folds.smoothed_load(empty, ["k"]), daily.baselines(empty, ["k"]), series.best_effort(empty.withColumn("d", F.col("v")), ["k"], 5.0)):
        assert df.count() == 0
