"""Queries over the driver's tables: operators of this library applied to events and orders, each with its SQL twin.

events stands for sensor readings (subject: user_id, t: milliseconds of ts, v: value); being sparse, it gets wider time
constants than sensors do. The SQL is for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paceline.functions import physics
from paceline.functions.clock import local_day, monday, wall_ms
from paceline.functions.numbers import half_up, hms, normal_cdf, pace, tidy
from paceline.operators import asof, codec, compact, daily, dedup, device, folds, intervals, product, selection, series

HOUR, DAY = 3_600_000, 86_400_000
QUERIES: dict = {}
ORACLES: dict = {}

#: Readings as SQL.
R = "r AS (SELECT user_id AS subject, epoch_us(ts) // 1000 AS t, value AS v, event_id AS id, event_type AS kind, CAST(ts AS DATE) AS day FROM events)"


def up(x: str, digits: int = 0) -> str:
    """half_up() as SQL."""
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def query(sql: str):
    """Register a query with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return keep


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, t, v, id, kind, day."""
    e = load(spark, sf_dir, "events")
    x = e.select(F.col("user_id").alias("subject"), wall_ms(F.col("ts")).alias("t"), F.col("value").alias("v"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"))
    return x.withColumn("day", local_day(F.col("t")))


def cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def day_totals(r: DataFrame) -> DataFrame:
    """subject, day, value: exact sums in hundredths."""
    return r.groupBy("subject", "day").agg((F.sum(cents(F.col("v"))) / 100.0).alias("value"))


DAYS = "d AS (SELECT subject, day, sum(CAST(floor(v * 100 + 0.5) AS BIGINT)) / 100.0 AS value FROM r GROUP BY subject, day)"
ZONES = [50.0, 100.0, 150.0, 200.0]


@query(f"""WITH {R},
l AS (SELECT subject, v, least(coalesce(lead(t) OVER (PARTITION BY subject ORDER BY t), t), t + 21600000) - t AS w FROM r),
z AS (SELECT subject, 1 + (v >= 50)::INT + (v >= 100)::INT + (v >= 150)::INT + (v >= 200)::INT AS zone, sum(w) AS ms FROM l WHERE w > 0 GROUP BY 1, 2)
SELECT subject, zone, {up("ms / 1000.0", 1)} AS seconds, {up("100.0 * ms / sum(ms) OVER (PARTITION BY subject)", 1)} AS percent FROM z""")
def time_in_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = series.weights(readings(spark, sf_dir), ["subject"], cap_ms=6 * HOUR).withColumn("w", F.round(F.col("w") * 1000).cast("long"))
    x = w.withColumn("zone", physics.in_zone(F.col("v"), ZONES)).groupBy("subject", "zone").agg(F.sum("w").alias("ms"))
    share = 100.0 * F.col("ms") / F.sum("ms").over(Window.partitionBy("subject"))
    return x.select("subject", "zone", half_up(F.col("ms") / 1000.0, 1).alias("seconds"), half_up(share, 1).alias("percent"))


@query(f"WITH {R} SELECT subject, kind, day, id, v FROM r QUALIFY row_number() OVER (PARTITION BY subject, kind, day ORDER BY id DESC) = 1")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.latest(readings(spark, sf_dir), ["subject", "kind", "day"], ["id"]).select("subject", "kind", "day", "id", "v")


@query(f"WITH {R} SELECT subject, id, kind, v FROM r WHERE NOT EXISTS (SELECT 1 FROM r x WHERE x.kind = 'error' AND x.subject = r.subject AND x.day = r.day)")
def tombstone_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return dedup.without_deleted(r, r.filter("kind = 'error'"), ["subject"], "day").select("subject", "id", "kind", "v")


@query(f"""WITH {R}, h AS (SELECT subject, t // 3600000 AS hour, avg(CAST(floor(v * 100 + 0.5) AS BIGINT)) AS v, min(v) AS low, max(v) AS high FROM r GROUP BY 1, 2)
SELECT subject, CAST(make_timestamp(hour * 3600000000) AS DATE) AS day, {up("avg(v)", 3)} AS mean, min(low) AS low, max(high) AS high, count(*) AS hours FROM h GROUP BY 1, 2""")
def hourly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    h = r.groupBy("subject", F.floor(F.col("t") / HOUR).alias("hour")).agg(F.avg(cents(F.col("v"))).alias("v"), F.min("v").alias("v2"), F.max("v").alias("v3")).withColumn("s", F.col("hour") * HOUR)
    return daily.hourly_to_daily(h, ["subject"]).select("subject", "day", half_up(F.col("mean"), 3).alias("mean"), "low", "high", "hours")


def _kind_days(r: DataFrame) -> DataFrame:
    return r.groupBy("subject", "day", F.col("kind").alias("metric")).agg(F.max(cents(F.col("v"))).alias("value"))


def _periods(unit: str) -> str:
    return f"""WITH {R}, m AS (SELECT subject, day, kind AS metric, max(CAST(floor(v * 100 + 0.5) AS BIGINT)) AS value FROM r GROUP BY ALL)
SELECT subject, metric, CAST(date_trunc('{unit}', day) AS DATE) AS start, {up("sum(value)::DOUBLE / count(*)", 3)} AS mean, count(*) AS days FROM m GROUP BY 1, 2, 3"""


@query(_periods("week"))
def week_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily.period_means(_kind_days(readings(spark, sf_dir)), ["subject"], "week")
    return x.withColumn("mean", half_up(F.col("mean"), 3))


@query(_periods("month"))
def month_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily.period_means(_kind_days(readings(spark, sf_dir)), ["subject"], "month")
    return x.withColumn("mean", half_up(F.col("mean"), 3))


@query(f"WITH {R} SELECT subject, day, kind AS metric, arg_max(v, id) AS value FROM r GROUP BY 1, 2, 3")
def metric_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each upload is a map of metrics; of a day's uploads, the last one that has a metric gives it."""
    maps = readings(spark, sf_dir).select("subject", "day", F.col("id").alias("seq"), F.create_map("kind", "v").alias("m"))
    return dedup.latest_metrics(maps, ["subject", "day"], ["seq"])


@query(f"""WITH {R}, a AS (SELECT *, min(t) OVER (PARTITION BY subject) AS t0, max(t) OVER (PARTITION BY subject) AS t1 FROM r),
b AS (SELECT subject, v, CASE WHEN t1 > t0 THEN least(19, CAST(floor((t - t0) / ((t1 - t0) / 20.0::DOUBLE)) AS INT)) ELSE 0 END AS bucket FROM a)
SELECT subject, bucket, count(*) AS n, {up("avg(CAST(floor(v * 100 + 0.5) AS BIGINT)) / 100", 4)} AS mean, min(v) AS low, max(v) AS high FROM b GROUP BY 1, 2""")
def downsample_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    x = series.downsample(r.withColumn("v", cents(F.col("v"))), ["subject"], 20)
    return x.select("subject", "bucket", "n", half_up(F.col("mean") / 100, 4).alias("mean"), (F.col("low") / 100.0).alias("low"), (F.col("high") / 100.0).alias("high"))


@query(f"""WITH {R}, {DAYS},
w AS (SELECT subject, day, value, avg(value) OVER b AS mean, stddev_samp(value) OVER b AS sd, count(*) OVER b AS n FROM d
  WINDOW b AS (PARTITION BY subject ORDER BY day RANGE BETWEEN INTERVAL 14 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)),
z AS (SELECT *, (value - mean) / CASE WHEN sd > 0 THEN sd END AS z FROM w)
SELECT subject, day, value, {up("mean", 4)} AS mean, {up("sd", 4)} AS sd, n, {up("z", 2)} AS z,
  CASE WHEN z IS NULL OR n < 7 THEN 'not enough baseline' WHEN z <= -1 THEN 'below baseline' WHEN z >= 1 THEN 'above baseline' ELSE 'within baseline range' END AS status FROM z""")
def zscore_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily.baselines(day_totals(readings(spark, sf_dir)), ["subject"], days=14, enough=7)
    return x.select("subject", "day", "value", half_up(F.col("mean"), 4).alias("mean"), half_up(F.col("sd"), 4).alias("sd"), "n", "z", "status")


@query(f"""WITH RECURSIVE {R}, {DAYS},
s AS (SELECT subject, min(day) AS a, max(day) AS b FROM d GROUP BY subject),
f AS (SELECT s.subject, CAST(g.day AS DATE) AS day, coalesce(d.value, 0) AS load FROM s, LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON d.subject = s.subject AND d.day = CAST(g.day AS DATE)),
e AS (SELECT f.subject, f.day, f.load, f.load / 7.0::DOUBLE AS atl, f.load / 42.0::DOUBLE AS ctl FROM f JOIN s ON s.subject = f.subject AND f.day = s.a
  UNION ALL SELECT f.subject, f.day, f.load, e.atl + (f.load - e.atl) / 7, e.ctl + (f.load - e.ctl) / 42 FROM e JOIN f ON f.subject = e.subject AND f.day = e.day + 1)
SELECT subject, day, load, {up("atl", 4)} AS atl, {up("ctl", 4)} AS ctl, {up("ctl - atl", 4)} AS tsb, {up("ctl - lag(ctl, 7) OVER (PARTITION BY subject ORDER BY day)", 4)} AS ramp FROM e""")
def training_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = folds.smoothed_load(day_totals(readings(spark, sf_dir)).withColumnRenamed("value", "load"), ["subject"])
    x = x.withColumn("ramp", daily.ramp(x, ["subject"]))
    return x.select("subject", "day", "load", *(half_up(F.col(c), 4).alias(c) for c in ("atl", "ctl", "tsb", "ramp")))


@query(f"WITH {R}, {DAYS} SELECT subject, CAST(date_trunc('week', day) AS DATE) AS week, {up('sum(value)', 2)} AS value FROM d GROUP BY 1, 2")
def weekly_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.weekly_totals(day_totals(readings(spark, sf_dir)), ["subject"], "value").withColumn("value", half_up(F.col("value"), 2))


MERGED = """m AS (SELECT subject, t AS s, t + 7200000 AS e FROM r),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n),
u AS (SELECT subject, min(s) AS s, max(e) AS e FROM i GROUP BY subject, island)"""


@query(f"WITH {R}, {MERGED} SELECT subject, s, e FROM u")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.col("t").alias("s"), (F.col("t") + 2 * HOUR).alias("e"))
    return intervals.merge(x, ["subject"])


@query(f"WITH {R}, {MERGED} SELECT subject, sum(e - s) / 60000.0 AS minutes, max(e - s) >= 14400000 AS covered FROM u GROUP BY subject")
def union_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.col("t").alias("s"), (F.col("t") + 2 * HOUR).alias("e"))
    u = intervals.merge(x, ["subject"])
    return u.groupBy("subject").agg((F.sum(F.col("e") - F.col("s")) / 60000.0).alias("minutes"), (F.max(F.col("e") - F.col("s")) >= 4 * HOUR).alias("covered"))


@query(f"""WITH {R}, x AS (SELECT subject, t, CASE kind WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 5 ELSE 6 END AS type, max(t) OVER (PARTITION BY subject) AS fin FROM r WHERE kind <> 'error'),
o AS (SELECT *, type >= 5 AS family, type IN (1, 5) AS opens FROM x),
q AS (SELECT *, lag(opens) OVER (PARTITION BY subject, family ORDER BY t, type) AS before FROM o),
k AS (SELECT *, lead(t) OVER (PARTITION BY subject, family ORDER BY t, type) AS nxt FROM q WHERE (opens AND NOT coalesce(before, FALSE)) OR (NOT opens AND coalesce(before, FALSE))),
m AS (SELECT subject, t AS s, coalesce(nxt, fin) AS e FROM k WHERE opens AND coalesce(nxt, fin) > t),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM m),
i AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT subject, min(s) AS s, max(e) AS e FROM i GROUP BY subject, island""")
def pause_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).filter("kind <> 'error'")
    e = r.withColumn("type", F.when(F.col("kind") == "view", 1).when(F.col("kind") == "click", 2).when(F.col("kind") == "signup", 5).otherwise(6))
    return intervals.pauses(e, ["subject"], e.groupBy("subject").agg(F.max("t").alias("end")))


#: Cumulative value as distance, in whole hundredths.
DIST = "c AS (SELECT subject, t, sum(CAST(floor(v * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS d FROM r), s0 AS (SELECT subject, min(t) AS t FROM r GROUP BY subject), p AS (SELECT * FROM c UNION ALL SELECT subject, t, 0.0 FROM s0)"


def _distance(r: DataFrame) -> DataFrame:
    points = r.select("subject", "t", cents(F.col("v")).cast("double").alias("v"))
    return series.distance_from_increments(points, ["subject"], r.groupBy("subject").agg(F.min("t").alias("start")))


@query(f"WITH {R}, {DIST} SELECT subject, t, d FROM p")
def cumulative_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distance(readings(spark, sf_dir)).select("subject", "t", "d")


def interpolated(probes: str, column: str = "d") -> str:
    """Probes (subject, d) with the time at which p first reaches d."""
    return f"""{probes}_t AS (SELECT b.*, (SELECT CASE WHEN a1.d1 = b.{column} THEN a1.t1::DOUBLE ELSE a0.t0 + (b.{column} - a0.d0) / (a1.d1 - a0.d0) * (a1.t1 - a0.t0) END
  FROM (SELECT min(t) AS t1, min(d) AS d1 FROM p WHERE p.subject = b.subject AND p.d = (SELECT min(d) FROM p q WHERE q.subject = b.subject AND q.d >= b.{column})) a1,
       (SELECT max(t) AS t0, max(d) AS d0 FROM p WHERE p.subject = b.subject AND p.d = (SELECT max(d) FROM p q WHERE q.subject = b.subject AND q.d < b.{column})) a0) AS tt FROM {probes} b)"""


@query(f"WITH {R}, {DIST}, b AS (SELECT subject, unnest(range(1, CAST(floor(max(d) / 50000) AS BIGINT) + 1)) * 50000.0::DOUBLE AS d FROM p GROUP BY subject), {interpolated('b')} SELECT subject, d, {up('tt')} AS at FROM b_t")
def interpolate_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _distance(readings(spark, sf_dir))
    probes = p.groupBy("subject").agg(F.floor(F.max("d") / 50000).alias("k")).filter("k >= 1").select("subject", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "k"), lambda k: k * 50000.0)).alias("d"))
    return asof.at(p, probes, ["subject"], "d", "t", "at").withColumn("at", half_up(F.col("at")))


@query(f"""WITH {R}, {DIST}, tot AS (SELECT subject, max(d) AS total FROM p GROUP BY subject),
k AS (SELECT subject, total, unnest(range(0, CAST(ceil(total / 50000) AS BIGINT))) AS k FROM tot),
f AS (SELECT subject, CAST(k + 1 AS INT) AS split, k * 50000.0::DOUBLE AS from_m, least((k + 1) * 50000.0::DOUBLE, total) AS to_m FROM k WHERE least((k + 1) * 50000.0::DOUBLE, total) - k * 50000.0::DOUBLE >= 5000 OR k = 0),
b AS (SELECT DISTINCT subject, d FROM (SELECT subject, from_m AS d FROM f UNION ALL SELECT subject, to_m FROM f)), {interpolated('b')}
SELECT f.subject, f.split, f.from_m, f.to_m - f.from_m AS length_m, {up('(y.tt - x.tt) / 1000', 1)} AS seconds, f.to_m - f.from_m < 50000 AS partial FROM f JOIN b_t x ON x.subject = f.subject AND x.d = f.from_m JOIN b_t y ON y.subject = f.subject AND y.d = f.to_m""")
def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = series.splits(_distance(readings(spark, sf_dir)), ["subject"], 50000.0)
    return x.select("subject", "split", "from_m", "length_m", half_up((F.col("t1") - F.col("t0")) / 1000, 1).alias("seconds"), (F.col("length_m") < 50000).alias("partial"))


@query(f"""WITH {R}, {DIST}, b AS (SELECT subject, t AS t0, min(d) + 100000 AS d FROM p GROUP BY subject, t HAVING min(d) + 100000 <= (SELECT max(d) FROM p q WHERE q.subject = p.subject)), {interpolated('b')}
SELECT subject, {up('min(tt - t0) / 1000', 1)} AS seconds FROM b_t WHERE tt > t0 GROUP BY subject""")
def best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.best_effort(_distance(readings(spark, sf_dir)), ["subject"], 100000.0).select("subject", half_up(F.col("seconds"), 1).alias("seconds"))


@query(f"""WITH {R}, l AS (SELECT subject, t, v, (least(coalesce(lead(t) OVER (PARTITION BY subject ORDER BY t), t), t + 21600000) - t) AS w, min(t) OVER (PARTITION BY subject) AS a, max(t) OVER (PARTITION BY subject) AS b FROM r),
h AS (SELECT *, (a + b) / 2.0::DOUBLE AS mid FROM l WHERE w > 0),
o AS (SELECT subject, v, greatest(least(t + w, mid) - greatest(t, a), 0) / 1000 AS w1, greatest(least(t + w, b) - greatest(t, mid), 0) / 1000 AS w2 FROM h),
g AS (SELECT subject, sum(w1 * v) / sum(w1) AS hr1, sum(w2 * v) / sum(w2) AS hr2 FROM o GROUP BY subject)
SELECT subject, {up('hr1', 4)} AS hr1, {up('hr2', 4)} AS hr2, {up('100 * (hr2 - hr1) / hr1', 2)} AS change FROM g""")
def drift_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    bounds = r.groupBy("subject").agg(F.min("t").alias("start"), F.max("t").alias("end")).withColumn("mid", (F.col("start") + F.col("end")) / 2)
    x = series.halves(series.weights(r, ["subject"], cap_ms=6 * HOUR), ["subject"], bounds)
    return x.select("subject", half_up(F.col("hr1"), 4).alias("hr1"), half_up(F.col("hr2"), 4).alias("hr2"), half_up(F.col("change"), 2).alias("change"))


ISLANDS = f"{R}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) AS n FROM r), g AS (SELECT *, n - row_number() OVER (PARTITION BY subject ORDER BY t) AS island FROM n WHERE v >= 50), c AS (SELECT *, count(*) OVER (PARTITION BY subject, island) AS size FROM g)"


@query(f"WITH {ISLANDS} SELECT subject, max(size) AS longest FROM c GROUP BY subject")
def streak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.longest_run(readings(spark, sf_dir), ["subject"], ["t"], F.col("v") >= 50)


@query(f"WITH {ISLANDS} SELECT subject, id, v FROM c WHERE size >= 3")
def band_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.stretches(readings(spark, sf_dir), ["subject"], ["t"], F.col("v") >= 50, 3).select("subject", "id", "v")


@query(f"""WITH {R}, d AS (SELECT DISTINCT subject, day FROM r), g AS (SELECT subject, day, day - coalesce(lag(day) OVER (PARTITION BY subject ORDER BY day), DATE '2024-01-01') AS gap FROM d)
SELECT subject, greatest(max(gap), DATE '2024-01-31' - max(day))::INT AS gap FROM g GROUP BY subject""")
def longest_gap_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.longest_gap(readings(spark, sf_dir), ["subject"], F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))


@query(f"""WITH {R}, n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY subject ORDER BY t) < 10800000 THEN 0 ELSE 1 END AS new FROM r),
e AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING) AS episode FROM n)
SELECT subject, episode::BIGINT AS episode, min(t) AS s, max(t) AS e, count(*) AS n FROM e GROUP BY subject, episode""")
def session_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = intervals.episodes(readings(spark, sf_dir).withColumn("t2", F.col("t")), ["subject"], "t", "t2", 3 * HOUR)
    return x.groupBy("subject", "episode").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


@query(f"WITH {R} SELECT subject, max(v) AS peak FROM r a WHERE v BETWEEN 140 AND 230 AND (SELECT count(*) FROM r b WHERE b.subject = a.subject AND b.v BETWEEN 140 AND 230 AND b.v BETWEEN a.v - 3 AND a.v + 3) >= 2 GROUP BY subject")
def confirmed_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.confirmed_max(readings(spark, sf_dir), ["subject"])


@query(f"""WITH {R}, n AS (SELECT DISTINCT subject, day, epoch_us(day::TIMESTAMP) // 1000 - 7200000 - 3540000 AS a, epoch_us(day::TIMESTAMP) // 1000 + 21600000 AS b FROM r)
SELECT n.subject, n.day, count(*) AS n, {up("avg(CASE WHEN kind <> 'error' THEN CAST(floor(v * 100 + 0.5) AS BIGINT) END) / 100", 4)} AS mean, min(CASE WHEN kind <> 'error' THEN v END) AS low
FROM n JOIN r ON r.subject = n.subject AND r.t >= n.a AND r.t < n.b GROUP BY n.subject, n.day""")
def night_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    nights = daily.nights(r.select("subject", "day").distinct().withColumns({"bed": F.lit("22:00"), "wake": F.lit("06:00")}))
    x = intervals.in_windows(r.drop("day"), nights, ["subject"])
    usual = F.when(F.col("kind") != "error", F.col("v"))
    return x.groupBy("subject", "day").agg(F.count("*").alias("n"), half_up(F.avg(cents(usual)) / 100, 4).alias("mean"), F.min(usual).alias("low"))


@query(f"""WITH {R} SELECT subject, t // 60000 AS minute, arg_max(v, t) FILTER (WHERE kind = 'view') AS view, arg_max(v, t) FILTER (WHERE kind = 'purchase') AS purchase, arg_max(v, t) FILTER (WHERE kind = 'signup') AS signup FROM r GROUP BY 1, 2""")
def pivot_minute_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.col("t").alias("s"), F.col("kind").alias("agg"), "v")
    return daily.entries_by_minute(x, ["subject"], ["view", "purchase", "signup"])


GPS = f"{R}, g AS (SELECT subject, t, id, 50 + (id % 1000) / 1000.0::DOUBLE AS lat, 10 + (id % 777) / 777.0::DOUBLE AS lon, v FROM r)"


def _route(r: DataFrame) -> DataFrame:
    return series.route_distance(r.select("subject", "t", "id", "v", (50 + (F.col("id") % 1000) / 1000.0).alias("lat"), (10 + (F.col("id") % 777) / 777.0).alias("lon")), ["subject"])


ROUTE = f"""{GPS}, h AS (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM g WINDOW w AS (PARTITION BY subject ORDER BY t)),
j AS (SELECT *, CASE WHEN la IS NULL OR lo IS NULL THEN 0.0::DOUBLE ELSE 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin(radians(lat - la) / 2), 2) + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))) END AS step FROM h),
d AS (SELECT *, sum(step) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING) AS d FROM j)"""


@query(f"WITH {ROUTE} SELECT subject, id, {up('d', 1)} AS d FROM d")
def haversine_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(readings(spark, sf_dir)).select("subject", "id", half_up(F.col("d"), 1).alias("d"))


@query(f"WITH {ROUTE}, t AS (SELECT *, max(d) OVER (PARTITION BY subject) AS total FROM d) SELECT subject, id FROM t WHERE d >= 200000 AND total - d >= 200000")
def route_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trim_ends(_route(readings(spark, sf_dir)), ["subject"], 200000.0).select("subject", "id")


@query(f"WITH {ROUTE} SELECT subject, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM d GROUP BY subject")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route(readings(spark, sf_dir)).groupBy("subject").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))


@query(f"WITH {R} SELECT subject, id, {up('avg(CAST(floor(v * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY subject ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)', 3)} AS smooth FROM r")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).withColumn("c", cents(F.col("v")))
    return r.select("subject", "id", half_up(series.smooth("c", ["subject"], "t"), 3).alias("smooth"))


@query(f"""WITH {R}, n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM r),
k AS (SELECT unnest(range(0, 10)) AS k) SELECT DISTINCT subject, id FROM n WHERE n <= 10 OR i IN (SELECT CAST(floor(k * (n.n - 1) / 9.0::DOUBLE + 0.5) AS BIGINT) FROM k)""")
def thin_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.thin(readings(spark, sf_dir), ["subject"], "t", 10).select("subject", "id")


@query(f"WITH {R} SELECT subject, id FROM r QUALIFY row_number() OVER (PARTITION BY subject ORDER BY t) BETWEEN 21 AND 30")
def cursor_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.page(readings(spark, sf_dir), ["subject"], "t", 20, 10).select("subject", "id")


def _divisor(m: int) -> str:
    return f"bool_and(floor(v * {m} + 0.5) / {m}.0::DOUBLE = v)"


@query(f"WITH {R} SELECT subject, kind, CASE {' '.join(f'WHEN {_divisor(m)} THEN {m}' for m in codec.DIVISORS)} END AS divisor FROM r GROUP BY subject, kind")
def column_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.exact_divisor(readings(spark, sf_dir), ["subject", "kind"])


@query(f"WITH {R} SELECT subject, CAST(row_number() OVER (PARTITION BY subject ORDER BY t) - 1 AS INT) AS pos, CAST(floor(v * 100 + 0.5) AS BIGINT) AS i FROM r")
def delta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded in chunks as the cheaper differences, then decoded."""
    r = readings(spark, sf_dir).withColumn("i", cents(F.col("v")))
    x = compact.encode(r, ["subject"], "t", {"i": compact.exact()}, 50)
    back = compact.unpacked(x, ["subject", "chunk"], ["t"], ["i"], compact.SAFE).select("subject", "chunk", F.posexplode("i").alias("pos", "i"))
    return back.select("subject", (F.col("chunk") * 50 + F.col("pos")).alias("pos"), F.col("i").cast("long").alias("i"))


@query(f"""WITH {R}, x AS (SELECT kind, (t // 3600000) % 24 AS hour, CAST(floor(v * 100 + 0.5) AS BIGINT) AS y FROM r),
a AS (SELECT kind, count(*) AS n, sum(hour) AS sx, sum(y) AS sy, sum(hour * hour) AS sxx, sum(hour * y) AS sxy FROM x GROUP BY kind)
SELECT kind, n, {up('(n * sxy - sx * sy)::DOUBLE / (n * sxx - sx * sx)', 4)} AS slope, {up('(sy - (n * sxy - sx * sy)::DOUBLE / (n * sxx - sx * sx) * sx) / n', 4)} AS intercept FROM a""")
def regression_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("kind", (F.floor(F.col("t") / HOUR) % 24).cast("double").alias("x"), cents(F.col("v")).cast("double").alias("y"))
    return x.groupBy("kind").agg(F.count("*").alias("n"), half_up(F.regr_slope("y", "x"), 4).alias("slope"), half_up(F.regr_intercept("y", "x"), 4).alias("intercept"))


@query(f"""WITH {R}, k AS (SELECT subject, kind, avg(v) AS m, stddev_samp(v) AS s FROM r GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_samp(v) > 0),
w AS (SELECT subject, sum(m / (s * s)) / sum(1 / (s * s)) AS central, sqrt(1 / sum(1 / (s * s))) AS sigma, min(s) AS least, count(*) AS n FROM k GROUP BY subject)
SELECT subject, n, {up('central', 4)} AS central, {up('greatest(sigma, 0.85 * least)', 4)} AS sigma FROM w""")
def inverse_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = readings(spark, sf_dir).groupBy("subject", "kind").agg(F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.count("*").alias("c")).filter("c >= 3 and s > 0")
    w = 1 / (F.col("s") * F.col("s"))
    x = k.groupBy("subject").agg(F.count("*").alias("n"), (F.sum(F.col("m") * w) / F.sum(w)).alias("central"), F.sqrt(1 / F.sum(w)).alias("sigma"), F.min("s").alias("least"))
    return x.select("subject", "n", half_up(F.col("central"), 4).alias("central"), half_up(F.greatest("sigma", 0.85 * F.col("least")), 4).alias("sigma"))


@query(f"""WITH {R}, b AS (SELECT kind, {' '.join(f'(v * 100 > {x})::INT +' for x in product.BUCKETS_MS[:-1])} 0 AS bucket, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT kind, bucket, sum(n) OVER (PARTITION BY kind ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY kind) AS total FROM b)
SELECT kind, ([{', '.join(map(str, product.BUCKETS_MS))}])[min(bucket) + 1] AS bound FROM c WHERE seen >= ceil(total * 0.95) GROUP BY kind""")
def histogram_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).withColumn("ms", F.col("v") * 100)
    return product.percentile_bound(product.histogram(x, ["kind"], "ms"), ["kind"], 0.95)


def _users(r: DataFrame) -> DataFrame:
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("t")))
    u = r.groupBy(F.col("subject").alias("uid")).agg(first("signup").alias("first_opened"), first("view").alias("viewed"), first("click").alias("clicked"), first("purchase").alias("activated"))
    return u.withColumn("deleting", F.lit(False))


USERS = f"{R}, u AS (SELECT subject AS uid, min(t) FILTER (WHERE kind = 'signup') AS first_opened, min(t) FILTER (WHERE kind = 'view') AS viewed, min(t) FILTER (WHERE kind = 'click') AS clicked, min(t) FILTER (WHERE kind = 'purchase') AS activated FROM r GROUP BY subject)"


@query(f"WITH {USERS} SELECT CAST(make_timestamp(first_opened * 1000) AS DATE) AS day, count(first_opened) AS first_opened, count(viewed) AS viewed, count(clicked) AS clicked, count(activated) AS activated FROM u WHERE first_opened IS NOT NULL GROUP BY 1")
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.funnel(_users(readings(spark, sf_dir)), ["first_opened", "viewed", "clicked", "activated"])


@query(f"""WITH {USERS}, s AS (SELECT count(first_opened) AS a, count(viewed) AS b, count(clicked) AS c, count(activated) AS d FROM u WHERE first_opened IS NOT NULL)
SELECT 0 AS place, 'first_opened' AS step, a AS users, a / a::DOUBLE AS rate FROM s UNION ALL SELECT 1, 'viewed', b, b / a::DOUBLE FROM s UNION ALL SELECT 2, 'clicked', c, c / a::DOUBLE FROM s UNION ALL SELECT 3, 'activated', d, d / a::DOUBLE FROM s""")
def funnel_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = ["first_opened", "viewed", "clicked", "activated"]
    return product.funnel_rates(product.funnel(_users(readings(spark, sf_dir)), steps), steps)


NOW = 1706572800000  # 2024-01-30


@query(f"""WITH {USERS}, h AS (SELECT u.uid, u.activated, max((r.t >= activated + 7 * {DAY}::BIGINT AND r.t < activated + 14 * {DAY}::BIGINT)::INT) AS w1, max((r.t >= activated + 28 * {DAY}::BIGINT AND r.t < activated + 35 * {DAY}::BIGINT)::INT) AS w4
  FROM u LEFT JOIN r ON r.subject = u.uid AND r.kind <> 'error' WHERE activated IS NOT NULL GROUP BY 1, 2)
SELECT CAST(make_timestamp(activated * 1000) AS DATE) AS day, count(*) AS activated, count(*) FILTER (WHERE {NOW} >= activated + 14 * {DAY}::BIGINT) AS w1_eligible, count(*) FILTER (WHERE {NOW} >= activated + 14 * {DAY}::BIGINT AND w1 = 1) AS w1_retained,
  count(*) FILTER (WHERE {NOW} >= activated + 35 * {DAY}::BIGINT) AS w4_eligible, count(*) FILTER (WHERE {NOW} >= activated + 35 * {DAY}::BIGINT AND w4 = 1) AS w4_retained FROM h GROUP BY 1""")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return product.retention(_users(r), _access(r), NOW)


def _access(r: DataFrame) -> DataFrame:
    return r.select(F.col("subject").alias("uid"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("provider"), (F.col("kind") != "error").alias("ok"), F.col("t").alias("at"), F.floor(F.col("v") * 100).cast("long").alias("ms"))


ACCESS = f"{R}, x AS (SELECT subject AS uid, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, kind <> 'error' AS ok, day FROM r)"
_USE = "count(DISTINCT CASE WHEN ok THEN uid END) AS active, count(*) AS calls, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS failures FROM x"


@query(f"WITH {ACCESS} SELECT day, {_USE} GROUP BY day")
def daily_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.usage(_access(readings(spark, sf_dir)))


@query(f"WITH {ACCESS} SELECT day, provider, {_USE} GROUP BY day, provider")
def daily_active_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.usage(_access(readings(spark, sf_dir)), ["provider"])


@query(f"""WITH {ACCESS}, d AS (SELECT day, NULL AS provider, {_USE} GROUP BY day UNION ALL SELECT day, provider, {_USE} GROUP BY day, provider)
SELECT provider, sum(active)::BIGINT AS active_user_days, sum(calls)::BIGINT AS calls, sum(successes)::BIGINT AS successes, sum(successes) / sum(calls)::DOUBLE AS success_rate FROM d GROUP BY provider""")
def usage_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _access(readings(spark, sf_dir))
    return product.usage_overview(product.usage(a), product.usage(a, ["provider"]))


@query(f"""WITH {R}, e AS (SELECT CASE WHEN id % 3 = 0 THEN '1.0' ELSE '1.1' END AS app_version, kind, CAST(floor(v * 100) AS BIGINT) AS ms FROM r WHERE kind IN ('purchase', 'error')),
b AS (SELECT app_version, {' '.join(f'(ms > {x})::INT +' for x in product.BUCKETS_MS[:-1])} 0 AS bucket, count(*) AS n FROM e GROUP BY 1, 2),
c AS (SELECT app_version, bucket, sum(n) OVER (PARTITION BY app_version ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY app_version) AS total FROM b),
p AS (SELECT app_version, ([{', '.join(map(str, product.BUCKETS_MS))}])[min(bucket) + 1] AS bound FROM c WHERE seen >= ceil(total * 0.95) GROUP BY 1)
SELECT e.app_version, count(*) AS attempts, count(*) FILTER (WHERE kind = 'purchase') AS successes, CAST(floor(avg(ms) + 0.5) AS BIGINT) AS mean_ms, any_value(p.bound) AS bound FROM e JOIN p ON p.app_version = e.app_version GROUP BY 1""")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).filter(F.col("kind").isin("purchase", "error"))
    e = r.select(F.lit("sync_finished").alias("name"), F.when(F.col("id") % 3 == 0, "1.0").otherwise("1.1").alias("app_version"), F.when(F.col("kind") == "purchase", "success").otherwise("failure").alias("outcome"), F.floor(F.col("v") * 100).cast("long").alias("duration_ms"))
    return product.reliability(e, ["app_version"])


@query(f"WITH {R} SELECT subject AS uid, kind AS name, min(t) AS at FROM r GROUP BY 1, 2")
def milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product.first_times(readings(spark, sf_dir).select(F.col("subject").alias("uid"), F.col("kind").alias("name"), F.col("t").alias("at")))


@query("""WITH o AS (SELECT o_custkey AS subject, CAST(date_trunc('week', o_orderdate) AS DATE) AS week, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
SELECT subject, count(DISTINCT week) AS weeks, count(*) AS orders, count(*) FILTER (WHERE c >= 20000000) AS large, floor(sum(c) / 100.0 + 0.5) AS total FROM o GROUP BY subject""")
def orders_weekly_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), monday(F.to_date("o_orderdate")).alias("week"), F.round(F.col("o_totalprice") * 100).cast("long").alias("c"))
    return o.groupBy("subject").agg(F.countDistinct("week").alias("weeks"), F.count("*").alias("orders"), F.count(F.when(F.col("c") >= 20_000_000, 1)).alias("large"), half_up(F.sum("c") / 100.0).alias("total"))


@query("SELECT o_custkey AS subject, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) > 3 AS truncated FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def fixed_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), "o_orderkey", "o_totalprice")
    return series.first_rows(o, ["subject"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(f"""WITH {R}, x AS (SELECT id, v, (v - 100) / 50 AS z, 1 / (1 + 0.3275911 * abs((v - 100) / 50) / sqrt(2.0::DOUBLE)) AS q FROM r),
e AS (SELECT *, 1 - ((((1.061405429 * q - 1.453152027) * q + 1.421413741) * q - 0.284496736) * q + 0.254829592) * q * exp(-z * z / 2) AS f FROM x)
SELECT id, {up('CASE WHEN z < 0 THEN (1 - f) / 2 ELSE (1 + f) / 2 END', 6)} AS p, CASE WHEN abs(v) >= 1000 THEN {up('v')} WHEN abs(v) >= 10 THEN {up('v', 1)} ELSE {up('v', 2)} END AS tidy,
  printf('%d:%02d:%02d', CAST(floor(v * 20 + 0.5) AS BIGINT) // 3600, CAST(floor(v * 20 + 0.5) AS BIGINT) // 60 % 60, CAST(floor(v * 20 + 0.5) AS BIGINT) % 60) AS hms,
  printf('%d:%02d', CAST(floor(v + 0.5) AS BIGINT) // 60, CAST(floor(v + 0.5) AS BIGINT) % 60) AS pace FROM e""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return r.select("id", half_up(normal_cdf((F.col("v") - 100) / 50), 6).alias("p"), tidy(F.col("v")).alias("tidy"), hms(F.col("v") * 20).alias("hms"), pace(F.col("v")).alias("pace"))


@query(f"""WITH {R}, w AS (SELECT id, v / 20 AS temp, 20 + id % 70 AS hum FROM r), t AS (SELECT *, ln(hum / 100.0::DOUBLE) + 17.625 * temp / (243.04 + temp) AS g, temp * 9 / 5 + 32 AS f FROM w)
SELECT id, {up('243.04 * g / (17.625 - g)', 4)} AS dew, CASE WHEN f >= 80 AND hum >= 40 THEN {up('((-42.379 + 2.04901523 * f + 10.14333127 * hum - 0.22475541 * f * hum - 0.00683783 * f * f - 0.05481717 * hum * hum + 0.00122874 * f * f * hum + 0.00085282 * f * hum * hum - 0.00000199 * f * f * hum * hum) - 32) * 5 / 9', 4)} END AS heat FROM t""")
def derived_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).select("id", (F.col("v") / 20).alias("temp"), (20 + F.col("id") % 70).cast("double").alias("hum"))
    return r.select("id", half_up(physics.dew_point(F.col("temp"), F.col("hum")), 4).alias("dew"), half_up(physics.heat_index(F.col("temp"), F.col("hum")), 4).alias("heat"))


@query(f"""WITH {R}, s AS (SELECT kind AS subject, id, t, t + 60000 * CAST(ceil(v) AS BIGINT) AS e, v FROM r WHERE v > 0),
k AS (SELECT *, unnest(range(t // 300000, greatest(t // 300000, CAST(ceil(e / 300000.0) AS BIGINT) - 1) + 1)) * 300000 AS slot FROM s)
SELECT subject, slot // 86400000 AS day, {up('sum(v * (least(slot + 300000, e) - greatest(slot, t)) / (e - t))', 3)} AS amount FROM k GROUP BY 1, 2""")
def slot_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).filter("v > 0").select(F.col("kind").alias("subject"), F.col("t").alias("start"), (F.col("t") + 60000 * F.ceil("v")).alias("end"), F.col("v").alias("value"))
    x = device.slot_shares(r).groupBy("subject", F.floor(F.col("slot") / DAY).alias("day")).agg(half_up(F.sum("share"), 3).alias("amount"))
    return x


# folds, with recursive twins ----------------------------------------------------------------------------------

NUMBERED = f"{R}, n AS (SELECT subject, t, v, id, row_number() OVER (PARTITION BY subject ORDER BY t) AS n FROM r)"


@query(f"""WITH RECURSIVE {NUMBERED}, f AS (SELECT subject, n, v AS ref, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss FROM n WHERE n = 1
  UNION ALL SELECT f.subject, n.n, CASE WHEN abs(n.v - f.ref) >= 20 THEN n.v ELSE f.ref END, f.gain + CASE WHEN n.v - f.ref >= 20 THEN n.v - f.ref ELSE 0 END, f.loss + CASE WHEN f.ref - n.v >= 20 THEN f.ref - n.v ELSE 0 END
  FROM f JOIN n ON n.subject = f.subject AND n.n = f.n + 1)
SELECT subject, {up('arg_max(gain, n)', 4)} AS gain, {up('arg_max(loss, n)', 4)} AS loss FROM f GROUP BY subject""")
def climb_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = folds.climb(readings(spark, sf_dir), ["subject"], 20.0)
    return x.select("subject", half_up(F.col("gain"), 4).alias("gain"), half_up(F.col("loss"), 4).alias("loss"))


@query(f"""WITH RECURSIVE {NUMBERED}, f AS (SELECT subject, n, t, t AS kept FROM n WHERE n = 1
  UNION ALL SELECT f.subject, n.n, n.t, CASE WHEN n.t - f.kept >= 43200000 THEN n.t ELSE f.kept END FROM f JOIN n ON n.subject = f.subject AND n.n = f.n + 1)
SELECT DISTINCT subject, t FROM (SELECT subject, t FROM f WHERE t = kept UNION ALL SELECT subject, max(t) FROM f GROUP BY subject)""")
def spaced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.spaced(readings(spark, sf_dir), ["subject"], 12 * HOUR)


@query(f"""WITH RECURSIVE {R}, d AS (SELECT subject, t, v, sum(CAST(floor(v * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY subject ORDER BY t ROWS UNBOUNDED PRECEDING)::DOUBLE AS d FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY d, v) AS n FROM d),
f AS (SELECT subject, n, d AS d0, v AS a0, NULL::DOUBLE AS grade, 0.0::DOUBLE AS dd FROM n WHERE n = 1
  UNION ALL SELECT f.subject, n.n, CASE WHEN n.d - f.d0 >= 20000 THEN n.d ELSE f.d0 END, CASE WHEN n.d - f.d0 >= 20000 THEN n.v ELSE f.a0 END, CASE WHEN n.d - f.d0 >= 20000 THEN (n.v - f.a0) / (n.d - f.d0) * 100 END, n.d - f.d0 FROM f JOIN n ON n.subject = f.subject AND n.n = f.n + 1)
SELECT subject, coalesce(sum(dd) FILTER (WHERE grade > 0.1), 0) AS up, coalesce(sum(dd) FILTER (WHERE grade BETWEEN -0.1 AND 0.1), 0) AS level, coalesce(sum(dd) FILTER (WHERE grade < -0.1), 0) AS down, {up('max(grade)', 4)} AS steepest, {up('min(grade)', 4)} AS lowest FROM f GROUP BY subject""")
def grade_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    w = Window.partitionBy("subject").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    x = folds.grades(r.select("subject", F.sum(cents(F.col("v"))).over(w).alias("d"), F.col("v").alias("a")), ["subject"], 20000.0, 0.1)
    return x.select("subject", "up", "level", "down", half_up(F.col("steepest"), 4).alias("steepest"), half_up(F.col("lowest"), 4).alias("lowest"))


@query("""WITH o AS (SELECT o_custkey AS subject, o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS s, epoch_us(o_orderdate) // 1000 + 86400000 * (5 + o_orderkey % 40) AS e FROM orders),
p AS (SELECT a.subject, a.id, min(b.id) AS first FROM o a JOIN o b ON b.subject = a.subject AND (b.s, b.e, b.id) <= (a.s, a.e, a.id) AND (b.id = a.id OR least(a.e, b.e) - greatest(a.s, b.s) > 0.5 * least(a.e - a.s, b.e - b.s)) GROUP BY 1, 2),
c AS (SELECT a.subject, a.id, count(*) - 1 AS earlier FROM o a JOIN o b ON b.subject = a.subject AND (b.s, b.e, b.id) <= (a.s, a.e, a.id) AND (b.id = a.id OR least(a.e, b.e) - greatest(a.s, b.s) > 0.5 * least(a.e - a.s, b.e - b.s)) GROUP BY 1, 2)
SELECT subject, count(*) FILTER (WHERE earlier = 0) AS chains, count(*) AS runs FROM c GROUP BY subject""")
def duplicate_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans of days: those that overlap an earlier one join its chain."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("id"), wall_ms(F.col("o_orderdate")).alias("s"))
    x = folds.duplicate_chains(o.withColumn("e", F.col("s") + DAY * (5 + F.col("id") % 40)), ["subject"])
    return x.groupBy("subject").agg(F.countDistinct("chain").alias("chains"), F.count("*").alias("runs"))


@query(f"""WITH {R}, x AS (SELECT subject, t // 3600000 AS k, t AS a, t + 60000 AS b, v FROM r WHERE t // 3600000 = (t + 60000) // 3600000),
w AS (SELECT *, lag(b + 22500) OVER o AS hi0, lead(a - 22500) OVER o AS lo1 FROM x WINDOW o AS (PARTITION BY subject, k ORDER BY a, b, v)),
y AS (SELECT *, greatest(a - 22500, k * 3600000 - 22500, CASE WHEN a - 22500 < hi0 THEN (a - 22500 + hi0) / 2.0::DOUBLE ELSE a - 22500 END) AS s, least(b + 22500, (k + 1) * 3600000 + 22500, CASE WHEN lo1 < b + 22500 THEN (lo1 + b + 22500) / 2.0::DOUBLE ELSE b + 22500 END) AS e FROM w)
SELECT subject, k * 3600000 AS bucket, {up('sum(v * greatest(e - s, 0)) / sum(greatest(e - s, 0))', 4)} AS mean FROM y GROUP BY 1, 2""")
def time_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of a minute within an hour."""
    r = readings(spark, sf_dir).filter("floor(t / 3600000) = floor((t + 60000) / 3600000)")
    x = r.select("subject", F.col("t").alias("start"), (F.col("t") + 60_000).alias("end"), F.col("v").alias("value"), F.lit(1).alias("n"))
    return device.time_weighted(x).withColumn("mean", half_up(F.col("mean"), 4))


@query(f"""WITH {R}, m AS (SELECT subject, day, CAST(floor(max(v) * 100 + 0.5) AS BIGINT) AS value FROM r GROUP BY 1, 2)
SELECT subject, day, {up('avg(value) OVER (PARTITION BY subject ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)', 3)} AS trailing FROM m""")
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = readings(spark, sf_dir).groupBy("subject", "day").agg(cents(F.max("v")).alias("value"))
    return m.select("subject", "day", half_up(daily.trailing_mean(m, ["subject"], 7), 3).alias("trailing"))


@query(f"WITH {R}, s AS (SELECT DISTINCT subject FROM r), e AS (SELECT min(t) // 3600000 AS a, max(t) // 3600000 AS b FROM r), h AS (SELECT subject, unnest(range(a, b + 1)) AS hour FROM s, e) SELECT subject, CAST(hour AS INT) AS hour FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.subject = h.subject AND r.t // 3600000 = h.hour)")
def missing_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the whole table's span without a reading of a subject."""
    r = readings(spark, sf_dir)
    first, last = r.agg(F.min("t"), F.max("t")).first()
    return daily.missing_hours(r, ["subject"], first or 0, (last or 0) + 1).withColumn("hour", F.col("hour").cast("int"))


@query(f"WITH {R}, a AS (SELECT subject, day, sum(CAST(floor(v * 100 + 0.5) AS BIGINT)) AS x FROM r WHERE kind = 'view' GROUP BY 1, 2), b AS (SELECT subject, day, sum(CAST(floor(v * 100 + 0.5) AS BIGINT)) AS y FROM r WHERE kind = 'click' GROUP BY 1, 2) SELECT a.subject, {up('median(abs(y - x)::DOUBLE / x)', 4)} AS median, {up('max(abs(y - x)::DOUBLE / x)', 4)} AS greatest, count(*) AS days FROM a JOIN b ON b.subject = a.subject AND b.day = a.day GROUP BY a.subject")
def shared_day_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    of = lambda kind: r.filter(F.col("kind") == kind).groupBy("subject", "day").agg(F.sum(cents(F.col("v"))).alias("value"))
    x = device.shared_day_difference(of("view"), of("click"), plain=True)
    rounded = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.col(c)).otherwise(half_up(F.col(c), 4)).alias(c)
    return x.select("subject", rounded("median"), rounded("greatest"), "days")


@query(f"""WITH {R}, o AS (SELECT subject, id, kind, v, row_number() OVER (PARTITION BY subject ORDER BY v DESC, id) AS rn FROM r WHERE kind = 'purchase'),
a AS (SELECT subject, id, 'best purchase' AS why, 0 AS c, rn FROM o WHERE rn <= 3),
p AS (SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY t DESC, id) AS rn FROM r WHERE id NOT IN (SELECT id FROM a)),
u AS (SELECT * FROM a UNION ALL SELECT subject, id, 'recent', 1, rn FROM p WHERE rn <= 5),
w AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY c, rn) AS n FROM u) SELECT subject, id, why FROM w WHERE n <= 6""")
def ranked_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return selection.shortlist([("best purchase", r.filter("kind = 'purchase'"), [F.desc("v")], 3), ("recent", r, [F.desc("t")], 5)], 6)
