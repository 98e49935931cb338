"""More queries over the driver's tables: records, choices, calendars, devices and joins in time, each with its SQL twin.

As in queries.py, events stand for readings and records of a subject; what an operator needs further is derived from their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions import clock, physics
from paceline.functions.numbers import coefficient_of_variation, goal_seconds, half_up, pace, tidy
from paceline.operators import codec, compact, daily, dedup, device, intervals, selection, series
from paceline.plans import health, workouts
from paceline.plans.queries import DAY, HOUR, ORACLES, QUERIES, R, cents, query, readings, up
from paceline.sources import maintenance, shared, tables
from paceline.streaming.ingest import live_minutes

__all__ = ["ORACLES", "QUERIES"]

#: One reading for each time of a subject, as SQL.
U = f"{R}, u AS (SELECT *, CAST(floor(v * 100 + 0.5) AS BIGINT) AS c FROM r QUALIFY row_number() OVER (PARTITION BY subject, t ORDER BY id DESC) = 1)"


def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """readings with c, the value in hundredths; the last one of those with one time."""
    return dedup.latest(readings(spark, sf_dir), ["subject", "t"], ["id"]).withColumn("c", cents(F.col("v")))


# devices ----------------------------------------------------------------------------------------------------


@query(f"""WITH {R}, x AS (SELECT subject, t // 3600000 AS k, t AS a, t + 60000 AS b, pow(10.0, v / 100) AS v FROM r WHERE t // 3600000 = (t + 60000) // 3600000),
w AS (SELECT *, lag(b + 22500) OVER o AS hi0, lead(a - 22500) OVER o AS lo1 FROM x WINDOW o AS (PARTITION BY subject, k ORDER BY a, b, v)),
y AS (SELECT *, greatest(a - 22500, k * 3600000 - 22500, CASE WHEN a - 22500 < hi0 THEN (a - 22500 + hi0) / 2.0::DOUBLE ELSE a - 22500 END) AS s, least(b + 22500, (k + 1) * 3600000 + 22500, CASE WHEN lo1 < b + 22500 THEN (lo1 + b + 22500) / 2.0::DOUBLE ELSE b + 22500 END) AS e FROM w)
SELECT subject, k * 3600000 AS bucket, {up('10 * log10(sum(v * greatest(e - s, 0)) / sum(greatest(e - s, 0)))', 4)} AS mean FROM y GROUP BY 1, 2""")
def sound_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels (a tenth of the value, as decibels) of a minute within an hour: the mean is of energies."""
    r = readings(spark, sf_dir).filter("floor(t / 3600000) = floor((t + 60000) / 3600000)")
    x = r.select("subject", F.col("t").alias("start"), (F.col("t") + 60_000).alias("end"), (F.col("v") / 10).alias("value"), F.lit(1).alias("n"))
    return device.time_weighted(x, level=True).withColumn("mean", half_up(F.col("mean"), 4))


@query(f"WITH {U} SELECT subject, t // 86400000 * 86400000 AS bucket, {up('sum(c * (1 + id % 3))::DOUBLE / sum(1 + id % 3)', 4)} AS mean, min(c) AS low, max(c) AS high, arg_max(c, t) AS last FROM u GROUP BY 1, 2")
def discrete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    x = u.select("subject", F.col("t").alias("start"), (F.col("t") + 60_000).alias("end"), F.col("c").cast("double").alias("value"), F.col("c").alias("low"), F.col("c").alias("high"), F.col("c").alias("last"), (1 + F.col("id") % 3).alias("n"))
    return device.discrete(x, DAY).withColumn("mean", half_up(F.col("mean"), 4))


@query(f"WITH {R} SELECT subject, t // 86400000 * 86400000 AS day, sum((id % 5 + 1) * 60000) / 60000.0::DOUBLE AS minutes, count(*) AS count, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM r GROUP BY 1, 2")
def category_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.col("t").alias("start"), (F.col("t") + (F.col("id") % 5 + 1) * 60_000).alias("end"), F.col("kind").alias("value"))
    return device.categories(x).withColumn("kinds", F.array_join("values", ",")).drop("values")


@query(f"""WITH {U}, w AS (SELECT subject, id // 3 AS id, arg_max(c, id) AS metres, arg_max(kind, id) AS kind FROM u WHERE kind <> 'error' GROUP BY 1, 2),
d AS (SELECT subject, day, arg_max(c, id) AS steps FROM u WHERE kind = 'view' GROUP BY 1, 2), a AS (SELECT subject, count(*) AS workouts, sum(metres)::BIGINT AS metres, count(DISTINCT kind) AS kinds FROM w GROUP BY 1), b AS (SELECT subject, count(*) AS days, sum(steps)::BIGINT AS steps FROM d GROUP BY 1)
SELECT coalesce(a.subject, b.subject) AS subject, workouts, metres, kinds, days, steps FROM a FULL JOIN b ON a.subject = b.subject""")
def lifetime_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    w = u.filter("kind <> 'error'").select("subject", F.floor(F.col("id") / 3).alias("id"), F.col("c").alias("metres"), "kind", F.col("id").alias("seq"))
    return device.lifetime(w, u.filter("kind = 'view'").select("subject", "day", F.col("c").alias("steps"), F.col("id").alias("seq")))


@query(f"""WITH {U}, s AS (SELECT subject, t // 300000 * 300000 AS slot, sum(c)::DOUBLE AS amount FROM u GROUP BY 1, 2)
SELECT subject, slot // 3600000 * 3600000 AS bucket, sum(amount) AS amount FROM s GROUP BY 1, 2""")
def amounts_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    slots = u.groupBy("subject", (F.floor(F.col("t") / 300_000) * 300_000).alias("slot")).agg(F.sum("c").cast("double").alias("amount"))
    return device.per_unit(slots, HOUR)


# records ----------------------------------------------------------------------------------------------------


@query(f"""WITH {R}, x AS (SELECT subject, id // 4 AS id, max(id) AS last, count(*) FILTER (id % 3 = 0) AS again FROM r GROUP BY 1, 2)
SELECT subject, id FROM x WHERE last < 4000 AND again = 0""")
def not_sent_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.floor(F.col("id") / 4).alias("id"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "pass").alias("rid"))
    return dedup.not_sent_again(x, ["subject"], 4000, "pass")


@query(f"""WITH {U}, a AS (SELECT subject, day, sum(c)::BIGINT AS value FROM u WHERE kind = 'purchase' GROUP BY 1, 2), b AS (SELECT subject, day, sum(c)::BIGINT AS value FROM u WHERE kind = 'view' GROUP BY 1, 2)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.subject = b.subject AND a.day = b.day)""")
def fill_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    of = lambda kind: u.filter(F.col("kind") == kind).groupBy("subject", "day").agg(F.sum("c").alias("value"))
    return dedup.fill_missing(of("purchase"), of("view"), ["subject", "day"])


@query(f"""WITH {R}, a AS (SELECT subject, day, floor(v / 50) AS v FROM r WHERE kind = 'view'), b AS (SELECT subject, day, floor(v / 50) AS v FROM r WHERE kind = 'click')
SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'added' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def read_back_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    of = lambda kind: r.filter(F.col("kind") == kind).select("subject", "day", F.floor(F.col("v") / 50).cast("double").alias("v"))
    return dedup.differences(of("view"), of("click"))


@query(f"""WITH {R}, p AS (SELECT subject, kind AS stream, id % 3 AS gen, id AS batch, t // 21600000 AS t, v FROM r), g AS (SELECT *, max(gen) OVER (PARTITION BY subject, stream) AS newest FROM p)
SELECT subject, stream, t, gen, batch, v FROM g WHERE gen = newest QUALIFY row_number() OVER (PARTITION BY subject, stream, t ORDER BY gen DESC, batch DESC) = 1""")
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.col("kind").alias("stream"), (F.col("id") % 3).alias("gen"), F.col("id").alias("batch"), F.floor(F.col("t") / (6 * HOUR)).alias("t"), "v")
    return dedup.latest_generation(x, ["subject", "stream"])


@query(f"""WITH {R}, x AS (SELECT subject, kind AS type, CASE WHEN id % 4 > 0 THEN 'k' || id // 5 END AS id, kind AS agg, t // 3600000 AS s, CASE WHEN id % 2 = 0 THEN 'app' END AS src, id AS seq, v FROM r),
y AS (SELECT *, coalesce(id, concat_ws('|', agg, s::VARCHAR, src)) AS key FROM x WHERE id IS NULL OR NOT EXISTS (SELECT 1 FROM r d WHERE d.kind = 'error' AND d.subject = x.subject AND 'k' || d.id // 5 = x.id))
SELECT subject, type, key, seq, v FROM y QUALIFY row_number() OVER (PARTITION BY subject, type, key ORDER BY seq DESC) = 1""")
def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of records with and without ids; an error deletes the records of its id in all types."""
    r = readings(spark, sf_dir)
    key = F.concat(F.lit("k"), F.floor(F.col("id") / 5))
    x = r.select("subject", F.col("kind").alias("type"), F.when(F.col("id") % 4 > 0, key).alias("id"), F.col("kind").alias("agg"), F.floor(F.col("t") / HOUR).alias("s"), F.when(F.col("id") % 2 == 0, "app").alias("src"), F.col("id").alias("seq"), F.lit("b").alias("batch"), "v")
    errors = r.filter("kind = 'error'").select("subject", key.alias("id"))
    gone = x.filter("id is not null").select("subject", "type", "id").distinct().join(errors, ["subject", "id"], "left_semi")
    return tables.current_rows(x, gone).select("subject", "type", dedup.row_key().alias("key"), "seq", "v")


@query(f"WITH {R} SELECT subject, count(*) AS n, min(t) AS first FROM r WHERE t >= 1704844800000 - 86400000 AND t < 1704931200000 + 172800000 GROUP BY 1")
def rough_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = clock.rough_bounds(1_704_844_800_000, 1_704_931_200_000)
    return readings(spark, sf_dir).filter((F.col("t") >= a) & (F.col("t") < b)).groupBy("subject").agg(F.count("*").alias("n"), F.min("t").alias("first"))


@query(f"WITH {R} SELECT subject, id, kind FROM r WHERE t >= 1705708800000 - 7 * 86400000 AND subject IN (SELECT subject FROM r GROUP BY 1 HAVING max(t) < 1706659200000 - 86400000)")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unexpired rows of subjects that have been inactive for a day."""
    r = readings(spark, sf_dir).withColumn("at", F.col("t"))
    still = maintenance.unexpired(r, 1_705_708_800_000, 7)
    return still.join(maintenance.inactive(r, 1_706_659_200_000, 1), "subject", "left_semi").select("subject", "id", "kind")


@query(f"""WITH {R}, x AS (SELECT kind || '/' || subject AS path, id AS size FROM r)
SELECT split_part(path, '/', 1) AS layout, count(*) AS files, sum(size)::BIGINT AS bytes FROM x WHERE split_part(path, '/', 1) NOT IN ('view', 'click') GROUP BY 1""")
def retired_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = readings(spark, sf_dir).select(F.concat_ws("/", "kind", F.col("subject").cast("string")).alias("path"), F.col("id").cast("long").alias("size"))
    return maintenance.by_layout(files, ["view", "click"])


@query(f"WITH {R} SELECT subject, max(t) AS at, min(t) AS as_of, bool_or(1706745600000 - t > 86400000) AS stale FROM (SELECT subject, kind, max(t) AS t FROM r GROUP BY 1, 2) GROUP BY 1")
def result_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = readings(spark, sf_dir).groupBy("subject", "kind").agg(F.max("t").alias("checked_at"))
    latest = checks.groupBy("subject").agg(F.max("checked_at").alias("at"))
    return daily.freshness(checks, ["subject"], 1_706_745_600_000).join(latest, "subject")


# columns ----------------------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT id, floor(v * 100 + 0.5)::BIGINT AS i, floor(v * 100 + 0.5) / 100 AS back FROM r")
def unscaled_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir).select("id", "kind", (cents(F.col("v")) / 100.0).alias("v"))
    x = codec.scaled(r, codec.exact_divisor(r, ["kind"]), ["kind"])
    # other divisors give other integers for the same value
    return x.select("id", (F.col("i") * 100 / F.col("divisor")).cast("long").alias("i"), selection.unscaled(F.col("i"), F.col("divisor")).alias("back"))


def _divided(v: str) -> str:
    return f"CASE {' '.join(f'WHEN bool_and(floor({v} * {m} + 0.5) / {m}.0::DOUBLE = {v}) THEN {m}' for m in codec.DIVISORS)} END"


@query(f"""WITH {R}, g AS (SELECT subject, kind, {_divided('v')} AS v_m, {_divided('(v / 3.0::DOUBLE)')} AS alt_m FROM r GROUP BY 1, 2)
SELECT r.subject, r.kind, t, v, v / 3.0::DOUBLE AS alt, v_m, alt_m FROM r JOIN g ON g.subject = r.subject AND g.kind = r.kind""")
def stored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as integers where these give every value of a stream back, and read again."""
    r = readings(spark, sf_dir).select("subject", "kind", "t", "v", (F.col("v") / 3.0).alias("alt"))
    path = f"{shared.new_folder(spark, 'streams')}/points"
    tables.append(codec.stored(r, ["subject", "kind"], ["v", "alt"]), path, ["kind"], ["subject", "t"])
    rows = spark.read.parquet(path)
    return codec.restored(rows.withColumns({"m1": F.col("v_m"), "m2": F.col("alt_m")}), ["v", "alt"]).select("subject", "kind", "t", "v", "alt", F.col("m1").alias("v_m"), F.col("m2").alias("alt_m"))


@query(f"""WITH {R}, c AS (SELECT subject, kind, v, row_number() OVER w AS n, (row_number() OVER w - 1) // 20 AS chunk FROM r WINDOW w AS (PARTITION BY subject, kind ORDER BY t, v)),
x AS (SELECT *, CAST(floor(v * m + 0.5) AS BIGINT) AS q FROM c, (SELECT unnest([1, 10, 100]) AS m)),
e AS (SELECT *, row_number() OVER w AS p, q - coalesce(lag(q) OVER w, 0) AS d1 FROM x WINDOW w AS (PARTITION BY subject, kind, chunk, m ORDER BY n)),
f AS (SELECT *, CASE WHEN p <= 2 THEN d1 ELSE d1 - lag(d1) OVER (PARTITION BY subject, kind, chunk, m ORDER BY n) END AS d2 FROM e),
s AS (SELECT subject, kind, chunk, m, count(*) AS n, bool_and(q / m::DOUBLE = v) AS exact, bool_and(abs(q / m::DOUBLE - v) <= 0.05) AS good, coalesce(sum(abs(d2)) FILTER (p > 2), 0) < coalesce(sum(abs(d1)) FILTER (p > 2), 0) AS second,
  sum(length(CAST(d1 AS VARCHAR)) + 1) AS l1, sum(length(CAST(d2 AS VARCHAR)) + 1) AS l2, sum(CAST(floor(q / m::DOUBLE * 100 + 0.5) AS BIGINT))::BIGINT AS total FROM f GROUP BY 1, 2, 3, 4),
y AS (SELECT *, (CASE WHEN second THEN l2 ELSE l1 END)::BIGINT AS characters, min(CASE WHEN exact THEN m END) OVER (PARTITION BY subject, kind, chunk) AS em FROM s)
SELECT subject, kind, chunk::INT AS chunk, n, m::BIGINT AS m, CASE WHEN second THEN 2 ELSE 1 END AS o, characters, total FROM y WHERE good QUALIFY row_number() OVER (PARTITION BY subject, kind, chunk ORDER BY characters, m <> em, m) = 1""")
def compact_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a stream by the plan of fewest characters that is off by 0.05 at most; total: what they decode to, in hundredths."""
    x = compact.encode(readings(spark, sf_dir), ["subject", "kind"], "t", {"v": compact.within(0.05)}, 20)
    x = x.select("*", F.col("v.m").alias("m"), F.col("v.o").alias("o"), (F.length(F.array_join(F.col("v.d").cast("array<string>"), ",")) + 1).cast("long").alias("characters"), F.col("n").alias("points"))
    back = compact.unpacked(x, ["subject", "kind", "chunk", "points", "m", "o", "characters"], ["t"], ["v"], compact.SAFE)
    total = F.aggregate("v", F.lit(0).cast("long"), lambda a, b: a + cents(b))
    return back.select("subject", "kind", "chunk", F.col("points").alias("n"), "m", "o", "characters", total.alias("total"))


@query(f"WITH {R} SELECT kind, id, ((row_number() OVER (PARTITION BY kind ORDER BY id) - 1) // 250)::INT AS chunk FROM r")
def chunk_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).select("kind", "id", codec.chunk_number(["kind"], "id", 250).alias("chunk"))


@query(f"""WITH {R} SELECT id, CASE id % 5 WHEN 0 THEN 'HeartRate' WHEN 1 THEN 'HeartRate' WHEN 2 THEN 'RunningPower' WHEN 3 THEN 'StepCount' ELSE 'CyclingCadence' END AS name FROM r""")
def stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.array(*(F.lit(x) for x in ("hr", "Heart-Rate", "power", "steps", "CyclingCadence")))
    return readings(spark, sf_dir).select("id", workouts.stream_name(F.get(asked, (F.col("id") % 5).cast("int"))).alias("name"))


@query(f"""WITH {U} SELECT subject, list_sort(list(c))[1 + floor((count(*) - 1) * 0.95)::BIGINT] AS p95, list_sort(list(c))[1 + floor((count(*) - 1) * 0.5)::BIGINT] AS p50, {up('stddev_samp(c) / avg(c)', 6)} AS variation FROM u GROUP BY 1""")
def percentiles_and_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = single(spark, sf_dir)
    variation = x.groupBy("subject").agg(half_up(coefficient_of_variation(F.col("c")), 6).alias("variation"))
    return daily.percentile_ranks(x, ["subject"], "c", {"p95": 0.95, "p50": 0.5}).join(variation, "subject")



METRICS = ("sleepAsleepMin", "restingHr", "steps", "walkingHrAvg", "walkingSpeed", "bodyMass", "envAudioLevel", "swimDistanceM", "stairUpSpeed", "other")


@query(f"""WITH {R}, m AS (SELECT id, [{', '.join(f"'{m}'" for m in METRICS)}][1 + id % 10] AS metric FROM r)
SELECT id, metric FROM m WHERE regexp_matches(metric, '^(restingHr|walkingHrAvg|steps|stair)|DistanceM$') OR (metric LIKE 'walking%' AND metric <> 'walkingHrAvg') OR metric = 'other'""")
def metric_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(m) for m in METRICS))
    x = readings(spark, sf_dir).select("id", F.get(names, (F.col("id") % 10).cast("int")).alias("metric"))
    return x.filter(daily.in_groups(F.col("metric"), ["heart", "activity", "mobility"], ["other"]))


# calendars and formulas -------------------------------------------------------------------------------------


@query(f"""WITH {R}, b AS (SELECT id, t, day, (make_timestamp(t * 1000) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS berlin FROM r)
SELECT id, day - 27 AS first, strftime(day, '%Y-%m') || CASE WHEN month(day) <> month(day + 20) THEN ',' || strftime(day + 20, '%Y-%m') ELSE '' END AS months, CAST(berlin AS DATE) AS berlin_day, hour(berlin)::INT AS berlin_hour,
  epoch_us((date_trunc('day', berlin) AT TIME ZONE 'Europe/Berlin')) // 1000 AS berlin_midnight, date_diff('year', DATE '1990-01-15', day)::INT - (strftime(day, '%m%d') < '0115')::INT AS age FROM b""")
def calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, day, tz = F.col("t"), F.col("day"), "Europe/Berlin"
    months = clock.months_overlapping(clock.day_start_ms(day), clock.day_start_ms(F.date_add(day, 21)))
    here = clock.local_day(t, tz)
    return readings(spark, sf_dir).select("id", clock.window_start(day, 4).alias("first"), F.array_join(months, ",").alias("months"), here.alias("berlin_day"), clock.local_hour(t, tz).alias("berlin_hour"), clock.local_range(here, here, tz)[0].alias("berlin_midnight"), clock.age_at(F.lit("1990-01-15").cast("date"), day).alias("age"))


@query(f"""WITH {R}, x AS (SELECT id, (id % 90)::DOUBLE AS minutes, v AS hr, (50 + id % 10)::DOUBLE AS rest, id % 2 = 0 AS female, CASE WHEN id % 3 = 0 THEN (id % 10)::DOUBLE END AS effort, CASE WHEN id % 3 = 1 THEN 30.0 + id % 40 END AS age, CASE WHEN id % 4 = 0 THEN 181.0 END AS given FROM r),
y AS (SELECT *, coalesce(given, floor(208 - 0.7 * age + 0.5), 190) AS top FROM x), f AS (SELECT *, least(1.0, (hr - rest) / (top - rest)) AS f FROM y)
SELECT id, top, {up("coalesce(CASE WHEN minutes > 0 AND hr > rest AND top > rest THEN minutes * f * 0.64 * exp(CASE WHEN female THEN 1.67 ELSE 1.92 END * f) END, CASE WHEN minutes > 0 THEN effort * minutes * 0.3 END, 0)", 4)} AS load,
  (1 + (hr >= 114)::INT + (hr >= 133)::INT + (hr >= 152)::INT + (hr >= 171)::INT)::INT AS zone FROM f""")
def workout_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("id"), F.col("v")
    top = selection.resolved_max_hr(F.when(i % 4 == 0, 181.0), F.lit(None).cast("double"), F.when(i % 3 == 1, 30.0 + i % 40))
    value = physics.load((i % 90).cast("double"), v, (50 + i % 10).cast("double"), top, i % 2 == 0, F.when(i % 3 == 0, (i % 10).cast("double")))
    return readings(spark, sf_dir).select("id", top.alias("top"), half_up(value, 4).alias("load"), physics.in_zone(v, physics.zone_bounds(190)).alias("zone"))


@query(f"""WITH {R}, x AS (SELECT id, floor(v) AS n, id % 2 = 0 AS f, CASE WHEN id % 3 = 0 THEN v / 1000 WHEN id % 3 = 1 THEN v / 10 ELSE v * 20 END AS h FROM r)
SELECT id, {up("CASE WHEN f THEN (n - 32) * 5 / 9 ELSE n END", 6)} AS celsius, {up("CASE WHEN h <= 1 THEN h * 100 WHEN h > 100 THEN h / 100 ELSE h END", 6)} AS humidity FROM x""")
def weather_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, v = F.col("id"), F.col("v")
    text = F.concat(F.floor(v).cast("string"), F.when(i % 2 == 0, " degF").otherwise(" degC"))
    h = F.when(i % 3 == 0, v / 1000).when(i % 3 == 1, v / 10).otherwise(v * 20)
    return readings(spark, sf_dir).select("id", half_up(physics.celsius(text), 6).alias("celsius"), half_up(physics.humidity_percent(h), 6).alias("humidity"))


@query(f"""WITH {R}, x AS (SELECT id, kind, (id % 7)::INT AS h, (id % 70)::INT AS m, (id % 60)::INT AS s FROM r), y AS (SELECT *, CASE WHEN m < 60 THEN h * 3600 + m * 60 + s END AS raw FROM x), z AS (SELECT *, CASE WHEN raw BETWEEN 600 AND 86400 THEN raw END AS seconds FROM y)
SELECT id, seconds, coalesce(id % 11 > 0 AND id % 5 > 0 AND seconds IS NOT NULL, false) AS valid, {{0}} AS per_km, {up("coalesce(12000 + id % 100, CASE WHEN abs((41 + id % 4) / 42.195 - 1) <= 0.03 THEN 13000 * 42.195 / (41 + id % 4) END)", 4)} AS prior FROM z""".replace("{0}", "CASE WHEN seconds IS NOT NULL THEN (floor(seconds / 42.195 + 0.5)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(seconds / 42.195 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') END").replace("coalesce(12000 + id % 100,", "coalesce(CASE WHEN id % 3 = 0 THEN 12000 + id % 100 END,"))
def race_goal_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = F.format_string("%d:%02d:%02d", (i % 7).cast("int"), (i % 70).cast("int"), (i % 60).cast("int"))
    race = F.when(i % 11 > 0, F.concat_ws("-", "kind", i.cast("string"))).otherwise("not a race")
    day = F.when(i % 5 > 0, F.lit("2024-02-29")).otherwise("2024-02-30")
    seconds = goal_seconds(text)
    prior = selection.prior_seconds(F.when(i % 3 == 0, (12_000 + i % 100).cast("double")), F.lit(13_000.0), (41 + i % 4).cast("double"))
    per = F.when(seconds.isNotNull(), pace(seconds / 42.195))
    return readings(spark, sf_dir).select("id", seconds.alias("seconds"), selection.valid_goal(race, day, seconds).alias("valid"), per.alias("per_km"), half_up(prior, 4).alias("prior"))


# choices and cleaning ---------------------------------------------------------------------------------------


@query(f"WITH {R} SELECT subject, day, id FROM r QUALIFY row_number() OVER (PARTITION BY subject, day ORDER BY id % 4 DESC, v DESC, id) = 1")
def richest_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", "day", "id", (F.col("id") % 4).alias("streams"), F.col("v").alias("km"))
    return selection.richest(x, ["subject", "day"]).select("subject", "day", "id")


@query(f"""WITH {U}, x AS (SELECT subject, day, c / 100.0::DOUBLE AS km FROM u WHERE c BETWEEN 4150 AND 4350 AND day >= DATE '2024-01-03' AND day < DATE '2024-01-28')
SELECT subject, day, km FROM x QUALIFY row_number() OVER (PARTITION BY subject ORDER BY day DESC, km DESC) = 1""")
def prior_long_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = single(spark, sf_dir).select("subject", "day", (F.col("c") / 100.0).alias("km"))
    day = lambda text: F.lit(text).cast("date")
    return selection.prior_marathon(x, day("2024-01-28"), day("2024-01-03"))


@query(f"""WITH {R}, x AS (SELECT subject, id::VARCHAR AS race, day, v * 500 AS metres FROM r WHERE kind = 'purchase' AND day >= DATE '2024-01-12')
SELECT subject, race, day FROM x QUALIFY row_number() OVER (PARTITION BY subject ORDER BY (metres BETWEEN 41500 AND 43500)::INT DESC, day, race) = 1""")
def next_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).filter("kind = 'purchase'").select("subject", F.col("id").cast("string").alias("race"), "day", (F.col("v") * 500).alias("metres"))
    return selection.next_race(x, F.lit("2024-01-12").cast("date")).select("subject", "race", "day")


@query(f"WITH {R}, x AS (SELECT subject, CASE WHEN v < 10 THEN 'too short' WHEN kind = 'error' THEN 'no data' END AS reason FROM r) SELECT subject, reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY 1, 2")
def skipped_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.skipped(readings(spark, sf_dir).withColumn("reason", F.when(F.col("v") < 10, "too short").when(F.col("kind") == "error", "no data")))


@query(f"WITH {R} SELECT subject, id, kind FROM r WHERE (kind = 'view' AND subject % 2 = 0) OR (kind = 'click' AND subject % 3 = 0)")
def consented_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    on = r.select("subject", F.explode(F.filter(F.array(F.when(F.col("subject") % 2 == 0, "view"), F.when(F.col("subject") % 3 == 0, "click")), lambda c: c.isNotNull())).alias("category"))
    return selection.consented(r, on, "kind").select("subject", "id", "kind")


@query(f"WITH {R}, s AS (SELECT subject, min(t) AS start FROM r GROUP BY 1) SELECT r.subject, id FROM r JOIN s ON s.subject = r.subject WHERE (t - start) / 1000.0 BETWEEN 3600 AND 259200")
def offset_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return selection.offset_window(r, r.groupBy("subject").agg(F.min("t").alias("start")), ["subject"], 3600, 259_200).select("subject", "id")


@query(f"""WITH {R}, x AS (SELECT *, NOT (v BETWEEN 30 AND 250) AS bad, v > 205 AS spike, CASE WHEN v BETWEEN 30 AND 250 THEN v END AS good FROM r),
o AS (SELECT subject, avg(bad::INT) > 0.05 OR avg((spike AND NOT bad)::INT) > 0.02 OR (count(good) >= 300 AND coalesce(stddev_samp(good), 0) < 1) AS unreliable FROM x GROUP BY 1)
SELECT x.subject, id, good AS v, unreliable FROM x JOIN o ON o.subject = x.subject""")
def clean_heart_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.clean_heart_rate(readings(spark, sf_dir), ["subject"], F.lit(200)).select("subject", "id", "v", "unreliable")


@query(f"""WITH {R}, l AS (SELECT subject, least(coalesce(lead(t) OVER (PARTITION BY subject ORDER BY t), t), t + 21600000) - t AS w FROM r), w AS (SELECT subject, sum(w) AS w FROM l WHERE w > 0 GROUP BY 1), m AS (SELECT subject, (max(t) - min(t)) AS m FROM r GROUP BY 1)
SELECT m.subject, CASE WHEN m > 0 THEN {up("least(1.0, coalesce(w, 0)::DOUBLE / m)", 6)} END AS share FROM m LEFT JOIN w ON w.subject = m.subject""")
def heart_rate_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    moving = r.groupBy("subject").agg(((F.max("t") - F.min("t")) / 1000).alias("moving"))
    x = selection.heart_rate_coverage(series.weights(r, ["subject"], cap_ms=6 * HOUR), moving, ["subject"])
    return x.withColumn("share", half_up(F.col("share"), 6))


@query(f"""WITH {R}, m AS (SELECT subject, median(v) FILTER (id % 10 > 0 AND v > 0) AS m FROM r GROUP BY 1) SELECT r.subject, id FROM r JOIN m ON m.subject = r.subject WHERE id % 10 = 0 OR m IS NULL OR v BETWEEN m / 2 AND m * 2""")
def clean_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", "id", F.col("v").alias("pace"), (F.col("id") % 10 == 0).alias("partial"))
    return selection.clean_splits(x, ["subject"]).select("subject", "id")


@query(f"""WITH {R}, p AS (SELECT subject, t // 3600000 AS t, v - 60 AS lat, CASE WHEN id % 50 = 0 THEN 'nan'::DOUBLE ELSE v - 100 END AS lon FROM r)
SELECT * FROM p WHERE abs(lat) <= 90 AND NOT isnan(lon) AND abs(lon) <= 180 QUALIFY row_number() OVER (PARTITION BY subject, t ORDER BY lat, lon) = 1""")
def valid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).select("subject", F.floor(F.col("t") / HOUR).alias("t"), (F.col("v") - 60).alias("lat"), F.when(F.col("id") % 50 == 0, float("nan")).otherwise(F.col("v") - 100).alias("lon"))
    return selection.valid_points(x)


# joins in time ----------------------------------------------------------------------------------------------


@query(f"""WITH {R}, i AS (SELECT subject, t AS s, t + 172800000 AS e FROM r WHERE kind = 'view'), n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY subject ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM n), m AS (SELECT subject, k, min(s) AS s, max(e) AS e FROM k GROUP BY 1, 2)
SELECT subject, bool_or(s <= 1704844800000 AND e >= 1705104000000) AS covered FROM m GROUP BY 1""")
def covered_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = readings(spark, sf_dir).filter("kind = 'view'").select("subject", F.col("t").alias("s"), (F.col("t") + 2 * DAY).alias("e"))
    return intervals.covers(x, ["subject"], F.lit(1_704_844_800_000), F.lit(1_705_104_000_000))


@query(f"""WITH {R}, w AS (SELECT subject, id, t AS a, t + 43200000 AS b FROM r WHERE kind = 'purchase'), i AS (SELECT subject, t AS s, t + 3600000 AS e FROM r WHERE kind = 'view')
SELECT w.subject, w.id, coalesce(sum(greatest(least(b, e) - greatest(a, s), 0)), 0)::BIGINT AS inside FROM w LEFT JOIN i ON i.subject = w.subject GROUP BY 1, 2""")
def overlap_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    w = r.filter("kind = 'purchase'").select("subject", "id", F.col("t").alias("a"), (F.col("t") + 12 * HOUR).alias("b"))
    i = r.filter("kind = 'view'").select("subject", F.col("t").alias("s"), (F.col("t") + HOUR).alias("e"))
    return intervals.overlap_sums(w, i, ["subject"]).select("subject", "id", F.col("inside").cast("long").alias("inside"))


@query(f"""WITH {U}, w AS (SELECT subject, id, t AS a, t + 259200000 AS b FROM u WHERE kind = 'purchase') SELECT w.subject, w.id, {up("avg(c)", 4)} AS mean FROM w LEFT JOIN u ON u.subject = w.subject AND u.kind = 'view' AND u.t >= a AND u.t < b GROUP BY 1, 2""")
def mean_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    w = u.filter("kind = 'purchase'").select("subject", "id", F.col("t").alias("a"), (F.col("t") + 3 * DAY).alias("b"))
    x = series.mean_within(u.filter("kind = 'view'").select("subject", "t", F.col("c").alias("v")), w, ["subject"])
    return x.select("subject", "id", half_up(F.col("mean"), 4).alias("mean"))


@query(f"WITH {R} SELECT e.subject, e.id, w.id AS wid FROM r e JOIN r w ON w.subject = e.subject AND w.kind = 'purchase' AND e.kind = 'view' AND e.t >= w.t - 129600000 AND e.t < w.t")
def before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    w = r.filter("kind = 'purchase'").select("subject", F.col("id").alias("wid"), F.col("t").alias("s"))
    return workouts.before_workouts(r.filter("kind = 'view'"), w, 36).select("subject", "id", "wid")


@query(f"WITH {R} SELECT subject, id AS wid FROM r w WHERE kind = 'purchase' AND EXISTS (SELECT 1 FROM r e WHERE e.kind = 'click' AND e.subject = w.subject AND e.t >= w.t AND e.t <= w.t + 86400000)")
def entries_during(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    w = r.filter("kind = 'purchase'").select("subject", F.col("id").alias("wid"), F.col("t").alias("s"), (F.col("t") + DAY).alias("e"))
    return workouts.during_workouts(r.filter("kind = 'click'").select("subject", "t"), w).select("subject", "wid")


@query(f"""WITH {U}, m AS (SELECT subject, day, max(c) AS value FROM u WHERE kind = 'view' GROUP BY 1, 2)
SELECT u.subject, u.id, a.value AS same_day, b.value AS day_before FROM u LEFT JOIN m a ON a.subject = u.subject AND a.day = u.day LEFT JOIN m b ON b.subject = u.subject AND b.day + 1 = u.day WHERE u.kind = 'purchase'""")
def day_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    m = u.groupBy("subject", "day", F.col("kind").alias("metric")).agg(F.max("c").alias("value"))
    return workouts.with_day_context(u.filter("kind = 'purchase'"), m, "view").select("subject", "id", "same_day", "day_before")


@query(f"""WITH {U}, n AS (SELECT subject, sum(c)::BIGINT AS total, count(*) AS n FROM u WHERE day >= DATE '2024-01-15' GROUP BY 1), p AS (SELECT subject, sum(c)::BIGINT AS total, count(*) AS n FROM u WHERE day < DATE '2024-01-15' GROUP BY 1)
SELECT n.subject, n.total, n.n, p.total AS total_prior, p.n AS n_prior, {up("100 * (n.total - p.total)::DOUBLE / CASE WHEN p.total <> 0 THEN p.total END", 1)} AS total_change, {up("100 * (n.n - p.n)::DOUBLE / CASE WHEN p.n <> 0 THEN p.n END", 1)} AS n_change FROM n LEFT JOIN p ON p.subject = n.subject""")
def block_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir)
    block = lambda x: x.groupBy("subject").agg(F.sum("c").alias("total"), F.count("*").alias("n"))
    return health.block_comparison(block(u.filter("day >= '2024-01-15'")), block(u.filter("day < '2024-01-15'")), ["total", "n"])


@query(f"""WITH {R} SELECT w.subject, w.id AS wid, coalesce(x.complete, false) AS complete FROM r w LEFT JOIN (SELECT subject, id + 1 AS wid, v > 50 AS complete FROM r WHERE id % 2 = 0) x ON x.subject = w.subject AND x.wid = w.id WHERE w.kind = 'purchase'""")
def raw_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    index = r.filter("id % 2 = 0").select("subject", (F.col("id") + 1).alias("wid"), (F.col("v") > 50).alias("complete"))
    return health.with_raw_index(r.filter("kind = 'purchase'").select("subject", F.col("id").alias("wid")), index)


# questions about days ---------------------------------------------------------------------------------------


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings as stored rows: a daily upload for each, an hour and an entry of a quarter of an hour for each, two sources."""
    r = single(spark, sf_dir)
    base = ["subject", "id", "t", "c", "kind", "day"]
    upload = r.select(*base, F.lit("day").alias("k"), F.to_json(F.struct(F.create_map("kind", "c").alias("m"))).alias("extra"))
    hour = r.select(*base, F.lit("hs").alias("k"), F.lit(None).cast("string").alias("extra"))
    entry = r.select(*base, F.lit("ev").alias("k"), F.lit(None).cast("string").alias("extra"))
    x = upload.unionByName(hour).unionByName(entry)
    v = F.col("c").cast("double")
    return x.select("subject", "k", F.when(F.col("k") == "day", F.col("day").cast("string")).alias("id"), F.when(F.col("k") == "hs", F.floor(F.col("t") / HOUR) * HOUR).otherwise(F.floor(F.col("t") / 60_000) * 60_000).alias("s"), v.alias("v"), v.alias("v2"), v.alias("v3"), F.col("kind").alias("agg"), F.when(F.col("id") % 2 == 0, "app").otherwise("watch").alias("src"), "extra", F.col("id").alias("seq"), F.lit("b").alias("batch"))


#: tidy() as SQL.
def _tidy(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 1000 THEN {up(x, 0)} WHEN abs({x}) >= 10 THEN {up(x, 1)} ELSE {up(x, 2)} END"


@query(f"""WITH {U}, m AS (SELECT subject, day, kind AS metric, arg_max(c, id) AS value FROM u WHERE kind IN ('view', 'click') AND day BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' GROUP BY 1, 2, 3)
SELECT subject, metric, CAST(date_trunc('week', day) AS DATE) AS start, {_tidy("avg(value)")} AS mean, count(*) AS days FROM m GROUP BY 1, 2, 3""")
def weekly_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily context of named metrics, rolled up to weeks, from stored uploads."""
    return health.daily_context(health.daily_metrics(stored(spark, sf_dir)), "2024-01-03", "2024-01-24", metrics=["view", "click"], rollup="week")


@query(f"""WITH {U}, h AS (SELECT subject, CAST((make_timestamp(t // 3600000 * 3600000000) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin' AS DATE) AS day, c FROM u WHERE kind = 'view')
SELECT subject, day, {_tidy("avg(c)")} AS value, {_tidy("min(c)")} AS low, {_tidy("max(c)")} AS high, count(*) AS hours FROM h WHERE day BETWEEN DATE '2024-01-03' AND DATE '2024-01-24' GROUP BY 1, 2""")
def hours_by_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.hourly(stored(spark, sf_dir), "view", "2024-01-03", "2024-01-24", "Europe/Berlin", by_day=True)


@query(f"""WITH {U}, e AS (SELECT subject, CASE WHEN id % 2 = 0 THEN 'app' ELSE 'watch' END AS src, t // 60000 AS minute, max(c) FILTER (kind = 'view')::DOUBLE AS view, max(c) FILTER (kind = 'click')::DOUBLE AS click FROM u WHERE kind IN ('view', 'click') GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY minute, src) AS i, count(*) OVER (PARTITION BY subject) AS n FROM e) SELECT subject, src, minute, view, click, n > 20 AS truncated FROM n WHERE i <= 20""")
def nutrition_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.nutrition_log(stored(spark, sf_dir), ["view", "click"], most=20)


@query(f"""WITH {U}, g AS (SELECT subject, id::VARCHAR AS race, day, 42195.0::DOUBLE AS metres, c AS seconds FROM u WHERE kind = 'purchase' AND c BETWEEN 600 AND 86400)
SELECT *, date_diff('day', DATE '2024-01-01', day) AS days_to_go, (floor(seconds / metres * 1000 + 0.5)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(seconds / metres * 1000 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS per_km,
  (floor(seconds / metres * 1609.344 + 0.5)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(seconds / metres * 1609.344 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS per_mile FROM g""")
def race_goals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = single(spark, sf_dir).filter("kind = 'purchase' and c between 600 and 86400")
    goals = u.select("subject", F.col("id").cast("string").alias("race"), "day", F.lit(42_195.0).alias("metres"), F.col("c").alias("seconds"))
    return health.race_goals(goals, "2024-01-01").withColumn("days_to_go", F.col("days_to_go").cast("long"))


@query("SELECT user_id AS uid, time_bucket(INTERVAL 1 MINUTE, ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def calls_per_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming count of calls in fixed minutes, over the table at once."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("uid"), "ts")
    return live_minutes(e).select("uid", F.col("window.start").alias("minute"), "n")
