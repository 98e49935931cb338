"""Queries that run whole plans over data that Spark derives from the driver's tables, each with its SQL twin.

An order stands for a run: its price for kilometres and pace; fifty runners share them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.numbers import half_up
from paceline.operators import compare, lifetime, product, rollup
from paceline.plans import pages, readiness
from paceline.plans.queries import ORACLES, QUERIES, R, cents, load, query, readings, up
from paceline.sources import retire, shared

__all__ = ["ORACLES", "QUERIES"]

#: Runs as SQL.
L = """a AS (SELECT o_custkey % 50 AS subject, o_orderkey AS wid, CAST(o_orderdate AS DATE) AS day, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders),
b AS (SELECT subject, wid, day, (1 + cents % 50)::DOUBLE AS km, wid % 3 = 0 AS chosen, 240 + cents // 50 % 120 AS pace FROM a), l AS (SELECT subject, wid, day, km, km * pace AS seconds, chosen AND km IN (5, 10, 21) AS tagged FROM b)"""


def order_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """runs as in paceline.plans.readiness, known by their summaries only."""
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("long")
    km, day = (1 + cents % 50).cast("double"), F.col("o_orderdate").cast("date")
    unknown = {"avg_hr": "double", "max_hr": "double", "temp": "double", "hr_coverage": "double", "unreliable": "boolean", "decoupling": "double", "gain_per_km": "double", "first_half": "double", "second_half": "double", "carbs": "boolean"}
    return load(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("subject"), F.col("o_orderkey").alias("wid"), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long").alias("s"), day.alias("day"), km.alias("km"), (km * (240 + F.floor(cents / 50) % 120)).alias("seconds"),
        F.lit(False).alias("indoor"), ((F.col("o_orderkey") % 3 == 0) & km.isin(5.0, 10.0, 21.0)).alias("tagged"), F.lit(False).alias("analysed"), *(F.lit(None).cast(t).alias(k) for k, t in unknown.items()),
    )


#: Events as calls of their users, and the sums of the days of a rollup.
@query(f"""WITH r AS (SELECT user_id AS uid, event_type AS provider, event_id % 7 <> 0 AS ok, epoch_us(ts) // 1000 AS at, CAST(floor(value * 100 + 0.5) AS BIGINT) AS ms, CAST(ts AS DATE) AS day FROM events),
w AS (SELECT * FROM r WHERE day BETWEEN (SELECT max(day) FROM r) - 39 AND (SELECT max(day) FROM r)),
k AS (SELECT *, {' '.join(f'(ms > {x})::INT +' for x in product.BUCKETS_MS[:-1])} 0 AS bucket FROM w),
d AS (SELECT provider, day, count(DISTINCT uid) FILTER (ok) AS active FROM w GROUP BY 1, 2), a AS (SELECT provider, sum(active)::BIGINT AS active_days FROM d GROUP BY 1),
h AS (SELECT provider, bucket, count(*) AS n FROM k GROUP BY 1, 2), c AS (SELECT provider, bucket, sum(n) OVER (PARTITION BY provider ORDER BY bucket) AS seen, sum(n) OVER (PARTITION BY provider) AS total FROM h),
p AS (SELECT provider, ([{', '.join(map(str, product.BUCKETS_MS))}])[min(bucket) + 1]::BIGINT AS p95 FROM c WHERE seen >= ceil(total * 0.95) GROUP BY 1)
SELECT w.provider AS key, count(DISTINCT day) AS days, any_value(active_days) AS active_days, count(*) AS calls, count(*) FILTER (ok) AS successes, sum(ms)::BIGINT AS duration_ms, any_value(p95) AS p95 FROM w JOIN a ON a.provider = w.provider JOIN p ON p.provider = w.provider GROUP BY 1""")
def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last forty days by provider, from a rollup that was written and read again."""
    r = readings(spark, sf_dir)
    access = r.select(F.col("subject").alias("uid"), F.col("kind").alias("provider"), (F.col("id") % 7 != 0).alias("ok"), F.col("t").alias("at"), cents(F.col("v")).alias("ms"))
    steps = ["opened"]
    users = spark.createDataFrame([], "uid long, deleting boolean, opened long, activated long, provider string, app_version string")
    events = spark.createDataFrame([], "id long, name string, at long, app_version string, outcome string, duration_ms long")
    path = f"{shared.new_folder(spark, 'rollup')}/days"
    rollup.rebuild(users, access, events, steps, path, r.agg(F.max("t")).first()[0])
    x = rollup.spans(rollup.stored(spark, path), "provider")
    of = lambda name: F.col("counts")[name]
    return x.select("key", "days", of("active").alias("active_days"), of("calls").alias("calls"), of("successes").alias("successes"), of("duration_ms").alias("duration_ms"), rollup.percentile(F.col("buckets"), 0.95).cast("long").alias("p95"))


def _minutes(km: str, pace: str) -> str:
    return f"(11.03 + 98.46 * exp(-0.0053 * {km}) + 0.387 * {pace} + 0.1 * exp(0.23 * 15))"


def _volumes(end: str) -> str:
    """Sums over the weeks that end with a day, as SQL."""
    season, formula = f"day BETWEEN {end} - 83 AND {end}", f"day BETWEEN {end} - 55 AND {end}"
    return f"coalesce(sum(km) FILTER ({season}), 0) / 12 AS km12, count(*) FILTER ({season} AND km >= 30) AS long12, coalesce(sum(km) FILTER ({formula}), 0) / 8 AS km8, sum(seconds) FILTER ({formula}) / sum(km) FILTER ({formula}) AS pace8, count(DISTINCT date_trunc('week', day)) FILTER ({formula}) AS weeks8"


def _gap(name: str, first: str, join: str) -> str:
    return f"""{name} AS (SELECT "case", greatest(max(step), date_diff('day', max(day), any_value(as_of))) AS gap FROM (SELECT *, date_diff('day', coalesce(lag(day) OVER (PARTITION BY "case" ORDER BY day), {first}), day) AS step
  FROM (SELECT DISTINCT h."case", h.as_of, h.day{', e.day AS eday' if join else ''} FROM h {join} WHERE h.day >= {first.replace('eday', 'e.day')})) GROUP BY 1)"""


@query(f"""WITH {L}, c AS (SELECT subject || '/' || wid AS "case", subject, day AS race_day, day - 14 AS as_of, seconds * CASE WHEN abs(km * 1000 - 42195) / 42195 <= 0.03 THEN 42195 / (km * 1000) ELSE 1 END AS actual FROM l WHERE km BETWEEN 41.5 AND 43.5),
h AS (SELECT c.*, l.day, l.km, l.seconds, l.tagged FROM c JOIN l ON l.subject = c.subject AND l.day <= c.as_of),
t AS (SELECT *, date_diff('day', day, as_of) / 7.0::DOUBLE AS age, CASE WHEN km >= 18 THEN 0 WHEN km >= 8 THEN 1 ELSE 2 END AS class FROM h WHERE tagged),
s AS (SELECT * FROM t WHERE day >= as_of - 111 QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY class, age, seconds) = 1),
e AS (SELECT * FROM t WHERE day BETWEEN as_of - 251 AND as_of - 112 QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY class, age, seconds) = 1),
v AS (SELECT "case", {_volumes('as_of')}, count(DISTINCT date_trunc('week', day)) FILTER (day >= as_of - 111) AS weeks FROM h GROUP BY 1),
w AS (SELECT h."case", {_volumes('(eday - 1)')} FROM (SELECT h.*, e.day AS eday FROM h JOIN e ON e."case" = h."case") h GROUP BY 1),
{_gap('g', 'as_of - 111', '')}, {_gap('ge', 'eday + 1', 'JOIN e ON e."case" = h."case"')},
x AS (SELECT v.*, log2(2.19) + CASE WHEN km12 >= 90 AND long12 >= 3 THEN -0.02 WHEN km12 < 50 THEN 0.02 ELSE 0 END AS r FROM v),
m AS (SELECT "case", age, class, CASE WHEN class = 0 THEN seconds * pow(21097.5 / (km * 1000), 1.06) ELSE seconds * pow(21097.5 / (km * 1000), 1.06) END * pow(2, r) AS seconds, CASE class WHEN 0 THEN CASE WHEN age <= 8 THEN 3.5 ELSE 5 END WHEN 1 THEN 5 ELSE 7 END AS sigma, 'race' AS name FROM s JOIN x USING ("case")),
k AS (SELECT e."case", x.km12 >= 0.9 * w.km12 AND coalesce(ge.gap, date_diff('day', e.day + 1, e.as_of)) <= 14 AS kept, CASE WHEN x.km8 > 0 AND w.km8 > 0 THEN {_minutes('x.km8', 'x.pace8')} / {_minutes('w.km8', 'w.pace8')} END AS ratio, e.seconds * pow(21097.5 / (e.km * 1000), 1.06) * pow(2, r) AS base, e.age
  FROM e JOIN x ON x."case" = e."case" JOIN w ON w."case" = e."case" LEFT JOIN ge ON ge."case" = e."case"),
n AS (SELECT "case", seconds, sigma, name FROM m UNION ALL SELECT "case", base * CASE WHEN kept AND ratio IS NOT NULL THEN greatest(1 / 1.05, ratio) ELSE 1 END, 6.5 + 0.1 * greatest(0, age - 16) + CASE WHEN kept THEN 0 ELSE 2 END + 1, 'earlier race' FROM k
  UNION ALL SELECT "case", 60 * {_minutes('km8', 'pace8')}, 7, 'training' FROM x WHERE weeks8 >= 6),
o AS (SELECT *, 1 / pow(seconds * sigma / 100, 2) AS w, sum(seconds / pow(seconds * sigma / 100, 2)) OVER p / sum(1 / pow(seconds * sigma / 100, 2)) OVER p AS c FROM n WINDOW p AS (PARTITION BY "case")),
q AS (SELECT "case", any_value(c) AS central, greatest(sqrt(1 / sum(w)), 0.85 * min(seconds * sigma / 100)) AS own, sqrt(sum(w * pow(seconds - c, 2)) / sum(w)) AS spread, bool_or(name <> 'training') AS personal, string_agg(name, ', ' ORDER BY name) AS estimates FROM o GROUP BY 1),
z AS (SELECT c.*, coalesce(x.weeks, 0) AS weeks, coalesce(g.gap, 111) AS gap, q.estimates, coalesce(x.weeks >= 6 AND personal, false) AS ok, central * (1 + CASE WHEN long12 < 2 THEN 2 WHEN long12 = 2 THEN 1 ELSE 0 END / 100.0::DOUBLE) AS forecast, sqrt(own * own + spread * spread + pow(0.02 * central, 2)) AS sigma,
  CASE WHEN s.class IS NULL THEN CASE WHEN e.class IS NULL THEN 0 ELSE 12 END WHEN s.age <= 8 AND s.class = 0 THEN 25 WHEN s.age <= 8 AND s.class = 1 THEN 18 ELSE 10 END AS p1,
  EXISTS (SELECT 1 FROM h WHERE h."case" = c."case" AND h.km BETWEEN 41.5 AND 43.5 AND h.day >= c.as_of - INTERVAL 36 MONTH AND h.day < c.as_of AND abs(h.km / 42.195 - 1) <= 0.03) AS before
  FROM c LEFT JOIN x ON x."case" = c."case" LEFT JOIN g ON g."case" = c."case" LEFT JOIN q ON q."case" = c."case" LEFT JOIN s ON s."case" = c."case" LEFT JOIN e ON e."case" = c."case")
SELECT "case", subject, race_day, as_of, {up('actual', 3)} AS actual, CASE WHEN ok THEN 'ok' ELSE 'insufficient_data' END AS status, CASE WHEN ok THEN {up('forecast', 3)} END AS forecast, CASE WHEN ok THEN {up('forecast - 1.2816 * sigma', 3)} END AS low, CASE WHEN ok THEN {up('forecast + 1.2816 * sigma', 3)} END AS high,
  CASE WHEN ok THEN {up('100 * (floor(forecast + 0.5) - floor(actual + 0.5)) / actual', 2)} END AS error_pct, CASE WHEN ok THEN floor(actual + 0.5) BETWEEN floor(forecast - 1.2816 * sigma + 0.5) AND floor(forecast + 1.2816 * sigma + 0.5) END AS inside_80,
  floor({up("15 * least(1, weeks / 12.0::DOUBLE) * CASE WHEN gap > 10 THEN 0.5 ELSE 1 END", 1)} + p1 + CASE WHEN before THEN 3 ELSE 0 END + 10 + 0.5)::BIGINT AS confidence FROM z""")
def marathon_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would have been forecast two weeks before each past marathon, from the runs until then."""
    nothing = lambda schema: spark.createDataFrame([], schema)
    splits = nothing("subject long, wid long, split int, pace double, hr double, gain double, partial boolean")
    efforts, mass = nothing("subject long, wid long, metres double, seconds double, hr double"), nothing("subject long, day date, kg double")
    x = readiness.backtest(order_runs(spark, sf_dir), splits, efforts, mass)
    return x.select("case", "subject", "race_day", "as_of", half_up(F.col("actual"), 3).alias("actual"), "status", *(half_up(F.col(k), 3).alias(k) for k in ("forecast", "low", "high")), "error_pct", "inside_80", F.col("confidence").cast("long").alias("confidence"))


def _pairing(names: str, chained: list[list[str]]) -> str:
    """The rounds of a comparison as SQL, from x0 (id, side, user, day, level, c_level): for each set of fields that may differ, rows that agree in the others are paired along their order."""
    out = []
    for k, agree in enumerate(chained):
        group = ", ".join(["subject", *agree])
        joined = " AND ".join(f"a.{g} = b.{g}" for g in ["subject", *agree])
        kept = " AND ".join({"c_level": "abs(a.level - b.level) <= 0.5"}.get(g, f"a.{g} = b.{g}") for g in agree) or "true"
        out.append(f"""n{k} AS (SELECT *, row_number() OVER (PARTITION BY side, {group} ORDER BY {names}, id) AS rn FROM x{k}),
p{k} AS (SELECT a.subject, a.id AS ida, b.id AS idb, a.day AS day0, b.day AS day1, a.hour AS hour0, b.hour AS hour1, a.level AS level0, b.level AS level1 FROM n{k} a JOIN n{k} b ON a.side = 0 AND b.side = 1 AND a.rn = b.rn AND {joined} WHERE {kept}),
x{k + 1} AS (SELECT * FROM x{k} WHERE NOT EXISTS (SELECT 1 FROM p{k} WHERE x{k}.id IN (ida, idb)))""")
    return ",\n".join(out)


_ROUNDS = _pairing("day, hour, level", [["day", "hour", "c_level"], ["hour", "c_level"], ["day", "c_level"], ["day", "hour"], ["c_level"], ["hour"], ["day"], []])


#: Views of each user against clicks, as two versions of one table; levels count as equal within half a unit.
@query(f"""WITH {R}, v AS (SELECT subject, day - CAST((day - DATE '2024-01-01') % 7 AS INTEGER) AS day, t // 3600000 % 4 AS hour, floor(v / 10) / 4 AS level, kind FROM r WHERE kind IN ('view', 'click')),
u AS (SELECT subject, day, hour, level, 0 AS side FROM (SELECT subject, day, hour, level FROM v WHERE kind = 'view' EXCEPT ALL SELECT subject, day, hour, level FROM v WHERE kind = 'click') UNION ALL
  SELECT subject, day, hour, level, 1 FROM (SELECT subject, day, hour, level FROM v WHERE kind = 'click' EXCEPT ALL SELECT subject, day, hour, level FROM v WHERE kind = 'view')),
g AS (SELECT *, row_number() OVER () AS id, CASE WHEN level - lag(level) OVER (PARTITION BY subject ORDER BY level) <= 0.5 THEN 0 ELSE 1 END AS new FROM u),
x0 AS MATERIALIZED (SELECT id, side, subject, day, hour, level, sum(new) OVER (PARTITION BY subject ORDER BY level) AS c_level FROM g),
{_ROUNDS},
p AS ({' UNION ALL '.join(f'SELECT * FROM p{k}' for k in range(8))}),
f AS (SELECT subject, 'day' AS field, day0::VARCHAR AS before, day1::VARCHAR AS after FROM p WHERE day0 <> day1 UNION ALL SELECT subject, 'hour', hour0::VARCHAR, hour1::VARCHAR FROM p WHERE hour0 <> hour1 UNION ALL SELECT subject, 'level', level0::VARCHAR, level1::VARCHAR FROM p WHERE abs(level0 - level1) > 0.5)
SELECT subject, field, before, after, count(*) AS n FROM f GROUP BY 1, 2, 3, 4""")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """field, before, after of what changed from a user's views to the clicks, as far as rows of both can be paired."""
    r = readings(spark, sf_dir)
    week = F.date_sub("day", F.datediff("day", F.lit("2024-01-01").cast("date")) % 7)
    x = r.select("kind", "subject", week.alias("day"), (F.floor(F.col("t") / 3_600_000) % 4).alias("hour"), (F.floor(F.col("v") / 10) / 4).alias("level"))
    of = lambda kind: x.filter(F.col("kind") == kind).drop("kind")
    return compare.field_changes(compare.matched(of("view"), of("click"), ["subject"], tolerance=0.5), ["subject"])


@query("""WITH l AS (SELECT l_orderkey AS wid, (l_linenumber - 1) // 2 AS b, l_linenumber AS line, l_returnflag AS purpose, l_linestatus AS goal, l_quantity AS value FROM lineitem), o AS (SELECT DISTINCT wid FROM l),
i AS (SELECT wid, 0 AS b, 0 AS s, 'warmup' AS purpose, NULL::INT AS repeats, NULL::VARCHAR AS goal, NULL::DOUBLE AS value FROM o WHERE wid % 2 = 0 UNION ALL SELECT wid, 99, 0, 'cooldown', NULL, 'open', NULL FROM o WHERE wid % 3 = 0
  UNION ALL SELECT wid, b + 1, 0, 'block', greatest(count(*) % 4, 1)::INT, NULL, NULL FROM l GROUP BY wid, b UNION ALL SELECT wid, b + 1, row_number() OVER (PARTITION BY wid, b ORDER BY line, purpose, goal, value), purpose, NULL, goal, value FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY wid ORDER BY b, s) AS node FROM i)
SELECT wid, node::INT AS node, CASE WHEN s > 0 THEN node - s END::INT AS parent, CASE WHEN s > 0 THEN 2 ELSE 1 END AS depth, purpose, repeats, goal, value FROM n""")
def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as steps of a plan, two line numbers a block, kept as JSON and read as a tree."""
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("wid"), F.floor((F.col("l_linenumber") - 1) / 2).alias("b"), F.struct("l_linenumber", F.col("l_returnflag").alias("purpose"), F.col("l_linestatus").alias("goal"), F.col("l_quantity").alias("value")).alias("step"))
    blocks = lines.groupBy("wid", "b").agg(F.struct("b", (F.count("*") % 4).cast("int").alias("iterations"), F.sort_array(F.collect_list("step")).alias("steps")).alias("block"))
    whole = blocks.groupBy("wid").agg(F.sort_array(F.collect_list("block")).alias("blocks"))
    only = lambda n, name, goal: F.when(F.col("wid") % n == 0, F.struct(F.lit(name).alias("purpose"), F.lit(goal).cast("string").alias("goal"))).alias(name)
    plan = F.to_json(F.struct(F.lit("custom").alias("kind"), only(2, "warmup", None), "blocks", only(3, "cooldown", "open")))
    x = pages.plan_steps(whole.select(F.lit("u").alias("subject"), "wid", plan.alias("plan")))
    return x.select("wid", "node", "parent", "depth", "purpose", "repeats", "goal", "value")


#: The readings of a user in ten days as points of a route, as SQL, and pages of them.
_PAGES = f"""{R}, p AS (SELECT DISTINCT subject, t // 864000000 AS wid, t FROM r), n AS (SELECT *, (row_number() OVER (PARTITION BY subject, wid ORDER BY t) - 1) // 10 + 1 AS page FROM p),
g AS (SELECT subject, wid, page, count(*) AS points, min(t) AS first, max(t) AS last FROM n GROUP BY 1, 2, 3)"""


def _route(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    x = r.select("subject", F.floor(F.col("t") / 864_000_000).alias("wid"), "t", (50 + F.col("v") / 1e5).alias("lat"), F.lit(8.0).alias("lon"), F.lit(None).cast("double").alias("alt"))
    return pages.shown_points(x, full=True)


@query(f"WITH {_PAGES} SELECT subject, wid, page, points, first, last, lag(last) OVER w AS after, CASE WHEN lead(last) OVER w IS NOT NULL THEN last END AS next_after FROM g WINDOW w AS (PARTITION BY subject, wid ORDER BY page)")
def route_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.pages(_route(spark, sf_dir), 10)


@query(f"""WITH {_PAGES} SELECT n.subject, n.wid, n.t, a.last AS after, CASE WHEN c.page IS NOT NULL THEN b.last END AS next_after FROM n JOIN g a ON a.subject = n.subject AND a.wid = n.wid AND a.page = 1 AND n.page = 2
JOIN g b ON b.subject = n.subject AND b.wid = n.wid AND b.page = 2 LEFT JOIN g c ON c.subject = n.subject AND c.wid = n.wid AND c.page = 3""")
def route_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the second page of each route, asked for with the cursor of the first."""
    points = _route(spark, sf_dir)
    asked = pages.pages(points, 10).filter("page = 1 and next_after is not null").select("subject", "wid", F.col("next_after").alias("after"))
    return pages.page_after(points, asked, 10).select("subject", "wid", "t", "after", "next_after")


@query(f"""WITH {R}, x AS (SELECT subject, t // 864000000 AS wid, t, kind, kind = 'view' AS o, (id % 50)::DOUBLE AS dur FROM r),
y AS (SELECT *, count(*) FILTER (o) OVER w AS segments, count(*) FILTER (NOT o) OVER w AS listed, row_number() OVER (PARTITION BY subject, wid ORDER BY o, t, kind, dur) AS place FROM x WINDOW w AS (PARTITION BY subject, wid))
SELECT subject, wid, CASE WHEN NOT o THEN place END::INT AS place, CASE WHEN NOT o THEN {up('(t - wid * 864000000) / 1000.0::DOUBLE', 1)} END AS offset_seconds, CASE WHEN NOT o THEN kind END AS type, CASE WHEN NOT o THEN dur END AS duration_seconds, listed > 5 AS truncated, segments
FROM y WHERE CASE WHEN listed = 0 THEN place = 1 ELSE NOT o AND place <= 5 END""")
def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five events of each user in ten days that are no views."""
    r = readings(spark, sf_dir).withColumn("wid", F.floor(F.col("t") / 864_000_000))
    events = r.select("subject", "wid", "t", F.col("kind").alias("type"), (F.col("id") % 50).cast("double").alias("dur"))
    return pages.listed_events(events, r.select("subject", "wid", (F.col("wid") * 864_000_000).alias("s")).distinct(), most=5, omitted="view")


@query(f"WITH {R} SELECT kind, kind NOT IN ('view', 'click') AS retired, count(*) AS n, sum(id)::BIGINT AS ids FROM r GROUP BY 1")
def retired_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stored by kind, of which two kinds are still read: the others are copied, verified and removed. Rows of the store, and of the copies."""
    store, backup = f"{shared.new_folder(spark, 'store')}/events", shared.new_folder(spark, "backup")
    readings(spark, sf_dir).select("id", "kind").write.partitionBy("kind").parquet(store)
    known = ["kind=view", "kind=click"]
    manifest = retire.back_up(spark, store, known, backup)
    retire.remove(spark, store, known, manifest)
    copies = manifest.removesuffix("/manifest") + "/data"
    rows = lambda path, gone: spark.read.parquet(path).withColumn("retired", F.lit(gone))
    x = rows(store, False).unionByName(rows(copies, True))
    return x.groupBy("kind", "retired").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(f"""WITH {R}, w AS (SELECT subject, id // 4 AS id, id AS seq, t, kind, (id % 90 * 60)::DOUBLE AS seconds, CASE id % 3 WHEN 0 THEN id % 500 WHEN 1 THEN id % 500 / 100.0::DOUBLE ELSE 0 END AS climb, 100 + id % 60 AS hr FROM r WHERE kind <> 'error'),
g AS (SELECT subject, id // 4 AS id, max(id) AS gone FROM r WHERE kind = 'error' GROUP BY 1, 2), l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY subject, id ORDER BY seq DESC) = 1),
c AS (SELECT l.* FROM l LEFT JOIN g ON g.subject = l.subject AND g.id = l.id WHERE gone IS NULL OR seq > gone),
a AS (SELECT subject, count(*) AS workouts, sum(seconds) AS training_seconds, sum(climb) AS climbed, sum(hr * seconds / 60) AS beats, count(DISTINCT t // 86400000) AS workout_days, count(DISTINCT kind) AS activities FROM c GROUP BY 1),
d AS (SELECT subject, count(*) FILTER (kind <> 'view') AS hrv_days, sum(id)::DOUBLE AS steps FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY subject, day ORDER BY id DESC) = 1) GROUP BY 1),
p AS (SELECT w.subject, w.id, max(w.seq) AS seq FROM w LEFT JOIN g ON g.subject = w.subject AND g.id = w.id WHERE (gone IS NULL OR w.seq > gone) AND w.seq % 7 > 0 GROUP BY 1, 2), q AS (SELECT subject, sum(seq % 7)::BIGINT AS hr_points FROM p GROUP BY 1)
SELECT d.subject, coalesce(workouts, 0) AS workouts, coalesce(training_seconds, 0) AS training_seconds, coalesce({up('climbed', 2)}, 0) AS climbed_metres, coalesce({up('beats', 2)}, 0) AS beats, coalesce(workout_days, 0) AS workout_days, coalesce(activities, 0) AS activities, steps, hrv_days, coalesce(hr_points, 0) AS hr_points
FROM d LEFT JOIN a ON a.subject = d.subject LEFT JOIN q ON q.subject = d.subject""")
def lifetime_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of workouts (four ids each), errors as their deletions, the last event of a day as its row."""
    r, id4 = readings(spark, sf_dir), F.floor(F.col("id") / 4)
    climb = F.when(F.col("id") % 3 == 0, F.concat((F.col("id") % 500).cast("string"), F.lit(" m"))).when(F.col("id") % 3 == 1, F.concat((F.col("id") % 500).cast("string"), F.lit(" cm")))
    w = r.filter("kind <> 'error'").select("subject", id4.alias("id"), F.col("id").alias("seq"), F.col("t").alias("s"), F.col("kind").alias("activity"), (F.col("id") % 90 * 60).cast("double").alias("seconds"), climb.alias("climb"), (100 + F.col("id") % 60).cast("double").alias("hr_avg"))
    gone = r.filter("kind = 'error'").select("subject", id4.alias("id"), F.col("id").alias("seq"))
    m = F.map_concat(F.create_map(F.lit("steps"), F.col("id").cast("string")), F.when(F.col("kind") != "view", F.create_map(F.lit("hrv"), F.lit("1"))).otherwise(F.create_map().cast("map<string,string>")))
    raw = w.select("subject", "id", "seq", (F.col("seq") % 7).alias("hr_points"), F.lit(0).cast("long").alias("gps_points"))
    x = lifetime.totals(w, gone, r.select("subject", "day", F.col("id").alias("seq"), m.alias("m")), raw)
    rounded = (half_up(F.col(c), 2).alias(c) for c in ("climbed_metres", "beats"))
    return x.select("subject", "workouts", "training_seconds", *rounded, "workout_days", "activities", "steps", "hrv_days", "hr_points")


@query(f"""WITH {R}, x AS (SELECT subject, kind AS source, t, id, CASE WHEN id % 5 = 0 THEN NULL ELSE floor(v) END AS v, (row_number() OVER (PARTITION BY subject, kind ORDER BY t, id::VARCHAR) - 1) // 20 AS chunk FROM r WHERE id % 5 > 0)
SELECT subject, source, chunk::INT AS chunk, count(*)::INT AS n, min(t) AS first, max(t) AS last, string_agg(id::VARCHAR, ',' ORDER BY t, id::VARCHAR) AS ids, sum(v * 100)::DOUBLE AS total FROM x GROUP BY 1, 2, 3""")
def event_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples in percent, by source, twenty a chunk; every fifth has a value that is not finite."""
    value = F.when(F.col("id") % 5 == 0, F.lit(float("inf"))).otherwise(F.floor("v").cast("double"))
    none = lambda k: F.lit(None).cast(k)
    samples = readings(spark, sf_dir).select("subject", F.lit("level").alias("type"), F.lit("%").alias("unit"), none("string").alias("bundle"), F.col("kind").alias("source"), F.col("t").alias("start"), F.col("t").alias("end"), value.alias("value"), none("int").alias("category"), F.col("id").cast("string").alias("id"))
    total = F.aggregate("value", F.lit(0.0), lambda a, v: a + v)
    return lifetime.event_chunks(samples, 20).select("subject", "source", "chunk", "n", F.array_min("start").alias("first"), F.array_max("start").alias("last"), F.array_join("ids", ",").alias("ids"), total.alias("total"))
