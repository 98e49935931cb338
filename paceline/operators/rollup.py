"""Daily rollups that are kept: counts and duration histograms that add up, stored by day and written anew for the last days only.

One row is what a day has of one kind: usage (calls), provider (calls of one), sync, version (syncs of one app version), cohort (steps of those who
first opened the app that day, in all, by provider and by version) and retention. counts add up over days, but for active users and cohorts, which
are of their day. buckets is the histogram of durations (product.BUCKETS_MS), so a percentile of any span of days comes from its sum.
Identifiers of users do not leave a day's counting. Repeated product events (one id) count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.clock import DAY_MS, local_day
from paceline.operators import product
from paceline.sources import tables

#: Days that a run counts and writes again: a day's numbers stop changing when it ends, and the last retention is settled after 35.
WINDOW_DAYS = 40
SCHEMA = "kind string, key string, counts map<string,long>, buckets array<long>, day date"


def _buckets(ms: Column) -> Column:
    """How many durations lie in each bucket."""
    place = F.when(ms >= 0, product.bucket(ms))
    return F.array(*(F.count(F.when(place == i, 1)) for i in range(len(product.BUCKETS_MS))))


def _counts(**columns: Column) -> Column:
    return F.create_map(*(x for name, c in columns.items() for x in (F.lit(name), F.coalesce(c, F.lit(0)).cast("long")))).alias("counts")


def daily(users: DataFrame, access: DataFrame, events: DataFrame, steps: list[str], start_ms: int, now_ms: int) -> DataFrame:
    """The rollup (SCHEMA) of the days from start_ms to now_ms; days without anything have rows of zeros.

    access and users as in operators.product; events: id, name, at, app_version, outcome, duration_ms.
    """
    first, end = start_ms // DAY_MS * DAY_MS, (now_ms // DAY_MS + 1) * DAY_MS
    inside = F.col("at").between(first, end - 1)
    n = lambda c: F.count(F.when(c, 1))
    none = F.expr(f"array_repeat(0L, {len(product.BUCKETS_MS)})")
    calls = access.filter(inside).withColumn("day", local_day(F.col("at")))

    def of_calls(kind: str, key: Column) -> DataFrame:
        x = calls.withColumn("key", key).groupBy("day", "key")
        active = F.countDistinct(F.when(F.col("ok"), F.col("uid")))
        return x.agg(_counts(active=active, calls=F.count("*"), successes=n(F.col("ok")), failures=n(~F.col("ok")), duration_count=n(F.col("ms") >= 0), duration_ms=F.sum(F.when(F.col("ms") >= 0, F.col("ms")))), _buckets(F.col("ms")).alias("buckets")).withColumn("kind", F.lit(kind))

    syncs = events.dropDuplicates(["id"]).filter((F.col("name") == "sync_finished") & inside).withColumn("day", local_day(F.col("at")))

    def of_syncs(kind: str, key: Column) -> DataFrame:
        ms = F.col("duration_ms")
        x = syncs.withColumn("key", key).filter("key is not null").groupBy("day", "key")
        good = F.coalesce(F.col("outcome") == "success", F.lit(False))
        return x.agg(_counts(attempts=F.count("*"), successes=n(good), failures=n(~good), duration_count=F.count(ms), duration_ms=F.sum(ms)), _buckets(ms).alias("buckets")).withColumn("kind", F.lit(kind))

    here = users.filter(~F.coalesce("deleting", F.lit(False)))

    def cohort(kind: str, key: Column) -> DataFrame:
        x = here.filter(F.col(steps[0]).between(first, end - 1)).withColumn("day", local_day(F.col(steps[0]))).withColumn("key", key).filter("key is not null")
        return x.groupBy("day", "key").agg(_counts(**{s: F.count(s) for s in steps})).withColumns({"buckets": none, "kind": F.lit(kind)})

    kept = product.retention(users.filter(F.col("activated").between(first, end - 1)), access, now_ms)
    retained = kept.select("day", F.lit("").alias("key"), _counts(**{c: F.col(c) for c in kept.columns if c != "day"}), none.alias("buckets"), F.lit("retention").alias("kind"))
    every = F.lit("")
    parts = [of_calls("usage", every), of_calls("provider", F.coalesce("provider", F.lit("unknown"))), of_syncs("sync", every), of_syncs("version", F.col("app_version")), cohort("cohort", every), cohort("cohort_provider", F.col("provider")), cohort("cohort_version", F.col("app_version")), retained]
    columns = ["kind", "key", "counts", "buckets", "day"]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    days = users.sparkSession.range(first // DAY_MS, end // DAY_MS).select(F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.explode(F.array(*map(F.lit, ("usage", "sync", "cohort", "retention")))).alias("kind"))
    blank = days.join(out.filter("key = ''").select("day", "kind"), ["day", "kind"], "left_anti").select("kind", F.lit("").alias("key"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>")).alias("counts"), none.alias("buckets"), "day")
    return out.unionByName(blank)


def rebuild(users: DataFrame, access: DataFrame, events: DataFrame, steps: list[str], path: str, now_ms: int, days: int = WINDOW_DAYS) -> None:
    """Count the last days anew and write them in place of what the table at path has of them; days before stay as they are."""
    start = (now_ms // DAY_MS - days + 1) * DAY_MS
    tables.replace_partitions(daily(users, access, events, steps, start, now_ms).repartition("day"), path, ["day"])


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def spans(rollup: DataFrame, kind: str) -> DataFrame:
    """key, days, counts and buckets added up over the days of a kind."""
    x = rollup.filter(F.col("kind") == kind)
    names = x.select("key", "day", F.explode("counts").alias("name", "n")).groupBy("key", "name").agg(F.sum("n").alias("n"))
    counts = names.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "n")))).alias("counts"))  # the names of one kind
    sums = x.groupBy("key").agg(F.countDistinct("day").alias("days"), F.array(*(F.sum(F.get("buckets", F.lit(i))) for i in range(len(product.BUCKETS_MS)))).alias("buckets"))
    return sums.join(counts, "key", "left")


def percentile(buckets: Column, q: float) -> Column:
    """The upper bound of the first bucket in which a share q of all durations is reached; null without any."""
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda a, b: a + b)
    seen = F.transform(F.sequence(F.lit(1), F.size(buckets)), lambda i: F.aggregate(F.slice(buckets, F.lit(1), i), F.lit(0).cast("long"), lambda a, b: a + b))
    place = F.array_position(F.transform(seen, lambda s: s >= F.ceil(total * q)), True)
    return F.when(total > 0, F.element_at(F.array(*map(F.lit, product.BUCKETS_MS)), place.cast("int")))
