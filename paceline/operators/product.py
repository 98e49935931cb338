"""Product analytics: daily use, reliability, cohort funnel and retention, all in UTC days.

access: uid, provider, ok, at, ms. events: name, at, app_version, outcome, duration_ms. users: uid, deleting, milestones
(longs, the first is first_opened), activated, provider, app_version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.clock import DAY_MS, local_day

#: Upper bounds of the duration histogram, in milliseconds.
BUCKETS_MS = (100, 250, 500, 1_000, 2_500, 5_000, 10_000, 30_000, 60_000, 300_000, 900_000, 3_600_000)


def bucket(ms: Column) -> Column:
    """The place of a duration in the histogram; the last bucket is open."""
    out = F.lit(len(BUCKETS_MS) - 1)
    for i in range(len(BUCKETS_MS) - 1, -1, -1):
        out = F.when(ms <= BUCKETS_MS[i], i).otherwise(out)
    return out


def histogram(rows: DataFrame, by: list[str], ms: str) -> DataFrame:
    return rows.filter(F.col(ms) >= 0).groupBy(*by, bucket(F.col(ms)).alias("bucket")).agg(F.count("*").alias("n"))


def percentile_bound(hist: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, bound: the upper bound of the first bucket in which a share q of all is reached."""
    w = Window.partitionBy(*by)
    x = hist.withColumns({"_seen": F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(w)})
    least = x.filter(F.col("_seen") >= F.ceil(F.col("_all") * q)).groupBy(*by).agg(F.min("bucket").alias("_b"))
    return least.select(*by, F.element_at(F.array(*map(F.lit, BUCKETS_MS)), F.col("_b") + 1).alias("bound"))


def usage(access: DataFrame, by: list[str] = ()) -> DataFrame:
    """day (and by), active users (with a success), calls, successes, failures."""
    x = access.withColumn("day", local_day(F.col("at")))
    return x.groupBy("day", *by).agg(F.countDistinct(F.when(F.col("ok"), F.col("uid"))).alias("active"), F.count("*").alias("calls"), F.count(F.when(F.col("ok"), 1)).alias("successes"), F.count(F.when(~F.col("ok"), 1)).alias("failures"))


def usage_overview(daily: DataFrame, by_provider: DataFrame) -> DataFrame:
    """Sums over the days of usage(), with a row for each provider and one (provider null) for all."""
    total = daily.agg(F.sum("active").alias("active_user_days"), F.sum("calls").alias("calls"), F.sum("successes").alias("successes")).withColumn("provider", F.lit(None).cast("string"))
    each = by_provider.groupBy("provider").agg(F.sum("active").alias("active_user_days"), F.sum("calls").alias("calls"), F.sum("successes").alias("successes"))
    x = total.unionByName(each)
    return x.withColumn("success_rate", F.col("successes") / F.when(F.col("calls") > 0, F.col("calls")))


def reliability(events: DataFrame, by: list[str]) -> DataFrame:
    """by, attempts, successes, mean duration and the 95 % bound of finished syncs."""
    x = events.filter("name = 'sync_finished'")
    sums = x.groupBy(*by).agg(F.count("*").alias("attempts"), F.count(F.when(F.col("outcome") == "success", 1)).alias("successes"), F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("mean_ms"))
    return sums.join(percentile_bound(histogram(x, by, "duration_ms"), by, 0.95), by, "left")


def funnel(users: DataFrame, steps: list[str], by: list[str] = ()) -> DataFrame:
    """day of first opening (and by): how many users reached each step."""
    x = users.filter(~F.coalesce("deleting", F.lit(False)) & F.col(steps[0]).isNotNull()).withColumn("day", local_day(F.col(steps[0])))
    return x.groupBy("day", *by).agg(*(F.count(s).alias(s) for s in steps))


def funnel_rates(daily: DataFrame, steps: list[str]) -> DataFrame:
    """step, users, rate from the first step over all days."""
    sums = daily.agg(*(F.sum(s).alias(s) for s in steps))
    rows = sums.select(F.posexplode(F.array(*(F.struct(F.lit(s).alias("step"), F.col(s).alias("users")) for s in steps))).alias("place", "r"), F.col(steps[0]).alias("_first"))
    return rows.select("place", "r.step", "r.users", (F.col("r.users") / F.when(F.col("_first") > 0, F.col("_first"))).alias("rate"))


def retention(users: DataFrame, access: DataFrame, now_ms: int) -> DataFrame:
    """day of activation, activated, w1/w4 eligible and retained: a success on days 7-13 and 28-34; only cohorts that old count."""
    x = users.filter(~F.coalesce("deleting", F.lit(False)) & F.col("activated").isNotNull())
    hits = access.filter("ok").select("uid", "at")
    age = F.col("at") - F.col("activated")
    inside = lambda a, b: F.coalesce(F.max((age >= a * DAY_MS) & (age < b * DAY_MS)), F.lit(False))
    each = x.join(hits, "uid", "left").groupBy("uid", "activated").agg(inside(7, 14).alias("w1"), inside(28, 35).alias("w4"))
    old = lambda d: F.lit(now_ms) >= F.col("activated") + d * DAY_MS
    n = lambda c: F.count(F.when(c, 1))
    return each.groupBy(local_day(F.col("activated")).alias("day")).agg(
        F.count("*").alias("activated"), n(old(14)).alias("w1_eligible"), n(old(14) & F.col("w1")).alias("w1_retained"), n(old(35)).alias("w4_eligible"), n(old(35) & F.col("w4")).alias("w4_retained")
    )


def first_times(events: DataFrame) -> DataFrame:
    """uid, name, at: one-time milestones are the first occurrence."""
    return events.groupBy("uid", "name").agg(F.min("at").alias("at"))


#: Names a product event may have, and the outcomes of one that ends.
EVENT_NAMES = ("app_opened", "onboarding_finished", "permissions_granted", "sync_started", "sync_finished", "connected", "first_answer")
OUTCOMES = ("success", "failure", "cancelled")


def checked_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and refused product events: known name, well-formed version, known outcome, duration of at most a day."""
    ok = F.col("name").isin(*EVENT_NAMES)
    ok &= F.col("app_version").isNull() | F.col("app_version").rlike(r"^[0-9A-Za-z][0-9A-Za-z.+_-]{0,31}$")
    ok &= F.col("outcome").isNull() | F.col("outcome").isin(*OUTCOMES)
    ok &= F.col("duration_ms").isNull() | F.col("duration_ms").between(0, DAY_MS)
    ok = F.coalesce(ok, F.lit(False))
    return events.filter(ok), events.filter(~ok)
