"""What is shown of a workout bit by bit: the steps of its plan, its events, and pages of its route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.numbers import half_up
from paceline.operators import series
from paceline.plans.workouts import KEY

_STEP = "purpose string, goal string, value double, target string"
#: A plan as JSON: single steps before and after, and blocks of steps that are repeated.
PLAN_SCHEMA = f"kind string, desc string, warmup struct<{_STEP}>, blocks array<struct<iterations int, steps array<struct<{_STEP}>>>>, cooldown struct<{_STEP}>"


def plan_steps(workouts: DataFrame, column: str = "plan") -> DataFrame:
    """subject, wid, kind, node, parent, depth, purpose, repeats, goal, value, target: a plan's tree, each node after its parent.

    Nodes count from 1 in order. A block is a node with repeats, at least 1, over its steps and isn't unrolled. A plan that is
    missing or no JSON gives no rows; one without steps gives none either.
    """
    p = workouts.select(*KEY, F.from_json(column, PLAN_SCHEMA).alias("p")).filter("p is not null")
    names = ("purpose", "goal", "value", "target")
    leaf = lambda s, within: F.struct(F.lit(None).cast("int").alias("repeats"), within.alias("within"), *(s[n].alias(n) for n in names))
    single = lambda c: F.when(F.col(c).isNotNull(), F.array(leaf(F.col(c), F.lit(0)))).otherwise(F.array())

    def block(b):
        head = F.struct(F.greatest(F.coalesce(b["iterations"], F.lit(1)), F.lit(1)).alias("repeats"), F.lit(0).alias("within"), F.lit("block").alias("purpose"), *(F.lit(None).cast(k).alias(n) for n, k in (("goal", "string"), ("value", "double"), ("target", "string"))))
        steps = F.filter(F.coalesce(b["steps"], F.array()), lambda s: s.isNotNull())
        return F.concat(F.array(head), F.transform(steps, lambda s, k: leaf(s, k + 1)))

    blocks = F.flatten(F.transform(F.filter(F.coalesce("p.blocks", F.array()), lambda b: b.isNotNull()), block))
    x = p.select(*KEY, F.col("p.kind").alias("kind"), F.posexplode(F.concat(single("p.warmup"), blocks, single("p.cooldown"))).alias("_i", "_s"))
    parent = F.when(F.col("_s.within") > 0, F.col("_i") + 1 - F.col("_s.within"))
    return x.select(*KEY, "kind", (F.col("_i") + 1).alias("node"), parent.alias("parent"), F.when(parent.isNull(), 1).otherwise(2).alias("depth"), "_s.purpose", "_s.repeats", "_s.goal", "_s.value", "_s.target")


def listed_events(events: DataFrame, workouts: DataFrame, most: int = 100, omitted: str = "segment") -> DataFrame:
    """subject, wid, place, offset_seconds, type, duration_seconds of the first events, truncated and segments (not listed) of each workout.

    events: subject, wid, t, type, dur (seconds, null: 0). A workout with nothing but omitted ones has one row without an event.
    """
    w = Window.partitionBy(*KEY)
    x = events.join(workouts.select(*KEY, "s"), KEY).withColumn("_o", F.col("type").eqNullSafe(omitted))
    x = x.withColumns({"segments": F.count_if("_o").over(w), "_listed": F.count_if(~F.col("_o")).over(w), "place": F.row_number().over(w.orderBy("_o", "t", "type", "dur"))})
    x = x.filter(F.when(F.col("_listed") == 0, F.col("place") == 1).otherwise(~F.col("_o") & (F.col("place") <= most)))
    of = lambda c: F.when(~F.col("_o"), c)
    return x.select(
        *KEY, of(F.col("place")).alias("place"), of(half_up((F.col("t") - F.col("s")) / 1000, 1)).alias("offset_seconds"), of(F.col("type")).alias("type"), of(half_up(F.coalesce("dur", F.lit(0.0)), 1)).alias("duration_seconds"),
        (F.col("_listed") > most).alias("truncated"), "segments",
    )


def _limit(n: int, most: int = 5000) -> int:
    if not 2 <= n <= most:
        raise ValueError(f"a page has 2 to {most} points")
    return n


def shown_points(routes: DataFrame, trim_m: float = 300.0, full: bool = False) -> DataFrame:
    """Points of routes with d, without the first and last metres; one for each time of a workout."""
    r = series.route_distance(routes.dropDuplicates([*KEY, "t"]), KEY)
    return r if full else series.trim_ends(r, KEY, trim_m)


def page_after(points: DataFrame, requests: DataFrame, limit: int) -> DataFrame:
    """The next points of each request (subject, wid, after; null: from the start), with next_after, null on the last page.

    A cursor is the time of the last point shown, so points that arrive late before it don't shift what comes next.
    """
    x = points.join(requests.select(*KEY, F.col("after").alias("_after")).distinct(), KEY).filter("_after is null or t > _after")
    w = Window.partitionBy(*KEY, "_after")
    x = x.withColumns({"_n": F.row_number().over(w.orderBy("t")), "_left": F.count("*").over(w)}).filter(F.col("_n") <= _limit(limit))
    return x.withColumn("next_after", F.when(F.col("_left") > limit, F.max("t").over(w))).withColumnRenamed("_after", "after").drop("_n", "_left")


def pages(points: DataFrame, limit: int) -> DataFrame:
    """subject, wid, page (from 1), after (its cursor), next_after, points, first, last: all pages of all workouts at once."""
    n = F.row_number().over(Window.partitionBy(*KEY).orderBy("t")) - 1
    x = points.withColumn("page", F.floor(n / _limit(limit)).cast("int") + 1).groupBy(*KEY, "page").agg(F.count("*").alias("points"), F.min("t").alias("first"), F.max("t").alias("last"))
    w = Window.partitionBy(*KEY).orderBy("page")
    x = x.withColumns({"after": F.lag("last").over(w), "next_after": F.when(F.lead("last").over(w).isNotNull(), F.col("last"))})
    return x.select(*KEY, "page", "after", "next_after", "points", "first", "last")
