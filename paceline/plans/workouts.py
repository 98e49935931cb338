"""Questions about workouts, over all subjects and workouts at once.

Tables: workouts (subject, wid, s, e (ms), activity, seq, batch, dist, dur, hr_avg, hr_max), stream points (subject, wid,
stream, gen, batch, t, v), route points (subject, wid, t, lat, lon, alt), workout events (subject, wid, t, type),
deleted (subject, wid). Results have a row, or several, for each workout; filter the inputs to ask about one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.functions.numbers import half_up, pace
from paceline.functions.physics import zone_bounds
from paceline.operators import asof, dedup, folds, intervals, series
from paceline.operators.dealing import dealt

KEY = ["subject", "wid"]
#: Metres of the best efforts that are reported unless others are asked for.
DISTANCES = (400.0, 1000.0, 1609.344, 5000.0, 10000.0, 21097.5, 42195.0)
#: Streams that measure distance, in order of choice.
DISTANCE_STREAMS = ("DistanceWalkingRunning", "DistanceCycling", "DistanceSwimming", "DistanceWheelchair")
ALIASES = {"hr": "HeartRate", "heartrate": "HeartRate", "distance": "DistanceWalkingRunning", "speed": "RunningSpeed", "power": "RunningPower", "steps": "StepCount"}


def stream_name(name: Column) -> Column:
    """The stored name of a stream that a person may call otherwise."""
    plain = F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, plain), name)


def current(workouts: DataFrame, deleted: DataFrame) -> DataFrame:
    """The latest version of each workout that is not deleted."""
    return dedup.latest(dedup.without_deleted(workouts, deleted, ["subject"], "wid"), KEY, ["seq", "batch"])


def listing(workouts: DataFrame, start_ms: int, end_ms: int, activity: str | None = None, limit: int = 300) -> DataFrame:
    """Workouts that begin in a half-open range, by activity (part of its name, any case), the first limit of each subject."""
    x = workouts.filter((F.col("s") >= start_ms) & (F.col("s") < end_ms))
    if activity:
        x = x.filter(F.lower("activity").contains(activity.lower()))
    x = x.withColumns({"km": half_up(F.col("dist") / 1000, 2), "minutes": half_up(F.col("dur") / 60, 1), "pace": F.when(F.col("dist") > 0, pace(F.col("dur") / F.col("dist") * 1000))})
    return series.first_rows(x, ["subject"], [F.asc("s"), F.asc("wid")], limit)


def points(streams: DataFrame, name: str) -> DataFrame:
    """One reading for each time of a stream's newest generation."""
    return dedup.latest_generation(streams.filter(F.col("stream") == name), KEY)


def distances(streams: DataFrame, routes: DataFrame, workouts: DataFrame, source: str = "auto") -> DataFrame:
    """subject, wid, t, d: from the first distance stream that a workout has, or else from its route; source: 'distance' or 'route' for that only."""
    if source not in ("auto", "distance", "route"):
        raise ValueError("source is auto, distance or route")
    if source == "route":
        return series.route_distance(routes.join(workouts.select(*KEY), KEY, "left_semi"), KEY).select(*KEY, "t", "d")
    starts = workouts.select(*KEY, F.col("s").alias("start"))
    place = F.array_position(F.array(*map(F.lit, DISTANCE_STREAMS)), F.col("stream"))
    measured = streams.filter(place > 0).withColumn("_p", place)
    best = measured.withColumn("_b", F.min("_p").over(Window.partitionBy(*KEY))).filter("_p = _b")
    from_streams = series.distance_from_increments(dedup.latest_generation(best, KEY), KEY, starts.join(best.select(*KEY).distinct(), KEY))
    if source == "distance":
        return from_streams
    from_routes = series.route_distance(routes.join(measured.select(*KEY).distinct(), KEY, "left_anti"), KEY).select(*KEY, "t", "d")
    return dealt(from_streams.unionByName(from_routes), KEY)


def totals(measured: DataFrame, workouts: DataFrame) -> DataFrame:
    """subject, wid, metres: the first kind of distance in measured (subject, wid, stream, metres) that a workout has, else its stored total."""
    place = F.array_position(F.array(*map(F.lit, DISTANCE_STREAMS)), F.col("stream"))
    first = measured.filter((place > 0) & F.col("metres").isNotNull()).groupBy(*KEY).agg(F.min_by("metres", place).alias("_m"))
    return workouts.join(first, KEY, "left").select(*KEY, F.coalesce("_m", "dist").alias("metres"))


def series_of(workouts: DataFrame, streams: DataFrame, name: str, first_s: float | None = None, last_s: float | None = None, most: int = 300, raw: bool = False, cursor: int = 0) -> DataFrame:
    """subject, wid, offset (s), value, low, high, n_range of a stream between two offsets from the start, both included.

    raw: readings cursor + 1 to cursor + most of each workout, with next (the next cursor or null). Else all readings where there
    are no more than most, or the mean, least and greatest of as many equal spans of time.
    """
    if not 2 <= most <= 1000 or cursor < 0 or (first_s is not None and last_s is not None and first_s > last_s):
        raise ValueError("most is 2 to 1000, cursor 0 or more, and the first offset not after the last")
    x = points(streams.withColumn("stream", stream_name(F.col("stream"))), ALIASES.get(name.lower().replace("-", ""), name)).filter("v is not null")
    x = x.join(workouts.select(*KEY, F.col("s").alias("_s")), KEY).withColumn("offset", (F.col("t") - F.col("_s")) / 1000)
    if first_s is not None:
        x = x.filter(F.col("offset") >= first_s)
    if last_s is not None:
        x = x.filter(F.col("offset") <= last_s)
    x = x.withColumn("n_range", F.count("*").over(Window.partitionBy(*KEY)))
    one = [*KEY, half_up(F.col("offset"), 1).alias("offset"), F.col("v").alias("value"), F.col("v").alias("low"), F.col("v").alias("high"), "n_range"]
    if raw:
        more = F.when(F.col("n_range") > cursor + most, cursor + most).alias("next")
        return series.page(x, KEY, "t", cursor, most).select(*one, more)
    many = x.filter(F.col("n_range") > most)
    spans = many.groupBy(*KEY, "n_range").agg(F.min("offset").alias("_a"), F.max("offset").alias("_b"))
    mean = series.downsample(many, KEY, most).join(spans, KEY)
    start = F.col("_a") + F.col("bucket") * (F.col("_b") - F.col("_a")) / most
    return x.filter(F.col("n_range") <= most).select(*one).unionByName(mean.select(*KEY, half_up(start, 1).alias("offset"), half_up(F.col("mean"), 2).alias("value"), "low", "high", "n_range"))


def detail(workouts: DataFrame, events: DataFrame, streams: DataFrame, marks: DataFrame, days: DataFrame) -> DataFrame:
    """workouts (with day) with paused_seconds, event_counts and streams (maps of counts), raw status, and the metrics of its day and the day before as maps.

    marks: subject, wid, complete of the raw data that has come. days: subject, day, metric, value.
    """
    stopped = moving_seconds(workouts, pauses(events, workouts)).select(*KEY, half_up(F.col("paused"), 1).alias("paused_seconds"))
    as_map = lambda name, n: F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, n))))
    counted = lambda df, name, n: df.groupBy(*KEY, F.col(name).cast("string").alias("_k")).agg(F.count("*").alias("_n")).groupBy(*KEY).agg(as_map("_k", "_n").alias(n))
    status = F.when(F.col("complete"), "complete").when(F.col("complete").isNotNull() | F.col("streams").isNotNull(), "partial").otherwise("none")
    x = workouts.join(stopped, KEY, "left").join(counted(events, "type", "event_counts"), KEY, "left").join(counted(streams, "stream", "streams"), KEY, "left")
    x = x.join(marks.groupBy(*KEY).agg(F.max("complete").alias("complete")), KEY, "left").withColumn("raw_status", status).drop("complete")
    of_day = days.filter("value is not null").groupBy("subject", "day").agg(as_map("metric", "value").alias("m"))
    x = x.join(of_day.withColumnRenamed("m", "same_day"), ["subject", "day"], "left")
    return x.join(of_day.select("subject", F.date_add("day", 1).alias("day"), F.col("m").alias("previous_day")), ["subject", "day"], "left")


def pauses(events: DataFrame, workouts: DataFrame) -> DataFrame:
    return intervals.pauses(events, KEY, workouts.select(*KEY, F.col("e").alias("end")))


def moving_seconds(workouts: DataFrame, stops: DataFrame) -> DataFrame:
    """subject, wid, moving, paused (seconds)."""
    x = intervals.overlap_sums(workouts.select(*KEY, F.col("s").alias("a"), F.col("e").alias("b")), stops, KEY, "p")
    return x.select(*KEY, ((F.col("b") - F.col("a") - F.col("p")) / 1000).alias("moving"), (F.col("p") / 1000).alias("paused"))


def hr_zones(workouts: DataFrame, streams: DataFrame, events: DataFrame, max_hr: float | None = None, bounds: list[float] | None = None) -> DataFrame:
    """subject, wid, zone, seconds, percent, unmeasured: time of moving in zones of heart rate."""
    stops = pauses(events, workouts)
    readings = points(streams, "HeartRate").join(workouts.select(*KEY, F.col("e").alias("end")), KEY)
    weighted = series.weights(readings, KEY, pauses=stops, end="end")
    measured = weighted.groupBy(*KEY).agg(F.sum("w").alias("measured"))
    left = moving_seconds(workouts, stops).join(measured, KEY, "left")
    left = left.select(*KEY, half_up(F.greatest(F.lit(0.0), F.col("moving") - F.coalesce("measured", F.lit(0.0))), 1).alias("unmeasured"))
    return series.zones(weighted, KEY, zone_bounds(max_hr, bounds)).join(left, KEY)


def splits(workouts: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame, unit: float = 1000.0, source: str = "auto") -> DataFrame:
    """subject, wid, split, length_m, seconds (moving), pace, hr, gain, partial."""
    dist = distances(streams, routes, workouts, source)
    x = series.moving(series.splits(dist, KEY, unit), KEY, pauses(events, workouts))
    spans = x.select(*KEY, "split", F.col("t0").alias("a"), F.col("t1").alias("b"))
    hr = series.mean_within(points(streams, "HeartRate"), spans, KEY, "hr").drop("a", "b")
    alt = spans.join(routes.filter("alt is not null").select(*KEY, "t", F.col("alt").alias("v")), KEY).filter("t >= a and t <= b")
    gain = folds.climb(alt, [*KEY, "split"]).drop("loss")
    seconds = F.col("moving_ms") / 1000
    x = x.join(hr, [*KEY, "split"], "left").join(gain, [*KEY, "split"], "left")
    return x.select(
        *KEY, "split", half_up(F.col("length_m"), 1).alias("length_m"), half_up(seconds, 1).alias("seconds"), half_up(seconds / F.col("length_m") * unit, 1).alias("pace"),
        half_up(F.col("hr"), 1).alias("hr"), half_up(F.col("gain"), 1).alias("gain"), (F.col("length_m") < unit - 1e-6).alias("partial"),
    )


def best_efforts(workouts: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame, lengths: tuple[float, ...] = DISTANCES) -> DataFrame:
    """subject, wid, metres, seconds, start, end of the fastest stretch of each length."""
    out = series.best_efforts(distances(streams, routes, workouts), KEY, list(lengths), pauses(events, workouts))
    return out.select(*KEY, "metres", half_up(F.col("seconds"), 1).alias("seconds"), half_up(F.col("seconds") / F.col("metres") * 1000, 1).alias("pace"), "start", "end")


def hr_drift(workouts: DataFrame, streams: DataFrame, routes: DataFrame, events: DataFrame) -> DataFrame:
    """subject, wid, hr1, hr2, change, decoupling (percent) of the halves of the moving time."""
    stops = pauses(events, workouts)
    moving = moving_seconds(workouts, stops)
    # the wall time of half the moving time: moving time as a function of wall time bends at the pauses' ends
    edges = stops.select(*KEY, F.explode(F.array("s", "e")).alias("t")).unionByName(workouts.select(*KEY, F.explode(F.array("s", "e")).alias("t"))).distinct()
    at = edges.join(workouts.select(*KEY, F.col("s").alias("a")), KEY).withColumn("b", F.col("t"))
    bent = intervals.overlap_sums(at, stops, KEY, "p").select(*KEY, F.col("t").cast("double").alias("t"), (F.col("b") - F.col("a") - F.col("p")).cast("double").alias("m"))
    mid = asof.at(bent, moving.select(*KEY, (F.col("moving") * 500).alias("m")), KEY, "m", "t", "mid").drop("m")
    bounds = workouts.select(*KEY, F.col("s").alias("start"), F.col("e").alias("end")).join(mid, KEY)
    readings = points(streams, "HeartRate").join(workouts.select(*KEY, F.col("e").alias("end")), KEY)
    weighted = series.weights(readings, KEY, pauses=stops, end="end").drop("end")
    halves = series.halves(weighted, KEY, bounds)
    dist = distances(streams, routes, workouts).withColumn("t", F.col("t").cast("double"))
    probes = bounds.select(*KEY, F.posexplode(F.array(F.col("start").cast("double"), "mid", F.col("end").cast("double"))).alias("k", "t"))
    d = asof.at(dist, probes, KEY, "t", "d", "d", clamp=True)
    legs = d.groupBy(*KEY).agg(*(F.max(F.when(F.col("k") == k, F.col("d"))).alias(f"d{k}") for k in range(3)))
    x = halves.join(legs, KEY, "left").join(moving, KEY)
    half = F.col("moving") / 2
    fall = series.decoupling((F.col("d1") - F.col("d0")) / half, F.col("hr1"), (F.col("d2") - F.col("d1")) / half, F.col("hr2"))
    return x.select(*KEY, half_up(F.col("hr1"), 1).alias("hr1"), half_up(F.col("hr2"), 1).alias("hr2"), half_up(F.col("change"), 1).alias("change"), half_up(fall, 1).alias("decoupling"))


def elevation(routes: DataFrame) -> DataFrame:
    """subject, wid, gain, loss, low, high, steepest, lowest, and shares (percent) of uphill, level and downhill."""
    r = series.route_distance(routes, KEY).filter("alt is not null")
    r = r.withColumn("a", series.smooth("alt", KEY, "t"))
    enough = r.groupBy(*KEY).agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count("*").alias("n")).filter("n >= 2").drop("n")
    turns, spans = folds.climb(r.withColumn("v", F.col("a")), KEY), folds.grades(r, KEY)
    x = enough.join(turns, KEY).join(spans, KEY)
    all_of = F.col("up") + F.col("level") + F.col("down")
    share = lambda c: half_up(100 * F.col(c) / F.when(all_of > 0, all_of), 1).alias(f"{c}_percent")
    number = lambda c: half_up(F.col(c), 1).alias(c)
    steep = F.when(F.col("steepest") > 0, F.col("steepest"))
    deep = F.when(F.col("lowest") < 0, F.col("lowest"))
    return x.select(*KEY, *map(number, ("gain", "loss", "low", "high")), half_up(steep, 1).alias("steepest"), half_up(deep, 1).alias("lowest"), *map(share, ("up", "level", "down")))


def shown_route(routes: DataFrame, most: int = 300, trim_m: float = 300.0, full: bool = False) -> DataFrame:
    """Route points without the first and last trim_m metres, thinned to most."""
    r = series.route_distance(routes, KEY)
    return series.thin(r if full else series.trim_ends(r, KEY, trim_m), KEY, "t", most)


def with_day_context(workouts: DataFrame, days: DataFrame, metric: str) -> DataFrame:
    """workouts (with day) and a daily metric on that day and the day before."""
    m = days.filter(F.col("metric") == metric).select("subject", "day", "value")
    x = workouts.join(m.withColumnRenamed("value", "same_day"), ["subject", "day"], "left")
    return x.join(m.select("subject", F.date_add("day", 1).alias("day"), F.col("value").alias("day_before")), ["subject", "day"], "left")


def before_workouts(entries: DataFrame, workouts: DataFrame, hours: float) -> DataFrame:
    """Entries (subject, t, ...) in the hours before each workout began."""
    w = workouts.select("subject", "wid", (F.col("s") - int(hours * 3_600_000)).alias("a"), F.col("s").alias("b"))
    return intervals.in_windows(entries, w, ["subject"])


def during_workouts(entries: DataFrame, workouts: DataFrame) -> DataFrame:
    """Workouts with an entry between start and end, both included."""
    w = workouts.select("subject", "wid", F.col("s").alias("a"), (F.col("e") + 1).alias("b"))
    return workouts.join(intervals.in_windows(entries, w, ["subject"]).select("subject", "wid").distinct(), KEY, "left_semi")
