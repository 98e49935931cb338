"""Upload batches: gzip files of JSON lines, a header first, then records of the kinds that the header's type allows.

lines: path, value (a line) of whole files, from read_lines() or a file stream. A record that is no good is set aside
and the rest kept; a file without a proper header, or without one good record, is refused as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.functions.clock import DAY_MS, local_day, valid_day
from paceline.operators import codec, compact
from paceline.operators.intervals import merge

#: Limits and names of the upload format.
MAX_EPOCH_MS = 4_102_444_800_000
MAX_RECORDS = 5_000
MAX_POINTS = 20_000
WORKOUT, DAILY, STREAM, STATUS, PROFILE = "HKWorkoutTypeIdentifier", "_daily", "_wstream", "_status", "_events_profile"
MODES = ("anchored", "recent", "stats", "reconcile", "status", "workoutdata")
STREAM_COLUMNS = ("v", "lat", "lon", "alt", "spd", "crs", "ha", "va")
KINDS = {WORKOUT: ("w", "d"), DAILY: ("day",), STREAM: ("ws", "wd"), STATUS: ("c",), "_hourly": ("hs",), "_events": ("ev", "d")}
#: Types of categories that a person switches on.
KINDS |= {"_daily_nutrition": ("day",), "_daily_cycle": ("day",), "_events_nutrition": ("ev", "d"), PROFILE: ("ev", "d")}

HEADER = "kind string, schema int, batchId string, type string, seq long, device string, tz string, createdAt long, mode string, window struct<start:long,end:long>, caughtUp boolean, checkedAt long, reconcileId string, reconcileDone boolean"
ROW = ("subject", "type", "k", "id", "s", "e", "v", "v2", "v3", "c", "u", "agg", "src", "bid", "dev", "tz", "extra", "seq", "batch", "rid")
_ROW_TYPES = dict(zip(ROW, ["string", "string", "string", "string", "long", "long", "double", "double", "double", "int", *["string"] * 7, "long", "string", "string"], strict=True))
ROW_SCHEMA = ", ".join(f"{c} {t}" for c, t in _ROW_TYPES.items()) + ", month string"


def read_lines(spark: SparkSession, landing: str) -> DataFrame:
    """The lines of all batch files under a folder; files are not split, as gzip is not."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ndjson.gz").text(landing).select(F.col("_metadata.file_path").alias("path"), "value")


def checksums(spark: SparkSession, landing: str) -> DataFrame:
    """path, size, sha256 of the files as they are."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(landing)
    return x.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def headers(lines: DataFrame, kinds: dict[str, tuple[str, ...]] = KINDS) -> DataFrame:
    """path, subject (the file's folder), the header's fields, n (records), and problem, null if the batch is good so far."""
    x = lines.filter("length(value) > 0")
    x = x.withColumn("h", F.when(F.get_json_object("value", "$.kind") == "header", F.from_json("value", HEADER)))
    x = x.groupBy("path").agg(F.first("h", True).alias("h"), F.count(F.when(F.col("h").isNull(), 1)).alias("n"), F.count("h").alias("n_headers"))
    x = x.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("subject"), "h.*", "n", "n_headers")
    status, stream = F.col("mode") == "status", F.col("mode") == "workoutdata"
    problem = (
        F.when(F.col("n_headers") != 1, "no header")
        .when(~F.coalesce(F.col("schema").isin(1, 2) & F.col("mode").isin(*MODES) & (F.col("seq") >= 0) & F.col("createdAt").between(0, MAX_EPOCH_MS) & F.col("batchId").rlike("^[0-9a-fA-F-]{36}$"), F.lit(False)), "bad header")
        .when(F.col("n") > MAX_RECORDS, "too many records")
        .when(status != (F.col("type") == STATUS), "mode and type disagree")
        .when(stream != (F.col("type") == STREAM), "mode and type disagree")
        .when(~F.col("type").isin(*kinds), "unknown type")
        .when((F.col("schema") < 2) & ~F.col("type").isin(WORKOUT, STATUS), "needs schema 2")
    )
    return x.withColumn("problem", problem).drop("n_headers", "kind")


def records(lines: DataFrame, heads: DataFrame, kinds: dict[str, tuple[str, ...]] = KINDS) -> tuple[DataFrame, DataFrame]:
    """Good records (header fields, value, k) and those set aside (path, value, problem)."""
    allowed = F.lit(False)
    for t, ks in kinds.items():
        allowed |= (F.col("type") == t) & F.col("k").isin(*ks)
    x = lines.filter("length(value) > 0").filter(F.coalesce(F.get_json_object("value", "$.kind"), F.lit("")) != "header")
    x = x.join(heads.filter("problem is null").drop("problem", "n"), "path")
    x = _parsed_chunks(x.withColumn("k", F.get_json_object("value", "$.k")))
    one = lambda name: F.get_json_object("value", f"$.{name}")
    number = lambda name: one(name).try_cast("long")
    name_ok = lambda c: c.rlike("^[0-9A-Za-z_-]{1,64}$")
    times = number("s").between(0, MAX_EPOCH_MS) & number("e").between(0, MAX_EPOCH_MS) & (number("e") >= number("s"))
    good = (
        F.when(F.col("k") == "w", name_ok(one("id")) & times & number("act").isNotNull())
        .when(F.col("k") == "d", name_ok(one("id")))
        .when(F.col("k") == "day", valid_day(one("day")) & F.try_parse_json(one("m")).isNotNull())
        .when(F.col("k") == "ws", name_ok(one("wid")) & one("st").rlike("^[A-Za-z0-9_]{1,60}$") & number("gen").between(0, MAX_EPOCH_MS) & _good_chunk("ws"))
        .when(F.col("k") == "wd", name_ok(one("wid")) & number("gen").isNotNull() & one("expected").isNotNull())
        .when(F.col("k") == "hs", one("st").isNotNull() & _good_chunk("hs"))
        .when(F.col("k") == "ev", one("ty").isNotNull() & _good_chunk("ev"))
        .when(F.col("k") == "c", one("t").isNotNull() & number("at").between(0, MAX_EPOCH_MS) & one("cu").isin("true", "false"))
    )
    problem = F.when(F.try_parse_json("value").isNull(), "not JSON").when(~F.coalesce(allowed, F.lit(False)), "kind not allowed").when(~F.coalesce(good, F.lit(False)), "bad record")
    x = x.withColumn("problem", problem).drop("_keys", "_p", "_q")
    return x.filter("problem is null").drop("problem"), x.filter("problem is not null").select("path", "value", "problem")


def _rows(x: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the common shape; what isn't given is null."""
    base = {"subject": F.col("subject"), "type": F.col("type"), "k": F.col("k"), "seq": F.col("seq"), "batch": F.col("batchId"), "rid": F.col("reconcileId")} | columns
    return x.select(*(base.get(c, F.lit(None)).cast(_ROW_TYPES[c]).alias(c) for c in ROW))


def _decoded(x: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """keep, t, and the further columns of a kind of chunk records, plain (arrays) or compact (enc = 1)."""
    time, times, values, lists = CHUNKS[kind]
    plain_schema = ", ".join([f"{c} array<long>" for c in (time, *times)] + [f"{c} array<double>" for c in values])
    packed_schema = ", ".join(["n long", *(f"{c} {compact.COLUMN}" for c in (time, *times, *values))])
    is_compact = F.coalesce(F.get_json_object("value", "$.enc") == "1", F.lit(False))
    if lists:
        x = x.withColumn("_l", F.from_json("value", ", ".join(f"{c} array<string>" for c in lists))).select("*", *(F.col(f"_l.{c}").alias(c) for c in lists)).drop("_l")
    keys = [*keep, *lists]
    plain = x.filter(~is_compact).select(*keys, F.from_json("value", plain_schema).alias("p")).select(*keys, "p.*")
    packed = x.filter(is_compact).select(*keys, F.from_json("value", packed_schema).alias("p")).select(*keys, "p.*").filter(F.col(time).isNotNull() & (F.col("n") <= MAX_POINTS))
    both = plain.unionByName(compact.unpacked(packed, keys, [time, *times], list(values), MAX_EPOCH_MS)).filter(F.size(time) <= MAX_POINTS)
    return codec.rows_of_chunks(both, keep, time, [*times, *values, *lists])


#: Time, further times, values and lists of each kind of chunk.
CHUNKS = {"ws": ("t", (), STREAM_COLUMNS, ()), "hs": ("t", (), ("v", "lo", "hi"), ()), "ev": ("s", ("e",), ("v", "v2", "c"), ("ids", "meta"))}


def _parsed_chunks(x: DataFrame) -> DataFrame:
    """x with _keys, _p and _q: the names in a chunk record, and its columns read as compact and as plain ones, each parsed once."""
    times = sorted({c for t, more, _, _ in CHUNKS.values() for c in (t, *more)})
    values, lists = (sorted({c for kind in CHUNKS.values() for c in kind[i]}) for i in (2, 3))
    packed = ", ".join(["n long", *(f"{c} {compact.COLUMN}" for c in (*times, *values))])
    plain = ", ".join(["n long", *(f"{c} array<long>" for c in times), *(f"{c} array<double>" for c in values), *(f"{c} array<string>" for c in lists)])
    chunk = F.col("k").isin(*CHUNKS)
    is_compact = F.get_json_object("value", "$.enc") == "1"
    return x.withColumns({"_keys": F.when(chunk, F.json_object_keys("value")), "_p": F.when(chunk & is_compact, F.from_json("value", packed)), "_q": F.when(chunk, F.from_json("value", plain))})


def _good_chunk(kind: str) -> Column:
    """Whether the columns of a chunk record fit together and decode."""
    time, times, values, lists = CHUNKS[kind]
    p, q, n = F.col("_p"), F.col("_q"), F.coalesce("_p.n", F.size(F.col(f"_q.{time}")).cast("long"))
    present = lambda c: F.array_contains("_keys", c)
    entries = lambda names, of: F.array(*(F.struct(present(c).alias("given"), of[c].alias("c")) for c in names))
    sound = lambda whole: lambda e: ~e["given"] | compact.sound(e["c"], n, whole, MAX_EPOCH_MS)
    packed = n.between(1, MAX_POINTS) & F.forall(F.array(F.struct(F.lit(True).alias("given"), p[time].alias("c")), *(F.struct(present(c).alias("given"), p[c].alias("c")) for c in times)), sound(True)) & F.forall(entries(values, p), sound(False))
    plain = q["n"].isNull() & (n <= MAX_POINTS) & F.forall(q[time], lambda t: t.isNotNull() & t.between(0, MAX_EPOCH_MS))
    equal = F.lit(True)
    for c in lists:
        equal &= ~present(c) | (F.size(q[c]) == n)
    for c in (*times, *values):
        plain &= ~present(c) | (F.size(q[c]) == n)
    return F.coalesce(equal & F.when(p.isNotNull(), packed).otherwise(plain), F.lit(False))


_HEAD = ["subject", "type", "k", "seq", "batchId", "reconcileId"]


def rows(good: DataFrame) -> DataFrame:
    """The common rows of workouts, days, hours and events."""
    one = lambda name: F.get_json_object("value", f"$.{name}")
    w = good.filter("k = 'w'")
    workouts = _rows(w, id=one("id"), s=one("s").try_cast("long"), e=one("e").try_cast("long"), src=one("src"), bid=one("bid"), dev=one("dev"), tz=one("tz"), extra=F.col("value"))
    day_ms = F.datediff(F.try_to_date(one("day"), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS
    days = _rows(good.filter("k = 'day'"), id=one("day"), s=day_ms, e=day_ms + DAY_MS, extra=F.concat(F.lit('{"m":'), one("m"), F.lit("}")))
    h = good.filter("k = 'hs'").withColumns({"st": one("st"), "u": one("u")})
    h = _decoded(h, "hs", [*_HEAD, "st", "u"])
    hours = _rows(h, s=F.col("t"), e=F.col("t") + 3_600_000, v=F.col("v"), v2=F.col("lo"), v3=F.col("hi"), u=F.col("u"), agg=F.col("st"))
    e = good.filter("k = 'ev'").withColumns({c: one(c) for c in ("ty", "u", "src", "bid")})
    both = _decoded(e, "ev", [*_HEAD, "ty", "u", "src", "bid"])
    events = _rows(both, id=F.col("ids"), s=F.col("t"), e=F.coalesce("e", "t"), v=F.col("v"), v2=F.col("v2"), c=F.col("c"), u=F.col("u"), agg=F.col("ty"), src=F.col("src"), bid=F.col("bid"), extra=F.col("meta")).filter("e >= s")
    return workouts.unionByName(days).unionByName(hours).unionByName(events).withColumn("month", F.date_format(local_day(F.col("s")), "yyyy-MM"))


def stream_points(good: DataFrame) -> DataFrame:
    """subject, wid, stream, gen, batch, unit, t and the value columns of raw streams."""
    one = lambda name: F.get_json_object("value", f"$.{name}")
    x = good.filter("k = 'ws'").select("subject", "value", F.col("batchId").alias("batch"), one("wid").alias("wid"), one("st").alias("stream"), one("gen").try_cast("long").alias("gen"), one("u").alias("unit"))
    return _decoded(x, "ws", ["subject", "wid", "stream", "gen", "batch", "unit"])


def marks(good: DataFrame) -> DataFrame:
    """subject, wid, gen, expected (stream to points) of each marker."""
    one = lambda name: F.get_json_object("value", f"$.{name}")
    return good.filter("k = 'wd'").select("subject", one("wid").alias("wid"), one("gen").try_cast("long").alias("gen"), F.from_json(one("expected"), "map<string,long>").alias("expected"))


def tombstones(good: DataFrame) -> DataFrame:
    return good.filter("k = 'd'").select("subject", "type", F.get_json_object("value", "$.id").alias("id"))


def statuses(good: DataFrame) -> DataFrame:
    one = lambda name: F.get_json_object("value", f"$.{name}")
    return good.filter("k = 'c'").select("subject", one("t").alias("type"), one("at").try_cast("long").alias("at"), (one("cu") == "true").alias("caught_up"))


def coverage(heads: DataFrame, checked: DataFrame, spans: DataFrame) -> DataFrame:
    """subject, type, intervals (merged, of what is synced), caught_up, checked_at, earliest, latest.

    heads: headers; a window counts as synced, and a pass that has caught up counts from 0 on. checked: statuses. spans: rows.
    """
    usual = heads.filter("problem is null and mode <> 'stats'")
    window = usual.filter("window is not null").select("subject", "type", F.col("window.start").alias("s"), F.col("window.end").alias("e"))
    caught = usual.filter("caughtUp and mode in ('anchored', 'reconcile')").select("subject", "type", F.coalesce("checkedAt", "createdAt").alias("at"))
    caught = caught.unionByName(checked.filter("caught_up").select("subject", "type", "at"))
    known = merge(window.unionByName(caught.select("subject", "type", F.lit(0).cast("long").alias("s"), F.col("at").alias("e"))), ["subject", "type"])
    a = known.groupBy("subject", "type").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("intervals"))
    b = caught.select("subject", "type").distinct().withColumn("caught_up", F.lit(True))
    times = usual.select("subject", "type", F.col("checkedAt").alias("at")).unionByName(checked.select("subject", "type", "at"))
    c = times.groupBy("subject", "type").agg(F.max("at").alias("checked_at"))
    d = spans.groupBy("subject", "type").agg(F.min("s").alias("earliest"), F.max("e").alias("latest"))
    key = ["subject", "type"]
    return c.join(a, key, "full").join(b, key, "left").join(d, key, "full").withColumn("caught_up", F.coalesce("caught_up", F.lit(False)))


def complete(cover: DataFrame, start_ms: int, end_ms: int, now_ms: int, stale_ms: int = DAY_MS) -> DataFrame:
    """cover with complete: one interval holds the range (up to now) and the last check is not stale."""
    end = min(end_ms, now_ms)
    inside = F.exists("intervals", lambda i: (i["s"] <= start_ms) & (i["e"] >= end))
    fresh = (now_ms - F.col("checked_at")) <= stale_ms
    return cover.withColumn("complete", F.coalesce((inside | (F.col("caught_up") & (F.col("checked_at") >= end))) & fresh, F.lit(False)))


def raw_complete(points: DataFrame, marked: DataFrame) -> DataFrame:
    """subject, wid, complete: each stream that the newest marker expects has arrived in full at that generation."""
    newest = marked.groupBy("subject", "wid").agg(F.max_by("expected", "gen").alias("expected"), F.max("gen").alias("gen"))
    need = newest.select("subject", "wid", "gen", F.explode_outer("expected").alias("stream", "n"))
    have = points.groupBy("subject", "wid", "stream", "gen").agg(F.count("*").alias("have"))
    x = need.join(have, ["subject", "wid", "stream", "gen"], "left")
    return x.groupBy("subject", "wid").agg(F.min(F.coalesce(F.col("have") >= F.col("n"), F.col("stream").isNull())).alias("complete"))
