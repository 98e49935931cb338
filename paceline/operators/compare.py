"""Two versions of one table compared as multisets: what is the same, what changed in which field, what is only in one.

Equal rows cancel by their counts, so copies are never written out as pairs. What is left is paired within a key, for each set
of fields that may differ in turn, fewest first and then in the order of the columns: rows that agree in all other fields are
paired along their order. A pair is two intervals of a running count that overlap, so a key's rows meet in one sort.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.sources import shared

FLOATING = ("double", "float")


def leftovers(a: DataFrame, b: DataFrame, by: list[str], fields: list[str]) -> DataFrame:
    """Rows of which one side has more: by, fields, side (0: a, 1: b), n (how many more). Null equals null, NaN equals NaN."""
    signed = lambda df, k: df.select(*by, *fields, F.lit(k).cast("long").alias("_k"))
    x = signed(a, 1).unionByName(signed(b, -1)).groupBy(*by, *fields).agg(F.sum("_k").alias("_k")).filter("_k <> 0")
    return x.select(*by, *fields, F.when(F.col("_k") > 0, 0).otherwise(1).alias("side"), F.abs("_k").alias("n"))


def _with_chains(x: DataFrame, by: list[str], floating: list[str], tolerance: float) -> DataFrame:
    """A number for each floating field (_c_...) that values of a key share if each is at most tolerance from the next.

    Values that agree within tolerance share it; others may, so pairs are checked. Nulls share one number, NaNs another.
    """
    for f in floating:
        w = Window.partitionBy(*by).orderBy(f)
        same = F.coalesce(F.col(f) - F.lag(f).over(w) <= tolerance, F.lit(False)) | F.col(f).eqNullSafe(F.lag(f).over(w))
        x = x.withColumn(f"_c_{f}", F.when(same, 0).otherwise(1))
        x = x.withColumn(f"_c_{f}", F.sum(f"_c_{f}").over(w))  # by range: equal values together
    return x


def _changed(field: str, floating: bool, tolerance: float) -> Column:
    before, after = F.col(f"before.{field}"), F.col(f"after.{field}")
    same = before.eqNullSafe(after)
    return ~(same | F.coalesce(F.abs(before - after) <= tolerance, F.lit(False))) if floating else ~same


def matched(a: DataFrame, b: DataFrame, by: list[str], tolerance: float = 1e-9, most: int = 2) -> DataFrame:
    """by, before, after (structs of the other columns; null: only one side has it), changed (names of fields), n.

    Equal rows are left out; an empty changed is a pair that differs within tolerance (of floating numbers). Sets of up to most
    changed fields are tried one by one, then all fields at once. b may have more columns, which don't count.
    """
    fields = [c for c in a.columns if c not in by]
    if not fields:
        raise ValueError("there must be a column beside the key")
    floating = [c for c, k in a.dtypes if k in FLOATING and c not in by]
    chains = [f"_c_{c}" for c in floating]
    x = shared.written(_with_chains(leftovers(a, b.select(a.columns), by, fields), by, floating, tolerance), "leftovers")
    sets = [s for k in range(min(most, len(fields) - 1) + 1) for s in combinations(fields, k)] + [tuple(fields)]
    found: list[DataFrame] = []
    for may_differ in sets:
        if x.agg(F.count_distinct("side")).first()[0] < 2:
            break
        segments = shared.written(_along(x, by, fields, chains, may_differ), "segments")
        changed = F.array_compact(F.array(*(F.when(_changed(c, c in floating, tolerance), F.lit(c)) for c in fields)))
        s = segments.withColumn("changed", changed)
        paired = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.size(F.array_except("changed", F.array(*map(F.lit, may_differ)).cast("array<string>"))) == 0)
        found.append(s.filter(paired).select(*by, "before", "after", "changed", "n"))
        sides = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("side"), F.col(c).alias("_r"))) for k, c in enumerate(("before", "after")))))
        rest = s.filter(~paired).select(*by, "n", F.inline(sides)).select(*by, "n", "side", "_r.*")
        x = shared.written(rest.groupBy(*by, *fields, *chains, "side").agg(F.sum("n").alias("n")), "leftovers")
    row = F.struct(*fields, *chains)
    single = x.select(*by, F.when(F.col("side") == 0, row).alias("before"), F.when(F.col("side") == 1, row).alias("after"), F.array().cast("array<string>").alias("changed"), "n")
    for part in found:
        single = single.unionByName(part)
    plain = lambda c: F.when(F.col(c).isNotNull(), F.struct(*(F.col(f"{c}.{f}").alias(f) for f in fields))).alias(c)
    return single.select(*by, plain("before"), plain("after"), "changed", "n")


def _along(x: DataFrame, by: list[str], fields: list[str], chains: list[str], may_differ: tuple[str, ...]) -> DataFrame:
    """by, before, after, n: rows of both sides that agree in all but may_differ, side by side along their order."""
    group = by + [f"_c_{c}" if f"_c_{c}" in chains else c for c in fields if c not in may_differ]
    x = x.withColumn("_row", F.struct(*fields, *chains)).withColumn("_dealt", F.xxhash64(*group) if group else F.lit(0)).repartition("_dealt")
    own = Window.partitionBy("_dealt", *group, "side").orderBy(*fields).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_dealt", *group).orderBy(F.desc("_end"), "side")
    seen = lambda k: F.last(F.when(F.col("side") == k, F.col("_row")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_end", F.sum("n").over(own))
    x = x.select(*by, seen(0).alias("before"), seen(1).alias("after"), (F.col("_end") - F.lead("_end", 1, 0).over(down)).alias("n"))
    return x.filter("n > 0")


def field_changes(found: DataFrame, by: list[str]) -> DataFrame:
    """by, field, before, after (as text), n of each changed field of matched() pairs."""
    fields = found.schema["before"].dataType.names
    text = lambda side, f: F.col(f"{side}.{f}").cast("string")
    each = F.array(*(F.struct(F.lit(f).alias("field"), text("before", f).alias("before"), text("after", f).alias("after")) for f in fields))
    x = found.filter("before is not null and after is not null").select(*by, "n", F.inline(F.filter(each, lambda e: F.array_contains("changed", e["field"]))))
    return x.groupBy(*by, "field", "before", "after").agg(F.sum("n").alias("n"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: equivalent, within (pairs that differ within tolerance), changed, missing, added, widest (largest difference of a floating number of any pair)."""
    floating = [f.name for f in found.schema["before"].dataType.fields if f.dataType.typeName() in FLOATING]
    pair = F.col("before").isNotNull() & F.col("after").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    widest = [F.max(F.abs(F.col(f"before.{f}") - F.col(f"after.{f}"))) for f in floating]
    x = found.agg(
        total(pair & (F.size("changed") == 0)).alias("within"), total(pair & (F.size("changed") > 0)).alias("changed"), total(F.col("after").isNull()).alias("missing"), total(F.col("before").isNull()).alias("added"),
        F.coalesce(*widest, F.lit(0.0)).alias("widest") if len(widest) < 2 else F.coalesce(F.greatest(*widest), F.lit(0.0)).alias("widest"),
    )
    return x.select((F.col("changed") + F.col("missing") + F.col("added") == 0).alias("equivalent"), "*")
