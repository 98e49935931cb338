"""As-of joins with interpolation: probes meet the points around them in one sort by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.operators.dealing import dealt


def at(points: DataFrame, probes: DataFrame, by: list[str], x: str, y: str, out: str, clamp: bool = False) -> DataFrame:
    """probes with out: y where x first reaches the probe's x, on a line between the points around it.

    points (by, x, y): y doesn't fall as x grows. Outside the points, out is null, or the nearest end's y if clamp.
    """
    more = [c for c in probes.columns if c not in (*by, x)]
    p = points.groupBy(*by, x).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi")).select(*by, x, "_lo", "_hi", F.lit(1).alias("_kind"), *(F.lit(None).cast(dict(probes.dtypes)[c]).alias(c) for c in more))
    q = probes.select(*by, F.col(x).cast(dict(points.dtypes)[x]).alias(x), F.lit(None).cast(dict(points.dtypes)[y]).alias("_lo"), F.lit(None).cast(dict(points.dtypes)[y]).alias("_hi"), F.lit(0).alias("_kind"), *more)
    # one sort: what came last before a probe, and what comes first after it
    order = f"(PARTITION BY {', '.join(f'`{c}`' for c in by)} ORDER BY `{x}`, _kind)"
    up = Window.partitionBy(*by).orderBy(x, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    z = dealt(p.unionByName(q), by).withColumn("_at", F.when(F.col("_kind") == 1, F.col(x)))
    z = z.withColumns(
        {
            "_x0": F.last("_at", True).over(up), "_y0": F.last("_hi", True).over(up),
            "_x1": F.expr(f"lead(_at, 1) IGNORE NULLS OVER {order}"), "_y1": F.expr(f"lead(_lo, 1) IGNORE NULLS OVER {order}"),
        }
    ).filter("_kind = 0")
    line = F.col("_y0") + (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0"))
    found = F.when((F.col("_x1") == F.col(x)), F.col("_y1").cast("double")).when(F.col("_x0").isNotNull() & F.col("_x1").isNotNull(), line)
    if clamp:
        found = F.coalesce(found, F.col("_y0").cast("double"), F.col("_y1").cast("double"))
    return z.withColumn(out, found).select(*probes.columns, out)
