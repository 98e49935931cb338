"""Columns as scaled integers where these give every value back, chunk numbers, and chunks as rows. Compact columns are in compact.py."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIVISORS = (1, 10, 100, 1_000, 10_000, 100_000, 1_000_000)
SAFE = 2**53 - 1
LARGEST_SCALED = 9e15
CHUNK = 5_000


def exact_divisor(values: DataFrame, by: list[str], column: str = "v") -> DataFrame:
    """by, divisor: the least power of ten up to 10**6 at which all values are whole and read back the same; else null."""
    x = F.col(column)
    whole = lambda m: F.min(F.coalesce((F.floor(x * m + 0.5) / F.lit(float(m)) == x) & (F.abs(F.floor(x * m + 0.5)) <= SAFE), F.lit(True)))
    out = values.groupBy(*by).agg(*(whole(m).alias(f"_m{m}") for m in DIVISORS))
    found = F.coalesce(*(F.when(F.col(f"_m{m}"), m) for m in DIVISORS))
    return out.select(*by, found.alias("divisor"))


def scaled(values: DataFrame, divisors: DataFrame, by: list[str], column: str = "v") -> DataFrame:
    """values with i, the scaled integer, and divisor."""
    return values.join(divisors, by).withColumn("i", F.floor(F.col(column) * F.col("divisor") + 0.5).cast("long"))


def divisors(points: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and for each column <column>_m: its least exact divisor among the group's values (1 without values), or null."""
    whole = lambda c, m: F.min(F.coalesce((F.floor(F.col(c) * m + 0.5) / F.lit(float(m)) == F.col(c)) & (F.abs(F.col(c) * m) <= LARGEST_SCALED), F.lit(True)))
    out = points.groupBy(*by).agg(*(whole(c, m).alias(f"_{c}_{m}") for c in columns for m in DIVISORS))
    return out.select(*by, *(F.coalesce(*(F.when(F.col(f"_{c}_{m}"), m) for m in DIVISORS)).alias(f"{c}_m") for c in columns))


def stored(points: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """points as they are stored: instead of each column, <column>_i (integers) and <column>_m where the group's values are exact short decimals, else the column.

    Integers of slowly changing values take few bytes in Parquet, and the divisor, one value a group, next to none.
    """
    x = points.join(divisors(points, by, columns), by)
    scaled_columns = {f"{c}_i": F.when(F.col(f"{c}_m").isNotNull(), F.floor(F.col(c) * F.col(f"{c}_m") + 0.5).cast("long")) for c in columns}
    return x.withColumns(scaled_columns).withColumns({c: F.when(F.col(f"{c}_m").isNull(), F.col(c)) for c in columns})


def restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    """What stored() was given, of the columns that are asked for; the others' integers and divisors are not read."""
    x = rows.withColumns({c: F.coalesce(F.col(f"{c}_i").cast("double") / F.col(f"{c}_m"), F.col(c)) for c in columns})
    return x.select(*(c for c in rows.columns if c in columns or not re.fullmatch(r"(.+)_[im]", c) or re.sub(r"_[im]$", "", c) not in rows.columns))


def chunk_number(by: list[str], order: str, size: int = CHUNK) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1) / size).cast("int")


def rows_of_chunks(chunks: DataFrame, keys: list[str], time: str, values: list[str]) -> DataFrame:
    """keys, t and a column for each value: parallel arrays as rows; chunks of unequal lengths go."""
    same = F.lit(True)
    for v in values:
        same &= F.col(v).isNull() | (F.size(v) == F.size(time))
    x = chunks.filter(same).select(*keys, F.posexplode(time).alias("pos", "t"), *values)
    return x.select(*keys, "t", *(F.get(v, F.col("pos")).alias(v) for v in values))
