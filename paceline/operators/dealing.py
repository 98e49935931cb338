"""Rows dealt by key, where the plan must not rely on how they happen to lie."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """df, a union, dealt by its key for a window or join above.

    Spark 4.1 takes a union whose sides are dealt by one key as dealt by it. Sides that adaptive execution changes later don't keep that, and a join
    above fails for unequal numbers of partitions. A plain repartition by that key is left out as needless; with its first column
    named twice it stays, and deals rows of a key together all the same.
    """
    return df.repartition(*by, by[0])
