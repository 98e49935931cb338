"""Vectors that can be reckoned with, and their entries as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """The rows of vectors whose vector has entries, none of them null or non-finite, and their dimension.

    Vectors of other lengths than the most frequent one (of equally frequent ones the longest) cannot be compared with the rest and go too.
    Without any such vector the dimension is 0.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    kept = vectors.filter((F.size(column) > 0) & F.forall(column, finite))
    sizes = kept.groupBy(F.size(column).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).head(1)
    width = sizes[0]["size"] if sizes else 0
    return kept.filter(F.size(column) == width), width


def entries(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of one length as doubles, one list a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
