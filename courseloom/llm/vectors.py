"""Rows of vectors: which of them count, and their entries as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, below: float = float("inf")) -> Column:
    """Whether a vector of doubles is there, has an entry, and all are finite numbers of less than
    this magnitude."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < below))


def common_length(rows: DataFrame, vector: str) -> int:
    """The length most vectors have (of several, the greatest); 0 without a row."""
    most = rows.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return most["length"] if most else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The vectors of a batch, all of this length, one a row."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, length)
