"""What the vector operators share: which vectors take part, and cosines in double precision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: Column) -> Column:
    """True for vectors that are not null or zero and hold no null, NaN or infinite component."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def in_common_dimension(vectors: DataFrame, column: str) -> DataFrame:
    """Rows of the dimension that most rows have (the smaller one of two that are as frequent), as doubles."""
    best = vectors.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    as_double = vectors.withColumn(column, F.col(column).cast("array<double>"))
    return as_double if best is None else as_double.filter(F.size(column) == best["d"])


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows over their largest component, so that no length over- or underflows."""
    return rows / np.abs(rows).max(axis=1, keepdims=True)


def cosines(rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Cosine of each row with the vector; equal rows have equal results, wherever they stand."""
    return (rows * vector).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((vector * vector).sum()))
