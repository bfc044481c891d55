"""Vectors as rows of double arrays, and exact cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Whether a vector is not null, has a non-zero component and only finite, non-null ones."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def doubles(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn(column, F.col(column).cast("array<double>"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column; all must have one length."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component is divided out first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def running_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row sum of products, added up from the first component to the last."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total = total + a[:, j] * b[:, j]
    return total


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dot / (|a| |b|) in double precision; scaled first only where the plain sums leave the range of doubles."""
    with np.errstate(all="ignore"):
        out = running_dot(a, b) / (np.sqrt(running_dot(a, a)) * np.sqrt(running_dot(b, b)))
        odd = ~np.isfinite(out) | (np.abs(out) > 1.5)
        if odd.any():
            out[odd] = running_dot(unit(a[odd]), unit(b[odd]))
    return out
