"""Vector functions over arrays, and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector has length 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def reciprocal_rank(weight: float, rank: Column, k: int = 60) -> Column:
    return F.lit(weight) / (F.lit(k) + rank)
