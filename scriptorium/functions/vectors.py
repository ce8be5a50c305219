"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors, 0 where either has no length."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))
