"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if either is all zero, null if either is null or they differ in length."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale))


def clamp(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def three_decimals(score: Column) -> Column:
    """The score with three decimals, halves to even."""
    return F.bround(score.cast("decimal(20,10)"), 3).cast("decimal(10,3)").cast("string")
