"""Columns over arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of unequal length or without direction."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), dot(a, b) / both).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def weighted_mean(original: Column, others: Column, weight: float = 2.0) -> Column:
    """Mean of a vector and an array of vectors, the first one counting ``weight`` times, at unit length."""
    total = F.aggregate(others, F.transform(original, lambda x: x.cast("double") * weight), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return normalised(F.transform(total, lambda x: x / (weight + F.size(others))))
