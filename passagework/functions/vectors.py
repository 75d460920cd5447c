"""Similarity functions of two vectors, as native expressions over arrays of doubles.

Vectors of different lengths, and vectors with null components, have a null similarity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidConfig


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _zip(a: Column, b: Column, f) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, f))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_zip(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(_zip(a, b, lambda x, y: F.abs(x - y)))


def angular(a: Column, b: Column) -> Column:
    cos = cosine(a, b)
    return F.when(cos.isNotNull(), F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cos))) / F.pi())


def chebyshev(a: Column, b: Column) -> Column:
    gaps = _zip(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda m, x: F.when(m.isNull() | x.isNull(), None).otherwise(F.greatest(m, x)))


def minkowski(a: Column, b: Column, p: int) -> Column:
    return F.pow(_sum(_zip(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(p))))), F.lit(1.0 / p))


def similarity(name: str, a: Column, b: Column, p: int | None = None) -> Column:
    known = {"cosine": cosine, "euclidean": euclidean, "manhattan": manhattan, "angular": angular, "chebyshev": chebyshev, "dotProduct": dot}
    if name == "minkowski" and p:
        return minkowski(a, b, p)
    if name not in known:
        raise InvalidConfig(f"no similarity {name}")
    return known[name](a, b)
