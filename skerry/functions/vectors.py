"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = l2_norm(v)
    return F.element_at(F.transform(F.array(n), lambda k: F.when(k > 0, F.transform(doubles(v), lambda x: x / k)).otherwise(doubles(v))), 1)


def truncate(v: Column, dims: int) -> Column:
    """The first ``dims`` numbers, brought to unit length again."""
    return normalize(F.slice(v, 1, dims))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (l2_norm(a) * l2_norm(b))


def mean_of(vectors: Column) -> Column:
    """Element-wise mean of an array of equally long vectors, at unit length."""
    n = F.size(vectors)
    total = F.aggregate(vectors, F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, doubles(v), lambda x, y: x + y))
    return normalize(F.transform(total, lambda x: x / n))
