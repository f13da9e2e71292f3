"""Dense-vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_norm(a: Column) -> Column:
    return inner(a, a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    size = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return inner(a, b) / F.when(size > 0, size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
