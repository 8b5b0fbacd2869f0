"""Vectors as arrays: norm, dot product, cosine, validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is null or has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def strict_cosine(a: Column, b: Column) -> Column:
    """Fails where a vector has no length; the lengths of both must be the same."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths")).cast("double")).when(n > 0, dot(a, b) / n).otherwise(F.raise_error(F.lit("a vector has no length")).cast("double"))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def valid(a: Column, dim: Column) -> Column:
    """Not null, of that length, all elements finite and not null."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
