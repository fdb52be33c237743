"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """M1."""
    return dot(a, b) / (norm(a) * norm(b))


def valid_vector(a: Column, dims: int) -> Column:
    """M2: exact size, every number finite, and a norm that is neither 0 nor infinite; false for null."""
    infinite = F.lit(float("inf"))
    finite = F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < infinite))
    return F.coalesce((F.size(a) == dims) & finite & (dot(a, a) > 0) & (dot(a, a) < infinite), F.lit(False))
