"""Vector arithmetic on ``array<float>`` columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length 1; components are null when it has no length."""
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm(vector)))


def along(vector: Column, direction: Column) -> Column:
    """Cosine with a ``direction`` of length 1; null when either has no length."""
    return F.try_divide(dot(vector, direction), norm(vector))
