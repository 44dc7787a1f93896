"""Scalar functions of numeric arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda n, x: n + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def argmax(a: Column) -> Column:
    """0-based place of the first largest entry."""
    return F.array_position(a, F.array_max(a)).cast("int") - 1


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / total(e))
