"""Expressions over ARRAY<DOUBLE> columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a, b) -> Column:
    return F.sqrt(squared_distance(a, b))


def plus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def over(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x / y)


def scaled(a, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def blend(a, b, weight: Column) -> Column:
    """``weight * a + (1 - weight) * b``."""
    return F.zip_with(a, b, lambda x, y: weight * x + (1.0 - weight) * y)


def mean(a) -> Column:
    return total(a) / F.size(a)


def std_pop(a) -> Column:
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def argmax(a) -> Column:
    """Zero-based position of the first largest element."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def count_at_least(a, threshold: float) -> Column:
    return F.size(F.filter(a, lambda x: x >= F.lit(threshold)))


def as_double(a) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def rounded(a, digits: int) -> Column:
    return F.transform(a, lambda x: F.round(x, digits))


def concat_all(columns) -> Column:
    return reduce(lambda x, y: F.concat(x, y), columns)
