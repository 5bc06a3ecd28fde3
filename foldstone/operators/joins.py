"""Joins with a contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .ranking import _cols, attach


def require_unique(df: DataFrame, key) -> None:
    """Fail when a key occurs twice."""
    repeated = df.groupBy(*_cols(key)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").limit(1).count()
    if repeated:
        raise ValueError(f"{key} is not unique: the join would change the row count")


def guarded_left_join(left: DataFrame, right: DataFrame, key) -> DataFrame:
    """Left join that provably keeps the row count: the right key is unique."""
    require_unique(right, key)
    return left.join(right, key, "left")


def keyed_lookup(features: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Rows for a key list; a key listed twice comes back twice."""
    return keys.join(features, key)


def group_overlap(tagged: DataFrame, group: str, by=()) -> DataFrame:
    """Groups on both sides of a split."""
    test = F.max((F.col("split") == "test").cast("int"))
    train = F.max((F.col("split") == "train").cast("int"))
    marks = tagged.groupBy(*_cols(by), group).agg(test.alias("_te"), train.alias("_tr"))
    return marks.where("_te = 1 and _tr = 1").drop("_te", "_tr")


def aligned(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """Inner join after checking that both sides hold the same keys."""
    only_a = a.join(b, key, "left_anti").limit(1).count()
    only_b = b.join(a, key, "left_anti").limit(1).count()
    if only_a or only_b:
        raise ValueError("the two tables do not hold the same keys")
    return a.join(b, key)


def misaligned(a: DataFrame, b: DataFrame, key) -> DataFrame:
    """(side, n) of keys that only one table has."""
    def count(x, y, name):
        return x.join(y, key, "left_anti").agg(F.lit(name).alias("side"), F.count(F.lit(1)).alias("n"))

    return count(a, b, "only_a").unionByName(count(b, a, "only_b"))


def with_group_stat(df: DataFrame, by, **stats: Column) -> DataFrame:
    """Aggregate once per group and join back: no window over whole groups."""
    table = df.groupBy(*_cols(by)).agg(*[c.alias(n) for n, c in stats.items()])
    return attach(df, settle(table), by, "inner")
