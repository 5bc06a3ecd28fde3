"""Exact positions and quantiles without a one-task window.

A plain ``row_number() over (partition by g ...)`` puts all rows of ``g`` into
one task. The helpers here cut each group into pieces first, number inside the
pieces, and shift by the sizes of the pieces before, so a group holding a
third of all rows is spread over the cluster and the numbers stay the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import digest
from ..session import materialise, settle


def _cols(names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def attach(df: DataFrame, other: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join on equal keys where null equals null, keeping one copy of the keys."""
    keys = _cols(keys)
    if not keys:
        return df.crossJoin(other)  # ``other`` is a one-row aggregate here
    renamed = other.select(
        *[F.col(k).alias(f"__{k}") for k in keys], *[c for c in other.columns if c not in keys]
    )
    on = None
    for k in keys:
        test = df[k].eqNullSafe(renamed[f"__{k}"])
        on = test if on is None else on & test
    return df.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def _before(df: DataFrame, by: list[str], piece: str, measure: str, out: str) -> DataFrame:
    """Sum of ``measure`` over the earlier pieces of the same group."""
    window = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(piece)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(out, F.coalesce(F.sum(measure).over(window), F.lit(0)))


def hash_rank(
    df: DataFrame, by, key, seed: object = "", out: str = "rank", digits: int = 3
) -> DataFrame:
    """1-based position of each row inside its ``by`` group, in md5 order.

    Pieces are the first ``digits`` hex digits of the md5, so they are even
    whatever the group sizes: 3 digits cut every group in 4,096 pieces.
    """
    by, key = _cols(by), _cols(key)
    marked = df.withColumn("_md5", digest(*([seed] if seed != "" else []), *[F.col(k) for k in key]))
    marked = marked.withColumn("_piece", F.substring("_md5", 1, digits))
    sizes = marked.groupBy(*by, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    shifts = _before(sizes, by, "_piece", "_n", "_shift").drop("_n")
    inside = Window.partitionBy(*by, "_piece").orderBy("_md5", *key)
    return (
        attach(marked, shifts, [*by, "_piece"], "inner")
        .withColumn(out, (F.row_number().over(inside) + F.col("_shift")).cast("bigint"))
        .drop("_md5", "_piece", "_shift")
    )


def size_rank(df: DataFrame, size: str, key, by=(), out: str = "rank") -> DataFrame:
    """1-based position inside ``by`` by ``size`` descending, then md5 of ``key``.

    Rows of one size are numbered by :func:`hash_rank`; the shift per size is
    a running sum over the distinct sizes only.
    """
    by = _cols(by)
    inner = hash_rank(df, [*by, size], key, out="_in")
    sizes = df.groupBy(*by, size).agg(F.count(F.lit(1)).alias("_n")).withColumn("_neg", -F.col(size))
    shifts = _before(sizes, by, "_neg", "_n", "_shift").select(*by, size, "_shift")
    return (
        attach(inner, shifts, [*by, size], "inner")
        .withColumn(out, F.col("_in") + F.col("_shift"))
        .drop("_in", "_shift")
    )


def _range_pieces(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Range-partition by group and order; written so that pieces stay fixed."""
    keys = [*by, *order]
    # without a fixed number, AQE merges neighbouring ranges of small inputs
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return materialise(placed, "ordered").withColumn("_piece", F.shiftright("_place", 33))


def ordered_rank(df: DataFrame, by, order: Sequence[str], out: str = "rank") -> DataFrame:
    """1-based position inside ``by`` in ``order``, which must end in a unique key.

    A hot group spans many range partitions. Only the per-piece minimum and
    count are joined back, so the rows themselves are shuffled once.
    """
    by, order = _cols(by), _cols(order)
    placed = _range_pieces(df, by, order)
    pieces = placed.groupBy(*by, "_piece").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    shifts = settle(_before(pieces, by, "_piece", "_n", "_shift").drop("_n"))
    return (
        attach(placed, shifts, [*by, "_piece"], "inner")
        .withColumn(out, F.col("_place") - F.col("_first") + F.col("_shift") + 1)
        .drop("_place", "_piece", "_first", "_shift")
    )


def running_total(df: DataFrame, by, order, measure: str, out: str) -> DataFrame:
    """Inclusive running sum of ``measure`` inside ``by`` along ``order``."""
    by, order = _cols(by), _cols(order)
    placed = _range_pieces(df, by, order)
    pieces = placed.groupBy(*by, "_piece").agg(F.sum(measure).alias("_n"))
    shifts = _before(pieces, by, "_piece", "_n", "_shift").drop("_n")
    inside = (
        Window.partitionBy(*by, "_piece")
        .orderBy("_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        attach(placed, shifts, [*by, "_piece"], "inner")
        .withColumn(out, F.sum(measure).over(inside) + F.col("_shift"))
        .drop("_place", "_piece", "_shift")
    )


def weighted_total(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Non-null values per group."""
    return df.groupBy(*by).agg(F.count(value).alias("_total")).where("_total > 0")


def exact_quantiles(
    df: DataFrame, by, value: str, probs: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any group size.

    Equal values collapse to one weighted row before the shuffle, so copies
    cost nothing; a hot group with many distinct values is range-partitioned.
    """
    by = _cols(by)
    weighted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_w"))
    )
    cumulated = running_total(weighted, by, ["_v"], "_w", "_upto")
    totals = settle(weighted_total(df, by, value))
    rows = attach(cumulated, totals, by, "inner")

    def at(position: Column) -> Column:
        inside = (F.col("_upto") - F.col("_w") <= position) & (position < F.col("_upto"))
        return F.max(F.when(inside, F.col("_v")))

    sides = []
    for i, p in enumerate(probs):
        position = (F.col("_total") - 1) * F.lit(float(p))
        sides += [at(F.floor(position)).alias(f"_lo{i}"), at(F.ceil(position)).alias(f"_hi{i}")]
    picked = rows.groupBy(*by).agg(F.max("_total").alias("_total"), *sides)
    out = []
    for i, (p, name) in enumerate(zip(probs, names)):
        position = (F.col("_total") - 1) * F.lit(float(p))
        fraction = position - F.floor(position)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * fraction).alias(name))
    return picked.select(*by, *out)


def first_by(df: DataFrame, by, order: Sequence[Column], k: int = 1) -> DataFrame:
    """The ``k`` first rows of each group.

    Spark keeps at most ``k`` rows per group on the map side, so a hot group
    never reaches one task whole.
    """
    window = Window.partitionBy(*(_cols(by) or [F.lit(0)])).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def vocabulary(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct values of a column known to be a small vocabulary."""
    rows = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values; it is not a vocabulary")
    return sorted(r[0] for r in rows)
