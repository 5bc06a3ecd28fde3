"""Connected components of a large graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of every node are linked to the smallest of them."""
    if large:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:  # only the smaller neighbours
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (a, b) edges; the component is its smallest node.

    Each round writes its edges to the shared folder, which cuts the lineage;
    the number of rounds grows with the logarithm of the longest path. A node
    with very many neighbours is an ordinary skewed join key here: its minimum
    is a partial aggregate, and AQE splits the join.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct(), "edges")
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    while before[0]:
        edges = materialise(_stars(_stars(edges, True), False), "edges")
        after = print_of(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
