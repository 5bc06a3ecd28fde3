"""Forests whose trees never meet on the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import forest
from foldstone.operators.evaluate import score
from tests.test_boosting import data


def guesses(df, **settings):
    out = forest.forest_oof(df, "key", "vec", "label", **settings)
    return {r["key"]: r["y_pred"] for r in out.collect()}


def test_forest_learns_interactions(spark):
    out = forest.forest_oof(data(spark), "key", "vec", "label", trees=20)
    assert out.count() == 601
    assert score(out.where("label IS NOT NULL")).first()["accuracy"] > 0.8


def test_large_nodes_are_split_as_small_ones_are(spark, monkeypatch):
    df = data(spark, 300)
    one = guesses(df, trees=4)
    monkeypatch.setattr(forest, "GROUP_ROWS", 40)
    monkeypatch.setattr(forest, "PASS_BYTES", 1 << 12)
    monkeypatch.setattr(forest, "CELLS", 100)
    assert guesses(df.repartition(5), trees=4) == one
    votes, _ = forest.forest_votes(df, "key", "vec", "label", "fold", trees=1)
    assert votes.count() >= 300


def test_trees_are_grown_out(spark):
    """A fully grown tree is sure of every row that was in its bag."""
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 32, (400, 9)).astype(np.uint8), rng.integers(0, 3, 400), rng.poisson(1, 400)
    own = w > 0
    parts = list(forest.grown_votes(x[own], y[own], w[own], x, 1, np.uint64(7), 3, 32, 3, 30, 1))
    r, c, share = (np.concatenate(v) for v in zip(*parts))
    assert np.bincount(r, share, 400) == pytest.approx(np.ones(400))
    sure = share == 1.0
    found = dict(zip(r[sure].tolist(), c[sure].tolist()))
    assert np.mean([found.get(i) == y[i] for i in np.flatnonzero(own)]) > 0.99


def test_copies_that_no_split_parts_are_leaves(spark, monkeypatch):
    monkeypatch.setattr(forest, "GROUP_ROWS", 20)
    df = spark.range(120).select(F.col("id").alias("key"), F.expr("array(1D, 2D)").alias("vec"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("label"), (F.col("id") % 2).alias("fold"))
    assert set(guesses(df, trees=3).values()) <= {"a", "b"} and len(guesses(df, trees=3)) == 120
    alone = df.where("fold = 0").limit(5)
    assert set(guesses(alone, trees=2).values()) <= {"a", "b"}
