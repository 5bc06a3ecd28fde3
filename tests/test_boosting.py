"""Histogram boosting over folds."""

import numpy as np
import pytest

from foldstone.operators import boosting
from foldstone.operators.evaluate import score


def data(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + 2 * (x[:, 2] > 0.5)  # no linear model sees the first part
    rows = [(i, v.tolist(), f"c{c}", i % 3) for i, (v, c) in enumerate(zip(x, y))]
    rows += [(n, [0.0] * 4, None, 0)]
    return spark.createDataFrame(rows, "key long, vec array<double>, label string, fold int")


def test_boosting_learns_interactions(spark):
    df = data(spark)
    out = boosting.boosted_oof(df, "key", "vec", "label", rounds=12, depth=3)
    assert out.count() == 601
    assert score(out.where("label IS NOT NULL")).first()["accuracy"] > 0.85


def test_partitions_and_stores_do_not_matter(spark, monkeypatch):
    df = data(spark, 200)
    one = boosting.boost(df, "vec", "label", "fold", rounds=4, depth=2)
    monkeypatch.setattr(boosting, "STORED", 2)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 13)
    many = boosting.boost(df.repartition(40), "vec", "label", "fold", rounds=4, depth=2)
    x = np.random.default_rng(0).normal(size=(50, 4))
    assert many.scores(x, np.arange(50) % 3) == pytest.approx(one.scores(x, np.arange(50) % 3), abs=1e-3)


def test_first_split_is_the_best_one():
    """Against all cuts of all features, one by one."""
    rng = np.random.default_rng(1)
    x, g = rng.integers(0, 8, (80, 3)), rng.normal(size=(80, 2))
    hist = np.zeros((1, 3, 1, 3, 8))
    for row, value in zip(x, g):
        for j in range(3):
            hist[0, :, 0, j, row[j]] += [*value, 1.0]
    feature, cut = boosting._splits(hist, 1.0, 1.0)
    gain = lambda own: (g[own].sum(0) ** 2).sum() / (own.sum() + 1.0)
    want = max((gain(x[:, j] <= c) + gain(x[:, j] > c), -j, -c) for j in range(3) for c in range(7) if 0 < (x[:, j] <= c).sum() < 80)
    assert (feature[0, 0], cut[0, 0]) == (-want[1], -want[2])


def test_edges_and_refusals(spark):
    df = data(spark, 100)
    edges = boosting.bin_edges(df, "vec", 8)
    assert edges.shape == (4, 7) and (np.diff(edges, axis=1) >= 0).all()
    with pytest.raises(ValueError):
        boosting.boost(df.where("label IS NULL"), "vec", "label", "fold")
    same = df.where("label = 'c0'")
    assert {r["y_pred"] for r in boosting.boosted_oof(same, "key", "vec", "label", rounds=2).collect()} == {"c0"}


def test_stumps_equal_plain_samme(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 6, (240, 3)).astype(float)
    y = (x[:, 0] > 2).astype(int) + (x[:, 1] > 3)
    y = np.where(rng.random(240) < 0.1, rng.integers(0, 3, 240), y)
    df = spark.createDataFrame([(i, v.tolist(), int(c), i % 2) for i, (v, c) in enumerate(zip(x, y))], "key long, vec array<double>, label int, fold int")
    model = boosting.boost_stumps(df, "vec", "label", "fold", rounds=8, bins=64)
    for f in (0, 1):
        own = np.arange(240) % 2 != f
        xs, ys, w, votes = x[own], y[own], np.ones(own.sum()), np.zeros((240, 3))
        for _ in range(8):
            def gini(j, c):
                left = xs[:, j] <= c
                sums = [np.bincount(ys[s], w[s], 3) for s in (left, ~left)]
                return sum((s**2).sum() / s.sum() for s in sums if s.sum() > 0)
            score_, j, c = max((round(gini(j, c), 9), -j, -c) for j in range(3) for c in range(5))
            j, c = -j, -c
            left = xs[:, j] <= c
            classes = [np.bincount(ys[s], w[s], 3).argmax() for s in (left, ~left)]
            miss = np.where(left, classes[0], classes[1]) != ys
            error = w[miss].sum() / w.sum()
            alpha = np.log((1 - error) / error) + np.log(2)
            votes[np.arange(240), np.where(x[:, j] <= c, classes[0], classes[1])] += alpha
            w = w * np.exp(alpha * miss)
        got = model.scores(x, np.full(240, f))
        assert (got.argmax(1) == votes.argmax(1)).mean() > 0.97


def test_histograms_do_not_reach_the_driver(spark, monkeypatch):
    df = data(spark, 300).repartition(5)
    monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    shapes, added = [], boosting._added
    monkeypatch.setattr(boosting, "_added", lambda table, run, shape: shapes.append(shape) or added(table, run, shape))
    many = boosting.boost(df, "vec", "label", "fold", rounds=2, depth=3)
    assert shapes and all(np.prod(shape) <= 3 * 2**3 * 4 * 2 for shape in shapes)  # leaves only
    monkeypatch.setattr(boosting, "TASK_ROWS", 8192)
    one = boosting.boost(df, "vec", "label", "fold", rounds=2, depth=3)
    for a, b in zip(many.rounds, one.rounds):
        assert all((x == y).all() for x, y in zip([*a.feature, *a.cut], [*b.feature, *b.cut])) and a.leaf == pytest.approx(b.leaf, abs=1e-4)
