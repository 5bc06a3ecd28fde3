"""Stacked linear models against solving each alone."""

import numpy as np
import pytest

from foldstone.operators import stacked
from foldstone.operators.evaluate import score


def data(spark, n=400, d=5, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) * np.array([1, 5, 0.1, 2, 1]) + np.eye(3, d)[y] * np.array([2, 4, 0.1, 1, 1])
    x[:, 4] = 3.0  # a constant column
    rows = [(i, v.tolist(), f"c{c}", i % 4) for i, (v, c) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "key long, vec array<double>, label string, fold int")


def alone(x, y, w, c, k, kind):
    """One model by plain gradient descent with line search over standardised rows."""
    own = w > 0
    mean, sd = x[own].mean(0), x[own].std(0)
    sd[sd < 1e-12] = 1
    z, n = (x - mean) / sd, w.sum()
    zi = np.c_[z, np.ones(len(z))]

    def both(b):
        value, g = stacked._loss(kind, (zi @ b.T)[:, None, :], y)
        ridge = b.copy()
        ridge[:, -1] = 0
        return (value[:, 0] * w).sum() / n + (ridge**2).sum() / (2 * c * n), (g[:, 0] * w[:, None]).T @ zi / n + ridge / (c * n)

    b = np.zeros((k, zi.shape[1]))
    v, g = both(b)
    t = 1.0
    for _ in range(4000):
        while (new := both(b - t * g))[0] > v - 0.5 * t * (g**2).sum():
            t /= 2
        b, (v, g), t = b - t * g, new, t * 1.5
        if np.abs(g).max() < 1e-7:
            break
    return v, b


@pytest.mark.parametrize("kind", stacked.LOSSES)
def test_each_model_is_the_one_fitted_alone(spark, kind):
    x, y, df = data(spark)
    specs = stacked.fold_specs(range(4), (0.1, 10.0)) + [stacked.Spec(("weighted",), 0, {0: 0.25, 1: 2.0, 3: 1.0}, 1.0)]
    stack = stacked.fit_stack(df, "vec", "label", ["fold"], specs, kind, tol=1e-7)
    fold = np.arange(len(x)) % 4
    for m, spec in enumerate(specs):
        w = np.array([spec.weights.get(f, 0.0) for f in fold.tolist()])
        value, _ = alone(x, y, w, spec.c, 3, kind)
        assert stack.value[m] == pytest.approx(value, abs=1e-6)
    assert stack.steps < 200


def test_oof_learns_and_predicts_every_row_once(spark):
    x, y, df = data(spark)
    out = stacked.stacked_oof(df, "key", "vec", "label")
    assert out.count() == 400 and out.select("key").distinct().count() == 400
    assert score(out).first()["accuracy"] > 0.6


def test_turns_and_blocks_do_not_matter(spark, monkeypatch):
    _, _, df = data(spark)
    specs = stacked.fold_specs(range(4))
    one = stacked.fit_stack(df, "vec", "label", ["fold"], specs, tol=1e-7).coef
    monkeypatch.setattr(stacked, "STACK_BYTES", 300)
    monkeypatch.setattr(stacked, "BLOCK_ROWS", 37)
    many = stacked.fit_stack(df.repartition(50), "vec", "label", ["fold"], specs, tol=1e-7).coef
    assert many == pytest.approx(one, abs=1e-3)


def test_search_over_weights_and_inner_folds(spark):
    _, _, df = data(spark)
    roles = df.selectExpr("*", "CASE WHEN key >= 300 THEN -2 WHEN fold = 0 THEN -1 ELSE key % 2 END AS i0", "CASE WHEN key >= 300 THEN -2 WHEN fold = 1 THEN -1 ELSE key % 2 END AS i1")
    counts = stacked.penalty_search(roles, "key", "vec", "label", "fold", ["i0", "i1"], (1.0, 0.1), 2, external=(0.0, 1.0)).collect()
    assert {(r["outer"], r["c"], r["weight"], r["inner"]) for r in counts} == {(o, c, w, i) for o in (0, 1) for c in (1.0, 0.1) for w in (0.0, 1.0) for i in (0, 1)}
    own = [r for r in counts if (r["outer"], r["c"], r["weight"]) == (0, 1.0, 0.0)]
    assert sum(r["n"] for r in own) == 225  # base rows outside fold 0, each once
    with pytest.raises(ValueError):
        stacked.fit_stack(df, "vec", "label", ["fold"], stacked.fold_specs([0, 1]), "absolute")


def test_balanced_weights_and_tuned_penalties(spark):
    x, y, df = data(spark)
    few = df.where("label <> 'c2' OR key % 10 = 0")
    out = stacked.balanced_oof(few, "key", "vec", "label")
    plain = stacked.stacked_oof(few, "key", "vec", "label")
    assert out.count() == few.count()
    recall = lambda t: t.where("label = 'c2' AND y_pred = 'c2'").count()
    assert recall(out) >= recall(plain)
    roles = df.selectExpr("*", *[f"CASE WHEN fold = {f} THEN -1 ELSE key % 3 END AS i{f}" for f in range(4)])
    tuned = stacked.tuned_oof(roles, "key", "vec", "label", [f"i{f}" for f in range(4)], (0.01, 1.0))
    assert tuned.count() == 400 and score(tuned).first()["accuracy"] > 0.6
    two = stacked.two_stage_oof(df, "key", "vec", "label", ["c2"])
    assert two.count() == 400 and two.where("(y_pred = 'c2') <> (gate = 'high')").count() == 0
    assert stacked.rbf_oof(df, "key", "vec", "label", width=64).count() == 400
