"""Perceptrons of all folds and arms in one stack."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import perceptron as P
from foldstone.operators.stacked import Spec, fold_specs


def frame(spark, n=240, folds=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 1, 1] + [0, 30, 0, 0]
    rows = [(i, x[i].tolist(), f"c{int(x[i, 0] > 0) + int(x[i, 1] > 30)}", i % folds) for i in range(n)]
    return spark.createDataFrame(rows, "key long, vec array<double>, label string, fold int")


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_every_row_once_and_learned(spark):
    out = P.nets_oof(frame(spark), "key", "vec", "label", hidden=8, max_iter=40).toPandas()
    assert sorted(out["key"]) == list(range(240))
    assert (out["y_true"] == out["y_pred"]).mean() > 0.9


def test_more_folds_make_no_more_passes(spark):
    """Folds are fitted by the same jobs: a fit a fold would take several times as many."""
    few, many = (frame(spark, folds=n).cache() for n in (2, 8))
    runs = [jobs(spark, f"nets{i}", lambda d=d: P.nets_oof(d, "key", "vec", "label", hidden=4, max_iter=6).collect()) for i, d in enumerate((few, many))]
    assert runs[1] < 2 * runs[0]


def test_gradient_is_that_of_the_loss(spark):
    """A fit reaches about the loss that MLlib reaches from the same weights."""
    from foldstone.operators import models as M

    df = frame(spark)
    nets = P.fit_nets(df, "vec", "label", "fold", fold_specs([0, 1, 2]), 4, 30)
    theirs = M.fit("mlp", df.where("fold <> 0"), "vec", "label", {"hidden": 4, "max_iter": 30}).model.summary().objectiveHistory
    first = P.fit_nets(df, "vec", "label", "fold", fold_specs([0, 1, 2]), 4, 0)
    assert first.value[0] == pytest.approx(theirs[0], rel=1e-5)
    assert nets.value[0] < theirs[0] and nets.value[0] == pytest.approx(theirs[-1], abs=0.1)


def test_a_class_outside_the_train_side_is_not_predicted(spark):
    df = frame(spark).withColumn("label", F.when(F.col("fold") == 1, "only").otherwise(F.col("label")))
    out = P.nets_oof(df, "key", "vec", "label", hidden=4, max_iter=5).where("y_true = 'only'")
    assert out.count() == 80 and out.where("y_pred = 'only'").count() == 0


def test_arms_share_the_pooled_model(spark):
    own, external = frame(spark), frame(spark, seed=1).withColumn("key", F.col("key") + 1000).drop("fold")
    arms = ["ravdess_only", "pooled", "two_stage", "two_stage_frozen"]
    out = P.arms_oof(own, external, "key", "vec", "label", arms, hidden=6, max_iter=25).toPandas()
    assert {a: sorted(g["key"]) for a, g in out.groupby("arm")} == {a: list(range(240)) for a in arms}
    assert ((out["y_true"] == out["y_pred"]).groupby(out["arm"]).mean() > 0.85).all()


def test_frozen_head_keeps_the_hidden_layer(spark):
    df, specs = frame(spark), [Spec(("all",), 0, {0: 1.0, 1: 1.0, 2: 1.0})]
    body = P.fit_nets(df, "vec", "label", "fold", specs, 4, 10)
    head = P.fit_nets(df, "vec", "label", "fold", specs, 4, 50, start=body, head_only=True)
    assert np.array_equal(head.hidden, body.hidden) and not np.array_equal(head.head, body.head)
    with pytest.raises(ValueError, match="same labels"):
        P.fit_nets(df.where("label <> 'c0'"), "vec", "label", "fold", specs, 4, 5, start=body)
