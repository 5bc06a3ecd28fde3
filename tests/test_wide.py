import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.operators import vectors as N
from foldstone.operators import wide as W


def frame(spark, x, labels=None, folds=None):
    rows = [
        (i, [float(v) for v in r], int(labels[i]) if labels is not None else 0, int(folds[i]) if folds is not None else 0)
        for i, r in enumerate(x)
    ]
    return spark.createDataFrame(rows, "key long, vec array<double>, label int, fold int").repartition(5)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 6)) @ rng.standard_normal((6, 90)) + 0.3 * rng.standard_normal((400, 90)) + 100.0
    labels = rng.integers(0, 4, 400)
    x[np.arange(400), labels] += 2.0
    return x, labels, rng.integers(0, 3, 400)


def test_principal_axes_equal_those_of_the_whole_matrix(spark, data):
    x, _, _ = data
    df = frame(spark, x)
    fit = W.fit_pca(df, "vec", 5, tol=1e-9)[None]
    mean, axes, ratio = N.fit_pca(df, "vec", 5)
    assert fit.residual <= 1e-9
    np.testing.assert_allclose(fit.mean, mean)
    np.testing.assert_allclose(fit.ratio, ratio, rtol=1e-7)
    np.testing.assert_allclose(np.abs((fit.axes * axes).sum(0)), 1, atol=1e-6)


def test_folds_share_passes_and_leave_their_rows_out(spark, data):
    x, _, folds = data
    df = frame(spark, x, folds=folds).cache()
    fits = W.fit_pca(df, "vec", 3, fold="fold", standardise=True, tol=1e-9)
    assert sorted(fits) == [0, 1, 2]
    for f, fit in fits.items():
        train = x[folds != f]
        z = (train - train.mean(0)) / train.std(0)
        _, s, v = np.linalg.svd(z, full_matrices=False)
        np.testing.assert_allclose(fit.values, s[:3] ** 2 / (len(z) - 1), rtol=1e-7)
        np.testing.assert_allclose(np.abs((fit.axes * train.std(0)[:, None] * v[:3].T).sum(0)), 1, atol=1e-6)
    got = {r["key"]: r["pc"] for r in W.project(df, "vec", fits, "pc", "fold").collect()}
    for i in (0, 7, 399):
        fit = fits[folds[i]]
        np.testing.assert_allclose(got[i], (x[i] - fit.mean) @ fit.axes, atol=1e-9)


def test_discriminant_axes_span_those_of_the_whole_matrix(spark, data):
    x, labels, _ = data
    df = frame(spark, x, labels)
    fit = W.fit_lda(df, "vec", "label", ridge=1e-6)[None]
    _, axes = N.fit_lda(df, "vec", "label", ridge=1e-6)
    assert fit.axes.shape == axes.shape == (90, 3) and fit.residual <= 1e-8
    cos = np.linalg.svd(np.linalg.qr(fit.axes)[0].T @ np.linalg.qr(axes)[0])[1]
    np.testing.assert_allclose(cos, 1, atol=1e-6)


def test_fewer_directions_than_axes(spark):
    x = np.outer(np.arange(12.0), np.arange(1.0, 9.0))
    fit = W.fit_pca(frame(spark, x), "vec", 4)[None]
    assert fit.ratio[0] == pytest.approx(1) and fit.ratio[1:].sum() < 1e-12
    same = W.fit_pca(frame(spark, np.ones((5, 8))), "vec", 2)[None]
    assert np.all(same.values == 0) and np.all(same.ratio == 0)


def test_no_rows(spark):
    with pytest.raises(ValueError, match="no rows"):
        W.fit_pca(spark.createDataFrame([], "vec array<double>"), "vec", 2)


def test_null_vectors_take_no_part(spark, data):
    x, labels, _ = data
    df = frame(spark, x, labels)
    holed = df.unionByName(df.limit(1).withColumn("vec", F.lit(None).cast("array<double>")).withColumn("key", F.lit(-1)))
    fit = W.fit_pca(holed, "vec", 2)
    assert fit[None].n == 400
    assert [r["pc"] for r in W.project(holed, "vec", fit, "pc").where("key = -1").collect()] == [None]


def test_stacks_in_turns(spark, data, monkeypatch):
    x, _, folds = data
    df = frame(spark, x, folds=folds).cache()
    whole = W.fit_pca(df, "vec", 2, fold="fold")
    monkeypatch.setattr(W, "STACK_BYTES", 1)
    turns = W.fit_pca(df, "vec", 2, fold="fold")
    for f in whole:
        np.testing.assert_allclose(whole[f].values, turns[f].values, rtol=1e-9)


def test_a_wide_layer_stack(spark):
    """9,984 columns: 13 layers of 768; a d x d matrix would take 800 MB."""
    rng = np.random.default_rng(5)
    base = spark.range(300).selectExpr("id AS key", "CAST(id % 3 AS INT) AS fold")
    low = rng.standard_normal((3, 9984))

    def widen(batches):
        import pandas as pd

        for pdf in batches:
            x = [np.array([3, 2, 1]) * np.random.default_rng(int(k)).standard_normal(3) @ low for k in pdf.key]
            yield pd.DataFrame({"key": pdf.key, "fold": pdf.fold, "vec": x})

    df = base.mapInPandas(widen, "key long, fold int, vec array<double>")
    fits = W.fit_pca(df, "vec", 3, fold="fold")
    for fit in fits.values():
        assert fit.axes.shape == (9984, 3) and fit.ratio.sum() == pytest.approx(1)
        np.testing.assert_allclose(fit.axes.T @ fit.axes, np.eye(3), atol=1e-9)
