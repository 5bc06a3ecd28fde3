import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.functions.binomial import sign_test_value
from foldstone.operators import evaluate as E
from foldstone.operators import uncertainty as U
from foldstone.sources import tables as B
from foldstone.session import scratch_path
from foldstone.vocab import HIGH_AROUSAL, LABELS


def frame(spark, rows, names="y_true string, y_pred string"):
    return spark.createDataFrame(rows, names)


def test_perfect_and_single_class(spark):
    one = E.score(frame(spark, [("a", "a"), ("b", "b")])).first()
    assert (one["accuracy"], one["macro_f1"], one["weighted_f1"]) == (1.0, 1.0, 1.0)
    flat = E.score(frame(spark, [("a", "a"), ("b", "a")])).first()
    assert flat["macro_f1"] == pytest.approx((2 / 3) / 2)


def test_divisor_is_the_observed_union(spark):
    row = E.score(frame(spark, [("a", "a"), ("a", "z")])).first()
    assert row["macro_f1"] == pytest.approx((2 / 3) / 2)
    assert row["macro_f1_present"] == pytest.approx(2 / 3)


def test_fixed_tables_keep_absent_labels(spark):
    pred = frame(spark, [("sad", "calm"), ("sad", "sad")])
    assert E.confusion(pred, LABELS).count() == 64
    rows = {r["label"]: r for r in E.per_class(pred, LABELS).collect()}
    assert rows["happy"]["f1"] == 0.0 and rows["sad"]["recall"] == 0.5
    assert E.confusion_pivot(pred, LABELS).count() == 8


def test_slices_recombine(spark):
    rows = [("a", "a", "x", None), ("b", "a", "x", "k"), ("a", "a", "y", "k"), ("a", "b", "y", None)]
    pred = frame(spark, rows, "y_true string, y_pred string, s string, t string")
    found = {(r["slice"], r["level"]): r for r in E.slices(pred, ["s", "t", "missing"]).collect()}
    assert found[("s", "x")]["n"] + found[("s", "y")]["n"] == 4
    assert found[("s", "y")]["macro_f1"] is None and found[("s", "y")]["accuracy"] == 0.5
    assert ("t", "k") in found and len(found) == 3


def test_pooled_equals_direct(spark):
    a, b = frame(spark, [("a", "a"), ("b", "a")]), frame(spark, [("b", "b")])
    pooled = E.evaluate_pooled([a, b], ["a", "b"], "p", model="m")
    assert pooled.row.first()["fold"] == "pooled"
    assert pooled.scores.first() == E.score(a.unionByName(b)).first()
    with pytest.raises(ValueError):
        E.evaluate_pooled([], ["a"], "p", model="m")
    with pytest.raises(TypeError):
        E.evaluate_pooled([a], ["a"], "p", model="m", fold=1)


def test_log_is_appended(spark):
    path = scratch_path(spark, "log")
    pred = frame(spark, [("a", "a"), ("b", "a")])
    for fold in (0, "pooled"):
        E.evaluate(pred, ["a", "b"], "p", fold, "m", hyperparams={"z": 1, "a": 2}, results_path=path)
    rows = B.read_results(spark, path).collect()
    assert len(rows) == 2 and {r["fold"] for r in rows} == {"0", "pooled"}
    assert all(r["hyperparams"] == '{"a": 2, "z": 1}' and len(r["run_id"]) == 8 for r in rows)


def test_alignment(spark):
    a = spark.createDataFrame([(1,), (2,)], "key int")
    E.check_alignment(a, a, "key")
    with pytest.raises(ValueError):
        E.check_alignment(a, a.where("key = 1"), "key")


def structure(spark, pairs):
    rows = [p for p, n in pairs.items() for _ in range(n)]
    return E.error_structure(frame(spark, rows), HIGH_AROUSAL, LABELS).first()


def test_error_structure(spark):
    none = structure(spark, {("sad", "sad"): 4})
    assert (none["within_share"], none["lift"]) == (0.0, 0.0)
    inside = structure(spark, {("sad", "calm"): 5, ("angry", "happy"): 3})
    assert (inside["within_errors"], inside["across_errors"]) == (8, 0)
    assert inside["chance_within_share"] == pytest.approx(3 / 7) and inside["lift"] == pytest.approx(7 / 3)
    assert structure(spark, {("calm", "angry"): 4})["across_errors"] == 4


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(24):
        for i in range(20):
            t = LABELS[i % 8]
            rows.append((f"g{g}", f"{g}-{i}", t, t if rng.random() < 0.7 else str(rng.choice(LABELS)), t if rng.random() < 0.4 else str(rng.choice(LABELS))))
    return spark.createDataFrame(rows, "grp string, key string, y_true string, y_pred string, other string").cache()


def test_interval_brackets_the_point(toy):
    row = U.cluster_bootstrap(toy, "grp", n_boot=100).first()
    assert row["lo"] < row["point"] < row["hi"] and row["n_groups"] == 24
    assert row == U.cluster_bootstrap(toy, "grp", n_boot=100).first()


def test_clustered_interval_is_wider(spark):
    rows = [(f"g{g}", f"{g}-{i}", "a" if i % 2 else "b", ("a" if i % 2 else "b") if g < 16 else "c") for g in range(24) for i in range(20)]
    df = spark.createDataFrame(rows, "grp string, key string, y_true string, y_pred string")
    by_group = U.cluster_bootstrap(df, "grp", "accuracy", 200).first()
    by_row = U.cluster_bootstrap(df, "key", "accuracy", 200).first()
    assert by_group["hi"] - by_group["lo"] > 3 * (by_row["hi"] - by_row["lo"])


def test_bootstrap_against_numpy(toy):
    """The same draws, rows gathered by hand."""
    import hashlib

    pdf = toy.toPandas()
    groups = sorted(pdf.grp.unique(), key=lambda g: (hashlib.md5(g.encode()).hexdigest(), g))
    draws = []
    for b in range(20):
        picks = [int(hashlib.md5(f"5|{b}|{i}".encode()).hexdigest()[:15], 16) % 24 for i in range(24)]
        rows = [pdf[pdf.grp == groups[p]] for p in picks]
        hit = sum((r.y_true == r.y_pred).sum() for r in rows)
        draws.append(hit / sum(len(r) for r in rows))
    row = U.cluster_bootstrap(toy, "grp", "accuracy", 20, seed=5).first()
    assert row["lo"] == pytest.approx(np.quantile(draws, 0.025))
    assert row["se"] == pytest.approx(np.std(draws, ddof=1))


def test_paired(toy):
    same = U.paired_bootstrap(toy.withColumn("copy", F.col("y_pred")), "grp", "y_pred", "copy", n_boot=50).first()
    assert same["delta"] == 0 and not same["significant"] and same["p_value"] == 1.0
    better = U.paired_bootstrap(toy, "grp", "y_pred", "other", n_boot=50).first()
    assert better["delta"] > 0 and better["lo"] > 0 and better["significant"]


def test_custom_and_unknown_metric(toy):
    metric = U.pandas_metric(lambda t, p, n: n[t == p].sum() / n.sum())
    a = U.cluster_bootstrap(toy, "grp", metric, 30).first()
    b = U.cluster_bootstrap(toy, "grp", "accuracy", 30).first()
    assert a["point"] == pytest.approx(b["point"]) and a["lo"] == pytest.approx(b["lo"])
    with pytest.raises(ValueError, match="unknown metric"):
        U.cluster_bootstrap(toy, "grp", "nope", 5)


@pytest.mark.parametrize("a, b", [(3, 11), (40, 25), (5, 5), (300, 220), (0, 0), (0, 9), (1, 0)])
def test_sign_test_is_exact(a, b):
    n = a + b
    tail = sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n
    assert sign_test_value(a, b) == pytest.approx(1.0 if a == b else min(1.0, 2 * tail), rel=1e-11)


def test_mcnemar_counts_only_discordant(spark):
    rows = [("a", "a", "b")] * 7 + [("a", "b", "a")] * 2 + [("a", "a", "a")] * 5 + [("a", "b", "b")] * 5
    row = U.mcnemar(spark.createDataFrame(rows, "y_true string, pa string, pb string"), "pa", "pb").first()
    assert (row["only_a_correct"], row["only_b_correct"]) == (7, 2)
    assert row["p_value"] == pytest.approx(2 * sum(math.comb(9, i) for i in range(3)) / 512)
