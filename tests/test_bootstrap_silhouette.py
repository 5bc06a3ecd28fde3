"""Draws of single rows and closed-form silhouettes."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from foldstone.functions import binomial as B
from foldstone.operators import neighbors
from foldstone.operators import uncertainty as U


@pytest.mark.parametrize(("n", "p"), [(7, 0.3), (40, 0.1), (60, 0.5), (1000, 0.97), (200, 0.35)])
def test_binomial_draws_have_their_distribution(n, p):
    size = 20_000
    found = Counter(B.binomial_draw(n, p, lambda t, name, i=i: B.key_uniform("s", i, t, name)) for i in range(size))
    assert min(found) >= 0 and max(found) <= n
    chi, cells, rest = 0.0, 0, (0.0, 0)
    for k in range(n + 1):
        want = size * math.comb(n, k) * p**k * (1 - p) ** (n - k)
        rest = (rest[0] + want, rest[1] + found[k])
        if rest[0] >= 10:
            chi, cells, rest = chi + (rest[1] - rest[0]) ** 2 / rest[0], cells + 1, (0.0, 0)
    assert chi < cells + 4 * math.sqrt(2 * cells)


def test_draws_of_very_many_trials():
    n = 10**13
    x = np.array([B.binomial_draw(n, 0.3, lambda t, name, i=i: B.key_uniform(i, t, name)) for i in range(3000)], float)
    z = (x - n * 0.3) / math.sqrt(n * 0.21)
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.06
    few = [B.binomial_draw(n, 2e-13, lambda t, name, i=i: B.key_uniform(i, t, name)) for i in range(3000)]
    assert abs(np.mean(few) - 2) < 0.15


def test_split_draws_add_up():
    weights = [5, 0, 70, 1, 24]
    draws = np.array([B.split_draw(100, weights, "m", b) for b in range(4000)])
    assert (draws.sum(1) == 100).all() and (draws[:, 1] == 0).all()
    assert draws.mean(0) == pytest.approx(np.array(weights), abs=0.35)
    # covariance of a multinomial
    assert np.cov(draws[:, 0], draws[:, 2])[0, 1] == pytest.approx(-100 * 0.05 * 0.7, abs=0.6)


def test_sign_test_stays_right_for_many_trials():
    assert B.sign_test_value(50, 50) == 1.0
    big = 10**9
    z = 2.5
    first = int(big / 2 - z * math.sqrt(big) / 2)
    assert B.sign_test_value(first, big - first) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-3)


def test_row_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(str(t), str(t if rng.random() < 0.7 else (t + 1) % 3), bool(i % 2)) for i, t in enumerate(rng.integers(0, 3, 3000))]
    pred = spark.createDataFrame(rows, "y_true string, y_pred string, half boolean")
    got = U.row_bootstrap(pred, "accuracy", 1000).first()
    p = np.mean([t == y for t, y, _ in rows])
    assert got["point"] == pytest.approx(p) and got["n"] == 3000
    assert got["se"] == pytest.approx(math.sqrt(p * (1 - p) / 3000), rel=0.1)
    assert got["lo"] < p < got["hi"]
    again = U.row_bootstrap(pred.repartition(7), "accuracy", 1000).first()
    assert got == again
    by = {r["half"]: r["n"] for r in U.row_bootstrap(pred, "macro_f1", 50, by="half").collect()}
    assert by == {True: 1500, False: 1500}


def test_squared_silhouettes_equal_pairs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 5)) + 1e4
    labels = ["a"] * 60 + ["b"] * 40 + ["c"] * 19 + ["one"]
    df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels))], "key long, vec array<double>, label string")
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    names = sorted(set(labels))
    at = np.array([names.index(v) for v in labels])
    want = []
    for i in range(len(x)):
        own = (at == at[i]).sum()
        a = d[i, at == at[i]].sum() / max(own - 1, 1)
        b = min(d[i, at == j].mean() for j in range(len(names)) if j != at[i])
        want.append(0.0 if own == 1 else (b - a) / max(a, b))
    for size in (1 << 20, 100):  # all labels at once, one label at a time
        rows = neighbors.squared_silhouette_rows(df, "key", "vec", "label", stats_bytes=size).collect()
        got = [r["silhouette"] for r in sorted(rows, key=lambda r: r["key"])]
        assert got == pytest.approx(want, abs=1e-6)
    alone = df.where("label = 'a'")
    assert all(r["silhouette"] is None for r in neighbors.squared_silhouette_rows(alone, "key", "vec", "label").collect())
    assert neighbors.squared_silhouette(df.where("false"), "key", "vec", "label").first()["n"] == 0


def test_draws_are_spread_and_packed(spark):
    """The draws of few small levels are many tasks of short rows, and equal plain hashes."""
    sizes = spark.createDataFrame([("x", 3000), ("y", 70_000)], "_by string, _size bigint")
    drawn = U.draw_groups(sizes, 40, 42, 1000)
    assert drawn.rdd.getNumPartitions() > 4
    rows = drawn.collect()
    assert max(len(r["picks"]) for r in rows) < 20_000
    got = sorted(r["_block"] * 1000 + p for r in rows if r["_by"] == "y" and r["b"] == 7 for p in np.frombuffer(r["picks"], np.uint16).tolist())
    want = [int(hashlib.md5(f"42|7|{i}".encode()).hexdigest()[:15], 16) % 70_000 for i in range(70_000)]
    assert got == sorted(want)


def test_levels_with_groups_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, "ab"[g % 2], str(t), str(t if rng.random() < 0.6 else 2)) for g in range(200) for t in rng.integers(0, 3, 4)]
    pred = spark.createDataFrame(rows, "grp long, half string, y_true string, y_pred string")
    whole = sorted(map(str, U.cluster_bootstrap(pred, "grp", n_boot=150, by="half").collect()))
    for name, value in (("BLOCK_DRAWS", 3000), ("SLOTS", 7), ("LEVELS", 1)):
        monkeypatch.setattr(U, name, value)
    assert sorted(map(str, U.cluster_bootstrap(pred, "grp", n_boot=150, by="half").collect())) == whole
