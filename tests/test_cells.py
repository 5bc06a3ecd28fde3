"""The cell index against brute force."""

import tracemalloc

import numpy as np
import pytest

from foldstone.operators import cells


def table(spark, x, folds, first=0):
    return spark.createDataFrame(
        [(first + i, v.tolist(), f"l{i % 3}", int(f)) for i, (v, f) in enumerate(zip(x, folds))], "key long, vec array<double>, label string, fold int"
    )


def brute(q, qf, x, xf, k, mode):
    out = {}
    for i in range(len(q)):
        ok = np.ones(len(x), bool) if mode is None else (xf == qf[i] if mode else xf != qf[i])
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        near = [j for j in np.lexsort((np.arange(len(x)), d)) if ok[j]][:k]
        out[i] = [(j, d[j]) for j in near]
    return out


def shapes():
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 30, (15, 4))
    clustered = centers[rng.integers(0, 15, 700)] + rng.normal(0, 0.3, (700, 4))
    clustered[100:300] = clustered[100]  # a third are one vector
    yield "clustered", clustered
    yield "far from zero", clustered + 1e5
    yield "random", rng.normal(size=(300, 16))
    yield "integers with ties", rng.integers(0, 3, (250, 3)).astype(float)


@pytest.mark.parametrize("mode", [None, False, True])
@pytest.mark.parametrize(("name", "x"), list(shapes()))
def test_neighbours_equal_brute_force(spark, name, x, mode):
    folds = np.arange(len(x)) % 3
    refs, queries = table(spark, x, folds), table(spark, x[::7], folds[::7])
    fold = None if mode is None else "fold"
    found = cells.nearest_in_cells(queries, refs, 4, "key", "vec", "label", fold, bool(mode), rows_per_pivot=30, block=25).collect()
    got = {}
    for r in found:
        got.setdefault(r["key"], []).append((r["distance"], r["ref"]))
        assert r["label"] == f"l{r['ref'] % 3}"
    for i, want in brute(x[::7], folds[::7], x, folds, 4, mode).items():
        mine = sorted(got[i])
        assert [j for _, j in mine] == [j for j, _ in want]
        assert [d for d, _ in mine] == pytest.approx([d for _, d in want], abs=1e-9)


def test_bounds_cut_cells(spark):
    """Separated clusters: a query visits a few blocks, not all."""
    name, x = next(shapes())
    refs = table(spark, x, np.zeros(len(x)))
    pivots = cells.pivots_of(refs, "key", "vec", 30)
    blocks = cells.build_cells(refs, pivots, "key", "vec", "label", block=25)
    directory = cells.Directory(blocks, pivots)
    allowed = np.ones((len(x), len(directory.cell)), bool)
    first = directory.first(x, allowed, 4)
    limit = np.array([np.sort(np.sqrt(((x - v) ** 2).sum(1)))[3] for v in x])
    visited = (first | directory.rest(x, allowed, 4, limit)).sum() / allowed.size
    assert len(directory.cell) > 25 and visited < 0.35


def test_few_and_no_references(spark):
    x = np.array([[0.0, 1.0], [2.0, 0.0]])
    refs = table(spark, x, [0, 1])
    rows = cells.nearest_in_cells(refs, refs, 5, "key", "vec", "label").collect()
    assert sorted((r["key"], r["ref"]) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert cells.nearest_in_cells(refs, refs.where("false"), 5, "key", "vec", "label").count() == 0
    assert cells.nearest_in_cells(refs.where("false"), refs, 5, "key", "vec", "label").count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e-20, 1e25])
@pytest.mark.parametrize("limited", [False, True])
def test_block_search_at_any_scale(scale, limited):
    """Single precision only narrows down: order, ties and folds are those of exact distances."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8))
    x[200:300] = x[200]
    x, q = x * scale, x[::6] * scale
    keys, folds = rng.permutation(600), np.arange(600, dtype=np.int32) % 3
    d = np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(2))
    d[folds[::6, None] == folds[None, :]] = np.inf
    limits = np.sort(d, axis=1)[:, 3] if limited else np.full(len(q), np.inf)
    got = cells._block_best(np.arange(len(q)), q, limits, keys, keys, x, 4, x.mean(0), (folds[::6], folds))
    for i in range(len(q)):
        want = np.lexsort((keys, d[i]))[:4]
        assert got[2][got[0] == i].tolist() == keys[want].tolist()
        assert got[1][got[0] == i] == pytest.approx(d[i][want], rel=1e-12)


def test_copies_in_a_block_are_measured_in_parts():
    """A block of copies: each is as near as the k-th, and no array holds the vectors of all pairs (1 GB here)."""
    x = np.ones((8192, 64))
    tracemalloc.start()
    got = cells._block_best(np.arange(256), x[:256], np.full(256, np.inf), np.arange(8192)[::-1], np.zeros(8192), x, 3, np.zeros(64))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[2][:3].tolist() == [0, 1, 2] and len(got[0]) == 768 and most < 400e6


def test_vectors_travel_in_single_precision_where_nothing_is_lost():
    x = np.random.default_rng(1).normal(size=(5, 3))
    single = x.astype(np.float32).astype(float)
    assert len(cells.as_bytes(single)) == 60 and len(cells.as_bytes(x)) == 120
    assert np.array_equal(cells.from_bytes(cells.as_bytes(single), 5, 3), single) and np.array_equal(cells.from_bytes(cells.as_bytes(x), 5, 3), x)
