"""Random forests of unpruned trees, all folds at once, without a model on the driver.

Features are cut into bins at quantiles. Every tree of every fold draws its own
bag (Poisson weights) and its features at each node (a square root of them, up)
by hashes of tree, row and node, so nothing depends on the partitioning.

A node that more than ``GROUP_ROWS`` rows reach is split by counts of (feature,
bin, class), which tasks return and one group a node adds up; the driver gets a
feature and a cut. All rows that reach a smaller node, those it is trained on
and those it predicts, meet in one group, which grows the rest of the tree and
hands on only votes. So a fully grown tree exists a small node at a time, and
the driver holds about one split for ``GROUP_ROWS`` rows and tree.

Defined results. Rows without label take no part in fits but are predicted; rows
without vector are left out. A vote is the class shares of a leaf, as MLlib's;
ties go to the smaller label. Rows whose other folds hold no row get the first
label. Among equal splits the first drawn feature wins, then the smaller cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..vocab import SEED
from .boosting import BINS, _binned, bin_edges
from .evaluate import PRED, TRUE

#: Rows that meet in one group at most.
GROUP_ROWS = 16_384
#: Bytes of counts that a task holds in a pass, and counts of nodes split at once.
PASS_BYTES = 64 << 20
CELLS = 4_000_000
#: Rows of a task at most.
TASK_ROWS = 8192
#: Chance that a Poisson draw of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64 bits of each number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tree_seed(seed: int, model: int) -> np.uint64:
    return _mixed(_mixed(np.array([seed], np.uint64)) ^ np.uint64(model))[0]


def bag(seed: np.uint64, rows: np.ndarray) -> np.ndarray:
    """How often each row is in a tree's bag."""
    u = (_mixed(rows ^ seed) >> np.uint64(11)).astype(float) / 2**53
    return np.searchsorted(_POISSON, u, "right")


def drawn_features(seed: np.uint64, nodes: np.ndarray, width: int, slots: int) -> np.ndarray:
    """(node, slot) features that a node may split on, in the order of their draw."""
    at = _mixed(nodes.astype(np.uint64) ^ _mixed(seed[None])[0])
    return np.argsort(_mixed(at[:, None] ^ np.arange(width, dtype=np.uint64)[None, :]), axis=1, kind="stable")[:, :slots]


def best_splits(cell: np.ndarray, counts: np.ndarray, nodes: int, slots: int, bins: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot, cut) of each node, -1 where no split lowers the Gini impurity, from the class counts of sorted cells (node, slot, bin)."""
    slot, cut = np.full(nodes, -1), np.zeros(nodes, np.int64)
    if not len(cell):
        return slot, cut
    run = cell // bins
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.append(first, len(run)))
    left = counts.cumsum(0)
    left -= np.repeat(left[first] - counts[first], size, axis=0)
    whole = left[first + size - 1]
    right = np.repeat(whole, size, axis=0) - left
    n_left, n_right = left.sum(1), right.sum(1)
    square = lambda c: np.einsum("ck,ck->c", c, c)
    gain = square(left) / n_left + square(right) / np.maximum(n_right, 1) - np.repeat(square(whole) / whole.sum(1), size)
    gain[(n_left < least) | (n_right < least)] = 0.0
    node = run // slots
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(node))))
    good = np.flatnonzero((gain == top) & (gain > 1e-9))
    which, at = np.unique(node[good], return_index=True)
    slot[which], cut[which] = run[good[at]] % slots, cell[good[at]] % bins
    return slot, cut


def _local_splits(x, y, w, node, nodes, feats, k, bins, least):
    """:func:`best_splits` of nodes 0, 1, ... from their rows, some nodes at a time."""
    slots = feats.shape[1]
    order = np.argsort(node, kind="stable")
    ends = np.searchsorted(node[order], np.arange(nodes), "right")
    slot, cut = np.empty(nodes, np.int64), np.empty(nodes, np.int64)
    lo, row = 0, 0
    while lo < nodes:
        hi = max(lo + 1, int(np.searchsorted(ends, row + max(1, CELLS // (slots * k)), "right")))
        some = order[row:ends[hi - 1]]
        at = node[some] - lo
        key = ((at[:, None] * slots + np.arange(slots)) * bins + x[some[:, None], feats[node[some]]]).ravel()
        cell, place = np.unique(key, return_inverse=True)
        counts = np.bincount(place * k + np.repeat(y[some], slots), np.repeat(w[some], slots), len(cell) * k)
        slot[lo:hi], cut[lo:hi] = best_splits(cell, counts.astype(np.int64).reshape(-1, k), hi - lo, slots, bins, least)
        lo, row = hi, ends[hi - 1]
    return slot, cut


def grown_votes(x, y, w, tests, root: int, seed: np.uint64, k: int, bins: int, slots: int, depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(test row, class, share) of the tree below node ``root``, grown from the rows ``x``; nothing if there are none."""
    if not len(x):
        return
    ids = np.array([root], np.int64)
    node, held, asked = np.zeros(len(x), np.int64), np.zeros(len(tests), np.int64), np.arange(len(tests))
    while len(ids) and len(asked):
        counts = np.bincount(node * k + y, w, len(ids) * k).reshape(-1, k)
        n = counts.sum(1)
        tried = np.flatnonzero((counts.max(1) < n) & (n >= 2 * least) & (ids < 1 << depth))
        feature, cut = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
        if len(tried):
            feats = drawn_features(seed, ids[tried], x.shape[1], slots)
            place = np.full(len(ids), -1)
            place[tried] = np.arange(len(tried))
            own = np.flatnonzero(place[node] >= 0)
            slot, cut[tried] = _local_splits(x[own], y[own], w[own], place[node[own]], len(tried), feats, k, bins, least)
            feature[tried] = np.where(slot >= 0, feats[np.arange(len(tried)), np.maximum(slot, 0)], -1)
        ended = np.flatnonzero(feature[held] < 0)
        if len(ended):
            share = (counts / n[:, None])[held[ended]]
            r, c = np.nonzero(share)
            yield asked[ended[r]], c, share[r, c]
        split = np.flatnonzero(feature >= 0)
        number = np.full(len(ids), -1)
        number[split] = np.arange(len(split)) * 2

        def below(rows, at):
            right = rows[np.arange(len(rows)), feature[at]] > cut[at]
            return number[at] + right

        stay = feature[node] >= 0
        x, y, w, node = x[stay], y[stay], w[stay], node[stay]
        node = below(x, node)
        stay = feature[held] >= 0
        tests, asked, held = tests[stay], asked[stay], held[stay]
        held = below(tests, held)
        ids = (2 * ids[split][:, None] + np.arange(2)).ravel()


class _Tops:
    """The splits of the large nodes of each tree, and the leaves among those nodes."""

    def __init__(self) -> None:
        self.splits: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.leaves: dict[tuple[int, int], np.ndarray] = {}

    def add(self, model: int, node: list[int], feature: list[int], cut: list[int]) -> None:
        old = self.splits.get(model, (np.zeros(0, np.int64),) * 3)
        new = [np.concatenate([a, np.array(b, np.int64)]) for a, b in zip(old, (node, feature, cut))]
        order = np.argsort(new[0])
        self.splits[model] = tuple(a[order] for a in new)

    def node(self, model: int, x: np.ndarray) -> np.ndarray:
        """The node below all known splits that each row reaches."""
        at = np.ones(len(x), np.int64)
        if model not in self.splits:
            return at
        ids, feature, cut = self.splits[model]
        while True:
            i = np.minimum(np.searchsorted(ids, at), len(ids) - 1)
            on = np.flatnonzero(ids[i] == at)
            if not len(on):
                return at
            at[on] = 2 * at[on] + (x[on, feature[i[on]]] > cut[i[on]])


def forest_votes(df: DataFrame, key: str, vec: str, label: str, fold: str, trees: int = 100, depth: int = 30, least: int = 1,
                 bins: int = BINS, seed: int = SEED) -> tuple[DataFrame, list]:
    """(key, c, share) votes of the trees that a row was held out of, and the labels that ``c`` numbers."""
    df = df.select(key, vec, label, fold).where(F.col(vec).isNotNull())
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if not labels:
        raise ValueError("no labelled rows")
    edges = bin_edges(df, vec, bins)
    k, d = len(labels), len(edges)
    slots = int(np.ceil(np.sqrt(d)))
    models = [(i * trees + t, i) for i in range(len(folds)) for t in range(trees)]
    seeds = {m: _tree_seed(seed, m) for m, _ in models}
    code, place = {v: i for i, v in enumerate(labels)}, {f: i for i, f in enumerate(folds)}
    kind = df.schema[key].dataType.simpleString()

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if len(part):
                x = _binned(np.stack(part["v"].to_numpy()).astype(float), edges)
                y = [code.get(v, -1) for v in part["y"].astype(object).where(part["y"].notna(), None).tolist()]
                yield pd.DataFrame({"k": part["k"], "h": part["h"], "f": [place[f] for f in part["f"].tolist()], "y": y, "x": [r.tobytes() for r in x]})

    n = df.count()
    rows = df.select(F.col(key).alias("k"), F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(fold).alias("f"), F.col(label).alias("y"), F.col(vec).cast("array<double>").alias("v"))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    table = materialise(rows.mapInPandas(pack, f"k {kind}, h bigint, f int, y int, x binary").repartition(tasks), "forest")

    def read(part: pd.DataFrame):
        x = np.frombuffer(b"".join(part["x"]), np.uint8).reshape(len(part), d)
        return x, part["h"].to_numpy(np.int64).view(np.uint64), part["f"].to_numpy(), part["y"].to_numpy(np.int64)

    def reached(x, h, f, y, model, own, tops):
        """(train rows, their weights, test rows, node of every row) of a tree."""
        w = np.where((f != own) & (y >= 0), bag(seeds[model], h), 0)
        return np.flatnonzero(w), w, np.flatnonzero(f == own), tops.node(model, x)

    tops = _Tops()
    open_ = [(m, f, 1) for m, f in models] if n > GROUP_ROWS else []
    step = max(1, PASS_BYTES // (slots * bins * (k + 1) * 8))
    while open_:
        after, new = [], {}
        for lo in range(0, len(open_), step):
            some = open_[lo:lo + step]
            for r in _large_splits(table, read, reached, some, tops, seeds, d, k, slots, bins, depth, least).collect():
                model, own, node = some[r["cell"]]
                if r["feature"] < 0:
                    tops.leaves[model, node] = np.array(r["counts"], float)
                    continue
                new.setdefault(model, []).append((node, r["feature"], r["cut"]))
                after += [(model, own, 2 * node + side) for side in (0, 1) if r["reached"][side] > GROUP_ROWS]
        for model, found in new.items():
            tops.add(model, *map(list, zip(*found)))
        open_ = after

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            x, h, f, y = read(part)
            keys = part["k"].to_numpy()
            for model, own in models:
                train, w, test, at = reached(x, h, f, y, model, own, tops)
                out = []
                for node in np.unique(at[np.concatenate([train, test])]).tolist():
                    if (model, node) in tops.leaves:
                        continue
                    a, b = train[at[train] == node], test[at[test] == node]
                    yw = np.c_[y[a], w[a]].astype(np.int32)
                    out.append((model, node, x[a].tobytes(), yw.tobytes(), x[b].tobytes(), list(keys[b])))
                yield pd.DataFrame(out, columns=["model", "node", "x", "yw", "tests", "keys"])

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        model, node = int(part["model"].iat[0]), int(part["node"].iat[0])
        x, tests = (np.frombuffer(b"".join(part[c]), np.uint8).reshape(-1, d) for c in ("x", "tests"))
        yw = np.frombuffer(b"".join(part["yw"]), np.int32).reshape(-1, 2).astype(np.int64)
        keys = np.concatenate([np.asarray(v, object) for v in part["keys"]])
        found = list(grown_votes(x, yw[:, 0], yw[:, 1], tests, node, seeds[model], k, bins, slots, depth, least))
        if not found:
            return pd.DataFrame({"key": [], "c": [], "share": []})
        r, c, share = (np.concatenate(v) for v in zip(*found))
        return pd.DataFrame({"key": keys[r], "c": c, "share": share})

    def settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ended = {m for m, _ in tops.leaves}
        for part in batches:
            if not len(part):
                continue
            x, h, f, y = read(part)
            for model, own in models:
                if model not in ended:
                    continue
                test = np.flatnonzero(f == own)
                at = tops.node(model, x[test])
                for node in np.unique(at).tolist():
                    if (model, node) in tops.leaves:
                        share = tops.leaves[model, node] / tops.leaves[model, node].sum()
                        for c in np.flatnonzero(share).tolist():
                            yield pd.DataFrame({"key": part["k"].to_numpy()[test[at == node]], "c": c, "share": share[c]})

    out = f"key {kind}, c int, share double"
    votes = table.mapInPandas(deal, f"model int, node bigint, x binary, yw binary, tests binary, keys array<{kind}>").groupBy("model", "node").applyInPandas(grow, out)
    if tops.leaves:
        votes = votes.unionByName(table.mapInPandas(settled, out))
    return votes, labels


def _large_splits(table, read, reached, cells, tops, seeds, d, k, slots, bins, depth, least) -> DataFrame:
    """(cell, feature, cut, reached, counts): the split of each listed node and the rows that reach its sides, or its class counts if it is a leaf."""
    by_model: dict[int, list[tuple[int, int, int]]] = {}
    for i, (model, own, node) in enumerate(cells):
        by_model.setdefault(model, []).append((node, i, own))
    size = slots * bins * (k + 1)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(cells), size), np.int64)
        for part in batches:
            if not len(part):
                continue
            x, h, f, y = read(part)
            for model, listed in by_model.items():
                listed = sorted(listed)
                ids, cell = np.array([v[0] for v in listed]), np.array([v[1] for v in listed])
                train, w, test, at = reached(x, h, f, y, model, listed[0][2], tops)
                feats = drawn_features(seeds[model], ids, d, slots)
                # rows to predict are counted as a class of their own
                for rows, c, weight in ((train, y[train], w[train]), (test, np.full(len(test), k), np.ones(len(test)))):
                    i = np.minimum(np.searchsorted(ids, at[rows]), len(ids) - 1)
                    on = ids[i] == at[rows]
                    i, rows, c, weight = i[on], rows[on], c[on], weight[on]
                    spot = ((i[:, None] * slots + np.arange(slots)) * bins + x[rows[:, None], feats[i]]) * (k + 1) + c[:, None]
                    total[cell] += np.bincount(spot.ravel(), np.repeat(weight, slots), len(ids) * size).astype(np.int64).reshape(len(ids), size)
        for i in np.flatnonzero(total.any(1)).tolist():
            yield pd.DataFrame({"cell": [i], "s": [total[i].tobytes()]})

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        i = int(part["cell"].iat[0])
        total = sum(np.frombuffer(s, np.int64) for s in part["s"]).reshape(slots * bins, k + 1)
        model, _, node = cells[i]
        counts = total[:bins, :k].sum(0)
        held = np.flatnonzero(total[:, :k].any(1))
        slot, cut = best_splits(held, total[held, :k], 1, slots, bins, least) if node < 1 << depth else (np.array([-1]), np.array([0]))
        s, c = int(slot[0]), int(cut[0])
        both = [0, 0]
        if s >= 0:
            sums = total[s * bins:(s + 1) * bins].sum(1)
            both = [int(sums[:c + 1].sum()), int(sums[c + 1:].sum())]
        feature = int(drawn_features(seeds[model], np.array([node]), d, slots)[0, s]) if s >= 0 else -1
        return pd.DataFrame({"cell": [i], "feature": [feature], "cut": [c], "reached": [both], "counts": [counts.tolist()]})

    return table.mapInPandas(count, "cell int, s binary").groupBy("cell").applyInPandas(
        pick, "cell int, feature int, cut int, reached array<bigint>, counts array<bigint>"
    )


def forest_oof(df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", **settings) -> DataFrame:
    """``df`` with y_true and y_pred, every row by the forest of the other folds."""
    votes, labels = forest_votes(df, key, vec, label, fold, **settings)
    sums = votes.groupBy("key", "c").agg(F.round(F.sum("share"), 9).alias("s"))
    best = sums.groupBy("key").agg(F.min_by("c", F.struct(-F.col("s"), F.col("c"))).alias("c"))
    names = F.array(*[F.lit(v) for v in labels])
    out = df.where(F.col(vec).isNotNull()).withColumn(TRUE, F.col(label)).join(best.withColumnRenamed("key", key), key, "left")
    return out.withColumn(PRED, F.get(names, F.coalesce("c", F.lit(0)))).drop("c")
