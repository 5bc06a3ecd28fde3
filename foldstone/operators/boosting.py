"""Multi-class histogram boosting, all folds at once.

Features are cut into bins at quantiles of mergeable sketches. A round grows,
for every fold at the same time, one tree with a vector of class scores in its
leaves: at each level tasks return histograms of gradients by (fold, node,
feature, bin), the sums of a (fold, node) meet in one group, and the split it
picks goes to the driver. The size of the sums depends on folds, nodes,
features, bins and classes and never on the rows. A last pass of a round sums gradients and
second derivatives by leaf for a Newton step of the softmax loss.

Scores of the rows are stored with the rows every ``STORED`` rounds; in
between they follow from the few trees since, so each pass reads one table
that outlives any executor.

Defined results. Rows without label or vector take no part in fits. A fold
whose other folds hold no row predicts the first label. Missing bins cannot
happen: a value beyond the last cut is in the last bin. Ties of gains go to
the smaller feature, then the smaller cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .evaluate import PRED, TRUE

BINS = 32
BLOCK_ROWS = 1024
#: Rows of a task at least, where there are as many.
TASK_ROWS = 8192
#: Rounds between stored scores.
STORED = 10
#: Relative error of the quantile sketches, in bins.
SKETCH = 0.05


def bin_edges(df: DataFrame, vec: str, bins: int = BINS) -> np.ndarray:
    """(feature, bins - 1) increasing cuts at quantiles, from sketches that merge over tasks."""
    width = df.agg(F.max(F.size(vec))).first()[0] or 0
    if not width:
        return np.zeros((0, bins - 1))
    at = [i / bins for i in range(1, bins)]
    accuracy = int(bins / SKETCH)
    found = []
    for lo in range(0, width, 256):  # columns of one aggregate
        columns = [F.percentile_approx(F.get(vec, F.lit(j)), F.array(*map(F.lit, at)), accuracy).alias(f"q{j}") for j in range(lo, min(lo + 256, width))]
        row = df.agg(*columns).first()
        found += [row[f"q{j}"] for j in range(lo, min(lo + 256, width))]
    return np.array(found, float)


@dataclass
class Trees:
    """One tree a fold: per level, the feature and cut of each node (-1: none), and the class scores of the leaves."""

    feature: list[np.ndarray]  # level -> (fold, node)
    cut: list[np.ndarray]
    leaf: np.ndarray | None = None  # (fold, leaf, class)

    def node(self, x: np.ndarray, fold: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Node of each row, in the tree of ``fold``, below so many levels; rows of an unsplit node go left."""
        at = np.zeros(len(x), np.int64)
        for feature, cut in zip(self.feature[:levels], self.cut[:levels]):
            f = feature[fold, at]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[fold, at])
            at = 2 * at + right
        return at


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1).astype(np.uint8) if len(edges) else np.zeros((len(x), 0), np.uint8)


def _blocks(df: DataFrame, vec: str, label: str, fold: str, edges: np.ndarray, labels: list, folds: list, prior: np.ndarray, n: int) -> DataFrame:
    """(x, y, z): binned features, (label, fold) numbers and (row, fold, class) scores of packed rows; stored.

    A task holds some thousand rows at least, and there are no more tasks than
    cores: what a task returns does not depend on its rows, so neither does
    what a pass moves.
    """
    code, place = {v: i for i, v in enumerate(labels)}, {f: i for i, f in enumerate(folds)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), BLOCK_ROWS):
                some = part.iloc[lo:lo + BLOCK_ROWS]
                y = np.array([(code[a], place[b]) for a, b in zip(some["y"].tolist(), some["f"].tolist())], np.int32)
                z = np.broadcast_to(prior[None], (len(some), *prior.shape)).astype(np.float32)
                yield pd.DataFrame({"x": [_binned(np.stack(some["v"].to_numpy()), edges).tobytes()], "y": [y.tobytes()], "z": [z.tobytes()]})

    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("y"), F.col(fold).alias("f"))
    tasks = min(rows.rdd.getNumPartitions(), max(1, -(-n // TASK_ROWS)), df.sparkSession.sparkContext.defaultParallelism)
    return materialise(rows.coalesce(tasks).mapInPandas(run, "x binary, y binary, z binary"), "boost")


class _Sums:
    def __init__(self, n_folds: int, n_classes: int, rate: float):
        self.f, self.k, self.rate = n_folds, n_classes, rate

    def rows(self, part: pd.DataFrame, recent: list[Trees]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(x, label, fold, scores) of each block, with the trees since the last store added."""
        for xb, yb, zb in zip(part["x"], part["y"], part["z"]):
            y = np.frombuffer(yb, np.int32).reshape(-1, 2)
            x = np.frombuffer(xb, np.uint8).reshape(len(y), -1)
            z = np.frombuffer(zb, np.float32).reshape(len(y), self.f, self.k).astype(float)
            for tree in recent:
                for f in range(self.f):
                    z[:, f] += self.rate * tree.leaf[f, tree.node(x, np.full(len(x), f))]
            yield x, y[:, 0], y[:, 1], z

    def gradients(self, label, fold, z, f):
        """(train rows, gradients, second derivatives) of the model of fold ``f``."""
        own = np.flatnonzero(fold != f)
        e = np.exp(z[own, f] - z[own, f].max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        g = p.copy()
        g[np.arange(len(own)), label[own]] -= 1.0
        return own, g, p * (1.0 - p)


def _added(df: DataFrame, run, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the arrays that ``run(frame)`` yields, added in a tree; partial sums travel as single floats."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            for out in run(part):
                total = out if total is None else total + out
        if total is not None:
            yield pd.DataFrame({"s": [total.astype(np.float32).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            for s in part["s"]:
                one = np.frombuffer(s, np.float32).astype(float)
                total = one if total is None else total + one
        if total is not None:
            yield pd.DataFrame({"s": [total.astype(np.float32).tobytes()]})

    sums, left = df.mapInPandas(partial, "s binary"), df.rdd.getNumPartitions()
    while left > 16:
        left = int(np.ceil(np.sqrt(left)))
        sums = sums.repartition(left).mapInPandas(add, "s binary")
    rows = sums.collect()
    return np.sum([np.frombuffer(r["s"], np.float32).astype(float) for r in rows], axis=0).reshape(shape) if rows else np.zeros(shape)


def _chosen(df: DataFrame, run, shape: tuple[int, ...], ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_splits` of the summed (fold, class + 1, node, feature, bin) arrays that ``run(frame)`` yields.

    The sums of a (fold, node) meet in one group of a row a task and become a
    split there: the driver gets two numbers a node, never a histogram.
    """
    n_f, k, nodes, d, bins = shape
    one = df.rdd.getNumPartitions() == 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for part in batches:
            for out in run(part):
                total = out if total is None else total + out
        if total is None:
            return
        total = total.reshape(shape).astype(np.float32)
        if one:
            feature, cut = _splits(total.astype(float), ridge, least)
            yield pd.DataFrame({"cell": np.arange(n_f * nodes), "feature": feature.ravel(), "cut": cut.ravel()})
            return
        task = TaskContext.get().partitionId()
        for f in range(n_f):
            some = [n for n in range(nodes) if total[f, -1, n].any()]
            if some:
                yield pd.DataFrame({"cell": [f * nodes + n for n in some], "task": task, "s": [total[f, :, n].tobytes() for n in some]})

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        # in the order of tasks, so that reruns add alike
        total = sum(np.frombuffer(s, np.float32).astype(float) for s in part.sort_values("task")["s"])
        feature, cut = _splits(total.reshape(1, k, 1, d, bins), ridge, least)
        return pd.DataFrame({"cell": part["cell"].iloc[:1], "feature": feature[0], "cut": cut[0]})

    kind = "cell int, feature int, cut int"
    rows = df.mapInPandas(partial, kind) if one else df.mapInPandas(partial, "cell int, task int, s binary").groupBy("cell").applyInPandas(pick, kind)
    feature, cut = np.full(n_f * nodes, -1), np.zeros(n_f * nodes, np.int64)
    for r in rows.collect():
        feature[r["cell"]], cut[r["cell"]] = r["feature"], r["cut"]
    return feature.reshape(n_f, nodes), cut.reshape(n_f, nodes)


def _splits(hist: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each (fold, node) from (fold, class + 1, node, feature, bin) sums; the last of the classes is the weight."""
    left = hist.cumsum(4)
    g, h = left[:, :-1], left[:, -1]
    whole, weight = g[..., -1], h[..., -1:]
    # squares of the right side from those of the left: no array of its sums is made
    ll = np.einsum("fcndb,fcndb->fndb", g, g)
    ww = np.einsum("fcnd,fcnd->fnd", whole, whole)[..., None]
    rr = ww - 2 * np.einsum("fcndb,fcnd->fndb", g, whole) + ll
    score = ll / (h + ridge) + rr / (weight - h + ridge) - ww / (weight + ridge)
    score[(h < least) | (weight - h < least)] = 0.0
    flat = score[..., :-1].reshape(*score.shape[:2], -1)
    best = flat.argmax(2)
    cuts = score.shape[3] - 1
    good = np.take_along_axis(flat, best[..., None], 2)[..., 0] > 1e-9
    return np.where(good, best // cuts, -1), np.where(good, best % cuts, 0)


@dataclass
class Boosted:
    """Trees of all rounds with what they need to score rows."""

    rounds: list[Trees]
    edges: np.ndarray
    labels: list
    folds: list
    prior: np.ndarray
    rate: float
    votes: list[np.ndarray] = ()  # of stumps: the weight of each fold's vote

    def scores(self, x: np.ndarray, fold: np.ndarray) -> np.ndarray:
        """(row, class) scores of vectors by the models of the numbered folds."""
        x = _binned(x, self.edges)
        if len(self.votes):
            z = np.zeros((len(x), len(self.labels)))
            for tree, vote in zip(self.rounds, self.votes):
                z[np.arange(len(x)), tree.leaf[fold, tree.node(x, fold)]] += vote[fold]
            return z
        z = self.prior[fold].copy()
        for tree in self.rounds:
            z += self.rate * tree.leaf[fold, tree.node(x, fold)]
        return z

    def predict(self, df: DataFrame, vec: str, fold: str) -> DataFrame:
        """``df`` + y_pred: each row by the model that its fold was held out of."""
        kind = {int: "bigint", bool: "boolean"}.get(type(self.labels[0]), "string")
        labels, place = np.array(self.labels, dtype=object), {f: i for i, f in enumerate(self.folds)}

        @F.pandas_udf(kind)
        def guess(v: pd.Series, f: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(labels[self.scores(np.stack(v.to_numpy()).astype(float), np.array([place[a] for a in f.tolist()])).argmax(1)])

        return df.withColumn(PRED, guess(F.col(vec), F.col(fold)))


def boost(
    df: DataFrame, vec: str, label: str, fold: str, rounds: int = 100, depth: int = 6, rate: float = 0.3, ridge: float = 1.0, least: float = 1.0, bins: int = BINS,
) -> Boosted:
    """Models of all folds, each trained on the rows of the others.

    ``least``: second derivatives of a child, the mean over classes.
    """
    df = df.select(vec, label, fold)
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if not labels:
        raise ValueError("no labelled rows")
    edges = bin_edges(df, vec, bins)
    n_f, k, d = len(folds), len(labels), len(edges)
    counts = np.zeros((n_f, k))
    for r in df.groupBy(fold, label).count().where(F.col(label).isNotNull()).collect():
        counts[[f != r[fold] for f in folds], labels.index(r[label])] += r["count"]
    prior = np.log((counts + 1e-3) / (counts + 1e-3).sum(1, keepdims=True))
    table, sums = _blocks(df, vec, label, fold, edges, labels, folds, prior, int(counts.sum())), _Sums(n_f, k, rate)
    model = Boosted([], edges, labels, folds, prior, rate)
    recent: list[Trees] = []
    for turn in range(rounds):
        tree = Trees([], [])
        for level in range(depth):
            shape = (n_f, k + 1, 2**level, d, bins)

            def histograms(part, tree=tree, recent=tuple(recent), shape=shape):
                out = np.zeros((n_f, k + 1, shape[2] * d * bins))
                cell = np.arange(d)[None, :] * bins
                for x, y, fold_, z in sums.rows(part, recent):
                    for f in range(n_f):
                        own, g, h = sums.gradients(y, fold_, z, f)
                        node = tree.node(x[own], np.full(len(own), f))
                        at = (node[:, None] * d * bins + cell + x[own]).ravel()
                        for c, value in enumerate([*g.T, h.sum(1)]):
                            out[f, c] += np.bincount(at, np.repeat(value, d), minlength=shape[2] * d * bins)
                yield out

            feature, cut = _chosen(table, histograms, shape, ridge, least * k)
            tree.feature.append(feature)
            tree.cut.append(cut)
            if (feature < 0).all():
                break

        def leaves(part, tree=tree, recent=tuple(recent)):
            n = 2 ** len(tree.feature)
            out = np.zeros((n_f, n, k, 2))
            for x, y, fold_, z in sums.rows(part, recent):
                for f in range(n_f):
                    own, g, h = sums.gradients(y, fold_, z, f)
                    node = tree.node(x[own], np.full(len(own), f))
                    for c in range(k):
                        out[f, :, c, 0] += np.bincount(node, g[:, c], minlength=n)
                        out[f, :, c, 1] += np.bincount(node, h[:, c], minlength=n)
            yield out

        found = _added(table, leaves, (n_f, 2 ** len(tree.feature), k, 2))
        tree.leaf = -found[..., 0] / (found[..., 1] + ridge)
        model.rounds.append(tree)
        recent.append(tree)
        if len(recent) == STORED and turn + 1 < rounds:
            table, recent = _stored(table, sums, recent), []
    return model


def _stored(table: DataFrame, sums: _Sums | _Weights, recent: list) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            z = [s.astype(np.float32).tobytes() for *_, s in sums.rows(part, recent)]
            yield pd.DataFrame({"x": part["x"], "y": part["y"], "z": z})

    return materialise(table.mapInPandas(run, "x binary, y binary, z binary"), "boost")


def boost_stumps(df: DataFrame, vec: str, label: str, fold: str, rounds: int = 50, rate: float = 1.0, bins: int = BINS) -> Boosted:
    """SAMME over trees of one split, all folds at once: one pass a round.

    The histograms hold the class weights of the train rows, so the split with
    the least Gini impurity, the leaves' classes and the weighted error follow
    from them. A fold stops when a stump is perfect or no better than chance.
    """
    df = df.select(vec, label, fold)
    labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    if not labels:
        raise ValueError("no labelled rows")
    edges = bin_edges(df, vec, bins)
    n_f, k, d = len(folds), len(labels), len(edges)
    n = df.where(F.col(label).isNotNull()).count()
    table = _blocks(df, vec, label, fold, edges, labels, folds, np.zeros((n_f, 1)), n)
    model = Boosted([], edges, labels, folds, np.zeros((n_f, k)), rate, [])
    weights = _Weights(n_f)
    recent: list[tuple[Trees, np.ndarray, np.ndarray]] = []
    going = np.ones(n_f, bool)
    for turn in range(rounds):
        shape = (n_f, k + 1, 1, d, bins)

        def histograms(part, recent=tuple(recent)):
            out = np.zeros(shape)
            cell = np.arange(d)[None, :] * bins
            for x, y, fold_, z in weights.rows(part, recent):
                for f in range(n_f):
                    own = np.flatnonzero(fold_ != f)
                    w, at = np.exp(z[own, f]), cell + x[own]
                    for c in range(k):
                        mine = y[own] == c
                        out[f, c, 0] += np.bincount(at[mine].ravel(), np.repeat(w[mine], d), minlength=d * bins).reshape(d, bins)
            out[:, k] = out[:, :k].sum(1)
            yield out

        hist = _added(table, histograms, shape)
        feature, cut = _splits(hist, 1e-12, 1e-12)
        leaf, alpha, whole = np.zeros((n_f, 2), np.int64), np.zeros(n_f), np.ones(n_f)
        for f in np.flatnonzero(going):
            classes = hist[f, :k, 0, max(feature[f, 0], 0)].T
            sides = np.stack([classes[: cut[f, 0] + 1].sum(0), classes[cut[f, 0] + 1:].sum(0)]) if feature[f, 0] >= 0 else np.stack([classes.sum(0)] * 2)
            leaf[f] = sides.argmax(1)
            whole[f] = classes.sum() or 1.0
            error = 1.0 - (sides.max(1).sum() if feature[f, 0] >= 0 else sides[0].max()) / whole[f]
            if error <= 1e-12:
                alpha[f], going[f] = 1.0, False
            elif error >= 1 - 1 / k:
                going[f] = False
            else:
                alpha[f] = rate * (np.log((1 - error) / error) + np.log(k - 1))
        if turn == 0:
            alpha[alpha == 0] = 1e-9  # a fold without a useful stump still has its first one's classes
        stump = Trees([feature], [cut], leaf)
        model.rounds.append(stump)
        model.votes.append(alpha)
        if not going.any():
            break
        recent.append((stump, alpha, np.log(whole)))
        if len(recent) == STORED and turn + 1 < rounds:
            table, recent = _stored(table, weights, recent), []
    return model


class _Weights:
    """Logarithms of row weights by fold, in the place of scores."""

    def __init__(self, n_folds: int):
        self.f = n_folds

    def rows(self, part: pd.DataFrame, recent) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for xb, yb, zb in zip(part["x"], part["y"], part["z"]):
            y = np.frombuffer(yb, np.int32).reshape(-1, 2)
            x = np.frombuffer(xb, np.uint8).reshape(len(y), -1)
            z = np.frombuffer(zb, np.float32).reshape(len(y), self.f).astype(float)
            for stump, alpha, whole in recent:
                for f in range(self.f):
                    miss = stump.leaf[f, stump.node(x, np.full(len(x), f))] != y[:, 0]
                    z[:, f] += alpha[f] * miss - whole[f]
            yield x, y[:, 0], y[:, 1], z


def stumps_oof(df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", **settings) -> DataFrame:
    """``df`` with y_true and y_pred by :func:`boost_stumps` of the other folds."""
    return boost_stumps(df, vec, label, fold, **settings).predict(df, vec, fold).withColumn(TRUE, F.col(label))


def boosted_oof(df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", **settings) -> DataFrame:
    """``df`` with y_true and y_pred, every row by the model of the other folds."""
    return boost(df, vec, label, fold, **settings).predict(df, vec, fold).withColumn(TRUE, F.col(label))
