"""Perceptrons of one hidden layer fitted together: all folds and arms in one pass a step.

The form of MLlib's classifier: sigmoid units, a softmax over the classes, the
mean cross-entropy without a penalty, L-BFGS from MLlib's own starting weights
for the seed. As in :mod:`stacked`, rows are packed in blocks once; a step
sends the weights of all models to the tasks, each task multiplies the rows of
every model in its blocks, and the gradients are added in a tree. The passes
are those of the slowest model, not the sum over models, and no model has a
table of its own. Weights and gradients are all that the driver sees. Products
of standardised rows are in single precision, all sums over rows in double.

A stack can go on from the weights of another (``start``), with the scalers of
that one, or keep its hidden layer and fit a new penalised head (``head_only``),
which is a logistic regression over the hidden units. Steps of the line search
differ from MLlib's, so the fits agree in loss and not in each prediction.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from ..vocab import SEED
from .evaluate import PRED, TRUE
from .stacked import STACK_BYTES, Spec, _loss, _pack, _Pass, _Path, fold_specs

#: Rows multiplied at once: their hidden units stay in a core's cache.
ROWS = 1024


@dataclass
class Nets:
    """Fitted models over standardised rows: ``hidden`` (model, unit, feature + 1), ``head`` (model, class, unit + 1), intercepts last."""

    specs: list[Spec]
    labels: list
    hidden: np.ndarray
    head: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    known: np.ndarray
    value: np.ndarray
    steps: int = 0

    def raw(self) -> np.ndarray:
        """Hidden weights for rows as they are."""
        out = np.empty_like(self.hidden)
        out[:, :, :-1] = self.hidden[:, :, :-1] / self.sd[:, None, :]
        out[:, :, -1] = self.hidden[:, :, -1] - np.einsum("mhd,md->mh", out[:, :, :-1], self.mean)
        return out

    def predict(self, df: DataFrame, key: str, vec: str, label: str, role: str, held: dict[int, Sequence[int]]) -> DataFrame:
        """(key, model, y_true, y_pred): rows whose role is among ``held[model]``, by that model; classes a model never saw are not predicted."""
        kind, out = (df.schema[c].dataType.simpleString() for c in (key, label))
        labels, raw, head, known = np.array(self.labels, dtype=object), self.raw(), self.head, self.known

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                roles = part["r"].to_numpy()
                for m, values in held.items():
                    at = np.flatnonzero(np.isin(roles, values))
                    for lo in range(0, len(at), ROWS):
                        some = at[lo:lo + ROWS]
                        z = _units(np.stack(part["v"].to_numpy()[some]).astype(float), raw[m]) @ head[m, :, :-1].T + head[m, :, -1]
                        z[:, ~known[m]] = -np.inf
                        yield pd.DataFrame({"key": part["k"].to_numpy()[some], "model": m, TRUE: part["y"].to_numpy()[some], PRED: labels[z.argmax(1)]})

        rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("k"), F.col(vec).alias("v"), F.col(label).alias("y"), F.coalesce(F.col(role).cast("int"), F.lit(-1)).alias("r"))
        return rows.mapInPandas(run, f"key {kind}, model int, {TRUE} {out}, {PRED} {out}").withColumnRenamed("key", key)


def _units(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hidden units of rows as they are."""
    a = x @ w[:, :-1].T
    a += w[:, -1]
    np.negative(a, out=a)
    with np.errstate(over="ignore"):
        np.exp(a, out=a)
    a += 1.0
    return np.reciprocal(a, out=a)


def starting_weights(spark: SparkSession, d: int, hidden: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The weights MLlib's classifier starts from: hidden (unit, feature + 1) and head (class, unit + 1)."""
    one = spark.createDataFrame([(Vectors.dense([0.0] * d), 0.0)], ["features", "label"])
    w = MultilayerPerceptronClassifier(layers=[d, hidden, k], maxIter=0, seed=seed).fit(one).weights.toArray()
    cut = hidden * (d + 1)

    def layer(part: np.ndarray, n_out: int, n_in: int) -> np.ndarray:
        return np.c_[part[: n_out * n_in].reshape((n_out, n_in), order="F"), part[n_out * n_in:]]

    return layer(w[:cut], hidden, d), layer(w[cut:], k, hidden)


def fit_nets(
    df: DataFrame, vec: str, label: str, role: str, specs: Sequence[Spec], hidden: int = 256, max_iter: int = 200, tol: float = 1e-6,
    start: Nets | None = None, head_only: bool = False, labels: list | None = None,
) -> Nets:
    """Fit all ``specs`` over the rows of ``df``; ``role`` is an integer column. ``start`` has a model for each spec.

    The penalty of a spec counts with ``head_only`` alone. A model is done after ``max_iter`` steps taken, when
    the norm of its gradient is below ``tol`` of its loss, or when no step improves it.
    """
    if labels is None:
        labels = start.labels if start is not None else sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    specs, k = list(specs), len(labels)
    blocks = materialise(_pack(df, vec, label, [role], labels), "blocks").persist()
    try:
        first = blocks.select(F.length("x").alias("a"), F.length("y").alias("b")).first()
        if first is None:
            raise ValueError("no rows to fit")
        d = first["a"] // 8 // (first["b"] // 8)
        run = _Pass(blocks, 1, specs, None)
        every = np.arange(len(specs))
        mean, sd, n = _scales(run, every, k)
        known = n > 0
        if start is None:
            w1, w2 = starting_weights(df.sparkSession, d, hidden, k)
            w1, w2 = np.stack([w1] * len(specs)), np.stack([w2] * len(specs))
        else:
            if not head_only and not np.array_equal(known, start.known):
                raise ValueError("both stages need the same labels for a warm start")
            mean, sd = start.mean, start.sd
            w1, w2 = start.hidden.copy(), np.zeros_like(start.head) if head_only else start.head.copy()
        nets = Nets(specs, labels, w1, w2, mean, sd, known, np.zeros(len(specs)))
        turn = max(1, STACK_BYTES // ((w1[0].size + w2[0].size) * 8))
        for lo in range(0, len(specs), turn):
            _descend(run, nets, every[lo:lo + turn], n, max_iter, tol, head_only)
    finally:
        blocks.unpersist()
    return nets


def _scales(run: _Pass, models: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and population sd of each model's train rows, and its total weight of each class."""
    used = lambda w: (w > 0).astype(float)

    def sums(x, y, w):
        size = np.zeros((len(models), k))
        for c in np.unique(y):
            size[:, c] = w[y == c].sum(0)
        return [used(w).sum(0), used(w).T @ x, size]

    n, s, size = run.total(models, sums)
    mean = s / np.maximum(n, 1)[:, None]
    middle = mean.mean(0)
    (square,) = run.total(models, lambda x, y, w: [used(w).T @ (x - middle) ** 2])
    sd = np.sqrt(np.maximum(square / np.maximum(n, 1)[:, None] - (mean - middle) ** 2, 0.0))
    sd[sd < 1e-12] = 1.0
    return mean, sd, size


def _descend(run: _Pass, nets: Nets, models: np.ndarray, size: np.ndarray, max_iter: int, tol: float, head_only: bool) -> None:
    total = np.maximum(size.sum(1), 1e-300)
    ridge = np.array([1.0 / (s.c * t) for s, t in zip(nets.specs, total)]) if head_only else np.zeros(len(total))
    units, width = nets.hidden.shape[1:]
    cut = 0 if head_only else units * width
    k = nets.head.shape[1]

    def flat(m: int) -> np.ndarray:
        return nets.head[m].ravel() if head_only else np.concatenate([nets.hidden[m].ravel(), nets.head[m].ravel()])

    def put(m: int, w: np.ndarray) -> None:
        if not head_only:
            nets.hidden[m] = w[:cut].reshape(units, width)
        nets.head[m] = w[cut:].reshape(k, units + 1)

    def evaluate(at: list[int], trial: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Loss and gradient of each model at its trial weights."""
        tried = Nets([nets.specs[m] for m in at], nets.labels, nets.hidden[at], nets.head[at], nets.mean[at], nets.sd[at], nets.known[at], total[at])
        for i, w in enumerate(trial):
            if not head_only:
                tried.hidden[i] = w[:cut].reshape(units, width)
            tried.head[i] = w[cut:].reshape(k, units + 1)
        layer, head, known, mean, sd = tried.hidden.astype(np.float32), tried.head.astype(np.float32), tried.known, tried.mean, tried.sd

        def work(x, y, weights):
            value = np.zeros(len(at))
            grad1, grad2 = np.zeros((len(at), 0 if head_only else units, width)), np.zeros((len(at), k, units + 1))
            for m in range(len(at)):
                own = np.flatnonzero(weights[:, m])
                for lo in range(0, len(own), ROWS):
                    some = own[lo:lo + ROWS]
                    xs, ws = ((x[some] - mean[m]) / sd[m]).astype(np.float32), weights[some, m]
                    a = _units(xs, layer[m])
                    z = (a @ head[m, :, :-1].T + head[m, :, -1]).astype(float)
                    z[:, ~known[m]] = -np.inf
                    v, g = _loss("logistic", z[:, None, :], y[some])
                    g = g[:, 0] * ws[:, None]
                    value[m] += v[:, 0] @ ws
                    grad2[m, :, -1] += g.sum(0)
                    g = g.astype(np.float32)
                    grad2[m, :, :-1] += g.T @ a
                    if not head_only:
                        back = g @ head[m, :, :-1]
                        back *= a
                        np.subtract(1.0, a, out=a)
                        back *= a
                        grad1[m, :, :-1] += back.T @ xs
                        grad1[m, :, -1] += back.sum(0, dtype=float)
            return [value, grad1, grad2]

        value, grad1, grad2 = run.total(np.array(at), work)
        out = []
        for i, m in enumerate(at):
            grad2[i, :, :-1] += ridge[m] * total[m] * head[i, :, :-1]
            value[i] += 0.5 * ridge[m] * total[m] * float((head[i, :, :-1] ** 2).sum())
            out.append(np.concatenate([grad1[i].ravel(), grad2[i].ravel()]) / total[m])
        return value / total[at], out

    def done(m: int) -> bool:
        return float(np.sqrt(grad[m] @ grad[m])) <= max(tol * abs(nets.value[m]), 1e-8) or taken[m] >= max_iter

    live = [int(m) for m in models if size[m].sum() > 0]
    if not live:
        return
    where, grad, taken = {m: flat(m) for m in live}, {}, dict.fromkeys(live, 0)
    states = {m: _Path() for m in live}
    values, grads = evaluate(live, [where[m] for m in live])
    for m, v, g in zip(live, values, grads):
        nets.value[m], grad[m] = v, g
    passes, live = 1, [m for m in live if not done(m)]
    while live:
        trial = [where[m] + states[m].step(grad[m]) for m in live]
        values, grads = evaluate(live, trial)
        passes, stay = passes + 1, []
        for m, w, v, g in zip(live, trial, values, grads):
            took = states[m].judge(nets.value[m], v, grad[m], g)
            if took:
                where[m], nets.value[m], grad[m] = w, v, g
                taken[m] += 1
                put(m, w)
            if (took and not done(m)) or (not took and states[m].size > 1e-10):
                stay.append(m)
        live = stay
    nets.steps = max(nets.steps, passes)


# ------------------------------------------------------------------ whole runs


def nets_oof(df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", hidden: int = 256, max_iter: int = 200) -> DataFrame:
    """(key, y_true, y_pred): every row by the model of the other folds, all folds fitted together."""
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())
    nets = fit_nets(df, vec, label, fold, fold_specs(folds), hidden, max_iter)
    return nets.predict(df, key, vec, label, fold, {m: [f] for m, f in enumerate(folds)}).select(key, TRUE, PRED)


def arms_oof(
    own: DataFrame, external: DataFrame, key: str, vec: str, label: str, arms: Sequence[str], fold: str = "fold", hidden: int = 256, max_iter: int = 100,
) -> DataFrame:
    """(arm, key, y_true, y_pred) of every row of ``own`` by the model of each arm that did not train on its fold.

    ``ravdess_only`` trains on the other folds, ``pooled`` on the external rows too; ``two_stage`` goes on from
    the pooled model over the other folds, ``two_stage_frozen`` keeps its hidden layer and fits a new head. The pooled
    model is one and the same for all three.
    """
    unknown = set(arms) - {"ravdess_only", "pooled", "two_stage", "two_stage_frozen"}
    if unknown:
        raise ValueError(f"unknown arms {sorted(unknown)}")
    folds = sorted(r[0] for r in own.select(F.col(fold).cast("int")).distinct().collect())
    columns = [key, vec, label, fold]
    outside = external.withColumn(fold, F.lit(-1)).select(*columns)
    rows = own.select(*columns).unionByName(outside)
    base = fold_specs(folds)
    pooled = [Spec(("pooled", f), 0, {**s.weights, -1: 1.0}) for f, s in zip(folds, base)]
    wanted = (base if "ravdess_only" in arms else []) + (pooled if set(arms) - {"ravdess_only"} else [])
    first = fit_nets(rows, vec, label, fold, wanted, hidden, max_iter)
    at = {"ravdess_only": 0, "pooled": len(wanted) - len(folds)}
    last = slice(at["pooled"], None)
    body = Nets(pooled, first.labels, *(a[last] for a in (first.hidden, first.head, first.mean, first.sd, first.known, first.value)))
    out = None
    for arm in arms:
        if arm in at:
            nets, start = first, at[arm]
        else:
            nets, start = fit_nets(own.select(*columns), vec, label, fold, base, hidden, max_iter, start=body, head_only=arm == "two_stage_frozen"), 0
        held = {start + i: [f] for i, f in enumerate(folds)}
        part = nets.predict(own, key, vec, label, fold, held).select(F.lit(arm).alias("arm"), key, TRUE, PRED)
        out = part if out is None else out.unionByName(part)
    return out
