"""Many linear models fitted together: folds, penalties and row weights in one pass a step.

A run over F folds, P penalties and W weights of external rows is F x P x W
convex problems over the same rows. They are solved side by side: coefficients
of all models are one stacked array; a step sends it to the tasks, each task
multiplies its blocks of rows with it once and returns the stacked gradient,
and the partial gradients are added in a tree. The number of passes over the
data is that of the slowest model, not the sum over models.

Every row carries small integer roles (an outer fold, the inner fold for one
outer fold, external or not). A model says which role it looks at and what
weight each value of it has, 0 being left out; so no model needs a table of
its own. Rows are packed in blocks once and kept in memory, spilling to disk.

Features are standardised by the mean and population sd of each model's own
train rows (weight above 0), inside the coefficients: rows stay as they are.
The objective of a model is the weighted mean loss plus |w|^2 / (2 C n) with n
its total weight, intercepts unpenalised: what a solver with penalty C sees.
Losses: "logistic" (multinomial) and "squared_hinge" (one against the rest).
Optimiser: L-BFGS with backtracking, each model with its own history and step;
models that are done cost nothing more.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..vocab import SEED
from .evaluate import PRED, TRUE, scores
from .vectors import apply_scaler, fit_scaler

#: Rows of a packed block.
BLOCK_ROWS = 2048
#: Rows of a task at least, where there are as many.
TASK_ROWS = 8192
#: Bytes of stacked coefficients at once; more models are solved in turns.
STACK_BYTES = 64 << 20
MEMORY = 8
LOSSES = ("logistic", "squared_hinge")


@dataclass(frozen=True)
class Spec:
    """A model: the role it looks at, the weight of each value of it (others 0), and its penalty."""

    name: tuple
    role: int
    weights: dict[int, float]
    c: float = 1.0


@dataclass
class Stack:
    """Fitted models: ``coef`` (model, class, feature + 1), in terms of the rows as they are; the last column is the intercept."""

    specs: list[Spec]
    labels: list
    coef: np.ndarray
    loss: str
    lift: Callable[[np.ndarray], np.ndarray] | None = None
    steps: int = 0
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, x: np.ndarray, models: Sequence[int]) -> np.ndarray:
        """(row, model, class)."""
        x = self.lift(x) if self.lift is not None else x
        w = self.coef[list(models)]
        return np.einsum("nd,mkd->nmk", x, w[:, :, :-1], optimize=True) + w[None, :, :, -1]

    def predict(self, df: DataFrame, key: str, vec: str, roles: Sequence[str], held: dict[int, Sequence[int]] | None = None) -> DataFrame:
        """(key, model, y_pred, score): each row by the models it was held out of.

        ``held[model]`` are the values of the model's role that it predicts;
        without it, the values of weight 0 that rows may have.
        """
        kind = df.schema[key].dataType.simpleString()
        labels = np.array(self.labels, dtype=object)
        named = self.labels[0] if self.labels else ""
        out = "bigint" if isinstance(named, (int, np.integer)) and not isinstance(named, bool) else "boolean" if isinstance(named, bool) else "string"

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                if not len(part):
                    continue
                keys, x = part["k"].to_numpy(), np.stack(part["v"].to_numpy()).astype(float)
                role = np.stack(part["r"].to_numpy())
                for m, spec in enumerate(self.specs):
                    own = role[:, spec.role]
                    at = np.flatnonzero(np.isin(own, held[m]) if held is not None else ~np.isin(own, [v for v, w in spec.weights.items() if w > 0]))
                    if len(at):
                        s = self.scores(x[at], [m])[:, 0]
                        best = s.argmax(1)
                        yield pd.DataFrame({"key": keys[at], "model": m, "y_pred": labels[best], "score": s[np.arange(len(at)), best]})

        rows = df.select(F.col(key).alias("k"), F.col(vec).alias("v"), F.array(*[F.col(r).cast("int") for r in roles]).alias("r"))
        return rows.mapInPandas(run, f"key {kind}, model int, y_pred {out}, score double").withColumnRenamed("key", key)


def _pack(df: DataFrame, vec: str, label: str, roles: Sequence[str], labels: list) -> DataFrame:
    """Rows in blocks of two binary columns: float features; label number and roles."""
    code = {v: i for i, v in enumerate(labels)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for lo in range(0, len(part), BLOCK_ROWS):
                some = part.iloc[lo:lo + BLOCK_ROWS]
                y = np.array([code[v] for v in some["y"].tolist()], np.int32)
                r = np.stack(some["r"].to_numpy()).astype(np.int32)
                yield pd.DataFrame({"x": [np.stack(some["v"].to_numpy()).astype(np.float64).tobytes()], "y": [np.c_[y, r].tobytes()]})

    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(
        F.col(vec).cast("array<double>").alias("v"), F.col(label).alias("y"), F.array(*[F.coalesce(F.col(r).cast("int"), F.lit(-1)) for r in roles]).alias("r")
    )
    # a task holds some thousand rows at least: what it returns does not depend on its rows
    tasks = min(rows.rdd.getNumPartitions(), max(1, -(-df.count() // TASK_ROWS)))
    return rows.coalesce(tasks).mapInPandas(run, "x binary, y binary")


class _Pass:
    """Sums over all blocks; a partial sum is one row a task, and they are added in a tree."""

    def __init__(self, blocks: DataFrame, width: int, specs: list[Spec], lift):
        self.blocks, self.lift, self.n_roles = blocks, lift, width
        self.role = np.array([s.role for s in specs])
        self.tables = [s.weights for s in specs]
        self.tasks = max(1, blocks.rdd.getNumPartitions())

    def total(self, models: np.ndarray, work: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """Sum of ``work(x, y, weights)`` over blocks; weights are (row, model)."""
        lift, n_roles, role, tables = self.lift, self.n_roles, self.role[models], [self.tables[m] for m in models]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, shapes = None, None
            for part in batches:
                for xb, yb in zip(part["x"], part["y"]):
                    yr = np.frombuffer(yb, np.int32).reshape(-1, n_roles + 1)
                    x = np.frombuffer(xb).reshape(len(yr), -1)
                    x = lift(x) if lift is not None else x
                    w = np.zeros((len(yr), len(role)))
                    for m, (r, table) in enumerate(zip(role, tables)):
                        for value, weight in table.items():
                            if weight:
                                w[yr[:, r + 1] == value, m] = weight
                    out = work(x, yr[:, 0], w)
                    shapes = [o.shape for o in out]
                    flat = np.concatenate([np.asarray(o, float).ravel() for o in out])
                    sums = flat if sums is None else sums + flat
            if sums is not None:
                yield pd.DataFrame({"sums": [sums.tobytes()], "shapes": [str(shapes)]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, shapes = None, None
            for part in batches:
                for s, shape in zip(part["sums"], part["shapes"]):
                    sums, shapes = np.frombuffer(s) if sums is None else sums + np.frombuffer(s), shape
            if sums is not None:
                yield pd.DataFrame({"sums": [sums.tobytes()], "shapes": [shapes]})

        partial = self.blocks.mapInPandas(run, "sums binary, shapes string")
        left = self.tasks
        while left > 32:  # a reduction tree: each level adds about sqrt many
            left = int(np.ceil(np.sqrt(left)))
            partial = partial.repartition(left).mapInPandas(add, "sums binary, shapes string")
        rows = partial.collect()
        shapes = [tuple(s) for s in ast.literal_eval(rows[0]["shapes"])]
        flat = np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0)
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [flat[e - int(np.prod(s)):e].reshape(s) for e, s in zip(ends, shapes)]


def _loss(kind: str, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each row and model, its derivative by the scores) of scores (row, model, class)."""
    at = np.arange(len(y))
    if kind == "logistic":
        top = z.max(2, keepdims=True)
        e = np.exp(z - top)
        total = e.sum(2, keepdims=True)
        value = np.log(total[:, :, 0]) + top[:, :, 0] - z[at, :, y]
        g = e / total
        g[at, :, y] -= 1.0
        return value, g
    sign = np.full(z.shape, -1.0)
    sign[at, :, y] = 1.0
    gap = np.maximum(0.0, 1.0 - sign * z)
    return (gap * gap).sum(2), -2.0 * sign * gap


def fit_stack(
    df: DataFrame, vec: str, label: str, roles: Sequence[str], specs: Sequence[Spec], loss: str = "logistic", max_iter: int = 2000,
    tol: float = 1e-5, lift: Callable[[np.ndarray], np.ndarray] | None = None, labels: list | None = None, standardise: bool = True,
) -> Stack:
    """Fit all ``specs`` over the rows of ``df``; ``roles`` are integer columns.

    A model stops when its largest gradient component is below ``tol``, or when no step improves it.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss {loss!r}; expected one of {sorted(LOSSES)}")
    if labels is None:
        # the classes of a stack of coefficients: bounded by it
        labels = sorted(r[0] for r in df.where(F.col(label).isNotNull()).select(label).distinct().collect())
    specs = list(specs)
    blocks = materialise(_pack(df, vec, label, roles, labels), "blocks").persist()
    try:
        first = blocks.select(F.length("x").alias("a"), F.length("y").alias("b")).first()
        if first is None:
            raise ValueError("no rows to fit")
        d = first["a"] // 8 // (first["b"] // 4 // (len(roles) + 1))
        d = lift(np.zeros((1, d))).shape[1] if lift is not None else d
        size = len(labels) * (d + 1) * 8
        turn = max(1, STACK_BYTES // size)
        coef, value, steps = [], [], 0
        for lo in range(0, len(specs), turn):
            c, v, n = _solve(_Pass(blocks, len(roles), specs, lift), specs, np.arange(lo, min(lo + turn, len(specs))), len(labels), d, loss, max_iter, tol, standardise)
            coef.append(c)
            value.append(v)
            steps = max(steps, n)
    finally:
        blocks.unpersist()
    return Stack(specs, labels, np.concatenate(coef), loss, lift, steps, np.concatenate(value))


def _solve(run: _Pass, specs, models, k, d, loss, max_iter, tol, standardise):
    # statistics of each model's own train rows, about a common centre
    used = lambda w: (w > 0).astype(float)
    n, total, s = run.total(models, lambda x, y, w: [used(w).sum(0), w.sum(0), used(w).T @ x])
    mean = s / np.maximum(n, 1)[:, None]
    middle = mean.mean(0)
    (square,) = run.total(models, lambda x, y, w: [used(w).T @ (x - middle) ** 2])
    sd = np.sqrt(np.maximum(square / np.maximum(n, 1)[:, None] - (mean - middle) ** 2, 0.0))
    sd[sd < 1e-12] = 1.0
    if not standardise:
        mean, sd = np.zeros_like(mean), np.ones_like(sd)
    # the penalty is a share of the total weight
    c = np.array([specs[m].c for m in models])
    ridge = 1.0 / (c * np.maximum(total, 1e-300))

    def raw(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Coefficients for rows as they are from those for standardised rows."""
        out = np.empty_like(w)
        out[:, :, :-1] = w[:, :, :-1] / sd[at, None, :]
        out[:, :, -1] = w[:, :, -1] - np.einsum("mkd,md->mk", out[:, :, :-1], mean[at])
        return out

    def evaluate(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = raw(w, at)

        def work(x, y, weights):
            value, grad, sums = np.zeros(len(at)), np.zeros((len(at), k, d)), np.zeros((len(at), k))
            step = max(1, 4_000_000 // (len(at) * k))
            for lo in range(0, len(x), step):
                xs, ys, ws = x[lo:lo + step], y[lo:lo + step], weights[lo:lo + step]
                z = (xs @ r[:, :, :-1].reshape(-1, d).T).reshape(len(xs), len(at), k) + r[None, :, :, -1]
                v, g = _loss(loss, z, ys)
                value += (v * ws).sum(0)
                g *= ws[:, :, None]
                sums += g.sum(0)
                grad += (g.reshape(len(xs), -1).T @ xs).reshape(len(at), k, d)
            return [value, grad, sums]

        value, grad, sums = run.total(models[at], work)
        scale = 1.0 / np.maximum(total[at], 1e-300)
        g = np.empty_like(w)
        g[:, :, :-1] = (grad - sums[:, :, None] * mean[at, None, :]) / sd[at, None, :] * scale[:, None, None]
        g[:, :, :-1] += ridge[at, None, None] * w[:, :, :-1]
        g[:, :, -1] = sums * scale[:, None]
        return value * scale + 0.5 * ridge[at] * (w[:, :, :-1] ** 2).sum((1, 2)), g

    m = len(models)
    w = np.zeros((m, k, d + 1))
    value, grad = evaluate(w, np.arange(m))
    states = [_Path() for _ in range(m)]
    active = np.array([i for i in range(m) if total[i] > 0 and np.abs(grad[i]).max() > tol], np.int64)
    steps = 1
    while len(active) and steps < max_iter:
        trial = np.stack([w[i] + states[i].step(grad[i]) for i in active])
        v, g = evaluate(trial, active)
        steps += 1
        stay = []
        for j, i in enumerate(active.tolist()):
            took = states[i].judge(value[i], v[j], grad[i], g[j])
            if took:
                w[i], value[i], grad[i] = trial[j], v[j], g[j]
            if (took and np.abs(grad[i]).max() > tol) or (not took and states[i].size > 1e-10):
                stay.append(i)
        active = np.array(stay, np.int64)
    return raw(w, np.arange(m)), value, steps


class _Path:
    """L-BFGS history and step size of one model."""

    def __init__(self) -> None:
        self.pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
        self.size, self.direction = 1.0, None

    def step(self, grad: np.ndarray) -> np.ndarray:
        if self.direction is None:
            q = grad.copy()
            marks = []
            for s, y, rho in reversed(self.pairs):
                a = rho * float((s * q).sum())
                marks.append(a)
                q -= a * y
            if self.pairs:
                s, y, _ = self.pairs[-1]
                q *= float((s * y).sum()) / float((y * y).sum())
            else:
                q /= max(1.0, float(np.sqrt((grad * grad).sum())))
            for (s, y, rho), a in zip(self.pairs, reversed(marks)):
                q += (a - rho * float((y * q).sum())) * s
            self.direction, self.size = -q, 1.0
        return self.size * self.direction

    def judge(self, before: float, after: float, grad: np.ndarray, new: np.ndarray) -> bool:
        """Whether the step is taken; if not, the next one is shorter."""
        slope = float((grad * self.direction).sum())
        if slope >= 0:  # not downhill: forget the history
            self.pairs, self.direction = [], None
            self.size *= 0.5
            return False
        if not np.isfinite(after) or after > before + 1e-4 * self.size * slope + 1e-15 * abs(before):
            self.size *= 0.5
            return False
        s, y = self.size * self.direction, new - grad
        bend = float((s * y).sum())
        if bend > 1e-12 * float((y * y).sum()):
            self.pairs = [*self.pairs[-(MEMORY - 1):], (s, y, 1.0 / bend)]
        self.direction = None
        return True


# ------------------------------------------------------------------ whole runs


def fold_specs(folds: Sequence[int], penalties: Sequence[float] = (1.0,), role: int = 0) -> list[Spec]:
    """A model for each penalty and held-out fold."""
    return [Spec((c, f), role, {g: 1.0 for g in folds if g != f}, c) for c in penalties for f in folds]


def stacked_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", loss: str = "logistic", c: float = 1.0, max_iter: int = 2000, tol: float = 1e-5,
    lift: Callable[[np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``df`` with y_true and y_pred: every row by the model of the other folds, all folds fitted together."""
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())
    stack = fit_stack(df, vec, label, [fold], fold_specs(folds, (c,)), loss, max_iter, tol, lift)
    held = {m: [s.name[1]] for m, s in enumerate(stack.specs)}
    found = stack.predict(df, key, vec, [fold], held).select(key, PRED)
    return df.withColumn(TRUE, F.col(label)).join(found, key)


def balanced_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", loss: str = "logistic", c: float = 1.0, max_iter: int = 2000, tol: float = 1e-5,
) -> DataFrame:
    """:func:`stacked_oof` with balanced class weights: n / (classes x rows of the class), by each model's own train rows."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(fold).cast("int").alias("f"), F.col(label).alias("l")).count().collect()  # folds x classes
    folds, labels = sorted({r["f"] for r in sizes}), sorted({r["l"] for r in sizes})
    n = {(r["f"], r["l"]): r["count"] for r in sizes}
    specs = []
    for f in folds:
        rows = {lab: sum(n.get((g, lab), 0) for g in folds if g != f) for lab in labels}
        whole, k = sum(rows.values()), sum(x > 0 for x in rows.values())
        own = {lab: whole / (k * x) for lab, x in rows.items() if x}
        # the role of a row is its fold and class
        specs.append(Spec((c, f), 0, {g * len(labels) + i: own.get(lab, 0.0) for g in folds if g != f for i, lab in enumerate(labels)}, c))
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label)).cast("int") - 1
    rows = df.withColumn("_role", F.col(fold).cast("int") * len(labels) + F.coalesce(place, F.lit(0)))
    stack = fit_stack(rows, vec, label, ["_role"], specs, loss, max_iter, tol, labels=labels)
    held = {m: [s.name[1] * len(labels) + i for i in range(len(labels))] for m, s in enumerate(specs)}
    return df.withColumn(TRUE, F.col(label)).join(stack.predict(rows, key, vec, ["_role"], held).select(key, PRED), key)


def tuned_oof(
    df: DataFrame, key: str, vec: str, label: str, inner: Sequence[str], penalties: Sequence[float] = (0.1, 1.0, 10.0), n_folds: int = 3, fold: str = "fold",
    loss: str = "logistic", max_iter: int = 2000,
) -> DataFrame:
    """:func:`stacked_oof` with the penalty of each fold chosen by its inner folds; the first of equal ones.

    ``inner[f]`` is the inner-fold column for outer fold f, -1 in that fold. Two stacks: the search, then all penalties on all folds.
    """
    counts = penalty_search(df, key, vec, label, fold, inner, penalties, n_folds, loss, max_iter=max_iter)
    marks = scores(counts, ["outer", "c", "inner"]).groupBy("outer", "c").agg(F.avg("macro_f1").alias("m")).collect()  # folds x penalties
    best = {f: max(penalties, key=lambda c: (round({r["c"]: r["m"] for r in marks if r["outer"] == f}[c], 12), -penalties.index(c))) for f in {r["outer"] for r in marks}}
    folds = sorted(best)
    specs = [s for s in fold_specs(folds, penalties) if s.name[0] == best[s.name[1]]]
    stack = fit_stack(df, vec, label, [fold], specs, loss, max_iter)
    held = {m: [s.name[1]] for m, s in enumerate(specs)}
    return df.withColumn(TRUE, F.col(label)).join(stack.predict(df, key, vec, [fold], held).select(key, PRED), key)


def penalty_search(
    df: DataFrame, key: str, vec: str, label: str, outer: str, inner: Sequence[str], penalties: Sequence[float], n_folds: int, loss: str = "logistic",
    external: Sequence[float] = (1.0,), external_role: int = -2, max_iter: int = 2000, tol: float = 1e-4,
) -> DataFrame:
    """(outer, c, weight, inner, y_true, y_pred, n): held-out counts of every candidate, one stack of models.

    ``inner[o]`` is the column with the inner fold of each row when outer fold
    ``o`` is held out: -1 for rows of that fold, ``external_role`` for rows of
    other sources, which train with each weight of ``external`` and are never
    held out.
    """
    specs = [
        Spec((o, c, w, i), o, {**{g: 1.0 for g in range(n_folds) if g != i}, external_role: w}, c)
        for o in range(len(inner)) for c in penalties for w in external for i in range(n_folds)
    ]
    stack = fit_stack(df, vec, label, list(inner), specs, loss, max_iter, tol)
    held = {m: [s.name[3]] for m, s in enumerate(specs)}
    found = stack.predict(df, key, vec, list(inner), held).join(df.select(key, F.col(label).alias(TRUE)), key)
    counts = found.groupBy("model", TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(m, *s.name) for m, s in enumerate(specs)], "model int, outer int, c double, weight double, inner int")
    return counts.join(F.broadcast(names), "model").drop("model")


def rbf_oof(
    df: DataFrame, key: str, vec: str, label: str, fold: str = "fold", c: float = 1.0, gamma: float | str = "scale", width: int = 256, seed: int = SEED,
    max_iter: int = 2000, tol: float = 1e-4,
) -> DataFrame:
    """Squared-hinge machines over random cosine features of each fold's standardised rows.

    The features depend on the fold's scaler, so each fold is a fit of its own.
    """
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())
    dim = df.agg(F.max(F.size(vec))).first()[0] or 1
    rate = 1.0 / dim if gamma == "scale" else float(gamma)
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0.0, np.sqrt(2 * rate), (dim, width)), rng.uniform(0.0, 2 * np.pi, width)
    out = None
    for f in folds:
        rows = apply_scaler(df, fit_scaler(df.where(F.col(fold) != f), vec), vec)
        stack = fit_stack(
            rows, vec, label, [fold], [Spec((c, f), 0, {g: 1.0 for g in folds if g != f}, c)], "squared_hinge", max_iter, tol,
            lambda x: np.sqrt(2.0 / width) * np.cos(x @ w + b), standardise=False,
        )
        part = stack.predict(rows.where(F.col(fold) == f), key, vec, [fold], {0: [f]}).select(key, PRED)
        out = part if out is None else out.unionByName(part)
    return df.withColumn(TRUE, F.col(label)).join(out, key)


def two_stage_oof(
    df: DataFrame, key: str, vec: str, label: str, high: Sequence, fold: str = "fold", loss: str = "logistic", c: float = 1.0, max_iter: int = 2000,
) -> DataFrame:
    """``df`` with y_true, gate and y_pred: a gate on the superclass, then the specialist of the branch it chose.

    Three stacks fit all folds: the gate, and a specialist on the rows of either branch.
    """
    folds = sorted(r[0] for r in df.select(F.col(fold).cast("int")).distinct().collect())
    band = F.when(F.col(label).isin(list(high)), "high").otherwise("low")
    rows = df.withColumn("_band", band)
    gate = stacked_oof(rows.select(key, vec, fold, "_band"), key, vec, "_band", fold, loss, c, max_iter).select(key, F.col(PRED).alias("gate"))
    routed = materialise(rows.join(gate, key), "gate")
    out = None
    for name in ("high", "low"):
        own = routed.where(F.col("_band") == name)
        if own.limit(1).count():
            stack = fit_stack(own, vec, label, [fold], fold_specs(folds, (c,)), loss, max_iter)
            held = {m: [s.name[1]] for m, s in enumerate(stack.specs)}
            part = stack.predict(routed.where(F.col("gate") == name), key, vec, [fold], held).select(key, PRED)
            out = part if out is None else out.unionByName(part)
    return routed.drop("_band").withColumn(TRUE, F.col(label)).join(out, key)
