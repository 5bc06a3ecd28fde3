"""Axes of wide vectors: principal and discriminant projections without a d x d matrix.

A scatter matrix of 9,984 columns is 800 MB. Everything here needs it only as
a product with a few vectors, ``A' (A Q)``, which one pass over the rows gives:
a task multiplies its batches with Q and returns blocks of 64 columns, Spark
adds the blocks of all tasks by key, and d x k numbers reach the driver.

All folds go through one pass: each has its own columns of Q, and a row leaves
out the columns of its own fold. Means and standard deviations of every train
side come from the moments of the folds, so rows are centred and scaled inside
the products.

Principal axes: a random start block is widened by products (block Krylov with
full orthogonalisation) until the residuals of the wanted axes are small; a
last pass factors the projected rows by QR, the triangular factors being merged
in a tree, so variances are not read off squared numbers. Discriminant axes:
the within-class scatter is inverted on the class means only, by conjugate
gradients of one product a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..vocab import SEED
from .vectors import moments

#: Columns of the vectors whose products travel together.
BLOCK = 64
#: Bytes of Q sent with a pass; more folds are done in turns.
STACK_BYTES = 64 << 20
#: Triangular factors merged by one task.
FAN_IN = 64


@dataclass
class Axes:
    """A projection fitted for one fold: (x - mean) @ axes."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    ratio: np.ndarray
    residual: float
    passes: int


@dataclass
class _Side:
    """The train side of a fold."""

    n: int
    mean: np.ndarray
    m2: np.ndarray
    scale: np.ndarray


def _merge(parts) -> tuple[int, np.ndarray, np.ndarray]:
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    m2 = sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts)
    return n, mean, m2


def _sides(df: DataFrame, vec: str, fold: str | None, standardise: bool) -> dict:
    """Train sides by fold (the only one is None without folds)."""
    by = fold or "_all"
    rows = moments(df if fold else df.withColumn(by, F.lit(0)), by, vec).collect()  # one row a fold
    parts = {(r[fold] if fold else None): (r["n"], np.asarray(r["mean"]), np.asarray(r["m2"])) for r in rows}
    if len(parts) < (2 if fold else 1):
        raise ValueError("no rows to fit axes on")
    out = {}
    for f in sorted(parts, key=lambda f: (f is None, f)):
        n, mean, m2 = _merge([p for g, p in parts.items() if g != f or not fold])
        sd = np.sqrt(m2 / n)
        out[f] = _Side(n, mean, m2, np.where(sd > 0, sd, 1.0) if standardise else np.ones(len(mean)))
    return out


def _turns(q: dict) -> list[list]:
    """Folds whose stacked columns fit into :data:`STACK_BYTES`."""
    turns, used = [], 0
    for f, block in q.items():
        if not turns or used + block.nbytes > STACK_BYTES:
            turns.append([])
            used = 0
        turns[-1].append(f)
        used += block.nbytes
    return turns


def _matrix(pdf: pd.DataFrame, vec: str, width: int) -> np.ndarray:
    return np.stack(pdf[vec].to_numpy()).astype("float64") if len(pdf) else np.zeros((0, width))


def _gram_of(vec: str, fold: str | None, q: dict, shift: np.ndarray):
    """One task's share of the products, a row (block, flat) for every 64 columns."""
    stack = np.hstack(list(q.values()))
    edges = np.cumsum([0, *[block.shape[1] for block in q.values()]])

    def run(batches):
        total = np.zeros(stack.shape)
        for pdf in batches:
            x = _matrix(pdf, vec, len(shift)) - shift
            z = x @ stack
            if fold:
                own = pdf[fold].to_numpy()
                for i, f in enumerate(q):
                    z[own == f, edges[i] : edges[i + 1]] = 0.0
            total += x.T @ z
        starts = range(0, len(shift), BLOCK)
        yield pd.DataFrame({"block": list(starts), "flat": [total[s : s + BLOCK].ravel() for s in starts]})

    return run


def gram_products(df: DataFrame, vec: str, fold: str | None, q: dict, shift: np.ndarray) -> dict:
    """By fold, the sum of (x - shift) (x - shift)' q over the rows outside the fold."""
    out = {}
    rows = df.select(vec, *([fold] if fold else []))
    for turn in _turns(q):
        widths = [q[f].shape[1] for f in turn]
        parts = rows.mapInPandas(_gram_of(vec, fold, {f: q[f] for f in turn}, shift), "block int, flat array<double>")
        sums = parts.groupBy("block").agg(
            vector_to_array(Summarizer.metrics("sum").summary(array_to_vector("flat"))["sum"]).alias("flat")
        )
        total = np.zeros((len(shift), sum(widths)))
        for r in sums.collect():  # d x k numbers
            block = np.asarray(r["flat"]).reshape(-1, total.shape[1])
            total[r["block"] : r["block"] + len(block)] = block
        out |= dict(zip(turn, np.hsplit(total, np.cumsum(widths)[:-1])))
    return out


def _triangle(rows: np.ndarray, k: int) -> np.ndarray:
    """The k x k triangular factor of ``rows``."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((k - len(r), k))]) if len(r) < k else r


def _triangles_of(vec: str, fold: str | None, mean: dict, q: dict):
    """One task's factors, a row (at, flat) for each fold in the order of ``q``."""

    def run(batches):
        held = {f: np.zeros((0, block.shape[1])) for f, block in q.items()}
        for pdf in batches:
            x = _matrix(pdf, vec, len(next(iter(q.values()))))
            own = pdf[fold].to_numpy() if fold else None
            for f, block in q.items():
                y = (x if own is None else x[own != f]) @ block - mean[f] @ block
                held[f] = _triangle(np.vstack([held[f], y]), block.shape[1])
        yield pd.DataFrame(
            {"at": range(len(q)), "flat": [_triangle(r, r.shape[1]).ravel() for r in held.values()]}
        )

    return run


def _merged_triangle(pdf: pd.DataFrame) -> pd.DataFrame:
    """The factor of all rows behind the (square) factors of a group."""
    k = int(np.sqrt(len(pdf["flat"].iloc[0])))
    stack = np.vstack([np.asarray(r).reshape(k, k) for r in pdf["flat"]])
    return pdf[["at", "part"]].iloc[:1].assign(flat=[_triangle(stack, k).ravel()])


def projected_triangles(df: DataFrame, vec: str, fold: str | None, mean: dict, q: dict) -> dict:
    """By fold, the triangular factor of (x - mean) q over the rows outside it."""
    out = {}
    rows = df.select(vec, *([fold] if fold else []))
    for turn in _turns(q):
        parts = rows.mapInPandas(_triangles_of(vec, fold, mean, {f: q[f] for f in turn}), "at int, flat array<double>")
        parts = parts.select("at", F.spark_partition_id().alias("part"), "flat")
        for _ in range(2):  # 4,096 tasks become one row; what is left is merged here
            parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
            parts = parts.groupBy("at", "part").applyInPandas(_merged_triangle, "at int, part int, flat array<double>")
        for r in parts.toLocalIterator():
            f = turn[r["at"]]
            k = q[f].shape[1]
            flat = np.asarray(r["flat"]).reshape(k, k)
            out[f] = _triangle(np.vstack([out[f], flat]), k) if f in out else flat
    return out


def _new_directions(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What ``block`` adds to an orthonormal basis, orthonormal."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    if not block.size:
        return block
    left, size, _ = np.linalg.svd(block, full_matrices=False)
    fresh = left[:, size > 1e-8]
    fresh = fresh - basis @ (basis.T @ fresh)
    return np.linalg.qr(fresh)[0] if fresh.size else fresh


def _signed(axes: np.ndarray) -> np.ndarray:
    """The largest component of each axis is positive."""
    if not axes.size:
        return axes
    sign = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return axes * np.where(sign == 0, 1, sign)


def fit_pca(
    df: DataFrame, vec: str, k: int, fold: str | None = None, standardise: bool = False,
    oversample: int = 8, tol: float = 1e-6, max_passes: int = 30, seed: int = SEED,
) -> dict:
    """:class:`Axes` of the first ``k`` principal components, by fold.

    A fold's axes come from the rows outside it; without ``fold`` the one key
    is None. Products go on until the largest residual of the wanted axes is
    ``tol`` of the first variance, or ``max_passes``; both are reported. There
    are fewer than ``k`` axes only where the rows span fewer. Null vectors
    take no part; no rows at all are an error.
    """
    df = df.where(F.col(vec).isNotNull())
    sides = _sides(df, vec, fold, standardise)
    d = len(next(iter(sides.values())).mean)
    shift = sum(s.n * s.mean for s in sides.values()) / sum(s.n for s in sides.values())
    rng = np.random.default_rng(seed)
    start = np.linalg.qr(rng.standard_normal((d, min(d, k + oversample))))[0]
    basis = {f: np.zeros((d, 0)) for f in sides}
    image = {f: np.zeros((d, 0)) for f in sides}
    fresh = {f: start for f in sides}
    ritz, passes = {}, dict.fromkeys(sides, 0)
    while fresh:
        scaled = {f: q / sides[f].scale[:, None] for f, q in fresh.items()}
        products = gram_products(df, vec, fold, scaled, shift)
        going = {}
        for f, q in fresh.items():
            s = sides[f]
            off = s.mean - shift
            g = (products[f] - s.n * np.outer(off, off @ scaled[f])) / s.scale[:, None] / max(s.n - 1, 1)
            basis[f], image[f] = np.hstack([basis[f], q]), np.hstack([image[f], g])
            small = basis[f].T @ image[f]
            values, turn = np.linalg.eigh((small + small.T) / 2)
            values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
            left = np.linalg.norm(image[f] @ turn - basis[f] @ turn * values, axis=0)
            top = max(values[0], np.finfo(float).tiny)
            passes[f] += 1
            ritz[f] = (basis[f] @ turn, float(left.max() / top))
            # the images of the newest block hold the only directions not yet tried
            more = _new_directions(g, basis[f])
            if ritz[f][1] > tol and passes[f] < max_passes and more.shape[1]:
                going[f] = more
        fresh = going
    factors = projected_triangles(
        df, vec, fold, {f: s.mean for f, s in sides.items()},
        {f: ritz[f][0] / sides[f].scale[:, None] for f in sides},
    )
    out = {}
    for f, s in sides.items():
        _, size, turn = np.linalg.svd(factors[f])
        values = size**2 / max(s.n - 1, 1)
        total = (s.m2 / s.scale**2).sum() / max(s.n - 1, 1)
        axes = _signed(ritz[f][0] @ turn.T) / s.scale[:, None]
        if not total > 0:  # rows that are all alike: what a rotation leaves is rounding
            values = np.zeros(len(values))
        ratio = values / total if total > 0 else np.zeros(len(values))
        out[f] = Axes(s.n, s.mean, axes, values, ratio, ritz[f][1], passes[f])
    return out


def fit_lda(
    df: DataFrame, vec: str, label: str, fold: str | None = None, standardise: bool = False,
    ridge: float = 1e-3, tol: float = 1e-8, max_passes: int = 200,
) -> dict:
    """:class:`Axes` of the discriminant projection (n_classes - 1 axes), by fold.

    The axes are within^-1 times combinations of the class means, where
    ``within`` has ``ridge`` times its mean diagonal added; ``values`` are the
    between-class scatters of axes with unit within-class scatter. Class means
    (classes x d a fold) reach the driver; rows without a label or a vector
    take no part.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(vec).isNotNull())
    sides = _sides(rows, vec, fold, standardise)
    by = [label, *([fold] if fold else [])]
    parts = [(r[label], r[fold] if fold else None, r["n"], np.asarray(r["mean"])) for r in moments(rows, by, vec).collect()]
    shift = sum(s.n * s.mean for s in sides.values()) / sum(s.n for s in sides.values())
    classes, target, extra, solved = {}, {}, {}, {}
    for f, s in sides.items():
        seen = [p for p in parts if not fold or p[1] != f]
        groups = [(n := sum(p[2] for p in seen if p[0] == c), sum(p[2] * p[3] for p in seen if p[0] == c) / n)
                  for c in sorted({p[0] for p in seen})]
        size = np.array([g[0] for g in groups], float)
        means = np.stack([g[1] for g in groups], 1)
        classes[f] = (size, means)
        target[f] = (means - s.mean[:, None]) / s.scale[:, None] * np.sqrt(size)
        trace = (s.m2 / s.scale**2).sum() - (target[f] ** 2).sum()
        extra[f] = max(ridge * trace / len(shift), np.finfo(float).tiny)

    def within(q: dict) -> dict:
        scaled = {f: v / sides[f].scale[:, None] for f, v in q.items()}
        products = gram_products(rows, vec, fold, scaled, shift)
        out = {}
        for f, v in q.items():
            size, means = classes[f]
            off = means - shift[:, None]
            inner = products[f] - (off * size) @ (off.T @ scaled[f])
            out[f] = inner / sides[f].scale[:, None] + extra[f] * v
        return out

    # conjugate gradients, a column each, all folds and classes in one pass
    x = {f: np.zeros_like(b) for f, b in target.items()}
    r = {f: b.copy() for f, b in target.items()}
    p = {f: b.copy() for f, b in target.items()}
    limit = {f: tol * max(np.linalg.norm(b), np.finfo(float).tiny) for f, b in target.items()}
    live = {f for f in sides if np.linalg.norm(r[f]) > limit[f]}
    passes = dict.fromkeys(sides, 0)
    while live:
        images = within({f: p[f] for f in sorted(live)})
        for f in sorted(live):
            before = (r[f] ** 2).sum(0)
            bend = (p[f] * images[f]).sum(0)
            step = np.divide(before, bend, out=np.zeros_like(before), where=bend > 0)
            x[f] += step * p[f]
            r[f] -= step * images[f]
            after = (r[f] ** 2).sum(0)
            p[f] = r[f] + np.divide(after, before, out=np.zeros_like(after), where=before > 0) * p[f]
            passes[f] += 1
            if np.linalg.norm(r[f]) <= limit[f] or passes[f] >= max_passes:
                live.discard(f)
    out = {}
    for f, s in sides.items():
        small = target[f].T @ x[f]
        values, turn = np.linalg.eigh((small + small.T) / 2)
        keep = np.argsort(values)[::-1][: len(values) - 1]
        keep = keep[values[keep] > 1e-12 * max(values.max(), np.finfo(float).tiny)]
        axes = x[f] @ turn[:, keep] / np.sqrt(values[keep])
        share = values[keep] / values[keep].sum() if len(keep) else values[keep]
        gap = float(np.linalg.norm(r[f]) / max(np.linalg.norm(target[f]), np.finfo(float).tiny))
        out[f] = Axes(s.n, s.mean, _signed(axes) / s.scale[:, None], values[keep], share, gap, passes[f])
    return out


def project(df: DataFrame, vec: str, fitted: dict, out: str, fold: str | None = None) -> DataFrame:
    """Each row on the axes of its fold; null where the fold has none or the vector is null."""
    ready = {f: (a.axes, a.mean @ a.axes) for f, a in fitted.items()}

    def of(vectors: pd.Series, own) -> pd.Series:
        result = [None] * len(vectors)
        for f, (axes, origin) in ready.items():
            mine = np.ones(len(vectors), bool) if own is None else own.to_numpy() == f
            at = np.flatnonzero(mine & vectors.notna().to_numpy())
            if len(at):
                y = np.stack(vectors.iloc[at].to_numpy()).astype("float64") @ axes - origin
                for i, row in zip(at, y):
                    result[i] = row
        return pd.Series(result)

    @F.pandas_udf("array<double>")
    def single(vectors: pd.Series) -> pd.Series:
        return of(vectors, None)

    @F.pandas_udf("array<double>")
    def by_fold(vectors: pd.Series, own: pd.Series) -> pd.Series:
        return of(vectors, own)

    return df.withColumn(out, by_fold(F.col(vec), F.col(fold)) if fold else single(F.col(vec)))
