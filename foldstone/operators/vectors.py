"""Normalisation and selection of vector columns (ARRAY<DOUBLE>)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from ..functions.hashing import normal
from ..session import settle
from ..vocab import GROUP_EPS, NORMALISATIONS, POOLINGS
from .ranking import _cols, attach, vocabulary

EPS = float(np.finfo(float).eps)


def moments(df: DataFrame, by, vec: str, extremes: bool = False) -> DataFrame:
    """n, mean, m2 (and min, max) arrays per group.

    One mergeable buffer of the vector's length per group: partial sums are
    built on the map side and no row is multiplied by the dimension.
    """
    by = _cols(by)
    names = ["count", "mean", "variance"] + (["min", "max"] if extremes else [])
    table = df.groupBy(*by).agg(
        Summarizer.metrics(*names).summary(array_to_vector(F.col(vec))).alias("_s")
    )
    n = F.col("_s.count")
    return table.select(
        *by,
        n.alias("n"),
        vector_to_array(F.col("_s.mean")).alias("mean"),
        A.scaled(vector_to_array(F.col("_s.variance")), (n - 1).cast("double")).alias("m2"),
        *[vector_to_array(F.col(f"_s.{c}")).alias(c) for c in names[3:]],
    )


def population_sd(n: Column, m2: Column) -> Column:
    return F.transform(m2, lambda v: F.sqrt(v / n))


def leave_out_moments(parts: DataFrame, fold: str, by=()) -> DataFrame:
    """Moments of the rows outside each fold, from the moments of the folds.

    With per-fold parts at hand, the train side of every fold is a merge of
    the other parts, so the data is read once instead of once per fold.
    """
    by = _cols(by)
    folds = vocabulary(parts, fold)
    spread = parts.withColumn("_out", F.explode(F.array(*[F.lit(f) for f in folds]))).where(
        F.col("_out") != F.col(fold)
    )
    # at most one entry per fold: a bounded list
    return merge_moments(spread.withColumn(fold, F.col("_out")), [fold, *by])


def merge_moments(parts: DataFrame, by) -> DataFrame:
    """(by, n, mean, m2) of all rows of ``by``, from the moments of its parts, which must be few."""
    by = _cols(by)
    listed = parts.groupBy(*by).agg(F.collect_list(F.struct("n", "mean", "m2")).alias("_parts"))
    zero = F.transform(F.col("_parts")[0]["mean"], lambda _: F.lit(0.0))
    n = F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
    sums = F.aggregate("_parts", zero, lambda a, p: F.zip_with(a, p["mean"], lambda x, m: x + m * p["n"]))
    centred = listed.withColumn("_n", n).withColumn("_mean", F.transform(sums, lambda s: s / F.col("_n")))
    m2 = F.aggregate(
        "_parts",
        F.transform(F.col("_mean"), lambda _: F.lit(0.0)),
        lambda a, p: A.plus(
            a,
            F.zip_with(
                p["m2"],
                F.zip_with(p["mean"], F.col("_mean"), lambda m, g: (m - g) * (m - g)),
                lambda v, d: v + d * p["n"],
            ),
        ),
    )
    return centred.select(*by, F.col("_n").alias("n"), F.col("_mean").alias("mean"), m2.alias("m2"))


def fit_scaler(train: DataFrame, vec: str | None, mode: str = "global", by=()) -> DataFrame | None:
    """(by, mean, scale) from train rows, one row in all or per ``by``; population sd, constant dims scale 1.

    Without ``vec``, ``train`` holds the moments of parts of the train rows.
    """
    if mode not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {mode!r}")
    if mode == "none":
        return None
    if mode == "per_speaker":
        raise ValueError("per-group normalisation needs groups: use per_group_normalise")
    by = _cols(by)
    table = merge_moments(train, by) if vec is None else moments(train, by, vec)
    n = F.col("n")
    # merged parts of a constant leave a rest of rounding, which is no spread
    rest = F.transform("mean", lambda m: F.abs(m) * n * EPS) if vec is None else F.transform("mean", lambda _: F.lit(0.0))
    scale = F.zip_with(population_sd(n, F.col("m2")), rest, lambda s, r: F.when(s > r, s).otherwise(1.0))
    return table.select(*by, "mean", scale.alias("scale"))


def apply_scaler(df: DataFrame, scaler: DataFrame | None, vec: str) -> DataFrame:
    if scaler is None:
        return df
    one = scaler.select(F.col("mean").alias("_m"), F.col("scale").alias("_s"))
    # one row: the bound of this broadcast is the vector length
    return (
        df.crossJoin(F.broadcast(one))
        .withColumn(vec, A.over(A.minus(F.col(vec), F.col("_m")), F.col("_s")))
        .drop("_m", "_s")
    )


def per_group_normalise(df: DataFrame, vec: str, group, eps: float = GROUP_EPS) -> DataFrame:
    """z-score inside each group, label-free.

    Transductive: a held-out group is normalised by its own rows.
    """
    by = _cols(group)
    table = moments(df, by, vec)
    stats = table.select(
        *by,
        F.col("mean").alias("_m"),
        F.transform(population_sd(F.col("n"), F.col("m2")), lambda s: s + F.lit(eps)).alias("_s"),
    )
    return (
        attach(df, settle(stats), by, "inner")
        .withColumn(vec, A.over(A.minus(F.col(vec), F.col("_m")), F.col("_s")))
        .drop("_m", "_s")
    )


def group_zscore(df: DataFrame, value: str, group, out: str, eps: float = GROUP_EPS) -> DataFrame:
    """The scalar form of :func:`per_group_normalise`, also used on frame rows."""
    by = _cols(group)
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return (
        attach(df, settle(stats), by, "inner")
        .withColumn(out, (F.col(value) - F.col("_m")) / (F.col("_s") + F.lit(eps)))
        .drop("_m", "_s")
    )


def peak_normalise(vec: Column) -> Column:
    """Divide by the largest magnitude where there is one."""
    peak = F.array_max(F.transform(vec, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(vec, lambda x: x / peak)).otherwise(vec)


def truncate(vec: Column, seconds: float | None, rate: int) -> Column:
    return vec if seconds is None else F.slice(vec, 1, int(seconds * rate))


def feature_columns(columns: Sequence[str], meta: Sequence[str]) -> list[str]:
    """Everything that is not metadata, in table order."""
    known = set(meta)
    return [c for c in columns if c not in known]


def assemble(df: DataFrame, meta: Sequence[str], out: str = "features") -> DataFrame:
    names = feature_columns(df.columns, meta)
    return df.select(*meta, F.array(*[F.col(c).cast("double") for c in names]).alias(out))


def named_elements(df: DataFrame, vec: str, prefix: str, keep: Sequence[str]) -> DataFrame:
    """(keep, name, value) with names such as ``emb_mean_000``."""
    return df.select(*keep, F.posexplode(vec).alias("_p", "value")).select(
        *keep, F.format_string(f"{prefix}_%03d", F.col("_p")).alias("name"), "value"
    )


def encode_frames(df: DataFrame, encoder, series: str, signal: str, rate: str, expected_rate: int) -> DataFrame:
    """(series, layer, frame_idx, vec): a user encoder over Arrow batches.

    ``encoder(list of signals)`` yields, per signal, an array (layers, frames,
    dim). Nothing is padded, so nothing needs a mask.
    """
    kind = df.schema[series].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if len(pdf) and (pdf[rate] != expected_rate).any():
                raise ValueError(f"encoder expects {expected_rate} Hz")
            encoded = encoder([np.asarray(s, dtype="float64") for s in pdf[signal]])
            for name, block in zip(pdf[series], encoded):
                layers, frames, dim = block.shape
                yield pd.DataFrame(
                    {
                        series: np.repeat(name, layers * frames),
                        "layer": np.repeat(np.arange(layers), frames),
                        "frame_idx": np.tile(np.arange(frames), layers),
                        "vec": list(block.reshape(-1, dim)),
                    }
                )

    return df.select(series, signal, rate).mapInPandas(
        run, f"{series} {kind}, layer int, frame_idx int, vec array<double>"
    )


def encode_batches(
    df: DataFrame, make_encoder, series: str, signal: str, length: int, shape: tuple[int, int, int], batch_size: int = 8
) -> DataFrame:
    """(series, layer, frame_idx, vec) of signals of one length, through Spark's batch inference.

    ``make_encoder()`` loads a model, once for each Python worker and not for
    each batch, and returns a function from a (batch, length) array to a
    (batch, layers, frames, dim) one of the given ``shape``. Signals of several
    lengths go through :func:`encode_frames`.
    """
    layers, frames, dim = shape

    def load():
        encoder = make_encoder()
        return lambda x: np.asarray(encoder(x), dtype="float64").reshape(len(x), -1)

    predict = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[length]])
    flat = df.where(F.size(signal) == length).select(series, predict(signal).alias("_flat"))
    places = F.sequence(F.lit(0), F.lit(layers * frames - 1))
    cells = F.transform(places, lambda i: F.struct(
        (i / frames).cast("int").alias("layer"), (i % frames).alias("frame_idx"), F.slice("_flat", i * dim + 1, F.lit(dim)).alias("vec")
    ))
    return flat.select(series, F.inline(cells))


def pool_frames(frames: DataFrame, series: str) -> DataFrame:
    """(series, layer, stat, vec): mean and population sd over real frames."""
    table = moments(frames, [series, "layer"], "vec")
    sd = F.transform(
        population_sd(F.col("n"), F.transform("m2", lambda v: F.greatest(v, F.lit(0.0)))), lambda s: s
    )
    entries = F.array(
        F.struct(F.lit("mean").alias("stat"), F.col("mean").alias("vec")),
        F.struct(F.lit("std").alias("stat"), sd.alias("vec")),
    )
    return table.select(series, "layer", F.explode(entries).alias("e")).select(
        series, "layer", "e.stat", "e.vec"
    )


def real_frames(frames: DataFrame, length: str) -> DataFrame:
    """Padding contributes nothing: rows at or past the true length go."""
    return frames.where(F.col("frame_idx") < F.col(length))


def cap_frames(frames: DataFrame, series: str, max_frames: int) -> tuple[DataFrame, DataFrame]:
    """Frames below the limit, and (n_series, n_truncated) so the loss is seen."""
    lengths = frames.groupBy(series).agg((F.max("frame_idx") + 1).alias("_len"))
    report = lengths.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.count_if(F.col("_len") > max_frames).alias("n_truncated"),
        F.max("_len").alias("longest"),
    )
    return frames.where(F.col("frame_idx") < max_frames), report


def resolve_layer(layer: int | str, n_layers: int) -> int:
    index = n_layers - 1 if layer == "last" else int(layer)
    if not -n_layers <= index < n_layers:
        raise ValueError(f"layer {layer} is out of range for {n_layers} layers")
    return index % n_layers


def select_layer(
    tensor: DataFrame,
    key: str,
    layer: int | str,
    pooling: str,
    n_layers: int,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """(key, vec) from the long tensor (key, layer, stat, vec).

    The layer test is a partition filter when the tensor is stored by layer.
    """
    if pooling not in POOLINGS:
        raise ValueError(f"pooling must be one of {POOLINGS}")
    stats = ["mean", "std"] if pooling == "mean_std" else [pooling]
    rows = tensor.where(F.col("stat").isin(stats))
    if layer == "weighted":
        if weights is None or len(weights) != n_layers:
            raise ValueError(f"weighted layers need exactly {n_layers} weights")
        rows = weighted_layers(rows, [key, "stat"], weights)
    else:
        rows = rows.where(F.col("layer") == resolve_layer(layer, n_layers))
    if len(stats) == 1:
        return rows.select(key, "vec")
    # two rows per key, so grouping them is bounded
    by_stat = rows.groupBy(key).agg(*[F.first(F.when(F.col("stat") == s, F.col("vec")), True).alias(s) for s in stats])
    return by_stat.select(key, F.concat(*stats).alias("vec"))


def weighted_layers(tensor: DataFrame, by, weights: Sequence[float]) -> DataFrame:
    """Sum of w_l * vec_l per key: exact for means, approximate for sds."""
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.col("layer"))
    weighted = tensor.withColumn("vec", A.scaled(F.col("vec"), w))
    table = weighted.groupBy(*_cols(by)).agg(
        Summarizer.metrics("sum").summary(array_to_vector(F.col("vec"))).alias("_s")
    )
    return table.select(*_cols(by), vector_to_array(F.col("_s.sum")).alias("vec"))


def concat_layers(tensor: DataFrame, key: str, layers: Sequence[int], stat: str = "mean") -> DataFrame:
    """Chosen layers side by side, in the order given."""
    rows = tensor.where((F.col("stat") == stat) & F.col("layer").isin(list(layers)))
    pick = [F.first(F.when(F.col("layer") == l, F.col("vec")), True).alias(f"_l{l}") for l in layers]
    return rows.groupBy(key).agg(*pick).select(key, F.concat(*[f"_l{l}" for l in layers]).alias("vec"))


def fuse(a: DataFrame, b: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """1:1 join of two feature blocks, concatenated."""
    other = b.select(key, F.col(vec).alias("_b"))
    return a.join(other, key).withColumn(vec, F.concat(vec, "_b")).drop("_b")


def add_feature_noise(df: DataFrame, vec: str, key: str, sigma: float, seed: str) -> DataFrame:
    """x + N(0, sigma) * population sd of the dimension over these rows."""
    stats = moments(df, [], vec).select(population_sd(F.col("n"), F.col("m2")).alias("_sd"))
    noise = F.transform("_sd", lambda s, i: s * sigma * normal(seed, F.col(key), i))
    return (
        df.crossJoin(F.broadcast(stats))  # one row
        .withColumn(vec, A.plus(F.col(vec), noise))
        .drop("_sd")
    )


def scatter(df: DataFrame, by, vec: str) -> DataFrame:
    """n, sum and sum of outer products (row-major d*d array) per group."""
    by = _cols(by)
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)
    head = f"{kinds}, " if by else ""

    def partial(batches):
        for pdf in batches:
            pieces = pdf.groupby(by, sort=False) if by else [((), pdf)]
            for name, part in pieces:
                x = np.stack(part[vec].to_numpy()).astype("float64")
                row = dict(zip(by, name if isinstance(name, tuple) else (name,)))
                yield pd.DataFrame(
                    [{**row, "n": len(x), "flat": np.concatenate([x.sum(0), (x.T @ x).ravel()])}]
                )

    parts = df.select(*by, vec).mapInPandas(partial, f"{head}n bigint, flat array<double>")
    return parts.groupBy(*by).agg(
        F.sum("n").alias("n"),
        vector_to_array(
            Summarizer.metrics("sum").summary(array_to_vector(F.col("flat"))).getField("sum")
        ).alias("flat"),
    )


def _unpack(row):
    flat = np.asarray(row["flat"])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2)
    return row["n"], flat[:d], flat[d:].reshape(d, d)


def project(df: DataFrame, vec: str, mean, axes, out: str) -> DataFrame:
    """Dot products of the centred vector with each axis (columns of ``axes``)."""
    @F.pandas_udf("array<double>")
    def apply(s: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(s.to_numpy()) - mean) @ axes))

    return df.withColumn(out, apply(F.col(vec)))


def fit_pca(df: DataFrame, vec: str, k: int):
    """(mean, axes, explained ratio) from a distributed scatter matrix.

    Only the d x d matrix reaches the driver.
    """
    n, total, outer = _unpack(scatter(df, [], vec).first())
    mean = total / n
    cov = (outer - n * np.outer(mean, mean)) / (n - 1)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    signs = np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    return mean, axes[:, order] * signs, values[order] / values.sum()


def fit_lda(df: DataFrame, vec: str, label: str, ridge: float = 1e-6):
    """(mean, axes) of the supervised projection with n_classes - 1 axes."""
    # total scatter and class means say it all: one d x d matrix and k x d numbers
    n, total, outer = _unpack(scatter(df, [], vec).first())
    classes = moments(df, label, vec).select("n", "mean").collect()
    mean = total / n
    d = len(mean)
    between = sum(r["n"] * np.outer(np.subtract(r["mean"], mean), np.subtract(r["mean"], mean)) for r in classes)
    within = outer - n * np.outer(mean, mean) - between
    within += ridge * np.trace(within) / d * np.eye(d)
    root = np.linalg.inv(np.linalg.cholesky(within))
    values, axes = np.linalg.eigh(root @ between @ root.T)
    order = np.argsort(values)[::-1][: len(classes) - 1]
    return mean, (root.T @ axes)[:, order]
