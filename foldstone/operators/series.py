"""Frame tables: (series, frame_idx, value or vec), ragged, one row per frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import FeatureSettings
from ..session import settle
from ..vocab import PERCENTILES
from .ranking import _cols, attach, exact_quantiles, ordered_rank
from .vectors import moments, population_sd

#: Frames per piece of a series when neighbours have to be seen.
PIECE = 65_536


def frame_index(df: DataFrame, series, order: Sequence[str]) -> DataFrame:
    """``df`` + zero-based ``frame_idx`` along ``order`` inside each series."""
    return ordered_rank(df, series, order, "_r").withColumn("frame_idx", F.col("_r") - 1).drop("_r")


def trim_bounds(frames: DataFrame, series, power: str, top_db: float) -> DataFrame:
    """(series, first, last, n_frames): frames within ``top_db`` dB of the peak."""
    by = _cols(series)
    peaks = frames.groupBy(*by).agg(
        F.max(power).alias("_peak"), F.count(F.lit(1)).alias("n_frames")
    )
    loud = F.col(power) >= F.col("_peak") * F.lit(10.0 ** (-top_db / 10.0))
    active = F.when(loud & (F.col("_peak") > 0), F.col("frame_idx"))
    return (
        attach(frames, settle(peaks), by, "inner")
        .groupBy(*by)
        .agg(F.min(active).alias("first"), F.max(active).alias("last"), F.max("n_frames").alias("n_frames"))
    )


def trim(frames: DataFrame, series, power: str, top_db: float) -> DataFrame:
    """Only the frames between the first and last active one, both included."""
    by = _cols(series)
    bounds = trim_bounds(frames, by, power, top_db).drop("n_frames")
    return (
        attach(frames, bounds, by, "inner")
        .where(F.col("frame_idx").between(F.col("first"), F.col("last")))
        .drop("first", "last")
    )


def resolve_width(width: int, n_frames: int) -> int:
    """An odd width of at least 3 that fits into the series where possible."""
    fit = min(width, n_frames if n_frames % 2 else n_frames - 1)
    return max(3, fit if fit % 2 else fit - 1)


def delta_kernel(width: int, order: int) -> list[float]:
    """Weights of the local straight line (or parabola) fit, centre in the middle."""
    half = width // 2
    offsets = range(-half, half + 1)
    if order == 1:
        norm = sum(k * k for k in offsets)
        return [k / norm for k in offsets]
    if order == 2:
        mean = sum(k * k for k in offsets) / width
        norm = sum((k * k - mean) ** 2 for k in offsets)
        return [2.0 * (k * k - mean) / norm for k in offsets]
    raise ValueError("order must be 1 or 2")


def deltas(
    frames: DataFrame,
    series,
    values: Sequence[str],
    width: int = 9,
    order: int = 1,
    prefix: str = "d_",
    piece: int = PIECE,
) -> DataFrame:
    """``frames`` + local slope (or curvature) columns over ``width`` frames.

    A series is cut into pieces of ``piece`` frames; frames near a cut are also
    handed to the neighbour piece, so the window sees whole neighbourhoods
    while no task holds a whole series. Frames closer to an end than half the
    width take the value of the nearest full window, which is what a fit over
    the border window gives. Series shorter than ``width`` get nulls: call with
    :func:`resolve_width`.
    """
    by = _cols(series)
    half = width // 2
    weights = delta_kernel(width, order)
    own = F.floor(F.col("frame_idx") / piece)
    near = F.array_distinct(
        F.array(F.floor((F.col("frame_idx") - half) / piece), own, F.floor((F.col("frame_idx") + half) / piece))
    )
    spread = frames.withColumn("_own", own).withColumn("_piece", F.explode(near))
    window = Window.partitionBy(*by, "_piece").orderBy("frame_idx")
    out = spread
    for v in values:
        total = None
        for k, w in zip(range(-half, half + 1), weights):
            term = F.lag(F.col(v), -k).over(window) * F.lit(w)
            total = term if total is None else total + term
        out = out.withColumn(f"{prefix}{v}", total)
    out = out.where(F.col("_piece") == F.col("_own")).drop("_piece", "_own")
    names = [f"{prefix}{v}" for v in values]
    full = F.col(names[0]).isNotNull()
    ends = out.groupBy(*by).agg(
        F.min(F.when(full, F.col("frame_idx"))).alias("_lo"),
        F.max(F.when(full, F.col("frame_idx"))).alias("_hi"),
        *[F.min_by(n, F.when(full, F.col("frame_idx"))).alias(f"_a{i}") for i, n in enumerate(names)],
        *[F.max_by(n, F.when(full, F.col("frame_idx"))).alias(f"_z{i}") for i, n in enumerate(names)],
    )
    filled = attach(out, settle(ends), by, "inner")
    for i, n in enumerate(names):
        filled = filled.withColumn(
            n,
            F.when(F.col("frame_idx") < F.col("_lo"), F.col(f"_a{i}"))
            .when(F.col("frame_idx") > F.col("_hi"), F.col(f"_z{i}"))
            .otherwise(F.col(n)),
        )
    extra = [f"_{s}{i}" for i in range(len(names)) for s in "az"]
    return filled.drop("_lo", "_hi", *extra)


def suffixes(strategy: str) -> list[str]:
    if strategy == "percentiles":
        return [f"p{p}" for p in PERCENTILES]
    return strategy.split("_")


def aggregate_vectors(frames: DataFrame, series, vec: str, strategy: str) -> DataFrame:
    """(series, features): statistics of every dimension, suffix-major order."""
    by = _cols(series)
    if strategy == "percentiles":
        cells = frames.select(*by, F.posexplode(vec).alias("_p", "_x"))
        names = suffixes(strategy)
        table = exact_quantiles(cells, [*by, "_p"], "_x", [p / 100 for p in PERCENTILES], names)
        # one entry per dimension: a bounded list
        listed = table.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_p", *names))).alias("_l"))
        return listed.select(
            *by, F.concat(*[F.col(f"_l.{n}") for n in names]).alias("features")
        )
    stats = moments(frames, by, vec, extremes="min" in strategy)
    parts = {
        "mean": F.col("mean"),
        "std": population_sd(F.col("n"), F.col("m2")),
        "min": F.col("min") if "min" in strategy else None,
        "max": F.col("max") if "max" in strategy else None,
    }
    return stats.select(*by, F.concat(*[parts[s] for s in suffixes(strategy)]).alias("features"))


def aggregate_values(frames: DataFrame, series, value: str, strategy: str) -> DataFrame:
    """The scalar form: one column per statistic."""
    by = _cols(series)
    if strategy == "percentiles":
        return exact_quantiles(frames, by, value, [p / 100 for p in PERCENTILES], suffixes(strategy))
    exprs = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}
    return frames.groupBy(*by).agg(*[exprs[s](value).alias(s) for s in suffixes(strategy)])


def frame_names(settings: FeatureSettings) -> list[str]:
    """Names of the frame rows, in stored order."""
    base = [f"mfcc{i:02d}" for i in range(settings.n_mfcc)]
    names = list(base)
    names += [f"d_{n}" for n in base] if settings.deltas else []
    names += [f"dd_{n}" for n in base] if settings.delta_deltas else []
    widths = {
        "chroma": [f"chroma{i:02d}" for i in range(12)],
        "spectral_contrast": [f"contrast{i:02d}" for i in range(7)],
        "spectral_centroid": ["centroid"],
        "rolloff": ["rolloff"],
        "zcr": ["zcr"],
        "rms": ["rms"],
    }
    return names + [n for block in widths if block in settings.extras for n in widths[block]]


def feature_names(settings: FeatureSettings) -> list[str]:
    names = frame_names(settings)
    return [f"{n}_{s}" for s in suffixes(settings.aggregation) for n in names]


def rms_of(samples: Column) -> Column:
    power = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(power / F.size(samples))
