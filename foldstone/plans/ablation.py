"""Feature ablation: one axis of the settings changed at a time, scored over all folds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import FeatureSettings
from ..functions import arrays as A
from ..operators.evaluate import PRED, TRUE, scores
from ..operators.models import CLASS_LIMIT
from ..operators.ranking import attach
from ..operators.splits import with_group_fold
from ..operators.transfer import versus_control
from ..operators.vectors import fit_scaler, leave_out_moments, merge_moments, population_sd
from ..session import materialise, settle
from ..sources.audio import batched, extractor, read_clip
from ..vocab import ABLATION_AXES, GROUP_EPS, N_SPLITS

#: Numbers that a task's sums hold before it hands them over.
HELD_NUMBERS = 1 << 22


def settings_grid(base: FeatureSettings, axes: Mapping[str, Sequence[dict]] = ABLATION_AXES) -> list[tuple[str, FeatureSettings]]:
    """(axis, settings): the baseline, then every change of one axis."""
    return [("baseline", base), *[(axis, base.replace(**change)) for axis, changes in axes.items() for change in changes]]


def ablation(
    files: DataFrame, group: str, label: str, base: FeatureSettings, axes: Mapping[str, Sequence[dict]] = ABLATION_AXES,
    k: int = N_SPLITS, method: str = "snake", content: str = "content",
) -> DataFrame:
    """(ordinal, axis, config, n, accuracy, macro_f1, vs_control_pp) of every cell, pooled over its folds.

    ``files`` holds content, group and label. In every cell, vectors are scaled
    by the mean and sd of the train side of the fold (:func:`fit_scaler`), then
    go to the nearest class mean of that side; the settings "none" and "global"
    are therefore the same. "per_speaker" normalises inside groups before that.
    Folds are the same in all cells.

    Files are read twice, first for the moments of classes and groups, then for
    the predictions. Both times a clip gives the vectors of all cells and what
    leaves a task are sums and counts: no vector is stored or shuffled. The
    models of all cells, folds and classes reach the driver, so more than
    :data:`CLASS_LIMIT` classes are refused.
    """
    grid = settings_grid(base, axes)
    variants = list(dict.fromkeys((s.hash, s.normalisation == "per_speaker") for _, s in grid))
    features = {s.hash: s for _, s in reversed(grid)}
    rows = with_group_fold(files.select(F.col(content).alias("content"), F.col(group).alias("group"), F.col(label).alias("label")), "group", k, method)
    rows = rows.select("content", "fold", "group", "label")

    first = materialise(_moments(rows, features, variants), "moments")
    parts, stats = _normalised(first, [v for v, (_, inside) in enumerate(variants) if inside])
    parts = settle(parts)
    labels = [r["label"] for r in parts.select("label").distinct().limit(CLASS_LIMIT + 1).collect()]
    if len(labels) > CLASS_LIMIT:
        raise ValueError(f"more than {CLASS_LIMIT} classes")
    labels.sort(key=lambda x: (x is not None, x))
    outside = settle(leave_out_moments(parts, "fold", ["variant", "label"]))
    scaler = {(r["variant"], r["fold"]): (np.array(r["mean"]), np.array(r["scale"])) for r in fit_scaler(outside, None, "global", ["variant", "fold"]).collect()}
    models = {}
    for r in outside.select("variant", "fold", "label", "mean").collect():
        at = r["variant"], r["fold"]
        mean, scale = scaler[at]
        centres = models.setdefault(at, (mean, scale, np.full((len(labels), len(mean)), np.inf)))[2]
        centres[labels.index(r["label"])] = (np.array(r["mean"]) - mean) / scale
    for v, table in stats.items():
        rows = attach(rows, settle(table), "group")
    counts = settle(_predictions(rows, features, variants, models, labels).groupBy("variant", TRUE, PRED).agg(F.sum("n").alias("n")))
    cells = files.sparkSession.createDataFrame(
        [(i, axis, s.name, variants.index((s.hash, s.normalisation == "per_speaker"))) for i, (axis, s) in enumerate(grid)],
        "ordinal int, axis string, config string, variant int",
    )
    table = scores(counts.join(F.broadcast(cells), "variant").drop("variant"), ["ordinal", "axis", "config"])
    return versus_control(table.select("ordinal", "axis", "config", "n", "accuracy", "macro_f1"), "axis", "macro_f1", "baseline")


def _clips(batch: pa.RecordBatch, rate: int) -> Iterator[list[tuple]]:
    """Some rows at a time: (fold, group, label, place in the batch, clip) of the readable files that are not empty."""

    def readable() -> Iterator[tuple]:
        about = zip(*(batch.column(name).to_pylist() for name in ("fold", "group", "label")))
        for i, (row, blob) in enumerate(zip(about, batch.column("content"))):
            try:
                y = read_clip(blob, rate)[0]
            except Exception:  # no vector, as in the audit
                continue
            if len(y):
                yield (*row, i, y)

    return batched(readable())


def _rates(features: Mapping[str, FeatureSettings]) -> int:
    rates = {s.sr for s in features.values()}
    if len(rates) > 1:
        raise ValueError("settings of one rate only")
    return rates.pop()


def _moments(rows: DataFrame, features: Mapping[str, FeatureSettings], variants: Sequence[tuple[str, bool]]) -> DataFrame:
    """(variant, fold, group, label, n, mean, m2), a part a task; the group is kept where vectors are normalised inside it."""
    out = T.StructType([
        T.StructField("variant", T.IntegerType()), rows.schema["fold"], rows.schema["group"], rows.schema["label"],
        T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("mean", "m2")],
    ])
    rate, schema = _rates(features), to_arrow_schema(out)

    def run(batches):
        vectors, sums = extractor(features), _Sums()
        for batch in batches:
            for part in _clips(batch, rate):
                found = vectors([row[-1] for row in part])
                for v, (name, inside) in enumerate(variants):
                    at, x = found[name]
                    if len(at):
                        sums.add(v, [(fold, group if inside else None, label) for fold, group, label, *_ in (part[i] for i in at.tolist())], x)
                if sums.size > HELD_NUMBERS:
                    yield sums.batch(schema)
                    sums = _Sums()
        if sums.size:
            yield sums.batch(schema)

    return rows.select("content", "fold", "group", "label").mapInArrow(run, out)


class _Sums:
    """Sums and squares by variant and key, about a row of the variant: constant columns have none."""

    def __init__(self) -> None:
        self.of: dict[int, tuple[dict[tuple, int], np.ndarray, list[np.ndarray]]] = {}
        self.size = 0

    def add(self, variant: int, keys: list[tuple], x: np.ndarray) -> None:
        d = x.shape[1]
        places, about, (n, first, second) = self.of.setdefault(variant, ({}, x[0].copy(), [np.zeros(0), np.zeros((0, d)), np.zeros((0, d))]))
        at = np.array([places.setdefault(key, len(places)) for key in keys])
        if more := len(places) - len(n):
            n, first, second = np.append(n, np.zeros(more)), np.vstack([first, np.zeros((more, d))]), np.vstack([second, np.zeros((more, d))])
            self.of[variant] = places, about, [n, first, second]
            self.size += 2 * more * d
        order = np.argsort(at, kind="stable")
        own, starts = np.unique(at[order], return_index=True)
        shifted = x[order] - about
        n[own] += np.diff(np.append(starts, len(at)))
        first[own] += np.add.reduceat(shifted, starts)
        second[own] += np.add.reduceat(shifted * shifted, starts)

    def batch(self, schema: pa.Schema) -> pa.RecordBatch:
        rows = []
        for variant, (places, about, (n, first, second)) in self.of.items():
            m2 = np.maximum(second - first * first / n[:, None], 0.0)
            rows += [(variant, *key, int(n[i]), about + first[i] / n[i], m2[i]) for key, i in places.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _normalised(parts: DataFrame, inside: Sequence[int]) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(variant, fold, label, n, mean, m2) after the normalisation inside groups, and (group, _m, _s) of each variant that has it."""
    merged = settle(merge_moments(parts, ["variant", "fold", "group", "label"]))
    own = F.col("variant").isin(list(inside))
    plain, grouped = merged.where(~own), merged.where(own)
    stats = merge_moments(grouped, ["variant", "group"]).select(
        "variant", "group", F.col("mean").alias("_m"), F.transform(population_sd(F.col("n"), F.col("m2")), lambda s: s + F.lit(GROUP_EPS)).alias("_s")
    )
    stats = settle(stats)
    scaled = attach(grouped, stats, ["variant", "group"], "inner").select(
        "variant", "fold", "group", "label", "n", A.over(A.minus(F.col("mean"), F.col("_m")), F.col("_s")).alias("mean"),
        A.over(F.col("m2"), F.transform("_s", lambda s: s * s)).alias("m2"),
    )
    joined = plain.unionByName(_over_groups(scaled))
    return joined.drop("group"), {v: stats.where(F.col("variant") == v).select("group", F.col("_m").alias(f"_m{v}"), F.col("_s").alias(f"_s{v}")) for v in inside}


def _over_groups(parts: DataFrame) -> DataFrame:
    """Moments of a fold's class from those of its groups, by sums over the positions of the vectors."""
    by = ["variant", "fold", "label"]
    cells = parts.select(*by, "n", F.posexplode(F.arrays_zip("mean", "m2")).alias("_p", "_x"))
    about = cells.groupBy(*by, "_p").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_x.mean")).alias("_a"), F.sum(F.col("_x.m2") + F.col("n") * F.col("_x.mean") * F.col("_x.mean")).alias("_b")
    )
    mean = F.col("_a") / F.col("n")
    listed = about.select(*by, "n", F.struct("_p", mean.alias("mean"), F.greatest(F.col("_b") - F.col("_a") * mean, F.lit(0.0)).alias("m2")).alias("_x"))
    # one entry per dimension: a bounded list
    return listed.groupBy(*by, "n").agg(F.array_sort(F.collect_list("_x")).alias("_l")).select(
        "variant", "fold", F.lit(None).cast(parts.schema["group"].dataType).alias("group"), "label", "n", F.col("_l.mean").alias("mean"), F.col("_l.m2").alias("m2")
    )


def _predictions(rows: DataFrame, features: Mapping[str, FeatureSettings], variants: Sequence[tuple[str, bool]], models: dict, labels: list) -> DataFrame:
    """(variant, y_true, y_pred, n), a part a task: the nearest class mean, the first label of equal ones."""
    kind = rows.schema["label"].dataType
    out = T.StructType([T.StructField("variant", T.IntegerType()), T.StructField(TRUE, kind), T.StructField(PRED, kind), T.StructField("n", T.LongType())])
    rate, schema = _rates(features), to_arrow_schema(out)

    def run(batches):
        vectors, counts, place = extractor(features), Counter(), {x: i for i, x in enumerate(labels)}
        for batch in batches:
            for part in _clips(batch, rate):
                folds, true = np.array([row[0] for row in part]), np.array([place[row[2]] if row[2] in place else -1 for row in part])
                origin, found = np.array([row[3] for row in part]), vectors([row[-1] for row in part])
                for v, (name, inside) in enumerate(variants):
                    at, x = found[name]
                    if inside and len(at):
                        mean, spread = (_matrix(batch.column(f"{c}{v}"), origin[at]) for c in ("_m", "_s"))
                        x = (x - mean) / spread
                    for fold in set(folds[at].tolist()):
                        if (v, fold) not in models:  # no other fold has rows
                            continue
                        mean, scale, centres = models[v, fold]
                        own = folds[at] == fold
                        z = (x[own] - mean) / scale
                        best = np.argmin(np.stack([((z - c) ** 2).sum(1) for c in centres]), axis=0)
                        for pair, n in zip(*np.unique(true[at[own]] * len(labels) + best, return_counts=True)):
                            counts[v, int(pair)] += int(n)
        if counts:
            found = [(v, labels[p // len(labels)], labels[p % len(labels)], n) for (v, p), n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return rows.mapInArrow(run, out)


def _matrix(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """Rows of a column of equally long lists."""
    some = column.take(pa.array(at))
    return some.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
