"""Leakage, shift and sensitivity reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from ..vocab import GROUP_EPS, N_BOOT, N_SPLITS, SEED
from .evaluate import score, scores, slice_levels, tally
from .models import nearest_centroid_oof
from .neighbors import silhouette, squared_silhouette
from .profile import value_shares
from .ranking import attach
from .splits import attribute_holdout_disjoint, stratified_folds, with_group_fold
from .uncertainty import cluster_bootstrap, paired_comparisons
from .vectors import apply_scaler, fit_scaler, per_group_normalise

Oof = Callable[..., DataFrame]


def identity_probe(
    df: DataFrame, key: str, vec: str, group: str, k: int = N_SPLITS, seed=SEED, oof: Oof = nearest_centroid_oof
) -> DataFrame:
    """How well the group itself can be predicted, raw and group-normalised.

    Stratified folds by group: a score far above chance means identity is in
    the vectors. One row per space.
    """
    folded = stratified_folds(df, group, key, k, seed)
    n_groups = df.select(group).distinct().count()
    out = None
    for space, rows in (("raw", folded), ("normalised", per_group_normalise(folded, vec, group, GROUP_EPS))):
        part = oof(rows, key, vec, group).select(F.lit(space).alias("space"), "fold", "y_true", "y_pred")
        out = part if out is None else out.unionByName(part)
    per_fold = score(out, ["space", "fold"])
    chance = 1.0 / n_groups
    return per_fold.groupBy("space").agg(
        F.avg("accuracy").alias("accuracy"),
        F.stddev_samp("accuracy").alias("sd"),
        F.lit(chance).alias("chance"),
        (F.avg("accuracy") / F.lit(chance)).alias("x_chance"),
    )


def source_probe(
    df: DataFrame, key: str, vec: str, group: str, source: str, k: int = N_SPLITS, oof: Oof = nearest_centroid_oof,
    method: str = "snake",
) -> DataFrame:
    """Can the source be told from the vectors, on groups never seen?"""
    folded = with_group_fold(df, group, k, method)
    majority = value_shares(df, source).agg(F.max("share").alias("majority"))
    out = None
    for space, rows in (("raw", folded), ("normalised", per_group_normalise(folded, vec, group))):
        part = oof(rows, key, vec, source).select(F.lit(space).alias("space"), "y_true", "y_pred")
        out = part if out is None else out.unionByName(part)
    return score(out, "space").crossJoin(majority).select(
        "space", "accuracy", "majority", (F.col("accuracy") / F.col("majority")).alias("ratio")
    )


def silhouette_by(df: DataFrame, key: str, vec: str, label: str, squared: bool = False) -> DataFrame:
    """Silhouette after standardising all rows; ``squared`` distances need no pairs of rows."""
    return (squared_silhouette if squared else silhouette)(apply_scaler(df, fit_scaler(df, vec), vec), key, vec, label)


def silhouette_comparison(df: DataFrame, key: str, vec: str, group: str, label: str, squared: bool = False) -> DataFrame:
    """(space, by, silhouette): raw and normalised vectors, by group and by label."""
    out = None
    for space, rows in (("raw", df), ("normalised", per_group_normalise(df, vec, group))):
        for name, column in (("group", group), ("label", label)):
            part = silhouette_by(rows, key, vec, column, squared).select(
                F.lit(space).alias("space"), F.lit(name).alias("by"), "silhouette"
            )
            out = part if out is None else out.unionByName(part)
    return out


def attribute_invariance(
    df: DataFrame, key: str, vec: str, label: str, group: str, train_if, test_if, k: int = N_SPLITS,
    oof: Oof = nearest_centroid_oof, method: str = "snake",
) -> DataFrame:
    """Scores with groups held out, an attribute held out, and both.

    The held-out-attribute protocols reuse one out-of-fold routine: rows on
    the test side of an attribute get a fold of their own, so they only ever
    meet centres of the train attribute.
    """
    grouped = with_group_fold(df, group, k, method)
    by_group = oof(grouped, key, vec, label).select(F.lit("group").alias("protocol"), "y_true", "y_pred")
    single = df.withColumn("fold", F.when(test_if, 1).when(train_if, 0)).where(F.col("fold").isNotNull())
    by_attribute = oof(single, key, vec, label).where(F.col("fold") == 1).select(
        F.lit("attribute").alias("protocol"), "y_true", "y_pred"
    )
    long = attribute_holdout_disjoint(grouped, key, k, train_if, test_if)
    both = None
    for f in range(k):
        one = df.join(long.where(F.col("fold") == f).select(key, "split"), key)
        part = oof(one.withColumn("fold", F.when(F.col("split") == "test", 1).otherwise(0)), key, vec, label)
        part = part.where(F.col("fold") == 1).select(F.lit("both").alias("protocol"), "y_true", "y_pred")
        both = part if both is None else both.unionByName(part)
    return score(by_group.unionByName(by_attribute).unionByName(both), "protocol")


def slice_report(pred: DataFrame, columns: Sequence[str], group: str, n_boot: int, seed=SEED) -> DataFrame:
    """(slice, level, n, accuracy, macro_f1, lo, hi) with draws of each level's own groups."""
    point = scores(slice_levels(pred, columns), ["slice", "level"]).select("slice", "level", "n", "accuracy", "macro_f1")
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("level")) for c in columns])
    )
    # one row per (observation, slice): counted per group before any draw
    long = pred.select(group, "y_true", "y_pred", pairs.alias("e")).select(
        group, "y_true", "y_pred", F.col("e.slice").alias("slice"), F.col("e.level").alias("level")
    ).where(F.col("level").isNotNull())
    interval = cluster_bootstrap(long, group, "macro_f1", n_boot, seed=seed, by=["slice", "level"])
    return attach(point, interval.select("slice", "level", "lo", "hi"), ["slice", "level"])


def slice_gap(report: DataFrame) -> DataFrame:
    """Largest minus smallest score within each slice."""
    return report.groupBy("slice").agg(
        (F.max("accuracy") - F.min("accuracy")).alias("accuracy_gap"),
        (F.max("macro_f1") - F.min("macro_f1")).alias("macro_f1_gap"),
    )


def axis_curve(
    candidates: Sequence[tuple[str, DataFrame]], key: str, vec: str, label: str, oof: Oof = nearest_centroid_oof
) -> DataFrame:
    """(ordinal, candidate, scores) over folded tables, e.g. one per layer."""
    out = None
    for i, (name, rows) in enumerate(candidates):
        part = oof(rows, key, vec, label).select(
            F.lit(i).alias("ordinal"), F.lit(name).alias("candidate"), "y_true", "y_pred"
        )
        out = part if out is None else out.unionByName(part)
    return scores(tally(out, ["ordinal", "candidate"]), ["ordinal", "candidate"])


def axis_search(
    axes: dict[str, Sequence], table_of: Callable[[dict], DataFrame], key: str, vec: str, label: str, oof: Oof = nearest_centroid_oof
) -> DataFrame:
    """(step, axis, candidate, n, accuracy, macro_f1, chosen): the best value of one axis after another.

    All candidates of an axis are scored in one job, with the axes before it
    at their best and those after it at their first value; ties go to the
    first declared. ``table_of(choice)`` is the folded table of a choice.
    """
    spark = None
    choice = {axis: values[0] for axis, values in axes.items()}
    out = None
    for step, (axis, values) in enumerate(axes.items()):
        tables = [(str(v), table_of({**choice, axis: v})) for v in values]
        spark = tables[0][1].sparkSession
        curve = materialise(axis_curve(tables, key, vec, label, oof).select("ordinal", "candidate", "n", "accuracy", "macro_f1"), "axis")
        marks = {r["ordinal"]: round(r["macro_f1"], 12) for r in curve.select("ordinal", "macro_f1").collect()}  # one row a candidate
        best = max(sorted(marks), key=lambda i: marks[i])
        choice[axis] = values[best]
        part = curve.select(
            F.lit(step).alias("step"), F.lit(axis).alias("axis"), "candidate", "n", "accuracy", "macro_f1", (F.col("ordinal") == best).alias("chosen")
        )
        out = part if out is None else out.unionByName(part)
    return out


def encoder_comparison(
    encoders: dict[str, Sequence[tuple[str, DataFrame]]], control: str, key: str, vec: str, label: str, group: str, n_boot: int = N_BOOT,
    oof: Oof = nearest_centroid_oof,
) -> DataFrame:
    """(encoder, layer, point, delta, lo, hi, p_value, identity): each encoder at its best layer against ``control`` at its own.

    ``encoders`` maps a name to its folded layer tables. The best layer has the
    largest pooled macro-F1, the first of equal ones; the difference is tested
    on shared draws of groups; ``identity`` is how well groups can be told
    from the chosen layer.
    """
    best, long, leaks = [], None, None
    for name, layers in encoders.items():
        stored = [(layer, materialise(rows, "layer")) for layer, rows in layers]
        curve = axis_curve(stored, key, vec, label, oof).select("ordinal", "macro_f1").collect()
        at = max(sorted((r["ordinal"], round(r["macro_f1"], 12)) for r in curve), key=lambda r: (r[1], -r[0]))[0]
        rows = stored[at][1]
        best.append((name, stored[at][0]))
        part = oof(rows, key, vec, label).select(F.lit(name).alias("encoder"), group, "y_true", "y_pred")
        long = part if long is None else long.unionByName(part)
        probe = identity_probe(rows.drop("fold"), key, vec, group).where("space = 'raw'").select(F.lit(name).alias("encoder"), F.col("accuracy").alias("identity"))
        leaks = probe if leaks is None else leaks.unionByName(probe)
    long = materialise(long, "encoders")
    chosen = leaks.sparkSession.createDataFrame(best, "encoder string, layer string").join(leaks, "encoder")
    tested = paired_comparisons(long, group, "encoder", control, n_boot=n_boot).drop("significant")
    base = score(long.where(F.col("encoder") == control)).select(F.lit(control).alias("encoder"), F.col("macro_f1").alias("point"))
    return chosen.join(tested.unionByName(base, allowMissingColumns=True), "encoder")


def drift_check(found: DataFrame, committed: DataFrame, key, metric: str, tolerance: float = 1e-6) -> DataFrame:
    """Reproduction of control cells before anything else is read."""
    old = committed.withColumnRenamed(metric, "_committed")
    gap = F.abs(F.col(metric) - F.col("_committed"))
    return found.join(old, key).select(
        key, F.col(metric).alias("found"), F.col("_committed").alias("committed"), gap.alias("drift"), (gap <= tolerance).alias("reproduced")
    )
