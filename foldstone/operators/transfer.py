"""Training rows from other sources: weights, selections, arms and sweeps."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..vocab import RATIO_CLIP, WEIGHT_GRID
from .evaluate import TRUE, class_deltas, score
from .models import fit, fit_predict
from .ranking import vocabulary
from .vectors import fit_scaler


def uniform_weight(source: Column, base: str, weight: float) -> Column:
    """1 for base rows, ``weight`` for the others; rows of weight 0 are not used."""
    return F.when(source == base, F.lit(1.0)).otherwise(F.lit(float(weight)))


def weighted_train(df: DataFrame, source: str, base: str, weight: float, out: str = "weight") -> DataFrame:
    return df.withColumn(out, uniform_weight(F.col(source), base, weight)).where(F.col(out) > 0)


def density_ratio(p: Column, clip: float = RATIO_CLIP) -> Column:
    """p / (1 - p), bounded on both sides."""
    ratio = p / F.greatest(1.0 - p, F.lit(1e-6))
    return F.least(F.greatest(ratio, F.lit(0.0)), F.lit(clip))


def importance_weights(
    train: DataFrame, source: str, base: str, vec: str, max_iter: int = 2000, clip: float = RATIO_CLIP
) -> DataFrame:
    """``train`` with ``weight``: how base-like each external row looks."""
    marked = train.withColumn("_in", F.when(F.col(source) == base, 1).otherwise(0))
    judge = fit("logistic-regression", marked, vec, "_in", {"max_iter": max_iter})
    scored = judge.predict(marked)
    weight = F.when(F.col("_in") == 1, 1.0).otherwise(density_ratio(F.get("probability", F.lit(1)), clip))
    return scored.withColumn("weight", weight).drop("_in", "probability", "y_pred")


def pick_weight(
    base_rows: DataFrame,
    external: DataFrame,
    vec: str,
    label: str,
    key: str,
    inner: str,
    model: str = "svm-rbf",
    params: dict | None = None,
    candidates: Sequence[float] = (0.0, *WEIGHT_GRID),
    n_folds: int = 3,
) -> tuple[float, DataFrame]:
    """External weight by inner group folds of the train side; first best wins."""
    rows = []
    for weight in candidates:
        marks = []
        for f in range(n_folds):
            own = base_rows.where(F.col(inner) != f).drop(inner).withColumn("weight", F.lit(1.0))
            train = own
            if weight > 0:
                train = own.unionByName(external.select(*own.drop("weight").columns, F.lit(float(weight)).alias("weight")))
            held = base_rows.where(F.col(inner) == f).drop(inner)
            out = fit_predict(model, train, held, vec, label, key, params=params, weight="weight")
            marks.append(float(score(out).first()["macro_f1"]))
        rows.append((len(rows), float(weight), sum(marks) / len(marks)))
    best = max(rows, key=lambda r: (r[2], -r[0]))
    table = base_rows.sparkSession.createDataFrame(rows, "ordinal int, weight double, macro_f1 double")
    return best[1], table


def helped_classes(pred_with: DataFrame, pred_without: DataFrame) -> DataFrame:
    """Labels whose recall rises with the external rows."""
    return class_deltas(pred_with, pred_without).where(F.col("recall_a") > F.col("recall_b")).select("label")


def class_selective(external: DataFrame, helped: DataFrame, label: str) -> DataFrame:
    """External rows of the helped classes only."""
    return external.join(helped.select(F.col("label").alias(label)), label, "left_semi")


def scaler_only(
    base_rows: DataFrame, external: DataFrame, test: DataFrame, vec: str, label: str,
    model: str = "svm-rbf", params: dict | None = None,
) -> DataFrame:
    """Scaler from all training rows, classifier from base rows."""
    scaler = fit_scaler(base_rows.select(vec).unionByName(external.select(vec)), vec, "global")
    return fit(model, base_rows, vec, label, params, scaler=scaler).predict(test.withColumn(TRUE, F.col(label)))


def subsets(sources: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets, smallest first, members in declared order."""
    return [c for size in range(len(sources) + 1) for c in combinations(sources, size)]


def subset_table(df: DataFrame, source: str, candidates: Sequence[str]) -> DataFrame:
    """(subset, n_sources, n_rows): the training rows each subset would add.

    Sizes per source are counted once; 2^k subsets then sum k numbers each.
    """
    if len(candidates) > 20:
        raise ValueError("2^k subsets: at most 20 sources")
    sizes = df.where(F.col(source).isin(list(candidates))).groupBy(F.col(source).alias("member")).agg(
        F.count(F.lit(1)).alias("n")
    )
    names = F.array(*[F.lit(s) for s in candidates])
    masks = df.sparkSession.range(2 ** len(candidates)).select(F.col("id").alias("mask"))
    slots = masks.select("mask", F.posexplode(names).alias("bit", "member")).where(
        F.expr("shiftright(mask, bit) & 1 = 1")
    )
    totals = slots.join(sizes, "member", "left").groupBy("mask").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("bit", "member"))), lambda s: s["member"]), "+"
        ).alias("subset"),
        F.count(F.lit(1)).alias("n_sources"),
        F.sum(F.coalesce("n", F.lit(0))).alias("n_rows"),
    )
    return masks.join(totals, "mask", "left").select(
        F.coalesce("subset", F.lit("(base only)")).alias("subset"),
        F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"),
        F.coalesce("n_rows", F.lit(0)).cast("bigint").alias("n_rows"),
    )


def versus_control(table: DataFrame, name: str, metric: str, control: str, out: str = "vs_control_pp") -> DataFrame:
    """(metric - control's metric) in points, two digits.

    The table holds one row per configuration.
    """
    at_control = F.max(F.when(F.col(name) == control, F.col(metric))).over(Window.partitionBy(F.lit(0)))
    return table.withColumn(out, F.round((F.col(metric) - at_control) * 100, 2))


def sweep(
    df: DataFrame,
    source: str,
    base: str,
    candidates: Sequence[str],
    folds: Sequence[int],
    predict: Callable[[DataFrame, DataFrame], DataFrame],
    keep: Sequence[str],
    fold: str = "fold",
) -> DataFrame:
    """Held-out predictions of every source subset: (subset, keep, y_true, y_pred)."""
    out = None
    own = df.where(F.col(source) == base)
    for subset in subsets(candidates):
        extra = df.where(F.col(source).isin(list(subset))) if subset else None
        for f in folds:
            train = own.where(F.col(fold) != f)
            if extra is not None:
                train = train.unionByName(extra)
            part = predict(train, own.where(F.col(fold) == f)).select(
                F.lit("+".join(subset) or "(base only)").alias("subset"), *keep, "y_true", "y_pred"
            )
            out = part if out is None else out.unionByName(part)
    return out


def optimism(outer: DataFrame, nested_score: float) -> DataFrame:
    """Best score picked on the test folds minus the nested score, in points."""
    return outer.agg(F.max("macro_f1").alias("selected_on_test")).select(
        "selected_on_test",
        F.lit(float(nested_score)).alias("nested"),
        ((F.col("selected_on_test") - F.lit(float(nested_score))) * 100).alias("optimism_pp"),
    )


def select_inner(scores: DataFrame, by: str, candidate: str, ordinal: str, metric: str) -> DataFrame:
    """Per outer fold the candidate with the best inner mean; first declared wins."""
    means = scores.groupBy(by, candidate, ordinal).agg(F.avg(metric).alias("inner_score"))
    pick = F.max_by(F.struct(candidate, "inner_score"), F.struct(F.round("inner_score", 12), -F.col(ordinal)))
    return means.groupBy(by).agg(pick.alias("_p")).select(by, F.col(f"_p.{candidate}").alias(candidate), "_p.inner_score")


def external_sources(df: DataFrame, source: str, base: str) -> list[str]:
    return [s for s in vocabulary(df, source) if s != base]
