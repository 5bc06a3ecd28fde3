"""Whole runs: from a table of vectors to logged, compared scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import scores, tally
from ..operators.models import fit_predict, nearest_centroid_oof
from ..operators.splits import nested_folds, with_group_fold
from ..operators.transfer import optimism, select_inner
from ..operators.uncertainty import cluster_bootstrap
from ..operators.vectors import per_group_normalise
from ..session import materialise

Oof = Callable[[DataFrame, str, str, str], DataFrame]


def group_safe_predictions(
    df: DataFrame, key: str, vec: str, label: str, group: str, k: int = 5, method: str = "snake",
    oof: Oof = nearest_centroid_oof, normalise: bool = True,
) -> DataFrame:
    """Group folds, in-group normalisation, out-of-fold predictions."""
    rows = per_group_normalise(df, vec, group) if normalise else df
    return oof(with_group_fold(rows, group, k, method), key, vec, label)


def score_models(
    protocols: dict[str, DataFrame], models: dict[str, Oof], key: str, vec: str, label: str
) -> DataFrame:
    """(model, protocol, fold, scores): per-fold rows plus one pooled row.

    ``protocols`` maps a name to the table with its ``fold`` column. Folds are
    text because of 'pooled', which scores all held-out rows once.
    """
    counts = None
    for protocol, rows in protocols.items():
        for name, oof in models.items():
            part = tally(oof(rows, key, vec, label), "fold").select(
                F.lit(name).alias("model"), F.lit(protocol).alias("protocol"), F.col("fold").cast("string").alias("fold"),
                "y_true", "y_pred", "n",
            )
            counts = part if counts is None else counts.unionByName(part)
    by = ["model", "protocol", "fold"]
    pooled = counts.withColumn("fold", F.lit("pooled"))
    return scores(counts.unionByName(pooled).groupBy(*by, "y_true", "y_pred").agg(F.sum("n").alias("n")), by)


def mllib_oof(name: str, params: dict | None = None, scale: str = "global") -> Oof:
    """An MLlib model as an out-of-fold routine over the ``fold`` column."""

    def run(df: DataFrame, key: str, vec: str, label: str, fold: str = "fold") -> DataFrame:
        from ..operators.ranking import vocabulary

        out = None
        for f in vocabulary(df, fold):
            part = fit_predict(
                name, df.where(F.col(fold) != f), df.where(F.col(fold) == f), vec, label, key, params=params, scale=scale
            ).select(*df.columns, "y_true", "y_pred")
            out = part if out is None else out.unionByName(part)
        return out

    return run


def nested_selection(
    candidates: Sequence[tuple[str, DataFrame]],
    key: str,
    vec: str,
    label: str,
    group: str,
    k: int = 5,
    inner_k: int = 3,
    oof: Oof = nearest_centroid_oof,
    n_boot: int = 2000,
    method: str = "snake",
) -> dict[str, DataFrame]:
    """Choose per outer fold by inner group folds, then score the choice.

    Every candidate is a table with the same keys. Candidate tables are
    stored once and read by all folds.
    """
    stored = [(n, materialise(with_group_fold(t, group, k, method), "candidate")) for n, t in candidates]
    inner = nested_folds(stored[0][1].select(group, "fold"), group, inner_k).withColumnRenamed("fold", "_inner")
    selected, outer_parts, inner_parts = None, None, None
    for i, (name, rows) in enumerate(stored):
        tag = [F.lit(name).alias("candidate"), F.lit(i).alias("ordinal")]
        held = oof(rows, key, vec, label).select(*tag, key, group, "fold", "y_true", "y_pred")
        outer_parts = held if outer_parts is None else outer_parts.unionByName(held)
        for f in range(k):
            train = rows.where(F.col("fold") != f).drop("fold").join(
                inner.where(F.col("outer") == f).select(group, F.col("_inner").alias("fold")), group
            )
            part = tally(oof(train, key, vec, label), "fold").select(
                *tag, F.lit(f).alias("outer"), F.col("fold").alias("inner"), "y_true", "y_pred", "n"
            )
            inner_parts = part if inner_parts is None else inner_parts.unionByName(part)
    outer_parts = materialise(outer_parts, "outer")
    inner_scores = scores(inner_parts, ["candidate", "ordinal", "outer", "inner"])
    chosen = materialise(select_inner(inner_scores, "outer", "candidate", "ordinal", "macro_f1"), "chosen")
    pooled = outer_parts.join(
        F.broadcast(chosen.select(F.col("outer").alias("fold"), "candidate")), ["fold", "candidate"]  # k rows
    )
    nested = scores(tally(pooled))
    outer = scores(tally(outer_parts, ["candidate", "ordinal"]), ["candidate", "ordinal"])
    selected = optimism(outer, float(nested.first()["macro_f1"]))
    return {
        "chosen": chosen,
        "outer": outer,
        "nested": nested,
        "optimism": selected,
        "interval": cluster_bootstrap(pooled, group, n_boot=n_boot),
        "predictions": pooled,
    }
