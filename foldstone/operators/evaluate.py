"""Scores of pooled predictions, all from one (true, predicted, n) table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash32
from ..functions.text import sorted_json, utc_seconds
from .ranking import _cols, attach

TRUE, PRED = "y_true", "y_pred"


def tally(pred: DataFrame, by=(), true: str = TRUE, guess: str = PRED) -> DataFrame:
    """Rows per (by, true, predicted): all that any score below needs."""
    return pred.groupBy(*_cols(by), F.col(true).alias(TRUE), F.col(guess).alias(PRED)).agg(
        F.count(F.lit(1)).alias("n")
    )


def grid(counts: DataFrame, labels: Sequence) -> DataFrame:
    """A dense label x label table in declared order; pairs never seen get 0."""
    labels = list(labels)
    spark = counts.sparkSession
    rows = [(i, t, j, p) for i, t in enumerate(labels) for j, p in enumerate(labels)]
    kind = counts.schema[TRUE].dataType.simpleString()
    cells = spark.createDataFrame(rows, f"true_order int, {TRUE} {kind}, pred_order int, {PRED} {kind}")
    known = counts.where(F.col(TRUE).isin(labels) & F.col(PRED).isin(labels))
    return attach(cells, known.select(TRUE, PRED, "n"), [TRUE, PRED]).withColumn(
        "n", F.coalesce("n", F.lit(0)).cast("bigint")
    )


def confusion(pred: DataFrame, labels: Sequence) -> DataFrame:
    return grid(tally(pred), labels).select(TRUE, PRED, "n")


def confusion_pivot(pred: DataFrame, labels: Sequence) -> DataFrame:
    """The confusion table as a square, one column per predicted label."""
    return grid(tally(pred), labels).groupBy(TRUE).pivot(PRED, list(labels)).agg(F.first("n"))


def class_table(counts: DataFrame, by=()) -> DataFrame:
    """Support, predicted count, hits, precision, recall, F1 per observed label.

    Observed means true or predicted somewhere in the same ``by`` cell, which
    is the label set that macro-F1 divides by.
    """
    by = _cols(by)
    n = F.col("n")
    hit = F.when(F.col(TRUE) == F.col(PRED), n).otherwise(0 * n)
    both = F.array(
        F.struct(F.col(TRUE).alias("label"), n.alias("s"), (0 * n).alias("p"), hit.alias("t")),
        F.struct(F.col(PRED).alias("label"), (0 * n).alias("s"), n.alias("p"), (0 * n).alias("t")),
    )
    sums = (
        counts.select(*by, F.explode(both).alias("e"))
        .groupBy(*by, F.col("e.label").alias("label"))
        .agg(
            F.sum("e.s").alias("support"),
            F.sum("e.p").alias("predicted"),
            F.sum("e.t").alias("hits"),
        )
    )
    return _rates(sums)


def _rates(sums: DataFrame) -> DataFrame:
    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return (
        sums.withColumn("precision", ratio(hits, predicted))
        .withColumn("recall", ratio(hits, support))
        .withColumn("f1", ratio(2.0 * hits, support + predicted))
    )


def per_class(pred: DataFrame, labels: Sequence) -> DataFrame:
    """The class table over the declared labels; absent labels get zeros."""
    spark = pred.sparkSession
    kind = pred.schema[TRUE].dataType.simpleString()
    frame = spark.createDataFrame(list(enumerate(labels)), f"label_order int, label {kind}")
    found = class_table(tally(pred)).select("label", "support", "predicted", "hits")
    sums = attach(frame, found, "label").fillna(0, ["support", "predicted", "hits"])
    return _rates(sums)


def scores(counts: DataFrame, by=()) -> DataFrame:
    """accuracy, macro_f1, weighted_f1, n and n_classes per ``by`` cell."""
    by = _cols(by)
    return (
        class_table(counts, by)
        .groupBy(*by)
        .agg(
            F.sum("support").alias("n"),
            (F.sum("hits") / F.sum("support")).alias("accuracy"),
            F.avg("f1").alias("macro_f1"),
            (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
            F.count_if(F.col("support") > 0).alias("n_classes"),
            F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1_present"),
        )
    )


def score(pred: DataFrame, by=()) -> DataFrame:
    return scores(tally(pred, by), by)


def slice_levels(pred: DataFrame, columns: Sequence[str], extra=()) -> DataFrame:
    """(slice, level, true, predicted, n) for several slice columns in one pass.

    Rows are counted over all slice columns together first, so the unpivot
    works on the small counted table. Missing columns are skipped, null
    levels dropped.
    """
    present = [c for c in columns if c in pred.columns]
    extra = _cols(extra)
    counts = pred.groupBy(*extra, *present, TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("slice"), F.col(c).cast("string").alias("level")) for c in present])
    )
    return (
        counts.select(*extra, pairs.alias("e"), TRUE, PRED, "n")
        .where(F.col("e.level").isNotNull())
        .groupBy(*extra, F.col("e.slice").alias("slice"), F.col("e.level").alias("level"), TRUE, PRED)
        .agg(F.sum("n").alias("n"))
    )


def slices(pred: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Accuracy and macro-F1 per slice level; macro-F1 null for one true class."""
    table = scores(slice_levels(pred, columns), ["slice", "level"])
    return table.select(
        "slice",
        "level",
        "n",
        "accuracy",
        F.when(F.col("n_classes") > 1, F.col("macro_f1")).alias("macro_f1"),
    )


def shared_class_slices(pred: DataFrame, column: str) -> DataFrame:
    """Slice scores over the true classes that occur at every level."""
    counts = tally(pred, column).where(F.col(column).isNotNull())
    n_levels = counts.agg(F.count_distinct(column).alias("_levels"))
    shared = (
        counts.groupBy(TRUE)
        .agg(F.count_distinct(column).alias("_at"))
        .crossJoin(n_levels)
        .where(F.col("_at") == F.col("_levels"))
        .select(TRUE)
    )
    return scores(counts.join(shared, TRUE, "left_semi"), column)


def normalised_confusion(pred: DataFrame, labels: Sequence) -> DataFrame:
    """Confusion divided by row sums; an empty row divides by one."""
    row_sum = F.sum("n").over(Window.partitionBy(TRUE))
    return grid(tally(pred), labels).select(
        TRUE, PRED, (F.col("n") / F.greatest(row_sum, F.lit(1))).alias("share")
    )


def error_structure(pred: DataFrame, high: Sequence, labels: Sequence) -> DataFrame:
    """Are errors more often inside a superclass than chance would have them?"""
    high, labels = list(high), list(labels)
    k, h = len(labels), len([x for x in labels if x in high])
    low = k - h
    chance = (h * (h - 1) + low * (low - 1)) / (k * (k - 1))
    wrong = tally(pred).where(F.col(TRUE) != F.col(PRED))
    same = F.col(TRUE).isin(high) == F.col(PRED).isin(high)
    sums = wrong.agg(
        F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("within_errors"),
        F.coalesce(F.sum(F.when(~same, F.col("n"))), F.lit(0)).alias("across_errors"),
    )
    total = F.col("within_errors") + F.col("across_errors")
    share = F.when(total > 0, F.col("within_errors") / total).otherwise(F.lit(0.0))
    return sums.select(
        "within_errors",
        "across_errors",
        share.alias("within_share"),
        F.lit(chance).alias("chance_within_share"),
        (share / F.lit(chance)).alias("lift"),
    )


def class_deltas(pred_a: DataFrame, pred_b: DataFrame) -> DataFrame:
    """Recall of run A minus run B per true class, in points, worst first."""
    def recalls(pred, name):
        return class_table(tally(pred)).where(F.col("support") > 0).select(
            "label", F.col("recall").alias(name), F.col("support").alias(f"{name}_n")
        )

    a, b = recalls(pred_a, "recall_a"), recalls(pred_b, "recall_b")
    table = a.join(b, "label")
    share = F.col("recall_a_n") / F.sum("recall_a_n").over(Window.partitionBy(F.lit(0)))
    return (
        table.withColumn("delta_pp", F.round((F.col("recall_a") - F.col("recall_b")) * 100, 2))
        .withColumn("share_pct", F.round(100 * share, 2))
        .select("label", "recall_a", "recall_b", "delta_pp", "share_pct")
        .orderBy("delta_pp", "label")
    )


def top_confusions(pred: DataFrame, k: int) -> DataFrame:
    return (
        tally(pred)
        .where(F.col(TRUE) != F.col(PRED))
        .orderBy(F.desc("n"), TRUE, PRED)
        .limit(k)
    )


def with_synthetic_predictions(
    df: DataFrame, label: str, key: str, labels: Sequence, tenths: int, seed: str
) -> DataFrame:
    """Predictions right ``tenths`` times in ten, otherwise a hashed label."""
    names = F.array(*[F.lit(x) for x in labels])
    other = F.get(names, (hash32("c", F.col(key)) % len(labels)).cast("int"))
    keep = hash32(seed, F.col(key)) % 10 < tenths
    return df.withColumn(TRUE, F.col(label)).withColumn(
        PRED, F.when(keep, F.col(label)).otherwise(other)
    )


def leakage_gap(results: DataFrame, leaky: str, honest: str) -> DataFrame:
    """Leaky minus group-safe accuracy per model, in points and relative terms."""
    wide = results.groupBy("model").pivot("protocol", [leaky, honest]).agg(F.max("accuracy"))
    return wide.select(
        "model",
        F.col(leaky).alias("leaky"),
        F.col(honest).alias("honest"),
        ((F.col(leaky) - F.col(honest)) * 100).alias("gap_pp"),
        ((F.col(leaky) / F.col(honest) - 1) * 100).alias("inflation_pct"),
    )


def rank_protocols(table: DataFrame) -> DataFrame:
    """Pre-registered order: classes kept, no source cue, small gap, then macro-F1."""
    return table.orderBy(
        F.desc("all_classes"), F.desc("no_source_cue"), F.asc("gap_pp"), F.desc("macro_f1"), "protocol"
    )


@dataclass
class Evaluation:
    """Lazy score tables of one run; ``row`` is its results-log line."""

    scores: DataFrame
    per_class: DataFrame
    confusion: DataFrame
    slices: DataFrame
    row: DataFrame


def check_alignment(pred: DataFrame, meta: DataFrame, key: str) -> None:
    """Predictions and metadata must describe the same observations."""
    left = pred.join(meta, key, "left_anti").limit(1).count()
    right = meta.join(pred, key, "left_anti").limit(1).count()
    if left or right:
        raise ValueError("predictions and metadata describe different observations")


def evaluate(
    pred: DataFrame,
    labels: Sequence,
    protocol: str,
    fold: object,
    model: str,
    feature_config: str = "",
    hyperparams: dict | None = None,
    notes: str = "",
    owner: str = "",
    slice_columns: Sequence[str] = (),
    results_path: str | None = None,
) -> Evaluation:
    """Score one prediction table and, with ``results_path``, log one row."""
    table = score(pred)
    row = table.select(
        F.lit(uuid.uuid4().hex[:8]).alias("run_id"),
        utc_seconds(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())).alias("timestamp"),
        F.lit(owner).alias("owner"),
        F.lit(protocol).alias("protocol"),
        F.lit(str(fold)).alias("fold"),
        F.lit(feature_config).alias("feature_config"),
        F.lit(model).alias("model"),
        F.lit(sorted_json(hyperparams or {})).alias("hyperparams"),
        F.round("accuracy", 6).alias("accuracy"),
        F.round("macro_f1", 6).alias("macro_f1"),
        F.lit(notes).alias("notes"),
    )
    if results_path:
        from ..sources.tables import append_results

        append_results(row, results_path)
    present = [c for c in slice_columns if c in pred.columns]
    cut = slices(pred, present) if present else None
    return Evaluation(table, per_class(pred, labels), confusion(pred, labels), cut, row)


def evaluate_pooled(per_fold: Sequence[DataFrame], labels: Sequence, protocol: str, **kwargs) -> Evaluation:
    """Union the folds' held-out predictions and score them once."""
    if "fold" in kwargs:
        raise TypeError("pooled scores have no fold")
    per_fold = list(per_fold)
    if not per_fold:
        raise ValueError("no folds to pool")
    pooled = per_fold[0]
    for part in per_fold[1:]:
        pooled = pooled.unionByName(part)
    return evaluate(pooled, labels, protocol, "pooled", **kwargs)
