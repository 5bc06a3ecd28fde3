"""Copies and blends of training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NoiseSettings
from ..functions import arrays as A
from ..functions.hashing import beta_symmetric, hash60, normal
from ..functions.text import stem
from ..vocab import AUGMENT_TAG, MIX_ALPHA
from .ranking import attach, hash_rank


def augmented_key(filename: Column, tag: str | Column) -> Column:
    """``stem__tag.wav``."""
    return F.concat(stem(filename), F.lit(AUGMENT_TAG), tag if isinstance(tag, Column) else F.lit(tag), F.lit(".wav"))


def source_key(filename: Column) -> Column:
    """The original name; untagged names come back unchanged."""
    head = F.substring_index(stem(filename), AUGMENT_TAG, 1)
    return F.when(F.contains(stem(filename), F.lit(AUGMENT_TAG)), F.concat(head, F.lit(".wav"))).otherwise(filename)


def noise_at_snr(signal: Column, key: Column, decibel: float, seed: object) -> Column:
    """White noise at a signal-to-noise ratio; a silent series stays as it is."""
    power = A.total(F.transform(signal, lambda x: x * x)) / F.size(signal)
    sd = F.sqrt(power / F.lit(10.0 ** (decibel / 10.0)))
    noisy = F.transform(signal, lambda x, i: x + sd * normal(seed, key, i))
    return F.when(power > 0, noisy).otherwise(signal)


def materialise_plan(df: DataFrame, configs: Sequence[NoiseSettings], done: DataFrame | None = None) -> DataFrame:
    """One row per (row, config) with lineage; names already in ``done`` are skipped."""
    tags = F.explode(F.array(*[F.lit(c.name) for c in configs]))
    plan = (
        df.withColumn("augmentation", tags)
        .withColumn("source_filename", F.col("filename"))
        .withColumn("filename", augmented_key(F.col("source_filename"), F.col("augmentation")))
    )
    return plan if done is None else plan.join(done.select("filename"), "filename", "left_anti")


def admit_to_train(augmented: DataFrame, train: DataFrame) -> DataFrame:
    """Augmented rows whose source is on this train side; they are never scored."""
    sources = train.select(F.col("filename").alias("source_filename"))
    return augmented.join(sources, "source_filename", "left_semi")


def mixup(
    df: DataFrame,
    key: str,
    vec: str,
    label: str,
    group: str,
    ratio: float,
    seed: object,
    alpha: float = MIX_ALPHA,
    tries: int = 8,
) -> DataFrame:
    """(label, draw, a, b, weight, vec): blends of two rows of one class.

    Each class gets ``round(n * ratio)`` draws. A draw names two positions in
    the class by hash, with up to ``tries`` further partners when the groups
    agree; a class held by one group keeps its last pair. Positions are looked
    up by equi-join, so no within-class pair list exists.
    """
    ranked = hash_rank(df, label, key, seed, out="_pos")
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    # draws start from rows, so a large class is drawn from in many tasks
    per_row = int(ratio) + 1
    starts = attach(ranked.select(label, "_pos"), sizes, label, "inner").where(F.col("_n") >= 2)
    draws = (
        starts.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(per_row - 1))))
        .withColumn("draw", F.col("_rep") * F.col("_n") + F.col("_pos") - 1)
        .where(F.col("draw") < F.bround(F.col("_n") * ratio))
        .select(label, "draw", "_n")
    )
    first = hash60(seed, "a", F.col(label), F.col("draw")) % F.col("_n")
    # a partner position different from the first, one candidate per try
    tried = F.transform(
        F.sequence(F.lit(0), F.lit(tries)),
        lambda t: (first + 1 + hash60(seed, "b", F.col(label), F.col("draw"), t) % (F.col("_n") - 1)) % F.col("_n"),
    )
    lines = draws.select(label, "draw", first.alias("_a"), F.posexplode(tried).alias("_try", "_b"))
    groups = ranked.select(label, F.col("_pos"), F.col(group).alias("_g"))
    with_a = attach(lines.withColumn("_pos", F.col("_a") + 1), groups, [label, "_pos"], "inner").withColumnRenamed("_g", "_ga")
    with_b = attach(with_a.withColumn("_pos", F.col("_b") + 1), groups, [label, "_pos"], "inner")
    usable = F.when(F.col("_ga") != F.col("_g"), F.col("_try")).otherwise(F.lit(tries + 1) + (F.lit(tries) - F.col("_try")))
    chosen = with_b.groupBy(label, "draw").agg(
        F.min("_a").alias("_a"), F.min_by("_b", usable).alias("_b")
    )
    rows = ranked.select(label, "_pos", F.col(key).alias("_k"), F.col(vec).alias("_x"))

    def side(frame, position, name):
        named = rows.withColumnRenamed("_k", name).withColumnRenamed("_x", f"{name}_vec")
        at = frame.withColumn("_pos", F.col(position) + 1)
        return attach(at, named, [label, "_pos"], "inner").drop("_pos")

    pairs = side(side(chosen, "_a", "a"), "_b", "b")
    weight = beta_symmetric(alpha, seed, "w", F.col(label), F.col("draw"))
    return pairs.withColumn("weight", weight).select(
        label, "draw", "a", "b", "weight",
        A.blend(F.col("a_vec"), F.col("b_vec"), F.col("weight")).alias("vec"),
    )
