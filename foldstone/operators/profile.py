"""Counts, distributions, anomalies and report tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import digest
from ..functions.text import delta_text, interval_text
from ..session import settle
from .ranking import _cols, attach, exact_quantiles, first_by



def value_shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share, majority): the largest share is the majority baseline."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"), F.max("n").alias("_m"))
    return counts.crossJoin(total).select(
        column, "n", (F.col("n") / F.col("_t")).alias("share"), (F.col("_m") / F.col("_t")).alias("majority")
    )


def crosstab(df: DataFrame, row: str, column: str, columns: Sequence) -> DataFrame:
    """Counts with a declared column list, zero filled."""
    return df.groupBy(row).pivot(column, list(columns)).count().fillna(0)


def distribution(df: DataFrame, value: str, by=()) -> DataFrame:
    """min, p25, median, mean, p75, max, std (sample) with exact quantiles."""
    by = _cols(by)
    quart = exact_quantiles(df, by, value, [0.25, 0.5, 0.75], ["p25", "median", "p75"])
    rest = df.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return attach(rest, quart, by, "inner").select(*by, "min", "p25", "median", "mean", "p75", "max", "std")


def grouped_stats(df: DataFrame, value: str, attributes: Sequence[str]) -> DataFrame:
    """(attribute, level, n, mean, std, min, max) for several attributes, one scan.

    The rows multiply inside the scan stage only; partial aggregates are what
    is shuffled, one per (attribute, level) and task.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("level")) for a in attributes])
    )
    return (
        df.select(pairs.alias("e"), F.col(value).alias("_x"))
        .where(F.col("_x").isNotNull() & F.col("e.level").isNotNull())
        .groupBy(F.col("e.attribute").alias("attribute"), F.col("e.level").alias("level"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
            F.min("_x").alias("min"), F.max("_x").alias("max"),
        )
    )


def header_summary(headers: DataFrame, source: str, rate: str, channels: str, subtype: str, duration: str) -> DataFrame:
    """One row per source: sorted distinct formats, durations, total hours."""
    formats = headers.groupBy(source, rate, channels, subtype).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(duration).alias("_d"), F.min(duration).alias("_lo"), F.max(duration).alias("_hi")
    )
    main = formats.groupBy(source).agg(
        F.sum("_n").alias("clips"),
        F.array_sort(F.collect_set(rate)).alias("rates"),  # formats are few per source
        F.array_sort(F.collect_set(channels)).alias("channels"),
        F.slice(F.array_sort(F.collect_set(subtype)), 1, 3).alias("subtypes"),
        F.min("_lo").alias("dur_min"),
        F.max("_hi").alias("dur_max"),
        F.round(F.sum("_d") / 3600, 2).alias("total_hours"),
    )
    median = exact_quantiles(headers, source, duration, [0.5], ["dur_med"])
    return attach(main, median, source)


def dominant(df: DataFrame, by, value: str, out: str = "dominant") -> DataFrame:
    """Most frequent value per group; the smallest one on a tie."""
    by = _cols(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(out))


def off_dominant(df: DataFrame, by, value: str, usable: Column | None = None) -> DataFrame:
    """Rows whose value differs from the dominant one of their own group."""
    rows = df if usable is None else df.where(usable)
    return attach(rows, settle(dominant(rows, by, value)), by, "inner").where(F.col(value) != F.col("dominant"))


def cell_sample(df: DataFrame, cell, key: str, n: int, seed: object) -> DataFrame:
    """At most ``n`` rows per cell without replacement, repeatable by seed."""
    return first_by(df, cell, [digest(seed, F.col(key)), F.col(key)], n)


def sampled_cell_statistic(df: DataFrame, cell, key: str, value: str, n: int, seed: object) -> DataFrame:
    """n, mean and population sd of a sample per cell, one digit."""
    by = _cols(cell)
    return cell_sample(df, by, key, n, seed).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_probed"),
        F.round(F.avg(value), 1).alias("value_mean"),
        F.round(F.stddev_pop(value), 1).alias("value_sd"),
    )


def box_statistics(df: DataFrame, level: str, value: str) -> DataFrame:
    """Quartiles and whiskers inside 1.5 IQR per level; outliers not shown."""
    rows = df.where(F.col(value).isNotNull())
    quart = exact_quantiles(rows, level, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach), F.col(value))
    return (
        attach(rows, settle(quart), level, "inner")
        .groupBy(level)
        .agg(
            F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
            F.min(inside).alias("whisker_lo"), F.max(inside).alias("whisker_hi"),
            F.count_if(inside.isNull()).alias("n_outliers"),
        )
    )


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties averaged, from running counts over distinct values."""
    from .ranking import running_total

    counts = df.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_w"))
    upto = running_total(counts, [], ["_v"], "_w", "_upto")
    ranks = upto.select(F.col("_v").alias(value), (F.col("_upto") - (F.col("_w") - 1) / 2.0).alias(out))
    return attach(df, settle(ranks), value, "inner")


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r and Spearman rho."""
    ranked = average_ranks(average_ranks(df.select(x, y), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def results_rollup(results: DataFrame) -> DataFrame:
    """Fold mean, sd, min and max of the scores per model and protocol."""
    return results.groupBy("model", "protocol").agg(
        F.avg("accuracy").alias("acc_mean"), F.stddev_samp("accuracy").alias("acc_sd"),
        F.min("accuracy").alias("acc_min"), F.max("accuracy").alias("acc_max"),
        F.avg("macro_f1").alias("f1_mean"), F.stddev_samp("macro_f1").alias("f1_sd"),
    )


def extreme_ratio(df: DataFrame, cell, value: str) -> DataFrame:
    """Largest over smallest cell mean, also in dB: which factor drives a measure."""
    means = df.groupBy(*_cols(cell)).agg(F.avg(value).alias("_m"))
    ratio = F.max("_m") / F.min("_m")
    return means.agg(
        F.max("_m").alias("highest"), F.min("_m").alias("lowest"), ratio.alias("ratio"), (20 * F.log10(ratio)).alias("decibel")
    )


def fold_table(results: DataFrame, metric: str = "accuracy") -> DataFrame:
    """(fold, model, value): per-fold rows plus ``sd`` and ``range`` rows per model."""
    rows = results.select(F.col("fold").cast("string").alias("fold"), "model", F.col(metric).alias("value"))
    stats = results.groupBy("model").agg(
        F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("sd"), (F.max(metric) - F.min(metric)).alias("range")
    )
    lines = F.array(*[F.struct(F.lit(n).alias("fold"), F.col(n).alias("value")) for n in ("sd", "range")])
    return rows.unionByName(
        stats.select("model", F.explode(lines).alias("e")).select("e.fold", "model", "e.value")
    )


def composition(rows: DataFrame, fold: str, source: str, sources: Sequence[str], base: str, split: str = "split") -> DataFrame:
    """Per fold: train rows of each source, test rows, and test rows from outside the base source."""
    train, test = F.col(split) == "train", F.col(split) == "test"
    return rows.groupBy(fold).agg(
        *[F.count_if(train & (F.col(source) == s)).alias(f"train_{s}") for s in sources],
        F.count_if(test).alias("test_rows"), F.count_if(test & (F.col(source) != base)).alias("test_external"),
    )


def fold_dispersion(results: DataFrame, by: str, metric: str) -> DataFrame:
    """Sample sd over folds, 0 where there is one fold."""
    return results.groupBy(by).agg(
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("fold_sd"), F.count(F.lit(1)).alias("n_folds")
    )


def best_per_group(df: DataFrame, by, score: str, ordinal: str, keep: Sequence[str]) -> DataFrame:
    """The row with the highest score; the first declared one wins ties."""
    pick = F.max_by(F.struct(*keep, score), F.struct(F.col(score), -F.col(ordinal)))
    return df.groupBy(*_cols(by)).agg(pick.alias("_p")).select(*_cols(by), *[f"_p.{c}" for c in [*keep, score]])


def first_rows(df: DataFrame, by, key: str, keep: Sequence[str]) -> DataFrame:
    """The first row of each group in key order, as a mergeable aggregate."""
    pick = F.min_by(F.struct(key, *keep), F.col(key))
    return df.groupBy(*_cols(by)).agg(pick.alias("_p")).select(*_cols(by), *[f"_p.{c}" for c in [key, *keep]])


def step_gain(df: DataFrame, step: str, metric: str, by=()) -> DataFrame:
    """Change to the previous step in points; one row per configuration."""
    window = Window.partitionBy(*(_cols(by) or [F.lit(0)])).orderBy(step)
    return df.withColumn("gain_pp", F.round((F.col(metric) - F.lag(metric).over(window)) * 100, 2))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def last_n(log: DataFrame, subset: Sequence[str], order: str, n: int) -> DataFrame:
    """Keep the first row per subset, then the last ``n`` by ``order``, ascending."""
    kept = first_rows(log, subset, order, [c for c in log.columns if c not in {*subset, order}])
    return kept.orderBy(F.desc(order), *[F.desc(c) for c in subset]).limit(n).orderBy(order, *subset)


def report_pivot(df: DataFrame, row, column: str, columns: Sequence, value: Column) -> DataFrame:
    return df.groupBy(*_cols(row)).pivot(column, list(columns)).agg(value)


def duplicated(df: DataFrame, key) -> DataFrame:
    keys = _cols(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def candidate_grid(spark, axes: dict[str, Sequence]) -> DataFrame:
    """Every combination of the axes with its ordinal; last axis varies fastest."""
    from itertools import product

    rows = [(i, *combo) for i, combo in enumerate(product(*axes.values()))]
    return spark.createDataFrame(rows, ["ordinal", *axes])


def one_axis_grid(spark, baseline: dict[str, object], axes: dict[str, Sequence]) -> DataFrame:
    """The baseline and every single-axis change of it, as text columns."""
    rows = [("baseline", *[str(v) for v in baseline.values()])]
    for axis, values in axes.items():
        for v in values:
            rows.append((axis, *[str(x) for x in {**baseline, axis: v}.values()]))
    return spark.createDataFrame(rows, ["axis", *baseline])


def log_rows(log: DataFrame, tag: str, models: Sequence[str], fold: str = "pooled") -> DataFrame:
    """Log lines of one fold kind, notes tag and model list."""
    return log.where(
        (F.col("fold") == fold) & F.contains(F.coalesce("notes", F.lit("")), F.lit(tag)) & F.col("model").isin(list(models))
    )


def with_interval_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", interval_text(F.col("point"), F.col("lo"), F.col("hi")))


def with_delta_text(df: DataFrame) -> DataFrame:
    return df.withColumn("text", delta_text(F.col("delta"), F.col("lo"), F.col("hi")))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
