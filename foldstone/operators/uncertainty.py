"""Cluster bootstrap and paired tests from sufficient statistics.

A replicate only needs how often each group was drawn, so the rows are
counted once per (group, true, predicted) and every replicate is a weighted
sum of that small table. The cost does not depend on the number of rows; for
draws of single rows, :func:`row_bootstrap` does not even depend on that of groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binomial import sign_test, split_draw
from ..functions.hashing import hash60
from ..session import materialise, settle
from ..vocab import N_BOOT, SEED
from .evaluate import PRED, TRUE, scores
from .ranking import _cols, attach, hash_rank

#: Built-in metrics: columns of the ``scores`` table.
METRICS = ("macro_f1", "accuracy", "weighted_f1")

Metric = str | Callable[[DataFrame, list[str]], DataFrame]


def metric_table(counts: DataFrame, by: list[str], metric: Metric) -> DataFrame:
    """``by`` + ``value``. A callable gets (counts, by) and returns that shape."""
    if callable(metric):
        return metric(counts, by)
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; expected one of {sorted(METRICS)}")
    return scores(counts, by).select(*by, F.col(metric).alias("value"))


def pandas_metric(fn: Callable) -> Callable[[DataFrame, list[str]], DataFrame]:
    """Wrap ``fn(true, pred, weight) -> float`` over the cells of one replicate.

    A replicate has at most labels^2 cells, whatever the number of rows.
    """

    def apply(counts: DataFrame, by: list[str]) -> DataFrame:
        kinds = "".join(f"{c} {counts.schema[c].dataType.simpleString()}, " for c in by)

        def one(pdf):
            head = {c: [pdf[c].iloc[0]] for c in by}
            return pd.DataFrame({**head, "value": [float(fn(pdf[TRUE], pdf[PRED], pdf["n"]))]})

        return counts.groupBy(*by).applyInPandas(one, f"{kinds}value double")

    return apply


#: Groups whose cells and draws meet in one task are this many draws, about, and draws that a task makes at once.
BLOCK_DRAWS = 4_000_000
SLOTS = 1 << 16
#: Levels that share the hashes of a slot, about.
LEVELS = 64


def _hashes(seed, b: int, lo: int, hi: int) -> np.ndarray:
    """:func:`hash60` of (seed, b, slot) for the slots ``lo`` to ``hi``."""
    head = hashlib.md5(f"{seed}|{b}|".encode())
    out = []
    for slot in range(lo, hi):
        one = head.copy()
        one.update(b"%d" % slot)
        out.append(one.digest())
    return (np.frombuffer(b"".join(out), ">u8")[::2] >> np.uint64(4)).astype(np.int64)


def draw_groups(sizes: DataFrame, n_boot: int, seed, width: int) -> DataFrame:
    """(_by, _block, b, picks): as many hashed draws with replacement a replicate as a level has groups.

    ``sizes`` is (_by, _size). The draws of a replicate that fall in one block
    of ``width`` groups are one row, as positions of two or four bytes in it.
    """
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    row = sizes.agg(F.sum("_size"), F.count(F.lit(1))).first()
    rows = (row[0] or 0) // SLOTS * n_boot + row[1] * n_boot
    # the rows are small and each is up to SLOTS draws: a fixed number of parts, which AQE does not merge
    parts = max(1, min((row[0] or 0) * n_boot // 500_000 + 1, rows, 100_000))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.col("_size") - 1, F.lit(SLOTS).cast("bigint"))
    some = F.pmod(F.xxhash64("_by"), F.lit(-(-row[1] // LEVELS) or 1)).alias("some")
    # a slot's hash is that of all levels: it is made once for some of them
    work = sizes.select("_by", "_size", some, F.explode(chunks).alias("lo")).groupBy("lo", "some").agg(F.collect_list(F.struct("_by", "_size")).alias("levels"))
    work = work.select("lo", "levels", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b")).repartition(parts, "lo", "b")

    def draw(batches):
        for part in batches:
            out = []
            for levels, lo, b in zip(part["levels"], part["lo"].tolist(), part["b"].tolist()):
                levels = [(v["_by"], v["_size"]) for v in levels]
                hashed = _hashes(seed, b, lo, min(lo + SLOTS, max(size for _, size in levels)))
                for by, size in levels:
                    picks = np.sort(hashed[:size - lo] % size)
                    first = np.flatnonzero(np.concatenate([[True], picks[1:] // width != picks[:-1] // width]))
                    for x in np.split(picks, first[1:]):
                        block = int(x[0]) // width
                        out.append((by, block, b, (x - block * width).astype(kind).tobytes()))
                if len(out) > 1000:
                    yield pd.DataFrame(out, columns=["_by", "_block", "b", "picks"])
                    out = []
            if out:
                yield pd.DataFrame(out, columns=["_by", "_block", "b", "picks"])

    return work.mapInPandas(draw, "_by string, _block bigint, b bigint, picks binary")


def replicate_counts(
    counts: DataFrame, group: str, n_boot: int = N_BOOT, seed=SEED, by=(), configs: str | None = None
) -> DataFrame:
    """(by, b, true, pred, n) for every replicate.

    ``by`` levels get draws of their own groups; ``configs`` share one set of
    draws, which is what makes a comparison between them paired.

    Draws and cells meet in blocks of groups, where a replicate's counts are a
    product of two matrices: how often each group was drawn, and its cells. A
    block returns one row a replicate and cell, however many groups it holds.
    """
    by = _cols(by)
    extra = [configs] if configs else []
    groups = hash_rank(counts.select(*by, group).distinct(), by, group, out="_pos")
    ranked = attach(counts, groups, [*by, group], "inner")
    width = max(16, BLOCK_DRAWS // n_boot)
    kind = np.uint16 if width <= 1 << 16 else np.uint32
    # levels travel as one text, which null values have too
    level = (F.to_json(F.struct(*by)) if by else F.lit("")).alias("_by")
    cells = ranked.select(level, ((F.col("_pos") - 1) / width).cast("bigint").alias("_block"), (F.col("_pos") - 1).alias("pick"),
                          F.struct(*by, *extra, TRUE, PRED).alias("cell"), "n")
    # cells are numbered inside their block, in the order of their values
    numbered = cells.withColumn("_code", F.dense_rank().over(Window.partitionBy("_by", "_block").orderBy("cell")) - 1)
    stored = materialise(numbered, "cells")
    sizes = settle(stored.groupBy("_by").agg((F.max("pick") + 1).alias("_size")))
    drawn = draw_groups(sizes, n_boot, seed, width)

    def multiply(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in ("_by", "_block", "b", "_code", "n")})
        start = int(right["_block"].iat[0]) * width
        left = left.sort_values("b", ignore_index=True)
        order = np.argsort(right["_code"].to_numpy(), kind="stable")
        code, pos, n = (right[c].to_numpy()[order] for c in ("_code", "pick", "n"))
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        pos = pos - start
        found = []
        for lo in range(0, n_boot, 128):  # some replicates at a time
            a, z = np.searchsorted(left["b"].to_numpy(), [lo, lo + 128])
            picks = [np.frombuffer(x, kind).astype(np.int64) for x in left["picks"].iloc[a:z]]
            if not picks:
                continue
            at = np.repeat(left["b"].to_numpy()[a:z] - lo, [len(x) for x in picks]) * width + np.concatenate(picks)
            times = np.bincount(at, minlength=128 * width).reshape(128, width)
            # integers as they are: sums of any size stay exact
            sums = np.add.reduceat(times[:, pos] * n[None, :], first, axis=1)
            b, c = np.nonzero(sums)
            found.append((b + lo, code[first][c], sums[b, c]))
        b, c, n = (np.concatenate(v) for v in zip(*found))
        return pd.DataFrame({"_by": left["_by"].iat[0], "_block": right["_block"].iat[0], "b": b, "_code": c, "n": n})

    parts = drawn.groupBy("_by", "_block").cogroup(stored.select("_by", "_block", "pick", "_code", "n").groupBy("_by", "_block")).applyInPandas(
        multiply, "_by string, _block bigint, b bigint, _code int, n bigint"
    )
    names = settle(stored.select("_by", "_block", "_code", "cell").distinct())
    found = parts.join(names, ["_by", "_block", "_code"])
    return found.groupBy(*[F.col(f"cell.{c}").alias(c) for c in [*by, *extra]], "b", F.col(f"cell.{TRUE}").alias(TRUE), F.col(f"cell.{PRED}").alias(PRED)).agg(
        F.sum("n").alias("n")
    )


def _summary(draws: DataFrame, by: list[str], alpha: float) -> DataFrame:
    # n_boot values per cell: a bounded group, so the built-in is safe
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return draws.groupBy(*by).agg(q.alias("_q"), F.stddev_samp("value").alias("se")).select(
        *by, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"), "se"
    )


def group_counts(pred: DataFrame, group: str, extra=()) -> DataFrame:
    return pred.groupBy(*_cols(extra), group, TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))


def cluster_bootstrap(
    pred: DataFrame,
    group: str,
    metric: Metric = "macro_f1",
    n_boot: int = N_BOOT,
    alpha: float = 0.05,
    seed=SEED,
    by=(),
) -> DataFrame:
    """point, lo, hi, se, n_groups: an interval that resamples whole groups."""
    by = _cols(by)
    counts = settle(group_counts(pred, group, by))
    point = metric_table(counts.groupBy(*by, TRUE, PRED).agg(F.sum("n").alias("n")), by, metric)
    draws = metric_table(replicate_counts(counts, group, n_boot, seed, by), [*by, "b"], metric)
    size = counts.groupBy(*by).agg(F.count_distinct(group).alias("n_groups"))
    table = attach(point.withColumnRenamed("value", "point"), _summary(draws, by, alpha), by)
    return attach(table, size, by).select(*by, "point", "lo", "hi", "se", "n_groups")


def row_bootstrap(
    pred: DataFrame, metric: Metric = "macro_f1", n_boot: int = N_BOOT, alpha: float = 0.05, seed=SEED, by=()
) -> DataFrame:
    """point, lo, hi, se, n: an interval that resamples single rows.

    Rows with one pair of labels are alike, so a replicate is a multinomial
    draw over the label pairs. It is split in two by exact binomial draws until
    each pair has its count: the cost depends on the pairs and not on the rows.
    Every draw is derived from (seed, by, replicate, node).
    """
    by = _cols(by)
    counts = settle(pred.groupBy(*by, TRUE, PRED).agg(F.count(F.lit(1)).alias("n")))
    # one row a level, with its pairs in order: at most labels^2 of them
    lists = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(TRUE, PRED, "n"))).alias("_cells"))
    parts = max(1, n_boot // 100)
    chunks = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    label = F.to_json(F.struct(*by)) if by else F.lit("")
    work = lists.select(*by, label.alias("_by"), F.transform("_cells", lambda c: c["n"]).alias("_w"), "_cells", chunks.alias("_part")).repartition(parts, "_part")

    @F.pandas_udf("array<struct<b:bigint,ns:array<bigint>>>")
    def drawn(levels: pd.Series, weights: pd.Series, part: pd.Series) -> pd.Series:
        out = []
        for level, w, i in zip(levels, weights, part):
            w = [int(x) for x in w]
            out.append([{"b": b, "ns": split_draw(sum(w), w, seed, level, b)} for b in range(i, n_boot, parts)])
        return pd.Series(out)

    rows = work.select(*by, "_cells", F.explode(drawn("_by", "_w", "_part")).alias("_d")).select(
        *by, F.col("_d.b").alias("b"), F.explode(F.arrays_zip("_cells", F.col("_d.ns").alias("ns"))).alias("_c")
    )
    cells = rows.select(*by, "b", F.col(f"_c._cells.{TRUE}").alias(TRUE), F.col(f"_c._cells.{PRED}").alias(PRED), F.col("_c.ns").alias("n")).where("n > 0")
    draws = metric_table(cells, [*by, "b"], metric)
    point = metric_table(counts, by, metric).withColumnRenamed("value", "point")
    size = counts.groupBy(*by).agg(F.sum("n").alias("n"))
    table = attach(point, _summary(draws, by, alpha), by)
    return attach(table, size, by).select(*by, "point", "lo", "hi", "se", "n")


def paired_comparisons(
    pred: DataFrame,
    group: str,
    config: str,
    control: str,
    metric: Metric = "macro_f1",
    n_boot: int = N_BOOT,
    alpha: float = 0.05,
    seed=SEED,
) -> DataFrame:
    """Every configuration against ``control`` on the same draws, in one job.

    ``pred`` is long: one row per (config, observation).
    """
    counts = settle(group_counts(pred, group, config))
    point = metric_table(
        counts.groupBy(config, TRUE, PRED).agg(F.sum("n").alias("n")), [config], metric
    )
    drawn = replicate_counts(counts, group, n_boot, seed, configs=config)
    draws = metric_table(drawn, [config, "b"], metric)
    base = draws.where(F.col(config) == control).select("b", F.col("value").alias("_base"))
    diff = (
        draws.where(F.col(config) != control)
        .join(base, "b")
        .select(config, (F.col("value") - F.col("_base")).alias("value"))
    )
    tails = diff.groupBy(config).agg(
        F.avg((F.col("value") <= 0).cast("double")).alias("_le"),
        F.avg((F.col("value") >= 0).cast("double")).alias("_ge"),
    )
    at_control = point.where(F.col(config) == control).select(F.col("value").alias("_base"))
    delta = (
        point.where(F.col(config) != control)
        .crossJoin(at_control)  # one row: the control's score
        .select(config, "value", (F.col("value") - F.col("_base")).alias("delta"))
    )
    table = attach(attach(delta, _summary(diff, [config], alpha), config), tails, config)
    return table.select(
        config,
        F.col("value").alias("point"),
        "delta",
        "lo",
        "hi",
        F.least(F.lit(1.0), 2.0 * F.least("_le", "_ge")).alias("p_value"),
        ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("significant"),
    )


def to_long(paired: DataFrame, group: str, columns: dict[str, str]) -> DataFrame:
    """(config, group, y_true, y_pred) from one row per observation."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(n).alias("config"), F.col(c).alias("p")) for n, c in columns.items()])
    )
    return paired.select(group, TRUE, cells.alias("e")).select(
        F.col("e.config").alias("config"), group, TRUE, F.col("e.p").alias(PRED)
    )


def paired_bootstrap(pred: DataFrame, group: str, a: str, b: str, **kwargs) -> DataFrame:
    """Difference a - b between two prediction columns of one table."""
    long = to_long(pred, group, {"a": a, "b": b})
    return paired_comparisons(long, group, "config", "b", **kwargs).drop("config", "point")


def mcnemar(pred: DataFrame, a: str, b: str, by=()) -> DataFrame:
    """Exact test on observations where just one of two models is right."""
    by = _cols(by)
    right_a, right_b = F.col(a) == F.col(TRUE), F.col(b) == F.col(TRUE)
    sums = pred.groupBy(*by).agg(
        F.count_if(right_a & ~right_b).alias("only_a_correct"),
        F.count_if(~right_a & right_b).alias("only_b_correct"),
    )
    return sums.withColumn("p_value", sign_test(F.col("only_a_correct"), F.col("only_b_correct"))).withColumn(
        "significant", F.col("p_value") < 0.05
    )

