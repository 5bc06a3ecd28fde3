"""Fold tables that keep groups, attributes or sources apart.

A compact table (key, fold) says in which fold a row is tested; the long table
(protocol, fold, key, split) is derived from it by one ``explode``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from ..vocab import ARMS, MERGED_PROTOCOLS, N_SPLITS, PROTOCOLS, SEED
from .ranking import _cols, attach, hash_rank, ordered_rank, size_rank, vocabulary


def _sizes(df: DataFrame, group: str, by=()) -> DataFrame:
    return df.groupBy(*_cols(by), group).agg(F.count(F.lit(1)).alias("n"))


def snake_folds(df: DataFrame, group: str, k: int = N_SPLITS, by=()) -> DataFrame:
    """(by, group, fold): groups by size, dealt out 0..k-1, k-1..0, 0..k-1, ..."""
    step = (F.col("rank") - 1) % (2 * k)
    ranked = size_rank(_sizes(df, group, by), "n", group, by)
    return ranked.select(
        *_cols(by), group, F.when(step < k, step).otherwise(2 * k - 1 - step).cast("int").alias("fold")
    )


def _below(loads, size: int, value):
    """Groups of one size that greedy dealing gives to folds while their load is below ``value``."""
    return sum(max(0, -(-(value - load) // size)) for load in loads)


def _water_level(loads: list[int], size: int, m: int) -> list[int]:
    """Loads after ``m`` groups of one size were each given to the lightest fold, the first of equal ones."""
    lo, hi = min(loads), max(loads) + size * (m + 1)
    while hi - lo > 1:  # the largest load at which no more than m groups are gone
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if _below(loads, size, mid) <= m else (lo, mid)
    after = [load + size * max(0, -(-(lo - load) // size)) for load in loads]
    left = m - _below(loads, size, lo)
    for i, load in enumerate(after):
        if left and load == lo:
            after[i], left = load + size, left - 1
    return after


def greedy_folds(df: DataFrame, group: str, k: int = N_SPLITS) -> DataFrame:
    """(group, fold): largest group first, each to the lightest fold so far.

    Groups of one size are alike: the n-th of them goes where the n-th least of
    the loads ``L_i + t * size`` is. So only the distinct sizes, of which a
    table of N rows has less than sqrt(2 N), are walked through in order; every
    group then finds its fold from its place within its size.
    """
    sizes = settle(_sizes(df, group).where(F.col(group).isNotNull()))
    listed = sizes.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    if (total := sum(r["m"] for r in listed)) < k:
        raise ValueError(f"{total} groups cannot fill {k} folds")
    loads, starts = [0] * k, []
    for r in listed:
        starts.append((r["n"], list(loads)))
        loads = _water_level(loads, r["n"], r["m"])
    table = df.sparkSession.createDataFrame(starts, "n bigint, _loads array<bigint>")

    @F.pandas_udf("int")
    def place(loads: pd.Series, size: pd.Series, rank: pd.Series) -> pd.Series:
        if not len(loads):
            return pd.Series([], dtype="int32")
        at, s, j = np.stack(loads.to_numpy()), size.to_numpy()[:, None], rank.to_numpy() - 1
        gone = lambda v: np.maximum(0, -(-(v[:, None] - at) // s)).sum(1)
        lo, hi = at.min(1), at.max(1) + s[:, 0] * (j + 2)
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            ok = gone(mid) <= j
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid)
        # the folds whose next group comes at this load, in their order
        level = lo[:, None]
        now = (level >= at) & ((level - at) % s == 0)
        return pd.Series((np.cumsum(now, 1) <= (j - gone(lo))[:, None]).sum(1).astype(np.int32))

    ranked = ordered_rank(sizes, "n", [group], out="_rank").join(table, "n")
    return ranked.select(group, place("_loads", "n", "_rank").alias("fold"))


def group_folds(df: DataFrame, group: str, k: int = N_SPLITS, method: str = "snake") -> DataFrame:
    """No group on both sides of any fold; the same folds at every size of table."""
    if method not in ("greedy", "snake"):
        raise ValueError(f"unknown method {method!r}")
    return (greedy_folds if method == "greedy" else snake_folds)(df, group, k)


def with_group_fold(df: DataFrame, group: str, k: int = N_SPLITS, method: str = "snake") -> DataFrame:
    """``df`` plus the fold in which each row is held out."""
    return attach(df, settle(group_folds(df, group, k, method)), group, "inner")


def stratified_folds(
    df: DataFrame, label: str, key: str, k: int = N_SPLITS, seed=SEED
) -> DataFrame:
    """``df`` plus a fold balanced within each label; groups leak on purpose."""
    ranked = hash_rank(df, label, key, seed, out="_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def nested_folds(train_folds: DataFrame, group: str, k: int) -> DataFrame:
    """(outer, group, fold): inner group folds inside each outer train side.

    ``train_folds`` has one row per row and its own outer test ``fold``. The
    groups are counted once; an outer fold only leaves its test groups out.
    """
    outer_folds = vocabulary(train_folds, "fold")
    sizes = train_folds.groupBy(group, "fold").agg(F.count(F.lit(1)).alias("n"))
    spread = (
        sizes.withColumn("outer", F.explode(F.array(*[F.lit(f) for f in outer_folds])))
        .where(F.col("outer") != F.col("fold"))
        .groupBy("outer", group)
        .agg(F.sum("n").alias("n"))
    )
    step = (F.col("rank") - 1) % (2 * k)
    return size_rank(spread, "n", group, ["outer"]).select(
        "outer", group, F.when(step < k, step).otherwise(2 * k - 1 - step).cast("int").alias("fold")
    )


def long_table(assigned: DataFrame, protocol: str, key: str, k: int) -> DataFrame:
    """(protocol, fold, key, split) for k folds from one test fold per row."""
    return (
        assigned.select(key, F.col("fold").alias("_own"))
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .select(
            F.lit(protocol).alias("protocol"),
            "fold",
            key,
            F.when(F.col("_own") == F.col("fold"), "test").otherwise("train").alias("split"),
        )
    )


def attribute_holdout(
    df: DataFrame, key: str, train_if: Column, test_if: Column, protocol: str = "statement_holdout"
) -> DataFrame:
    """One fold: train where one condition holds, test where the other does."""
    side = F.when(train_if, "train").when(test_if, "test")
    return df.select(
        F.lit(protocol).alias("protocol"), F.lit(0).alias("fold"), key, side.alias("split")
    ).where(F.col("split").isNotNull())


def attribute_holdout_disjoint(
    assigned: DataFrame,
    key: str,
    k: int,
    train_if: Column,
    test_if: Column,
    protocol: str = "statement_holdout_si",
) -> DataFrame:
    """Group folds and an attribute at once; a row may be on neither side."""
    marked = assigned.select(
        key, F.col("fold").alias("_own"), train_if.alias("_tr"), test_if.alias("_te")
    ).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = F.col("_own") == F.col("fold")
    side = F.when(held & F.col("_te"), "test").when(~held & F.col("_tr"), "train")
    return marked.select(
        F.lit(protocol).alias("protocol"), "fold", key, side.alias("split")
    ).where(F.col("split").isNotNull())


def leave_one_source_out(
    df: DataFrame,
    key: str,
    source: str = "source",
    order: Sequence[str] | None = None,
    protocol: str = "corpus_holdout",
) -> DataFrame:
    """One fold per source present, numbered in declared order."""
    present = vocabulary(df, source)
    declared = [s for s in order if s in present] if order is not None else present
    entries = F.array(
        *[F.struct(F.lit(i).alias("fold"), F.lit(s).alias("src")) for i, s in enumerate(declared)]
    )
    return df.select(key, F.col(source).alias("_s"), F.explode(entries).alias("e")).select(
        F.lit(protocol).alias("protocol"),
        F.col("e.fold").alias("fold"),
        key,
        F.when(F.col("_s") == F.col("e.src"), "test").otherwise("train").alias("split"),
    )


def assigned_folds(
    df: DataFrame, key: str, group: str, label: str, train_if: Column, test_if: Column, k: int = N_SPLITS, seed=SEED, method: str = "snake"
) -> DataFrame:
    """``df`` plus all that decides on its places in every single-source protocol: a row a row."""
    dealt = settle(group_folds(df, group, k, method)).withColumnRenamed("fold", "_own")
    grouped = attach(df.withColumns({"_tr": train_if, "_te": test_if}), dealt, group)  # a group without a fold is in no group protocol
    return stratified_folds(grouped, label, key, k, seed).withColumnRenamed("fold", "_mixed")


def _protocol_cells(k: int) -> list[tuple[str, int, Column]]:
    """(protocol, fold, side or null) of every fold of the single-source protocols, over columns of :func:`assigned_folds`."""
    names, own, mixed, tr, te = PROTOCOLS, F.col("_own"), F.col("_mixed"), F.col("_tr"), F.col("_te")
    side = lambda held: F.when(held, "test").when(~held, "train")
    return [
        *[(names[0], f, side(own == f)) for f in range(k)],
        *[(names[1], f, side(mixed == f)) for f in range(k)],
        (names[2], 0, F.when(tr, "train").when(te, "test")),
        *[(names[3], f, F.when((own == f) & te, "test").when((own != f) & tr, "train")) for f in range(k)],
    ]


def protocol_rows(assigned: DataFrame, columns: Sequence[str | Column], k: int = N_SPLITS) -> DataFrame:
    """(protocol, fold, columns, split) of an assigned table."""
    cells = F.array(*[F.struct(F.lit(p).alias("protocol"), F.lit(f).alias("fold"), s.alias("split")) for p, f, s in _protocol_cells(k)])
    return assigned.select(*columns, F.explode(cells).alias("_e")).where(F.col("_e.split").isNotNull()).select(
        "_e.protocol", "_e.fold", *assigned.select(*columns).columns, "_e.split"
    )


def build_folds(
    df: DataFrame,
    key: str,
    group: str,
    label: str,
    train_if: Column,
    test_if: Column,
    k: int = N_SPLITS,
    seed=SEED,
    method: str = "snake",
) -> DataFrame:
    """Every single-source protocol as one long table."""
    return protocol_rows(assigned_folds(df, key, group, label, train_if, test_if, k, seed, method), [key], k)


def protocol_counts(assigned: DataFrame, by: Sequence[str], k: int = N_SPLITS) -> DataFrame:
    """(protocol, fold, split, by, n): rows are counted by their places before these are spread out."""
    counts = assigned.groupBy(*by, "_own", "_mixed", "_tr", "_te").agg(F.count(F.lit(1)).alias("n"))
    return protocol_rows(counts, [*by, "n"], k).groupBy("protocol", "fold", "split", *by).agg(F.sum("n").alias("n"))


def build_merged_folds(
    df: DataFrame,
    key: str,
    group: str,
    label: str,
    source: str = "source",
    order: Sequence[str] | None = None,
    k: int = N_SPLITS,
    seed=SEED,
    method: str = "snake",
) -> DataFrame:
    """Every multi-source protocol as one long table."""
    names = MERGED_PROTOCOLS
    return (
        long_table(with_group_fold(df, group, k, method), names[0], key, k)
        .unionByName(leave_one_source_out(df, key, source, order, names[1]))
        .unionByName(long_table(stratified_folds(df, label, key, k, seed), names[2], key, k))
    )


def ordered_folds(folds: DataFrame, key: str, protocols: Sequence[str]) -> DataFrame:
    """Presentation order: declared protocol order, fold, side, key."""
    place = F.array_position(F.array(*[F.lit(p) for p in protocols]), F.col("protocol"))
    return folds.orderBy(place, "fold", "split", key)


def _one_fold(folds: DataFrame, protocol: str, fold: int) -> DataFrame:
    chosen = folds.where((F.col("protocol") == protocol) & (F.col("fold") == fold))
    if not chosen.limit(1).count():
        raise ValueError(f"no fold {fold} of protocol {protocol!r}")
    return chosen


def tag_split(df: DataFrame, folds: DataFrame, protocol: str, fold: int, key: str) -> DataFrame:
    """Rows of one fold with their ``split``."""
    return df.join(_one_fold(folds, protocol, fold).select(key, "split"), key)


def get_split(
    df: DataFrame, folds: DataFrame, protocol: str, fold: int, key: str
) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one fold."""
    chosen = _one_fold(folds, protocol, fold)

    def side(name):
        return df.join(chosen.where(F.col("split") == name).select(key), key, "left_semi")

    return side("train"), side("test")


def training_subset(
    df: DataFrame, folds: DataFrame, key: str, protocol: str = PROTOCOLS[0], fold: int = 0
) -> DataFrame:
    """Only the train rows of one fold: the rows an analysis may look at."""
    return get_split(df, folds, protocol, fold, key)[0]


def foreign_test_sources(
    test: DataFrame, index: DataFrame, key: str, base: str, source: str = "source"
) -> DataFrame:
    """Sources other than the base on a test side; must come back empty."""
    return test.select(key).join(index, key).where(F.col(source) != base).select(source).distinct()


def augmented_train(
    index: DataFrame,
    folds: DataFrame,
    protocol: str,
    fold: int,
    key: str,
    sources: Sequence[str],
    base: str,
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """Frozen base train side plus all rows of chosen other sources; test untouched."""
    requested = list(sources)
    if base in requested:
        raise ValueError(f"{base} is always on the train side; list other sources only")
    unknown = set(requested) - set(vocabulary(index, source))
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    train, test = get_split(index, folds, protocol, fold, key)
    foreign = [r[0] for r in foreign_test_sources(test, index, key, base, source).collect()]
    if foreign:
        raise ValueError(f"the test side holds rows of {sorted(foreign)}")
    if requested:
        train = train.unionByName(index.where(F.col(source).isin(requested)))
    return train, test


def arm_table(
    folds: DataFrame,
    index: DataFrame,
    key: str,
    base: str,
    protocol: str = PROTOCOLS[0],
    source: str = "source",
) -> DataFrame:
    """(arm, fold, stage, key) of all four training arms.

    Single-stage arms have only stage2 and test rows. The two two-stage arms
    share their data; ``freeze_backbone`` is an attribute of the arm.
    """
    own = folds.where(F.col("protocol") == protocol).select("fold", key, "split")
    outside = index.where(F.col(source) != base).select(key)
    leaked = own.where(F.col("split") == "test").join(outside, key, "left_semi").limit(1).count()
    if leaked:
        raise ValueError("a test side holds rows from outside the base source")
    fold_ids = F.array(*[F.lit(f) for f in vocabulary(own, "fold")])
    external = outside.select(F.explode(fold_ids).alias("fold"), key, F.lit("external").alias("split"))
    base_only, pooled, two, frozen = ARMS

    def cells(*pairs):
        return F.array(
            *[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("stage")) for a, s in pairs]
        )

    places = (
        F.when(F.col("split") == "test", cells(*[(a, "test") for a in ARMS]))
        .when(
            F.col("split") == "train",
            cells(
                (base_only, "stage2"), (pooled, "stage2"), (two, "stage2"), (frozen, "stage2"),
                (two, "stage1"), (frozen, "stage1"),
            ),
        )
        .otherwise(cells((pooled, "stage2"), (two, "stage1"), (frozen, "stage1")))
    )
    return (
        own.unionByName(external)
        .select("fold", key, F.explode(places).alias("e"))
        .select("e.arm", "fold", "e.stage", key)
    )


def arm_summary(arms: DataFrame) -> DataFrame:
    return (
        arms.groupBy("arm", "fold")
        .agg(*[F.count_if(F.col("stage") == s).alias(s) for s in ("stage1", "stage2", "test")])
        .withColumn("freeze_backbone", F.col("arm") == ARMS[3])
    )


def summarise_folds(
    folds: DataFrame,
    meta: DataFrame,
    key: str,
    group: str,
    label: str,
    attribute: Column,
    counted_labels: Sequence[str] = (),
    source: str | None = None,
) -> DataFrame:
    """Composition of every fold.

    The joined rows are reduced once to one row per distinct combination of
    the reported columns; all distinct counts read that stored table, and no
    group list is ever collected.
    """
    sources = F.col(source) if source else F.lit(None).cast("string")
    facts = meta.select(
        key, F.col(group).alias("_g"), F.col(label).alias("_l"), attribute.alias("_a"), sources.alias("_s")
    )
    cells = settle(
        folds.join(facts, key)
        .groupBy("protocol", "fold", "split", "_g", "_l", "_a", "_s")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cell = ["protocol", "fold"]
    test, train = F.col("split") == "test", F.col("split") == "train"

    def sides(column):
        """One row per distinct value: on which sides it occurs."""
        return cells.groupBy(*cell, F.col(column).alias("_v")).agg(
            F.max(train.cast("int")).alias("_tr"), F.max(test.cast("int")).alias("_te")
        )

    return _composition(cells, sides, counted_labels, source)


def summarise_protocols(
    assigned: DataFrame,
    group: str,
    label: str,
    attribute: Column,
    counted_labels: Sequence[str] = (),
    source: str | None = None,
    k: int = N_SPLITS,
) -> DataFrame:
    """:func:`summarise_folds` of the single-source protocols, from one row a row.

    The places of a row are bits of a number. Rows are counted by places and
    the few reported columns, and every group is reduced to the places of any of
    its rows, before places are spread out: no row is repeated for its folds.
    """
    sources = F.col(source) if source else F.lit(None).cast("string")
    cells = _protocol_cells(k)
    # 31 folds with two bits each make a number
    masks = []
    for lo in range(0, len(cells), 31):
        bits = F.lit(0).cast("bigint")
        for i, (_, _, side) in enumerate(cells[lo:lo + 31]):
            bits = bits.bitwiseOR(F.when(side == "test", F.lit(2 << 2 * i)).when(side == "train", F.lit(1 << 2 * i)).otherwise(F.lit(0)).cast("bigint"))
        masks.append(bits.alias(f"_m{lo}"))
    rows = assigned.select(F.col(group).alias("_g"), F.col(label).alias("_l"), attribute.alias("_a"), sources.alias("_s"), *masks)
    names = [f"_m{lo}" for lo in range(0, len(cells), 31)]
    groups = settle(rows.groupBy("_g").agg(*[F.bit_or(m).alias(m) for m in names]))
    counts = settle(rows.groupBy("_l", "_a", "_s", *names).agg(F.count(F.lit(1)).alias("_n")))

    def bit(i: int, b: int) -> Column:
        return F.getbit(f"_m{i // 31 * 31}", F.lit(2 * (i % 31) + b)).cast("int")

    spread = F.explode(F.array(*[
        F.struct(F.lit(p).alias("protocol"), F.lit(f).alias("fold"), bit(i, 0).alias("_tr"), bit(i, 1).alias("_te")) for i, (p, f, _) in enumerate(cells)
    ]))
    placed = lambda df, *columns: df.select(*columns, spread.alias("_e")).select(*columns, "_e.*").where("_tr + _te > 0")

    def sides(column):
        values = groups.withColumnRenamed("_g", "_v") if column == "_g" else counts.groupBy(F.col(column).alias("_v")).agg(*[F.bit_or(m).alias(m) for m in names])
        return placed(values, "_v")

    # a row is on one side of a fold
    long = placed(counts, "_l", "_a", "_n").withColumn("split", F.when(F.col("_te") == 1, "test").otherwise("train"))
    return _composition(long, sides, counted_labels, source)


def _composition(rows_: DataFrame, sides, counted_labels: Sequence[str], source: str | None) -> DataFrame:
    """The table of :func:`summarise_folds` from (protocol, fold, split, _l, _a, _n) and the (protocol, fold, _tr, _te) of each value of a column."""
    cell = ["protocol", "fold"]
    test, train = F.col("split") == "test", F.col("split") == "train"
    n = F.col("_n")

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0)).cast("bigint")

    both = (F.col("_tr") == 1) & (F.col("_te") == 1)
    counted = rows_.groupBy(*cell).agg(
        rows(train).alias("n_train"),
        rows(test).alias("n_test"),
        F.round(100 * rows(test & F.col("_a")) / F.nullif(rows(test), F.lit(0)), 1).alias("test_pct_attribute"),
        *[rows(test & (F.col("_l") == v)).alias(f"test_{v}") for v in counted_labels],
    )
    groups = sides("_g").groupBy(*cell).agg(
        F.sum("_tr").alias("train_groups"), F.sum("_te").alias("test_groups"), F.count_if(both).alias("group_overlap")
    )
    labels = sides("_l").groupBy(*cell).agg(F.sum("_te").alias("test_labels"))
    table = counted.join(groups, cell).join(labels, cell)
    if source:
        # a closed vocabulary: a handful of sources per fold
        listed = F.array_sort(F.collect_set(F.when(F.col("_te") == 1, F.col("_v"))))
        found = sides("_s").groupBy(*cell).agg(F.count_if(both).alias("source_overlap"), F.array_join(listed, ",").alias("test_sources"))
        table = table.join(found, cell)
    return table


def freeze_check(rebuilt: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows on one side only; both counts are 0 when the folds are unchanged."""
    columns = rebuilt.columns
    marks = rebuilt.withColumn("_d", F.lit(1)).unionByName(
        committed.select(columns).withColumn("_d", F.lit(-1))
    )
    net = marks.groupBy(*columns).agg(F.sum("_d").alias("_d"))
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("missing"),
    )


def freeze_check_assigned(rebuilt: DataFrame, committed: DataFrame, key: str, k: int = N_SPLITS) -> DataFrame:
    """:func:`freeze_check` of the long tables of two assigned tables: only rows that differ are spread over their folds."""
    columns = [key, "_own", "_mixed", "_tr", "_te"]
    marks = rebuilt.select(*columns, F.lit(1).alias("_d")).unionByName(committed.select(*columns, F.lit(-1).alias("_d")))
    left = marks.groupBy(*columns).agg(F.sum("_d").alias("_d")).where("_d <> 0")
    net = protocol_rows(left, [key, "_d"], k).groupBy("protocol", "fold", key, "split").agg(F.sum("_d").alias("_d"))
    return net.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("added"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).cast("bigint").alias("missing"),
    )
