"""Exact all-pairs distance work in bounded blocks.

Rows are hashed into even blocks and every pair of blocks is one task that
does matrix arithmetic and emits only a reduced result: the k nearest per row,
or distance sums per (row, label). No pair of rows is ever a row of a table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import hash32
from ..session import materialise, settle
from .ranking import attach, first_by

#: Rows per block: bounds the memory of one task.
BLOCK_ROWS = 4096
MIN_BLOCKS = 3


def _block_count(rows: int) -> int:
    return max(MIN_BLOCKS, -(-rows // BLOCK_ROWS))


def nearest(
    queries: DataFrame,
    refs: DataFrame,
    k: int,
    key: str,
    vec: str,
    label: str,
    fold: str | None = None,
    same_fold: bool = False,
) -> DataFrame:
    """(key, distance, ref, label): the k nearest references of each query.

    With ``fold``, references are taken from other folds than the query's, or
    with ``same_fold`` from the same one. Ties go to the smaller reference key.
    """
    nq, nr = _block_count(queries.count()), _block_count(refs.count())
    f = F.col(fold) if fold else F.lit(0)
    qkind = queries.schema[key].dataType.simpleString()
    rkind = refs.schema[key].dataType.simpleString()
    lkind = refs.schema[label].dataType.simpleString()
    q = queries.select(
        F.col(key).alias("q"), F.col(vec).alias("qv"), f.cast("int").alias("qf"),
        (hash32("q", F.col(key)) % nq).alias("qb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nr - 1).cast("bigint"))).alias("rb"),
    )
    r = refs.select(
        F.col(key).alias("r"), F.col(vec).alias("rv"), f.cast("int").alias("rf"), F.col(label).alias("rl"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nq - 1).cast("bigint"))).alias("qb"),
        (hash32("r", F.col(key)) % nr).alias("rb"),
    )
    folded = fold is not None

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "distance", "r", "rl"]
        if left.empty or right.empty:
            return pd.DataFrame({c: [] for c in columns})
        right = right.sort_values("r", ignore_index=True)
        a, b = np.stack(left.qv.to_numpy()), np.stack(right.rv.to_numpy())
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        out = []
        for s in range(0, len(a), 256):
            x = a[s : s + 256]
            d2 = aa[s : s + 256, None] + bb[None, :] - 2 * x @ b.T
            if folded:
                eq = left.qf.to_numpy()[s : s + 256, None] == right.rf.to_numpy()[None, :]
                d2[eq if not same_fold else ~eq] = np.inf
            take = min(k, d2.shape[1])
            cut = np.partition(d2, take - 1, axis=1)[:, take - 1]
            slack = 1e-9 * (aa[s : s + 256] + bb.max() + 1.0)
            for i in range(len(x)):
                near = np.flatnonzero(d2[i] <= cut[i] + slack[i])
                near = near[np.isfinite(d2[i, near])]
                dist = np.sqrt(((b[near] - x[i]) ** 2).sum(1))
                best = np.argsort(dist, kind="stable")[:take]
                for j in best:
                    out.append((left.q.iat[s + i], dist[j], right.r.iat[near[j]], right.rl.iat[near[j]]))
        return pd.DataFrame(out, columns=columns)

    found = (
        q.groupBy("qb", "rb")
        .cogroup(r.groupBy("qb", "rb"))
        .applyInPandas(block, f"q {qkind}, distance double, r {rkind}, rl {lkind}")
    )
    # at most k rows per query and block are left
    return first_by(found, "q", [F.col("distance"), F.col("r")], k).select(
        F.col("q").alias(key), "distance", F.col("r").alias("ref"), F.col("rl").alias(label)
    )


def knn_vote(near: DataFrame, key: str, label: str, weights: str = "uniform") -> DataFrame:
    """(key, y_pred) by majority of the neighbours; ties to the smallest label."""
    if weights not in ("uniform", "distance"):
        raise ValueError(f"unknown weights {weights!r}")
    vote = F.lit(1.0) if weights == "uniform" else 1.0 / F.greatest(F.col("distance"), F.lit(1e-12))
    sums = near.groupBy(key, label).agg(F.round(F.sum(vote), 9).alias("_v"))
    return sums.groupBy(key).agg(F.min_by(label, F.struct(-F.col("_v"), F.col(label))).alias("y_pred"))


def distance_sums(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(key, label, other, total, best): what a silhouette needs, already reduced.

    ``total`` sums the distances of a row to the rows of label ``other``, for
    its own label and for labels that span blocks. A label that lies in one
    block is finished there, so of all those only the smallest mean distance
    is kept, in ``best``. Blocks follow the label order, so few labels span
    blocks and a row emits a handful of values per block, however many labels
    there are. Each pair of blocks is computed once for both of its sides; blocks
    are packed and stored, and pairs of them are a product of stored parts.
    """
    n = df.count()
    blocks = _block_count(n)
    kkind, lkind = (df.schema[c].dataType.simpleString() for c in (key, label))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    before = F.sum("_c").over(
        Window.partitionBy(F.lit(0)).orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    )

    def block_at(position):
        return F.least(F.floor(position * blocks / n), F.lit(blocks - 1)).cast("int")

    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0)).cast("double")).withColumn(
        "_whole", block_at(F.col("_start")) == block_at(F.col("_start") + F.col("_c"))
    )
    spot = F.col("_start") + hash32("s", F.col(key)) / F.lit(4294967296.0) * F.col("_c")
    placed = attach(df, settle(starts), label, "inner").select(
        F.col(key).alias("k"), F.col(vec).alias("v"), F.col(label).alias("l"),
        F.col("_c").alias("c"), F.col("_whole").alias("whole"), block_at(spot).alias("b"),
    )
    columns = ["k", "l", "other", "total", "best"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("l", kind="stable")
        return pd.DataFrame({
            "b": pdf["b"].iloc[:1], "k": [list(pdf["k"])], "l": [list(pdf["l"])], "v": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()],
            "c": [pdf["c"].to_numpy(np.int64).tobytes()], "whole": [pdf["whole"].to_numpy(bool).tobytes()],
        })

    packed = placed.repartition(min(blocks, 10_000), "b").groupBy("b").applyInPandas(
        pack, f"b int, k array<{kkind}>, l array<{lkind}>, v binary, c binary, whole binary"
    )
    stored = materialise(packed, "blocks")
    left, right = (stored.select(*[F.col(c).alias(f"{side}_{c}") for c in stored.columns]) for side in "ij")

    def side_of(row, side: str) -> dict:
        k, l = np.asarray(getattr(row, f"{side}_k")), np.asarray(getattr(row, f"{side}_l"))
        first = np.flatnonzero(np.concatenate([[True], l[1:] != l[:-1]]))
        code = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(l))))
        return {
            "k": k, "l": l, "first": first, "code": code, "v": np.frombuffer(getattr(row, f"{side}_v")).reshape(len(k), -1),
            "size": np.frombuffer(getattr(row, f"{side}_c"), np.int64)[first], "whole": np.frombuffer(getattr(row, f"{side}_whole"), bool)[first],
        }

    def reduce(total, rows, cols):
        """What rows get from the labels of a block, from (label, row) sums."""
        names, whole = cols["l"][cols["first"]], cols["whole"]
        k, l = rows["k"], rows["l"]
        own = names[:, None] == l[None, :]
        means = np.where(whole[:, None] & ~own, total / cols["size"][:, None], np.inf)
        at, row = np.nonzero(own | ~whole[:, None])
        sums = pd.DataFrame({"k": k[row], "l": l[row], "other": names[at], "total": total[at, row], "best": np.inf})
        mins = pd.DataFrame({"k": k, "l": l, "other": l, "total": 0.0, "best": means.min(0)})
        return pd.concat([sums, mins])[columns]

    def meet(batches):
        for part in batches:
            for row in part.itertuples(index=False):
                x, y, same = side_of(row, "i"), side_of(row, "j"), row.i_b == row.j_b
                a, b = x["v"], y["v"]
                aa, bb = (a * a).sum(1), (b * b).sum(1)
                to_y, to_x = np.zeros((len(y["first"]), len(a))), np.zeros((len(x["first"]), len(b)))
                key_code = np.unique(x["k"], return_inverse=True)[1] if same else None
                for lo in range(0, len(a), 512):  # some rows at a time
                    some = slice(lo, lo + 512)
                    dist = np.sqrt(np.maximum(aa[some, None] + bb[None, :] - 2 * a[some] @ b.T, 0.0))
                    if same:
                        dist[key_code[some, None] == key_code[None, :]] = 0.0
                    to_y[:, some] = np.add.reduceat(dist, y["first"], axis=1).T
                    if not same:
                        code = x["code"][some]
                        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                        to_x[code[first]] += np.add.reduceat(dist, first, axis=0)
                yield reduce(to_y, x, y)
                if not same:
                    yield reduce(to_x, y, x)

    # every pair of blocks once: a product of stored blocks, for which no vector is shuffled
    parts = left.crossJoin(right).where("i_b <= j_b").mapInPandas(
        meet, f"k {kkind}, l {lkind}, other {lkind}, total double, best double"
    )
    return parts.groupBy(F.col("k").alias(key), F.col("l").alias(label), "other").agg(
        F.sum("total").alias("total"), F.min("best").alias("best")
    )


def silhouette_rows(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """(key, label, a, b, silhouette) with Euclidean distances; singletons 0."""
    sums = distance_sums(df, key, vec, label)
    sizes = df.groupBy(F.col(label).alias("other")).agg(F.count(F.lit(1)).alias("_c"))
    rows = attach(sums, settle(sizes), "other", "inner")
    own = F.col("other") == F.col(label)
    table = rows.groupBy(key, label).agg(
        F.max(F.when(own, F.col("_c"))).alias("_own"),
        F.max(F.when(own, F.col("total") / F.greatest(F.col("_c") - 1, F.lit(1)))).alias("a"),
        F.least(F.min(F.when(~own, F.col("total") / F.col("_c"))), F.min("best")).alias("b"),
    )
    s = F.when(F.col("_own") <= 1, F.lit(0.0)).otherwise(
        (F.col("b") - F.col("a")) / F.greatest("a", "b")
    )
    return table.select(key, label, "a", "b", s.alias("silhouette"))


def silhouette(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """The mean silhouette coefficient over all rows."""
    return silhouette_rows(df, key, vec, label).agg(
        F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n")
    )


# ------------------------------------------------- silhouettes in closed form

def mean_vector(vec) -> Column:
    """Componentwise mean through one mergeable buffer."""
    return vector_to_array(Summarizer.metrics("mean").summary(array_to_vector(vec)).getField("mean"))


#: Bytes of label statistics that travel to the rows at once.
STATS_BYTES = 32 << 20


def squared_silhouette_rows(df: DataFrame, key: str, vec: str, label: str, stats_bytes: int = STATS_BYTES) -> DataFrame:
    """(key, label, a, b, silhouette) with squared Euclidean distances; singletons 0, no other label: null.

    The mean squared distance of a row to a label follows from the label's
    count, mean and mean squared norm, so the work grows with rows times labels
    and no two rows meet. Statistics travel in blocks of labels whose size is
    bounded; with several blocks each gives the least mean of its labels.
    """
    mean, stat = "_mean", "_stat"
    at_zero = df.where(F.col(label).isNotNull())
    center = at_zero.agg(mean_vector(F.col(vec)).alias(mean))
    # rows are centred first: squares of far-off vectors would swallow the differences
    rows = at_zero.crossJoin(F.broadcast(center)).withColumn("_v", F.zip_with(vec, mean, lambda x, m: x - m)).select(key, label, "_v")
    norm = F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x)
    stats = settle(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_c"), mean_vector(F.col("_v")).alias(stat), F.avg(norm).alias("_q")))
    n, width = stats.agg(F.count(F.lit(1)), F.max(F.size(stat))).first()
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, label)}
    schema = f"{key} {kinds[key]}, {label} {kinds[label]}, a double, b double, own bigint"
    if not n:
        return df.sparkSession.createDataFrame([], schema).select(key, label, "a", "b", F.lit(None).cast("double").alias("silhouette"))
    blocks = -(-n * (width + 4) * 8 // stats_bytes)
    found = None
    for i in range(blocks):
        held = stats.where(F.pmod(F.xxhash64(label), F.lit(blocks)) == i).toPandas()
        if len(held):
            part = rows.mapInPandas(_means_to_labels(held, key, label, stat), schema)
            found = part if found is None else found.unionByName(part)
    if blocks > 1:
        found = found.groupBy(key, label).agg(F.max("a").alias("a"), F.min("b").alias("b"), F.max("own").alias("own"))
    s = F.when(F.col("own") <= 1, 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return found.select(key, label, "a", "b", F.when(F.col("b").isNotNull(), s).alias("silhouette"))


def _means_to_labels(held: pd.DataFrame, key: str, label: str, stat: str):
    means, count = np.stack(held[stat].to_numpy()), held["_c"].to_numpy(float)
    square, names = held["_q"].to_numpy(float), held[label].to_numpy()
    place = {name: i for i, name in enumerate(names.tolist())}

    def run(batches):
        for part in batches:
            for lo in range(0, len(part), 1024):
                some = part.iloc[lo:lo + 1024]
                v = np.stack(some["_v"].to_numpy())
                to = np.maximum((v * v).sum(1)[:, None] - 2 * v @ means.T + square[None, :], 0.0)
                at = np.array([place.get(x, -1) for x in some[label].tolist()])
                mine = np.flatnonzero(at >= 0)
                a, own = np.full(len(some), np.nan), np.zeros(len(some), np.int64)
                own[mine] = count[at[mine]]
                # a row is no neighbour of itself
                a[mine] = to[mine, at[mine]] * own[mine] / np.maximum(own[mine] - 1, 1)
                to[mine, at[mine]] = np.inf
                b = to.min(1)
                none = lambda x: pd.Series(x, dtype=object).where(np.isfinite(x), None)
                yield pd.DataFrame({key: some[key].to_numpy(), label: some[label].to_numpy(), "a": none(a), "b": none(b), "own": own})

    return run


def squared_silhouette(df: DataFrame, key: str, vec: str, label: str) -> DataFrame:
    """The mean over all rows of :func:`squared_silhouette_rows`."""
    return squared_silhouette_rows(df, key, vec, label).agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n"))
