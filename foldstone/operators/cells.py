"""Exact nearest neighbours through a metric cell index.

Reference rows belong to the cell of their nearest pivot (pivots are spread
points of a bounded sample). A cell keeps its radius and is cut into blocks of
bounded size; for every block the least and the largest distance of its rows
to the pivot are stored, and the distance and the fold of each row. Where only
rows of the query's own fold count, blocks are of one fold. Vectors without
structure reach most blocks: a query then travels once a block, so blocks are
as large as a task can hold with ease.

By the triangle inequality no row of a block is nearer to a query than the
larger of d(query, pivot) - farthest and nearest - d(query, pivot). Pivots
within reach are searched in two rounds: first each query's own cell (as many
nearest cells as hold ``k`` rows), which gives it a k-th distance; then, only
for queries and blocks whose bound does not exceed it, the others. Cell pairs
are cut before a vector is shuffled, and in a block the stored distances cut
rows before theirs are computed. Bounds are loosened by more than distances
are rounded, so the result is exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialise
from .ranking import first_by

#: Rows of a reference block, and queries of a packed query block: a reference block goes to Python once a pack.
BLOCK_ROWS = 8192
QUERY_ROWS = 4096
#: Bytes of packed queries handed on at once, queries multiplied with a block at once, and candidates measured at once.
DEALT_BYTES = 16 << 20
PRODUCT_ROWS = 256
MEASURED = 65_536
#: Shares of a block's packs that can go to different tasks.
SHARES = 4
#: Rows of the sample that pivots are spread over, and reference rows for one pivot; the sample bounds the pivots.
SAMPLE_ROWS = 4096
ROWS_PER_PIVOT = 8192
#: Bounds of query and block pairs computed at once.
BOUNDS = 4_000_000
SLACK = 1e-7


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows, in blocks of rows so that no cube of differences exists."""
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def slack(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What rounding can add to a distance: it grows with the norms, not with the distance."""
    return SLACK * (1 + np.sqrt((q * q).sum(1)) + float(np.sqrt((x * x).sum(1).max(initial=0.0))))


def as_bytes(x: np.ndarray) -> bytes:
    """Vectors as bytes, in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    return (single if np.array_equal(single, x) else x.astype(np.float64)).tobytes()


def from_bytes(raw, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of a sample, fewer if all points are taken."""
    picked, near = [0], distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)):
        far = int(near.argmax())
        if near[far] <= 0:
            break
        picked.append(far)
        near = np.minimum(near, distances(x, x[far:far + 1])[:, 0])
    return x[picked]


def pivots_of(refs: DataFrame, key: str, vec: str, rows_per_pivot: int = ROWS_PER_PIVOT) -> np.ndarray:
    """Pivots from a sample drawn by a hash of the key; the only vectors a driver sees."""
    total = refs.count()
    share = min(1.0, SAMPLE_ROWS / total) if total else 0.0
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("pivot"), F.col(key)), 11) / F.lit(float(2**53))
    rows = sorted((r for r in refs.where(draw <= share).select(F.col(key).alias("k"), F.col(vec).alias("v")).collect()), key=lambda r: str(r["k"]))
    x = np.array([r["v"] for r in rows], float) if rows else np.zeros((0, 0))
    if not len(x):
        first = refs.select(vec).first()
        return np.array([first[0]], float) if first else np.zeros((0, 0))
    return spread(x, max(1, min(len(x) // 8, total // rows_per_pivot)))


def _placed(df: DataFrame, vec: str, pivots: np.ndarray) -> DataFrame:
    """``df`` with cell and distance to its pivot."""

    @F.pandas_udf("cell int, far double")
    def place(v: pd.Series) -> pd.DataFrame:
        d = distances(np.stack(v.to_numpy()), pivots) if len(v) else np.zeros((0, 1))
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": d.min(1)})

    return df.withColumn("_p", place(F.col(vec))).withColumns({"_cell": F.col("_p.cell"), "_far": F.col("_p.far")}).drop("_p")


def build_cells(refs: DataFrame, pivots: np.ndarray, key: str, vec: str, label: str, fold: str | None = None, block: int = BLOCK_ROWS, one_fold: bool = False) -> DataFrame:
    """Stored reference blocks: (cell, block, fold, n, sure, near, far) and their rows as arrays.

    ``sure`` rows at least count for a query of any one fold. Blocks hold one fold each if ``one_fold``, else ``fold`` is 0.
    """
    f = F.col(fold).cast("int") if fold else F.lit(0)
    rows = _placed(refs.select(F.col(key).alias("_key"), F.col(vec).cast("array<double>").alias("_vec"), F.col(label).alias("_label"), f.alias("_fold")), "_vec", pivots)
    rows = materialise(rows.withColumn("_part", F.col("_fold") if one_fold else F.lit(0)), "placed")
    sizes = rows.groupBy("_cell", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # a cell is cut by a hash, so one that holds a third of all rows is many blocks
    cut = rows.join(materialise(sizes, "sizes"), ["_cell", "_part"]).withColumn(
        "_block", F.pmod(F.xxhash64("_key"), F.ceil(F.col("_n") / block)).cast("int")
    )
    kind = {c: refs.schema[n].dataType.simpleString() for c, n in (("keys", key), ("labels", label))}

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_far")
        return pd.DataFrame({
            "cell": [part["_cell"].iat[0]], "block": [part["_block"].iat[0]], "fold": [part["_part"].iat[0]], "n": [len(part)],
            "sure": [len(part) - (0 if one_fold or fold is None else int(part["_fold"].value_counts().max()))],
            "folds": [part["_fold"].to_numpy(np.int32).tobytes()],
            "near": [part["_far"].iat[0]], "far": [part["_far"].iat[-1]], "keys": [list(part["_key"])], "labels": [list(part["_label"])],
            "dist": [part["_far"].to_numpy(np.float64).tobytes()], "vecs": [as_bytes(np.stack(part["_vec"].to_numpy()).astype(np.float64))],
        })

    packed = cut.groupBy("_cell", "_part", "_block").applyInPandas(
        pack,
        f"cell int, block int, fold int, n bigint, sure bigint, folds binary, near double, far double, keys array<{kind['keys']}>, labels array<{kind['labels']}>, dist binary, vecs binary",
    )
    return materialise(packed, "cells")


class Directory:
    """What is known of all blocks without their rows: about 50 bytes a block."""

    def __init__(self, blocks: DataFrame, pivots: np.ndarray):
        rows = blocks.select("cell", "block", "fold", "sure", "near", "far").toPandas().sort_values(["cell", "fold", "block"], ignore_index=True)
        self.cell, self.block, self.fold = (rows[c].to_numpy(np.int64) for c in ("cell", "block", "fold"))
        self.sure, self.near, self.far = rows["sure"].to_numpy(np.int64), rows["near"].to_numpy(), rows["far"].to_numpy()
        self.pivots = pivots

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Least distance that any row of each block can have to each query."""
        d = distances(q, self.pivots)[:, self.cell]
        return np.maximum(np.maximum(d - self.far, self.near - d), 0.0)

    def allowed(self, folds: np.ndarray, one_fold: bool) -> np.ndarray:
        return folds[:, None] == self.fold[None, :] if one_fold else np.ones((len(folds), len(self.cell)), bool)

    def first(self, q: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """The blocks with the least bounds that together hold more than ``k`` allowed rows."""
        bound = np.where(allowed, self.bounds(q), np.inf)
        order = np.argsort(bound, axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(np.where(allowed, self.sure, 0), order, 1), axis=1)
        use = np.empty_like(allowed)
        # up to the block that brings the count to k
        np.put_along_axis(use, order, np.concatenate([np.zeros((len(q), 1)), held[:, :-1]], axis=1) < k, 1)
        return use & allowed

    def rest(self, q: np.ndarray, allowed: np.ndarray, k: int, limit: np.ndarray) -> np.ndarray:
        return allowed & ~self.first(q, allowed, k) & (self.bounds(q) <= (limit + slack(q, self.pivots))[:, None])


def _searched(queries: DataFrame, blocks: DataFrame, directory: Directory, pick, k: int, kinds: dict[str, str], other_folds: bool) -> DataFrame:
    """(q, distance, r, rl): the k best of each pair of a query and a picked block.

    ``pick(vectors, folds, limits)`` says which blocks each query visits.
    Queries travel packed by block, once for each block they visit.
    """
    cells = list(zip(directory.cell.tolist(), directory.fold.tolist(), directory.block.tolist()))
    step = max(1, min(QUERY_ROWS, BOUNDS // max(len(cells), 1)))
    pivots = directory.pivots

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            vecs, keys = np.stack(part["v"].to_numpy()).astype(np.float64), part["q"].to_numpy()
            limits, folds = part["limit"].to_numpy(np.float64), part["f"].to_numpy(np.int64)
            for lo in range(0, len(part), step):
                some = slice(lo, lo + step)
                use, out, held = pick(vecs[some], folds[some], limits[some]), [], 0
                share = zlib.crc32(vecs[lo].tobytes()) % SHARES
                for j in np.flatnonzero(use.any(0)).tolist():
                    own = np.flatnonzero(use[:, j]) + lo
                    out.append((*cells[j], share, list(keys[own]), as_bytes(vecs[own]), limits[own].tobytes(), folds[own].astype(np.int32).tobytes()))
                    held += 8 * vecs.shape[1] * len(own)
                    if held >= DEALT_BYTES:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
                if out:
                    yield pd.DataFrame(out, columns=names)

    names = ["cell", "fold", "block", "share", "qs", "q_vecs", "q_limits", "q_folds"]
    dealt = queries.mapInPandas(deal, f"cell int, fold int, block int, share int, qs array<{kinds['q']}>, q_vecs binary, q_limits binary, q_folds binary")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = dict(zip(batch.schema.names, batch.columns))
            for i in range(batch.num_rows):
                # a row is read where it arrived: its block is not copied but for what is multiplied
                qs, keys, labels = (col[c][i].values.to_numpy(zero_copy_only=False) for c in ("qs", "keys", "labels"))
                limits, dist = np.frombuffer(col["q_limits"][i].as_buffer()), np.frombuffer(col["dist"][i].as_buffer())
                q_folds, folds = (np.frombuffer(col[c][i].as_buffer(), np.int32) for c in ("q_folds", "folds"))
                centre = pivots[col["cell"][i].as_py()]
                q, x = from_bytes(col["q_vecs"][i].as_buffer(), len(qs), len(centre)), from_bytes(col["vecs"][i].as_buffer(), len(keys), len(centre))
                # rows lie in the order of their distance to the pivot: those beyond every query's reach are cut off
                to, reach = distances(q, centre[None, :])[:, 0], limits + slack(q, x)
                a, b = np.searchsorted(dist, (to - reach).min()), np.searchsorted(dist, (to + reach).max(), "right")
                if a < b:
                    best = _block_best(qs, q, limits, keys[a:b], labels[a:b], x[a:b], k, centre, (q_folds, folds[a:b]) if other_folds else None)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(best, types)], names=["q", "distance", "r", "rl"])

    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    pairs = dealt.join(blocks.select("cell", "fold", "block", "keys", "labels", "folds", "dist", "vecs", shares.alias("share")), ["cell", "fold", "block", "share"])
    schema = f"q {kinds['q']}, distance double, r {kinds['r']}, rl {kinds['rl']}"
    types = to_arrow_schema(StructType.fromDDL(schema)).types
    return pairs.select("cell", "qs", "q_vecs", "q_limits", "q_folds", "keys", "labels", "folds", "dist", "vecs").mapInArrow(search, schema)


def _block_best(qs, q, limits, keys, labels, x, k, centre, folds=None) -> tuple:
    """(q, distance, r, rl) of the k nearest rows of a block for each query, ties to smaller keys.

    With ``folds`` (of queries, of rows), rows of a query's own fold are left out.
    Products in single precision about the block's pivot say which rows can be near
    enough, by more than they are rounded; those alone are measured exactly.
    """
    a, b = q - centre, x - centre
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    # d^2 = aa - 2 s with s = ab - bb/2: a row is near if s is large
    single = np.float32 if aa.max() + bb.max() < 1e30 else np.float64
    left, right = np.c_[a, np.ones(len(a))].astype(single), np.c_[b, -0.5 * bb].astype(single)
    most, norm = bb.max(), np.sqrt((q * q).sum(1))
    wide = 4 * np.finfo(np.float32).eps * (x.shape[1] + 4) * (np.sqrt(aa * most) + most) + 1e-30
    wide += 1e-12 * (aa + most) + 1e-13 * norm * (np.sqrt(aa) + np.sqrt(most))
    rows, cols = [], []
    for lo in range(0, len(q), PRODUCT_ROWS):
        some = slice(lo, lo + PRODUCT_ROWS)
        s = left[some] @ right.T
        reach = np.where(np.isfinite(limits[some]), limits[some], 0.0)
        edge = np.where(np.isfinite(limits[some]), 0.5 * (aa[some] - reach**2), -np.inf)
        blind = np.flatnonzero(np.isinf(edge))  # no limit yet: the block's own k-th row is one
        if len(blind) and len(x) > k:
            open_ = s[blind]
            if folds is not None:
                open_[folds[0][some][blind, None] == folds[1][None, :]] = -np.inf
            edge[blind] = np.partition(open_, len(x) - k, axis=1)[:, len(x) - k]
        row, col = np.nonzero(s >= (edge - wide[some])[:, None].astype(np.float64))
        if folds is not None:
            keep = folds[0][some][row] != folds[1][col]
            row, col = row[keep], col[keep]
        exact = np.empty(len(row))
        for at in range(0, len(row), MEASURED):
            part = slice(at, at + MEASURED)
            exact[part] = np.sqrt(((q[some][row[part]] - x[col[part]]) ** 2).sum(1))
        place = np.unique(keys[col], return_inverse=True)[1] if len(col) else col
        order = np.lexsort((place, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.arange(len(row)) - np.searchsorted(row, np.arange(len(left[some])))[row] < k
        rows.append((row[first] + lo, exact[first]))
        cols.append(col[first])
    row, col = np.concatenate([r for r, _ in rows]), np.concatenate(cols)
    return qs[row], np.concatenate([e for _, e in rows]), keys[col], labels[col]


def nearest_in_cells(
    queries: DataFrame, refs: DataFrame, k: int, key: str, vec: str, label: str, fold: str | None = None, same_fold: bool = False,
    rows_per_pivot: int = ROWS_PER_PIVOT, block: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, distance, ref, label): the exact k nearest references of each query.

    With ``fold``, references are taken from other folds than the query's, or
    with ``same_fold`` from the same one. Ties go to the smaller reference key.
    """
    pivots = pivots_of(refs, key, vec, rows_per_pivot)
    kinds = {"q": queries.schema[key].dataType.simpleString(), "r": refs.schema[key].dataType.simpleString(), "rl": refs.schema[label].dataType.simpleString()}
    if not len(pivots):
        return refs.sparkSession.createDataFrame([], f"{key} {kinds['q']}, distance double, ref {kinds['r']}, {label} {kinds['rl']}")
    one_fold, other_folds = fold is not None and same_fold, fold is not None and not same_fold
    blocks = build_cells(refs, pivots, key, vec, label, fold, block, one_fold)
    directory = Directory(blocks, pivots)
    asked = queries.select(
        F.col(key).alias("q"), F.col(vec).cast("array<double>").alias("v"), (F.col(fold).cast("int") if fold else F.lit(0)).alias("f"),
    )

    def first(q, folds, limits):
        return directory.first(q, directory.allowed(folds, one_fold), k)

    def rest(q, folds, limits):
        return directory.rest(q, directory.allowed(folds, one_fold), k, limits)

    everywhere = asked.withColumn("limit", F.lit(float("inf")))
    start = materialise(first_by(_searched(everywhere, blocks, directory, first, k, kinds, other_folds), "q", [F.col("distance"), F.col("r")], k), "near")
    reach = start.groupBy("q").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("limit"))
    again = asked.join(reach, "q", "left").select("q", "v", "f", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    found = start.unionByName(_searched(again, blocks, directory, rest, k, kinds, other_folds))
    return first_by(found, "q", [F.col("distance"), F.col("r")], k).select(
        F.col("q").alias(key), "distance", F.col("r").alias("ref"), F.col("rl").alias(label)
    )
