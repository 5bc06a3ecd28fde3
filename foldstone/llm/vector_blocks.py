"""Vectors in packed blocks, and searching query blocks against them.

Rows belong to cells (leaves of a tree, pivots); the cells are as many as a
parameter allows, however many rows there are. A cell is cut into chunks of
about ``BLOCK`` rows by a hash of the id, so no cell is ever in one task, and
each chunk is packed into one row of two binary columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise

#: Rows of a packed block, and queries of a packed query block.
BLOCK = 2048
QUERIES = 512


def usable(rows: DataFrame, vec_id: str, vector: str, change: Callable[[Column], Column] | None = None, zero: bool = True) -> DataFrame:
    """(vec_id, v) of the rows that take part, one a ``vec_id``, with ``v`` as doubles.

    Left out: null ids; null or empty vectors; vectors with null or non-finite
    components, or all zero unless ``zero``; vectors whose length is not the
    most frequent one. Of rows that share an id the smallest vector stays.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        fine = fine & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine
    )
    if change is not None:
        kept = kept.withColumn("v", change(F.col("v")))
    kept = materialise(kept.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), "d").first()
    return kept.where(F.size("v") == (common["d"] if common else 0))


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.zeros((0, 0))


def sample_of(vecs: DataFrame, rows: int, salt: str = "sample") -> np.ndarray:
    """About ``rows`` vectors, chosen by a hash of the id; the only vectors a driver sees."""
    total = vecs.count()
    share = min(1.0, rows / total) if total else 0.0
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(salt), "vec_id"), 11) / F.lit(float(2**53))
    picked = sorted(vecs.where(draw < share).collect(), key=lambda r: r["vec_id"])
    return np.array([r["v"] for r in picked])


def rows_of(assigned: DataFrame) -> dict[int, int]:
    """Rows of every cell; as many entries as there are cells."""
    return {r["cell"]: r["n"] for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}


def chunks_of(assigned: DataFrame, block: int = BLOCK) -> dict[int, int]:
    """Chunks of every cell."""
    return chunked(rows_of(assigned), block)


def chunked(rows: dict[int, int], block: int = BLOCK) -> dict[int, int]:
    return {cell: -(-n // block) for cell, n in rows.items()}


def _lookup(spark, chunks: dict[int, int]) -> DataFrame:
    return spark.createDataFrame(list(chunks.items()), "cell int, chunks int")


def packed(assigned: DataFrame, chunks: dict[int, int]) -> DataFrame:
    """(cell, chunk, ids, vecs) of (cell, vec_id, v) rows."""

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("vec_id")
        return pd.DataFrame({
            "cell": [key[0]], "chunk": [key[1]], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
            "vecs": [matrix(part["v"]).astype(np.float64).tobytes()],
        })

    placed = assigned.join(F.broadcast(_lookup(assigned.sparkSession, chunks)), "cell").withColumn(
        "chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    )
    return materialise(
        placed.select("cell", "chunk", "vec_id", "v").groupBy("cell", "chunk")
        .applyInPandas(pack, "cell int, chunk int, ids binary, vecs binary"), "blocks",
    )


def query_blocks(cells_of: Callable[[np.ndarray], Iterator[tuple[int, np.ndarray]]], queries: int = QUERIES):
    """A mapInPandas function: queries packed by the cells they visit.

    ``cells_of(vectors)`` yields (cell, positions of the queries that visit it).
    ``floor`` carries the score a query already has to beat.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            if not len(part):
                continue
            vecs, ids = matrix(part["v"]), part["vec_id"].to_numpy(np.int64)
            floor = part["floor"].to_numpy(np.float64)
            out = []
            for cell, at in cells_of(vecs, floor):
                for lo in range(0, len(at), queries):
                    own = at[lo:lo + queries]
                    out.append((cell, ids[own].tobytes(), vecs[own].tobytes(), floor[own].tobytes()))
            yield pd.DataFrame(out, columns=["cell", "q_ids", "q_vecs", "q_floor"])

    return run


QUERY_SCHEMA = "cell int, q_ids binary, q_vecs binary, q_floor binary"


def searched(packed_queries: DataFrame, blocks: DataFrame, chunks: dict[int, int], search) -> DataFrame:
    """(query_id, vec_id, score) found by ``search(q_ids, q, floor, ids, x)`` on every pair of blocks of a cell.

    Query blocks are dealt to the chunks of their cell, so a hot cell is as
    many join keys as it has chunks.
    """
    spark = blocks.sparkSession
    dealt = packed_queries.join(F.broadcast(_lookup(spark, chunks)), "cell").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    ).drop("chunks")
    pairs = dealt.join(blocks, ["cell", "chunk"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = []
            for q_ids, q_vecs, q_floor, ids, vecs in zip(part["q_ids"], part["q_vecs"], part["q_floor"], part["ids"], part["vecs"]):
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, x = np.frombuffer(q_vecs).reshape(len(q_ids), -1), np.frombuffer(vecs).reshape(len(ids), -1)
                found.append(search(q_ids, q, np.frombuffer(q_floor), ids, x))
            if found:
                yield pd.DataFrame({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("query_id", "vec_id", "score"))})

    return pairs.select("q_ids", "q_vecs", "q_floor", "ids", "vecs").mapInPandas(run, "query_id bigint, vec_id bigint, score double")


def top_scores(scores: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray):
    """The k best of each row of a score matrix, ties to smaller ids, the query itself left out."""
    scores = np.where(ids[None, :] == q_ids[:, None], -np.inf, scores)
    if len(ids) > k:
        # every score that ties with the k-th stays in until ids decide
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    else:
        edge = np.full(len(q_ids), -np.inf)
    row, col = np.nonzero((scores >= np.maximum(edge, floor)[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(q_ids)))
    keep = np.arange(len(row)) - first[row] < k
    row, col = row[keep], col[keep]
    return q_ids[row], ids[col], scores[row, col]


def best(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each query, ties to smaller ids."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
