"""Exact top-k inner products by best-first search of an M-tree.

Inner products become distances by one more coordinate: with M the largest
norm, x gets sqrt(M^2 - |x|^2) and a query 0, and then d(q, x)^2 = |q|^2 + M^2
- 2 qx, so the nearest in this metric space have the largest products.

The top nodes are pivots picked from a bounded sample; every row belongs to
its nearest pivot, whose covering radius is the largest distance of its rows.
The rows of a pivot are packed in blocks; in a block rows are gathered into
pages around page centres with covering radii, and every row keeps its
distance to its page's centre, every page its distance to the pivot. A search
takes pages best first, by the lower bound of their distance, until no bound
beats the k-th best: the distance to the pivot and the stored parent distance
give a bound without computing the distance to the page's centre, and the
stored distance of a row one without computing its own.

Each query first searches the blocks of its nearest pivot, which gives it a
score to beat everywhere else; pivots whose bound cannot beat it are not
visited. Bounds are loosened by more than distances can be rounded, so nothing
is lost; scores are integer products of the integer vectors.

Defined results. Vectors that are null, empty, hold null or non-finite
components or have another length than most take no part, nor do null ids;
rows sharing a ``vec_id`` count once, with the smallest vector. Fewer than k
candidates: all. Ties: smaller id first. Empty table: empty result. Scores are
exact up to 2^53 in size.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .vector_blocks import QUERY_SCHEMA, best, chunks_of, matrix, packed, query_blocks, sample_of, searched, usable

SAMPLE = 8192
#: Pivots: one for so many rows, and at most so many.
ROWS_A_PIVOT, MOST_PIVOTS = 4096, 512
PAGE = 64
K = 10
#: Rounding allowed for in distances, as a share of the norms.
SLACK = 1e-6


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that turns products into distances; ``most`` is the largest squared norm."""
    rest = np.maximum(most - (x * x).sum(1), 0.0)
    return np.c_[x, np.sqrt(rest)]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def spread_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first points of a sample."""
    picked = [0]
    near = distances(x, x[:1])[:, 0]
    while len(picked) < min(n, len(x)):
        i = int(near.argmax())
        if near[i] == 0:
            break
        picked.append(i)
        near = np.minimum(near, distances(x, x[i:i + 1])[:, 0])
    return x[picked]


class Block:
    """The pages of one packed block below a pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, pivot: np.ndarray, most: float):
        up = lifted(x, most)
        # pages: rows ordered by their nearest of a few spread centres, then by distance, and cut
        centers = spread_pivots(up, max(1, len(x) // PAGE))
        d = distances(up, centers)
        near = d.argmin(1)
        order = np.lexsort((d[np.arange(len(x)), near], near))
        self.ids, self.x, up = ids[order], x[order], up[order]
        self.starts = np.arange(0, len(x), PAGE)
        ends = np.append(self.starts[1:], len(x))
        self.ends = ends
        self.centers = np.stack([up[a:b].mean(0) for a, b in zip(self.starts, ends)])
        own = [distances(up[a:b], c[None])[:, 0] for a, b, c in zip(self.starts, ends, self.centers)]
        self.radius = np.array([r.max() for r in own])
        self.member = np.concatenate(own)  # of each row to its page's centre
        self.parent = distances(self.centers, pivot[None])[:, 0]  # of each page to the pivot

    def search(self, q_id: int, q: np.ndarray, to_pivot: float, floor: float, k: int, most: float):
        """Best-first: (scores, ids) of the rows that may be among the k best and reach ``floor``."""
        base = float(q @ q) + most
        high = np.append(q, 0.0)

        def reach(score: float) -> float:  # the distance that a score has
            return np.sqrt(max(base - 2 * score, 0.0)) + SLACK * np.sqrt(base) if score > -np.inf else np.inf

        heap: list[tuple[float, int]] = []  # the k best so far, worst first
        limit = reach(floor)
        # bounds from stored distances alone; real ones are computed when a page comes up
        queue = [(b, p, False) for p, b in enumerate(np.maximum(np.abs(to_pivot - self.parent) - self.radius, 0.0).tolist())]
        heapq.heapify(queue)
        while queue:
            bound, p, real = heapq.heappop(queue)
            if bound > limit:
                break
            to_center = float(np.sqrt(((high - self.centers[p]) ** 2).sum())) if not real else real
            if not real:
                bound = to_center - self.radius[p]
                if bound > limit:
                    continue
                if queue and bound > queue[0][0]:
                    heapq.heappush(queue, (bound, p, to_center or 1e-12))
                    continue
            a, b = self.starts[p], self.ends[p]
            mine = np.nonzero(np.abs(to_center - self.member[a:b]) <= limit)[0] + a
            scores = self.x[mine] @ q
            for s, i in zip(scores.tolist(), self.ids[mine].tolist()):
                if i == q_id or s < floor:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, (s, -i))
                elif (s, -i) > heap[0]:
                    heapq.heapreplace(heap, (s, -i))
            if len(heap) == k:
                limit = min(limit, reach(heap[0][0]))
        return heap


def top_k(rows: DataFrame, is_query, vec_id="vec_id", vector="embedding", k: int = K, scale: int = 1024, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest integer products of the rows that meet ``is_query``."""
    spark = rows.sparkSession
    vecs = usable(rows, vec_id, vector, lambda v: F.transform(v, lambda x: F.floor(x * scale).cast("double")))
    norms = vecs.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    empty = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not norms[0]:
        return spark.createDataFrame([], empty)
    total, most = int(norms[0]), float(norms[1])
    x = sample_of(vecs, sample)
    if not len(x):
        x = np.array([r["v"] for r in vecs.limit(1).collect()])
    pivots = spread_pivots(lifted(x, most), max(1, min(MOST_PIVOTS, total // ROWS_A_PIVOT)))

    @F.pandas_udf("cell int, far double")
    def placed(v: pd.Series) -> pd.DataFrame:
        d = distances(lifted(matrix(v), most), pivots)
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": d.min(1)})

    assigned = materialise(vecs.withColumn("p", placed("v")).select("vec_id", "v", "p.cell", "p.far"), "pivots")
    covering = {r["cell"]: r["r"] for r in assigned.groupBy("cell").agg(F.max("far").alias("r")).collect()}  # at most MOST_PIVOTS
    chunks = chunks_of(assigned)
    blocks = packed(assigned.select("cell", "vec_id", "v"), chunks)
    cells = np.array(sorted(covering), np.int64)
    centers, radius = pivots[cells], np.array([covering[c] for c in cells])

    def search(q_ids, q, floor, ids, x):
        up = lifted(x, most)
        pivot = pivots[int(distances(up[:1], pivots).argmin())]  # the rows of a block share their pivot
        block = Block(ids, x, pivot, most)
        to_pivot = distances(np.c_[q, np.zeros(len(q))], pivot[None])[:, 0]
        out_q, out_i, out_s = [], [], []
        for n, i in enumerate(q_ids.tolist()):
            for s, j in block.search(i, q[n], float(to_pivot[n]), float(floor[n]), k, most):
                out_q.append(i)
                out_i.append(-j)
                out_s.append(s)
        return np.array(out_q, np.int64), np.array(out_i, np.int64), np.array(out_s, np.float64)

    def first_cell(q: np.ndarray, floor: np.ndarray):
        near = distances(np.c_[q, np.zeros(len(q))], centers).argmin(1)
        for j in np.unique(near):
            yield int(cells[j]), np.nonzero(near == j)[0]

    def other_cells(q: np.ndarray, floor: np.ndarray):
        d = distances(np.c_[q, np.zeros(len(q))], centers)
        near = d.argmin(1)
        base = (q * q).sum(1) + most
        reach = np.sqrt(np.maximum(base - 2 * np.maximum(floor, -1e300), 0.0)) + SLACK * np.sqrt(base)
        may = (d - radius[None, :] <= reach[:, None]) & (np.arange(len(cells))[None, :] != near[:, None])
        for j in range(len(cells)):
            if len(at := np.nonzero(may[:, j])[0]):
                yield int(cells[j]), at

    asked = assigned.where(is_query).select("vec_id", "v", F.lit(float("-inf")).alias("floor"))
    first = materialise(best(searched(asked.mapInPandas(query_blocks(first_cell), QUERY_SCHEMA), blocks, chunks, search), k), "first")
    # the k-th score so far is what the other pivots have to reach
    seen = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("seen"))
    again = asked.join(seen, "vec_id", "left").select("vec_id", "v", F.coalesce("seen", "floor").alias("floor"))
    rest = searched(again.mapInPandas(query_blocks(other_cells), QUERY_SCHEMA), blocks, chunks, search)
    both = first.select("query_id", "vec_id", "score").unionByName(rest)
    return best(both, k).withColumn("score", F.col("score").cast("bigint"))


def op10_topk(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 10 highest integer products of every vector whose id is divisible by 100."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


#: The contract query in DuckDB SQL.
ORACLE = """WITH fine AS (SELECT vec_id::BIGINT AS vec_id, min(list_transform(embedding, lambda x: floor(1024 * x::DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 GROUP BY 1),
  usual AS (SELECT len(v) AS d FROM fine GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  e AS (SELECT vec_id, v FROM fine, usual WHERE len(v) = d),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
  WHERE rank <= 10"""
