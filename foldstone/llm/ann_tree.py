"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, about, chosen by a
hash of the id); every row is then sent down to its leaf. A query walks the
tree best bin first: a priority queue holds the nodes met so far by the inner
product with their centre plus a share of their spread, the best one is opened
next, and each leaf that comes out is visited. How many leaves are visited is
widened, on calibration queries answered exactly over all rows, until the
recall reached is ``RECALL``; a query whose leaves hold fewer rows than it asks
for goes on until they suffice. Visited leaves are searched in double precision
on the original vectors.

Defined results. Vectors that are null, empty, zero, hold null or non-finite
components or have another length than most take no part, nor do null ids;
rows sharing a ``vec_id`` count once, with the smallest vector. Fewer
candidates than asked for: all of them. Equal scores: smaller id first. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import (
    QUERY_SCHEMA, best, chunked, matrix, packed, query_blocks, rows_of, sample_of, searched, top_scores, usable,
)

SAMPLE = 16_384
BRANCHES = 8
#: Sample rows of a leaf, at most.
LEAF = 160
#: Recall that calibration must reach, on so many queries.
RECALL = 0.96
CALIBRATION = 64
K = 20


@dataclass
class Tree:
    """Nodes with centres; ``children[i]`` are node numbers, empty for a leaf; ``leaf[i]`` its number."""

    centers: list[np.ndarray] = field(default_factory=list)
    spread: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    leaves: int = 0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            c = np.stack([self.centers[i] for i in kids])
            near = (x[rows] @ c.T - (c * c).sum(1) / 2).argmax(1)
            for j, kid in enumerate(kids):
                if len(mine := rows[near == j]):
                    todo.append((kid, mine))
        return out

    def visit(self, q: np.ndarray, visits: int, rows: dict[int, int] | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: at least ``visits``, and by the ``rows`` of leaves as many as hold ``least``."""
        size = float(np.sqrt(q @ q))
        queue, out, held = [(0.0, 0)], [], 0
        while queue and (len(out) < visits or (rows is not None and held < least)):
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                out.append(self.leaf[node])
                held += rows.get(self.leaf[node], 0) if rows is not None else 0
                continue
            for kid in kids:
                heapq.heappush(queue, (-float(q @ self.centers[kid]) - 0.25 * size * self.spread[kid], kid))
        return out


def _lloyd(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)
        for j in range(k):
            if len(mine := x[near == j]):
                centers[j] = mine.mean(0)
    return (x @ centers.T - (centers * centers).sum(1) / 2).argmax(1)


def build(x: np.ndarray, branches: int = BRANCHES, leaf: int = LEAF, seed: int = 3) -> Tree:
    """Split by k-means until a node holds at most ``leaf`` sample rows or cannot be split."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def add(rows: np.ndarray) -> int:
        part = x[rows]
        center = part.mean(0)
        tree.centers.append(center)
        tree.spread.append(float(np.sqrt(((part - center) ** 2).sum(1).max())))
        tree.children.append([])
        tree.leaf.append(-1)
        return len(tree.centers) - 1

    todo = [(add(np.arange(len(x))), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        near = _lloyd(x[rows].copy(), min(branches, len(rows)), rng) if len(rows) > leaf else np.zeros(len(rows))
        parts = [rows[near == j] for j in np.unique(near)]
        if len(parts) < 2:  # small enough, or all alike
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
            continue
        for part in parts:
            kid = add(part)
            tree.children[node].append(kid)
            todo.append((kid, part))
    return tree


def _search(k: int):
    def run(q_ids, q, floor, ids, x):
        return top_scores(q @ x.T, q_ids, ids, k, floor)

    return run


def calibrated_visits(tree: Tree, blocks: DataFrame, chunks: dict[int, int], queries: DataFrame, k: int, recall: float) -> tuple[int, float]:
    """Leaves to visit for ``recall`` on the given few queries, and the recall there."""
    everywhere = lambda x, floor: ((c, np.arange(len(x))) for c in chunks)
    truth = best(searched(queries.mapInPandas(query_blocks(everywhere), QUERY_SCHEMA), blocks, chunks, _search(k)), k)
    rows = queries.select("vec_id", "v").collect()
    home = {r["query_id"]: [] for r in truth.select("query_id").distinct().collect()}
    for r in truth.collect():
        home[r["query_id"]].append(r["vec_id"])
    wanted = sorted({v for vs in home.values() for v in vs})
    spark = blocks.sparkSession
    # the leaves of the true neighbours: one row each of a bounded list
    ids = F.broadcast(spark.createDataFrame([(w,) for w in wanted], "want bigint")) if wanted else None
    if ids is None:
        return tree.leaves, 1.0

    def members(batches):
        for part in batches:
            for cell, raw in zip(part["cell"], part["ids"]):
                own = np.frombuffer(raw, np.int64)
                yield pd.DataFrame({"cell": np.full(len(own), cell, np.int32), "want": own})

    place = {r["want"]: r["cell"] for r in blocks.select("cell", "ids").mapInPandas(members, "cell int, want bigint").join(ids, "want").collect()}
    ranks = []
    for r in rows:
        order = {c: i for i, c in enumerate(tree.visit(np.array(r["v"]), tree.leaves))}
        ranks += [order[place[v]] for v in home.get(r["vec_id"], [])]
    ranks = np.array(ranks)
    visits, share = 1, 0.0
    while visits < tree.leaves:
        share = float((ranks < visits).mean())
        if share >= recall:
            break
        visits = min(tree.leaves, max(visits + 1, visits * 9 // 8))
    return visits, float((ranks < visits).mean())


def nearest(rows: DataFrame, is_query, vec_id="vec_id", vector="embedding", k: int = K, sample: int = SAMPLE,
            leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` largest inner products of the rows that meet ``is_query``."""
    vecs = usable(rows, vec_id, vector, zero=False)
    spark = rows.sparkSession
    x = sample_of(vecs, sample)
    if not len(x):
        x = np.array([r["v"] for r in vecs.limit(1).collect()])
        if not len(x):
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = build(x, leaf=leaf)
    state = spark.sparkContext.broadcast(tree)  # at most the sample's size

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(state.value.assign(matrix(v)) if len(v) else [], dtype="int32")

    from ..session import materialise

    assigned = materialise(vecs.withColumn("cell", leaf_of("v")), "leaves")
    held = rows_of(assigned)
    chunks = chunked(held)
    blocks = packed(assigned, chunks)
    asked = assigned.where(is_query).select("vec_id", "v", F.lit(float("-inf")).alias("floor"))
    total = asked.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("calibrate"), "vec_id"), 11) / F.lit(float(2**53))
    some = asked.where(draw < min(1.0, CALIBRATION / total)) if total else asked
    visits, _ = calibrated_visits(tree, blocks, chunks, some, k, recall)

    def cells_of(q: np.ndarray, floor: np.ndarray):
        by: dict[int, list[int]] = {}
        for i, row in enumerate(q):
            for cell in state.value.visit(row, visits, held, k + 1):  # one row is the query itself
                by.setdefault(cell, []).append(i)
        for cell, at in by.items():
            yield cell, np.array(at)

    found = searched(asked.mapInPandas(query_blocks(cells_of), QUERY_SCHEMA), blocks, chunks, _search(k))
    return best(found, k)


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """Contract query: the 20 nearest found of every vector whose id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
