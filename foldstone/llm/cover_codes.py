"""Vector code compression: product quantisation by Lloyd rounds over cover trees.

Vectors become integers, floor(scale * x), and are cut into equal parts; each
part position has a codebook of entries that Lloyd rounds improve.

Cover-tree Lloyd. Rows are packed in blocks of ``BLOCK``, and for every part
position of a block a cover tree is built once and stored: nested nets of
halving radius, each node with its centre, the radius that covers its points
and the range its points take in the tree's order, along which counts and sums
are cumulative. An assignment pass goes down the trees with all entries: when
the nearest entry of a centre is nearer than any other by more than twice the
radius, the triangle inequality gives it to the node's whole range, whose sums
are one difference; only ambiguous nodes go on to their children, and only
points that are left at the bottom are compared exactly, in integers. Passes
return sums by entry; vectors are never shuffled.

Defined results. Rows whose vector is null, empty or holds null or non-finite
components are dropped, as are vectors whose length is no multiple of the
number of parts or not the most frequent such length, and those with a scaled
component of 2^28 or more in size (their errors need not fit a long). Repeated
ids are rows of their own; null ids come last where rows are ordered by id,
equal ids by vector. Equal vectors are one point of a tree with a weight.
Fewer rows than entries: as many entries as rows. No row: no result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import attach
from ..session import materialise, settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of a block.
BLOCK = 2048
LARGEST = 2**28
#: Added to radii and margins against the rounding of square roots.
SLACK = 1e-6


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of integer rows, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[None, :, j]
        out += d * d
    return out


class CoverTree:
    """A cover tree over distinct integer points with weights.

    Points are kept in tree order. Node i covers the points ``low[i]`` to
    ``high[i]`` within ``radius[i]`` of point ``centre[i]``; its child nodes are
    ``child[i]`` to ``child[i] + kids[i]``; points below it that are in no child
    node have ``owner`` i. Sums along the order are cumulative.
    """

    def __init__(self, points: np.ndarray, weights: np.ndarray):
        m = len(points)
        order = np.arange(m)
        centre, low, high, radius, child, kids = [0], [0], [m], [0.0], [0], [0]
        owner = np.zeros(m, np.int64)
        # clusters still to split: node, centre, range; far: distance of each point to its cluster's centre
        node_of, heads = np.array([0]), np.array([0])
        starts, ends = np.array([0]), np.array([m])
        far = np.sqrt(((points - points[0]) ** 2).sum(1).astype(float))
        radius[0] = float(far.max()) if m else 0.0
        scale = radius[0]
        while len(starts) and scale > 0:
            scale /= 2
            rows = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
            cluster = np.repeat(np.arange(len(starts)), ends - starts)
            pts = points[order[rows]]
            near, label = far[rows], np.zeros(len(rows), np.int64)
            net = [[int(c)] for c in heads]
            active = np.arange(len(rows))
            while True:  # each cluster takes its farthest point into its net until the net covers it
                cut = np.flatnonzero(np.concatenate([[True], cluster[active][1:] != cluster[active][:-1]]))
                most = np.maximum.reduceat(near[active], cut)
                open_ = most > scale
                if not open_.any():
                    break
                span = np.diff(np.append(cut, len(active)))
                at_most = near[active] == np.repeat(most, span)
                first = active[cut + np.array([at_most[a:a + n].argmax() for a, n in zip(cut, span)])][open_]
                active = active[np.repeat(open_, span)]
                span = span[open_]
                for f in first.tolist():
                    net[cluster[f]].append(int(order[rows[f]]))
                new = np.repeat(first, span)
                d = np.sqrt(((pts[active] - pts[new]) ** 2).sum(1).astype(float))
                closer = d < near[active]
                hit = active[closer]
                near[hit] = d[closer]
                label[hit] = np.array([len(n) - 1 for n in net])[cluster[hit]]
            far[rows] = near
            split = np.array([len(n) > 1 for n in net])
            # points in the order of their net centres, inside the range of their cluster
            sort = np.lexsort((label, cluster))
            order[rows] = order[rows[sort]]
            far[rows] = far[rows[sort]]
            cluster, label, near = cluster[sort], label[sort], near[sort]
            cut = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (label[1:] != label[:-1])]))
            size = np.diff(np.append(cut, len(rows)))
            most = np.maximum.reduceat(near, cut)
            n_node, n_head, n_start, n_end = [], [], [], []
            for c, lab, a, n, r in zip(cluster[cut].tolist(), label[cut].tolist(), rows[cut].tolist(), size.tolist(), most.tolist()):
                up = int(node_of[c])
                if not split[c]:  # the same cluster, one level down
                    n_node.append(up)
                elif n == 1:
                    owner[a] = up
                    continue
                else:
                    if not kids[up]:
                        child[up] = len(centre)
                    kids[up] += 1
                    centre.append(net[c][lab])
                    low.append(a)
                    high.append(a + n)
                    radius.append(r)
                    child.append(0)
                    kids.append(0)
                    n_node.append(len(centre) - 1)
                n_head.append(net[c][lab])
                n_start.append(a)
                n_end.append(a + n)
            node_of, heads, starts, ends = (np.array(x, np.int64) for x in (n_node, n_head, n_start, n_end))
        place = np.empty(m, np.int64)
        place[order] = np.arange(m)
        self.order, self.owner = order, owner
        self.points, self.weights = points[order], weights[order]
        self.centre, self.low, self.high = place[np.array(centre)] if m else np.array(centre), np.array(low), np.array(high)
        self.radius, self.child, self.kids = np.array(radius), np.array(child), np.array(kids)
        self.count_to = np.concatenate([[0], np.cumsum(self.weights)])
        self.sum_to = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points * self.weights[:, None], axis=0)])

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(codes in tree order, counts and sums by entry, points compared one by one)."""
        codes = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(len(book), np.int64), np.zeros(book.shape, np.int64)
        ambiguous = np.zeros(len(self.centre), bool)
        nodes = np.array([0]) if len(self.points) else np.zeros(0, np.int64)
        while len(nodes):
            d = np.sqrt(squares(self.points[self.centre[nodes]], book).astype(float))
            best = d.argmin(1)
            nearest = d[np.arange(len(nodes)), best]
            if len(book) > 1:
                d[np.arange(len(nodes)), best] = np.inf
                sure = nearest + 2 * self.radius[nodes] + SLACK * (1 + nearest) < d.min(1)
            else:
                sure = np.ones(len(nodes), bool)
            a, b, code = self.low[nodes[sure]], self.high[nodes[sure]], best[sure]
            np.add.at(counts, code, self.count_to[b] - self.count_to[a])
            np.add.at(sums, code, self.sum_to[b] - self.sum_to[a])
            codes[np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(a) else a] = np.repeat(code, b - a)
            nodes = nodes[~sure]
            ambiguous[nodes] = True
            at, n = self.child[nodes], self.kids[nodes]
            nodes = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        left = np.flatnonzero(ambiguous[self.owner])
        if len(left):
            code = squares(self.points[left], book).argmin(1)  # ties: the first
            codes[left] = code
            np.add.at(counts, code, self.weights[left])
            np.add.at(sums, code, self.points[left] * self.weights[left, None])
        return codes, counts, sums, len(left)


def packed_tree(values: np.ndarray) -> bytes:
    """A tree over the rows of ``values``, with the position of each row in it."""
    points, inverse, weights = np.unique(values, axis=0, return_inverse=True, return_counts=True)
    tree = CoverTree(points, weights)
    place = np.empty(len(points), np.int64)
    place[tree.order] = np.arange(len(points))
    small = np.int32
    state = (tree.points.astype(small), tree.weights.astype(small), tree.owner.astype(small), tree.centre.astype(small), tree.low.astype(small),
             tree.high.astype(small), tree.radius, tree.child.astype(small), tree.kids.astype(small), place[inverse.ravel()].astype(small))
    return pickle.dumps(state, protocol=5)


def unpacked_tree(blob: bytes) -> tuple[CoverTree, np.ndarray]:
    """(tree, position of every row of the block in it)."""
    tree = CoverTree.__new__(CoverTree)
    points, weights, tree.owner, tree.centre, tree.low, tree.high, tree.radius, tree.child, tree.kids, place = pickle.loads(blob)
    tree.points, tree.weights = points.astype(np.int64), weights.astype(np.int64)
    tree.count_to = np.concatenate([[0], np.cumsum(tree.weights)])
    tree.sum_to = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(tree.points * tree.weights[:, None], axis=0)])
    return tree, place


def usable_vectors(rows: DataFrame, vec_id: str, vector: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, ``v`` as integers; stored."""
    v = F.col(vector).cast("array<double>")
    scaled = F.transform(v, lambda x: F.floor(x * scale))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * scale < LARGEST))
    kept = rows.where((F.size(v) > 0) & (F.size(v) % parts == 0) & fine).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), scaled.alias("v")
    )
    kept = materialise(kept, "vectors")
    common = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.where(F.size("v") == (common["d"] if common else 0))


def tree_blocks(vectors: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Stored blocks: their rows and one packed tree a part position."""
    label = vectors.schema["label"].dataType.simpleString()
    schema = f"block bigint, vec_ids array<bigint>, labels array<{label}>, trees array<binary>"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rest = TaskContext.get().partitionId() << 32, None

        def closed(table: pa.Table) -> pa.RecordBatch:
            flat = table.column("v").combine_chunks().flatten().to_numpy()
            values = flat.reshape(len(table), parts, -1).astype(np.int64)
            trees = [packed_tree(np.ascontiguousarray(values[:, p])) for p in range(parts)]
            whole = lambda name: pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), table.column(name).combine_chunks())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), whole("vec_id"), whole("label"), pa.array([trees], pa.list_(pa.binary()))], ["block", "vec_ids", "labels", "trees"]
            )

        for batch in batches:
            piece = pa.Table.from_batches([batch])
            rest = piece if rest is None else pa.concat_tables([rest, piece])
            while len(rest) >= block:
                yield closed(rest.slice(0, block))
                rest, number = rest.slice(block), number + 1
        if rest is not None and len(rest):
            yield closed(rest)

    return materialise(vectors.select("vec_id", "label", "v").mapInArrow(build, schema), "trees")


def first_books(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """(part, entry, component): the parts of the ``entries`` rows that come first by id."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    values = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1)
    return np.ascontiguousarray(values.transpose(1, 0, 2))


def improved(blocks: DataFrame, books: np.ndarray) -> tuple[np.ndarray, float]:
    """(books after one Lloyd round, share of points compared one by one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared, points = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64), 0, 0
        for batch in batches:
            for trees in batch.column(0).to_pylist():
                for p, blob in enumerate(trees):
                    tree, _ = unpacked_tree(blob)
                    _, n, s, left = tree.assign(books[p])
                    counts[p] += n
                    sums[p] += s
                    compared, points = compared + left, points + len(tree.points)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"]
        )
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([compared]), pa.array([points]), pa.array([[]], pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    found = blocks.select("trees").mapInArrow(run, "part bigint, entry bigint, n bigint, s array<bigint>")
    wide = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(books.shape[2])]
    key = F.when(F.col("part") >= 0, F.col("entry"))  # the last line of each task counts comparisons
    totals = found.groupBy("part", key.alias("at")).agg(F.sum("n").alias("n"), F.sum("entry").alias("entries"), *wide).collect()
    new, share = books.copy(), 0.0
    for r in totals:
        if r["part"] < 0:
            share = r["entries"] / max(r["n"], 1)
        else:
            new[r["part"], r["at"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(books.shape[2])]
    return new, share


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, codes, error) of every row: entry numbers in part order and the sum of squared distances."""
    label = blocks.schema["labels"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, labels = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                codes, error = np.zeros((len(ids), len(books)), np.int32), np.zeros(len(ids), np.int64)
                for p, blob in enumerate(batch.column(2)[i].as_py()):
                    tree, place = unpacked_tree(blob)
                    own = tree.assign(books[p])[0]
                    codes[:, p] = own[place]
                    error += ((tree.points - books[p][own]) ** 2).sum(1)[place]
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(list(codes), pa.list_(pa.int32())), pa.array(error)], ["vec_id", "label", "codes", "error"]
                )

    return blocks.select("vec_ids", "labels", "trees").mapInArrow(run, f"vec_id bigint, label {label}, codes array<int>, error bigint")


def compress(rows: DataFrame, vec_id="vec_id", vector="embedding", label="label", parts=PARTS, entries=ENTRIES, rounds=ROUNDS, scale=SCALE, block=BLOCK):
    """(coded rows as of :func:`coded`, final books as (part, entry, component)); a vector is about the entries of its codes."""
    vectors = usable_vectors(rows, vec_id, vector, label, parts, scale)
    blocks = tree_blocks(vectors, parts, block)
    books = first_books(vectors, parts, entries)
    for _ in range(rounds if books.size else 0):
        books, _ = improved(blocks, books)
    return coded(blocks, books), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_codes(spark, sf_dir: str) -> DataFrame:
    """Contract query: codes and errors of all embeddings after two rounds."""
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    found = materialise(found, "codes")
    sums = settle(found.groupBy("label").agg(F.sum("error").alias("label_error")))
    return attach(found, sums, "label").select(
        "vec_id", F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"), "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )


def _round(n: int) -> str:
    """SQL of one assignment and update over ``book{n}``."""
    return f"""near{n} AS (SELECT p.r, p.part, p.s, arg_min(b.entry, dist * 64 + b.entry) AS entry, min(dist) AS dist FROM part p JOIN book{n} b ON b.part = p.part,
    LATERAL (SELECT list_sum(list_transform(range(1, len(p.s) + 1), lambda i: (p.s[i] - b.c[i]) ** 2))::HUGEINT AS dist) GROUP BY p.r, p.part, p.s)"""


def _update(n: int) -> str:
    return f"""sums{n} AS (SELECT part, entry, i, floor_div(sum(s[i]), count(*)) AS x FROM near{n}, unnest(range(1, len(s) + 1)) AS u(i) GROUP BY ALL),
  new{n} AS (SELECT part, entry, list(x ORDER BY i) AS c FROM sums{n} GROUP BY ALL),
  book{n + 1} AS (SELECT b.part, b.entry, coalesce(w.c, b.c) AS c FROM book{n} b LEFT JOIN new{n} w USING (part, entry))"""


#: The contract query in DuckDB SQL.
ORACLE = ("""WITH fine AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT)) AS r,
    vec_id::BIGINT AS vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(embedding) % 16 = 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
  part AS (SELECT r, p AS part, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS s FROM fine, unnest(range(0, 16)) AS u(p)),
  book0 AS (SELECT part, r - 1 AS entry, s AS c FROM part WHERE r <= 64),
  """ + ",\n  ".join([_round(0), _update(0), _round(1), _update(1), _round(2)]) + """,
  total AS (SELECT r, string_agg(lpad(format('{:x}', entry), 2, '0'), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM near2 GROUP BY r),
  digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM book2)
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM fine JOIN total USING (r), digest""").replace(
    "floor_div(sum(s[i]), count(*))", "((sum(s[i]) - ((sum(s[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT"
)
