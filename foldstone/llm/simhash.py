"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints are made by one pass over the texts. The distinct ones are
sorted by Gray rank, in which neighbours share leading bits, and cut into
pages of bounded size. A page knows the bits that all its members share (mask)
and their values (pattern); nodes above factor the masks of their children in
the same way. The self join descends this tree from the root against itself:
a pair of nodes whose shared bits already differ in more places than allowed
is dropped with everything below it, and only the surviving pairs of pages
compare members, again by groups first. The levels are DataFrames joined on
node ids, so neither the index nor the pairs pass through the driver.

A page pair hands on a spanning forest of its links, never all pairs.

Defined results. Null or empty text, or one without words: fingerprint zero,
linked like any other. Fewer than three words: one shingle of the whole
sequence. Repeated shingles count each time. Null ``doc_id``: the row keeps
its fingerprint; its group's id is the smallest non-null id (null if none).
Repeated rows share a fingerprint and so a group. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import components

#: Words of a shingle, and bits in which linked fingerprints differ at most.
SHINGLE = 3
DISTANCE = 2
#: Fingerprints of a leaf page, members of a group inside it, children of a node.
PAGE = 512
GROUP = 16
FANOUT = 16
_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The fingerprint of one text as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).translate(_SPACES).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        line = b" ".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts = (ends - size).tolist()
        hashes = [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1:].tolist())]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):  # bounded, however long the text
        part = np.array(hashes[at:at + 4096], ">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits).view(">i8")[0])


def fingerprints(docs: DataFrame, doc_id="doc_id", text="text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is a signed long."""

    @F.pandas_udf("bigint")
    def printed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), printed(F.col(text)).alias("fp"))


# ------------------------------------------------------------------- the index

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order: the prefix parity of its bits."""
    out = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(shift))
    return out


def _gray_column(fp):
    """:func:`gray_rank` as a column whose signed order is the Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(2**63)))


def _shared(parts: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the bits that all members of each run share, and their values."""
    both, any_ = np.bitwise_and.reduceat(parts, bounds), np.bitwise_or.reduceat(parts, bounds)
    return ~(both ^ any_), both


def _pages(distinct: DataFrame, page: int) -> DataFrame:
    """(node, parent order ``place``, mask, pattern, members) of the leaf pages."""
    placed = (
        distinct.select("fp", _gray_column(F.col("fp")).alias("g"))
        .repartitionByRange("g").sortWithinPartitions("g").select("fp", F.spark_partition_id().alias("p"))
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, n, p = np.zeros(0, np.int64), 0, 0
        for part in batches:
            if not len(part):
                continue
            p = int(part["p"].iloc[0])
            rest = np.concatenate([rest, part["fp"].to_numpy(np.int64)])
            whole = len(rest) // page * page
            if whole:
                yield _page_rows(rest[:whole], page, p, n)
                n, rest = n + whole // page, rest[whole:]
        if len(rest):
            yield _page_rows(rest, page, p, n)

    return placed.mapInPandas(cut, "p int, n bigint, mask bigint, pattern bigint, members binary")


def _page_rows(fps: np.ndarray, page: int, p: int, n: int) -> pd.DataFrame:
    bounds = np.arange(0, len(fps), page)
    mask, pattern = _shared(fps, bounds)
    return pd.DataFrame({
        "p": p, "n": n + np.arange(len(bounds)), "mask": mask, "pattern": pattern,
        "members": [fps[b:b + page].tobytes() for b in bounds],
    })


def _parents(nodes: DataFrame) -> DataFrame:
    """Nodes one level up: the bits shared by all children."""
    both = F.bit_and("pattern")
    # a bit is shared if every child shares it and all have the same value
    some = F.bit_or(F.col("pattern"))
    shared = F.bit_and("mask").bitwiseAND(F.bitwise_not(both.bitwiseXOR(some)))
    return nodes.groupBy("parent").agg(shared.alias("mask"), both.alias("pattern")).select(
        F.col("parent").alias("node"), "mask", F.col("pattern").bitwiseAND(F.col("mask")).alias("pattern")
    )


def _far(a: str, b: str):
    """Accumulated differences of two nodes on the bits that both share."""
    return F.bit_count(
        F.col(f"{a}_pattern").bitwiseXOR(F.col(f"{b}_pattern")).bitwiseAND(F.col(f"{a}_mask")).bitwiseAND(F.col(f"{b}_mask"))
    )


def _side(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("node", "parent", "mask", "pattern") if c in nodes.columns])


def _page_pairs(pages: DataFrame, distance: int, fanout: int) -> DataFrame:
    """Pairs (a, b) of page ids, a <= b, that may hold members within ``distance``."""
    levels, count = [], pages.count()
    level = pages.select("node", "mask", F.col("pattern").bitwiseAND(F.col("mask")).alias("pattern"))
    while count > 1:
        level = level.withColumn("parent", F.floor(F.col("node") / fanout))
        levels.append(level)
        level = materialise(_parents(level), "nodes")
        count = level.count()
    pairs = level.select(F.col("node").alias("a_node"), F.col("node").alias("b_node"))
    for below in reversed(levels):
        left, right = _side(below, "a"), _side(below, "b")
        pairs = (
            pairs.withColumnsRenamed({"a_node": "a_parent", "b_node": "b_parent"})
            .join(left, "a_parent").join(right, "b_parent")
            .where((F.col("a_node") <= F.col("b_node")) & (_far("a", "b") <= distance))
            .select("a_node", "b_node")
        )
        pairs = materialise(pairs, "pairs")
    return pairs


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links (a[i], b[i])."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = top(x), top(y)
        if u != v:
            root[u] = v
            left.append(x)
            right.append(y)
    return left, right


def close_members(a: np.ndarray, b: np.ndarray, same: bool, distance: int, group: int = GROUP):
    """Links between two pages: groups of members first, then members of the groups left."""
    sides = []
    for fps in (a, b):
        bounds = np.arange(0, len(fps), group)
        sides.append((fps, bounds, *_shared(fps, bounds)))
    (a, at, am, ap), (b, bt, bm, bp) = sides
    near = np.bitwise_count(((ap[:, None] ^ bp[None, :]) & am[:, None] & bm[None, :]).view(np.uint64)) <= distance
    if same:
        near &= at[:, None] <= bt[None, :]
    gi, gj = np.nonzero(near)
    step = np.arange(group)
    links_a, links_b = [], []
    for at_ in range(0, len(gi), 4096):
        i = at[gi[at_:at_ + 4096], None] + step
        j = bt[gj[at_:at_ + 4096], None] + step
        x, y = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        hit = np.bitwise_count((x[:, :, None] ^ y[:, None, :]).view(np.uint64)) <= distance
        k, r, c = np.nonzero(hit)
        u, v = a[np.minimum(i[k, r], len(a) - 1)], b[np.minimum(j[k, c], len(b) - 1)]
        keep = u != v
        f, g = _forest(u[keep], v[keep])
        links_a += f
        links_b += g
    return _forest(np.array(links_a, np.int64), np.array(links_b, np.int64))


def links(distinct: DataFrame, distance: int = DISTANCE, page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(a, b): fingerprints within ``distance``, enough of them to connect every group."""
    pages = materialise(_pages(distinct, page), "pages")
    # pages get running numbers in Gray order: the count of pages in the partitions before
    counts = pages.groupBy("p").agg(F.max("n").alias("last"))
    from pyspark.sql.window import Window

    before = Window.partitionBy(F.lit(0)).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("p").alias("q"), F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("shift"))
    pages = materialise(
        pages.join(F.broadcast(shift), F.col("p") == F.col("q"))  # a row for each range partition
        .select((F.col("n") + F.col("shift")).alias("node"), "mask", "pattern", "members"), "pages",
    )
    pairs = _page_pairs(pages, distance, fanout)
    left = pages.select(F.col("node").alias("a_node"), F.col("members").alias("a"))
    right = pages.select(F.col("node").alias("b_node"), F.col("members").alias("b"))
    both = pairs.join(left, "a_node").join(right, "b_node")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found_a, found_b = [], []
            for same, x, y in zip(part["same"], part["a"], part["b"]):
                u, v = close_members(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), bool(same), distance)
                found_a += u
                found_b += v
            yield pd.DataFrame({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    return both.select((F.col("a_node") == F.col("b_node")).alias("same"), "a", "b").repartition(
        both.sparkSession.sparkContext.defaultParallelism * 4
    ).mapInPandas(compare, "a bigint, b bigint")


def near_groups(docs: DataFrame, doc_id="doc_id", text="text", distance: int = DISTANCE, width: int = SHINGLE,
                page: int = PAGE, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    prints = materialise(fingerprints(docs, doc_id, text, width), "prints")
    # copies meet here once: one row a distinct fingerprint from now on
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    edges = links(distinct, distance, page, fanout)
    group = components(edges)
    # groups of fingerprints become groups of documents: the smallest id among their members
    named = distinct.join(group.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("g")
    )
    least = named.groupBy("g").agg(F.min("first").alias("component_id"))
    labels = materialise(named.join(least, "g").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp")


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: fingerprint and component of every document."""
    groups = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
