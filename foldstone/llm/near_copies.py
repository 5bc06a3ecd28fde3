"""Near copies by verified similarity: SimHash candidates from the Gray index, an exact check, then groups.

Two texts are near copies if their sets of five-word shingles have a Jaccard
similarity of 0.8 or more. One 64-bit fingerprint of a whole text is too blunt
for that (such texts differ in some ten bits), so every distinct text gets
several fingerprints, each of a small sample of its shingles: those that come
first in an order of the fingerprint's own. Texts with a similarity s agree in
a fingerprint of r shingles with probability s**r, so with 10 fingerprints of
4 shingles a pair at 0.8 is found with probability 0.995. The fingerprints go
into the Gray-order index of :mod:`simhash`; those within ``distance`` bits
form one bucket.

Buckets only give candidates. Every member is first compared with its bucket's
leader; large buckets that still hold several groups get further leaders. What
is left are members of one bucket in different groups. In a large bucket each
gives its first shingles in an order of the bucket, rare ones first: two
similar sets share one of these (prefix filter). Rare ones name the pairs to
compare; only members that share a frequent one still meet all others of that
kind, as all members of a small bucket do:
pairwise in pages of bounded size, each page pair one small group of rows that
hands on a spanning forest. So no pair of a bucket is skipped that could still
join two groups, and a bucket of many copies, or of many texts a little too far
from one text, costs a few comparisons a member.

Shingles are compared by 64-bit hashes. Case of A-Z and white space are
ignored: texts that differ in nothing else are one text.

Defined results. Fewer than five words: one shingle of the whole sequence.
Null or empty text, or one without words: all such rows are copies of each
other. Repeated rows are copies. Different texts with one ``doc_id`` are
different documents. Of each group the row with the smallest ``doc_id`` stays
(nulls last, then by text digest, then by the whole row as JSON). Empty table:
empty result. Other columns, whatever their names, pass unchanged. Texts of
any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from . import simhash
from .common import text_of
from .components import components

WIDTH = 5
SIMILARITY = 0.8
#: Fingerprints of a text, shingles in each, bits in which candidates differ at most.
VIEWS = 10
SAMPLE = 4
DISTANCE = 1
#: Texts of a page, about.
PAGE = 32
#: Buckets of more pages get further leaders first, at most so many, and are then met by first shingles.
WIDE = 4
LEADERS = 8
#: Members of a large bucket that tell its frequent shingles, about, and members whose first shingles meet at once.
TOLD = 64
MET = 1024
#: Shingles put in order at once.
PART = 1 << 16
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _plain(text: Column) -> Column:
    """Lower-case words with one space between them."""
    return F.trim(F.regexp_replace(F.translate(text, _CAPITALS, _SMALL), r"[\x20\x09-\x0D]+", " "))


def digest_of(text: str) -> Column:
    """128 bits that stand for the words of a text."""
    return F.unhex(F.md5(_plain(text_of(text))))


def shingle_set(plain: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in plain form; empty if it has no words."""
    from xxhash import xxh64_intdigest

    line = plain.encode("utf-8", "surrogatepass")
    if not line:
        return np.zeros(0, np.uint64)
    gaps = np.nonzero(np.frombuffer(line, np.uint8) == 32)[0]
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)]
    if len(starts) <= width:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    hashed = (xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[width - 1:]))
    return np.unique(np.fromiter(hashed, np.uint64, len(starts) - width + 1))


def _orders(views: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(6)
    return draw.integers(0, 2**63, views, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 2**63, views, np.uint64)


def sampled_fingerprints(shingles: np.ndarray, views: int = VIEWS, sample: int = SAMPLE) -> np.ndarray:
    """SimHash of the first shingles in each view's order, as signed 64-bit integers."""
    if not len(shingles):
        return np.zeros(views, np.int64)
    factor, shift = _orders(views)
    first = np.zeros((views, 0), np.uint64)
    for at in range(0, len(shingles), PART):
        placed = (shingles[at:at + PART] ^ shift[:, None]) * factor[:, None]
        # low bits of a product depend on few bits of the hash: fold the high ones in
        placed = (placed ^ (placed >> np.uint64(32))) * factor[:, None]
        first = np.concatenate([first, placed], axis=1)
        if first.shape[1] > sample:
            first = np.partition(first, sample - 1, axis=1)[:, :sample]
    bits = np.unpackbits(np.ascontiguousarray(first, ">u8").view(np.uint8).reshape(*first.shape, 8), axis=2)
    ones = bits.sum(1, dtype=np.int64) * 2 > first.shape[1]
    return np.packbits(ones, axis=1).view(">i8")[:, 0].astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets of shingles are similar enough."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def common_shingles(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that at least two of the sets hold, and how many do."""
    found, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    return found[counts > 1], counts[counts > 1]


def first_shingles(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, shortest: int, least: float = SIMILARITY) -> np.ndarray:
    """The first shingles in the order (count, hash), so many that similar sets of ``shortest`` shingles or more share one."""
    n = len(shingles)
    # a similar set has at least so many shingles, and shares at least so many
    shared = least / (1 + least) * (n + max(shortest, least * n))
    many = max(0, n - int(np.ceil(shared - 1e-6)) + 1)
    at = np.searchsorted(common, shingles)
    hit = at < len(common)
    hit[hit] = common[at[hit]] == shingles[hit]
    order = np.zeros(n, np.int64)
    order[hit] = counts[at[hit]]
    return shingles[np.argsort(order, kind="stable")[:many]]


def meetings(firsts: list[np.ndarray], groups: list, most: int) -> tuple[set[tuple[int, int]], set[int]]:
    """Pairs of members of different groups that share a shingle of at most ``most`` members, and the members that share another one."""
    tokens = np.concatenate([np.zeros(0, np.uint64), *firsts])
    who = np.repeat(np.arange(len(firsts)), [len(f) for f in firsts])
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    starts = np.nonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))[0] if len(tokens) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(tokens))
    pairs: set[tuple[int, int]] = set()
    crowded: set[int] = set()
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        run = who[a:b].tolist()
        if len({groups[i] for i in run}) == 1:
            continue
        if len(run) > most:
            crowded.update(run)
        else:
            pairs.update((i, j) for k, i in enumerate(run) for j in run[k + 1:] if groups[i] != groups[j])
    return pairs, crowded


def differing(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> int:
    """In how many shingles a set differs from those that over half as many members hold as the most frequent one."""
    core = common[counts * 2 > counts.max(initial=0)]
    return len(shingles) + len(core) - 2 * len(np.intersect1d(shingles, core, assume_unique=True))


def _prints(docs: DataFrame, doc_id: str, text: str, width: int, views: int, sample: int) -> DataFrame:
    """(digest, none, id, fps) of every distinct text: its smallest id, null last, and its fingerprints."""

    @F.arrow_udf("array<bigint>")
    def printed(texts: pa.Array) -> pa.Array:
        # a text at a time: a batch of long texts is not held a second time as Python strings
        return pa.array((sampled_fingerprints(shingle_set(t.as_py(), width), views, sample) for t in texts), pa.list_(pa.int64()))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), digest_of(text).alias("digest"), printed(_plain(text_of(text))).alias("fps"))
    rows = materialise(rows, "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
    return materialise(rows.groupBy("digest").agg(first, F.first("fps").alias("fps")), "texts")


def _members(texts: DataFrame, distance: int) -> DataFrame:
    """(bucket, digest) of every text in a bucket of at least two texts."""
    fps = texts.select("digest", F.explode("fps").alias("fp")).distinct()
    fps = materialise(fps, "fps")
    linked = simhash.links(fps.select("fp").distinct(), distance)
    near = components(linked).withColumnRenamed("node", "fp")
    placed = fps.join(near, "fp", "left").select(F.coalesce("component", "fp").alias("bucket"), "digest").distinct()
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", "n")
    return materialise(placed.join(shared, "bucket"), "members")


def _sets(docs: DataFrame, text: str, members: DataFrame, width: int) -> DataFrame:
    """(digest, shingles) of the texts that have a candidate: sorted hashes as bytes."""

    @F.arrow_udf("binary")
    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array((shingle_set(t.as_py(), width).tobytes() for t in texts), pa.binary())

    wanted = members.select("digest").distinct()
    rows = docs.select(digest_of(text).alias("digest"), _plain(text_of(text)).alias("plain"))
    # one text of each digest first: texts are shuffled, which pack better than hashes
    rows = rows.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    return materialise(rows.select("digest", hashed("plain").alias("shingles")), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) that are similar."""

    @F.arrow_udf("boolean")
    def checked(a: pa.Array, b: pa.Array) -> pa.Array:
        # sets are read where they arrived, without a copy
        kept = (similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least) for x, y in zip(a, b))
        return pa.array(map(bool, kept), pa.bool_())

    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(checked("x", "y")).select("a", "b")


def _leader_links(members: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified links (a, b) between the members of each bucket and its smallest one."""
    leaders = members.groupBy("bucket").agg(F.min("digest").alias("a"))
    pairs = materialise(members.join(leaders, "bucket").where("digest <> a").select("a", F.col("digest").alias("b")).distinct(), "pairs")
    return _verified(pairs, sets, least)


def _open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, n, digest, g, big, n_big) of the members of buckets with several groups; ``big`` is the largest group of the bucket."""
    named = members.join(groups.withColumnRenamed("node", "digest"), "digest", "left").select(
        "bucket", "n", "digest", F.coalesce("component", "digest").alias("g")
    )
    sizes = named.groupBy("bucket", "g").agg(F.count(F.lit(1)).alias("c"))
    open_ = sizes.groupBy("bucket").agg(F.max(F.struct("c", "g")).alias("top"), F.count(F.lit(1)).alias("gs")).where("gs > 1")
    return named.join(open_.select("bucket", F.col("top.g").alias("big"), F.col("top.c").alias("n_big")), "bucket")


def _common(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of large buckets with their shingles, and (bucket, shortest, common, counts) as told by some of them.

    What is told only says which leader and which order serve best; results do not depend on it.
    """
    placed = materialise(rows.join(sets, "digest").select(*rows.columns, "shingles"), "large")
    told = placed.where(F.pmod(F.xxhash64("bucket", "digest"), "n") < TOLD).select("bucket", "shingles")

    def common(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        found, counts = common_shingles([np.frombuffer(s, np.uint64) for s in part["shingles"]])
        return pd.DataFrame({"bucket": [key[0]], "common": [found.tobytes()], "counts": [counts.astype(np.int64).tobytes()]})

    known = told.groupBy("bucket").applyInPandas(common, "bucket bigint, common binary, counts binary")
    shortest = placed.groupBy("bucket").agg(F.min(F.length("shingles") / 8).cast("int").alias("shortest"))
    return placed, materialise(shortest.join(known, "bucket", "left"), "common")


def _view(value: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), kind) if value.is_valid else np.zeros(0, kind)


def _hubs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(bucket, a, ga): of each large bucket the member that differs least from what most of its members share, and its group."""

    @F.arrow_udf("bigint")
    def distance(shingles: pa.Array, common: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.array((differing(_view(s, np.uint64), _view(c, np.uint64), _view(k, np.int64)) for s, c, k in zip(shingles, common, counts)), pa.int64())

    placed, known = _common(rows, sets)
    far = placed.join(known, "bucket").select("bucket", "digest", "g", distance("shingles", "common", "counts").alias("far"))
    lead = F.min_by(F.struct(F.col("digest").alias("a"), F.col("g").alias("ga")), F.struct("far", "digest")).alias("lead")
    return far.groupBy("bucket").agg(lead).select("bucket", "lead.*")


def _more_leaders(members: DataFrame, sets: DataFrame, found: DataFrame, groups: DataFrame, least: float, page: int) -> tuple[DataFrame, DataFrame]:
    """Links and groups after further leaders of buckets that hold several groups and many pages.

    The first is the member nearest to what most of the bucket share, each later one any from
    outside the largest group; it is compared with all members of other groups: a comparison a
    member. In a bucket of copies of one text a few leaders join nearly all; what they do not
    join is left to the first shingles and the pages.
    """
    for turn in range(LEADERS):
        rows = materialise(_open_members(members, groups).where(F.col("n") > WIDE * page), "open")
        if rows.isEmpty():
            break
        if turn:
            leader = F.min_by(F.struct(F.col("digest").alias("a"), F.col("g").alias("ga")), F.xxhash64(F.lit(turn), "digest")).alias("lead")
            leads = rows.where("g <> big").groupBy("bucket").agg(leader).select("bucket", "lead.*")
        else:
            leads = _hubs(rows, sets)
        pairs = materialise(rows.join(leads, "bucket").where("g <> ga").select("a", F.col("digest").alias("b")).distinct(), "pairs")
        new = materialise(_verified(pairs, sets, least), "links")
        if not new.isEmpty():
            found = found.union(new)
            groups = materialise(components(found), "groups")
        elif turn:
            break
    return found, groups


def _met_by_shingles(rows: DataFrame, sets: DataFrame, least: float, page: int) -> DataFrame:
    """(bucket, a, b) of the pairs of large buckets to compare; without b, members that must meet all others without it.

    A part of a bucket's first shingles is one group of rows, of about
    :data:`MET` members' worth; a member travels once for each part it has
    shingles in, so rows grow with the shingles and not with pairs.
    """
    placed, known = _common(rows, sets)

    @F.arrow_udf("array<struct<part:int,firsts:binary>>")
    def firsts(shingles: pa.Array, common: pa.Array, counts: pa.Array, shortest: pa.Array, parts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("part", pa.int32()), ("firsts", pa.binary())]))
        out = []
        for s, c, k, short, many in zip(shingles, common, counts, shortest.to_pylist(), parts.to_pylist()):
            first = first_shingles(_view(s, np.uint64), _view(c, np.uint64), _view(k, np.int64), short, least)
            part = (first % np.uint64(many)).astype(np.int32)
            out.append([{"part": p, "firsts": first[part == p].tobytes()} for p in np.unique(part).tolist()])
        return pa.array(out, kind)

    def meet(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        names = part["digest"].tolist()
        pairs, crowded = meetings([np.frombuffer(f, np.uint64) for f in part["firsts"]], part["g"].tolist(), page)
        found = [(key[0], *sorted((names[i], names[j]))) for i, j in pairs] + [(key[0], names[i], None) for i in crowded]
        return pd.DataFrame(found, columns=["bucket", "a", "b"])

    parts = F.ceil(F.col("n") / MET).cast("int")
    cut = placed.join(known, "bucket").select(
        "bucket", "digest", "g", F.explode(firsts("shingles", "common", "counts", "shortest", parts)).alias("cut")
    )
    cut = cut.select("bucket", "digest", "g", "cut.*")
    return materialise(cut.groupBy("bucket", "part").applyInPandas(meet, "bucket bigint, a binary, b binary"), "met")


def _rest_links(members: DataFrame, sets: DataFrame, groups: DataFrame, least: float, page: int) -> DataFrame:
    """Verified links (a, b) between members of one bucket whose groups differ."""
    rows = materialise(_open_members(members, groups), "open")
    large = rows.where(F.col("n") > WIDE * page)
    rows = rows.where(F.col("n") <= WIDE * page)
    if large.isEmpty():
        return _page_links(rows, sets, least, page)
    met = _met_by_shingles(large, sets, least, page)
    pairs = materialise(met.where("b IS NOT NULL").select("a", "b").distinct(), "pairs")
    crowded = met.where("b IS NULL").select("bucket", F.col("a").alias("digest")).distinct()
    crowded = materialise(crowded.join(crowded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket"), "crowded")
    rows = rows.unionByName(_open_members(crowded, groups))
    return _verified(pairs, sets, least).union(_page_links(rows, sets, least, page))


def _page_links(rows: DataFrame, sets: DataFrame, least: float, page: int) -> DataFrame:
    """Verified links (a, b) between open members whose groups differ, as a forest for each pair of pages."""
    # pages of the largest group come after those of the others; they need not meet each other
    small, large = F.ceil((F.col("n") - F.col("n_big")) / page).cast("int"), F.ceil(F.col("n_big") / page).cast("int")
    inside, at = F.col("g") == F.col("big"), F.xxhash64("digest")
    paged = rows.withColumns({"pages": F.when(inside, small).otherwise(small + large), "p": F.when(inside, small + F.pmod(at, large)).otherwise(F.pmod(at, small)).cast("int")})
    # every other pair of pages of a bucket meets once, a page and itself included
    meets = paged.select("bucket", "digest", "g", "p", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("q"))
    meets = meets.select("bucket", "digest", "g", "p", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")).join(sets, "digest")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        kept = [np.frombuffer(s, np.uint64) for s in part["shingles"]]
        names, group, place = part["digest"].tolist(), part["g"].tolist(), part["p"].tolist()
        across = part["lo"].iloc[0] != part["hi"].iloc[0]
        root: dict[bytes, bytes] = {}

        def top(g: bytes) -> bytes:
            while (up := root.get(g, g)) != g:
                root[g] = g = root.get(up, up)
            return g

        order = sorted(range(len(kept)), key=lambda i: len(kept[i]))
        out = []
        for k, i in enumerate(order):
            for j in order[k + 1:]:
                if len(kept[i]) < least * len(kept[j]):  # all later ones are longer still
                    break
                if across and place[i] == place[j]:
                    continue
                u, v = top(group[i]), top(group[j])
                if u != v and similar(kept[i], kept[j], least):
                    root[u] = v
                    out.append((names[i], names[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return meets.groupBy("bucket", "lo", "hi").applyInPandas(compare, "a binary, b binary")


def near_copy_groups(docs: DataFrame, doc_id="doc_id", text="text", width: int = WIDTH, least: float = SIMILARITY,
                     views: int = VIEWS, sample: int = SAMPLE, distance: int = DISTANCE, page: int = PAGE) -> DataFrame:
    """(digest, none, id, component) of every distinct text; ``id`` is its smallest doc_id, ``none`` that it has none."""
    texts = _prints(docs, doc_id, text, width, views, sample)
    members = _members(texts, distance)
    sets = _sets(docs, text, members, width)
    found = materialise(_leader_links(members, sets, least), "links")
    groups = materialise(components(found), "groups")
    found, groups = _more_leaders(members, sets, found, groups, least, page)
    rest = materialise(_rest_links(members, sets, groups, least, page), "links")
    groups = components(found.union(rest)).withColumnRenamed("node", "digest")
    return texts.join(groups, "digest", "left").select(
        "digest", F.col("first.none").alias("none"), F.col("first.id").alias("id"), F.coalesce("component", "digest").alias("component")
    )


def deduplicated(docs: DataFrame, doc_id="doc_id", text="text", **options) -> DataFrame:
    """One row of each group of near copies, with all its columns; see the module for which."""
    named = near_copy_groups(docs, doc_id, text, **options)
    best = named.groupBy("component").agg(F.min(F.struct("none", "id", "digest")).alias("best"))
    keep = materialise(best.select(F.col("best.id").alias("_id_"), F.col("best.digest").alias("_digest_")), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("bigint").alias("_id"), digest_of(text).alias("_digest"))
    rows = rows.join(keep, F.col("_digest").eqNullSafe(F.col("_digest_")) & F.col("_id").eqNullSafe(F.col("_id_")), "left_semi")
    # rows with one id and one text are copies; only such rows are left to choose from
    crowded = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("_digest").alias("_digest_"))
    crowded = materialise(crowded, "crowded")
    one = rows.join(crowded, F.col("_digest") == F.col("_digest_"), "left_anti").select("row.*")
    many = rows.join(crowded, F.col("_digest") == F.col("_digest_"), "left_semi")
    first = many.groupBy("_digest").agg(F.min_by("row", F.struct(F.to_json("row"), F.xxhash64("row"))).alias("row"))
    return one.unionByName(first.select("row.*"))
