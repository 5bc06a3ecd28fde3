"""The prefix trie of conversations: which beginnings are shared, and what sharing them saves.

A conversation is a path of turns, a trie node a distinct sequence of first
turns. A turn becomes 20 bytes (md5 of role and text, code points of the
text), a conversation their concatenation: 100 bytes for five turns, however
long the texts are. Texts are read once and never shuffled.

Splitter-skeleton. Conversations are ordered by (path, conv_id) and cut into
shards by splitters, quantiles of a bounded sample. If two members of a node
lie in different shards, the splitter between them begins with that node; so
the trie of the splitters' paths (the skeleton) holds every node that more
than one shard knows. It is broadcast, and bounded by ``SKELETON_BYTES``. Every
shard walks its sorted paths once and finishes all other nodes by itself; for
skeleton nodes it returns partial counts, which a reduction adds up. Equal
paths are ordered by conv_id, so copies of one conversation fill many shards.

Defined results. Null role or text count as empty; rows without ``conv_id``
take no part; turns are ordered by ``turn``, null first, ties by the md5 of
the turn. Repeated rows are turns of their own. No conversation: no node, not
even the root. Turns are compared by 128 bits of md5 and the text's length.
A conversation is one row of 20 bytes a turn, however long its texts are. The
hash of the members that end in a node is sequential by definition: their ids
are streamed in pieces of a shard each through one task a node, not gathered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialise, settle
from .common import text_of

#: Bytes of a turn in a path.
TURN = 20
#: Bytes of paths a shard is meant for; rows it holds at least, on average.
SHARD_BYTES, SHARD_ROWS = 4 << 20, 64
#: Bounds of the broadcast skeleton, and of the sample that splitters are taken from (bytes of paths; rows a shard).
SKELETON_BYTES, SAMPLE_BYTES, SAMPLE_ROWS = 16 << 20, 64 << 20, 16
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_key(role: str = "role", text: str = "text") -> Column:
    """40 hex digits that identify a turn; the last 8 are the code points of its text."""
    said = text_of(text)
    # the length of the role keeps "ab", "c" and "a", "bc" apart
    both = F.concat(F.length(text_of(role)).cast("string"), F.lit(":"), text_of(role), said)
    return F.concat(F.md5(both.cast("binary")), F.lpad(F.lower(F.hex(F.length(said))), 8, "0"))


def turn_lists(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, keys): the turn keys of every conversation in order."""
    rows = turns.select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_key(role, text).alias("key")).alias("t")
    ).where(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["key"]).alias("keys"))


def with_shared_heads(lists: DataFrame, stride: int = 100, most: int = 6) -> DataFrame:
    """Conversations that begin as the conversation at the multiple of ``stride`` below their id does.

    The first h turns come from there (all, if fewer; none, if it is absent),
    then follow the own ones after the first h; h is crc32 of the id modulo ``most``.
    """
    base = F.col("conv_id") - F.col("conv_id") % stride
    heads = lists.where(F.col("conv_id") % stride == 0).select(
        F.col("conv_id").alias("base"), F.slice("keys", 1, most - 1).alias("head") if most > 1 else F.array().cast("array<string>").alias("head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    keys = F.concat(F.slice(F.coalesce("head", F.array()), F.lit(1), h), F.slice("keys", h + 1, F.greatest(F.size("keys") - h, F.lit(0))))
    return lists.withColumn("base", base).join(heads, "base", "left").select("conv_id", keys.alias("keys"))


def as_paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path) of (conv_id, keys)."""
    return lists.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"))


class Skeleton:
    """The trie of the splitters' paths; nodes are numbered in preorder, 0 is the root."""

    def __init__(self, paths: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.chars, self.kids = [-1], [0], [0], [0]
        for path in sorted(paths):
            at = 0
            for i in range(0, len(path), TURN):
                key = (at, path[i:i + TURN])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.kids[at] += 1
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.chars.append(int.from_bytes(path[i + TURN - 4:i + TURN], "big"))
                    self.kids.append(0)
                at = self.child[key]
        self.last = list(range(len(self.parent)))  # of each subtree, in preorder
        for i in range(len(self.parent) - 1, 0, -1):
            self.last[self.parent[i]] = max(self.last[self.parent[i]], self.last[i])

    def table(self) -> pd.DataFrame:
        return pd.DataFrame({"sid": range(len(self.parent)), "up": self.parent, "depth": self.depth, "chars": self.chars, "inner": self.kids, "last": self.last})


SHARD_SCHEMA = (
    "sid bigint, up bigint, shard bigint, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends string"
)


def shard_nodes(shard: int, members: list[tuple[bytes, int]], skeleton: Skeleton) -> Iterator[tuple]:
    """Rows of SHARD_SCHEMA from one shard's (path, conv_id), sorted.

    Nodes outside the skeleton are finished (``sid`` null; ``ends`` is the
    hash; ``up`` is the parent's number if that is in the skeleton). Skeleton
    nodes are partial: members, least member, children, leaves and savings of
    the finished subtrees right below them, and the ids that end there.
    """
    sid, up, depth, chars = [0], [-1], [0], [0]
    n, least, kids, leaves, saved, ends = [0], [None], [0], [0], [0], [[]]
    open_rows = [0]

    def close() -> None:
        i = open_rows.pop()
        if not open_rows:
            return
        p = up[i]
        n[p] += n[i]
        least[p] = least[i] if least[p] is None else min(least[p], least[i])
        if sid[i] is None:
            leaves[i] = leaves[i] if kids[i] else 1
            saved[i] += (n[i] - 1) * chars[i]
            kids[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]

    before = b""
    for path, conv in members:
        shared, most = 0, min(len(before), len(path))
        while shared < most and before[shared:shared + TURN] == path[shared:shared + TURN]:
            shared += TURN
        while len(open_rows) > shared // TURN + 1:
            close()
        for at in range(shared, len(path), TURN):
            key, top = path[at:at + TURN], open_rows[-1]
            sid.append(None if sid[top] is None else skeleton.child.get((sid[top], key)))
            up.append(top)
            depth.append(depth[top] + 1)
            chars.append(int.from_bytes(key[-4:], "big"))
            for counts, start in ((n, 0), (least, None), (kids, 0), (leaves, 0), (saved, 0)):
                counts.append(start)
            ends.append([])
            open_rows.append(len(sid) - 1)
        top = open_rows[-1]
        n[top] += 1
        least[top] = conv if least[top] is None else min(least[top], conv)
        ends[top].append(conv)
        before = path
    while open_rows:
        close()
    for i in range(len(sid)):
        ids, p = ",".join(map(str, ends[i])), up[i]
        if sid[i] is not None:
            yield sid[i], None, shard, depth[i], least[i], None, n[i], kids[i], leaves[i], saved[i], ids or None
        else:
            outer = sid[p] is not None
            yield (
                None, sid[p] if outer else None, shard, depth[i], least[i], None if outer else least[p], n[i], kids[i], leaves[i], saved[i],
                hashlib.sha256(ids.encode()).hexdigest(),
            )


def splitters_of(paths: DataFrame, shards: int | None = None) -> list[tuple[bytes, int]]:
    """(path, conv_id) where shards begin, from a sample drawn by a hash of the id; bounded as its parameters say."""
    rows, size = paths.agg(F.count(F.lit(1)), F.sum(F.length("path").cast("bigint"))).first()
    if not rows:
        return []
    mean = max(1.0, size / rows)
    if shards is None:
        wanted = max(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
        shards = max(1, min(wanted, rows // SHARD_ROWS, int(SKELETON_BYTES / mean)))
    if shards == 1:
        return []
    share = min(1.0, min(shards * SAMPLE_ROWS, SAMPLE_BYTES / mean) / rows)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("splitter"), "conv_id"), 11) / F.lit(float(2**53))
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in paths.where(draw < share).select("path", "conv_id").collect())
    picked = [sample[len(sample) * i // shards] for i in range(1, shards)] if sample else []
    return [s for i, s in enumerate(picked) if not i or s != picked[i - 1]]


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of (conv_id, path) rows, one a conversation.

    conv_id: smallest member; depth; parent_conv_id: the parent's conv_id
    (root: null); n_convs: members; n_children; n_leaves: childless nodes in
    the subtree; saved_tokens: over the subtree, code points of each node's
    last text times its members but one; ends_sha256: of the ids ending there.
    """
    spark = paths.sparkSession
    paths = materialise(paths, "paths")
    splitters = splitters_of(paths, shards)
    skeleton = Skeleton([p for p, _ in splitters])

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["shard"] = [bisect_right(splitters, (bytes(p), c)) for p, c in zip(part["path"], part["conv_id"])]
            yield part

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        members: dict[int, list] = {}
        for part in batches:
            for shard, path, conv in zip(part["shard"], part["path"], part["conv_id"]):
                members.setdefault(shard, []).append((bytes(path), conv))
        names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
        for shard, own in members.items():
            yield pd.DataFrame(list(shard_nodes(shard, sorted(own), skeleton)), columns=names, dtype=object)

    dealt = paths.select("conv_id", "path").mapInPandas(placed, "conv_id bigint, path binary, shard int")
    # shard i is partition i: as even as the splitters are
    found = materialise(dealt.repartitionById(len(splitters) + 1, F.col("shard")).mapInPandas(walked, SHARD_SCHEMA), "nodes")
    node = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    local = found.where(F.col("sid").isNull()).withColumnRenamed("ends", "ends_sha256")
    upper = _reduced(found.where(F.col("sid").isNotNull()), spark.createDataFrame(skeleton.table()))
    joined = local.where(F.col("up").isNotNull()).drop("parent_conv_id").join(
        upper.select(F.col("sid").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up"
    )
    return local.where(F.col("up").isNull()).select(node).unionByName(joined.select(node)).unionByName(upper.select(node))


def _reduced(partial: DataFrame, skeleton: DataFrame) -> DataFrame:
    """Finished rows of the skeleton's nodes; all tables here are at most as long as the skeleton times its shards."""
    sums = partial.groupBy("sid").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    own = sums.join(skeleton, "sid").withColumns({
        "n_children": F.col("n_children") + F.col("inner"),
        "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars"),
    }).withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
    # a subtree is a range of the preorder: its sum is the difference of two running sums
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    run = settle(own.withColumns({"leaves_to": F.sum("n_leaves").over(order), "saved_to": F.sum("saved_tokens").over(order)}))
    end = run.select(F.col("sid").alias("last"), F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"))
    above = run.select(F.col("sid").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    whole = run.join(end, "last").join(above, "up", "left").join(_ends(partial), "sid", "left").withColumns({
        "n_leaves": F.col("leaves_end") - F.col("leaves_to") + F.col("n_leaves"),
        "saved_tokens": F.col("saved_end") - F.col("saved_to") + F.col("saved_tokens"),
        "ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING)),
        "depth": F.col("depth").cast("bigint"),
    })
    return settle(whole)


def _ends(partial: DataFrame) -> DataFrame:
    """(sid, ends_sha256): pieces of ids, in the order of the shards and so of the ids, streamed through the hash."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for part in batches:
            out = []
            for sid, piece in zip(part["sid"], part["ends"]):
                if sid != now:
                    if now is not None:
                        out.append((now, digest.hexdigest()))
                    now, digest = sid, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            yield pd.DataFrame(out, columns=["sid", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(now, digest.hexdigest())], columns=["sid", "ends_sha256"])

    pieces = partial.where(F.col("ends").isNotNull()).select("sid", "shard", "ends")
    return pieces.repartition("sid").sortWithinPartitions("sid", "shard").select("sid", "ends").mapInPandas(streamed, "sid bigint, ends_sha256 string")


def texts_of(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of their last turn, from (conv_id, place, role, text) with 1-based places; the root has none."""
    said = turns.select("conv_id", F.col("place").cast("bigint").alias("depth"), "role", "text")
    return nodes.join(said, ["conv_id", "depth"], "left")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Contract query: the trie of all conversations, rebuilt with shared heads."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie(as_paths(with_shared_heads(turn_lists(turns))))


#: The contract query in DuckDB SQL; crc32 bit by bit over the digits of the id.
ORACLE = r"""WITH turns AS (SELECT conv_id::BIGINT AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT c, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, md5(length(role)::VARCHAR || ':' || role || text)) AS t FROM turns GROUP BY c),
  bits AS (SELECT c, t, list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END, 4294967295::BIGINT) AS a FROM own),
  heads AS (SELECT c, t, (xor(a, 4294967295) % 6)::INT AS h FROM bits),
  conv AS (SELECT x.c, list_concat(coalesce(b.t, [])[1:x.h], x.t[x.h + 1:]) AS t FROM heads x LEFT JOIN own b ON b.c = x.c - x.c % 100),
  member AS (SELECT c, d, t[1:d] AS node, t[1:d - 1] AS up, len(t) = d AS ends, CASE WHEN d > 0 THEN length(t[d].text) ELSE 0 END AS chars
    FROM conv, unnest(range(0, len(t) + 1)) AS u(d)),
  nodes AS (SELECT d, node, CASE WHEN d > 0 THEN any_value(up) END AS up, min(c) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS saved,
      coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '') AS ids FROM member GROUP BY d, node),
  kids AS (SELECT d - 1 AS d, up AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
  full_nodes AS (SELECT x.*, coalesce(k.n, 0) AS kids FROM nodes x LEFT JOIN kids k ON k.d = x.d AND k.node = x.node),
  below AS (SELECT a AS d, node[1:a] AS node, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
    FROM full_nodes, unnest(range(0, d + 1)) AS u(a) GROUP BY ALL)
  SELECT x.conv_id, x.d::BIGINT AS depth, p.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, x.kids::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
    b.saved::BIGINT AS saved_tokens, sha256(x.ids) AS ends_sha256
  FROM full_nodes x JOIN below b ON b.d = x.d AND b.node = x.node LEFT JOIN nodes p ON p.d = x.d - 1 AND p.node = x.up"""
