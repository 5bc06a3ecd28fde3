"""Cover-tree codes, the prefix trie and the positional index against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.llm import cover_codes, positional_index, prefix_trie

# --- op11 ---------------------------------------------------------------------

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    # names that the operator uses inside
    T.StructField("v", T.StringType()), T.StructField("block", T.StringType()), T.StructField("error", T.StringType()),
])


def lloyd(rows, parts, entries, rounds, scale):
    """(vec_id, label, codes, error) and books, the plain way."""
    kept = sorted(
        ((i, label, np.floor(scale * np.array(v, float)).astype(int).tolist()) for i, v, label in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)),
        key=lambda r: (r[0] is None, r[0] or 0, r[2]),
    )
    cut = lambda v, p: v[p * len(v) // parts:(p + 1) * len(v) // parts]
    out, error = [[] for _ in kept], [0] * len(kept)
    books = []
    for p in range(parts):
        own = [cut(r[2], p) for r in kept]
        book = [list(s) for s in own[:entries]]
        nearest = lambda s: min((sum((a - b) ** 2 for a, b in zip(s, e)), j) for j, e in enumerate(book))
        for _ in range(rounds):
            near = [nearest(s)[1] for s in own]
            for j in range(len(book)):
                mine = [s for s, n in zip(own, near) if n == j]
                if mine:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine)]
        for n, s in enumerate(own):
            d, j = nearest(s)
            out[n].append(j)
            error[n] += d
        books.append(book)
    return sorted([(i, label, tuple(c), e) for (i, label, _), c, e in zip(kept, out, error)], key=str), books


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_plain_lloyd(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 0.2, (400, 8)), 2)
    x[100:180] = x[100]  # one very common vector
    x[200:260] = np.floor(x[200:260] * 4) / 4  # ties
    rows = [(i, v.tolist(), [None, 1, 2][i % 3]) for i, v in enumerate(x)]
    rows += [(5, rows[5][1], 1), (5, rows[9][1], 2), (None, rows[7][1], None), (901, None, 1), (902, [], 1), (903, [None] * 8, 1), (904, [float("nan")] * 8, 1), (905, [float("inf")] * 8, 1)]
    rows.append((906, [1e9] * 8, 1))
    df = spark.createDataFrame([(i, v, label, "v", "b", "e") for i, v, label in rows], VECTORS)
    found, books = cover_codes.compress(df, parts=4, entries=16, rounds=2, block=64)
    want, book = lloyd([r for r in rows if r[0] != 906], 4, 16, 2, 256)
    assert sorted([(r["vec_id"], r["label"], tuple(r["codes"]), r["error"]) for r in found.collect()], key=str) == want
    assert books.tolist() == book


def test_codes_of_small_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, "v", "b", "e") for i, v in rows], VECTORS)
    for rows in ([], [(1, None), (2, [float("nan")] * 4)]):
        found, books = cover_codes.compress(make(rows), parts=4)
        assert found.count() == 0 and books.size == 0
    found, books = cover_codes.compress(make([(3, [0.5] * 4)]), parts=4)
    assert [tuple(r["codes"]) for r in found.collect()] == [(0, 0, 0, 0)] and books.tolist() == [[[128]]] * 4
    # the usual length stays, another one goes
    found, _ = cover_codes.compress(make([(1, [0.1] * 4), (2, [0.2] * 4), (3, [0.3] * 8)]), parts=4)
    assert {r["vec_id"] for r in found.collect()} == {1, 2}


def test_tree_gives_whole_subtrees_away():
    rng = np.random.default_rng(5)
    centers = rng.integers(-4000, 4000, (20, 4))
    points = np.unique(centers[rng.integers(0, 20, 3000)] + rng.integers(-9, 10, (3000, 4)), axis=0)
    weights = rng.integers(1, 5, len(points))
    tree = cover_codes.CoverTree(points, weights)
    for i in range(len(tree.centre)):
        own = tree.points[tree.low[i]:tree.high[i]]
        assert np.sqrt(((own - tree.points[tree.centre[i]]) ** 2).sum(1)).max() <= tree.radius[i] + 1e-6
    codes, counts, sums, compared = tree.assign(centers)
    want = cover_codes.squares(tree.points, centers).argmin(1)
    assert (codes == want).all() and compared < len(points) / 10
    assert (counts == np.bincount(want, tree.weights, 20)).all()
    assert (sums == np.stack([np.bincount(want, tree.weights * tree.points[:, j], 20) for j in range(4)], 1)).all()


# --- op12 ---------------------------------------------------------------------

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("path", T.StringType()), T.StructField("depth", T.StringType()),
])


def plain_trie(convs):
    """The contract's rows from {conv_id: [(role, text)]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    total = {}
    for node in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids.get(node, [])]
        save = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        total[node] = (sum(b[0] for b in below) or 1, save + sum(b[1] for b in below))
    out = set()
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out.add((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids.get(node, [])), *total[node],
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(t)] for c, t in own.items()}
    heads = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[:heads(c)] + t[heads(c):] for c, t in own.items()}


def nodes_of(df):
    rows = [tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def conversations(seed, n=600):
    rng = random.Random(seed)
    said = ["", "hé", "no", "x" * 50, "y"]
    rows = []
    for c in range(n):
        if c % 7 == 3:  # a third with one beginning, many of them copies
            rows += [(c, t, "user", "hi") for t in range(4)]
        else:
            rows += [(c, t if t else None, rng.choice(["user", None, "bot"]), rng.choice([*said, None])) for t in range(rng.randrange(1, 7))]
    rows += [(n + 5, t, "user", f"t{t}") for t in range(300)] + [(None, 1, "user", "lost"), (301, 99, "user", "again"), (301, 99, "user", "again")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "shards"), [(1, 1), (1, 2), (2, 17), (3, 150), (4, None)])
def test_trie_equals_plain_counts(spark, seed, shards):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "k", "p", "d") for r in rows], TURNS)
    paths = prefix_trie.as_paths(prefix_trie.with_shared_heads(prefix_trie.turn_lists(df)))
    assert nodes_of(prefix_trie.prefix_trie(paths, shards)) == plain_trie(rebuilt(rows))


def test_trie_of_copies_and_of_nothing(spark):
    one = [(c, t, "user", "same") for c in range(400) for t in range(3)]
    df = spark.createDataFrame([(*r, "k", "p", "d") for r in one], TURNS)
    lists = prefix_trie.turn_lists(df)
    trie = prefix_trie.prefix_trie(prefix_trie.as_paths(lists), 40)
    assert nodes_of(trie) == plain_trie({c: [("user", "same")] * 3 for c in range(400)})
    places = df.select("conv_id", (F.col("turn") + 1).alias("place"), "role", "text")
    assert {(r["depth"], r["text"]) for r in prefix_trie.texts_of(trie, places).collect()} == {(0, None), (1, "same"), (2, "same"), (3, "same")}
    empty = prefix_trie.as_paths(prefix_trie.with_shared_heads(prefix_trie.turn_lists(df.where("false"))))
    assert prefix_trie.prefix_trie(empty).count() == 0


def test_skeleton_is_bounded_and_used(spark, monkeypatch):
    rows = conversations(9)
    df = spark.createDataFrame([(*r, "k", "p", "d") for r in rows], TURNS)
    paths = prefix_trie.as_paths(prefix_trie.turn_lists(df)).cache()
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 900)
    splitters = prefix_trie.splitters_of(paths)
    assert 0 < len(splitters) < 8
    convs = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((role or "", text or ""))
    assert nodes_of(prefix_trie.prefix_trie(paths)) == plain_trie(convs)


# --- op13 ---------------------------------------------------------------------

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    import re

    return re.findall(WORDS, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_hits(docs, items, width=10):
    wins = {}
    for item, text in items:
        w = words(text)
        for a in range(max(len(w) - width, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[a:a + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for size in {len(k) for k in wins}:
            for a in range(len(w) - size + 1):
                if own := wins.get(tuple(w[a:a + size])):
                    found |= own
                    hit |= set(range(a, a + size))
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), ids))
    return sorted(out, key=str)


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("words", T.StringType())])


def texts(seed, n=250):
    rng = random.Random(seed)
    few = ["a", "b", "The", "ñu", "7", "Éa", "日本"]
    say = lambda k: "".join(rng.choice(few) + rng.choice([" ", ", ", "\n", "-", " \x00"]) for _ in range(k))
    items = [(i, say(rng.choice([3, 10, 11, 25]))) for i in range(30)] + [(3, "b b"), (100, None), (101, "..."), (None, "only here " * 6), (102, "a b"), (103, "A  b")]
    docs = [(i, say(rng.randrange(0, 80))) for i in range(n)]
    docs += [(i, f"{say(9)} {rng.choice(items[:30])[1].upper()} {say(9)}") for i in range(n, 2 * n)]
    docs += [(7, None), (None, "only here " * 20), (9, ""), (9, "a b " * 3000), (10, "w" * 3000 + " a B")]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_plain_search(spark, make_docs, seed, monkeypatch):
    monkeypatch.setattr(positional_index, "CHUNK", 512)
    docs, items = texts(seed)
    index = positional_index.build_index(make_docs([(i, t, "en", "s") for i, t in docs]), segment_bytes=4000)
    windows = positional_index.windows_of(spark.createDataFrame([(*r, "w") for r in items], ITEMS))
    want = plain_hits(docs, items)
    for block in (1 << 20, 3000):  # one block of windows, many blocks
        found = positional_index.search(index, windows, block_bytes=block)
        rows = positional_index.contaminated(index, found).collect()
        got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in rows], key=str)
        assert got == want
    assert sum(r[2] > 0 for r in want) > 200 and any(r[2] == 0 for r in want)


def test_proximity_equals_plain_search(spark, make_docs):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(80)]
    items = [(0, "w1 w2 w3"), (1, "w4 w4 w5 w6"), (2, "w9"), (3, "nowhere w1")]
    index = positional_index.build_index(make_docs([(i, t, "en", "s") for i, t in docs]), segment_bytes=500)
    ids = {(r["segment"], n): i for r in index.collect() for n, i in enumerate(r["doc_ids"])}
    windows = positional_index.windows_of(spark.createDataFrame([(*r, "w") for r in items], ITEMS))
    found = positional_index.search(index, windows, within=5).collect()
    got = sorted((ids[r["segment"], r["ordinal"]], int(r["item_ids"][0]), r["start"], r["end"]) for r in found)
    want = []
    for doc, text in docs:
        w = words(text)
        for item, phrase in items:
            need = set(words(phrase))
            held = [(a, b) for a in range(len(w)) for b in range(a + 1, min(a + 5, len(w)) + 1) if need <= set(w[a:b])]
            want += [(doc, item, a, b) for a, b in held if not any((c, d) != (a, b) and a <= c and d <= b for c, d in held)]
    assert got == sorted(want) and len(got) > 50


def test_index_of_nothing(spark, make_docs):
    items = spark.createDataFrame([(1, "a b c", "w")], ITEMS)
    empty = positional_index.build_index(make_docs([]))
    windows = positional_index.windows_of(items)
    assert positional_index.contaminated(empty, positional_index.search(empty, windows)).count() == 0
    some = positional_index.build_index(make_docs([(1, "x a b c", "en", "s"), (2, None, None, None)]))
    none = positional_index.windows_of(items.where("false"))
    assert [r["n_hit"] for r in positional_index.contaminated(some, positional_index.search(some, none)).collect()] == [0, 0]
    rows = positional_index.contaminated(some, positional_index.search(some, windows)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["item_ids"]) for r in rows] == [(4, 3, ["1"]), (0, 0, [])]
