"""Verified near copies against all pairs, and the cases that the stage defines."""

import random

import numpy as np

from foldstone.llm import near_copies


def _plain(text):
    return " ".join((text or "").lower().split())


def _brute(texts):
    """Components of all pairs of texts by exact similarity."""
    sets = [near_copies.shingle_set(_plain(t)) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            union = len(sets[i]) + len(sets[j]) - both
            if not union or both >= 0.8 * union:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    notice = " ".join(rng.choices(vocabulary, k=30))
    texts = []
    for _ in range(12):
        words = rng.choices(vocabulary, k=rng.randint(60, 160))
        texts.append(" ".join(words))
        for _ in range(4):  # chains: each copy changes the copy before
            words = list(words)
            words[rng.randrange(len(words))] = "changed" + str(rng.random())
            texts.append(" ".join(words))
    for _ in range(20):  # a passage that many share makes no copies
        texts.append(notice + " " + " ".join(rng.choices(vocabulary, k=40)))
    return texts


def test_groups_equal_all_pairs(make_docs):
    texts = _corpus()
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    want = {i for i, top in enumerate(_brute(texts)) if i == top}
    for page in (2, 32):
        assert {r["doc_id"] for r in near_copies.deduplicated(docs, page=page).collect()} == want


def test_leader_does_not_hide_links_of_others(make_docs, monkeypatch):
    """All texts in one bucket: the pages find what the leader is not similar to."""
    texts = _corpus(5)
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    monkeypatch.setattr(near_copies, "_members", lambda texts, distance: _one_bucket(texts))
    want = {i for i, top in enumerate(_brute(texts)) if i == top}
    assert {r["doc_id"] for r in near_copies.deduplicated(docs, page=4).collect()} == want


def test_large_buckets_are_joined_by_more_leaders(make_docs, monkeypatch):
    """Copies of one text that the first leader does not join: few rows are left for pages, and groups stay exact."""
    rng = random.Random(1)
    base = rng.choices([f"w{i}" for i in range(400)], k=120)
    texts = []
    for i in range(90):
        words = list(base)
        words[rng.randrange(120)] = f"own{i}"
        texts.append(" ".join(words))
    texts += _corpus(7)[:20]
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    monkeypatch.setattr(near_copies, "_members", lambda texts, distance: _one_bucket(texts))
    want = {i for i, top in enumerate(_brute(texts)) if i == top}
    made, keep = [], near_copies._rest_links

    def counted(members, sets, groups, least, page):
        rows = near_copies._open_members(members, groups).collect()
        made.append(sum(-(-(r["n"] - r["n_big"]) // page) if r["g"] == r["big"] else -(-r["n"] // page) + 1 for r in rows))
        return keep(members, sets, groups, least, page)

    monkeypatch.setattr(near_copies, "_rest_links", counted)
    assert {r["doc_id"] for r in near_copies.deduplicated(docs, page=4).collect()} == want
    assert 0 < made[0] < 110 * 28 / 2  # every member in every page before


def test_first_shingles_miss_no_similar_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 120, np.uint64)
    for least in (0.5, 0.8, 0.9):
        sets = [np.zeros(0, np.uint64)]
        for i in range(90):  # changes from a small stock, so that changed texts share some
            own = rng.integers(0, 2**63, 400, np.uint64)[:4] if i % 2 else np.arange(400, dtype=np.uint64)
            kept = rng.choice(base, 120 - rng.integers(0, 40), replace=False)
            sets.append(np.unique(np.concatenate([kept, rng.choice(own, min(len(own), rng.integers(1, 30)), replace=False)])))
        order = near_copies.common_shingles(sets[:20])
        shortest = min(map(len, sets[1:]))
        firsts = [near_copies.first_shingles(s, *order, shortest, least) for s in sets]
        similar = {(i, j) for j in range(len(sets)) for i in range(j) if near_copies.similar(sets[i], sets[j], least)}
        for most in (3, 30, 1000):
            pairs, crowded = near_copies.meetings(firsts, list(range(len(sets))), most)
            met = {tuple(sorted(p)) for p in pairs}
            assert similar and all(p in met or crowded.issuperset(p) for p in similar)
        assert not near_copies.meetings(firsts, [0] * len(sets), 3)[1]


def test_texts_a_little_too_far_do_not_meet_all_others(make_docs, monkeypatch):
    """Many texts near one text, most of them similar to nothing: rows for pages do not grow with their square."""
    rng = random.Random(2)
    base = rng.choices([f"w{i}" for i in range(400)], k=120)
    texts = [" ".join(base)]
    for i in range(160):
        words = list(base)
        for at in rng.sample(range(0, 120, 6), rng.choice((1, 2, 4, 5, 6))):
            words[at] = f"own{i}" if i % 3 else "shared"
        texts.append(" ".join(words))
    docs = make_docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    monkeypatch.setattr(near_copies, "_members", lambda texts, distance: _one_bucket(texts))
    made, keep = [], near_copies._page_links

    def counted(rows, *rest):
        rows = rows.collect()
        page = rest[-1]
        made.append(sum(-(-(r["n"] - r["n_big"]) // page) if r["g"] == r["big"] else -(-r["n"] // page) + 1 for r in rows))
        return keep(rows_of(rows), *rest)

    def rows_of(rows):
        kind = "bucket bigint, n bigint, digest binary, g binary, big binary, n_big bigint"
        return docs.sparkSession.createDataFrame(rows, kind)

    monkeypatch.setattr(near_copies, "_page_links", counted)
    want = {i for i, top in enumerate(_brute(texts)) if i == top}
    assert {r["doc_id"] for r in near_copies.deduplicated(docs, page=4).collect()} == want
    assert len(want) > 60 and made[0] < 4 * len(texts)


def _one_bucket(texts):
    from pyspark.sql import functions as F

    return texts.select(F.lit(1).cast("bigint").alias("bucket"), "digest", F.lit(texts.count()).alias("n"))


def test_defined_cases(make_docs):
    long = " ".join(f"word{i % 997} x{i}" for i in range(60_000))
    docs = make_docs([
        (5, "one two three four five six", "en", "s"), (3, "One  two three\tfour five six", "en", "s"),
        (7, "first text of a shared id", "en", "s"), (7, "second text that nobody copied at all", "en", "s"),
        (None, "alpha beta gamma", "en", "s"), (None, "alpha beta gamma", "en", "s"), (None, "no such id", None, None),
        (8, None, "en", "s"), (9, "", "en", "s"), (10, " \n ", "en", "s"),
        (11, long, "en", "s"), (12, long + " end", "en", "s"), (11, long, "en", "s"),
    ])
    out = near_copies.deduplicated(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [3, 7, 7, 8, 11]
    assert sorted(r["text"] for r in rows if r["doc_id"] is None) == ["alpha beta gamma", "no such id"]
    assert near_copies.deduplicated(make_docs([])).count() == 0


def test_texts_are_read_one_at_a_time(spark, monkeypatch):
    """No batch of texts or of sets is turned into Python objects at once: the columns stay Arrow's."""
    docs = spark.createDataFrame([(i, f"w{i % 7} " * 40) for i in range(20)], "doc_id long, text string")
    plans = []
    keep = near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df, label))
    texts = near_copies._prints(docs, "doc_id", "text", near_copies.WIDTH, near_copies.VIEWS, near_copies.SAMPLE)
    sets = near_copies._sets(docs, "text", texts.select("digest"), near_copies.WIDTH)
    got = {bytes(r["digest"]): r for r in texts.join(sets, "digest").collect()}
    assert len(got) == 7
    for r in got.values():
        shingles = np.frombuffer(r["shingles"], np.uint64)
        assert r["fps"] == near_copies.sampled_fingerprints(shingles).tolist()
    read = [line for p in plans for line in p.splitlines() if "ArrowEvalPython" in line]
    assert len(read) == 2 and all(line.rstrip().endswith("250") for line in read)  # Arrow's scalar UDFs, not pandas'
