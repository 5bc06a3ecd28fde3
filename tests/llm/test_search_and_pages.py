"""Nearest neighbours, exact top-k, page wrappers, revisits and toxicity."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.llm import ann_tree, mtree, toxicity, warc, wrappers

VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("cell", T.StringType()), T.StructField("v", T.StringType()), T.StructField("score", T.StringType()),
])


@pytest.fixture(scope="module")
def make_vectors(spark):
    return lambda rows: spark.createDataFrame([(i, v, 0, "c", "v", "s") for i, v in rows], VECTORS)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, d))
    return (centers[rng.integers(0, 12, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)


BAD = [(9001, None), (9002, []), (9003, [float("nan")] * 8), (9004, [None] + [1.0] * 7), (9005, [float("inf")] * 8), (9006, [1.0, 2.0]), (None, [1.0] * 8)]


def test_neighbours_reach_the_recall(make_vectors):
    x = clustered(3000, 8, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(9007, [0.0] * 8), (5, x[5].tolist())]
    found = ann_tree.nearest(make_vectors(rows), F.col("vec_id") % 20 == 0, k=20, leaf=40).collect()
    exact = x.astype(float) @ x[::20].astype(float).T
    hits, by = 0, {}
    for r in found:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 3000, 20))
    for q, mine in by.items():
        mine.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and q not in {r["vec_id"] for r in mine}
        assert all(r["score"] == pytest.approx(exact[r["vec_id"], q // 20], abs=1e-9) for r in mine)
        order = np.lexsort((np.arange(3000), -exact[:, q // 20]))
        hits += len({r["vec_id"] for r in mine} & set(order[order != q][:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


def test_few_candidates_ties_and_empty_tables(make_vectors):
    same = [(i, [1.0, 1.0]) for i in (0, 7, 3, 20)]
    rows = ann_tree.nearest(make_vectors(same), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in rows] == [(0, 3), (0, 7), (0, 20), (20, 0), (20, 3), (20, 7)]
    top = mtree.top_k(make_vectors(same), F.col("vec_id") % 20 == 0, k=2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in top] == [(0, 3, 2**21), (0, 7, 2**21), (20, 0, 2**21), (20, 3, 2**21)]
    for run in (ann_tree.nearest, mtree.top_k):
        assert run(make_vectors([]), F.col("vec_id") % 20 == 0).count() == 0
        assert run(make_vectors(BAD), F.col("vec_id") % 20 == 0).count() == 0
        assert run(make_vectors([(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_top_k_is_exact(make_vectors, seed, monkeypatch):
    monkeypatch.setattr(mtree, "ROWS_A_PIVOT", 100)
    x = clustered(1500, 8, seed)
    x[700:900] = x[700]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + BAD + [(9007, [0.0] * 8)]
    found = mtree.top_k(make_vectors(rows), F.col("vec_id") % 50 == 0, k=10).collect()
    y = np.vstack([np.floor(1024 * x.astype(float)), np.zeros(8)]).astype(np.int64)
    ids = np.array([*range(1500), 9007])
    want = set()
    for q in np.nonzero(ids % 50 == 0)[0]:
        s = y @ y[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want |= {(int(ids[q]), n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(order)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found} == want


def test_tree_visits_every_leaf_once():
    x = clustered(2000, 8, 3).astype(float)
    tree = ann_tree.build(x, leaf=50)
    assert sorted(tree.visit(x[0], tree.leaves)) == list(range(tree.leaves))
    assert set(tree.assign(x)) == set(range(tree.leaves))


def test_queries_in_small_leaves_find_k_rows(make_vectors):
    rng = np.random.default_rng(4)
    x = 20 * np.eye(8)[rng.integers(0, 4, 2400)] + 0.1 * rng.normal(size=(2400, 8))
    x[::400] = [[-300.0 * (j == 7) + i for j in range(8)] for i in range(6)]  # six outliers, a leaf of their own, all of them queries
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = ann_tree.nearest(make_vectors(rows), F.col("vec_id") % 20 == 0, k=20, leaf=500, recall=0.5).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 20 for i in range(0, 2400, 20)}


# -------------------------------------------------------------------------- pages

def page(i, body, extra=""):
    return (
        f'<!DOCTYPE html><html><head><title>t{i}</title><style>p{{}}</style><script>var a="<p>";</script></head><body>'
        f'<header><a href="/">Site</a></header><nav><ul><li><a href="/{i}">go {i}</a></li></ul></nav><!-- ad {i} -->'
        f'<div class="cookie-notice">We use cookies</div><div class="ad">buy {i}</div><article><h1>Title {i}</h1>{body}'
        f'<form><label>mail</label><input name=m></form>{extra}</article><aside>also</aside>'
        f'<section id="comments"><article class="comment"><p>nice {i}</p></article></section><footer>&copy; host</footer></body></html>'
    )


PAGES = [
    ("http://a.example/1", page(1, "<p>one &amp; two<p>three\n\t four<br>five"), "Title 1\none & two\nthree four five"),
    ("https://A.example/2", page(2, "<ul><li>x<li>y</ul><table><tr><td>c<td>d</table>"), "Title 2\nx\ny\nc\nd"),
    ("http://a.example/3", page(3, "<p>só <b>bold</b> <span class=ads>BUY</span><i>it</i></p>", "<div class='share'>share</div>"), "Title 3\nsó bold it"),
    ("http://b.example/", "<body><div class=menu><a>m</a></div><div><p>alpha beta gamma</p><p>delta</p></div></body>", "alpha beta gamma\ndelta"),
    ("http://c.example/", None, ""), (None, "", ""), (None, "plain &lt;b&gt; text", "plain <b> text"),
    ("http://d.example/", "<nav>only a menu</nav>", ""), ("http://e.example/", "<article>" + "<p>long text</p>" * 20_000, "\n".join(["long text"] * 20_000)),
    ("http://f.example/", "<article><p>open <a href='x>broken <p>second</article", "open broken\nsecond"),
]


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "old", "k") for i, (u, h, *_) in enumerate(rows)], "page_id long, url string, html string, text string, host string")


def test_main_text_of_pages(spark):
    table = pages_of(spark, PAGES + [PAGES[0]])
    found = wrappers.extract(table).collect()
    assert len(found) == len(PAGES) + 1
    for r in found:
        if r["page_id"] not in (9,):
            assert r["text"] == (PAGES + [PAGES[0]])[r["page_id"]][2], r["page_id"]
    broken = next(r["text"] for r in found if r["page_id"] == 9)
    assert "open" in broken and "second" in broken
    assert wrappers.extract(table.where("page_id < 0")).count() == 0


def test_wrappers_resolve_mismatches(spark):
    rows = [("http://w.example/", page(i, "<p>p</p>" * (i % 3) + ("<h2>part</h2>" if i % 2 else ""))) for i in range(40)]
    rows += [("http://w.example/", "<body><article><p>Read more here</p><p>own</p></article>")]
    wrapper = {r["host"]: r["wrapper"] for r in wrappers.wrappers(pages_of(spark, rows), block=4).collect()}
    said = wrappers.expression(json.loads(wrapper["w.example"]))
    assert "<h2>#constant</>?" in said and "<p>" in said and "+?" in said
    assert json.loads(wrappers.rule_of(wrapper["w.example"]))["root"][-1] == "article"


def test_constants_of_a_host_are_furniture(spark):
    rows = [("http://k.example/", f"<body><article><h4>Share this article</h4><p>text number {i}</p><p>more {i}</p></article>") for i in range(12)]
    texts = {r["text"] for r in wrappers.extract(pages_of(spark, rows)).collect()}
    assert texts == {f"text number {i}\nmore {i}" for i in range(12)}


def test_a_constant_leaves_its_siblings(spark):
    body = "<h1>Head {0}</h1><p>By our staff</p><ul><li>point {0}</li></ul><p>Paragraph number {0} of the article</p>"
    rows = [("http://s.example/", f"<body><article>{body.format(i)}</article>") for i in range(12)]
    texts = {r["text"] for r in wrappers.extract(pages_of(spark, rows)).collect()}
    assert texts == {f"Head {i}\npoint {i}\nParagraph number {i} of the article" for i in range(12)}


def test_copies_on_a_host_are_no_furniture(spark):
    quote = "<blockquote>The same long quotation on every copy</blockquote>"
    rows = [("http://n.example/", f"<body><article><p>Own words {i}</p>{quote if i < 10 else ''}</article>") for i in range(30)]
    found = {r["page_id"]: r["text"] for r in wrappers.extract(pages_of(spark, rows)).collect()}
    assert all(found[i] == f"Own words {i}" + "\nThe same long quotation on every copy" * (i < 10) for i in range(30))
    rows = [("http://m.example/", f"<body><article><h1>A head</h1>{quote}<p>copy {i}</p></article>") for i in range(10)]
    found = {r["page_id"]: r["text"] for r in wrappers.extract(pages_of(spark, rows)).collect()}
    assert found == {i: f"A head\nThe same long quotation on every copy\ncopy {i}" for i in range(10)}


def test_class_words_are_whole_classes():
    said = lambda c: wrappers.main_text(f'<body><article><p>one</p><div class="{c}"><p>two</p></div></article>')
    assert {said(c) for c in ("no-sidebar", "has-comments wide", "content-sidebar-wrap", "skip-level-math")} == {"one\ntwo"}
    assert {said(c) for c in ("cookie-notice", "wide share", "share-buttons", "ad-1", "related-posts")} == {"one"}


# ----------------------------------------------------------------------- revisits

def test_canonical_urls(spark):
    urls = {
        "HTTP://user@WWW.Example.org:80/a/b/?utm_source=x#top": "example.org/a/b", "https://example.org/a/b?x=1&utm_medium=m&y=2": "example.org/a/b?x=1&y=2",
        "example.org/?gclid=1&fbclid=2": "example.org", "": None, None: None, "http://example.org/A//": "example.org/A",
    }
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.canonical(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == urls


def test_revisits_resolve_as_of_their_date(spark):
    rng = random.Random(8)
    records, schema = [], "record_id long, type string, url string, date long, headers map<string,string>, digest string, stored string"
    for i in range(800):
        kind = rng.choice(["response", "revisit"])
        url = "http://hot.example/" if rng.random() < 0.5 else f"http://u{rng.randint(0, 30)}.example/"
        url, date = (None if rng.random() < 0.02 else url), (None if rng.random() < 0.02 else rng.randint(0, 200))
        headers = {"etag": f'W/"{rng.randint(0, 1)}"', "content-length": str(i), f"x-{i % 3}": str(i)} if rng.random() < 0.8 else None
        if headers and rng.random() < 0.3:
            headers = {"last-modified": str(rng.randint(0, 1)), "content-type": "t"}
        records.append((i, kind, url, date, headers, f"d{i}" if kind == "response" else None, "clash"))
    records.append(next(r for r in records if r[1] == "revisit"))
    rows = warc.resolve(spark.createDataFrame(records, schema)).collect()
    assert len(rows) == sum(r[1] == "revisit" for r in records)
    by = {r[0]: r for r in records}
    for r in rows:
        me = by[r["record_id"]]
        earlier = [x for x in records if x[1] == "response" and x[2] == me[2] and x[2] and x[3] is not None and me[3] is not None and x[3] <= me[3]]
        if not earlier:
            assert (r["check"], r["response_id"], r["headers"]) == ("missing", None, None)
            continue
        last = max(earlier, key=lambda x: (x[3], x[0]))
        sent, stored = me[4] or {}, last[4] or {}
        if "etag" in sent and "etag" in stored:
            want = "etag" if sent["etag"] == stored["etag"] else "changed"
        elif "last-modified" in sent and "last-modified" in stored:
            want = "modified" if sent["last-modified"] == stored["last-modified"] else "changed"
        else:
            want = "none"
        assert r["check"] == want
        if want == "changed":
            assert r["response_id"] is None
        else:
            assert r["response_id"] == last[0] and r["body_digest"] == last[5]
            assert r["headers"] == {**stored, **{k: v for k, v in sent.items() if k not in warc.KEPT_HEADERS}}
    assert warc.resolve(spark.createDataFrame([], schema)).count() == 0


def test_header_blocks(spark):
    block = "HTTP/1.1 304 Not Modified\r\nETag: \"a:b\"\r\nX-A: 1\r\nx-a: 2\r\nbroken line\r\nEmpty:\r\n"
    row = spark.createDataFrame([(block,)], "b string").select(warc.header_map(F.col("b")).alias("m")).first()
    assert row["m"] == {"etag": '"a:b"', "x-a": "2", "empty": ""}


# ----------------------------------------------------------------------- toxicity

def test_toxicity_on_held_out_documents(spark, make_docs):
    rng = random.Random(9)
    syllables = "an the in on er st re ti ou ha ea nd".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(2000):
        bad = i % 5 == 0
        words = [word() for _ in range(rng.randint(30, 120))]
        if bad:
            for _ in range(6):
                words[rng.randrange(len(words))] = rng.choice(["grumblewort", "snottlepig", "wretchface"])
        rows.append((i, " ".join(words), None, None))
        labels.append((i, int(bad)))
    docs, table = make_docs(rows), spark.createDataFrame(labels + [(7, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, table.where("doc_id % 4 <> 2 or doc_id is null"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, model).where("doc_id % 4 = 2").collect()}
    good = [s for i, s in scores.items() if i % 5] + [0.0]
    bad = [s for i, s in scores.items() if i % 5 == 0]
    assert np.mean([b > g for b in bad for g in good]) > 0.95 and all(0 <= s <= 1 for s in scores.values())
    odd = make_docs([(1, None, None, None), (2, "", None, None), (3, "x" * 300_000, None, None), (4, "ab " * 100_000, None, None)])
    assert all(0 <= r["score"] <= 1 for r in toxicity.scored(odd, model).collect())
    assert toxicity.scored(make_docs([]), model).count() == 0


@pytest.mark.parametrize("place", ["forms", "calibrates", "rare"])
def test_few_toxic_documents_are_enough(spark, make_docs, place):
    rng = random.Random(10)
    syllables = "an the in on er st re ti ou ha ea nd".split()
    line = lambda: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(40))
    role = spark.range(4000).select("id", (F.pmod(F.xxhash64(F.lit("role"), "id"), F.lit(4)) > 0).alias("forms")).collect()
    marked = [r["id"] for r in role if place == "rare" or r["forms"] == (place == "forms")][:24 if place == "rare" else 8]
    words = " grumblewort snottlepig wretchface grumblewort foulmouthed snottlepig"
    rows = [(i, line() + words * (i in marked), None, None) for i in range(4000)]
    table = spark.createDataFrame([(i, int(i in marked)) for i in range(4000)], "doc_id long, toxic int")
    model = toxicity.fit(make_docs(rows), table, calibration=200 if place == "rare" else 5000)
    assert model is not None
    fresh = make_docs([(9000 + i, line() + words * (i < 10), None, None) for i in range(200)])
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(fresh, model).collect()}
    assert min(scores[9000 + i] for i in range(10)) >= toxicity.CUT
    assert sum(scores[9000 + i] >= toxicity.CUT for i in range(10, 200)) <= 2


def test_toxicity_without_both_classes(spark, make_docs):
    docs = make_docs([(1, "some text", None, None)])
    assert toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert [r["score"] for r in toxicity.scored(docs, None).collect()] == [0.0]


def test_windows_hold_the_whole_text():
    line = toxicity.normal("Some  words\tand" + "x" * 200 + " end")
    parts = toxicity.windows(line)
    assert all(len(p) <= toxicity.WINDOW + 1 for p in parts)
    assert parts[0] + b"".join(p[1:] for p in parts[1:]) == line or b"".join(parts).replace(b" ", b"") == line.replace(b" ", b"")
