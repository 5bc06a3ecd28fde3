"""Rejection of texts in no learned language, many secrets in one text, and the pipeline as a whole."""

import random

import numpy as np
import pytest

import corpus_pipeline
from foldstone.llm import langid, secret_scan

VOCABULARY = {
    "en": "the and of house water with from this that river stone which would their about people".split(),
    "de": "der und die das haus wasser mit von dieser fluss stein nicht werden sich auch wurde".split(),
    "fr": "le et les des maison eau avec dans cette rivière pierre qui que pour sont nous".split(),
    "es": "el y los las casa agua con desde este río piedra que para son nosotros también".split(),
}


def _sentence(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) for _ in range(n))


def _row(lang, text):
    counts = langid.subword_counts(text)
    at = np.nonzero(counts)[0]
    return lang, at.astype(np.int32), counts[at].astype(np.int32)


def test_threshold_rejects_junk_and_keeps_the_learned():
    rng = random.Random(4)
    model = langid.train([_row(lang, _sentence(rng, lang, 25)) for _ in range(80) for lang in VOCABULARY])

    def top(text):
        return float(model.scores(langid.subword_counts(text)).max())

    junk = ["xqzw kjvb qqqq zzxv wkqj", "k3J9 aGVs bG8g d29y bGQh", "Ѓќѓ љњџ ћђ ј", "ωψχ φυτ σρπ"]
    assert all(top(t) < model.threshold for t in junk)
    good = [top(_sentence(rng, lang, 25)) for _ in range(50) for lang in VOCABULARY]
    assert np.mean(np.array(good) < model.threshold) <= 0.02
    assert model.threshold > 1 / len(VOCABULARY) + 0.1


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 9, 10, 50, 5000])
def test_positions_of_many_secrets(make_docs, count):
    text = "ä " + "".join(f"token=abcdefgh{i} " for i in range(count))
    found = make_docs([(1, text, None, None)]).select(secret_scan.base_spans(secret_scan.text_of("text")).alias("s")).first()["s"]
    assert len(found) == count and all(text[s["start"]:s["stop"]] == f"token=abcdefgh{i}" for i, s in enumerate(found))


def test_pipeline_over_awkward_rows(spark, make_docs, tmp_path):
    rng = random.Random(9)
    rows = [(i, _sentence(rng, lang, 30), lang, f"src{i % 3}") for i, lang in enumerate(["en", "de"] * 60)]
    rows += [
        (200, rows[0][1], "en", "src0"), (7, "the house of people which would stand with water from this river", "en", None),
        (None, rows[3][1] + " und", "de", "src1"), (300, None, "en", "src1"), (301, "", None, None), (302, "12 34 !!", None, "src2"),
        (303, _sentence(rng, "en", 20_000), "en", "src2"), (303, rows[5][1], "de", "src2"),
    ]
    docs = make_docs(rows)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    kept = corpus_pipeline.keep_languages(spark, docs, "")
    assert kept.columns == docs.columns and not {300, 301, 302} & {r["doc_id"] for r in kept.collect()}
    single = corpus_pipeline.drop_near_copies(spark, kept, "").collect()
    ids = [r["doc_id"] for r in single]
    assert 200 not in ids and None not in ids and ids.count(7) == 2 and ids.count(303) == 1
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert {r["doc_id"] for r in out} <= set(ids)
    docs.where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
