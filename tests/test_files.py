"""Sources on odd files: signals without samples, tables stored as folders."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.catalog import QUERIES
from foldstone.catalog.storage import SMALL
from foldstone.operators.series import aggregate_vectors
from foldstone.sources import audio as W


@pytest.fixture(scope="module")
def short_texts(spark, tmp_path_factory):
    """Texts of no, one, four and many bytes; odd keys have two channels."""
    root = str(tmp_path_factory.mktemp("short"))
    texts = [(1, "a"), (2, ""), (3, "abcd"), (4, "ab" * 300), (5, "abc"), (57, "a bare text")]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    return root


def test_decoded_without_samples(spark, short_texts):
    got = {r["key"]: r["n_samples"] for r in QUERIES["src_05"](spark, short_texts).collect()}
    assert got == {3: 1, 4: 300}


def test_one_frame_without_samples(spark, short_texts):
    got = {r["key"]: (r["frames"], r["width"]) for r in QUERIES["fea_02"](spark, short_texts).collect()}
    assert got == {1: (1, 256), 2: (1, 256), 3: (1, 256), 4: (3, 256), 5: (1, 256)}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table of one file and two of several part files."""
    root = str(tmp_path_factory.mktemp("tables (1)"))
    for name, parts in (("a", 3), ("b", 2)):
        spark.range(60).repartition(parts).write.parquet(f"{root}/{name}.parquet")
    part = next(f for f in os.listdir(f"{root}/a.parquet") if f.endswith(".parquet"))
    with open(f"{root}/a.parquet/{part}", "rb") as one, open(f"{root}/c.parquet", "wb") as out:
        out.write(one.read())
    return root


def test_a_folder_is_one_table(spark, stored):
    assert sorted(map(tuple, QUERIES["src_01"](spark, stored).collect())) == [("a.parquet", True), ("b.parquet", True), ("c.parquet", True)]


def test_a_folder_arrives_once(spark, stored):
    assert sorted(map(tuple, QUERIES["str_01"](spark, stored).collect())) == [("a.parquet", 1), ("b.parquet", 1), ("c.parquet", 1)]


@pytest.fixture(scope="module")
def clips(spark):
    """Noise, a tone between silences, silence, nothing, an unreadable file."""
    draw = np.random.default_rng(1)
    tone = np.concatenate([np.zeros(3000), 0.5 * np.sin(np.arange(5000) / 7), np.zeros(2000)])
    signals = [draw.normal(0, 0.1, 4000), tone, np.zeros(500), np.zeros(0), None]
    rows = [(i, 16000, 1, None if y is None else y.astype("float32").tolist(), "ValueError: bad" if y is None else None) for i, y in enumerate(signals)]
    return spark.createDataFrame(rows, "key long, sr int, n_channels int, samples array<float>, load_error string")


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_clips_are_not_shuffled(clips):
    assert not shuffles(W.extract(clips, "key", SMALL)) and not shuffles(W.audit_measures(clips, "key")) and not shuffles(W.prosody(clips, "key"))


@pytest.mark.parametrize("aggregation", ["mean_std", "percentiles"])
def test_extract_is_the_chain_over_frames(clips, aggregation):
    s = SMALL.replace(aggregation=aggregation, trim=False)
    frames = W.cepstra(W.descriptors(W.frames_of(clips, "key", s.n_fft, s.hop_length), "key", s), "key", s.n_mfcc, s.n_mels)
    wide = W.vector_deltas(frames, "key", "mfcc", "rest", s.resolved_delta_width, [1, 2])
    want = {r["key"]: r["features"] for r in aggregate_vectors(wide, "key", "vec", aggregation).collect()}
    got = {r["key"]: r["features"] for r in W.extract(clips, "key", s).collect()}
    assert sorted(got) == sorted(want) == [0, 1, 2] and all(np.allclose(got[k], want[k]) for k in want)
    both = {r["key"]: r for r in W.extract_each(clips, "key", {"a": s.replace(trim=True), "b": s}).collect()}
    assert both[2]["a"] is None and np.allclose(both[1]["b"], want[1]) and not np.allclose(both[1]["a"], want[1])


def test_clips_over_many_batches(spark):
    n = 3 * W.HELD_ROWS + 5
    files = spark.range(n).select(F.col("id").alias("key"), W.pcm_blob(F.encode(F.lpad(F.col("id").cast("string"), 8, "0"), "UTF-8"), F.lit(8000), F.lit(1)).alias("content"))
    got = W.audit_measures(W.decode(files.coalesce(1), "key"), "key").agg(F.count_distinct("key"), F.min("n_frames"), F.max("n_frames")).first()
    assert tuple(got) == (n, 8, 8)
