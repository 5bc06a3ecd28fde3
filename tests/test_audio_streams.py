import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.config import FeatureSettings, NoiseSettings, VectorSettings
from foldstone.operators import series as R
from foldstone.sources import audio as W
from foldstone.sources import tables as B
from foldstone.streaming import ingest as I


def write(path, y, rate, channels=1):
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(2)
        out.setframerate(rate)
        out.writeframes((np.clip(y, -1, 1) * 32767).astype("<i2").tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("wavs")
    t = np.arange(16000) / 16000
    write(root / "sine.wav", 0.5 * np.sin(2 * np.pi * 220 * t), 16000)
    tone = 0.5 * np.sin(2 * np.pi * 440 * np.arange(48000) / 48000)
    write(root / "padded.wav", np.concatenate([np.zeros(24000), tone, np.zeros(24000)]), 48000)
    write(root / "same.wav", np.repeat(0.3 * np.sin(2 * np.pi * 100 * t), 2), 16000, 2)
    both = np.stack([0.5 * np.ones(800), -0.5 * np.ones(800)], 1)
    write(root / "differ.wav", both.ravel(), 16000, 2)
    write(root / "clipped.wav", np.ones(1000), 16000)
    write(root / "empty.wav", np.zeros(0), 16000)
    (root / "pointer.wav").write_text("version https://example.org\n")
    (root / "short.wav").write_bytes(b"RIFF\x00\x00")
    return str(root)


@pytest.fixture(scope="module")
def files(spark, folder):
    return W.scan_files(spark, folder).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_scan_and_guard(spark, files, folder, tmp_path):
    assert files.count() == 8
    ok = by_name(files.select("name", W.is_wav(F.col("content")).alias("ok")))
    assert ok["sine.wav"]["ok"] and not ok["pointer.wav"]["ok"] and not ok["short.wav"]["ok"]
    with pytest.raises(FileNotFoundError):
        W.scan_files(spark, folder, "*.flac")


def test_header_probe_never_raises(files):
    rows = by_name(W.probe_headers(files, "name"))
    assert (rows["padded.wav"]["native_sr"], rows["padded.wav"]["frames"]) == (48000, 96000)
    assert rows["padded.wav"]["duration_s"] == pytest.approx(2.0)
    assert rows["same.wav"]["channels"] == 2 and rows["sine.wav"]["subtype"] == "PCM_16"
    for bad in ("pointer.wav", "short.wav"):
        assert rows[bad]["native_sr"] == -1 and rows[bad]["subtype"].startswith("UNREADABLE")


def test_decode(files):
    native = by_name(W.decode(files, "name", rate=None))
    assert len(native["padded.wav"]["samples"]) == 96000 and native["padded.wav"]["sr"] == 48000
    assert np.allclose(native["differ.wav"]["samples"], 0.0, atol=1e-4)
    assert native["pointer.wav"]["load_error"] and native["pointer.wav"]["samples"] is None
    low = by_name(W.decode(files, "name"))
    assert len(low["padded.wav"]["samples"]) == 32000 and low["padded.wav"]["sr"] == 16000
    y = np.array(low["padded.wav"]["samples"])[10000:22000]
    assert np.abs(y).max() == pytest.approx(0.5, abs=0.02)
    with pytest.raises(Exception, match="ValueError"):
        W.load_strict(files.where("name = 'pointer.wav'"), "name").collect()


def test_audit_measures(files):
    rows = by_name(W.audit_measures(W.decode(files, "name", rate=None), "name"))
    p = rows["padded.wav"]
    assert p["duration"] == pytest.approx(2.0) and p["rms"] == pytest.approx(0.25, abs=0.01)
    assert p["lead_silence"] == pytest.approx(0.5, abs=0.05) and p["trail_silence"] == pytest.approx(0.5, abs=0.05)
    assert p["silence_fraction"] == pytest.approx(0.5, abs=0.05)
    assert rows["clipped.wav"]["n_clipped"] == 1000 and rows["sine.wav"]["n_clipped"] == 0
    e = rows["empty.wav"]
    assert e["load_error"] is None and e["duration"] == 0 and e["dbfs_peak"] is None and e["silence_fraction"] == 0
    assert rows["pointer.wav"]["duration"] is None and rows["pointer.wav"]["load_error"]


def test_channel_report(files):
    rows = by_name(W.channel_report(files, "name"))
    assert rows["same.wav"]["max_abs_diff"] == 0 and rows["same.wav"]["n_channels"] == 2
    assert rows["differ.wav"]["max_abs_diff"] == pytest.approx(1.0, abs=0.01)
    assert rows["pointer.wav"]["load_error"]


def test_feature_names_and_vectors(files):
    s = FeatureSettings()
    names = R.feature_names(s)
    assert len(names) == 240 and names[0] == "mfcc00_mean" and names[-1] == "dd_mfcc39_std"
    decoded = W.decode(files.where("name in ('sine.wav', 'padded.wav', 'clipped.wav')"), "name")
    for settings in (s, FeatureSettings(n_mfcc=13, aggregation="percentiles", extras=("chroma", "rms"), deltas=False, delta_deltas=False)):
        rows = by_name(W.extract(decoded, "name", settings))
        assert set(rows) == {"sine.wav", "padded.wav", "clipped.wav"}
        for r in rows.values():
            assert len(r["features"]) == len(R.feature_names(settings)) and np.isfinite(r["features"]).all()


def test_descriptor_values(files):
    s = FeatureSettings(extras=("spectral_centroid", "rolloff", "zcr", "rms"))
    frames = W.frames_of(W.decode(files.where("name = 'sine.wav'"), "name"), "name", s.n_fft, s.hop_length)
    rows = W.descriptors(frames, "name", s).where("frame_idx between 5 and 25").collect()
    centroid, rolloff, zcr, rms = np.array([r["rest"] for r in rows]).mean(0)
    assert centroid == pytest.approx(220, abs=25) and rolloff == pytest.approx(220, abs=20)
    assert zcr == pytest.approx(2 * 220 / 16000, abs=0.002) and rms == pytest.approx(0.5 / np.sqrt(2), abs=0.01)


def test_prosody(files):
    row = by_name(W.prosody(W.decode(files.where("name in ('sine.wav', 'padded.wav', 'empty.wav')"), "name"), "name"))
    assert row["sine.wav"]["f0_mean"] == pytest.approx(220, abs=4) and row["sine.wav"]["voiced_fraction"] > 0.9
    # trimming works on whole frames: a frame of 2048 samples may reach past the tone
    assert 1.0 <= row["padded.wav"]["speech_duration"] <= 1.0 + 2048 / 16000
    assert row["empty.wav"]["f0_mean"] is None and row["empty.wav"]["voiced_fraction"] == 0


# ------------------------------------------------------------------- settings


def test_settings_hash_and_name():
    a = FeatureSettings()
    assert a.name == "mfcc40-d-dd-mean_std-trim" and len(a.hash) == 12
    assert a.hash == FeatureSettings(normalisation="per_speaker").hash != FeatureSettings(n_mfcc=20).hash
    assert FeatureSettings(extras=("rms", "zcr")).hash == FeatureSettings(extras=("zcr", "rms")).hash
    fine = FeatureSettings(n_fft=400, hop_length=160)
    assert fine.name.endswith("win25ms-hop10ms") and fine.resolved_delta_width == 29 and a.resolved_delta_width == 9
    assert "delta_frames" in a.describe()
    for bad in ({"aggregation": "x"}, {"normalisation": "x"}, {"delta_width": 4}, {"extras": ("x",)}):
        with pytest.raises(ValueError):
            FeatureSettings(**bad)
    v = VectorSettings()
    assert v.hash == VectorSettings(layer=6, pooling="std", normalisation="global").hash != VectorSettings(trim=True).hash
    assert VectorSettings(layer=6, max_duration_s=3).name == "wav2vec2-base-L6-mean-max3s"
    for bad in ({"pooling": "x"}, {"layer": "first"}, {"max_duration_s": 0}):
        with pytest.raises(ValueError):
            VectorSettings(**bad)
    with pytest.raises(ValueError):
        NoiseSettings("s", "stretch", 0)


# ------------------------------------------------------------ storage, streams


def test_cache_reuse_and_rebuild(spark, tmp_path):
    calls = []

    def build(df):
        calls.append(1)
        return df.withColumn("v", F.lit(1))

    root = str(tmp_path)
    keys = spark.range(5).withColumnRenamed("id", "key")
    for _ in range(2):
        assert B.cached_by_hash(keys, root, "abc", "key", build).count() == 5
    assert len(calls) == 1
    assert B.cached_by_hash(spark.range(7).withColumnRenamed("id", "key"), root, "abc", "key", build).count() == 7
    assert len(calls) == 2


def test_guarded_sink(spark, tmp_path):
    a = spark.range(3)
    with pytest.raises(ValueError, match="3 in, 6 out"):
        B.write_guarded(a, a.unionAll(a), str(tmp_path / "x"))


def test_missing_side_table(spark, tmp_path):
    side = B.side_table(spark, str(tmp_path / "none.csv"), "actor INT, sex STRING")
    df = spark.createDataFrame([(1,)], "actor int")
    assert B.with_side_table(df, side, "actor", "sex").first()["sex"] == "unknown"


def test_files_are_ingested_once(spark, folder, tmp_path):
    import shutil

    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    shutil.copy(f"{folder}/sine.wav", inbox / "a.wav")
    for extra in (None, "b.wav"):
        if extra:
            shutil.copy(f"{folder}/sine.wav", inbox / extra)
        I.ingest(I.file_stream(spark, str(inbox)), out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("path").distinct().count() == 2


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
    schema = "ts timestamp, y_true string, y_pred string"

    def add(name, rows):
        spark.sql("select 1").count()
        spark.createDataFrame(rows, "ts string, y_true string, y_pred string").selectExpr("cast(ts as timestamp) ts", "y_true", "y_pred").coalesce(1).write.mode("append").parquet(str(src))

    add("a", [("2024-01-01 01:00:00", "a", "a"), ("2024-01-03 00:00:00", "a", "b")])
    stream = lambda: spark.readStream.schema(schema).parquet(str(src))
    I.count_stream(stream(), out, mark).awaitTermination()
    add("b", [("2024-01-01 02:00:00", "a", "a"), ("2024-01-05 00:00:00", "a", "b")])
    I.count_stream(stream(), out, mark).awaitTermination()
    rows = {str(r["window_start"])[:10]: r["n"] for r in spark.read.parquet(out).collect()}
    assert rows == {"2024-01-01": 1, "2024-01-03": 1}


def test_replayed_batches_are_logged_once(spark, tmp_path):
    from foldstone.sources import tables as B

    row = {f.name: 0.5 if f.name in ("accuracy", "macro_f1") else "x" for f in B.RESULTS_SCHEMA}
    rows = spark.createDataFrame([tuple(row[f.name] for f in B.RESULTS_SCHEMA)] * 3, B.RESULTS_SCHEMA)
    for number in (0, 1, 1):
        B.write_batch(rows, str(tmp_path / "log"), number)
    log = B.read_results(spark, str(tmp_path / "log"))
    assert log.count() == 6 and log.columns == B.RESULTS_SCHEMA.fieldNames()
