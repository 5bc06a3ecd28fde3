import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldstone.sources import audio as W
from foldstone.sources import containers as C
from foldstone.sources import recordings as R


def chunk(name, body):
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def wav(x, rate=8000, kind="<i2", tag=1, before=(), extensible=False, length=None):
    x = np.atleast_2d(np.asarray(x).T).T
    data, bits, ch = x.astype(kind).tobytes(), 8 * np.dtype(kind).itemsize, x.shape[1]
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHI", 22, bits, 3) + struct.pack("<H", tag) + bytes.fromhex("000000001000800000aa00389b71")
    body = b"WAVE" + b"".join(chunk(*c) for c in before) + chunk(b"fmt ", form)
    body += b"data" + struct.pack("<I", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(1)
    pcm, floats = rng.integers(-30000, 30000, 1001), rng.uniform(-1, 1, 500)
    return {
        "plain": wav(pcm), "listed": wav(pcm, before=[(b"LIST", b"x" * 301), (b"junk", b"")]),
        "extensible": wav(np.stack([pcm, -pcm], 1), extensible=True), "float": wav(floats, kind="<f4", tag=3),
        "double": wav(floats, kind="<f8", tag=3, extensible=True), "eight": wav(pcm % 256, kind="u1"),
        "piped": wav(pcm, length=0xFFFFFFFF), "empty": wav(pcm[:0]),
        "alaw": wav(pcm % 256, kind="u1", tag=6), "text": b"version 1", "cut": b"RIFF\0\0", "none": b"",
    }


@pytest.fixture(scope="module")
def files(spark, blobs):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in blobs.items()] + [("null", None)], "name string, content binary")


def test_headers_behind_other_chunks(files):
    got = {r["name"]: (r["native_sr"], r["channels"], r["subtype"], r["frames"]) for r in W.probe_headers(files, "name").collect()}
    assert got["plain"] == got["listed"] == got["piped"] == (8000, 1, "PCM_16", 1001)
    assert got["extensible"] == (8000, 2, "PCM_16", 1001)
    assert got["float"] == (8000, 1, "FLOAT", 500) and got["double"] == (8000, 1, "DOUBLE", 500)
    assert got["eight"] == (8000, 1, "PCM_U8", 1001) and got["empty"] == (8000, 1, "PCM_16", 0)
    for bad in ("alaw", "text", "cut", "none", "null"):
        assert got[bad] == (-1, -1, "UNREADABLE: no PCM header", 0)


def test_samples_of_every_format(files):
    got = {r["name"]: r for r in W.decode(files, "name", rate=None).collect()}
    np.testing.assert_array_equal(got["plain"]["samples"], got["listed"]["samples"])
    np.testing.assert_array_equal(got["plain"]["samples"], got["piped"]["samples"])
    np.testing.assert_allclose(got["float"]["samples"], got["double"]["samples"])
    assert max(np.abs(got["extensible"]["samples"])) == 0  # the channels cancel out
    assert "unsupported" in got["alaw"]["load_error"] and got["null"]["load_error"]


@pytest.mark.parametrize("window,hop,samples", [(256, 128, 300), (7, 3, 10), (64, 100, 1 << 20), (5000, 16, 64)])
def test_ranges_cut_the_same_frames(spark, files, tmp_path, window, hop, samples):
    root = str(tmp_path / "wavs")
    R.write_files(files.where("name <> 'null'"), root, F.concat("name", F.lit(".wav")), F.col("content")).collect()
    planned = R.plan(R.list_files(spark, root))
    errors = {r["path"].split("/")[-1] for r in planned.where("load_error IS NOT NULL").collect()}
    assert errors == {"alaw.wav", "text.wav", "cut.wav"}  # Spark does not list files of no bytes
    got = {(r["path"].split("/")[-1][:-4], r["frame_idx"]): r["vec"] for r in R.range_frames(planned, window, hop, samples, 3).collect()}
    want = W.frames_of(W.decode(files, "name", rate=None).where("load_error IS NULL"), "name", window, hop).collect()
    want = {(r["name"], r["frame_idx"]): r["vec"] for r in want if len(r["vec"]) == window}
    assert got.keys() == want.keys() and all(got[k] == want[k] for k in want)


def test_files_are_listed_in_tasks(spark, files, tmp_path):
    """The driver holds no list of the files: what is read is a stored table of paths, not the files."""
    root = str(tmp_path / "wavs")
    nested = F.concat(R.folder_of(F.col("name"), 5000), F.lit("/in/"), "name", F.lit(".wav"))
    R.write_files(files.where("name <> 'null'"), root, nested, F.col("content")).collect()
    R.write_files(files.where("name = 'plain'"), root, F.lit("top.wav"), F.col("content")).collect()
    for hidden in ("_of/a.wav", ".of/a.wav", "in/_a.wav", "in/a.txt"):
        R.write_files(files.where("name = 'plain'"), root, F.lit(hidden), F.col("content")).collect()
    listed = R.list_files(spark, root)
    paths = [r["path"] for r in listed.collect()]
    want = {"plain", "listed", "extensible", "float", "double", "eight", "piped", "empty", "alaw", "text", "cut", "top"}
    assert sorted(p.split("/")[-1][:-4] for p in paths) == sorted(want) and len({p.split("/")[-3] for p in paths}) > 2
    assert not [f for f in listed.inputFiles() if f.endswith(".wav")]
    (tmp_path / "none").mkdir()
    assert R.list_files(spark, str(tmp_path / "none")).count() == 0


def test_a_range_reads_its_own_bytes(monkeypatch):
    """Finding the samples of an hour at 48 kHz reads headers only."""
    blob, seen = wav(np.zeros(10), before=[(b"LIST", b"y" * 1000)]), []

    def read(at, count):
        seen.append(count)
        return blob[at : at + count]

    assert C.layout(read, len(blob)).frames == 10 and sum(seen) < 100
    with pytest.raises(ValueError, match="no data"):
        C.layout(C.in_memory(blob[:30]), 30)


def test_frames_of_many_ranges_share_a_batch():
    """Short ranges are handed over together, with the path and index of each frame."""
    held = [("a", np.arange(0, 2), np.ones((2, 4), "float32")), ("b", np.arange(5, 8), np.zeros((3, 4), "float32"))]
    rows = R._frame_rows(held)
    assert rows["path"].tolist() == ["a", "a", "b", "b", "b"] and rows["frame_idx"].tolist() == [0, 1, 5, 6, 7]
    assert [v.sum() for v in rows["vec"]] == [4, 4, 0, 0, 0]
