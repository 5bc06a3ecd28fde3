"""PCM WAV content: guard, header, samples, frames, frame descriptors.

Files are rows with a BINARY ``content`` column, as ``binaryFile`` reads them.
Header fields are read by byte position in SQL; only sample decoding and the
per-frame spectrum run as Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import FeatureSettings
from ..operators.series import delta_kernel, resolve_width, suffixes
from ..vocab import CLIP_LEVEL, EXTRAS, PERCENTILES, TARGET_RATE
from . import containers as C

#: Samples and rows that a task holds before it hands them over.
HELD_SAMPLES, HELD_ROWS = 1 << 20, 1024
#: Decibels below the loudest mel value at which cepstra are floored.
FLOOR_DB = 80.0

_FOUND = T.StructType(
    [T.StructField("rate", T.IntegerType()), T.StructField("channels", T.IntegerType()),
     T.StructField("subtype", T.StringType()), T.StructField("frames", T.LongType())]
)


def scan_files(spark: SparkSession, root: str, glob: str = "*.wav", content: bool = True) -> DataFrame:
    """All matching files below ``root``; none at all is an error."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(root)
    )
    if not content:
        files = files.drop("content")
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no {glob} below {root}")
    return files


def is_wav(content: Column) -> Column:
    """RIFF in bytes 0-3 and WAVE in bytes 8-11."""
    return (F.hex(F.substring(content, 1, 4)) == "52494646") & (
        F.hex(F.substring(content, 9, 4)) == "57415645"
    )


def _byte_swapped(text: Column, width: int) -> Column:
    """Hex text with its bytes in reverse; ``reverse`` on BINARY works on characters."""
    return F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(width))])


def little_endian(content: Column, start: int, width: int) -> Column:
    """Unsigned integer of ``width`` bytes at 1-based ``start``."""
    text = F.hex(F.substring(content, start, width))
    return F.conv(_byte_swapped(text, width), 16, 10).cast("bigint")


def to_little_endian(value: Column, width: int) -> Column:
    return F.unhex(_byte_swapped(F.lpad(F.hex(value.cast("bigint")), 2 * width, "0"), width))


def pcm_blob(data: Column, rate: Column, channels: Column, bits: int = 16) -> Column:
    """A WAV file around raw PCM bytes."""
    n = F.octet_length(data)
    align = channels * (bits // 8)

    def raw(text):
        return F.encode(F.lit(text), "US-ASCII")

    return F.concat(
        raw("RIFF"), to_little_endian(n + 36, 4), raw("WAVEfmt "), to_little_endian(F.lit(16), 4),
        to_little_endian(F.lit(1), 2), to_little_endian(channels, 2), to_little_endian(rate, 4),
        to_little_endian(rate * align, 4), to_little_endian(align, 2), to_little_endian(F.lit(bits), 2),
        raw("data"), to_little_endian(n, 4), data,
    )


@F.pandas_udf(_FOUND)
def _walked(content: pd.Series) -> pd.DataFrame:
    """The layout behind other chunks; null where there is none."""
    rows = []
    for blob in content:
        try:
            of = C.layout(C.in_memory(blob), len(blob))
            rows.append((of.rate, of.channels, of.subtype, of.frames))
        except Exception:  # not readable is a finding
            rows.append((None, None, None, None))
    return pd.DataFrame(rows, columns=["rate", "channels", "subtype", "frames"]).astype(
        {"rate": "Int32", "channels": "Int32", "frames": "Int64"}
    )


def probe_headers(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, native_sr, channels, subtype, duration_s, frames); never raises.

    The canonical 44-byte header of PCM is read in SQL. Only files with other
    chunks, extensible formats or float samples go through a walk over their
    chunks. Unreadable files become a row with rate -1.
    """
    c = F.col(content)
    names = F.create_map(*[F.lit(v) for (tag, bits), name in C.SUBTYPES.items() if tag == C.PCM for v in (bits, name)])
    rate, channels, bits = little_endian(c, 25, 4), little_endian(c, 23, 2), little_endian(c, 35, 2).cast("int")
    canonical = F.coalesce(
        is_wav(c)
        & (F.octet_length(c) >= 44)
        & (F.hex(F.substring(c, 13, 8)) == "666D742010000000")
        & (little_endian(c, 21, 2) == C.PCM)
        & (F.hex(F.substring(c, 37, 4)) == "64617461")
        & (rate > 0) & (channels > 0) & names[bits].isNotNull(),
        F.lit(False),
    )
    size = F.least(little_endian(c, 41, 4), (F.octet_length(c) - 44).cast("bigint"))
    # other rows only: null content does not travel
    rows = files.select(key, c, canonical.alias("_plain"), _walked(F.when(~canonical & is_wav(c), c)).alias("_w"))

    def pick(plain, walked, missing):
        return F.when(F.col("_plain"), plain).otherwise(F.coalesce(walked, missing))

    found = rows.select(
        key,
        pick(rate.cast("int"), F.col("_w.rate"), F.lit(-1)).alias("native_sr"),
        pick(channels.cast("int"), F.col("_w.channels"), F.lit(-1)).alias("channels"),
        pick(names[bits], F.col("_w.subtype"), F.lit("UNREADABLE: no PCM header")).alias("subtype"),
        pick(F.floor(size / F.greatest(channels * F.floor(bits / 8), F.lit(1))), F.col("_w.frames"), F.lit(0)).alias("frames"),
    )
    return found.select(
        key, "native_sr", "channels", "subtype",
        F.when(F.col("native_sr") > 0, F.col("frames") / F.col("native_sr")).otherwise(0.0).alias("duration_s"),
        F.col("frames").cast("int").alias("frames"),
    )


def _samples(blob: bytes) -> tuple[np.ndarray, int]:
    """(frames x channels float32, rate) of a WAV in memory."""
    of = C.layout(C.in_memory(blob), len(blob))
    return C.samples(blob[of.offset : of.offset + of.frames * of.align], of), of.rate


def _resample(y: np.ndarray, rate: int, target: int) -> np.ndarray:
    """Band-limited resampling through the spectrum."""
    if rate == target or not len(y):
        return y
    n = int(np.ceil(len(y) * target / rate))
    spectrum = np.fft.rfft(y)
    out = np.zeros(n // 2 + 1, complex)
    m = min(len(out), len(spectrum))
    out[:m] = spectrum[:m]
    return (np.fft.irfft(out, n) * (n / len(y))).astype("float32")


def read_clip(blob: pa.Scalar, rate: int | None, mono: bool = True) -> tuple[np.ndarray, int, int]:
    """(samples, rate, channels) of a file in an Arrow batch, whose bytes are not copied."""
    x, native = _samples(blob.as_buffer().to_pybytes())
    y = x.mean(1) if mono else x
    if rate is not None and native != rate:
        y = np.stack([_resample(c, native, rate) for c in np.atleast_2d(y.T)]).T
    return y.astype("float32").ravel(), rate or native, x.shape[1]


def decode(
    files: DataFrame, key: str, content: str = "content", rate: int | None = TARGET_RATE, mono: bool = True
) -> DataFrame:
    """(key, sr, n_channels, samples, load_error); channels averaged when ``mono``.

    ``rate=None`` keeps the native rate. With ``mono=False`` the samples are
    interleaved. A bad file is a row with an error, not a failed job.
    """
    kind = files.schema[key].dataType.simpleString()
    names = [key, "sr", "n_channels", "samples", "load_error"]

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            # a file at a time: what is decoded is handed over by and by
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    y, sr, channels = read_clip(blob, rate, mono)
                    rows.append((name, sr, channels, y, None))
                    held += y.size
                except Exception as error:  # a bad file is a finding
                    rows.append((name, None, None, None, f"{type(error).__name__}: {error}"))
                if held >= HELD_SAMPLES or len(rows) >= HELD_ROWS:
                    yield _batch(rows, names, types)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, names, types)

    types = [to_arrow_type(files.schema[key].dataType), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
    return files.select(key, content).mapInArrow(
        run, f"{key} {kind}, sr int, n_channels int, samples array<float>, load_error string"
    )


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def per_clip(decoded: DataFrame, key: str, measure, columns: str) -> DataFrame:
    """(key, columns): what ``measure(sr, n_channels, samples, load_error)`` says of each clip, if anything.

    A clip's samples are in one row, so nothing about a single clip needs a
    shuffle. A task holds one clip at a time beside the batch it arrived in.
    """
    out = T.StructType([decoded.schema[key], *T.StructType.fromDDL(columns).fields])
    names, types = out.fieldNames(), [to_arrow_type(f.dataType) for f in out]

    def run(batches):
        rows = []
        for batch in batches:
            keys, rates, channels, clips, errors = (batch.column(i) for i in range(5))
            for name, sr, n, clip, error in zip(keys.to_pylist(), rates.to_pylist(), channels.to_pylist(), clips, errors.to_pylist()):
                y = clip.values.to_numpy(zero_copy_only=False) if clip.is_valid else None
                found = measure(sr, n, y, error)
                if found is not None:
                    rows.append((name, *found))
                if len(rows) >= HELD_ROWS:
                    yield _batch(rows, names, types)
                    rows = []
        if rows:
            yield _batch(rows, names, types)

    return decoded.select(key, "sr", "n_channels", "samples", "load_error").mapInArrow(run, out)


def load_strict(files: DataFrame, key: str, **kwargs) -> DataFrame:
    """:func:`decode` that raises inside the job on a bad file."""
    out = decode(files, key, **kwargs)
    return out.withColumn(
        "samples", F.when(F.col("load_error").isNull(), F.col("samples")).otherwise(F.raise_error(F.col("load_error")))
    ).drop("load_error")


def _power(y: np.ndarray, window: int, hop: int) -> np.ndarray:
    """Mean square of each centred frame of a signal."""
    square = np.concatenate([np.zeros(window // 2), np.square(y, dtype="float64"), np.zeros(window // 2)])
    total = np.concatenate([[0.0], np.cumsum(square)])
    starts = np.arange(0, len(y) + 1, hop)
    return np.maximum(total[starts + 2 * (window // 2)] - total[starts], 0.0) / window


def _active(y: np.ndarray, window: int, hop: int, top_db: float) -> tuple[int, int] | None:
    """First and last frame within ``top_db`` dB of the loudest; none in silence."""
    power = _power(y, window, hop) if len(y) else np.zeros(1)
    if not power.max() > 0:
        return None
    loud = np.flatnonzero(power >= power.max() * 10.0 ** (-top_db / 10.0))
    return int(loud[0]), int(loud[-1])


def _cut(y: np.ndarray, window: int, hop: int) -> Iterator[np.ndarray]:
    """(frames x window) of the centred, zero-padded frames of a signal, some thousand samples at a time."""
    padded = np.concatenate([np.zeros(window // 2, y.dtype), y, np.zeros(window - window // 2, y.dtype)])
    view = np.lib.stride_tricks.sliding_window_view(padded, window)[: len(y) + 1 : hop]
    step = max(1, HELD_SAMPLES // (4 * window))
    for at in range(0, len(view), step):
        yield view[at : at + step].astype("float64")


def frame_power(decoded: DataFrame, key: str, window: int, hop: int) -> DataFrame:
    """(key, frame_idx, power): mean square of each centred frame."""

    @F.pandas_udf("array<double>")
    def powers(samples: pd.Series) -> pd.Series:
        return pd.Series([_power(y, window, hop) for y in samples])

    rows = decoded.where(F.size("samples") > 0)
    return rows.select(key, F.posexplode(powers("samples")).alias("frame_idx", "power"))


def frames_of(decoded: DataFrame, key: str, window: int, hop: int, empty: bool = False) -> DataFrame:
    """(key, frame_idx, vec): centred, zero-padded frames as rows.

    Frames are cut inside the row and exploded afterwards, so the signal
    itself is never copied once per frame. A signal without samples has no
    frames, or with ``empty`` the one of its padding.
    """
    pad = F.array_repeat(F.lit(0.0).cast("float"), window // 2)
    starts = F.sequence(F.lit(0), F.size("samples"), F.lit(hop))
    padded = decoded.where(F.size("samples") >= (0 if empty else 1)).select(
        key, F.concat(pad, "samples", pad).alias("_y"), starts.alias("_starts")
    )
    cut = F.transform("_starts", lambda s: F.slice("_y", s + 1, window))
    return padded.select(key, F.posexplode(cut).alias("frame_idx", "vec"))


_MEASURES = (
    "sr int, n_channels int, n_frames bigint, duration double, peak_amp double, rms double, dbfs_peak double, n_clipped bigint, "
    "trimmed_duration double, lead_silence double, trail_silence double, silence_fraction double, load_error string"
)


def _levels(y: np.ndarray, sr: int, top_db: float, window: int, hop: int) -> tuple:
    """n_frames to silence_fraction of :data:`_MEASURES`, then the first kept sample and their number."""
    n, size = len(y), np.abs(y)
    peak = float(size.max()) if n else 0.0
    rms = float(np.sqrt(np.square(size, dtype="float64").mean())) if n else 0.0
    found = _active(y, window, hop, top_db)
    start, end = (min(found[0] * hop, n), min((found[1] + 1) * hop, n)) if found else (0, 0)
    return (
        n, n / sr, peak, rms, 20.0 * float(np.log10(peak)) if peak > 0 else None, int((size >= CLIP_LEVEL).sum()),
        (end - start) / sr, start / sr, (n - end) / sr if found else 0.0, 1.0 - (end - start) / n if n else 0.0, start, end - start,
    )


def audit_measures(decoded: DataFrame, key: str, top_db: float = 30, window: int = 2048, hop: int = 512) -> DataFrame:
    """Amplitude and silence measures per file, nulls where decoding failed.

    Trimming looks at frame power relative to the loudest frame and keeps from
    the first to one hop past the last active frame.
    """

    def measure(sr, channels, y, error):
        if error is not None:
            return (sr, channels, *[None] * 10, error)
        return (sr, channels, *_levels(y, sr, top_db, window, hop)[:10], None)

    return per_clip(decoded, key, measure, _MEASURES)


def channel_report(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, n_channels, max_abs_diff): 0 means a lossless downmix."""
    raw = decode(files, key, content, rate=None, mono=False)
    k = F.col("n_channels")
    # the first channel of the same frame sits at the frame's start
    diff = F.transform(
        "samples", lambda x, i: F.abs(x - F.element_at("samples", (F.floor(i / k) * k + 1).cast("int")))
    )
    return raw.select(
        key, "n_channels",
        F.when(F.col("load_error").isNull(), F.coalesce(F.array_max(diff).cast("double"), F.lit(0.0))).alias("max_abs_diff"),
        "load_error",
    )


# ------------------------------------------------------------- frame spectrum


def _mel_bank(s: FeatureSettings) -> np.ndarray:
    """Triangular filters, linear below 1 kHz and logarithmic above, unit area."""
    low, step, knee = 200.0 / 3, np.log(6.4) / 27.0, 1000.0

    def to_mel(f):
        f = np.asarray(f, float)
        return np.where(f < knee, f / low, knee / low + np.log(np.maximum(f, 1e-9) / knee) / step)

    def to_hz(m):
        return np.where(m < knee / low, m * low, knee * np.exp(step * (m - knee / low)))

    edges = to_hz(np.linspace(to_mel(s.fmin), to_mel(s.fmax or s.sr / 2), s.n_mels + 2))
    freq = np.fft.rfftfreq(s.n_fft, 1 / s.sr)
    rise = (freq - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - freq) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


def _cosines(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II rows."""
    basis = np.cos(np.pi / n_in * (np.arange(n_in) + 0.5) * np.arange(n_out)[:, None]) * np.sqrt(2 / n_in)
    basis[0] /= np.sqrt(2)
    return basis


def _spectra(sr: int, n_fft: int, banks: Sequence[np.ndarray], extras: Collection[str]):
    """frames -> (mel decibels of each bank, extra descriptors by name), from one spectrum."""
    window, freq = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft), np.fft.rfftfreq(n_fft, 1 / sr)
    pitch = np.zeros((12, len(freq)))
    pitch[np.round(12 * np.log2(np.maximum(freq[1:], 1e-9) / 440.0) + 9).astype(int) % 12, np.arange(1, len(freq))] = 1
    bands = [0.0] + [200.0 * 2**i for i in range(7)]
    cells = [np.flatnonzero((freq >= lo) & (freq < hi)) for lo, hi in zip(bands, [*bands[1:], sr / 2 + 1])]
    by_size = {"spectral_contrast", "spectral_centroid", "rolloff"} & set(extras)

    def contrast(mag: np.ndarray, cell: np.ndarray) -> np.ndarray:
        q = max(1, int(round(0.02 * len(cell)))) if len(cell) else 0
        if not q:
            return np.zeros((len(mag), 1))
        part = np.sort(mag[:, cell], axis=1)
        top, low = part[:, -q:].mean(1), part[:, :q].mean(1)
        return (20 * np.log10(np.maximum(top, 1e-5) / np.maximum(low, 1e-5)))[:, None]

    def describe(y: np.ndarray) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        spectrum = np.fft.rfft(y * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mag, rest = np.sqrt(power) if by_size else None, {}
        if "chroma" in extras:
            c = power @ pitch.T
            rest["chroma"] = c / np.maximum(c.max(1, keepdims=True), 1e-12)
        if "spectral_contrast" in extras:
            rest["spectral_contrast"] = np.hstack([contrast(mag, cell) for cell in cells])
        if "spectral_centroid" in extras:
            rest["spectral_centroid"] = (mag @ freq / np.maximum(mag.sum(1), 1e-12))[:, None]
        if "rolloff" in extras:
            rest["rolloff"] = freq[np.argmax(np.cumsum(mag, 1) >= 0.85 * mag.sum(1, keepdims=True), axis=1)][:, None]
        if "zcr" in extras:
            rest["zcr"] = (np.diff(np.signbit(y), axis=1).sum(1) / y.shape[1])[:, None]
        if "rms" in extras:
            rest["rms"] = np.sqrt((y**2).mean(1))[:, None]
        return [10 * np.log10(np.maximum(power @ bank.T, 1e-10)) for bank in banks], rest

    return describe


def _describer(s: FeatureSettings):
    """frames -> (mel decibels, extra descriptors)."""
    spectra = _spectra(s.sr, s.n_fft, [_mel_bank(s)], s.extras)

    def describe(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (mel,), rest = spectra(y)
        return mel, np.hstack([np.zeros((len(y), 0)), *rest.values()])

    return describe


def descriptors(frames: DataFrame, key: str, s: FeatureSettings) -> DataFrame:
    """(key, frame_idx, mel, rest): mel decibels and the extra descriptors.

    Cepstra need the loudest mel value of the whole series for their 80 dB
    floor, so they follow in :func:`cepstra` after a group aggregate.
    """
    kind = frames.schema[key].dataType.simpleString()

    def run(batches):
        describe = _describer(s)
        for pdf in batches:
            for at in range(0, len(pdf), HELD_ROWS):
                part = pdf.iloc[at : at + HELD_ROWS]
                mel, rest = describe(np.stack(part.vec.to_numpy()).astype("float64"))
                yield pd.DataFrame({key: part[key], "frame_idx": part.frame_idx, "mel": list(mel), "rest": list(rest)})

    return frames.mapInPandas(run, f"{key} {kind}, frame_idx int, mel array<double>, rest array<double>")


def cepstra(described: DataFrame, key: str, n_mfcc: int, n_mels: int, floor_db: float = FLOOR_DB) -> DataFrame:
    """(key, frame_idx, mfcc, rest): cosine transform of the floored mel decibels."""
    peak = described.groupBy(key).agg(F.max(F.array_max("mel")).alias("_top"))
    basis = _cosines(n_mfcc, n_mels)

    @F.pandas_udf("array<double>")
    def transform(mel: pd.Series, top: pd.Series) -> pd.Series:
        x = np.maximum(np.stack(mel.to_numpy()), top.to_numpy()[:, None] - floor_db)
        return pd.Series(list(x @ basis.T))

    joined = described.join(peak, key)
    return joined.select(key, "frame_idx", transform("mel", "_top").alias("mfcc"), "rest")


def _local_fit(frames: np.ndarray, width: int, order: int) -> np.ndarray:
    """Slope or curvature per frame; frames near an end take the nearest full window's."""
    width = resolve_width(width, len(frames))
    half = width // 2
    if len(frames) < width:
        return np.zeros_like(frames)
    inner = sum(w * frames[k : len(frames) - 2 * half + k] for k, w in enumerate(delta_kernel(width, order)))
    return np.concatenate([np.repeat(inner[:1], half, 0), inner, np.repeat(inner[-1:], half, 0)])


def vector_deltas(frames: DataFrame, key: str, vec: str, rest: str, width: int, orders) -> DataFrame:
    """(key, frame_idx, vec): ``vec``, its deltas of each order, then ``rest``.

    The frames of one clip come from one file that one task decoded, so a clip
    fits into a row; for unbounded series use
    :func:`foldstone.operators.series.deltas`.
    """

    @F.pandas_udf("array<array<double>>")
    def widen(clips: pd.Series, tails: pd.Series) -> pd.Series:
        out = []
        for clip, tail in zip(clips, tails):
            x = np.stack(clip)
            blocks = [x, *[_local_fit(x, width, o) for o in orders], np.stack(tail)]
            out.append(list(np.hstack(blocks)))
        return pd.Series(out)

    clips = frames.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("frame_idx", F.col(vec).alias("v"), F.col(rest).alias("r")))).alias("_f")
    )
    wide = clips.select(key, widen(F.col("_f.v"), F.col("_f.r")).alias("_w"))
    return wide.select(key, F.posexplode("_w").alias("frame_idx", "vec"))


def extract(decoded: DataFrame, key: str, s: FeatureSettings) -> DataFrame:
    """(key, features): the whole chain from samples to one vector per series.

    All steps look at one clip, so none of its frames is shuffled; clips that
    are silent, empty or unreadable have no vector. For series over several
    rows use :func:`descriptors`, :func:`cepstra` and :func:`vector_deltas`.
    """
    return extract_each(decoded, key, {"features": s}).where("features IS NOT NULL")


def extract_each(decoded: DataFrame, key: str, settings: Mapping[str, FeatureSettings]) -> DataFrame:
    """(key, a vector a name): :func:`extract` by several settings in one pass, null where one finds none."""
    out = T.StructType([decoded.schema[key], *[T.StructField(name, T.ArrayType(T.DoubleType())) for name in settings]])
    names, types = out.fieldNames(), [to_arrow_type(f.dataType) for f in out]

    def run(batches):
        vectors = extractor(settings)
        for batch in batches:
            keys, clips, errors = (batch.column(i) for i in range(3))
            some = ((k, c.values.to_numpy(zero_copy_only=False)) for k, c, e in zip(keys.to_pylist(), clips, errors) if c.is_valid and not e.is_valid and len(c.values))
            for part in batched(some):
                columns = []
                for at, x in vectors([y for _, y in part]).values():
                    column = [None] * len(part)
                    for i, vector in zip(at.tolist(), x):
                        column[i] = vector
                    columns.append(column)
                yield _batch([(k, *row) for (k, _), row in zip(part, zip(*columns))], names, types)

    return decoded.select(key, "samples", "load_error").mapInArrow(run, out)


def batched(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """Lists of some rows, whose last value is a clip: :data:`HELD_ROWS` rows at most and about a quarter of :data:`HELD_SAMPLES`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if 4 * size >= HELD_SAMPLES or len(held) >= HELD_ROWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def extractor(settings: Mapping[str, FeatureSettings]) -> Callable[[list[np.ndarray]], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """clips, none of them empty -> name -> (places of the clips that have a vector, a vector each).

    What settings have in common is computed once: frames and their spectra a
    framing and trim, cepstra and deltas a filter bank, statistics a block of
    columns. All frames of the clips are handled together, not a clip at a time.
    """
    shared: dict[tuple, dict[str, FeatureSettings]] = {}
    for name, s in settings.items():
        shared.setdefault((s.sr, s.n_fft, s.hop_length, s.top_db if s.trim else None), {})[name] = s
    views = [_view(group) for group in shared.values()]

    def vectors(clips: list[np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        found = {}
        for view in views:
            found |= view(clips)
        return {name: found[name] for name in settings}

    return vectors


def _frames(clips: list[np.ndarray], window: int, hop: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """(their number a clip, the centred, zero-padded frames of all clips, some thousand samples at a time)."""
    sizes = np.array([len(y) for y in clips])
    counts, ends = sizes // hop + 1, np.cumsum(sizes + window)
    padded = np.zeros(ends[-1], "float32")
    for y, end in zip(clips, ends.tolist()):
        padded[end - len(y) - window + window // 2 : end - window + window // 2] = y
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(ends - sizes - window, counts) + hop * within
    view, step = np.lib.stride_tricks.sliding_window_view(padded, window), max(1, HELD_SAMPLES // (4 * window))
    return counts, (view[starts[at : at + step]].astype("float64") for at in range(0, len(starts), step))


def _view(settings: Mapping[str, FeatureSettings]):
    """:func:`extractor` for settings of one rate, framing and trim."""
    one = next(iter(settings.values()))
    about = {s: (s.n_mels, s.fmin, s.fmax) for s in settings.values()}
    banks = list(dict.fromkeys(about.values()))
    bank = {s: banks.index(b) for s, b in about.items()}
    n_mfcc = [max(s.n_mfcc for s in settings.values() if bank[s] == b) for b in range(len(banks))]
    bases = [_cosines(n, mels) for n, (mels, *_) in zip(n_mfcc, banks)]
    extras = {name for s in settings.values() for name in s.extras}
    spectra = _spectra(one.sr, one.n_fft, [_mel_bank(next(s for s in bank if bank[s] == b)) for b in range(len(banks))], extras)

    def trimmed(y: np.ndarray) -> np.ndarray:
        found = _active(y, one.n_fft, one.hop_length, one.top_db)
        return y[found[0] * one.hop_length : (found[1] + 1) * one.hop_length] if found else y[:0]

    def vectors(clips: list[np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        cut = list(map(trimmed, clips)) if one.trim else clips
        at = np.flatnonzero([len(y) > 0 for y in cut])
        if not len(at):
            return {name: (at, np.zeros((0, 0))) for name in settings}
        counts, frames = _frames([cut[i] for i in at.tolist()], one.n_fft, one.hop_length)
        mels, rest = zip(*map(spectra, frames))
        mels, rest = [np.vstack(m) for m in zip(*mels)], {name: np.vstack([r[name] for r in rest]) for name in rest[0]}
        starts, blocks, done = np.cumsum(counts) - counts, {}, {}
        for b, mel in enumerate(mels):
            top = np.maximum.reduceat(mel.max(1), starts)
            blocks[b, 0] = np.maximum(mel, np.repeat(top - FLOOR_DB, counts)[:, None]) @ bases[b].T

        def block(name, *more) -> np.ndarray:
            if (name, *more) not in blocks:
                order, width = more
                blocks[name, *more] = _local_fits(blocks[name, 0], counts, width, order)
            return blocks[name, *more]

        def statistic(kind, name, *more) -> np.ndarray:
            """(clip, column), or (clip, percentile, column)."""
            if (kind, name, *more) not in done:
                done[kind, name, *more] = _of_clips(kind, rest[name] if name in rest else block(name, *more), counts, starts)
            return done[kind, name, *more]

        out = {}
        for name, s in settings.items():
            orders = [(0,), *[(o, s.resolved_delta_width) for o, on in ((1, s.deltas), (2, s.delta_deltas)) if on]]
            kinds = ["percentiles"] if s.aggregation == "percentiles" else suffixes(s.aggregation)
            parts = []
            for kind in kinds:
                own = [statistic(kind, bank[s], *o)[..., : s.n_mfcc] for o in orders]
                own += [statistic(kind, x) for x in EXTRAS if x in s.extras]
                parts.append(np.concatenate(own, axis=-1).reshape(len(at), -1))
            out[name] = at, np.hstack(parts)
        return out

    return vectors


def _local_fits(frames: np.ndarray, counts: np.ndarray, width: int, order: int) -> np.ndarray:
    """:func:`_local_fit` of each of the clips whose frames follow each other."""
    out = np.zeros_like(frames)
    clip = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(frames)) - np.repeat(np.cumsum(counts) - counts, counts)
    widths = np.array([resolve_width(width, n) for n in counts.tolist()])
    for w in set(widths[counts >= widths].tolist()):  # one, but for short clips
        half, own = w // 2, np.flatnonzero(((widths == w) & (counts >= w))[clip])
        x, n = frames[own], counts[clip[own]]
        inner = sum(c * x[k : len(x) - 2 * half + k] for k, c in enumerate(delta_kernel(w, order)))
        # the window around the nearest frame that has a whole one in its clip
        out[own] = inner[np.arange(len(own)) - place[own] + np.clip(place[own], half, n - 1 - half) - half]
    return out


def _of_clips(kind: str, x: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A statistic of every column a clip, as :func:`foldstone.operators.series.aggregate_vectors` has them."""
    if kind == "percentiles":
        ordered = np.ascontiguousarray(x.T)
        for a, n in zip(starts.tolist(), counts.tolist()):
            ordered[:, a : a + n].sort(axis=1)
        place = np.array(PERCENTILES) / 100 * (counts[:, None] - 1)
        low = np.floor(place).astype(int)
        below, above = (ordered.T[starts[:, None] + np.minimum(i, counts[:, None] - 1)] for i in (low, low + 1))
        return below + (above - below) * (place - low)[:, :, None]
    if kind in ("min", "max"):
        return (np.minimum if kind == "min" else np.maximum).reduceat(x, starts)
    mean = np.add.reduceat(x, starts) / counts[:, None]
    if kind == "mean":
        return mean
    return np.sqrt(np.add.reduceat((x - np.repeat(mean, counts, 0)) ** 2, starts) / counts[:, None])


def rolloff_mean(decoded: DataFrame, key: str, percent: float = 0.95, window: int = 2048, hop: int = 512) -> DataFrame:
    """(key, rolloff_hz): mean frequency below which ``percent`` of the magnitude lies."""
    kind = decoded.schema[key].dataType.simpleString()
    frames = frames_of(decoded, key, window, hop).join(decoded.select(key, "sr"), key)

    def run(batches):
        hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(window) / window)
        for pdf in batches:
            if len(pdf):
                mag = np.abs(np.fft.rfft(np.stack(pdf.vec.to_numpy()) * hann, axis=1))
                bin_ = np.argmax(np.cumsum(mag, 1) >= percent * mag.sum(1, keepdims=True), axis=1)
                yield pd.DataFrame({key: pdf[key], "hz": bin_ * pdf.sr.to_numpy() / window})

    return frames.mapInPandas(run, f"{key} {kind}, hz double").groupBy(key).agg(F.avg("hz").alias("rolloff_hz"))


def _pitch(y: np.ndarray, sr: int, window: int, hop: int, fmin: float = 65.41, fmax: float = 2093.0, floor: float = 0.3) -> np.ndarray:
    """Pitch of each centred frame by its autocorrelation peak, NaN where unvoiced."""
    found = []
    lo, hi = int(sr / fmax), min(int(sr / fmin), window - 1)
    for frames in _cut(y, window, hop):
        frames -= frames.mean(1, keepdims=True)
        corr = np.fft.irfft(np.abs(np.fft.rfft(frames, 2 * window, axis=1)) ** 2, axis=1)[:, :window]
        out = np.full(len(frames), np.nan)
        if hi > lo:
            lag = lo + corr[:, lo:hi].argmax(1)
            top, whole = corr[np.arange(len(frames)), lag], corr[:, 0]
            voiced = (whole > 0) & (top >= floor * whole)
            out[voiced] = sr / lag[voiced]
        found.append(out)
    return np.concatenate(found)


def prosody(decoded: DataFrame, key: str, top_db: float = 30) -> DataFrame:
    """Duration, speech duration, silence, loudness and pitch statistics of readable clips."""
    window, hop = 2048, 512

    def measure(sr, channels, y, error):
        if error is not None:
            return None
        *level, start, length = _levels(y, sr, top_db, window, hop)
        speech = y[start : start + length]
        if not len(speech):
            return (level[1], level[6], level[9], None, None, None, 0.0)
        f0 = _pitch(speech, sr, window, hop)
        voiced = f0[~np.isnan(f0)]
        mean, sd = (float(voiced.mean()), float(voiced.std())) if len(voiced) else (None, None)
        loud = float(np.sqrt(np.square(speech, dtype="float64").mean()))
        return (level[1], level[6], level[9], loud, mean, sd, len(voiced) / len(f0))

    columns = "duration double, speech_duration double, silence_fraction double, rms double, f0_mean double, f0_std double, voiced_fraction double"
    return per_clip(decoded, key, measure, columns)


def clip_width(settings: FeatureSettings, n_frames: int) -> int:
    return resolve_width(settings.resolved_delta_width, n_frames)
