"""Sources and sinks: files, stored tables, and the audio container."""

from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import FeatureSettings
from ..operators.ranking import first_by
from ..operators.vectors import select_layer
from ..operators.series import aggregate_values
from ..sources import audio as W
from ..sources import recordings as RC
from ..sources import tables as B
from ..session import scratch_path
from .base import OBS, VECS, obs, query, read, rounded, tidy, vecs
from .evaluation import RESULTS, results
from .folds import FOLDS, folds
from .parsing import BASE, base_files, _LBL, _p


def wav_files(spark, d):
    """Documents as WAV files: the text bytes are the PCM samples.

    Rate and channel count follow from the key; every 50th file is a bare
    text, like a pointer page saved under a .wav name.
    """
    k = F.col("doc_id")
    rate = F.when(F.col("lang") == "en", 16000).otherwise(8000)
    channels = (k % 2 + 1).cast("int")
    data = F.encode(F.col("text"), "UTF-8")
    content = F.when(k % 50 == 7, data).otherwise(W.pcm_blob(data, rate, channels))
    path = F.concat(F.lit("wav/d"), k.cast("string"), F.lit(".wav"))
    return read(spark, d, "documents").select(k.alias("key"), "lang", "source", path.alias("path"), content.alias("content"))


_FILES = "(VALUES ('region.parquet'), ('nation.parquet'), ('customer.parquet'), ('supplier.parquet'), ('part.parquet'), ('orders.parquet'), ('lineitem.parquet'), ('events.parquet'), ('documents.parquet'), ('embeddings.parquet'), ('pages.parquet'), ('benchmark.parquet'), ('labels.parquet'), ('conversations.parquet')) AS t(name)"


def table_of(d) -> Column:
    """The table below ``d`` that a path is of, whether it is one file or a folder of part files."""
    return F.regexp_extract("path", r"\Q" + urlsplit(d).path.rstrip("/") + r"\E/+([^/]+)", 1)


@query("src_01", f"SELECT name, true AS has_bytes FROM {_FILES}")
def scan(spark, d):
    files = W.scan_files(spark, d, "*.parquet", content=False)
    return files.groupBy(table_of(d).alias("name")).agg((F.sum("length") > 0).alias("has_bytes"))


@query("src_02", "SELECT doc_id AS key, doc_id % 50 <> 7 AS ok FROM documents")
def guard(spark, d):
    return wav_files(spark, d).select("key", W.is_wav(F.col("content")).alias("ok"))


@query("src_03", f"WITH {OBS} SELECT key, label FROM obs WHERE NOT early")
def resume(spark, d):
    rows = obs(spark, d)
    return B.new_rows(rows.select("key", "label"), rows.where("early").select("key"), "key")


@query("src_04", rounded("""SELECT doc_id AS key, CASE WHEN ok THEN rate ELSE -1 END AS native_sr, CASE WHEN ok THEN ch ELSE -1 END AS channels,
 CASE WHEN ok THEN 'PCM_16' ELSE 'UNREADABLE: no PCM header' END AS subtype, CASE WHEN ok THEN n // (2 * ch) / rate::DOUBLE ELSE 0 END AS duration_s,
 CASE WHEN ok THEN n // (2 * ch) ELSE 0 END AS frames FROM (SELECT doc_id, doc_id % 50 <> 7 AS ok, CASE WHEN lang = 'en' THEN 16000 ELSE 8000 END AS rate,
 doc_id % 2 + 1 AS ch, octet_length(encode(text)) AS n FROM documents) AS _t""", "duration_s", digits=9))
def header_probe(spark, d):
    return tidy(W.probe_headers(wav_files(spark, d), "key"), 9)


#: (key, i, c, s): the 16-bit little-endian samples of every document
SAMPLES = """bytes AS (SELECT doc_id AS key, doc_id % 2 + 1 AS ch, CASE WHEN lang = 'en' THEN 16000 ELSE 8000 END AS rate,
   hex(encode(text)) AS hx, octet_length(encode(text)) // (2 * (doc_id % 2 + 1)) AS n FROM documents WHERE doc_id % 50 <> 7),
 pos AS (SELECT key, ch, rate, n, hx, unnest(range(n * ch)) AS j FROM bytes),
 smp AS (SELECT key, ch, rate, n, j // ch AS i, j % ch AS c, ('0x' || substr(hx, 4 * j + 1, 2))::INT + 256 * ('0x' || substr(hx, 4 * j + 3, 2))::INT AS raw FROM pos),
 sig AS (SELECT key, any_value(ch) AS ch, any_value(rate) AS rate, any_value(n) AS n, i, avg((CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END) / 32768e0) AS y,
   max(abs((CASE WHEN raw >= 32768 THEN raw - 65536 ELSE raw END) / 32768e0 - CASE WHEN c0 >= 32768 THEN c0 - 65536 ELSE c0 END / 32768e0)) AS dev
   FROM (SELECT *, first_value(raw) OVER (PARTITION BY key, i ORDER BY c) AS c0 FROM smp) AS _s GROUP BY key, i)"""


@query("src_05", rounded(f"""WITH {SAMPLES} SELECT key, any_value(rate)::INT AS sr, any_value(ch)::INT AS n_channels, count(*) AS n_samples, sum(y) / count(*) AS mean, max(abs(y)) AS peak
 FROM sig GROUP BY key""", "mean", "peak", digits=4))
def decoded(spark, d):
    rows = W.decode(wav_files(spark, d), "key", rate=None).where("load_error IS NULL")
    y = F.col("samples")
    return tidy(rows.where(F.size(y) > 0).select(  # a file without a whole frame has no mean
        "key", "sr", "n_channels", F.size(y).cast("bigint").alias("n_samples"),
        (F.aggregate(y, F.lit(0.0), lambda a, x: a + x) / F.size(y)).alias("mean"), F.array_max(F.transform(y, lambda x: F.abs(x))).cast("double").alias("peak"),
    ), 4)


@query("src_06", f"""WITH {BASE} SELECT filename, 'RAVDESS_' || {_p('a')} AS speaker_id, e AS emotion, {_LBL}[e::INT] AS emotion_label, e::INT AS label, 1 AS source_order
 FROM base WHERE problem IS NULL""")
def index_csv(spark, d):
    from ..operators import inventory as I

    path = scratch_path(spark, "index")
    B.write_index(I.base_index(I.parse_base(base_files(spark, d))).where("problem IS NULL"), path)
    return B.read_index(spark, path).select("filename", "speaker_id", "emotion", "emotion_label", "label", "source_order")


@query("src_07", "SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END ELSE 'unknown' END AS sex FROM customer")
def demographics(spark, d):
    path = scratch_path(spark, "people")
    side = read(spark, d, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("nation"), F.when(F.col("n_nationkey") % 2 == 0, "male").otherwise("female").alias("sex")
    )
    B.write_csv(side, path)
    rows = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    return B.with_side_table(rows, B.side_table(spark, path, "nation INT, sex STRING"), "nation", "sex").drop("nation")


@query("src_08", f"WITH {FOLDS} SELECT protocol, fold, split, count(*) AS n, true AS refused FROM folds GROUP BY ALL")
def fold_sink(spark, d):
    path = scratch_path(spark, "folds")
    table = folds(spark, d)
    B.write_folds(table, path)
    refused = False
    try:
        B.write_folds(table, path)
    except Exception:
        refused = True
    stored = B.read_folds(spark, path, T.LongType(), "key")
    return stored.groupBy("protocol", "fold", "split").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("src_09", f"WITH {FOLDS} SELECT * FROM folds WHERE protocol = 'random_stratified'")
def fold_scan(spark, d):
    path = scratch_path(spark, "folds")
    B.write_folds(folds(spark, d), path, force=True)
    return B.read_folds(spark, path, T.LongType(), "key").where("protocol = 'random_stratified'")


@query("src_10", rounded(f"WITH {OBS} SELECT grp, avg(x) AS mean, stddev_pop(x) AS std FROM obs GROUP BY grp", "mean", "std"))
def keyed_cache(spark, d):
    root = scratch_path(spark, "cache")
    config = FeatureSettings()
    keys = obs(spark, d).select("grp").distinct()

    def build(_):
        return aggregate_values(obs(spark, d), "grp", "x", "mean_std")

    B.cached_by_hash(keys, root, config.hash, "grp", build)
    return tidy(B.cached_by_hash(keys, root, config.hash, "grp", lambda _: None))


@query("src_11", rounded(f"WITH {RESULTS} SELECT model, protocol, fold::VARCHAR AS fold, accuracy, macro_f1 FROM res UNION ALL SELECT model, protocol, 'pooled', accuracy, macro_f1 FROM res WHERE fold = 0", "accuracy", "macro_f1"))
def results_log(spark, d):
    path = scratch_path(spark, "results")
    empty = F.lit("")

    def rows(df, fold):
        return df.select(
            F.lit("r").alias("run_id"), F.lit("t").alias("timestamp"), F.lit("o").alias("owner"), "protocol", fold.alias("fold"),
            empty.alias("feature_config"), "model", F.lit("{}").alias("hyperparams"), "accuracy", "macro_f1", empty.alias("notes"),
        )

    res = results(spark, d)
    B.append_results(rows(res, F.col("fold")), path)
    B.append_results(rows(res.where("fold = 0"), F.lit("pooled")), path)
    return tidy(B.read_results(spark, path).select("model", "protocol", "fold", "accuracy", "macro_f1"))


@query("src_12", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def guarded_sink(spark, d):
    path = scratch_path(spark, "audit")
    rows = read(spark, d, "customer")
    B.write_guarded(rows, rows.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left"), path)
    return spark.read.parquet(path).select("c_custkey", "n_name")


@query("src_13", rounded(f"WITH {RESULTS} SELECT model, protocol, fold::VARCHAR AS fold, accuracy FROM res", "accuracy"))
def result_table(spark, d):
    path = scratch_path(spark, "runs")
    B.write_result_table(results(spark, d).select("model", "protocol", "fold", "accuracy"), path)
    return tidy(spark.read.parquet(path))


def tensor(spark, d, layers=4):
    """(key, layer, stat, vec): layers derived from the stored vectors."""
    entries = F.array(*[
        F.struct(F.lit(l).alias("layer"), F.lit(s).alias("stat"), F.lit(float(l + 1)).alias("f"), F.lit(0.5 * l if s == "mean" else 2.0).alias("o"))
        for l in range(layers) for s in ("mean", "std")
    ])
    rows = vecs(spark, d).select("key", "grp", "label", "vec", F.explode(entries).alias("e"))
    return rows.select("key", "grp", "label", "e.layer", "e.stat", F.transform("vec", lambda x: x * F.col("e.f") + F.col("e.o")).alias("vec"))


TENSOR = f"""{VECS}, tensor AS (SELECT key, grp, label, l AS layer, s AS stat,
  list_transform(vec, lambda x: x * (l + 1) + CASE WHEN s = 'mean' THEN 0.5::DOUBLE * l ELSE 2e0 END) AS vec
  FROM vecs, range(4) AS t(l), unnest(['mean', 'std']) AS u(s))"""
R6 = "list_transform({}, lambda x: round(x, 6) + 0e0)"


@query("src_14", f"WITH {TENSOR} SELECT key, {R6.format('vec')} AS vec FROM tensor WHERE layer = 2 AND stat = 'std'")
def tensor_store(spark, d):
    path = scratch_path(spark, "tensor")
    B.write_tensor(tensor(spark, d).drop("grp", "label"), path)
    return tidy(select_layer(B.read_tensor(spark, path), "key", 2, "std", 4))


# ---------------------------------------------------------------------- audit


def trim_sql(window: int, hop: int, top_db: float) -> str:
    """tb(key, first, last, n_frames): active frames of the decoded signals."""
    half = window // 2
    return f"""fr AS (SELECT key, unnest(range(greatest(0, (i - {half}) // {hop} + CASE WHEN i >= {half} THEN 1 ELSE 0 END), least(n // {hop}, (i + {half}) // {hop}) + 1)) AS f, y * y AS e FROM sig),
 pw AS (SELECT key, f, sum(e) / {window} AS power FROM fr GROUP BY ALL), pk AS (SELECT *, max(power) OVER (PARTITION BY key) AS peak FROM pw),
 tb AS (SELECT key, min(f) FILTER (WHERE power >= peak * pow(10, {-top_db / 10})) AS first, max(f) FILTER (WHERE power >= peak * pow(10, {-top_db / 10})) AS last FROM pk GROUP BY key)"""


@query("aud_01", rounded(f"""WITH {SAMPLES} SELECT key, count(*) AS n_frames, count(*) / any_value(rate)::DOUBLE AS duration, max(abs(y)) AS peak_amp, sqrt(avg(y * y)) AS rms,
 20 * log10(max(abs(y))) AS dbfs_peak, count(*) FILTER (WHERE abs(y) >= 0.999) AS n_clipped FROM sig GROUP BY key""", "duration", "peak_amp", "rms", "dbfs_peak", digits=8))
def amplitude(spark, d):
    rows = W.audit_measures(W.decode(wav_files(spark, d), "key", rate=None), "key")
    return tidy(rows.where("load_error IS NULL AND n_frames > 0").select("key", "n_frames", "duration", "peak_amp", "rms", "dbfs_peak", "n_clipped"), 8)


_AUDIT = ["duration", "peak_amp", "rms", "dbfs_peak", "trimmed_duration", "lead_silence", "trail_silence", "silence_fraction"]


@query("aud_02", rounded(f"""WITH {SAMPLES}, {trim_sql(2048, 512, 30)},
 b AS (SELECT key, any_value(rate) AS sr, any_value(ch) AS n_channels, count(*) AS n, max(abs(y)) AS peak_amp, sqrt(avg(y * y)) AS rms, count(*) FILTER (WHERE abs(y) >= 0.999) AS n_clipped FROM sig GROUP BY key),
 c AS (SELECT *, least(first * 512, n) AS s, least((last + 1) * 512, n) AS e FROM b JOIN tb USING (key))
SELECT d.doc_id AS key, d.lang, d.source, sr::INT AS sr, n_channels::INT AS n_channels, n AS n_frames, n / sr::DOUBLE AS duration, peak_amp, rms, 20 * log10(peak_amp) AS dbfs_peak, n_clipped,
 (e - s) / sr::DOUBLE AS trimmed_duration, s / sr::DOUBLE AS lead_silence, (n - e) / sr::DOUBLE AS trail_silence, 1 - (e - s) / n::DOUBLE AS silence_fraction,
 CASE WHEN c.key IS NULL THEN 'ValueError: not a WAV file' END AS load_error FROM documents d LEFT JOIN c ON c.key = d.doc_id""", *_AUDIT, digits=8))
def full_audit(spark, d):
    from ..operators.joins import guarded_left_join

    files = wav_files(spark, d)
    measures = W.audit_measures(W.decode(files, "key", rate=None), "key")
    return tidy(guarded_left_join(files.select("key", "lang", "source"), measures, "key"), 8)


_S = ["min", "p25", "median", "mean", "p75", "max", "std"]


@query("aud_03", rounded(" UNION ALL ".join(f"""SELECT '{c}' AS measure, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median, avg({c}) AS mean,
 quantile_cont({c}, 0.75) AS p75, max({c}) AS max, stddev_samp({c}) AS std FROM lineitem WHERE l_tax > 0.01""" for c in ("l_quantity", "l_extendedprice", "l_discount")), *_S, digits=4))
def audit_summary(spark, d):
    from ..operators.profile import distribution

    rows = read(spark, d, "lineitem").where("l_tax > 0.01")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in ("l_quantity", "l_extendedprice", "l_discount")]))
    return tidy(distribution(rows.select(cells.alias("e")).select("e.measure", "e.x"), "x", "measure"), 4)


@query("aud_04", rounded(f"""WITH {SAMPLES} SELECT key, any_value(ch)::INT AS n_channels, max(dev) AS max_abs_diff FROM sig GROUP BY key
 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 50 = 7""", "max_abs_diff", digits=4))
def channels(spark, d):
    return tidy(W.channel_report(wav_files(spark, d), "key").drop("load_error"), 4)


# ------------------------------------------------------------ frame features

SMALL = FeatureSettings(
    n_mfcc=13, n_fft=256, hop_length=128, n_mels=26, sr=16000, delta_width=5, trim=True, top_db=30,
    extras=("spectral_centroid", "rolloff", "zcr", "rms", "chroma", "spectral_contrast"),
)


@query("fea_01", f"""WITH {SAMPLES}, {trim_sql(256, 128, 3)}, c AS (SELECT key, any_value(n) // 128 + 1 AS n_frames FROM sig GROUP BY key)
SELECT key, first, last, n_frames FROM tb JOIN c USING (key)""")
def silence_trim(spark, d):
    from ..operators.series import trim_bounds

    rows = W.decode(wav_files(spark, d), "key", rate=None).where("load_error IS NULL")
    return trim_bounds(W.frame_power(rows, "key", 256, 128), "key", "power", 3)


@query("fea_02", """SELECT doc_id AS key, n // (2 * ch) // 128 + 1 AS frames, 256 AS width FROM
 (SELECT doc_id, doc_id % 2 + 1 AS ch, octet_length(encode(text)) AS n FROM documents WHERE doc_id % 50 <> 7) AS _t""")
def framing(spark, d):
    rows = W.decode(wav_files(spark, d), "key", rate=None).where("load_error IS NULL")
    frames = W.frames_of(rows, "key", 256, 128, empty=True)
    return frames.groupBy("key").agg(F.count(F.lit(1)).alias("frames"), F.max(F.size("vec")).alias("width"))


@query("fea_02_ranges", rounded(f"""WITH {SAMPLES}, files AS (SELECT DISTINCT key, n FROM bytes WHERE n > 0), cut AS (SELECT s.key, f.i AS frame_idx, s.y
 FROM sig s, range(3) AS o(k), LATERAL (SELECT (s.i + 128) // 128 - o.k AS i) AS f WHERE f.i >= 0 AND s.i + 128 < f.i * 128 + 256)
SELECT key, n // 128 + 1 AS frames, coalesce(energy, 0) AS energy FROM files LEFT JOIN (SELECT key, sum(y * y) AS energy FROM cut JOIN files USING (key) WHERE frame_idx <= n // 128 GROUP BY key) AS _e USING (key)""", "energy", digits=3))
def framing_by_ranges(spark, d):
    """Frames of files on the shared folder, read by byte ranges of 2,048 samples: their number and the sum of their squares."""
    root, files = scratch_path(spark, "wavs"), wav_files(spark, d)
    n = files.count()
    name = F.concat(RC.folder_of(F.col("key"), n), F.lit("/"), F.col("key").cast("string"), F.lit(".wav"))
    written = RC.write_files(files, root, name, F.col("content"))
    written.agg(F.sum("bytes")).collect()
    # rows of ranges are small, whatever they name: their size does not say how many tasks they need
    tasks = max(spark.sparkContext.defaultParallelism, n // (4 * RC.FOLDER_FILES))
    frames = RC.range_frames(RC.plan(RC.list_files(spark, root)), 256, 128, samples=2048, partitions=tasks)
    key = F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("bigint")
    energy = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    return tidy(frames.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("frames"), F.sum(energy).alias("energy")), 3)


@query("fea_03")
def frame_descriptors(spark, d):
    rows = W.decode(wav_files(spark, d), "key").where("load_error IS NULL")
    return W.descriptors(W.frames_of(rows, "key", SMALL.n_fft, SMALL.hop_length), "key", SMALL)


@query("fea_06")
def extract(spark, d):
    return W.extract(W.decode(wav_files(spark, d), "key"), "key", SMALL)


@query("fea_07")
def prosody(spark, d):
    return W.prosody(W.decode(wav_files(spark, d), "key"), "key")


@query("agg_12_rolloff")
def rolloff(spark, d):
    files = wav_files(spark, d)
    from ..functions.hashing import digest

    chosen = first_by(files.select("key", "lang", "content"), "lang", [digest(42, F.col("key")), F.col("key")], 40)
    hz = W.rolloff_mean(W.decode(chosen, "key").where("load_error IS NULL"), "key")
    return hz.join(chosen.select("key", "lang"), "key").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_probed"), F.round(F.avg("rolloff_hz"), 1).alias("hz_mean"), F.round(F.stddev_pop("rolloff_hz"), 1).alias("hz_sd")
    )
