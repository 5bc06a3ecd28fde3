"""Streams and user extension points."""

from pyspark.sql import functions as F

from ..functions.hashing import hash32
from ..operators import evaluate as E
from ..operators import models as M
from ..operators.augment import mixup
from ..session import scratch_path
from ..sources import tables as B
from ..streaming import ingest as I
from ..streaming.udtf import frame_rows, series_frames
from .storage import _FILES, table_of
from .base import EVENT_LABELS, PRED, VECS, query, read, rounded, score_sql, tidy, vecs
from .profiling import SERIES, series
from .vectors import RAWF, SCORES, T, _centroid_predict, _mllib, encoded, folded


def event_stream(spark, d):
    """The events as a stream, whether the table is one file or a folder of part files."""
    schema = read(spark, d, "events").schema
    if B.is_folder(spark, f"{d}/events.parquet"):
        return spark.readStream.schema(schema).parquet(f"{d}/events.parquet")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("str_01", f"SELECT name, 1::BIGINT AS times FROM {_FILES}")
def file_ingest(spark, d):
    out, mark = scratch_path(spark, "ingest"), scratch_path(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        stream = I.file_stream(spark, d, "*.parquet").select(table_of(d).alias("name"), "path", "length")
        I.ingest(stream, out, mark).awaitTermination()
    files = spark.read.parquet(out).groupBy("name", "path").agg(F.count(F.lit(1)).alias("times"))
    return files.groupBy("name").agg(F.max("times").alias("times"))


@query("str_02", "SELECT event_type AS model, count(*) AS n FROM events GROUP BY 1")
def stream_log(spark, d):
    path, mark = scratch_path(spark, "log"), scratch_path(spark, "mark")
    text = F.lit("")
    rows = event_stream(spark, d).select(
        F.col("event_id").cast("string").alias("run_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        text.alias("owner"), text.alias("protocol"), F.lit("pooled").alias("fold"), text.alias("feature_config"),
        F.col("event_type").alias("model"), F.lit("{}").alias("hyperparams"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("macro_f1"), text.alias("notes"),
    )
    I.log_stream(rows, path, mark).awaitTermination()
    return B.read_results(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def scored(events):
    return E.with_synthetic_predictions(events.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "event_id", EVENT_LABELS, 7, "a")


_WIN = f"""{PRED}, w AS (SELECT date_trunc('day', ts) AS window_start, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)"""
_CLOSED = "window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("str_03", f"WITH {_WIN} SELECT strftime(window_start, '%Y-%m-%d') AS day, y_true, y_pred, n FROM w WHERE {_CLOSED}")
def windowed(spark, d):
    out, mark = scratch_path(spark, "windows"), scratch_path(spark, "mark")
    I.count_stream(scored(event_stream(spark, d)), out, mark).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "y_true", "y_pred", "n")


@query("str_03_batch", rounded(f"""WITH {_WIN}, t AS (SELECT strftime(window_start, '%Y-%m-%d') AS day, y_true, y_pred, n FROM w)
 SELECT day, n, accuracy, macro_f1 FROM ({score_sql('t', 'day')}) AS _s""", "accuracy", "macro_f1"))
def windowed_batch(spark, d):
    counts = I.windowed_counts(scored(read(spark, d, "events")), batch=True)
    table = I.windowed_scores(counts)
    return tidy(table.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "accuracy", "macro_f1"))


@query("str_04", "SELECT vec_id AS key, 12 AS frames FROM (SELECT vec_id FROM embeddings) AS _t")
def frame_batches(spark, d):
    return encoded(spark, d).groupBy("key").agg(F.count(F.lit(1)).alias("frames"))


# ------------------------------------------------------------ extension points


@query("udf_01", rounded(f"""WITH {PRED} SELECT early, avg((y_true = y_pred)::INT) AS value FROM pred GROUP BY early""", "value"))
def metric_callable(spark, d):
    from ..operators.uncertainty import pandas_metric
    from .base import pred

    def right(true, guess, weight):
        return weight[true == guess].sum() / weight.sum()

    return tidy(pandas_metric(right)(E.tally(pred(spark, d), "early"), ["early"]))


@query("udf_02")
def model_factory(spark, d):
    from pyspark.ml.classification import DecisionTreeClassifier

    M.MODELS["shallow-tree"] = lambda p, n, k: DecisionTreeClassifier(maxDepth=3, featuresCol="_x", labelCol="_y", weightCol="_w")
    return _mllib("shallow-tree", {})(spark, d)


@query("udf_03", rounded(f"WITH {RAWF}, {T} {score_sql('t')}", *SCORES))
def predict_function(spark, d):
    rows = folded(spark, d)

    def predict(train, test):
        return _centroid_predict(train, test).drop("fold").join(test.select("key", "fold"), "key")

    return tidy(E.score(M.run_folds(rows, range(5), predict, ["key"])))


@query("udf_04")
def augment_function(spark, d):
    rows = folded(spark, d)

    def with_blends(train):
        mixed = mixup(train, "key", "vec", "label", "grp", 0.5, "u4")
        return train.select("key", "label", "vec").unionByName(mixed.select((-1 - F.col("draw")).alias("key"), "label", "vec"))

    def predict(train, test):
        return _centroid_predict(with_blends(train), test).drop("fold").join(test.select("key", "fold"), "key")

    return tidy(E.score(M.run_folds(rows, range(5), predict, ["key"])))


@query("udf_05")
def selector_function(spark, d):
    """A per-fold choice made on train rows only: the width of the vectors."""
    rows = folded(spark, d)

    def choose(train):
        inner = train.withColumn("fold", (hash32("in", F.col("grp")) % 3).cast("int"))
        marks = {w: E.score(M.nearest_centroid_oof(inner.withColumn("vec", F.slice("vec", 1, w)), "key", "vec", "label")).first()["macro_f1"] for w in (16, 64)}
        return max(marks, key=lambda w: (marks[w], -w))

    def predict(train, test):
        w = choose(train)
        cut = F.slice("vec", 1, w)
        out = _centroid_predict(train.withColumn("vec", cut), test.withColumn("vec", cut))
        return out.drop("fold").join(test.select("key", "fold"), "key")

    return M.run_folds(rows, range(5), predict, ["key"])


@query("udf_06", "SELECT vec_id AS key, layer::INT AS layer, 4 AS n FROM embeddings, range(3) AS t(layer)")
def encoder_function(spark, d):
    return encoded(spark, d).groupBy("key", "layer").agg(F.count(F.lit(1)).alias("n"))


@query("udf_07", f"""WITH {VECS} SELECT key, i::INT AS frame_idx, list_transform(vec[i * 8 + 1 : i * 8 + 16], lambda x: round(x, 6) + 0e0) AS vec FROM vecs, range(7) AS t(i)""")
def frame_udtf(spark, d):
    return tidy(frame_rows(vecs(spark, d), "key", "vec", 16, 8))


@query("udf_07_series", f"""WITH {SERIES}, n AS (SELECT grp, count(*) AS n FROM series GROUP BY grp),
 frames AS (SELECT grp, unnest(range((n - 16) // 8 + 1)) AS frame_idx FROM n WHERE n >= 16)
SELECT f.grp, f.frame_idx, list(round(x, 6) + 0e0 ORDER BY s.frame_idx) AS vec FROM frames f JOIN series s ON s.grp = f.grp AND s.frame_idx BETWEEN f.frame_idx * 8 AND f.frame_idx * 8 + 15 GROUP BY ALL""")
def series_udtf(spark, d):
    """Frames of 16 events every 8 for each user, from event rows by PARTITION BY and ORDER BY."""
    return tidy(series_frames(series(spark, d).select("grp", "frame_idx", "x"), "grp", "frame_idx", "x", 16, 8))
