"""Incremental work on arriving files and rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evaluate import PRED, TRUE, scores
from ..sources.tables import write_batch

#: Schema of the ``binaryFile`` source; a stream must be told.
FILE_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


def file_stream(spark: SparkSession, root: str, glob: str = "*.wav", per_trigger: int = 1000) -> DataFrame:
    """New files below ``root``, each exactly once per checkpoint."""
    return (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_trigger)
        .load(root)
    )


def ingest(stream: DataFrame, out: str, checkpoint: str):
    """Append a stream to parquet until the present input is used up."""
    return (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def log_stream(rows: DataFrame, path: str, checkpoint: str):
    """Add result rows to the shared log, batch by batch.

    A batch that is replayed after a failure replaces its own folder, so no
    row is logged twice. The folder ``batch=<id>`` is no column of the log.
    """
    return (
        rows.writeStream.foreachBatch(lambda batch, number: write_batch(batch, path, number))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def windowed_counts(
    pred: DataFrame, ts: str = "ts", width: str = "1 day", lateness: str = "1 hour", batch: bool = False
) -> DataFrame:
    """(window_start, y_true, y_pred, n) over event time; works on both kinds of table."""
    rows = pred if batch else pred.withWatermark(ts, lateness)
    return (
        rows.groupBy(F.window(ts, width).alias("w"), TRUE, PRED)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), TRUE, PRED, "n")
    )


def windowed_scores(counts: DataFrame) -> DataFrame:
    """Scores per window from stored window counts."""
    return scores(counts, "window_start")


def count_stream(pred: DataFrame, out: str, checkpoint: str, **kwargs):
    """Closed windows of a prediction stream, appended to parquet."""
    return ingest(windowed_counts(pred, **kwargs), out, checkpoint)
