import pytest
from pyspark.sql import functions as F

from foldstone.streaming.udtf import frame_rows, series_frames


def cut(values, width, hop):
    return [values[s : s + width] for s in range(0, len(values) - width + 1, hop)]


def got(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r["frame_idx"]] = list(r["vec"])
    return {k: [v[i] for i in range(len(v))] for k, v in out.items()}


@pytest.mark.parametrize("width,hop", [(4, 2), (3, 3), (2, 5), (1, 1)])
def test_signals_in_rows(spark, width, hop):
    signals = {"a": [1.0, None, 3.0, 4.0, 5.0, 6.0, 7.0], "b": [], "c": None, "d": [9.0], "e": [float(i) for i in range(40)]}
    df = spark.createDataFrame(list(signals.items()), "name string, y array<double>").repartition(3)
    out = frame_rows(df, "name", "y", width, hop)
    assert out.dtypes == [("name", "string"), ("frame_idx", "int"), ("vec", "array<double>")]
    assert got(out) == {k: c for k, v in signals.items() if (c := cut(v or [], width, hop))}


@pytest.mark.parametrize("width,hop,piece", [(4, 2, 3), (7, 2, 1), (2, 5, 4), (3, 3, 2), (5, 1, 4096)])
def test_series_of_rows(spark, width, hop, piece):
    series = {1: list(range(1, 101)), 2: [7, None, 9, 10, 11], 3: [5]}
    rows = [(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "sensor long, at int, v int").repartition(4)
    out = series_frames(df, "sensor", "at", "v", width, hop, piece)
    assert out.dtypes == [("sensor", "bigint"), ("frame_idx", "bigint"), ("vec", "array<int>")]
    assert got(out) == {k: c for k, v in series.items() if (c := cut(v, width, hop))}


def test_series_over_many_batches(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("pos"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = got(series_frames(df, "key", "pos", "v", 50, 20, 60))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out == {"k": cut([float(i) for i in range(5000)], 50, 20)}


def test_gaps_and_bad_sizes(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 2, 1.0)], "key int, pos int, v double")
    with pytest.raises(Exception, match="positions of a series"):
        series_frames(df, "key", "pos", "v", 2, 1).collect()
    with pytest.raises(ValueError, match="positive"):
        series_frames(df, "key", "pos", "v", 0, 1)
    assert series_frames(df.where("false"), "key", "pos", "v", 2, 1).collect() == []
    assert frame_rows(df.where("false").select("key", F.array("v").alias("v")), "key", "v", 2, 1).collect() == []
