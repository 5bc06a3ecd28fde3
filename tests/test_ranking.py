"""Positions and quantiles against plain windows and numpy, with a hot group."""

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from foldstone.operators import ranking as R


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value many copies, one group is null."""
    rows = []
    rng = np.random.default_rng(0)
    for i in range(3000):
        g = "hot" if i % 3 else (f"g{i % 40}" if i % 2 else None)
        v = 1.0 if i % 5 == 0 else float(rng.normal())
        rows.append((i, g, v))
    return spark.createDataFrame(rows, "key int, grp string, v double").cache()


def test_hash_rank_equals_plain_window(skewed):
    want = skewed.withColumn(
        "want", F.row_number().over(Window.partitionBy("grp").orderBy(F.md5(F.concat_ws("|", F.lit("s"), F.col("key").cast("string"))), "key"))
    )
    got = R.hash_rank(skewed, "grp", "key", "s").select("key", "rank")
    joined = want.join(got, "key")
    assert joined.count() == 3000
    assert joined.where("rank <> want").count() == 0


def test_ordered_rank_equals_plain_window(skewed):
    want = skewed.withColumn("want", F.row_number().over(Window.partitionBy("grp").orderBy("v", "key")))
    joined = want.join(R.ordered_rank(skewed, "grp", ["v", "key"]).select("key", "rank"), "key")
    assert joined.count() == 3000
    assert joined.where("rank <> want").count() == 0


def test_running_total_without_group(skewed):
    got = R.running_total(skewed.withColumn("one", F.lit(1)), [], ["key"], "one", "upto")
    assert got.where("upto <> key + 1").count() == 0


def test_quantiles_match_numpy(skewed):
    got = {r["grp"]: r for r in R.exact_quantiles(skewed, "grp", "v", [0.1, 0.5, 0.93], ["a", "b", "c"]).collect()}
    pdf = skewed.toPandas()
    for g, part in pdf.groupby("grp", dropna=False):
        name = None if not isinstance(g, str) else g
        want = np.quantile(part["v"], [0.1, 0.5, 0.93])
        assert np.allclose([got[name][c] for c in "abc"], want)


def test_size_rank_orders_by_size(spark):
    df = spark.createDataFrame([(f"g{i}", i % 7) for i in range(200)], "g string, n int")
    rows = R.size_rank(df, "n", "g").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 201))
    sizes = [r["n"] for r in rows]
    assert sizes == sorted(sizes, reverse=True)


def test_vocabulary_refuses_large(spark):
    with pytest.raises(ValueError):
        R.vocabulary(spark.range(50), "id", limit=10)
