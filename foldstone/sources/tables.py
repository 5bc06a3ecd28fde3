"""Stored tables: indexes, folds, results, tensors, keyed materialisations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import FOLDS_COLUMNS, INDEX_COLUMNS, RESULTS_COLUMNS, SOURCES

_INTS = {"actor", "label", "label_idx", "fold"}

INDEX_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c in _INTS else T.StringType()) for c in INDEX_COLUMNS]
)
FOLDS_SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c in _INTS else T.StringType()) for c in FOLDS_COLUMNS]
)
RESULTS_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("accuracy", "macro_f1") else T.StringType()) for c in RESULTS_COLUMNS]
)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on the file system it names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(hadoop) and files.getFileStatus(hadoop).isDirectory()


def write_csv(df: DataFrame, path: str, force: bool = False) -> None:
    """CSV with header and LF lines."""
    df.write.mode("overwrite" if force else "errorifexists").option("header", True).option(
        "lineSep", "\n"
    ).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV by declared types, so that a code such as 01 stays a string."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.option("header", True).schema(schema).csv(path)


def write_index(index: DataFrame, path: str, force: bool = True) -> None:
    write_csv(index.select(*INDEX_COLUMNS), path, force)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The stored index plus ``source_order``, the declared place of its source."""
    order = F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int")
    return read_csv(spark, path, INDEX_SCHEMA).withColumn("source_order", order)


def with_side_table(df: DataFrame, side: DataFrame, key: str, value: str, default: str = "unknown") -> DataFrame:
    """Attribute from a side table keyed like ``df``; missing keys get a default."""
    return df.join(side.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def side_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A side CSV, or an empty table when the file is absent."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path)


def new_rows(df: DataFrame, manifest: DataFrame, key) -> DataFrame:
    """Rows whose key is not in the manifest: the work that is left."""
    return df.join(manifest, key, "left_anti")


def write_folds(folds: DataFrame, path: str, force: bool = False) -> None:
    """Freeze a fold table: refuses to replace one unless forced."""
    folds.write.mode("overwrite" if force else "errorifexists").partitionBy("protocol").parquet(path)


def read_folds(spark: SparkSession, path: str, key: T.DataType | None = None, name: str = "filename") -> DataFrame:
    if not exists(spark, path):
        raise FileNotFoundError(f"no fold table at {path}")
    schema = T.StructType(
        [T.StructField("protocol", T.StringType()), T.StructField("fold", T.IntegerType()),
         T.StructField(name, key or T.StringType()), T.StructField("split", T.StringType())]
    )
    return spark.read.schema(schema).parquet(path).select("protocol", "fold", name, "split")


def cached_by_hash(
    df: DataFrame, root: str, config_hash: str, key: str, build: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """``build(df)`` stored under the config hash and reused for the same keys.

    A hit needs the same key set on both sides: anti-joins each way are empty.
    """
    spark = df.sparkSession
    path = f"{root}/hash={config_hash}"
    if exists(spark, path):
        stored = spark.read.parquet(path)
        wanted = df.select(key)
        missing = wanted.join(stored, key, "left_anti").limit(1).count()
        extra = stored.select(key).join(wanted, key, "left_anti").limit(1).count()
        if not missing and not extra:
            return stored
    build(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_results(rows: DataFrame, path: str) -> None:
    """Append log rows; writers add own files, so they never clobber."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA])
    typed.write.mode("append").parquet(path)


def write_batch(rows: DataFrame, path: str, number: int) -> None:
    """The log rows of one numbered batch; writing it again replaces it."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS_SCHEMA])
    typed.write.mode("overwrite").parquet(f"{path}/batch={number}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESULTS_SCHEMA).parquet(path).select(*RESULTS_SCHEMA.fieldNames())


def write_guarded(df: DataFrame, joined: DataFrame, path: str) -> None:
    """Store a join result only if it kept the row count."""
    before, after = df.count(), joined.count()
    if before != after:
        raise ValueError(f"the join changed the row count: {before} in, {after} out")
    joined.write.mode("overwrite").parquet(path)


def write_result_table(df: DataFrame, path: str) -> None:
    """Experiment table; ``fold`` is text because it can be 'pooled'."""
    out = df.withColumn("fold", F.col("fold").cast("string")) if "fold" in df.columns else df
    out.write.mode("overwrite").parquet(path)


def write_tensor(tensor: DataFrame, path: str) -> None:
    """All layers in one store; a layer choice later prunes partitions."""
    tensor.write.mode("overwrite").partitionBy("layer").parquet(path)


def read_tensor(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
