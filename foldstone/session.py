"""Session settings and scratch tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings this package is written for. AQE picks broadcast joins from the
#: measured size of a side and splits skewed join partitions at run time, so
#: no operator forces a broadcast of data that can grow.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

_own_scratch: dict[str, str] = {}


def build_session(master: str, name: str = "foldstone", **conf: str) -> SparkSession:
    """Start a session with :data:`SETTINGS` and any extra ``conf``."""
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; on one machine an own folder, removed at the end, where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return _own_scratch[app]


def scratch_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/foldstone/{label}-{uuid.uuid4().hex}"


def settle(stats: DataFrame) -> DataFrame:
    """Store a reduced table (one row per group) before it is joined back.

    Its true size is then known when the join is planned: within Spark's
    broadcast threshold the rows it meets are not shuffled at all; beyond it
    the join is a shuffle join whose skewed partitions AQE splits.
    """
    return materialise(stats, "stats")


def materialise(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The written files outlive any executor, so a lost task re-reads them
    instead of recomputing a plan whose row placement might differ.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
