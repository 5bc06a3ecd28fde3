"""Registry of runnable queries, and the inputs they derive from the tables.

Each query has a Spark callable and, where SQL can say it, the same result as
DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import with_synthetic_predictions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENT_LABELS = ["click", "error", "purchase", "signup", "view"]
HIGH_EVENTS = ["error", "purchase"]


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame and its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show."""
    columns = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            columns.append((F.round(F.col(name).cast("double"), digits) + F.lit(0.0)).alias(name))
        elif kind in ("array<double>", "array<float>"):
            columns.append(F.transform(name, lambda x: F.round(x.cast("double"), digits) + F.lit(0.0)).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def rounded(sql: str, *names: str, digits: int = 6) -> str:
    """The SQL twin of :func:`tidy` for the named columns."""
    parts = ", ".join(f"round({n}, {digits}) + 0e0 AS {n}" for n in names)
    at = sql.rstrip().rstrip(";")
    return f"SELECT * REPLACE ({parts}) FROM ({at}) AS _t"


def h(*parts: str) -> str:
    """SQL of the 32-bit key hash; string literals go in quoted."""
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 8))::BIGINT"


def h60(*parts: str) -> str:
    """SQL of the 60-bit key hash."""
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {text})), 1, 15))::BIGINT"


def m(*parts: str) -> str:
    """SQL of the key digest."""
    text = ", ".join(f"({p})::VARCHAR" for p in parts)
    return f"md5(concat_ws('|', {text}))"


# ------------------------------------------------------------ derived inputs

OBS = (
    "obs AS (SELECT event_id AS key, user_id AS grp, event_type AS label, "
    "day(ts) <= 15 AS early, value AS x, ts FROM events)"
)


def obs(spark, d) -> DataFrame:
    """Observations: events with group, label, a half-month attribute, a value."""
    return read(spark, d, "events").select(
        F.col("event_id").alias("key"), F.col("user_id").alias("grp"), F.col("event_type").alias("label"),
        (F.dayofmonth("ts") <= 15).alias("early"), F.col("value").alias("x"), "ts",
    )


_NAMES = "['click', 'error', 'purchase', 'signup', 'view']"
PRED = f"""{OBS},
pred AS (SELECT *, label AS y_true,
    CASE WHEN {h("'a'", 'key')} % 10 < 7 THEN label ELSE {_NAMES}[{h("'c'", 'key')} % 5 + 1] END AS y_pred,
    CASE WHEN {h("'b'", 'key')} % 10 < 5 THEN label ELSE {_NAMES}[{h("'c'", 'key')} % 5 + 1] END AS y_pred_b
  FROM obs)"""


def pred(spark, d) -> DataFrame:
    """Observations with two deterministic prediction columns."""
    a = with_synthetic_predictions(obs(spark, d), "label", "key", EVENT_LABELS, 7, "a")
    b = with_synthetic_predictions(
        a.withColumnRenamed("y_pred", "_a"), "label", "key", EVENT_LABELS, 5, "b"
    )
    return b.withColumnRenamed("y_pred", "y_pred_b").withColumnRenamed("_a", "y_pred")


VECS = "vecs AS (SELECT vec_id AS key, vec_id % 24 AS grp, label, embedding::DOUBLE[] AS vec FROM embeddings)"


def vecs(spark, d) -> DataFrame:
    """Vectors with a derived group of 24 levels."""
    return read(spark, d, "embeddings").select(
        F.col("vec_id").alias("key"), (F.col("vec_id") % 24).alias("grp"), "label",
        F.col("embedding").cast("array<double>").alias("vec"),
    )


DOCS = (
    "docs AS (SELECT d.doc_id AS key, d.source, d.lang, d.n_chars, "
    "l.quality AS label, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)


def docs(spark, d) -> DataFrame:
    """Documents with source, language and, where labelled, quality."""
    return (
        read(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
        .join(read(spark, d, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("key"), "source", "lang", "n_chars", F.col("quality").alias("label"), "toxic")
    )


def score_sql(src: str, by: str = "") -> str:
    """Scores of a (by, y_true, y_pred, n) relation, one row per ``by``."""
    b = f"{by}, " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT {b}sum(support)::BIGINT AS n, sum(hits) / sum(support)::DOUBLE AS accuracy,
        avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
        count(*) FILTER (WHERE support > 0) AS n_classes,
        avg(f1) FILTER (WHERE support > 0) AS macro_f1_present
      FROM (SELECT {b}label, sum(s) AS support, sum(p) AS predicted, sum(t) AS hits,
              CASE WHEN sum(s) + sum(p) > 0 THEN 2e0 * sum(t) / (sum(s) + sum(p)) ELSE 0e0 END AS f1
            FROM (SELECT {b}y_true AS label, n AS s, 0 AS p, CASE WHEN y_true = y_pred THEN n ELSE 0 END AS t FROM {src}
                  UNION ALL SELECT {b}y_pred, 0, n, 0 FROM {src}) AS _u
            GROUP BY {b}label) AS _c {g}"""


def snake_sql(src: str, group: str, k: int) -> str:
    """(group, fold) by size, dealt back and forth."""
    step = f"(row_number() OVER (ORDER BY n DESC, md5({group}::VARCHAR), {group}) - 1) % {2 * k}"
    return f"""SELECT {group}, CASE WHEN s < {k} THEN s ELSE {2 * k - 1} - s END AS fold FROM (
        SELECT {group}, {step} AS s FROM (SELECT {group}, count(*) AS n FROM {src} GROUP BY {group}) AS _g) AS _r"""
