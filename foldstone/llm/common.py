"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words and white space as the operators of this subpackage see them.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once inside a larger expression."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str) -> Column:
    """A text column with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def key_of(column: str) -> Column:
    """A never-null sort key: code point order of the value, null last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(column).cast("string")), F.lit("1"))


def fold_of(column: str, buckets: int) -> Column:
    """crc32 of the column as text, modulo ``buckets``; a null counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def documents(spark, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
