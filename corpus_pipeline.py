"""A corpus pipeline over ``documents``: each stage calls one operator and hands on what it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is stored
as Parquet and read again before the next one. All but the last return the
columns of ``documents``.

Defined results. Null or empty text, or one without a letter: its language is
not recognised and the row goes. Repeated rows are near copies: one stays, as
of texts that tie; different texts with one ``doc_id`` both stay, and so do
different texts without one. Null source: a source of its own in the mix. Very
long texts are read whole by every stage. Extra columns pass unchanged to the
last stage, which states its own columns. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldstone.llm import langid, mixing, near_copies, piece_fst, secret_scan
from foldstone.session import materialise


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go."""
    return langid.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more, checked exactly."""
    return near_copies.deduplicated(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets that look live are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left, and whether they decode to its text."""
    # half the words kept: workers stand beside the heaps that the stages before have filled
    return piece_fst.coded(docs, room=piece_fst.CACHE // 2)


STAGES = [
    ("language", keep_languages),
    ("near copies", drop_near_copies),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Rounding draws and learned models have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
