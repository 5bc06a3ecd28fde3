import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use inside must not clash
    T.StructField("key", T.StringType()), T.StructField("size", T.StringType()), T.StructField("rank", T.StringType()),
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table with clashing extra columns from (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "k", "s", "r") for i, t, lang, src in rows]
        return spark.createDataFrame(full, DOCS)

    return make


def by_id(rows, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in rows}
