"""Registered queries against their SQL twins.

A spread over all families by default; FOLDSTONE_ALL=1 runs every one.
"""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_module  # noqa: E402
from check_oracle import TABLES, compare  # noqa: E402
from foldstone.catalog import ORACLES, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
SOME = (
    "flagship eval_03 eval_04 eval_10 stat_03 spl_01 spl_02 spl_05 jn_01 jn_06 agg_02 agg_05 agg_06 agg_09 agg_11 "
    "win_01 win_04 win_06 srt_03 set_05 prj_01 prj_05 prj_07 fn_02 fn_06 src_02 src_04 src_14 aud_01 nrm_02 emb_04 fea_04 "
    "mdl_06 mdl_08 mdl_14 trf_05 augm_01 augm_04 diag_03 str_03 udf_07"
).split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("FOLDSTONE_ALL") else SOME)
def test_query_equals_sql(spark, con, name):
    status, _, _, text = compare(spark, con, name, DIR)
    assert status in ("ok", "EMPTY"), text


#: Without a twin and with many fits or extractions; run with FOLDSTONE_ALL=1.
LONG = ("mdl_01 mdl_02 mdl_03 mdl_04 mdl_05 mdl_07 mdl_09 mdl_11 mdl_15 mdl_16 trf_02 trf_04 trf_07 trf_09_nested merged_read diag_11 diag_12 "
        "udf_02 udf_04 udf_05 fea_06 fea_07").split()


@pytest.mark.parametrize("name", [n for n in sorted(set(QUERIES) - set(ORACLES)) if os.environ.get("FOLDSTONE_ALL") or n not in LONG])
def test_query_without_twin_has_rows(spark, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    row = entry_module.entry(spark).first()
    assert row["n"] == 500 and 0 < row["macro_f1"] < 1


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    # an optional subpackage may add more
    assert entry_module.queries().keys() >= QUERIES.keys()
    assert entry_module.oracle_sql().keys() >= ORACLES.keys()
    assert entry_module.oracle_sql().keys() <= entry_module.queries().keys()
