"""Run registered queries against their SQL twins.

    python tools/check_oracle.py [--dir SF_DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from foldstone.catalog import ORACLES, QUERIES  # noqa: E402
from foldstone.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in ORACLES:
        return ("rows", len(got), took, "") if got else ("EMPTY", 0, took, "")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        lost = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return "DIFF", len(got), took, f"{len(got)} vs {len(want)} rows\n     spark {extra}\n     sql   {lost}"
    return "ok" if got else "EMPTY", len(got), took, ""


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--trace", action="store_true")
    args = parser.parse_args()
    spark = build_session(
        "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.dir}/{t}.parquet')")
    wanted = [n for n in QUERIES if not args.names or any(n == a or n.startswith(a) for a in args.names)]
    bad = 0
    for name in wanted:
        try:
            status, n, took, text = compare(spark, con, name, args.dir)
        except Exception as error:  # report and go on
            if args.trace:
                raise
            status, n, took, text = "ERROR", 0, 0.0, f"{type(error).__name__}: {str(error)[:900]}"
        bad += status in ("DIFF", "ERROR", "COLUMNS", "EMPTY")
        print(f"{name:<10} {status:<8} {n:>7} rows {took:6.2f}s {text}", flush=True)
    print(f"{len(wanted)} queries, {bad} bad")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
