"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foldstone.catalog import QUERIES  # noqa: E402
from foldstone.session import build_session  # noqa: E402

HEADLINE = (
    "flagship eval_03 eval_04 stat_01 stat_02 stat_06 spl_01 spl_02 spl_06 agg_05 agg_06 agg_09 agg_10 agg_11 "
    "agg_14 agg_16 win_01 win_03 win_06 nrm_02 emb_04 fea_04 fea_05 mdl_06 mdl_08 mdl_13 diag_01 diag_03 "
    "prj_01 src_04 aud_01 fea_06"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    only = sys.argv[1:]
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{
            "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # one untimed run starts the executors' Python and the code caches
    QUERIES["flagship"](spark, sf_dir).collect()
    took = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
        if only:
            print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }))


if __name__ == "__main__":
    main()
