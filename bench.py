"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is forced to completion with the ``noop`` sink (no collect).  Queries that would start
after $BENCH_BUDGET_SEC seconds are skipped and reported as null, so the bench always ends.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from covista.plans.registry import QUERIES  # noqa: E402
from covista.runtime import local_session  # noqa: E402

HEADLINE = ["sku_pairs", "pair_stats", "joint_potential_daily_min", "pmi_edges_cut",
            "community_label_propagation", "community_louvain"]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    budget = float(os.environ.get("BENCH_BUDGET_SEC", "1500"))
    spark = local_session(cpus)
    # untimed warm-up: JVM class loading and code generation are not query time
    spark.range(1 << 16).selectExpr("sum(id)", "count(distinct id % 97)").collect()
    times = {}
    start = time.time()
    for name in HEADLINE:
        if time.time() - start > budget:
            times[name] = None
            continue
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    done = [v for v in times.values() if v is not None]
    sf_val = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(done), 3), "unit": "sec",
                      "queries": times, "sf": sf_val, "cpus": cpus}))


if __name__ == "__main__":
    main()
