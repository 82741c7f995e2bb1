"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (all rows computed,
nothing collected to the driver).  The one-time load -- deriving the
registry, writing the partitioned feature history and its as-of index -- is timed
as ``load`` and counted in the total.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "pit_lookup", "pit_asof_join", "pit_asof_wide", "sliding_stats", "upsert_last_wins",
    "online_replay", "purchase_count_7d", "session_duration", "latency_summary", "hourly_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "2"))
    from chronoframe.plans.catalog import QUERIES
    from chronoframe.plans.context import Tables
    from chronoframe.session import build_session

    spark = build_session(f"local[{cpus}]", app="chronoframe-bench",
                          shuffle_partitions=int(cpus) * 2,
                          extra={"spark.ui.showConsoleProgress": "false",
                                 "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    t0 = time.time()
    t = Tables(spark, sf_dir)
    t.registry.count()
    t.values.count()
    t.asof_index
    from chronoframe.plans.catalog import warm_snapshot
    warm_snapshot(t).count()
    load = time.time() - t0

    timings = {}
    rows = {}
    for name in HEADLINE:
        best = None
        for _ in range(reps):
            s = time.time()
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            el = time.time() - s
            best = el if best is None else min(best, el)
        timings[name] = round(best, 3)
        rows[name] = QUERIES[name](spark, sf_dir).count()
    n_values = t.values.count()
    total = round(sum(timings.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_and_load_total",
        "value": round(total + load, 3),
        "unit": "sec",
        "queries": timings,
        "load_sec": round(load, 3),
        "rows": rows,
        "history_rows": n_values,
        "history_rows_per_sec_pit": round(n_values / timings["pit_lookup"], 1),
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
