"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and executed to completion with the ``noop`` sink (every row
computed, nothing collected to the driver). Per-query time is the median of
``$BENCH_RUNS`` runs (default 1) after one warm-up run of the flagship on the smallest
tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stocktake.plans import scenario  # noqa: E402
from stocktake.plans.queries import QUERIES  # noqa: E402
from stocktake.session import build_session  # noqa: E402

HEADLINE = [
    "inventory_summary", "raw_job", "raw_cluster", "raw_tables",
    "flatten_props", "flatten_nested_orders", "flatten_long_leaves", "array_positions", "json_keep_list",
    "safe_names", "page_cap", "page_prefix", "page_complete", "page_unnest", "page_fallback", "page_object",
    "page_scalars", "child_rows", "hierarchy_counts", "allowlist_topn", "topn_per_group", "type_counts",
    "merge_counts", "name_patterns", "grand_totals", "snapshot_diff", "evolve_append", "stream_equals_batch",
    "stream_inventory_summary", "stream_raw_tables", "stream_retype", "names_over_runs", "retype_large_ints", "object_history",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    t0 = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    # warm-up on the smallest tables: JIT and class loading for every code path of the flagship;
    # the landing that plays the API's pages is input, so it is written before the clock starts
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    run_once(spark, "inventory_summary", warm_dir if os.path.isdir(warm_dir) else sf_dir)
    scenario.landing(spark, sf_dir)
    times = {}
    for name in only:
        samples = [run_once(spark, name, sf_dir) for _ in range(runs)]
        times[name] = round(statistics.median(samples), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
