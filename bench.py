"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, after one warm-up (default 2; the median counts)
BENCH_QUERIES  names to run instead of the headline ones, or "all"
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from trialspark.plans.catalog import QUERIES
from trialspark.session import build

HEADLINE = """
run_summary run_trials task_summary run_task_groups run_task_rollup check_report verdict showcase_trial recent_runs
runs_left_trials trial_status trial_detail loop_guard stop_reason step_cap token_budget watchdog running_peak replay_timeline
leaf_changes tamper_filter baseline_diff restore_before_delete log_growth config_merge dead_workers orphan_jobs
region_revenue top_spender shop_join native_tool_calls text_tool_calls truncate_middle strip_text task_catalog
live_status stream_loop_guard tumbling_activity lifecycle_upsert
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split() or HEADLINE
    spark = build("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for n in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if n:  # the first run warms up
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "sum of median seconds per query", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(scale.group(1)) if scale else None, "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
