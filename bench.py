"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query runs to completion through Spark's ``noop`` sink (the whole plan
executes, nothing is collected to the driver); median of $BENCH_REPS runs
after a JIT warm-up pass over the same queries at $BENCH_WARMUP_DIR
(default sf0.001).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "iqr_clip_monthly", "descriptive_stats", "monthly_boxplot", "missing_counts",
    "interpolate_both", "fill_categorical", "lag1_gap", "acf_40",
    "pearson_matrix", "spearman_matrix", "normality_k2", "breakpoint_stats",
    "vif_3var", "ols_subsets", "durbin_watson",
    "baseline_random", "baseline_year", "baseline_blocked", "baseline_monthly",
    "risk_metrics", "risk_topk", "decision_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from qualityspark.session import get_spark
    from qualityspark.plans import catalog

    spark = get_spark(f"local[{cpus}]", int(cpus) * 2, app_name="qualityspark-bench")
    qs = catalog.queries()
    # warm-up (JIT / codegen of every measured code path) on the smallest scale,
    # then one more query at the measured scale for its parquet footers
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm) and warm != sf_dir:
        for name in only or HEADLINE:
            qs[name](spark, warm).write.format("noop").mode("overwrite").save()
    qs["missing_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
