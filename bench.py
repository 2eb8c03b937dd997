"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEATS
(default 3: median of the warm repeats; the slow modelling queries run once).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabscope.catalog import queries as catalog  # noqa: E402

WARM = [
    "profile_lineitem", "profile_approximate_lineitem", "profile_documents", "heuristic_scores_events", "target_ranking_orders",
    "dominance_entropy_lineitem", "monotonicity_orders", "value_counts_events", "sample_exact", "split_stratified",
    "impute_values", "scale_values", "regression_metrics", "suggestion_verdicts", "csv_scan",
]
ONCE = ["permutation_importance", "bakeoff_regression"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tabscope-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.build()

    def timed(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in WARM:
        timed(name)  # warm-up
        seconds[name] = round(statistics.median(timed(name) for _ in range(repeats)), 3)
    for name in ONCE:
        seconds[name] = round(timed(name), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
