"""Times headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is built and written to the no-op sink; the first round warms the session up and the
value reported is the median of the following ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from tapeloom.catalog import all_queries
from tapeloom.plans.stage import clear

HEADLINE = (
    "B1_time_bars", "B2_volume_bars", "B4_resample_last_filled", "B6_ofi_bars", "C2_order_flow_imbalance",
    "C3_effective_spread", "C6_trade_size_distribution", "D3_top_of_book", "D4_book_at", "D8_queue_position",
    "E1_ma_crossover", "E2_bollinger", "E3_ofi_mean_reversion", "F1_run_backtest", "F2_trade_log", "F6_walk_forward",
    "F8_ledger", "G10_summarize", "G14_bootstrap_sharpe_ci", "G16_newey_west_sharpe", "H9_findings", "I5_build_features",
    "I7_micro_features", "I10_triple_barrier", "J2_ridge_regression", "J4_mlp", "J5_boosted_trees", "J7_walkforward_fit", "J8_classification_metrics",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = all_queries()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and not any(name.startswith(p) for p in only):
            continue
        taken = []
        for _ in range(rounds + 1):
            start = time.perf_counter()
            known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            clear(spark)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name}: {[round(t, 2) for t in taken]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
