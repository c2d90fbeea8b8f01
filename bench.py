"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is run to completion into a
sink that discards rows; the first run warms the JVM and the median of the next three counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "feature_table",
    "feature_table_with_signals",
    "halo_chunks_on_full_grid",
    "demand_lags",
    "spike_flags",
    "pivot_demand",
    "pivot_fuel_daily",
    "fill_hours",
    "news_rollup_24h",
    "risk_index",
    "scores_by_area",
    "pinball_by_quantile",
    "diebold_mariano",
    "wilcoxon_signed_rank",
    "quantile_forecast",
    "insert_ignore",
    "keep_first_row",
    "demand_audit",
    "dedupe_articles",
    "tag_articles",
    "seasonal_decomposition",
    "round_consensus",
    "model_frame_c",
    "merge_into_table",
    "stream_rounds",
    "asof_prices",
    "rolling_scores",
]


def main() -> None:
    from wattline.catalog import load

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wattline-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds: dict[str, float] = {}
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    for name in HEADLINE:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i or runs == 0:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
