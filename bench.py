"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from burnish.plans import registry  # noqa: E402

HEADLINE = (
    "profile_missing",
    "profile_numeric",
    "profile_quartiles",
    "profile_distinct",
    "profile",
    "table_summary",
    "duplicate_count",
    "top_values",
    "infer_kinds",
    "remove_duplicates",
    "remove_duplicate_documents",
    "drop_missing",
    "fill_mean",
    "fill_median",
    "fill_mode",
    "str_title",
    "remove_outliers",
    "recipe_replay",
    "apply_edits",
    "grid_search",
    "grid_page_sorted",
    "chart_histogram",
    "chart_box",
    "correlation_matrix",
    "roc_curve",
    "metrics_classification",
    "ml_linear",
    "ml_logistic",
    "ml_tree_reg",
    "ml_knn_reg",
    "ml_naive_bayes",
    "export_csv",
)
RUNS = 2


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        spark.catalog.clearCache()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_time", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
