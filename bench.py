"""Benchmark of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and
cores; BENCH_QUERIES limits the run to some names. Each query is built and fully evaluated
(``noop`` sink) once to warm up and then BENCH_RUNS times; the median of these is reported.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gristmill.plans.session import local_session
from gristmill.queries import QUERIES

HEADLINE = [
    "q_filter_gt", "q_dedup_subset_first", "q_dedup_drop_all", "q_fill_median", "q_fill_mode", "q_fill_ffill",
    "q_cast_numeric", "q_validate_cast", "q_add_column_divide", "q_fix_formula", "q_replace_values",
    "q_trim_outliers_iqr", "q_detect_outliers", "q_outlier_summary", "q_cap_outliers", "q_transform_log",
    "q_scale_zscore", "q_clean_title", "q_extract_datetime", "q_encode_label", "q_encode_onehot", "q_inspect",
    "q_describe_numeric", "q_describe_text", "q_corr_pearson", "q_corr_spearman", "q_corr_kendall", "q_cramers_v",
    "q_distribution_bins", "q_value_counts", "q_crosstab", "q_missing_by_column", "q_co_null_pairs",
    "q_pairwise_points", "q_bar_sum", "q_bar_grouped", "q_line", "q_scatter_color", "q_pie", "q_history_window",
    "q_ml_split", "q_regression_metrics", "q_classification_metrics_weighted", "q_knn", "q_dbscan_core",
    "q_activity_rollup", "q_roundtrip_parquet", "q_load_csv", "q_line_all", "q_silhouette_squared",
    "q_ml_train_linear", "q_ml_train_logistic", "q_ml_train_kmeans",
]


def run(spark, name: str, sf: str) -> float:
    started = time.monotonic()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.monotonic() - started


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, 8, "16g")
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        try:
            cold = run(spark, name, sf)
            again = [run(spark, name, sf) for _ in range(runs)]
            times[name] = round(statistics.median(again), 3)
            print(f"{name} cold {cold:.2f} warm {times[name]:.2f}", file=sys.stderr, flush=True)
        except Exception as problem:
            print(f"{name} failed: {str(problem)[:300]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    result = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
