"""Time the headline queries, warm, and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores, BENCH_QUERIES a comma-separated choice.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "column_profile_lineitem", "column_profile_documents", "duplicate_rows", "text_consistency", "numeric_summary",
    "categorical_summary", "outlier_table", "isolation_forest", "pearson_matrix", "spearman_matrix", "kendall_matrix",
    "anova_test", "chi_square_test", "distribution_shifts_lineitem", "row_overlap", "date_summary", "weekday_counts",
    "word_counts", "top_bigrams", "health_score_orders", "clean_table", "label_code_feature", "stratified_folds",
    "rank_anova", "rank_information", "classification_metrics", "roc_auc", "regression_metrics", "kernel_density",
    "normal_quantiles", "box_stats", "scale_robust", "linear_regression", "nearest_vectors", "silhouette_squared",
    "series_differences", "violin", "encode_many_levels", "cross_validated_scores", "density_clusters", "k_means_clusters",
]


def main() -> None:
    shared = tempfile.mkdtemp(prefix="bench-")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from colscope.plans.catalog import QUERIES

    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    times = {}
    for name in names:
        best = None
        for _ in range(2):  # the first run warms the code paths
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = time.perf_counter() - start
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, warm", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
