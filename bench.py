"""Time the headline queries and print one JSON line.

Each query is run cold (first run in the session, the shared company table
already built) and warm; the warm time is reported per query, the cold sum is
kept beside it.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from firmlens.catalog import REGISTRY
from firmlens.sources.company import cached_company

HEADLINE = [
    "it_gap_by_employee_scale", "process_companies", "describe_table", "describe_by_cluster", "cap_outliers",
    "correlation_matrix", "calculate_indicators", "engineer_features", "classify_anomalies", "cluster_vs_rest",
    "analyze_clusters", "build_personas", "chi_square_all", "anova", "preprocess", "robust_scale", "vif_prune",
    "pca_projection", "silhouette", "davies_bouldin", "adjusted_rand", "tfidf_descriptions", "tfidf_documents",
    "kmeans", "k_sweep", "gmm_bic", "dbscan", "kmedoids_gower", "hierarchical_segments", "two_tier",
    "logistic_drivers", "linear_analysis", "forest_importance", "run_full", "kfold_accuracy", "kmeans_of_vectors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("firmlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ["BENCH_ONLY"].split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    start = time.perf_counter()
    rows = cached_company(spark, sf_dir).count()
    times = {"company_table_cold": round(time.perf_counter() - start, 3)}
    cold = 0.0
    for name in names:
        for attempt in ("cold", "warm"):
            start = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt == "cold":
                cold += took
                # Long fits are timed once.
                if took > 20:
                    break
        times[name] = round(took, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total headline query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "cold_total": round(cold, 3), "sf": os.path.basename(sf_dir.rstrip("/")), "companies": rows, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
