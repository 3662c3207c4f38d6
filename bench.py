"""Bench: run headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query is fully materialised through the ``noop`` sink (no collect to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabflow.plans.registry import load_all  # noqa: E402
from tabflow.session import build_session  # noqa: E402

HEADLINE = ["dq_issues_orders", "dataset_profile", "numeric_stats", "distinct_counts", "correlation_matrix",
            "five_number", "histogram_equal_width", "top_categories", "text_top_tokens", "cleaner_fit_transform",
            "ffill_bfill", "lag_features", "rolling_mean", "split_random", "kfold", "split_stratified3",
            "tfidf_weights", "m_roc_auc", "m_roc_multiclass", "m_regression", "fc_seasonal_naive", "fc_ar_diff",
            "leaderboard", "latest_per_key", "duplicate_rows", "knn_exact"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="tabflow-bench", shuffle_partitions=int(cpus) * 2,
                          driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
    queries, _ = load_all()
    names = [n for n in HEADLINE if n in queries]
    if len(sys.argv) > 1:
        names = [n for n in names if any(p in n for p in sys.argv[1:])]
    times = {}
    for name in names:
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
