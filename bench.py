"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the threads, ``BENCH_RUNS`` the warm
runs per query (the median counts), ``BENCH_ONLY`` a comma list of names.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.queries import QUERIES
from riskloom.session import local_session

HEADLINE = [
    "p_coerce_numeric", "a_null_profile", "a_duplicate_rows", "a_describe", "a_distribution_stats", "a_quantiles",
    "a_skewness", "a_ols_by_group", "a_box_stats", "a_histogram", "f_standard_scale", "f_one_hot", "f_label_encode",
    "f_outlier_detect", "f_outlier_cap", "f_outlier_cap_stats", "f_log_transform", "f_impute_median", "f_clean_data",
    "f_quantile_bin", "f_mutual_info", "f_mutual_info_binned", "f_chi2", "l_preprocess_preset", "m_split_random",
    "m_split_stratified", "m_fold_assign", "m_metrics", "m_smote", "f_rf_importance",
]
# Fits of all three models take most of a minute, so one cold run stands for them.
ONCE = ["m_evaluate", "m_cross_validate"]


def seconds(name: str, spark, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(cpus)
    times = {}
    for name in only or HEADLINE + ONCE:
        if name not in ONCE:
            seconds(name, spark, folder)
        taken = [seconds(name, spark, folder) for _ in range(1 if name in ONCE else runs)]
        times[name] = round(statistics.median(taken), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, warm median", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
