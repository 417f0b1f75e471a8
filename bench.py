"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabstudy.registry import QUERIES  # noqa: E402
from tabstudy.session import local_session  # noqa: E402

HEADLINE = [
    "join_chain", "agg_overview", "agg_duplicates", "agg_cardinality", "agg_describe", "agg_feature_profile", "agg_table1", "mis_pattern", "out_rate", "pla_report",
    "rel_corr", "rel_mi", "rel_dose", "tst_spearman", "tst_kendall", "tst_mannwhitney", "fe_poly", "pre_target_encode", "spl_stratified", "sel_lasso", "mdl_ols", "mdl_train_all",
    "ev_regression", "ev_auc", "ev_boot", "ev_decision", "ex_perm",
]
RUNS = 3


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    run(spark, folder, "agg_describe")  # start the JVM's and Python's workers outside the timings
    times = {name: round(statistics.median(run(spark, folder, name) for _ in range(RUNS)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
