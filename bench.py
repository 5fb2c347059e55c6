"""Headline queries over whole tables; prints one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import checks.all  # noqa: E402,F401
from checks.compare import session  # noqa: E402
from checks.registry import QUERIES  # noqa: E402

HEADLINE = [
    "b1_basic_info", "b12_column_views", "c1_missing_by_column", "c5_missing_cooccurrence",
    "d1_numeric_summary", "d4_distribution_class", "d5_drop_candidates", "d7_redundant_098", "e2_top5_categories",
    "f2_feature_similarity", "f5_target_spearman", "f7_cat_impact_classification", "g6_bivariate_classification",
    "h3_tokenize", "h6_text_quality", "h7_duplicate_text_ratio", "i8_drift_report", "j6_ts_summary_hourly",
    "j8_kpss_test_daily", "j10_seasonal_decompose_daily", "j11_acf_daily", "j13_missing_timestamps_hourly",
    "k2_leakage_checks", "k3_duplicate_rows", "k18_anomaly_summary", "l10_tfidf_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    QUERIES["b3_integer_valued"](spark, folder).collect()  # start-up is not measured
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
