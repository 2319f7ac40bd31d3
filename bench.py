"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

# Jobs that read the raw tables come first; the detectors after them read the feature table, which
# `features_to_table` computes and writes once.
NAMES = [
    "c02_build_operational_flows",
    "d22_extract_features",
    "h01_score_job",
    "a01_read_normalized",
    "a04_read_zeek_conn",
    "a05_read_netflow_ipfix",
    "a10_read_binetflow",
    "l04_native_features",
    "l06_native_split",
    "features_to_table",
    "e10_rule_score",
    "b03_alerts_table",
    "f07_detect_zscore",
    "f09_local_outlier_factor",
    "f10_isolation_forest",
    "g03_random_forest_fit",
    "g05_supervised_scoring",
    "g12_threshold_evaluation",
    "j11_multi_seed_rules",
    "j12_threshold_sweep",
    "j17_evidence_summary",
    "l01_bidir_dataset",
    "l14_scenario_rollup",
    "l19_distribution_summary",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tidewatch.plans import common, registry
    from tidewatch.session import tune

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    queries = dict(registry.QUERIES)
    queries["features_to_table"] = common.feature_table
    # start Spark and the Python workers outside the clock
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in sys.argv[1:] or NAMES:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
