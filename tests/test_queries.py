"""Registered queries against DuckDB on the smallest tables."""

import __spark_entry__ as entry
import pytest
from check import connect, differences

SF = "/root/testdata/sf0.001"
NAMES = [
    "a02_validate_normalized", "a04_read_zeek_conn", "a10_read_binetflow", "c03_flow_ordering", "d22_extract_features",
    "d22_extract_features_sliced", "e10_rule_score", "f07_detect_zscore", "f09_local_outlier_factor", "g12_threshold_evaluation",
    "b03_alerts_table", "j11_multi_seed_rules", "j17_evidence_summary", "l01_bidir_dataset", "l06_native_split", "l19_distribution_summary",
    "n01_report_coverage",
]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, duck.execute(entry.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 130
