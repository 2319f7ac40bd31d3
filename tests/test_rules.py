import pytest
from tidewatch.operators import rules as rl
from tidewatch.operators import scoring as sc
from tidewatch.schema import BASELINE_RULES, FEATURES

SCHEMA = (
    "src_ip string, dst_ip string, dst_port int, protocol string, direction string, event_count bigint, "
    "flow_duration_seconds double, mean_interarrival_seconds double, inter_arrival_cv double, "
    "interarrival_iqr_seconds double, size_cv double, burst_count bigint, avg_burst_size double, "
    "avg_sleep_duration_seconds double, burst_to_idle_ratio double"
)


def row(spark, n, dur, mean, cv, iqr, size_cv, bursts=0, burst_size=None, sleep=None, ratio=None):
    d = spark.createDataFrame(
        [("a", "b", 443, "tcp", "->", n, dur, mean, cv, iqr, size_cv, bursts, burst_size, sleep, ratio)], SCHEMA
    )
    return rl.detect_rules(d, BASELINE_RULES).first()


def fired(r):
    return [c["rule_name"] for c in r["contributions"] if c["fired"] and c["score"] > 0]


def test_short_irregular_flow_is_benign(spark):
    assert row(spark, 6, 420.0, 84.0, 0.25, 35.0, 0.18)["predicted_label"] == "benign"


def test_long_low_rate_flow_is_beacon(spark):
    r = row(spark, 18, 960.0, 56.0, 0.47, 50.0, 0.40)
    assert r["predicted_label"] == "beacon" and "long_low_rate_repetition" in fired(r)


def test_weak_bursts_are_benign(spark):
    assert row(spark, 8, 230.0, 33.0, 1.4, 63.0, 0.44, 2, 3.5, 100.0, 0.12)["predicted_label"] == "benign"


def test_gate(spark):
    r = row(spark, 4, 960.0, 56.0, 0.01, 0.1, 0.0)
    assert r["score"] == 0 and len(r["contributions"]) == 1
    assert r["contributions"][0]["reason"] == "event_count 4 is below minimum 5"


def test_all_rules_sum_exactly(spark):
    r = row(spark, 20, 1200.0, 60.0, 0.05, 1.0, 0.01, 3, 4.0, 200.0, 0.1)
    assert len(fired(r)) == 8 and r["score"] == 8.3
    assert r["contributions"][1]["reason"] == "inter-arrival CV 0.050 <= 0.300"


def test_missing_values_do_not_fire(spark):
    assert fired(row(spark, 20, None, None, None, None, None)) == []


@pytest.mark.parametrize(
    "rule,rf,threshold,want", [(5.6, 0.1, 0.5, 2.0), (1.4, 0.9, 0.5, 1.8), (1.4, 0.9, 0.0, 0.5)]
)
def test_hybrid_score(spark, rule, rf, threshold, want):
    label = "beacon" if rf >= threshold else "benign"
    d = spark.createDataFrame(
        [(rule, 2.8, "benign", rf, threshold, label)],
        "rule_score double, rule_threshold double, rule_predicted_label string, rf_score double, rf_threshold double, rf_predicted_label string",
    )
    r = d.select(sc.hybrid_score(True).alias("h"), sc.final_label(True).alias("l")).first()
    assert r["h"] == pytest.approx(want) and r["l"] == label


def test_every_feature_is_listed_once():
    assert len(FEATURES) == 44 and len(set(FEATURES)) == 44
