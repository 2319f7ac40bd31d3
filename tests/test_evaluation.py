import pytest
from pyspark.sql import functions as F
from tidewatch.operators import bidir as bd
from tidewatch.operators import evaluate as ev
from tidewatch.operators import reports as rp

REC = "detector_name string, case_name string, seed int, scenario_name string, true_label string, predicted_label string, score double, threshold double"


def records(spark, rows):
    return spark.createDataFrame([("d", *r, 0.5) for r in rows], REC)


def test_all_counts_one(spark):
    pred = records(
        spark,
        [
            ("c", 0, "s", "beacon", "beacon", 0.9),
            ("c", 0, "s", "beacon", "benign", 0.1),
            ("c", 0, "s", "benign", "beacon", 0.7),
            ("c", 0, None, "benign", "benign", 0.2),
        ],
    )
    r = ev.classification_metrics(pred).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (1, 1, 1, 1)
    assert [r[m] for m in ev.METRICS] == [0.5] * 4
    assert {x["scenario_name"]: x["detection_rate"] for x in ev.scenario_rates(pred).collect()} == {"s": 1.0, "unknown": 0.0}
    assert ev.failures(pred).count() == 2 and ev.near_threshold(pred, 0.2).count() == 1
    assert ev.top_false_positives(pred).first()["score"] == 0.7 and ev.top_false_negatives(pred).first()["score"] == 0.1


def test_empty_denominators(spark):
    r = ev.classification_metrics(records(spark, [("c", 0, "s", "benign", "benign", 0.0)])).first()
    assert [r[m] for m in ev.METRICS] == [0.0] * 4


def test_spread_and_sweep(spark):
    pred = records(
        spark,
        [("c", 0, "s", "beacon", "beacon", 0.9), ("c", 0, "s", "benign", "beacon", 0.6), ("c", 1, "s", "beacon", "beacon", 0.8)],
    )
    m = ev.multi_seed(pred).first()
    assert m["mean_precision"] == 0.75 and m["std_precision"] == 0.25 and m["combined_precision"] == pytest.approx(2 / 3)
    sweep = {r["threshold"]: (r["tp"], r["fp"]) for r in ev.threshold_sweep(pred.drop("threshold"), [0.5, 0.85]).collect()}
    assert sweep == {0.5: (2, 1), 0.85: (1, 0)}


def test_first_reliable_count(spark):
    rates = [(3, 0.9), (5, 0.7), (7, 0.8), (9, 0.95)]
    d = spark.createDataFrame(
        [("d", "o", "f", n, r) for n, r in rates],
        "detector_name string, operating_point string, scenario_family string, event_count int, detection_rate double",
    )
    got = {r["reliability_target"]: r["first_reliable_event_count"] for r in ev.reliability_threshold(d, [0.8, 0.9, 0.99]).collect()}
    assert got == {0.8: 7, 0.9: 9, 0.99: None}


def test_score_distribution(spark):
    pred = records(spark, [("c", 0, "s", "beacon", "beacon", x) for x in (0.1, 0.6, 0.7, -0.1)])
    assert {r["bucket"]: r["count"] for r in ev.score_distribution(pred, 0.5).collect()} == {0.0: 1, 0.5: 2, -0.5: 1}


def test_ladder_takes_prefixes(events):
    e = events([("a", "b", t, 10) for t in range(6)] + [("c", "b", t, 10) for t in range(2)])
    got = ev.evidence_ladder(e, ["src_ip", "dst_ip"], [3, 5]).groupBy("src_ip", "evidence").agg(F.max("t_us").alias("m"), F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == [("a", 3, 2_000_000, 3), ("a", 5, 4_000_000, 5)]


def test_shift_ranking(spark):
    rows = [("synthetic_benign", 0.0 + i, None) for i in range(5)] + [("ctu_from_normal", 10.0 + i, None) for i in range(5)]
    d = spark.createDataFrame([(g, "x", "s", v) for g, v, _ in rows], "group_name string, source_family string, ctu_scenario string, f double")
    s = bd.distribution_summary(d, ["f"], ["group_name", "source_family"], "ctu_scenario")
    r = bd.shift_ranking(s.filter("ctu_scenario = 'pooled'")).first()
    assert (r["left_median"], r["right_median"], r["pooled_iqr"], r["normalized_median_shift"]) == (2.0, 12.0, 2.0, 5.0)


def test_split_scenario(spark):
    d = spark.createDataFrame([("a:b:c",), ("a",), (None,)], "s string")
    a, b = bd.split_scenario(F.col("s"))
    assert sorted(map(tuple, d.select(a, b).collect())) == [("a", "b:c"), ("a", "unknown"), ("unknown", "unknown")]


def test_leave_one_out_needs_two(spark):
    with pytest.raises(ValueError, match="At least two"):
        bd.leave_one_out(spark.createDataFrame([("a",)], "scenario_name string"))


def test_missing_stage_and_role(spark):
    cols = "policy_name string, detector_name string, operating_point string, precision double, recall double, f1 double, false_positive_rate double"
    m = spark.createDataFrame([("conservative", "local_outlier_factor_v1", "x", 1.0, 1.0, 1.0, 0.0)], cols)
    native = m.withColumns({"feature_path": F.lit("ctu_native"), "compatibility_status": F.lit("ok")})
    got = {r["story_stage"]: r["compatibility_status"] for r in rp.three_stages(m, native, m.filter("1=0")).collect()}
    assert got["Within-CTU supervised evaluation"] == "source_missing" and len(got) == 3
    paths = spark.createDataFrame([("a/final_x.png", "headline")], "artifact_path string, artifact_role string")
    assert {r["artifact_role"]: r["story_stage"] for r in rp.manifest(paths, "t").collect()}["headline"] == "Project conclusion"
