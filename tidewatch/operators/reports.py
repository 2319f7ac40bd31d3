"""Report tables: joins, filters and unions over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col

# Stages, labels, interpretations, the sweep points a report keeps.
STAGES = [
    "Synthetic direct transfer to CTU",
    "CTU-native unsupervised evaluation",
    "Within-CTU supervised evaluation",
]
REPORT_POINTS = [("full", 0.3), ("full", 0.6), ("timing_size", 0.4)]
LABELS = {
    "rule_baseline_v2_hardened_final": "Rule",
    "statistical_zscore_baseline_v1": "Statistical",
    "local_outlier_factor_v1": "LOF",
    "logistic_regression_v1": "LR",
    "rf_full_threshold_0p6": "Synthetic RF @ 0.6",
    "rf_full_threshold_0p3": "Synthetic RF @ 0.3",
    "rf_timing_size_threshold_0p4": "RF timing+size @ 0.4",
    "ctu_native_random_forest_v1": "CTU-native RF",
    "ctu_native_logistic_regression_v1": "CTU-native LR",
}
FOREST_LABELS = [
    ("threshold=0.6", "RF @ 0.6"),
    ("threshold=0.3", "RF @ 0.3"),
    ("threshold=0.4", "RF timing+size @ 0.4"),
]
TRANSFER_DETECTORS = [
    "rule_baseline_v2_hardened_final",
    "local_outlier_factor_v1",
    "rf_full_threshold_0p6",
    "rf_full_threshold_0p3",
]
ROLES = ["headline", "supporting", "diagnostic"]
RATES = ["precision", "recall", "f1", "false_positive_rate"]
COUNTS = ["tp", "fp", "tn", "fn"]


def display_label(name: Column, point: Column) -> Column:
    forest = None
    for text, label in FOREST_LABELS:
        forest = F.when(point.contains(text), label) if forest is None else forest.when(point.contains(text), label)
    out = F.when(name == "random_forest_v1", forest.otherwise("RF"))
    for detector, label in LABELS.items():
        out = out.when(name == detector, label)
    return out.otherwise(name)


def evidence_interpretation(family: Column, count: Column) -> Column:
    return (
        F.when(count.isNull(), "not_reliable_in_sweep")
        .when(family.contains("time_size"), "evasive_regime_more_history")
        .otherwise("easy_regime_low_history")
    )


def supervised_interpretation(label: Column, policy: Column) -> Column:
    return (
        F.when(policy == "background_as_benign_sensitivity", "background_sensitivity_is_not_headline_result")
        .when(label == "CTU-native LR", "higher_recall_higher_false_positive_rate")
        .when(label == "CTU-native RF", "lower_false_positive_rate_lower_recall")
        .otherwise("ctu_native_supervised_tradeoff")
    )


def with_provenance(df: DataFrame, experiment: str, source_file: str, generated_at: str, exported_at: str = "", schema_version: str = "") -> DataFrame:
    return df.withColumns(
        {
            "source_experiment": F.lit(experiment),
            "source_file": F.lit(source_file),
            "generated_at": F.lit(generated_at),
            "source_export_timestamp_utc": F.lit(exported_at),
            "feature_schema_version": F.lit(schema_version),
        }
    )


def native_stage(df: DataFrame) -> DataFrame:
    return df.withColumn("story_stage", F.when(c("feature_path") == "ctu_native", STAGES[1]).otherwise(STAGES[0]))


def report_points(sweep: DataFrame) -> DataFrame:
    """The sweep rows a report shows."""
    keep = None
    for name, t in REPORT_POINTS:
        hit = (c("feature_set") == name) & (F.abs(c("threshold") - F.lit(t)) < 1e-9)
        keep = hit if keep is None else keep | hit
    return sweep.filter(keep)


def report_detectors(baseline: DataFrame, sweep: DataFrame, generated_at: str) -> DataFrame:
    """Baseline rows and selected sweep rows in one layout, with provenance."""
    means = [f"mean_{r}" for r in RATES]
    combined = [f"combined_{x}" for x in COUNTS]
    names = ["detector_name", "operating_point", "feature_set", "evaluation_scope"]
    a = baseline.withColumns({"feature_set": F.lit(""), "evaluation_scope": F.lit("standard_hardened_grid")})
    a = with_provenance(a.select(*names, *means, *combined), "supervised_ml_hardened_grid", "baseline_comparison", generated_at)
    point = F.concat(F.lit("threshold="), c("threshold").cast("string"), F.lit(";features="), c("feature_set"))
    b = report_points(sweep).select(
        F.lit("random_forest_v1").alias("detector_name"),
        point.alias("operating_point"),
        "feature_set",
        F.lit("standard_hardened_grid").alias("evaluation_scope"),
        *[c(r).alias(m) for r, m in zip(RATES, means)],
        *[c(x).alias(m) for x, m in zip(COUNTS, combined)],
    )
    return a.unionByName(with_provenance(b, "supervised_threshold_sweep", "supervised_threshold_sweep_summary", generated_at))


def headline(comparison: DataFrame) -> DataFrame:
    return comparison.select(
        F.lit("Synthetic benchmark evaluation").alias("story_stage"),
        display_label(c("detector_name"), c("operating_point")).alias("detector_label"),
        "detector_name",
        "operating_point",
        *[c(f"mean_{r}").alias(r) for r in RATES],
        "source_experiment",
    )


def evidence_story(thresholds: DataFrame, target: float = 0.8) -> DataFrame:
    return thresholds.filter(F.abs(c("reliability_target") - F.lit(target)) < 1e-9).select(
        "scenario_family",
        display_label(c("detector_name"), c("operating_point")).alias("detector_label"),
        "operating_point",
        "reliability_target",
        "first_reliable_event_count",
        evidence_interpretation(c("scenario_family"), c("first_reliable_event_count")).alias("interpretation"),
    )


def three_stages(transfer: DataFrame, native: DataFrame, supervised: DataFrame) -> DataFrame:
    """Conservative rows of the three stages; a stage without rows is listed as missing."""

    def rows(d: DataFrame, stage: str, path: str, status: Column) -> DataFrame:
        return d.filter(c("policy_name") == "conservative").select(
            F.lit(stage).alias("story_stage"),
            c("policy_name").alias("label_policy"),
            display_label(c("detector_name"), c("operating_point")).alias("detector_label"),
            F.lit(path).alias("feature_path"),
            status.alias("compatibility_status"),
            *RATES,
        )

    known = transfer.filter(c("detector_name").isin(TRANSFER_DETECTORS))
    lof = native.filter((c("feature_path") == "ctu_native") & (c("detector_name") == "local_outlier_factor_v1"))
    out = rows(known, STAGES[0], "transferred_flowfeatures", F.lit("compatible_existing_transfer_path"))
    out = out.unionByName(rows(lof, STAGES[1], "ctu_native", c("compatibility_status")))
    out = out.unionByName(rows(supervised, STAGES[2], "ctu_native", F.lit("compatible_ctu_native_training")))
    spark = transfer.sparkSession
    stages = spark.createDataFrame([(s,) for s in STAGES], "story_stage string")
    missing = stages.join(out.select("story_stage").distinct(), "story_stage", "left_anti").select(
        "story_stage",
        F.lit("conservative").alias("label_policy"),
        F.lit("").alias("detector_label"),
        F.lit("").alias("feature_path"),
        F.lit("source_missing").alias("compatibility_status"),
    )
    return out.unionByName(missing, allowMissingColumns=True)


def tradeoff(supervised: DataFrame) -> DataFrame:
    label = display_label(c("detector_name"), c("operating_point"))
    return supervised.select(
        c("policy_name").alias("label_policy"),
        label.alias("detector_label"),
        *RATES,
        *COUNTS,
        supervised_interpretation(label, c("policy_name")).alias("interpretation"),
    )


def artifact_stage(name: Column) -> Column:
    ctu = name.contains("ctu")
    return (
        F.when(ctu & name.contains("supervised"), STAGES[2])
        .when(ctu & name.contains("native"), STAGES[1])
        .when(ctu, STAGES[0])
        .when(name.contains("minimum_evidence"), "Minimum-evidence analysis")
        .when(name.contains("shortcut"), "Shortcut stress evaluation")
        .when(name.contains("synthetic") | name.contains("detector_comparison"), "Synthetic benchmark evaluation")
        .when(name.contains("final") | name.contains("story"), "Project conclusion")
        .otherwise("Supporting evidence")
    )


def artifact_policy(name: Column) -> Column:
    return (
        F.when(name.contains("ctu") & name.contains("sensitivity"), "conservative_and_background_as_benign_sensitivity")
        .when(name.contains("ctu"), "conservative")
        .otherwise("not_applicable")
    )


def manifest(paths: DataFrame, generated_at: str, roles: Sequence[str] = tuple(ROLES)) -> DataFrame:
    """Manifest of outputs. `paths`: artifact_path, artifact_role. Roles without output are listed."""
    name = F.regexp_extract("artifact_path", r"([^/]*)$", 1)
    kind = F.regexp_extract(name, r"\.([^.]+)$", 1)
    source = F.when(c("artifact_role") == "headline", "final_story").otherwise("existing_export")
    d = paths.select(
        "artifact_path",
        F.when(kind == "", "directory").otherwise(kind).alias("artifact_type"),
        "artifact_role",
        artifact_stage(name).alias("story_stage"),
        source.alias("source_experiment"),
        artifact_policy(name).alias("label_policy"),
    )
    wanted = paths.sparkSession.createDataFrame([(r,) for r in roles], "artifact_role string")
    missing = wanted.join(paths.select("artifact_role").distinct(), "artifact_role", "left_anti").select(
        F.lit("").alias("artifact_path"),
        F.lit("").alias("artifact_type"),
        "artifact_role",
        F.lit("Supporting evidence").alias("story_stage"),
        F.lit("expected_artifact_missing").alias("source_experiment"),
        F.lit("not_applicable").alias("label_policy"),
    )
    return d.unionByName(missing).withColumn("generated_at", F.lit(generated_at))
