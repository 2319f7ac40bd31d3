"""Whole jobs: score flow logs, train and load a model, bidirectional scoring and transfer."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import anomaly as an
from tidewatch.operators import bidir as bd
from tidewatch.operators import evaluate as ev
from tidewatch.operators import models as md
from tidewatch.operators import rules as rl
from tidewatch.operators import scoring as sc
from tidewatch.operators.features import flow_features
from tidewatch.operators.flows import events_from_operational
from tidewatch.operators.ranks import ensure_checkpoint_dir
from tidewatch.schema import (
    HIGH_PRECISION_RULES,
    MODEL_SCHEMA_VERSION,
    OPS_KEY,
    FeatureParams,
    ModelParams,
    RuleThresholds,
)
from tidewatch.sources import flowlogs as fg
from tidewatch.sources import sinks as sk
from tidewatch.sources.normalized import read_normalized

NATIVE_NAMES = {
    "random_forest": "ctu_native_random_forest_v1",
    "logistic_regression": "ctu_native_logistic_regression_v1",
}


@dataclass
class Artifact:
    detector: md.Detector
    metadata: dict


@dataclass
class ScoreRun:
    scored: DataFrame
    alerts: DataFrame
    summary: DataFrame


def score_events(
    events: DataFrame,
    thresholds: RuleThresholds = HIGH_PRECISION_RULES,
    artifact: Artifact | None = None,
    profile: str = "conservative",
    params: FeatureParams = FeatureParams(),
) -> DataFrame:
    """Operational events -> scored flows: one plan from events to scores."""
    f = flow_features(events_from_operational(events, "benign"), params, OPS_KEY)
    if artifact is not None:
        d = md.with_profile(artifact.detector, artifact.metadata.get("threshold_profiles") or {}, profile)
        f = md.as_rf_columns(f, d)
    return sc.score_flows(f, thresholds, with_model=artifact is not None)


def score(
    spark: SparkSession,
    paths: str | Sequence[str],
    fmt: str,
    model_path: str | None = None,
    profile: str = "conservative",
    output: str | None = None,
    run_date: str = "",
    thresholds: RuleThresholds = HIGH_PRECISION_RULES,
) -> ScoreRun:
    """The scoring job: the files are parsed once, everything else reads the typed events. With
    `output`, writes alerts, scored flows and the run summary."""
    ensure_checkpoint_dir(spark)
    events = fg.load_events(spark, paths, fmt, f"{spark.sparkContext.getCheckpointDir()}/events-{uuid.uuid4().hex}")
    artifact = load_model(spark, model_path) if model_path else None
    scored = score_events(fg.loaded(events), thresholds, artifact, profile)
    if output:  # alerts, table and summary read the same rows
        scored = scored.checkpoint()
    alerts = sc.rank_alerts(scored)
    model = None
    if artifact is not None:
        model = {**artifact.metadata, "prediction_threshold": artifact.detector.params.threshold}
    text = paths if isinstance(paths, str) else ";".join(paths)
    summary = sk.run_summary(scored, fg.ingest_diagnostics(events), thresholds, text, fmt, profile, model)
    if output:
        sk.write_alerts(alerts, f"{output}/alerts", run_date)
        sk.write_scored(scored, f"{output}/scored_flows", run_date)
        sk.write_json(summary, f"{output}/run_summary")
        sk.write_json(sc.report_rows(alerts), f"{output}/report_rows")
    return ScoreRun(scored, alerts, summary)


def validate(rows: DataFrame, requested: int, p: ModelParams) -> tuple[dict, DataFrame | None]:
    """Grouped stratified validation: (metadata, out-of-fold predictions)."""
    k, why = md.fold_count(rows, requested)
    meta = {"strategy": "stratified_group_kfold", "requested_folds": requested, "executed_folds": k, "skipped_reason": why}
    if not k:
        return meta, None
    folded = md.kfold(rows, k).checkpoint()
    oof = md.out_of_fold(folded, k, "random_forest", p).checkpoint()
    meta["folds"] = [r.asDict() for r in md.fold_metrics(oof).orderBy("fold").collect()]  # k rows
    return meta, oof


def train_events(events: DataFrame, out: str, folds: int = 5, p: ModelParams = ModelParams(), params: FeatureParams = FeatureParams()) -> Artifact:
    """Labelled operational events -> fitted, validated, saved model."""
    spark = events.sparkSession
    ensure_checkpoint_dir(spark)
    known = events.filter(F.col("label") != "unknown")
    rows = flow_features(events_from_operational(known, "event"), params, OPS_KEY, mixed="reject").checkpoint()
    detector = md.fit(rows, "random_forest", p)
    meta, oof = validate(rows, folds, p)
    profiles, calibration = md.default_profiles(), {"brier_score": None, "reliability_bins": [], "out_of_fold_prediction_count": 0}
    if oof is not None:
        found = md.threshold_profiles(md.evaluate_thresholds(oof)).collect()  # three rows
        profiles = {r["profile"]: {k: v for k, v in r.asDict().items() if k != "profile"} for r in found}
        b = md.brier(oof).first()
        bins = md.reliability_bins(oof).orderBy("lower_bound").collect()  # ten rows
        calibration = {
            "brier_score": b["brier_score"],
            "out_of_fold_prediction_count": b["count"],
            "reliability_bins": [r.asDict() for r in bins],
        }
    counts = ev.training_counts(rows).first()
    dropped = events.agg(F.count_if(F.col("label") == "unknown").alias("n")).first()["n"]
    metadata = {
        "artifact_type": "operational_random_forest_model",
        "schema_version": MODEL_SCHEMA_VERSION,
        "detector_name": detector.name,
        "feature_names": list(p.features),
        "feature_count": len(p.features),
        "prediction_threshold": p.threshold,
        "params": {"trees": p.trees, "max_depth": p.max_depth, "min_leaf": p.min_leaf, "seed": p.seed},
        "label_mapping": {"benign": 0, "beacon": 1},
        "training_data": {**counts.asDict(), "dropped_unknown_events": dropped},
        "validation": meta,
        "threshold_profiles": profiles,
        "calibration": calibration,
    }
    metadata["model_format"] = md.save_model(detector, spark, f"{out}/model")
    sk.write_json(spark.createDataFrame([(json.dumps(metadata),)], "metadata string"), f"{out}/metadata")
    return Artifact(detector, metadata)


def train_model(spark: SparkSession, paths: str | Sequence[str], out: str, folds: int = 5, label_column: str = "label", p: ModelParams = ModelParams()) -> Artifact:
    return train_events(read_normalized(spark, paths, True, label_column), out, folds, p)


def load_model(spark: SparkSession, path: str) -> Artifact:
    """The saved model, after checking type, schema version and features."""
    meta = json.loads(spark.read.json(f"{path}/metadata").first()["metadata"])
    if meta.get("artifact_type") != "operational_random_forest_model":
        raise ValueError(f"Not an operational model: {path}")
    if meta.get("schema_version") != MODEL_SCHEMA_VERSION:
        raise ValueError(f"Unsupported model schema version: {meta.get('schema_version')}")
    p = replace(ModelParams(), threshold=meta["prediction_threshold"], **meta["params"])
    if list(p.features) != meta["feature_names"]:
        raise ValueError("Model features do not match this library.")
    return Artifact(md.Detector("random_forest", p, md.load_model(spark, f"{path}/model", meta.get("model_format", "spark_ml"))), meta)


# --- bidirectional ----------------------------------------------------------------------------------


def native_params(p: ModelParams = ModelParams()) -> ModelParams:
    return replace(p, features=tuple(bd.NATIVE_FEATURES))


def native_supervised(rows: DataFrame, kinds: Sequence[str] = ("logistic_regression", "random_forest"), p: ModelParams = ModelParams()) -> tuple[DataFrame, DataFrame]:
    """Leave-one-scenario-out predictions and the importance rows of every fold.

    The rows are read by every fit, so they are written once, evenly; a fold is a filter on the scenario."""
    p = native_params(p)
    rows = md.evenly(rows)
    names = bd.scenario_names(rows)
    pred = weights = None

    folds = [(name, kind) for name in names for kind in kinds]
    fits = md.side_by_side(rows.sparkSession, lambda x: md.fit(rows.filter(F.col("scenario_name") != x[0]), x[1], p), folds)
    for (name, kind), d in zip(folds, fits):
        test = rows.filter(F.col("scenario_name") == name)
        s = md.score(test, d).drop("contributions").withColumns(
            {"fold_name": F.lit(f"test_{name}"), "test_scenario": F.lit(name), "detector_name": F.lit(NATIVE_NAMES[kind]), "true_label": F.col("label"), "operating_point": F.lit(f"threshold={p.threshold:g};features={len(p.features)}")}
        )
        w = md.importance_table(d, rows.sparkSession, fold_name=f"test_{name}", test_scenario=name)
        w = w.withColumn("detector_name", F.lit(NATIVE_NAMES[kind]))
        pred = s if pred is None else pred.unionByName(s)
        weights = w if weights is None else weights.unionByName(w)
    return pred, weights


def score_bidir(train: DataFrame, rows: DataFrame, kind: str = "random_forest", p: ModelParams = ModelParams(), output: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Train on native rows of some scenarios, score others: (scored rows, metrics)."""
    d = md.fit(md.evenly(train), kind, native_params(p))
    s = md.score(rows, d).drop("contributions").withColumn("detector_name", F.lit(NATIVE_NAMES[kind]))
    m = ev.classification_metrics(s.withColumnRenamed("label", "true_label"), ["detector_name"])
    if output:
        s.write.mode("overwrite").parquet(f"{output}/scored")
        m.write.mode("overwrite").json(f"{output}/metrics")
    return s, m


def transfer_eval(
    train: DataFrame,
    dataset: DataFrame,
    thresholds: RuleThresholds = HIGH_PRECISION_RULES,
    p: ModelParams = ModelParams(),
    with_models: bool = True,
) -> DataFrame:
    """Records of the evaluation rows of `dataset` (role column): rules, LOF on the benign
    reference, and a forest trained on another table at 0.6 and 0.3."""
    rows = dataset.filter("role = 'evaluation'").drop("role", "row_key")
    reference = dataset.filter("role = 'reference'").drop("role", "row_key")
    out = bd.transfer_records(rl.detect_rules(rows, thresholds), F.lit(f"threshold={thresholds.prediction_threshold:g}"))
    lof = an.detect_lof(rows, fit_rows=reference)
    out = out.unionByName(bd.transfer_records(lof, F.lit("benign_reference;contamination=0.03")))
    if with_models:
        d = md.fit(train, "random_forest", p)
        for name, t in (("rf_full_threshold_0p6", 0.6), ("rf_full_threshold_0p3", 0.3)):
            s = md.score(rows, d.with_threshold(t)).withColumn("detector_name", F.lit(name))
            out = out.unionByName(bd.transfer_records(s, F.lit(f"threshold={t:g};trained_on_other_table")))
    return out
