"""Writing events, alerts, scored flows, run summaries and feature snapshots."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.scoring import iso
from tidewatch.schema import (
    ALERT_COLUMNS,
    OPS_KEY,
    OPTIONAL,
    REQUIRED,
    RULE_DETECTOR,
    SCORED_COLUMNS,
    RuleThresholds,
)

EVENT_COLUMNS = [
    "timestamp", "src_ip", "direction", "dst_ip", "dst_port", "protocol", "src_port", "size_bytes", "label",
    "scenario_name",
]
CONTRACT_COLUMNS = [
    "timestamp", "src_ip", "src_port", "direction", "dst_ip", "dst_port", "protocol", "total_bytes",
    "duration_seconds", "total_packets", "label", "scenario_name",
]
SNAPSHOT_VERSION = "flow_features_v1"


def event_rows(events: DataFrame) -> DataFrame:
    """Flow events as the ten text-friendly columns of the event CSV."""
    return events.withColumn("timestamp", iso(F.col("t_us"))).select(*EVENT_COLUMNS)


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    w = df.write.mode(mode)
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def write_events(events: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    _write(event_rows(events), path, fmt, mode)


def to_normalized(events: DataFrame) -> DataFrame:
    """Flow events as the labelled normalized contract."""
    return events.select(
        iso(F.col("t_us")).alias("timestamp"),
        "src_ip",
        F.coalesce("src_port", F.lit("")).alias("src_port"),
        F.coalesce("direction", F.lit("->")).alias("direction"),
        "dst_ip",
        "dst_port",
        "protocol",
        F.col("size_bytes").alias("total_bytes"),
        F.lit("").alias("duration_seconds"),
        F.lit("").alias("total_packets"),
        "label",
        F.coalesce("scenario_name", F.lit("unknown")).alias("scenario_name"),
    ).select(*CONTRACT_COLUMNS)


def contract_counts(events: DataFrame) -> DataFrame:
    """Event, label and scenario counts of an export: kind, key, count."""
    per = events.groupBy("label", F.coalesce("scenario_name", F.lit("unknown")).alias("s")).agg(
        F.count(F.lit(1)).alias("count")
    )
    kinds = F.array(
        F.struct(F.lit("events").alias("kind"), F.lit("").alias("key")),
        F.struct(F.lit("label").alias("kind"), F.col("label").alias("key")),
        F.struct(F.lit("scenario").alias("kind"), F.col("s").alias("key")),
    )
    return per.select(F.explode(kinds).alias("k"), "count").groupBy("k.kind", "k.key").agg(F.sum("count").alias("count"))


def write_alerts(alerts: DataFrame, path: str, run_date: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Alerts partitioned by run date."""
    d = alerts.select(*ALERT_COLUMNS).withColumn("run_date", F.lit(run_date))
    w = d.write.mode(mode).partitionBy("run_date")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def write_scored(scored: DataFrame, path: str, run_date: str, fmt: str = "parquet", mode: str = "append") -> None:
    d = scored.select(*SCORED_COLUMNS).withColumn("run_date", F.lit(run_date))
    w = d.write.mode(mode).partitionBy("run_date")
    w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path)


def run_summary(
    scored: DataFrame,
    diagnostics: DataFrame,
    thresholds: RuleThresholds,
    input_path: str = "",
    input_format: str = "normalized-csv",
    alert_profile: str = "conservative",
    model: Mapping | None = None,
) -> DataFrame:
    """One row: mode, thresholds, profile, grouping key, counts, skip reasons, semantics, outputs.

    Without a model the profile in use is always `conservative`, while `alert_profile` keeps what
    was asked for.
    """
    counts = scored.agg(
        F.count(F.lit(1)).alias("scored_flow_count"),
        F.count_if(F.col("predicted_label") == "beacon").alias("alert_count"),
    )
    if model is None:
        profile = {
            "profile": "conservative",
            "threshold": thresholds.prediction_threshold,
            "source": "rules_baseline",
            "selection_method": "fixed_rule_threshold",
        }
    else:
        found = (model.get("threshold_profiles") or {}).get(alert_profile) or {}
        profile = {
            "profile": alert_profile,
            "threshold": float(found.get("threshold", model["prediction_threshold"])),
            "source": "model_artifact",
            "selection_method": found.get("selection_method", "saved_model_default"),
        }
    semantics = {
        "score": "rule score in rules-only mode; max(rule ratio, rf ratio) in hybrid mode",
        "rf_score": "uncalibrated; for ranking and thresholding",
        "confidence": "threshold-relative display value, not a probability",
    }
    outputs = {"alerts": ALERT_COLUMNS, "scored_flows": SCORED_COLUMNS}
    d = counts.crossJoin(diagnostics)  # one row each
    return d.select(
        F.lit(input_path).alias("input_path"),
        F.lit(input_format).alias("input_format"),
        F.lit("rules_only" if model is None else "rules_random_forest_hybrid").alias("mode"),
        F.lit(RULE_DETECTOR).alias("detector_name"),
        F.lit(None if model is None else model["detector_name"]).cast("string").alias("model_detector_name"),
        F.lit(None if model is None else model["schema_version"]).cast("int").alias("model_schema_version"),
        F.lit(alert_profile).alias("alert_profile"),
        F.struct(*[F.lit(v).alias(k) for k, v in profile.items()]).alias("threshold_profile"),
        F.lit(float(thresholds.prediction_threshold)).alias("prediction_threshold"),
        F.array(*[F.lit(k) for k in OPS_KEY]).alias("flow_grouping_key"),
        F.lit("captured_but_not_grouped").alias("src_port_policy"),
        F.lit("whole_file_batch").alias("time_windowing"),
        F.col("loaded_event_count").alias("input_event_count"),
        F.struct("input_row_count", "loaded_event_count", "skipped_row_count", "skipped_row_reasons").alias("ingestion"),
        "scored_flow_count",
        "alert_count",
        F.array(*[F.lit(k) for k in REQUIRED]).alias("required_columns"),
        F.array(*[F.lit(k) for k in OPTIONAL]).alias("optional_columns"),
        F.struct(*[F.lit(v).alias(k) for k, v in semantics.items()]).alias("score_semantics"),
        F.struct(*[F.array(*[F.lit(x) for x in v]).alias(k) for k, v in outputs.items()]).alias("output_manifest"),
    )


def experiment_metadata(study: str, params: Mapping, outputs: Sequence[str], counts: DataFrame) -> DataFrame:
    """One row per study: seeds, detectors, operating points and other parameters as JSON, the
    outputs, and group counts taken from data (columns group_name, count)."""
    groups = F.map_from_entries(F.sort_array(F.collect_list(F.struct("group_name", "count"))))
    return counts.agg(groups.alias("group_counts")).select(
        F.lit(study).alias("study"),
        F.lit(json.dumps(params, sort_keys=True)).alias("parameters"),
        F.array(*[F.lit(o) for o in outputs]).alias("outputs"),
        "group_counts",
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def snapshot_path(root: str, kind: str, name: str, seed: int, config: Mapping) -> str:
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{root.rstrip('/')}/{kind}/{name}/seed={seed}/{digest}"


def feature_snapshot(
    spark: SparkSession,
    make: Callable[[], DataFrame],
    root: str | None,
    kind: str,
    name: str,
    seed: int,
    config: Mapping,
    version: str = SNAPSHOT_VERSION,
) -> tuple[DataFrame, str]:
    """Feature rows from a parquet snapshot, and its status: hit, miss, stale or disabled.

    Stale means another schema version, other fields or other metadata; then it is rebuilt. The
    manifest is written after the data, so a job that dies half way leaves no valid snapshot.
    """
    if root is None:
        return make(), "disabled"
    base = snapshot_path(root, kind, name, seed, config)
    meta = {"kind": kind, "name": name, "seed": seed, "config": json.loads(json.dumps(config, default=str))}
    status, want = "miss", None
    try:
        row = spark.read.json(f"{base}/manifest").first()
        data = spark.read.parquet(f"{base}/data")
        want = {"version": row["version"], "fields": row["fields"], "meta": row["meta"]}
        status = "stale"
        if want == {"version": version, "fields": ",".join(data.columns), "meta": json.dumps(meta, sort_keys=True)}:
            return data, "hit"
    except Exception:  # no snapshot, or an unreadable one
        if want is not None:
            status = "stale"
    built = make()
    built.write.mode("overwrite").parquet(f"{base}/data")
    fields = ",".join(built.columns)
    manifest = [(version, fields, json.dumps(meta, sort_keys=True))]
    write_json(spark.createDataFrame(manifest, "version string, fields string, meta string"), f"{base}/manifest")
    return spark.read.parquet(f"{base}/data"), status
