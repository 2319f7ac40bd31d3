"""Hybrid scoring, alerts, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import fixed3
from tidewatch.operators import rules
from tidewatch.operators.flows import order_columns
from tidewatch.operators.ranks import with_rank
from tidewatch.schema import ALERT_COLUMNS, HIGH_PRECISION_RULES, SCORED_COLUMNS, RuleThresholds

c = F.col


def iso(us: Column) -> Column:
    """ISO text in UTC; microseconds only when there are some."""
    t = F.timestamp_micros(us)
    form = F.when(us % 1_000_000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
    return F.concat(form, F.lit("+00:00"))


def hybrid_score(with_model: bool) -> Column:
    """max(rule/threshold, rf/threshold); a zero threshold gives ratio 0; the rule score alone
    without a model."""
    if not with_model:
        return c("rule_score")
    rule = F.when(c("rule_threshold") > 0, c("rule_score") / c("rule_threshold")).otherwise(0.0)
    rf = F.when(c("rf_threshold") > 0, c("rf_score") / c("rf_threshold")).otherwise(0.0)
    return F.greatest(rule, rf)


def final_label(with_model: bool) -> Column:
    if not with_model:
        return c("rule_predicted_label")
    return F.when(c("rf_predicted_label") == "beacon", "beacon").otherwise(c("rule_predicted_label"))


def detector_mode(with_model: bool) -> Column:
    return F.lit("rules_random_forest_hybrid" if with_model else "rules_only")


def severity() -> Column:
    margin = c("score") - c("threshold")
    return F.when(margin >= 2.0, "critical").when(margin >= 1.0, "high").otherwise("medium")


def confidence() -> Column:
    return F.when(c("threshold") <= 0, F.lit(1.0)).otherwise(
        F.least(c("score") / c("threshold"), F.lit(1.0))
    )


def score_flows(
    features: DataFrame, t: RuleThresholds = HIGH_PRECISION_RULES, with_model: bool = False
) -> DataFrame:
    """Scored flows. With a model, `features` already carries rf_score, rf_threshold,
    rf_predicted_label and top_model_features; rules and model meet on the row, without a join."""
    d = rules.detect_rules(features, t).withColumnsRenamed(
        {"score": "rule_score", "threshold": "rule_threshold", "predicted_label": "rule_predicted_label"}
    )
    if not with_model:
        none = F.lit(None)
        d = d.withColumns(
            {
                "rf_predicted_label": none.cast("string"),
                "rf_score": none.cast("double"),
                "rf_threshold": none.cast("double"),
                "top_model_features": F.lit(""),
            }
        )
    rf_reason = (
        F.when(
            c("rf_predicted_label") == "beacon",
            F.array(F.format_string("random forest score %s >= %s", fixed3(c("rf_score")), fixed3(c("rf_threshold")))),
        ).otherwise(F.array().cast("array<string>"))
        if with_model
        else F.array().cast("array<string>")
    )
    ports = F.array_join("src_ports", ";") if "src_ports" in features.columns else F.lit("")
    d = d.withColumns(
        {
            "hybrid_score": hybrid_score(with_model),
            "detector_mode": detector_mode(with_model),
            "predicted_label": final_label(with_model),
            "direction": F.coalesce("direction", F.lit("")),
            "first_seen": iso(c("start_us")),
            "last_seen": iso(c("end_us")),
            "src_ports_seen": ports,
            "triggered_rules": F.array_join(rules.triggered("rule_name"), " | "),
            "top_reasons": F.array_join(F.concat(rules.triggered("reason"), rf_reason), " | "),
        }
    )
    return d.withColumns(
        {
            "score": c("hybrid_score"),
            "threshold": F.lit(1.0) if with_model else c("rule_threshold"),
        }
    )


def scored_table(scored: DataFrame) -> DataFrame:
    return scored.select(*SCORED_COLUMNS)


def rank_alerts(scored: DataFrame) -> DataFrame:
    """Alerts ranked by final score; equal scores keep flow order."""
    hits = scored.filter(c("predicted_label") == "beacon").withColumns(
        {"severity": severity(), "confidence": confidence()}
    )
    order = [F.desc("score"), *order_columns(scored.columns)]
    keep = [x for x in ALERT_COLUMNS if x != "rank"] + ["start_us"]
    return with_rank(hits.select(*keep), order).select(*ALERT_COLUMNS)


def report_rows(alerts: DataFrame, n: int = 10) -> DataFrame:
    """The first n alerts as a report shows them (a top-k report)."""
    flow = F.format_string(
        "%s %s %s:%d/%s", c("src_ip"), c("direction"), c("dst_ip"), c("dst_port"), c("protocol")
    )
    return (
        alerts.filter(c("rank") <= n)
        .orderBy("rank")
        .select(
            "rank",
            "severity",
            fixed3(c("score")).alias("score"),
            flow.alias("flow"),
            "event_count",
            F.coalesce("top_reasons", F.lit("")).alias("reasons"),
        )
    )
