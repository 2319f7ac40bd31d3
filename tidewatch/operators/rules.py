"""Explainable rule detector over feature rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import fixed3, holds
from tidewatch.schema import BASELINE_RULES, RULE_DETECTOR, RuleThresholds

c = F.col


def gate(t: RuleThresholds) -> Column:
    return c("event_count") >= t.min_event_count


def periodic(t: RuleThresholds) -> Column:
    cv = c("inter_arrival_cv")
    support = (c("event_count") >= t.timing_min_event_count) | (cv <= t.strong_periodic_cv_threshold)
    long_enough = c("flow_duration_seconds") >= t.min_flow_duration_seconds
    return holds((cv <= t.periodic_cv_threshold) & long_enough & support)


def compact(t: RuleThresholds) -> Column:
    iqr, mean = c("interarrival_iqr_seconds"), c("mean_interarrival_seconds")
    strong = iqr <= mean * F.lit(t.strong_periodic_iqr_fraction_threshold)
    support = (c("event_count") >= t.timing_min_event_count) | strong
    return holds((iqr <= mean * F.lit(t.periodic_iqr_fraction_threshold)) & support)


def stable_size(t: RuleThresholds) -> Column:
    return holds(c("size_cv") <= t.stable_size_cv_threshold)


def sustained(t: RuleThresholds) -> Column:
    return holds(c("flow_duration_seconds") >= t.min_flow_duration_seconds)


def burst_sleep(t: RuleThresholds) -> Column:
    bursts, sleep = c("burst_count"), c("avg_sleep_duration_seconds")
    strong = (sleep >= t.burst_strong_sleep_seconds) | (bursts >= t.burst_repeated_count)
    return holds(
        (bursts >= t.burst_min_count)
        & (c("avg_burst_size") >= t.burst_min_avg_size)
        & (sleep >= t.burst_min_avg_sleep_seconds)
        & (c("burst_to_idle_ratio") <= t.burst_max_burst_to_idle_ratio)
        & strong
    )


def constant_size(t: RuleThresholds) -> Column:
    return holds(
        (c("size_cv") <= t.constant_size_cv_threshold)
        & (c("flow_duration_seconds") >= t.constant_size_min_duration_seconds)
    )


def long_low_rate(t: RuleThresholds) -> Column:
    return holds(
        (c("event_count") >= t.long_repetition_min_event_count)
        & (c("flow_duration_seconds") >= t.long_repetition_min_duration_seconds)
        & c("mean_interarrival_seconds").between(
            t.long_repetition_min_mean_interarrival_seconds,
            t.long_repetition_max_mean_interarrival_seconds,
        )
    )


def moderate_jitter(t: RuleThresholds) -> Column:
    return holds(
        (c("event_count") >= t.moderate_jitter_min_event_count)
        & (c("inter_arrival_cv") <= t.moderate_jitter_cv_threshold)
        & (c("size_cv") <= t.moderate_jitter_size_cv_threshold)
    )


def rule_table(t: RuleThresholds) -> list[tuple[str, Column, float, Column, str]]:
    """(name, condition, weight, text when fired, text when not), in scoring order. Names and
    texts are fixed values."""
    cv, iqr, mean = (c(x) for x in ("inter_arrival_cv", "interarrival_iqr_seconds", "mean_interarrival_seconds"))
    limit = mean * F.lit(t.periodic_iqr_fraction_threshold)
    return [
        (
            "low_interarrival_variability",
            periodic(t),
            t.periodic_timing_score,
            F.format_string("inter-arrival CV %s <= %s", fixed3(cv), fixed3(F.lit(t.periodic_cv_threshold))),
            "inter-arrival variability is not low enough",
        ),
        (
            "compact_interarrival_spread",
            compact(t),
            t.compact_timing_spread_score,
            F.format_string("inter-arrival IQR %ss <= %ss", fixed3(iqr), fixed3(limit)),
            "inter-arrival spread is too wide",
        ),
        (
            "stable_payload_size",
            stable_size(t),
            t.stable_size_score,
            F.format_string(
                "size CV %s <= %s", fixed3(c("size_cv")), fixed3(F.lit(t.stable_size_cv_threshold))
            ),
            "payload sizes are not stable enough",
        ),
        (
            "sustained_repeated_communication",
            sustained(t),
            t.sustained_flow_score,
            F.format_string(
                "flow duration %ss >= %ss",
                fixed3(c("flow_duration_seconds")),
                fixed3(F.lit(t.min_flow_duration_seconds)),
            ),
            "flow duration is too short",
        ),
        (
            "burst_sleep_structure",
            burst_sleep(t),
            t.burst_structure_score,
            F.lit("repeated bursts separated by longer sleeps"),
            "burst/sleep structure is not strong enough",
        ),
        (
            "constant_size_repetition",
            constant_size(t),
            t.constant_size_repetition_score,
            F.lit("repeated communication has nearly constant payload size"),
            "payload size is not constant enough over a sustained flow",
        ),
        (
            "long_low_rate_repetition",
            long_low_rate(t),
            t.long_low_rate_repetition_score,
            F.lit("many events repeat over a long low-rate flow"),
            "flow is not long/repeated enough for jitter-tolerant matching",
        ),
        (
            "moderate_jitter_repetition",
            moderate_jitter(t),
            t.moderate_jitter_repetition_score,
            F.lit("timing is moderately regular while size jitter stays bounded"),
            "timing/size jitter is too wide for moderate-jitter matching",
        ),
    ]


def rule_score(t: RuleThresholds) -> Column:
    total = F.lit(0.0)
    for _, cond, weight, _, _ in rule_table(t):
        total = total + F.when(cond, F.lit(float(weight))).otherwise(0.0)
    # rounding removes the last-bit noise of the sum, so equal rule weights give equal scores
    return F.when(gate(t), F.round(total, 9)).otherwise(F.lit(0.0))


def contributions(t: RuleThresholds) -> Column:
    """array<struct<rule_name, fired, score, reason>>: only the gate below the event minimum."""

    def part(name, fired, score, reason):
        return F.struct(
            F.lit(name).alias("rule_name"), fired.alias("fired"), score.alias("score"), reason.alias("reason")
        )

    n = c("event_count")
    first = part(
        "minimum_event_count",
        gate(t),
        F.lit(0.0),
        F.when(gate(t), F.format_string(f"event_count %d meets minimum {t.min_event_count}", n)).otherwise(
            F.format_string(f"event_count %d is below minimum {t.min_event_count}", n)
        ),
    )
    rest = [
        part(name, cond, F.when(cond, F.lit(float(w))).otherwise(0.0), F.when(cond, yes).otherwise(F.lit(no)))
        for name, cond, w, yes, no in rule_table(t)
    ]
    return F.when(gate(t), F.array(first, *rest)).otherwise(F.array(first))


def detect_rules(features: DataFrame, t: RuleThresholds = BASELINE_RULES) -> DataFrame:
    """Adds the rule detection to feature rows; everything is computed on the row itself."""
    return features.withColumns(
        {
            "detector_name": F.lit(RULE_DETECTOR),
            "score": rule_score(t),
            "threshold": F.lit(float(t.prediction_threshold)),
            "contributions": contributions(t),
        }
    ).withColumn(
        "predicted_label", F.when(c("score") >= c("threshold"), "beacon").otherwise("benign")
    )


def triggered(field: str, array: str = "contributions") -> Column:
    """The named field of the contributions that fired with a positive score, in rule order."""
    hits = F.filter(F.col(array), lambda x: x["fired"] & (x["score"] > 0))
    return F.transform(hits, lambda x: x[field])
