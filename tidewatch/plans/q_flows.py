"""Registered queries: flow grouping, features, rules, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import flows as fl
from tidewatch.operators import rules as rl
from tidewatch.operators import scoring as sc
from tidewatch.operators.features import flow_features
from tidewatch.plans.common import (
    KEY,
    PARAMS,
    RULES,
    as_integers,
    events,
    feature_sql,
    feature_table,
    features,
    features_sql,
    num,
    tidy,
)
from tidewatch.plans.views import FLOW_EVENTS_SQL
from tidewatch.schema import FEATURES, FULL_KEY, OPS_KEY

Q: dict = {}
S: dict = {}

# --- C: flows -------------------------------------------------------------------------------------

FULL = ", ".join(FULL_KEY)

Q["c01_build_flows"] = lambda s, d: tidy(
    fl.build_flows(events(s, d), FULL_KEY).select(
        *FULL_KEY, "event_count", "start_us", "end_us", "total_bytes", "flow_duration_seconds", "label", "scenario_name"
    )
)
S["c01_build_flows"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT {FULL}, count(*) AS event_count, min(t_us) AS start_us, max(t_us) AS end_us,
 CAST(sum(size_bytes) AS BIGINT) AS total_bytes, {num("(max(t_us)-min(t_us))/1e6", "flow_duration_seconds")},
 CASE WHEN min(label)=max(label) THEN min(label) END AS label,
 array_to_string(list_sort(list(DISTINCT scenario_name)), ',') AS scenario_name FROM fe GROUP BY {FULL}"""

Q["c02_build_operational_flows"] = lambda s, d: tidy(
    fl.build_operational_flows(
        events(s, d).select(
            F.timestamp_micros("t_us").alias("ts"), *OPS_KEY, "src_port", F.col("size_bytes").alias("total_bytes"), "label"
        ),
        "event",
    ).select(*OPS_KEY, "src_ports", "event_count", "total_bytes", "label", "scenario_name")
)
S["c02_build_operational_flows"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT {KEY}, array_to_string(list_sort(list(DISTINCT src_port)), ';') AS src_ports,
 count(*) AS event_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, min(label) AS label,
 'operational' AS scenario_name FROM fe GROUP BY {KEY}"""


def _c03(s, d):
    from tidewatch.operators.ranks import with_rank

    f = fl.build_flows(events(s, d), FULL_KEY)
    return with_rank(f, fl.order_columns(f.columns), "position").select(*FULL_KEY, "start_us", "position")


Q["c03_flow_ordering"] = _c03
S["c03_flow_ordering"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}), f AS (SELECT {FULL}, min(t_us) AS start_us FROM fe GROUP BY {FULL})
SELECT {FULL}, start_us, row_number() OVER (ORDER BY start_us, src_ip, coalesce(src_port,''), coalesce(direction,''),
 dst_ip, dst_port, protocol) AS position FROM f"""

Q["c04_flow_measures"] = lambda s, d: tidy(
    fl.build_flows(events(s, d), OPS_KEY).select(
        *OPS_KEY, "event_count", "start_us", "end_us", "flow_duration_seconds", "total_bytes"
    )
)
S["c04_flow_measures"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT {KEY}, count(*) AS event_count, min(t_us) AS start_us, max(t_us) AS end_us,
 {num("(max(t_us)-min(t_us))/1e6", "flow_duration_seconds")}, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
 FROM fe GROUP BY {KEY}"""

# Labels and scenarios by destination only, so that flows with several of them occur.
WIDE = ["dst_ip", "dst_port", "protocol"]
WKEY = ", ".join(WIDE)
Q["c05_flow_labels"] = lambda s, d: fl.build_flows(events(s, d), WIDE).select(
    *WIDE, "benign_events", "beacon_events", "label"
)
S["c05_flow_labels"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT {WKEY}, count(*) FILTER (label='benign') AS benign_events,
 count(*) FILTER (label='beacon') AS beacon_events, CASE WHEN min(label)=max(label) THEN min(label) END AS label
 FROM fe GROUP BY {WKEY}"""

Q["c06_mixed_label_policy"] = lambda s, d: fl.mixed_flow_counts(fl.build_flows(events(s, d), WIDE)).unionByName(
    fl.mixed_flow_counts(fl.apply_mixed_policy(fl.build_flows(events(s, d), [*WIDE, "src_ip"]), "drop"))
)
S["c06_mixed_label_policy"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}),
a AS (SELECT {WKEY}, count(DISTINCT label) AS k FROM fe GROUP BY {WKEY}),
b AS (SELECT {WKEY}, src_ip, count(DISTINCT label) AS k FROM fe GROUP BY {WKEY}, src_ip)
SELECT count(*) AS flow_count, count(*) FILTER (k>1) AS dropped_mixed_label_flows FROM a
UNION ALL SELECT count(*), count(*) FILTER (k>1) FROM b WHERE k=1"""

Q["c07_scenario_names"] = lambda s, d: fl.build_flows(events(s, d), WIDE).select(*WIDE, "scenario_name")
S["c07_scenario_names"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT {WKEY}, array_to_string(list_sort(list(DISTINCT scenario_name)), ',') AS scenario_name
 FROM fe GROUP BY {WKEY}"""

Q["c08_flow_key_text"] = lambda s, d: fl.build_flows(events(s, d), OPS_KEY).select(
    fl.flow_key_text().alias("flow_key"), "event_count"
)
S["c08_flow_key_text"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}) SELECT concat(src_ip,'|',coalesce(direction,''),'|',dst_ip,':',dst_port,'/',protocol) AS flow_key,
 count(*) AS event_count FROM fe GROUP BY {KEY}"""

# --- D: features ----------------------------------------------------------------------------------


def _feature_query(columns):
    return lambda s, d: tidy(as_integers(features(s, d).select(*OPS_KEY, *columns)))


for _name, _columns in {
    "d02_gap_basic": [
        "mean_interarrival_seconds", "median_interarrival_seconds", "min_interarrival_seconds", "max_interarrival_seconds",
    ],
    "d03_gap_spread": ["std_interarrival_seconds", "inter_arrival_cv"],
    "d04_gap_iqr": ["interarrival_iqr_seconds"],
    "d05_gap_mad": ["interarrival_mad_seconds"],
    "d06_gap_trimmed_cv": ["trimmed_interarrival_cv"],
    "d07_near_median": [
        "near_median_interarrival_fraction", "interarrival_within_10pct_median_fraction",
        "interarrival_within_20pct_median_fraction", "interarrival_within_30pct_median_fraction",
    ],
    "d08_dominant_fraction": ["dominant_interval_fraction"],
    "d09_adaptive_bins": [
        "dominant_interval_bin_fraction", "interval_bin_count", "dominant_size_bin_fraction", "size_bin_count",
    ],
    "d10_adjacent_similarity": ["adjacent_gap_similarity_fraction"],
    "d11_longest_run": ["longest_similar_gap_run"],
    "d12_range_median_ratio": ["gap_range_median_ratio", "normalized_size_range"],
    "d13_mapd": ["interarrival_median_absolute_percentage_deviation"],
    "d14_periodicity": ["periodicity_score"],
    "d15_event_rate": ["events_per_second", "events_per_minute"],
    "d17_burst_stats": ["burst_count", "avg_burst_size", "max_burst_size", "burst_size_variance", "burst_size_cv"],
    "d18_sleep_stats": ["avg_sleep_duration_seconds", "sleep_duration_variance", "sleep_duration_cv"],
    "d19_within_burst": ["within_burst_gap_consistency"],
    "d20_burst_idle": ["burst_to_idle_ratio"],
    "d21_size_stats": [
        "mean_size_bytes", "median_size_bytes", "std_size_bytes", "size_cv", "near_median_size_fraction",
    ],
    "d22_extract_features": FEATURES,
}.items():
    Q[_name] = _feature_query(_columns)
    S[_name] = feature_sql(_columns)

# The same features with every flow of more than twelve events on the sliced path.
Q["d22_extract_features_sliced"] = lambda s, d: tidy(
    as_integers(flow_features(events(s, d), PARAMS, hot_threshold=12).select(*OPS_KEY, *FEATURES))
)
S["d22_extract_features_sliced"] = S["d22_extract_features"]


def _gaps(s, d):
    from tidewatch.operators.sequences import gaps

    return tidy(gaps(events(s, d), OPS_KEY))


Q["d01_inter_arrival_gaps"] = _gaps
S["d01_inter_arrival_gaps"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}), g AS (SELECT {KEY}, t_us, (t_us - lag(t_us) OVER (PARTITION BY {KEY} ORDER BY t_us))/1e6 AS gap FROM fe)
SELECT {KEY}, t_us, {num("gap", "gap_seconds")} FROM g WHERE gap IS NOT NULL"""


def _bursts(s, d):
    from tidewatch.operators.sequences import bursts

    return tidy(bursts(events(s, d), OPS_KEY, PARAMS.burst_threshold_seconds))


Q["d16_burst_detection"] = _bursts
S["d16_burst_detection"] = f"""
WITH fe AS ({FLOW_EVENTS_SQL}),
g AS (SELECT {KEY}, t_us, (t_us - lag(t_us) OVER w)/1e6 AS gap FROM fe WINDOW w AS (PARTITION BY {KEY} ORDER BY t_us)),
i AS (SELECT *, sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY t_us) AS island FROM g)
SELECT {KEY}, min(t_us) AS burst_start_us, max(t_us) AS burst_end_us, count(*) AS burst_size
FROM i GROUP BY {KEY}, island HAVING count(*) >= 2"""

# --- E: rules -------------------------------------------------------------------------------------

T = RULES
RULE_SQL = {
    "low_interarrival_variability": f"""inter_arrival_cv <= {T.periodic_cv_threshold}::DOUBLE AND flow_duration_seconds >= 30
      AND (event_count >= 10 OR inter_arrival_cv <= {T.strong_periodic_cv_threshold}::DOUBLE)""",
    "compact_interarrival_spread": """interarrival_iqr_seconds <= mean_interarrival_seconds*0.5::DOUBLE
      AND (event_count >= 10 OR interarrival_iqr_seconds <= mean_interarrival_seconds*0.2::DOUBLE)""",
    "stable_payload_size": f"size_cv <= {T.stable_size_cv_threshold}::DOUBLE",
    "sustained_repeated_communication": "flow_duration_seconds >= 30",
    "burst_sleep_structure": """burst_count >= 2 AND avg_burst_size >= 2 AND avg_sleep_duration_seconds >= 86400
      AND burst_to_idle_ratio <= 0.35::DOUBLE AND (avg_sleep_duration_seconds >= 172800 OR burst_count >= 3)""",
    "constant_size_repetition": f"size_cv <= {T.constant_size_cv_threshold}::DOUBLE AND flow_duration_seconds >= 120",
    "long_low_rate_repetition": """event_count >= 12 AND flow_duration_seconds >= 600
      AND mean_interarrival_seconds BETWEEN 86400 AND 345600""",
    "moderate_jitter_repetition": f"""event_count >= 8 AND inter_arrival_cv <= {T.moderate_jitter_cv_threshold}::DOUBLE
      AND size_cv <= {T.moderate_jitter_size_cv_threshold}::DOUBLE""",
}
RULE_WEIGHT = dict(zip(RULE_SQL, [1.1, 0.5, 0.4, 0.2, 2.0, 1.6, 2.0, 0.5]))
FIRED_SQL = {k: f"coalesce(event_count >= 5 AND {v}, false)" for k, v in RULE_SQL.items()}
SCORE_SQL = " + ".join(f"CASE WHEN {FIRED_SQL[k]} THEN {w}::DOUBLE ELSE 0 END" for k, w in RULE_WEIGHT.items())
REASON_SQL = {
    "low_interarrival_variability": "format('inter-arrival CV {:.3f} <= {:.3f}', inter_arrival_cv, "
    f"{T.periodic_cv_threshold}::DOUBLE)",
    "compact_interarrival_spread": "format('inter-arrival IQR {:.3f}s <= {:.3f}s', interarrival_iqr_seconds, "
    "mean_interarrival_seconds*0.5::DOUBLE)",
    "stable_payload_size": f"format('size CV {{:.3f}} <= {{:.3f}}', size_cv, {T.stable_size_cv_threshold}::DOUBLE)",
    "sustained_repeated_communication": "format('flow duration {:.3f}s >= {:.3f}s', flow_duration_seconds, 30.0::DOUBLE)",
    "burst_sleep_structure": "'repeated bursts separated by longer sleeps'",
    "constant_size_repetition": "'repeated communication has nearly constant payload size'",
    "long_low_rate_repetition": "'many events repeat over a long low-rate flow'",
    "moderate_jitter_repetition": "'timing is moderately regular while size jitter stays bounded'",
}


def _joined_sql(values: dict[str, str]) -> str:
    parts = ", ".join(f"CASE WHEN {FIRED_SQL[k]} THEN {v} END" for k, v in values.items())
    return f"array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ' | ')"


TRIGGERED_SQL = _joined_sql({k: f"'{k}'" for k in RULE_SQL})
REASONS_SQL = _joined_sql(REASON_SQL)
RULED_SQL = f"""{features_sql()},
ru AS (SELECT *, round({SCORE_SQL}, 9) AS score, {TRIGGERED_SQL} AS triggered_rules, {REASONS_SQL} AS top_reasons FROM ff)"""

Q["e01_minimum_event_count"] = lambda s, d: feature_table(s, d).select(
    *OPS_KEY, rl.gate(T).alias("fired"), rl.contributions(T)[0]["reason"].alias("reason"),
    F.size(rl.contributions(T)).alias("rules_evaluated"),
)
S["e01_minimum_event_count"] = f"""WITH {features_sql()} SELECT {KEY}, event_count >= 5 AS fired,
 CASE WHEN event_count >= 5 THEN concat('event_count ', event_count, ' meets minimum 5')
 ELSE concat('event_count ', event_count, ' is below minimum 5') END AS reason,
 CAST(CASE WHEN event_count >= 5 THEN 9 ELSE 1 END AS INT) AS rules_evaluated FROM ff"""


def _rule_query(i):
    def run(s, d):
        part = F.get(rl.contributions(T), F.lit(i))
        f = feature_table(s, d).withColumn("p", part)
        return tidy(
            f.select(
                *OPS_KEY,
                F.coalesce(F.col("p.fired"), F.lit(False)).alias("fired"),
                F.coalesce(F.col("p.score"), F.lit(0.0)).alias("score"),
                F.when(F.col("p.fired"), F.col("p.reason")).alias("reason"),
            )
        )

    return run


for _i, (_id, _rule) in enumerate(
    zip(
        ["e02_low_interarrival_variability", "e03_compact_interarrival_spread", "e04_stable_payload_size",
         "e05_sustained_repeated_communication", "e06_burst_sleep_structure", "e07_constant_size_repetition",
         "e08_long_low_rate_repetition", "e09_moderate_jitter_repetition"],
        RULE_SQL,
    ),
    start=1,
):
    Q[_id] = _rule_query(_i)
    S[_id] = f"""WITH {features_sql()} SELECT {KEY}, {FIRED_SQL[_rule]} AS fired,
 CASE WHEN {FIRED_SQL[_rule]} THEN {RULE_WEIGHT[_rule]}::DOUBLE ELSE 0.0::DOUBLE END AS score,
 CASE WHEN {FIRED_SQL[_rule]} THEN {REASON_SQL[_rule]} END AS reason FROM ff"""

Q["e10_rule_score"] = lambda s, d: tidy(
    rl.detect_rules(feature_table(s, d), T).select(
        *OPS_KEY, "score", "predicted_label", F.array_join(rl.triggered("rule_name"), " | ").alias("triggered_rules"),
        F.array_join(rl.triggered("reason"), " | ").alias("top_reasons"),
    )
)
S["e10_rule_score"] = f"""WITH {RULED_SQL} SELECT {KEY}, {num("score")},
 CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label, triggered_rules, top_reasons FROM ru"""

# --- H: scoring -----------------------------------------------------------------------------------

ISO_SQL = """concat(CASE WHEN {c} % 1000000 = 0 THEN strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S')
 ELSE strftime(make_timestamp({c}), '%Y-%m-%dT%H:%M:%S.%f') END, '+00:00')"""
# A model column for the hybrid queries: a fixed function of the flow, so that SQL can repeat it.
RF_SQL = "(event_count % 10)/10.0::DOUBLE"


def _with_rf(f, threshold=0.65):
    rf = (F.col("event_count") % 10) / 10.0
    return f.withColumns(
        {
            "rf_score": rf,
            "rf_threshold": F.lit(threshold),
            "rf_predicted_label": F.when(rf >= threshold, "beacon").otherwise("benign"),
            "top_model_features": F.lit("event_count"),
        }
    )


def hybrid(s, d):
    return sc.score_flows(_with_rf(feature_table(s, d)), T, with_model=True)


HYBRID_SQL = f"""{RULED_SQL}, hy AS (SELECT *, {RF_SQL} AS rf_score,
 greatest(score/2.2::DOUBLE, {RF_SQL}/0.65::DOUBLE) AS hybrid_score,
 CASE WHEN {RF_SQL} >= 0.65::DOUBLE OR score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label FROM ru)"""

SCORED_SQL = f"""SELECT predicted_label, detector_mode, {num("score")}, {num("threshold")}, {num("hybrid_score")},
 rule_predicted_label, {num("rule_score")}, {num("rule_threshold")}, rf_predicted_label, {num("rf_score")}, {num("rf_threshold")},
 {KEY}, {ISO_SQL.format(c="start_us")} AS first_seen, {ISO_SQL.format(c="end_us")} AS last_seen, event_count, total_bytes,
 {num("mean_interarrival_seconds")}, {num("inter_arrival_cv")}, {num("periodicity_score")}, {num("size_cv")},
 src_ports AS src_ports_seen, triggered_rules, top_model_features"""
RULES_ONLY_SQL = """SELECT *, CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label,
 CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS rule_predicted_label, 'rules_only' AS detector_mode,
 2.2::DOUBLE AS threshold, 2.2::DOUBLE AS rule_threshold, score AS hybrid_score, score AS rule_score,
 CAST(NULL AS VARCHAR) AS rf_predicted_label, CAST(NULL AS DOUBLE) AS rf_score, CAST(NULL AS DOUBLE) AS rf_threshold,
 '' AS top_model_features FROM ru"""

Q["h01_score_job"] = lambda s, d: tidy(sc.scored_table(sc.score_flows(features(s, d), T)))
S["h01_score_job"] = f"WITH {RULED_SQL}, sc AS ({RULES_ONLY_SQL}) {SCORED_SQL} FROM sc"
Q["b04_scored_flows"] = lambda s, d: tidy(sc.scored_table(hybrid(s, d)))
S["b04_scored_flows"] = f"""WITH {HYBRID_SQL}, sc AS (SELECT * EXCLUDE (score), score AS rule_score, hybrid_score AS score,
 1.0::DOUBLE AS threshold, 2.2::DOUBLE AS rule_threshold, 'rules_random_forest_hybrid' AS detector_mode,
 CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS rule_predicted_label,
 CASE WHEN rf_score >= 0.65::DOUBLE THEN 'beacon' ELSE 'benign' END AS rf_predicted_label, 0.65::DOUBLE AS rf_threshold,
 'event_count' AS top_model_features FROM hy) {SCORED_SQL} FROM sc"""

Q["h02_hybrid_score"] = lambda s, d: tidy(hybrid(s, d).select(*OPS_KEY, "rule_score", "rf_score", "hybrid_score", "threshold"))
S["h02_hybrid_score"] = f"""WITH {HYBRID_SQL} SELECT {KEY}, {num("score", "rule_score")}, {num("rf_score")}, {num("hybrid_score")},
 1.0::DOUBLE AS threshold FROM hy"""
Q["h03_final_label"] = lambda s, d: hybrid(s, d).select(*OPS_KEY, "predicted_label", "detector_mode")
S["h03_final_label"] = f"""WITH {HYBRID_SQL} SELECT {KEY}, predicted_label, 'rules_random_forest_hybrid' AS detector_mode FROM hy"""
Q["h04_severity_confidence"] = lambda s, d: tidy(
    sc.score_flows(feature_table(s, d), T).select(*OPS_KEY, sc.severity().alias("severity"), sc.confidence().alias("confidence"))
)
S["h04_severity_confidence"] = f"""WITH {RULED_SQL} SELECT {KEY}, CASE WHEN score-2.2::DOUBLE >= 2 THEN 'critical'
 WHEN score-2.2::DOUBLE >= 1 THEN 'high' ELSE 'medium' END AS severity, {num("least(score/2.2::DOUBLE, 1)", "confidence")} FROM ru"""

RANKED_SQL = """row_number() OVER (ORDER BY score DESC, start_us, src_ip, '', coalesce(direction,''), dst_ip, dst_port, protocol)"""
Q["h05_alert_ranking"] = lambda s, d: tidy(
    sc.rank_alerts(sc.score_flows(feature_table(s, d), T)).select("rank", *OPS_KEY, "score", "severity")
)
S["h05_alert_ranking"] = f"""WITH {RULED_SQL} SELECT {RANKED_SQL} AS rank, {KEY}, {num("score")},
 CASE WHEN score-2.2::DOUBLE >= 2 THEN 'critical' WHEN score-2.2::DOUBLE >= 1 THEN 'high' ELSE 'medium' END AS severity
 FROM ru WHERE score >= 2.2::DOUBLE"""
Q["b03_alerts_table"] = lambda s, d: tidy(sc.rank_alerts(sc.score_flows(feature_table(s, d), T)))
S["b03_alerts_table"] = f"""WITH {RULED_SQL}, sc AS ({RULES_ONLY_SQL}) SELECT {RANKED_SQL} AS rank,
 CASE WHEN score-2.2::DOUBLE >= 2 THEN 'critical' WHEN score-2.2::DOUBLE >= 1 THEN 'high' ELSE 'medium' END AS severity,
 {num("least(score/2.2::DOUBLE, 1)", "confidence")}, detector_mode, {num("score")}, {num("threshold")}, {num("hybrid_score")},
 {num("rule_score")}, {num("rf_score")}, {num("rf_threshold")}, {KEY}, {ISO_SQL.format(c="start_us")} AS first_seen,
 {ISO_SQL.format(c="end_us")} AS last_seen, event_count, total_bytes, src_ports AS src_ports_seen, top_reasons, top_model_features
 FROM sc WHERE score >= 2.2::DOUBLE"""
Q["b06_report_rows"] = lambda s, d: sc.report_rows(sc.rank_alerts(sc.score_flows(feature_table(s, d), T)))
S["b06_report_rows"] = f"""WITH {RULED_SQL}, r AS (SELECT *, {RANKED_SQL} AS rank FROM ru WHERE score >= 2.2::DOUBLE)
 SELECT rank, CASE WHEN score-2.2::DOUBLE >= 2 THEN 'critical' WHEN score-2.2::DOUBLE >= 1 THEN 'high' ELSE 'medium' END AS severity,
 format('{{:.3f}}', score) AS score, concat(src_ip,' ',direction,' ',dst_ip,':',dst_port,'/',protocol) AS flow, event_count,
 top_reasons AS reasons FROM r WHERE rank <= 10"""
Q["h06_reason_strings"] = lambda s, d: hybrid(s, d).select(*OPS_KEY, "triggered_rules", "top_reasons", "top_model_features")
S["h06_reason_strings"] = f"""WITH {HYBRID_SQL} SELECT {KEY}, triggered_rules,
 CASE WHEN rf_score >= 0.65::DOUBLE THEN concat(top_reasons, CASE WHEN top_reasons <> '' THEN ' | ' ELSE '' END,
   format('random forest score {{:.3f}} >= {{:.3f}}', rf_score, 0.65::DOUBLE)) ELSE top_reasons END AS top_reasons,
 'event_count' AS top_model_features FROM hy"""
Q["h07_flow_identity"] = lambda s, d: sc.score_flows(feature_table(s, d), T).select(
    *OPS_KEY, "first_seen", "last_seen", "event_count", "total_bytes", "src_ports_seen"
)
S["h07_flow_identity"] = f"""WITH {features_sql()} SELECT {KEY}, {ISO_SQL.format(c="start_us")} AS first_seen,
 {ISO_SQL.format(c="end_us")} AS last_seen, event_count, total_bytes, src_ports AS src_ports_seen FROM ff"""

