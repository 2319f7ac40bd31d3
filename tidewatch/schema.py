"""Column contracts and default parameters.

The values in this module are fixed values: results are only comparable when names, numbers and
texts are exactly these.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# --- events -----------------------------------------------------------------------------------

REQUIRED = ["timestamp", "src_ip", "direction", "dst_ip", "dst_port", "protocol", "total_bytes"]
OPTIONAL = ["src_port", "duration_seconds", "total_packets", "label"]
PROTOCOLS = ["tcp", "udp"]
LABELS = ["benign", "beacon", "unknown"]

EVENT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("direction", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("total_bytes", T.LongType()),
        T.StructField("src_port", T.StringType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("total_packets", T.LongType()),
        T.StructField("label", T.StringType()),
    ]
)

# --- flow keys --------------------------------------------------------------------------------

FULL_KEY = ["src_ip", "dst_ip", "dst_port", "protocol", "src_port", "direction"]
OPS_KEY = ["src_ip", "dst_ip", "dst_port", "protocol", "direction"]

# --- features ---------------------------------------------------------------------------------

GAP_FEATURES = [
    "mean_interarrival_seconds",
    "median_interarrival_seconds",
    "std_interarrival_seconds",
    "min_interarrival_seconds",
    "max_interarrival_seconds",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "inter_arrival_cv",
    "trimmed_interarrival_cv",
    "near_median_interarrival_fraction",
    "interarrival_within_10pct_median_fraction",
    "interarrival_within_20pct_median_fraction",
    "interarrival_within_30pct_median_fraction",
    "dominant_interval_fraction",
    "dominant_interval_bin_fraction",
    "interval_bin_count",
    "adjacent_gap_similarity_fraction",
    "longest_similar_gap_run",
    "gap_range_median_ratio",
    "interarrival_median_absolute_percentage_deviation",
    "periodicity_score",
]
RATE_FEATURES = ["events_per_second", "events_per_minute"]
BURST_FEATURES = [
    "burst_count",
    "avg_burst_size",
    "max_burst_size",
    "burst_size_variance",
    "avg_sleep_duration_seconds",
    "sleep_duration_variance",
    "burst_size_cv",
    "sleep_duration_cv",
    "within_burst_gap_consistency",
    "burst_to_idle_ratio",
]
SIZE_FEATURES = [
    "mean_size_bytes",
    "median_size_bytes",
    "std_size_bytes",
    "size_cv",
    "dominant_size_bin_fraction",
    "size_bin_count",
    "normalized_size_range",
    "near_median_size_fraction",
]
BASE_FEATURES = ["event_count", "total_bytes", "flow_duration_seconds"]
FEATURES = BASE_FEATURES + GAP_FEATURES + RATE_FEATURES + BURST_FEATURES + SIZE_FEATURES

ZSCORE_FEATURES = [
    "event_count",
    "flow_duration_seconds",
    "inter_arrival_cv",
    "trimmed_interarrival_cv",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "near_median_interarrival_fraction",
    "dominant_interval_fraction",
    "periodicity_score",
    "burst_count",
    "avg_burst_size",
    "burst_to_idle_ratio",
    "size_cv",
]
MODEL_FEATURES = [
    "event_count",
    "flow_duration_seconds",
    "inter_arrival_cv",
    "trimmed_interarrival_cv",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "near_median_interarrival_fraction",
    "interarrival_within_10pct_median_fraction",
    "interarrival_within_20pct_median_fraction",
    "interarrival_within_30pct_median_fraction",
    "dominant_interval_fraction",
    "dominant_interval_bin_fraction",
    "interval_bin_count",
    "adjacent_gap_similarity_fraction",
    "longest_similar_gap_run",
    "gap_range_median_ratio",
    "interarrival_median_absolute_percentage_deviation",
    "periodicity_score",
    "burst_count",
    "avg_burst_size",
    "burst_size_cv",
    "sleep_duration_cv",
    "within_burst_gap_consistency",
    "burst_to_idle_ratio",
    "size_cv",
    "dominant_size_bin_fraction",
    "size_bin_count",
    "normalized_size_range",
    "near_median_size_fraction",
]


@dataclass(frozen=True)
class FeatureParams:
    burst_threshold_seconds: float = 10.0
    timing_tolerance: float = 0.20
    adjacent_tolerance: float = 0.30
    within_burst_tolerance: float = 0.30
    size_tolerance: float = 0.20
    trim_fraction: float = 0.10
    relative_bin_width: float = 0.20
    minimum_bin_width: float = 1.0


@dataclass(frozen=True)
class RuleThresholds:
    min_event_count: int = 5
    min_flow_duration_seconds: float = 30.0
    prediction_threshold: float = 2.2
    periodic_cv_threshold: float = 0.30
    periodic_iqr_fraction_threshold: float = 0.50
    timing_min_event_count: int = 10
    strong_periodic_cv_threshold: float = 0.12
    strong_periodic_iqr_fraction_threshold: float = 0.20
    stable_size_cv_threshold: float = 0.30
    constant_size_cv_threshold: float = 0.02
    constant_size_min_duration_seconds: float = 120.0
    long_repetition_min_event_count: int = 12
    long_repetition_min_duration_seconds: float = 600.0
    long_repetition_min_mean_interarrival_seconds: float = 20.0
    long_repetition_max_mean_interarrival_seconds: float = 240.0
    moderate_jitter_min_event_count: int = 8
    moderate_jitter_cv_threshold: float = 0.18
    moderate_jitter_size_cv_threshold: float = 0.25
    burst_min_count: int = 2
    burst_min_avg_size: float = 2.0
    burst_min_avg_sleep_seconds: float = 30.0
    burst_strong_sleep_seconds: float = 120.0
    burst_repeated_count: int = 3
    burst_max_burst_to_idle_ratio: float = 0.35
    periodic_timing_score: float = 1.1
    compact_timing_spread_score: float = 0.5
    stable_size_score: float = 0.4
    sustained_flow_score: float = 0.2
    burst_structure_score: float = 2.0
    constant_size_repetition_score: float = 1.6
    long_low_rate_repetition_score: float = 2.0
    moderate_jitter_repetition_score: float = 0.5


BASELINE_RULES = RuleThresholds()
HIGH_PRECISION_RULES = replace(BASELINE_RULES, prediction_threshold=2.8)


@dataclass(frozen=True)
class ZScoreParams:
    features: tuple[str, ...] = tuple(ZSCORE_FEATURES)
    benign_score_quantile: float = 0.99
    calibration_fraction: float = 0.25
    min_std: float = 1e-6
    top_k: int = 5


@dataclass(frozen=True)
class AnomalyParams:
    features: tuple[str, ...] = tuple(ZSCORE_FEATURES)
    contamination: float = 0.03
    calibration_fraction: float = 0.25
    trees: int = 200
    seed: int = 42
    neighbors: int = 20
    top_k: int = 5


@dataclass(frozen=True)
class ModelParams:
    features: tuple[str, ...] = tuple(MODEL_FEATURES)
    threshold: float = 0.5
    seed: int = 42
    max_iter: int = 1000
    trees: int = 200
    max_depth: int = 8
    min_leaf: int = 2
    top_k: int = 8


RULE_DETECTOR = "rule_baseline_v2_hardened_final"
ZSCORE_DETECTOR = "statistical_zscore_baseline_v1"
IFOREST_DETECTOR = "isolation_forest_v1"
LOF_DETECTOR = "local_outlier_factor_v1"
LR_DETECTOR = "logistic_regression_v1"
RF_DETECTOR = "random_forest_v1"
DEFAULT_RF_THRESHOLD = 0.65
MODEL_SCHEMA_VERSION = 1

# --- output tables ------------------------------------------------------------------------------

ALERT_COLUMNS = [
    "rank",
    "severity",
    "confidence",
    "detector_mode",
    "score",
    "threshold",
    "hybrid_score",
    "rule_score",
    "rf_score",
    "rf_threshold",
    "src_ip",
    "direction",
    "dst_ip",
    "dst_port",
    "protocol",
    "first_seen",
    "last_seen",
    "event_count",
    "total_bytes",
    "src_ports_seen",
    "top_reasons",
    "top_model_features",
]
SCORED_COLUMNS = [
    "predicted_label",
    "detector_mode",
    "score",
    "threshold",
    "hybrid_score",
    "rule_predicted_label",
    "rule_score",
    "rule_threshold",
    "rf_predicted_label",
    "rf_score",
    "rf_threshold",
    "src_ip",
    "direction",
    "dst_ip",
    "dst_port",
    "protocol",
    "first_seen",
    "last_seen",
    "event_count",
    "total_bytes",
    "mean_interarrival_seconds",
    "inter_arrival_cv",
    "periodicity_score",
    "size_cv",
    "src_ports_seen",
    "triggered_rules",
    "top_model_features",
]
