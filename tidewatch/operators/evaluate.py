"""Evaluation over labelled predictions. Cases, seeds and detectors are columns, so one plan covers
what would otherwise be a loop.

Prediction records carry: detector_name, case_name, seed, scenario_name, true_label,
predicted_label, score, threshold, event_count, triggered_rules, and the flow key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import rate_or_zero
from tidewatch.operators.ranks import group_quantiles

c = F.col
METRICS = ["precision", "recall", "f1", "false_positive_rate"]
RELIABILITY_TARGETS = [0.8, 0.9]
EVIDENCE_COUNTS = [3, 5, 7, 9, 12, 15, 18, 24]
PROFILE_FEATURES = [
    "event_count",
    "flow_duration_seconds",
    "size_cv",
    "normalized_size_range",
    "size_bin_count",
    "dominant_size_bin_fraction",
    "near_median_size_fraction",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "gap_range_median_ratio",
    "interarrival_within_10pct_median_fraction",
    "interarrival_within_20pct_median_fraction",
    "interarrival_within_30pct_median_fraction",
    "dominant_interval_bin_fraction",
    "interval_bin_count",
    "adjacent_gap_similarity_fraction",
    "longest_similar_gap_run",
    "interarrival_median_absolute_percentage_deviation",
]

TRUE, PRED = "true_label", "predicted_label"


def is_beacon(col: str) -> Column:
    return c(col) == "beacon"


def confusion_aggs(predicted: Column | None = None, actual: Column | None = None) -> list[Column]:
    p = is_beacon(PRED) if predicted is None else predicted
    t = is_beacon(TRUE) if actual is None else actual
    return [
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"),
        F.count_if(t & ~p).alias("fn"),
    ]


def with_metrics(d: DataFrame) -> DataFrame:
    """precision, recall, f1, fpr from tp, fp, tn, fn; an empty denominator gives 0."""
    tp, fp, tn, fn = c("tp"), c("fp"), c("tn"), c("fn")
    d = d.withColumns(
        {
            "precision": rate_or_zero(tp, tp + fp),
            "recall": rate_or_zero(tp, tp + fn),
            "false_positive_rate": rate_or_zero(fp, fp + tn),
        }
    )
    p, r = c("precision"), c("recall")
    return d.withColumn("f1", rate_or_zero(2.0 * p * r, p + r))


def classification_metrics(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_metrics(pred.groupBy(*by).agg(*confusion_aggs(), F.count(F.lit(1)).alias("total_flows")))


def metric_spread(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean and population std of the four metrics over seeds or folds."""
    aggs = []
    for m in METRICS:
        aggs += [F.avg(m).alias(f"mean_{m}"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"std_{m}")]
    return metrics.groupBy(*by).agg(*aggs)


def prediction_records(detections: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records from detection rows; the feature columns are on the same row already."""
    return detections.select(
        *keep,
        "detector_name",
        "scenario_name",
        c("label").alias(TRUE),
        PRED,
        "score",
        "threshold",
        "event_count",
        F.array_join(
            F.transform(
                F.filter("contributions", lambda x: x["score"] > 0), lambda x: x["rule_name"]
            ),
            ";",
        ).alias("triggered_rules"),
    )


def scenario_rates(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Predicted beacons over true beacons (over all flows when a scenario has none)."""
    d = pred.withColumn("scenario_name", F.coalesce("scenario_name", F.lit("unknown")))
    d = d.groupBy(*by, "scenario_name").agg(
        F.count(F.lit(1)).alias("total_flows"),
        F.count_if(is_beacon(TRUE)).alias("true_beacon_flows"),
        F.count_if(is_beacon(PRED)).alias("predicted_beacon_flows"),
    )
    base = F.when(c("true_beacon_flows") > 0, c("true_beacon_flows")).otherwise(c("total_flows"))
    return d.withColumn("detection_rate", rate_or_zero(c("predicted_beacon_flows"), base))


def profile_rates(pred: DataFrame, by: Sequence[str] = ("detector_name",)) -> DataFrame:
    d = scenario_rates(pred, by)
    beacon = c("true_beacon_flows") > 0
    return d.select(
        *by,
        c("scenario_name").alias("scenario_or_profile_name"),
        F.when(beacon, "beacon").otherwise("benign_profile").alias("category"),
        F.when(beacon, "detection_rate").otherwise("false_flag_rate").alias("rate_type"),
        c("detection_rate").alias("rate"),
        "total_flows",
        "true_beacon_flows",
        "predicted_beacon_flows",
    )


def failures(pred: DataFrame) -> DataFrame:
    d = pred.filter(c(TRUE) != c(PRED))
    return d.withColumn(
        "failure_type", F.when(is_beacon(PRED), "false_positive").otherwise("false_negative")
    )


def failure_summary(pred: DataFrame) -> DataFrame:
    """False positives and negatives as the export shows them."""
    anomaly = c("detector_name").isin("isolation_forest_v1", "local_outlier_factor_v1")
    return failures(pred).withColumns(
        {
            "scenario_name": F.coalesce("scenario_name", F.lit("unknown")),
            "top_contributors": c("triggered_rules"),
            "top_standardized_feature_deviations": F.when(anomaly, c("triggered_rules")).otherwise(""),
        }
    )


def near_threshold(pred: DataFrame, margin: float) -> DataFrame:
    return pred.filter(F.abs(c("score") - c("threshold")) <= margin)


def top_false_positives(pred: DataFrame, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    d = pred.filter((c(TRUE) == "benign") & is_beacon(PRED))
    return d.orderBy(F.desc("score"), *tie).limit(n)


def top_false_negatives(pred: DataFrame, n: int = 10, tie: Sequence[str] = ()) -> DataFrame:
    d = pred.filter(is_beacon(TRUE) & (c(PRED) == "benign"))
    return d.orderBy("score", *tie).limit(n)


def score_distribution(pred: DataFrame, bucket: float = 0.5, label: str | None = None) -> DataFrame:
    d = pred if label is None else pred.filter(c(TRUE) == label)
    b = F.round(F.floor(c("score") / F.lit(bucket)) * F.lit(bucket), 3)
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def multi_seed(pred: DataFrame, by: Sequence[str] = ("detector_name",)) -> DataFrame:
    """Per group: metrics of all seeds together and their spread over seeds."""
    per_seed = classification_metrics(pred, [*by, "seed"])
    spread = metric_spread(per_seed, by)
    counts = per_seed.groupBy(*by).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "tn", "fn")])
    combined = with_metrics(counts).withColumnsRenamed({m: f"combined_{m}" for m in METRICS})
    if by:
        return spread.join(combined, list(by))
    return spread.crossJoin(combined)  # one row each


def seed_metrics(pred: DataFrame, by: Sequence[str] = ("detector_name",)) -> DataFrame:
    """Per seed and over all seeds (`seed` null), in one pass of grouping sets."""
    sets = [[*map(c, by), c("seed")], [*map(c, by)]]
    d = pred.groupingSets(sets, *by, "seed").agg(*confusion_aggs(), F.count(F.lit(1)).alias("total_flows"))
    return with_metrics(d)


def combined_threshold(pred: DataFrame, by: Sequence[str] = ("detector_name",)) -> DataFrame:
    """Mean of the fitted thresholds over seeds."""
    per_seed = pred.groupBy(*by, "seed").agg(F.max("threshold").alias("threshold"))
    return per_seed.groupBy(*by).agg(F.avg("threshold").alias("combined_threshold"))


def threshold_sweep(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Metrics at each threshold from one pass over the scores: the counts of all thresholds are
    aggregated side by side, then laid out as rows."""
    t = is_beacon(TRUE)
    aggs = []
    for i, th in enumerate(thresholds):
        p = c("score") >= F.lit(float(th))
        aggs += [a.alias(f"{n}{i}") for a, n in zip(confusion_aggs(p, t), ("tp", "fp", "tn", "fn"))]
    d = scored.groupBy(*by).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(th)).alias("threshold"), *[c(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")]
            )
            for i, th in enumerate(thresholds)
        ]
    )
    return with_metrics(d.select(*by, F.explode(rows).alias("r")).select(*by, "r.*"))


def sweep_summary(scored: DataFrame, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Mean metrics over seeds at each threshold."""
    return metric_spread(threshold_sweep(scored, thresholds, [*by, "seed"]), [*by, "threshold"])


def holdout_split(features: DataFrame, exclude: Sequence[str]) -> DataFrame:
    return features.filter(~F.coalesce("scenario_name", F.lit("")).isin(list(exclude)))


def training_counts(training: DataFrame) -> DataFrame:
    return training.agg(
        F.count(F.lit(1)).alias("training_flow_count"),
        F.count_if(c("label") == "beacon").alias("training_beacon_flow_count"),
        F.count_if(c("label") == "benign").alias("training_benign_flow_count"),
    )


def training_table(features: DataFrame, where: Column | None = None) -> DataFrame:
    d = features.filter(c("label").isin("benign", "beacon"))
    return d if where is None else d.filter(where)


def reference_rows(features: DataFrame) -> DataFrame:
    return features.filter(c("label") == "benign")


def _grouped_scores(records: DataFrame, keys: Sequence[str], target: Column, prefix: str) -> DataFrame:
    """Counts, score statistics and rates of a target group, and the benign false positives."""
    score = F.when(target, c("score"))
    hit = is_beacon(PRED)
    benign = c(TRUE) == "benign"
    d = records.groupBy(*keys).agg(
        F.count_if(target).alias(f"{prefix}_flow_count"),
        F.avg(score).alias("mean_score"),
        F.min(score).alias("min_score"),
        F.max(score).alias("max_score"),
        rate_or_zero(F.count_if(target & hit), F.count_if(target)).alias("detection_rate"),
        F.count_if(target & ~hit).alias("false_negative_count"),
        rate_or_zero(F.count_if(benign & hit), F.count_if(benign)).alias("benign_false_positive_rate"),
        F.count_if(benign & hit).alias("benign_false_positive_count"),
    )
    medians = group_quantiles(records.filter(target), keys, "score", {"median_score": 0.5}).drop("n")
    return d.join(medians, list(keys), "left")


def evidence_summary(records: DataFrame) -> DataFrame:
    keys = ["detector_name", "operating_point", "scenario_family", "event_count"]
    return _grouped_scores(records, keys, is_beacon(TRUE), "beacon")


def detection_curve(summary: DataFrame) -> DataFrame:
    return summary.select(
        "detector_name", "operating_point", "scenario_family", "event_count", "detection_rate", "benign_false_positive_rate"
    )


def reliability_threshold(summary: DataFrame, targets: Sequence[float] = tuple(RELIABILITY_TARGETS)) -> DataFrame:
    """Smallest event count from which the detection rate stays at or above each target."""
    keys = ["detector_name", "operating_point", "scenario_family"]
    rest = W.partitionBy(*keys).orderBy("event_count").rowsBetween(0, W.unboundedFollowing)
    d = summary.withColumn("floor", F.min("detection_rate").over(rest))
    d = d.groupBy(*keys).agg(
        *[F.min(F.when(c("floor") >= F.lit(float(t)), c("event_count"))).alias(f"t{i}") for i, t in enumerate(targets)]
    )
    rows = F.array(
        *[
            F.struct(F.lit(float(t)).alias("reliability_target"), c(f"t{i}").alias("first_reliable_event_count"))
            for i, t in enumerate(targets)
        ]
    )
    return d.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def evidence_ladder(events: DataFrame, key: Sequence[str], counts: Sequence[int] = tuple(EVIDENCE_COUNTS)) -> DataFrame:
    """Events of the first k of each flow, for every k the flow can fill; adds `evidence`.

    `row_number() <= max(k)` prunes each flow before the shuffle, so a huge flow sends only its
    first rows.
    """
    from tidewatch.operators.flows import keyed, unkeyed

    key = list(key)
    w = W.partitionBy(*key).orderBy("t_us", "size_bytes", "src_port")
    d = keyed(events, key).withColumn("_i", F.row_number().over(w)).filter(c("_i") <= max(counts))
    d = d.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key)))
    ks = F.filter(F.array(*[F.lit(k) for k in sorted(counts)]), lambda k: (k >= c("_i")) & (k <= c("_n")))
    return unkeyed(d.withColumn("evidence", F.explode(ks)).drop("_i", "_n"), key)


def factor_summary(records: DataFrame, family: str) -> DataFrame:
    keys = ["detector_name", "feature_set", "threshold", "factor_name", "factor_value"]
    return _grouped_scores(records, keys, c("scenario_name") == family, "target")


def diagnostic_group(scope: Column, family: str) -> Column:
    outcome = F.when(is_beacon(PRED), "detected").otherwise("missed")
    middle = (
        F.when(scope == "standard_hardened_grid", "standard")
        .when(scope == "shortcut_stress", "shortcut")
        .otherwise("holdout")
    )
    return F.concat_ws("_", outcome, middle, F.lit(family))


def _value_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    d = rows.groupBy(*keys).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    medians = group_quantiles(rows, keys, value, {"median": 0.5}).drop("n")
    return d.join(medians, list(keys), "left")


def diagnostic_groups(records: DataFrame) -> DataFrame:
    """Score statistics per detector, feature set, threshold, scope and outcome group."""
    keys = ["detector_name", "feature_set", "threshold", "evaluation_scope", "group_name"]
    return _value_summary(records, keys, "score")


def long_features(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    d = rows.select(*keys, *[c(f).cast("double").alias(f) for f in features])
    return d.unpivot(list(keys), list(features), "feature_name", "value")


def diagnostic_features(records: DataFrame, features: Sequence[str] = tuple(PROFILE_FEATURES)) -> DataFrame:
    keys = ["detector_name", "feature_set", "threshold", "evaluation_scope", "group_name"]
    return _value_summary(long_features(records, keys, features), [*keys, "feature_name"], "value")


def lowest_misses(records: DataFrame, n: int = 100, tie: Sequence[str] = ()) -> DataFrame:
    return top_false_negatives(records, n, tie)


def compare_detectors(pred: DataFrame, by: Sequence[str] = ("evaluation_scope", "detector_name", "operating_point")) -> DataFrame:
    d = multi_seed(pred, by)
    return d.select(
        *by,
        *[f"mean_{m}" for m in METRICS],
        *[c(x).alias(f"combined_{x}") for x in ("tp", "fp", "tn", "fn")],
    )


def study_tables(pred: DataFrame, keys: Sequence[str]) -> dict[str, DataFrame]:
    """Summary, per-case and per-profile tables of a study, keyed by its own columns."""
    keys = list(keys)
    return {
        "summary": multi_seed(pred, keys),
        "per_case": classification_metrics(pred, [*keys, "case_name"]),
        "per_profile": profile_rates(pred, keys),
    }
