"""Bidirectional-flow datasets: native features, splits, roll-ups, distributions and shifts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.evaluate import confusion_aggs, long_features, with_metrics
from tidewatch.operators.features import flow_features
from tidewatch.operators.ranks import group_quantiles, hash_rank, with_rank
from tidewatch.operators.zscore import stable_key
from tidewatch.schema import FULL_KEY, FeatureParams
from tidewatch.sources.bidirectional import bidir_events, records

c = F.col

# Fixed values.
NATIVE_FEATURES = [
    "duration_seconds",
    "total_packets",
    "total_bytes",
    "src_bytes",
    "dst_bytes",
    "src_byte_ratio",
    "dst_byte_ratio",
    "packets_per_second",
    "bytes_per_second",
    "mean_packet_size_bytes",
    "src_bytes_per_packet",
    "dst_bytes_per_packet",
    "dst_port",
    "protocol_tcp",
    "protocol_udp",
    "is_web_port",
    "is_dns_port",
    "is_ntp_port",
    "is_ctu_common_port",
]
DISTRIBUTION_FEATURES = [
    "event_count",
    "flow_duration_seconds",
    "total_bytes",
    "size_cv",
    "normalized_size_range",
    "size_bin_count",
    "dominant_size_bin_fraction",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "gap_range_median_ratio",
    "near_median_interarrival_fraction",
    "interarrival_within_20pct_median_fraction",
    "dominant_interval_bin_fraction",
]
COMPARISONS = [
    ("synthetic_benign_vs_ctu_from_normal", "synthetic_benign", "ctu_from_normal"),
    ("synthetic_benign_vs_ctu_background", "synthetic_benign", "ctu_background"),
    ("synthetic_beacon_vs_ctu_from_botnet", "synthetic_beacon", "ctu_from_botnet"),
]
COMMON_PORTS = [13363, 19083]


def _over(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def service_bucket(port: Column, with_imaps: bool = False) -> Column:
    out = F.when(port == 53, "dns_53").when(port == 80, "http_80").when(port == 123, "ntp_123").when(port == 443, "https_443")
    if with_imaps:
        out = out.when(port == 993, "imaps_993")
    return (
        out.when(port.isin(COMMON_PORTS), F.concat(F.lit("ctu_common_"), port.cast("string")))
        .when(port < 1024, "other_well_known_0_1023")
        .when(port < 49152, "registered_1024_49151")
        .otherwise("ephemeral_49152_plus")
    )


def native_features(records_: DataFrame) -> DataFrame:
    """Per-record features: arithmetic on the row, no shuffle."""
    zero = F.lit(0)
    total, packets = F.greatest(zero, c("total_bytes")), F.greatest(zero, c("total_packets"))
    dur = F.greatest(F.lit(0.0), c("duration_seconds"))
    src, dst = c("src_bytes"), F.greatest(zero, c("total_bytes") - c("src_bytes"))
    port = c("dst_port")
    keep = [x for x in ("policy_name", "record_id") if x in records_.columns]
    return records_.select(
        *keep,
        "scenario_name",
        "label",
        c("label_category").alias("label_group"),
        "protocol",
        "state",
        "dst_port",
        service_bucket(port).alias("service_bucket"),
        dur.alias("duration_seconds"),
        packets.alias("total_packets"),
        total.alias("total_bytes"),
        F.greatest(zero, src).alias("src_bytes"),
        dst.alias("dst_bytes"),
        _over(src, total).alias("src_byte_ratio"),
        _over(dst, total).alias("dst_byte_ratio"),
        _over(packets, dur).alias("packets_per_second"),
        _over(total, dur).alias("bytes_per_second"),
        _over(total, packets).alias("mean_packet_size_bytes"),
        _over(src, packets).alias("src_bytes_per_packet"),
        _over(dst, packets).alias("dst_bytes_per_packet"),
        (c("protocol") == "tcp").cast("int").alias("protocol_tcp"),
        (c("protocol") == "udp").cast("int").alias("protocol_udp"),
        port.isin(80, 443, 8080, 8443).cast("int").alias("is_web_port"),
        (port == 53).cast("int").alias("is_dns_port"),
        (port == 123).cast("int").alias("is_ntp_port"),
        port.isin(COMMON_PORTS).cast("int").alias("is_ctu_common_port"),
    )


def cap_rows(df: DataFrame, group: Column, n: int | None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keep the first n rows of a group in hash order and all other rows; and count the dropped.

    The cap is the operator: the reference bounds background rows before its outlier model."""
    by = list(by)
    keyed = df.withColumn("row_key", stable_key(df.columns))
    if n is None:
        none = F.lit(0).cast("bigint")
        return keyed, keyed.groupBy(*by).agg(none.alias("capped_background_benign_flow_count"))
    d = keyed.withColumn("_g", F.coalesce(group, F.lit(False)))
    ranked = hash_rank(d, "row_key", "_rank", "_n", [*by, "_g"])
    kept = ranked.filter(~c("_g") | (c("_rank") <= n)).drop("_rank", "_n", "_g")
    dropped = ranked.groupBy(*by).agg(
        F.count_if(c("_g") & (c("_rank") > n)).alias("capped_background_benign_flow_count")
    )
    return kept, dropped


def is_background() -> Column:
    return (c("label") == "benign") & F.coalesce("scenario_name", F.lit("")).endswith(":ctu13_background")


def split_reference_eval(df: DataFrame, fraction: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """`role`: benign rows by hash order, the first max(2, int(f*n)) are reference; the remaining
    benign rows and all beacons are evaluation."""
    d = df if "row_key" in df.columns else df.withColumn("row_key", stable_key(df.columns))
    ranked = hash_rank(d, "row_key", "_rank", "_n", [*by, "label"])
    cut = F.greatest(F.lit(2), F.floor(c("_n") * F.lit(float(fraction))))
    ref = (c("label") == "benign") & (c("_rank") <= cut)
    return ranked.filter(c("label").isin("benign", "beacon")).withColumn(
        "role", F.when(ref, "reference").otherwise("evaluation")
    ).drop("_rank", "_n")


def bidir_features(
    records_: DataFrame, params: FeatureParams = FeatureParams(), by: Sequence[str] = (), mixed: str = "drop"
) -> DataFrame:
    """Flow features on the full key within each scenario; mixed-label flows are dropped."""
    key = [*by, "ctu_scenario", *FULL_KEY]
    return flow_features(bidir_events(records_), params, key=key, mixed=mixed)


def bidir_dataset(
    parsed: DataFrame,
    params: FeatureParams = FeatureParams(),
    max_background: int | None = None,
    fraction: float = 0.5,
) -> DataFrame:
    """Records -> flows -> features -> cap -> split, per scenario."""
    f = bidir_features(records(parsed), params)
    kept, _ = cap_rows(f, is_background(), max_background, ["ctu_scenario"])
    return split_reference_eval(kept, fraction, ["ctu_scenario"])


def native_key() -> Column:
    """sha256 of a native row's identity. Numbers as fixed decimal text."""
    text = lambda x: c(x).cast("string")
    parts = ["scenario_name", "label_group", "protocol", "state"]
    nums = ["total_packets", "total_bytes", "src_bytes"]
    return F.sha2(
        F.concat_ws(
            "|",
            *[c(p) for p in parts],
            text("dst_port"),
            F.call_function("format_number", c("duration_seconds"), F.lit("0.000000")),
            *[text(n) for n in nums],
            c("label"),
        ),
        256,
    )


def native_split(df: DataFrame, fraction: float = 0.5, tie: Sequence[str] = ("record_id",)) -> DataFrame:
    """`role` array: benign rows in key order -> reference, calibration, evaluation; beacons are
    evaluation. Two benign rows serve as reference and calibration both.

    Equal records share a key, so a whole share of the input may be one key: ranks come from a
    range-partitioned sort on (key, tie), which splits such a run of copies.
    """
    keyed = df.withColumn("row_key", native_key())
    benign = with_rank(keyed.filter(c("label") == "benign"), ["row_key", *tie], "_rank")
    n = benign.agg(F.count(F.lit(1)).alias("_n"))
    d = benign.crossJoin(F.broadcast(n))  # one row
    cut = F.least(F.greatest(F.lit(2), F.floor(c("_n") * F.lit(float(fraction)))), c("_n") - 1)
    cal = F.greatest(F.lit(1), F.floor((c("_n") - cut) / 2))
    role = (
        F.when(c("_n") < 3, F.array(F.lit("reference"), F.lit("calibration")))
        .when(c("_rank") <= cut, F.array(F.lit("reference")))
        .when(c("_rank") <= cut + cal, F.array(F.lit("calibration")))
        .otherwise(F.array(F.lit("evaluation")))
    )
    d = d.withColumn("role", role).drop("_rank", "_n")
    beacons = keyed.filter(c("label") == "beacon").withColumn("role", F.array(F.lit("evaluation")))
    return d.unionByName(beacons)


def compatibility_table(detectors: DataFrame, incompatible: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Detector rows next to rows of detectors that cannot use the native columns (null metrics)."""
    spark = detectors.sparkSession
    rows = spark.createDataFrame(
        [(a, b, "ctu_native", "not_schema_compatible", n) for a, b, n in incompatible],
        "detector_name string, operating_point string, feature_path string, compatibility_status string, "
        "compatibility_notes string",
    )
    ok = detectors.withColumns(
        {
            "feature_path": F.lit("ctu_native"),
            "compatibility_status": F.lit("compatible_unsupervised_reference"),
            "compatibility_notes": F.lit("Uses native numeric fields with a held-out benign reference."),
        }
    )
    return ok.unionByName(rows, allowMissingColumns=True)


def scenario_names(df: DataFrame, scenario: str = "scenario_name") -> list[str]:
    """The scenarios, one per input capture; they name the folds, so the list is collected."""
    names = sorted(r[0] for r in df.select(scenario).distinct().collect())
    if len(names) < 2:
        raise ValueError("At least two CTU scenarios are required for scenario-aware splits.")
    return names


def leave_one_out(df: DataFrame, scenario: str = "scenario_name") -> DataFrame:
    """Every row once per scenario, with `fold_name`, `test_scenario` and `role`."""
    names = scenario_names(df, scenario)
    d = df.withColumn("test_scenario", F.explode(F.array(*[F.lit(n) for n in names])))
    return d.withColumns(
        {
            "fold_name": F.concat(F.lit("test_"), c("test_scenario")),
            "role": F.when(c(scenario) == c("test_scenario"), "test").otherwise("train"),
        }
    )


def split_scenario(col: Column) -> tuple[Column, Column]:
    """`scenario:group` -> (scenario, group), `unknown` where missing."""
    parts = F.split(col, ":", 2)
    empty = col.isNull() | (col == "")
    scenario = F.when(empty, "unknown").otherwise(parts[0])
    group = F.when(empty | ~col.contains(":"), "unknown").otherwise(F.get(parts, F.lit(1)))
    return scenario, group


def transfer_records(detections: DataFrame, operating_point: Column) -> DataFrame:
    """Detection rows as records with scenario and label group."""
    scenario, group = split_scenario(c("scenario_name"))
    keep = [x for x in ("policy_name",) if x in detections.columns]
    return detections.select(
        *keep,
        "detector_name",
        operating_point.alias("operating_point"),
        scenario.alias("ctu_scenario"),
        group.alias("label_group"),
        "scenario_name",
        c("label").alias("true_label"),
        "predicted_label",
        "score",
        "event_count",
        "protocol",
        "dst_port",
        "total_bytes",
        "flow_duration_seconds",
        "mean_size_bytes",
        "size_cv",
    )


def scenario_rollup(pred: DataFrame, by: Sequence[str] = ("detector_name", "operating_point")) -> DataFrame:
    """Metrics per scenario (`all`) and per scenario and label group, in one pass."""
    by = list(by)
    sets = [[*map(c, by), c("ctu_scenario")], [*map(c, by), c("ctu_scenario"), c("label_group")]]
    d = pred.groupingSets(sets, *by, "ctu_scenario", "label_group").agg(
        *confusion_aggs(), F.count(F.lit(1)).alias("flow_count"), F.grouping("label_group").alias("_all")
    )
    d = d.withColumn("label_group", F.when(c("_all") == 1, "all").otherwise(c("label_group")))
    return with_metrics(d.drop("_all"))


def failure_groups(pred: DataFrame, keys: Sequence[str], means: Sequence[str], predicted: str = "beacon") -> DataFrame:
    """Failures counted per key with means of the present values."""
    wrong = (c("predicted_label") == predicted) & (c("true_label") != predicted)
    name = "false_positive_count" if predicted == "beacon" else "false_negative_count"
    return pred.filter(wrong).groupBy(*keys).agg(
        F.count(F.lit(1)).alias(name), *[F.avg(m).alias(f"mean_{m}") for m in means]
    )


def combine(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics over all scenarios per detector. Different operating points are listed sorted."""
    points = F.array_sort(F.collect_set("operating_point"))
    d = pred.groupBy(*by, "detector_name").agg(*confusion_aggs(), points.alias("_p"))
    text = F.when(F.size("_p") == 1, c("_p")[0]).otherwise(
        F.concat(F.lit("per_scenario_calibrated;"), F.array_join("_p", ";"))
    )
    return with_metrics(d.withColumn("operating_point", text).drop("_p"))


def policy_sensitivity(pred: DataFrame, counts: DataFrame) -> DataFrame:
    """Metrics per policy and detector next to the policy's row counts."""
    m = with_metrics(pred.groupBy("policy_name", "detector_name", "operating_point").agg(*confusion_aggs()))
    return m.join(counts, "policy_name")


def policy_counts(parsed: DataFrame, features: DataFrame, dropped: DataFrame) -> DataFrame:
    p = parsed.groupBy("policy_name").agg(
        F.count_if(c("skip_reason").isNull()).alias("parsed_events"),
        F.count_if(c("skip_reason").isNotNull()).alias("skipped_rows"),
    )
    f = features.groupBy("policy_name").agg(F.count(F.lit(1)).alias("feature_rows"))
    x = dropped.groupBy("policy_name").agg(
        F.sum("capped_background_benign_flow_count").alias("capped_background_benign_flows")
    )
    return p.join(f, "policy_name").join(x, "policy_name")


def diag_group(df: DataFrame, source_family: str) -> DataFrame:
    """`group_name` and `source_family`; rows of no group are left out."""
    if source_family == "synthetic":
        g = F.when(c("label") == "beacon", "synthetic_beacon").otherwise("synthetic_benign")
    else:
        s = F.coalesce("scenario_name", F.lit(""))
        g = (
            F.when(s.contains("ctu13_from_botnet"), "ctu_from_botnet")
            .when(s.contains("ctu13_from_normal"), "ctu_from_normal")
            .when(s.contains("ctu13_background"), "ctu_background")
        )
    return df.withColumns({"group_name": g, "source_family": F.lit(source_family)}).filter("group_name IS NOT NULL")


PROBS = {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}


def distribution_summary(df: DataFrame, features: Sequence[str], keys: Sequence[str], slice_: str) -> DataFrame:
    """Count, missing, mean, quantiles, std, min, max per group, slice (and `pooled`) and feature."""
    keys = list(keys)
    rows = df.withColumn(slice_, F.explode(F.array(F.lit("pooled"), c(slice_)))).filter(c(slice_).isNotNull())
    long = long_features(rows, [*keys, slice_], features)
    by = [*keys, slice_, "feature_name"]
    d = long.groupBy(*by).agg(
        F.count("value").alias("count"),
        F.count_if(c("value").isNull()).alias("missing_count"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = group_quantiles(long, by, "value", PROBS).drop("n")
    return d.join(q, by, "left")


def shift_ranking(summary: DataFrame, comparisons: Sequence[tuple[str, str, str]] = tuple(COMPARISONS)) -> DataFrame:
    """Normalized median shift between group pairs, ranked within a comparison. `summary` holds the
    pooled rows of distribution_summary."""
    spark = summary.sparkSession
    pairs = spark.createDataFrame(list(comparisons), "comparison string, left_group string, right_group string")
    s = summary.filter(c("count") > 0).select(
        "group_name", "feature_name", "count", "median", "mean", (c("p75") - c("p25")).alias("iqr")
    )

    def side(name: str) -> DataFrame:
        return s.select(
            c("group_name").alias(f"{name}_group"),
            "feature_name",
            *[c(x).alias(f"{name}_{x}") for x in ("count", "median", "mean", "iqr")],
        )

    d = side("left").join(F.broadcast(pairs), "left_group").join(side("right"), ["right_group", "feature_name"])
    diff = F.abs(c("left_median") - c("right_median"))
    pooled = (c("left_iqr") + c("right_iqr")) / 2.0
    scale = F.when(pooled > 0, pooled).otherwise(
        F.greatest(F.abs("left_median"), F.abs("right_median"), F.lit(1.0))
    )
    d = d.withColumns(
        {"median_absolute_difference": diff, "pooled_iqr": pooled, "normalized_median_shift": diff / scale}
    )
    # as many rows as comparisons times features
    w = W.partitionBy("comparison").orderBy(F.desc("normalized_median_shift"), "feature_name")
    return d.withColumn("rank", F.row_number().over(w)).drop("left_iqr", "right_iqr")


def port_share(df: DataFrame) -> DataFrame:
    """Flow count and share of the group total per protocol and port."""
    group = ["group_name", "source_family", "ctu_scenario"]
    d = df.withColumns(
        {
            "ctu_scenario": F.coalesce("ctu_scenario", F.lit("synthetic")),
            "dst_port_bucket": service_bucket(c("dst_port"), with_imaps=True),
        }
    )
    d = d.groupBy(*group, "protocol", "dst_port", "dst_port_bucket").agg(F.count(F.lit(1)).alias("flow_count"))
    # at most 2 x 65,536 counted rows per group
    return d.withColumn("group_share", c("flow_count") / F.sum("flow_count").over(W.partitionBy(*group)))


def label_mapping(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("raw_label", c("label").alias("mapped_label")).agg(F.count(F.lit(1)).alias("row_count"))
