"""Group events into flows: keys, measures, labels, order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import FULL_KEY, OPS_KEY

# Stands for null in key columns while grouping, so that keys can be joined with plain equality.
ABSENT = "\u0000"


def events_from_operational(events: DataFrame, label_policy: str = "benign") -> DataFrame:
    """Operational events as flow events. `benign` ignores labels (scoring); `event` keeps them
    and rejects anything else (training)."""
    if label_policy == "benign":
        label = F.lit("benign")
    elif label_policy == "event":
        bad = F.raise_error(F.lit("Training events must be labelled benign or beacon."))
        label = F.when(F.col("label").isin("benign", "beacon"), F.col("label")).otherwise(
            bad.cast("string")
        )
    else:
        raise ValueError(f"Unknown label policy: {label_policy}")
    return events.select(
        F.unix_micros("ts").alias("t_us"),
        *OPS_KEY,
        "src_port",
        F.col("total_bytes").alias("size_bytes"),
        label.alias("label"),
        F.lit("operational").alias("scenario_name"),
    )


def keyed(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Replace null key parts by a marker; `unkeyed` puts the nulls back."""
    text = [c for c in key if dict(events.dtypes)[c] == "string"]
    return events.withColumns({c: F.coalesce(F.col(c), F.lit(ABSENT)) for c in text})


def unkeyed(flows: DataFrame, key: Sequence[str]) -> DataFrame:
    text = [c for c in key if dict(flows.dtypes)[c] == "string"]
    return flows.withColumns({c: F.nullif(F.col(c), F.lit(ABSENT)) for c in text})


def measure_aggs(columns: Sequence[str], key: Sequence[str]) -> list[Column]:
    """Mergeable per-flow aggregates: Spark combines them before the shuffle."""
    aggs = [
        F.count("t_us").alias("event_count"),
        F.min("t_us").alias("start_us"),
        F.max("t_us").alias("end_us"),
        F.sum("size_bytes").cast("bigint").alias("total_bytes"),
    ]
    if "label" in columns:
        aggs += [
            F.count_if(F.col("label") == "benign").alias("benign_events"),
            F.count_if(F.col("label") == "beacon").alias("beacon_events"),
            F.when(F.min("label") == F.max("label"), F.min("label")).alias("label"),
        ]
    if "scenario_name" in columns:
        aggs.append(
            F.array_join(F.array_sort(F.collect_set("scenario_name")), ",").alias("scenario_name")
        )
    if "src_port" in columns and "src_port" not in key:
        # at most 65,536 distinct ports
        aggs.append(
            F.array_sort(F.collect_set(F.when(F.col("src_port") != "", F.col("src_port")))).alias(
                "src_ports"
            )
        )
    return aggs


def build_flows(events: DataFrame, key: Sequence[str] = FULL_KEY) -> DataFrame:
    """One row per flow with its measures. A single-label flow carries `label`, a mixed one null."""
    k = keyed(events, key)
    flows = k.groupBy(*key).agg(*measure_aggs(events.columns, key))
    return unkeyed(flows, key).withColumn(
        "flow_duration_seconds", (F.col("end_us") - F.col("start_us")) / F.lit(1e6)
    )


def build_operational_flows(events: DataFrame, label_policy: str = "benign") -> DataFrame:
    return build_flows(events_from_operational(events, label_policy), OPS_KEY)


def order_columns(columns: Sequence[str]) -> list[Column]:
    """start, source, source port, direction, destination; then port and protocol to break ties."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in columns else F.lit("")

    return [
        F.col("start_us"),
        F.col("src_ip"),
        text("src_port"),
        text("direction"),
        F.col("dst_ip"),
        F.col("dst_port"),
        F.col("protocol"),
    ]


def order_flows(flows: DataFrame) -> DataFrame:
    """Flows in report order (a range-partitioned sort)."""
    return flows.orderBy(*order_columns(flows.columns))


def flow_key_text(direction: Column | None = None) -> Column:
    d = F.coalesce(F.col("direction") if direction is None else direction, F.lit(""))
    return F.concat(
        F.col("src_ip"),
        F.lit("|"),
        d,
        F.lit("|"),
        F.col("dst_ip"),
        F.lit(":"),
        F.col("dst_port").cast("string"),
        F.lit("/"),
        F.col("protocol"),
    )


def apply_mixed_policy(flows: DataFrame, policy: str) -> DataFrame:
    """Flows whose events disagree on the label: `reject` fails the job, `drop` leaves them out."""
    mixed = (F.col("benign_events") > 0) & (F.col("beacon_events") > 0)
    if policy == "drop":
        return flows.filter(~mixed)
    if policy == "reject":
        msg = F.concat(F.lit("Mixed-label flow: "), flow_key_text())
        return flows.withColumn(
            "label", F.when(mixed, F.raise_error(msg).cast("string")).otherwise(F.col("label"))
        )
    if policy == "keep":
        return flows
    raise ValueError(f"Unknown mixed-label policy: {policy}")


def mixed_flow_counts(flows: DataFrame) -> DataFrame:
    mixed = (F.col("benign_events") > 0) & (F.col("beacon_events") > 0)
    return flows.agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.count_if(mixed).alias("dropped_mixed_label_flows"),
    )
