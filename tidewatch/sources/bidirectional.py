"""Bidirectional flow CSV and research event CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources import text as tx
from tidewatch.sources.normalized import read_rows

# Required header, service names, label prefixes.
BIDIR_COLUMNS = [
    "StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "State", "sTos", "dTos", "TotPkts",
    "TotBytes", "SrcBytes", "Label",
]
SERVICE_PORTS = {
    "http": 80, "https": 443, "domain": 53, "dns": 53, "ntp": 123, "smtp": 25, "imap": 143, "pop3": 110,
}
START_FORMATS = [
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "/"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "-"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "/"),
]


@dataclass(frozen=True)
class LabelPolicy:
    include_background_as_benign: bool = False
    include_to_normal_as_benign: bool = False
    include_to_botnet_as_beacon: bool = False


CONSERVATIVE = LabelPolicy()
BACKGROUND_AS_BENIGN = LabelPolicy(include_background_as_benign=True)
POLICIES = {"conservative": CONSERVATIVE, "background_as_benign_sensitivity": BACKGROUND_AS_BENIGN}


def map_label(raw: Column, policy: LabelPolicy = CONSERVATIVE) -> Column:
    low = F.lower(raw)
    return (
        F.when(low.contains("from-botnet"), "beacon")
        .when(low.contains("from-normal"), "benign")
        .when(low.contains("to-botnet"), "beacon" if policy.include_to_botnet_as_beacon else "skip")
        .when(low.contains("to-normal"), "benign" if policy.include_to_normal_as_benign else "skip")
        .when(low.contains("background"), "benign" if policy.include_background_as_benign else "skip")
        .otherwise("skip")
    )


def label_category(raw: Column) -> Column:
    name = F.lower(F.regexp_replace(F.trim(raw), "^flow=", ""))
    return (
        F.when(name.startswith("from-botnet"), "ctu13_from_botnet")
        .when(name.startswith("to-botnet"), "ctu13_to_botnet")
        .when(name.startswith("from-normal"), "ctu13_from_normal")
        .when(name.startswith("to-normal"), "ctu13_to_normal")
        .when(name.startswith("background"), "ctu13_background")
        .otherwise("ctu13_unknown")
    )


def service_port(raw: Column) -> Column:
    """A port number or service name; hex, octal and binary need their prefix."""
    t = F.lower(F.trim(raw))
    names = F.create_map(*[F.lit(x) for kv in SERVICE_PORTS.items() for x in kv])
    plain = F.when(t.rlike(r"^[+-]?(0+|[1-9][0-9]*)$"), t)
    based = (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(t, F.lit(3)), 16, 10))
        .when(t.rlike("^0o[0-7]+$"), F.conv(F.substr(t, F.lit(3)), 8, 10))
        .when(t.rlike("^0b[01]+$"), F.conv(F.substr(t, F.lit(3)), 2, 10))
    )
    return F.coalesce(F.try_element_at(names, t), F.coalesce(plain, based).try_cast("int"))


def loose_float(raw: Column) -> Column:
    t = F.trim(raw)
    return F.when(~F.lower(t).isin("", "nan", "none", "-") & t.rlike(tx.FLOAT), t.try_cast("double"))


def loose_int(raw: Column) -> Column:
    return loose_float(raw).try_cast("bigint")


def start_time(raw: Column) -> Column:
    t = F.trim(raw)
    out = None
    for pattern, _ in START_FORMATS:
        hit = F.when(t.rlike(pattern), F.translate(t, "/", "-").try_cast("timestamp"))
        out = hit if out is None else F.coalesce(out, hit)
    return out


def parse_values(rows: DataFrame) -> DataFrame:
    """Text rows -> record columns, whatever the label policy. Trimming and parsing are two steps,
    so that a value used in several places is computed once."""
    used = [c.lower() for c in BIDIR_COLUMNS]
    keep = [c for c in rows.columns if c.lower() not in used]
    names = [c for c in BIDIR_COLUMNS if c not in ("sTos", "dTos")]
    d = rows.select(*keep, *[F.trim(F.coalesce(F.col(n), F.lit(""))).alias(f"_{n}") for n in names])
    return d.select(
        *keep,
        start_time(F.col("_StartTime")).alias("ts"),
        loose_float(F.col("_Dur")).alias("duration_seconds"),
        F.lower("_Proto").alias("protocol"),
        F.col("_SrcAddr").alias("src_ip"),
        F.col("_Sport").alias("src_port"),
        F.col("_Dir").alias("direction"),
        F.col("_DstAddr").alias("dst_ip"),
        service_port(F.col("_Dport")).alias("dst_port"),
        F.col("_State").alias("state"),
        loose_int(F.col("_TotPkts")).alias("total_packets"),
        loose_int(F.col("_TotBytes")).alias("total_bytes"),
        loose_int(F.col("_SrcBytes")).alias("src_bytes"),
        F.col("_Label").alias("raw_label"),
        label_category(F.col("_Label")).alias("label_category"),
    )


def judge(d: DataFrame) -> DataFrame:
    """Adds `skip_reason`: the mapped label decides first, then the values."""
    present = ["dst_port", "ts", "duration_seconds", "total_packets", "total_bytes", "src_bytes"]
    usable = F.col("protocol").isin("tcp", "udp") & (F.col("total_bytes") >= 0) & (F.col("total_packets") >= 0)
    for name in present:
        usable = usable & F.col(name).isNotNull()
    reason = F.when(F.col("label") == "skip", F.concat(F.lit("label:"), F.col("label_category"))).when(
        ~F.coalesce(usable, F.lit(False)), "invalid_or_unsupported_schema_value"
    )
    return d.withColumn("skip_reason", reason)


def parse_bidir(rows: DataFrame, policy: LabelPolicy = CONSERVATIVE) -> DataFrame:
    """Text rows -> record columns with the mapped label and `skip_reason`."""
    return judge(parse_values(rows).withColumn("label", map_label(F.col("raw_label"), policy)))


def with_policies(rows: DataFrame, policies: Mapping[str, LabelPolicy]) -> DataFrame:
    """Records under every policy, `policy_name` as a column: values are parsed once."""
    d = parse_values(rows)
    raw = F.col("raw_label")
    cells = [F.struct(F.lit(n).alias("policy_name"), map_label(raw, p).alias("label")) for n, p in policies.items()]
    d = d.select("*", F.explode(F.array(*cells)).alias("_p")).select("*", "_p.policy_name", "_p.label").drop("_p")
    return judge(d)


def read_binetflow(
    spark: SparkSession,
    path: str | Sequence[str],
    scenario_name: str | Column,
    policy: LabelPolicy = CONSERVATIVE,
) -> DataFrame:
    """Records with their skip reason. The scenario is that of all files, or a column, such as a part
    of `source_file`."""
    rows = read_rows(spark, path)
    missing = [c for c in BIDIR_COLUMNS if c not in rows.columns]
    if missing:
        raise ValueError(f"CTU-13 file is missing required columns: {missing}")
    rows = rows.drop("_block", "_order")
    return parse_bidir(rows.drop("scenario_name"), policy).withColumn("scenario_name", F.lit(scenario_name))


def records(parsed: DataFrame) -> DataFrame:
    return parsed.filter("skip_reason IS NULL").drop("skip_reason")


def bidir_events(records_: DataFrame) -> DataFrame:
    """Records as flow events, scenario `<scenario>:<label category>`."""
    keep = [c for c in ("policy_name",) if c in records_.columns]
    return records_.select(
        *keep,
        F.col("scenario_name").alias("ctu_scenario"),
        F.unix_micros("ts").alias("t_us"),
        "src_ip",
        F.nullif("src_port", F.lit("")).alias("src_port"),
        F.nullif("direction", F.lit("")).alias("direction"),
        "dst_ip",
        "dst_port",
        "protocol",
        F.col("total_bytes").alias("size_bytes"),
        "label",
        F.concat_ws(":", "scenario_name", "label_category").alias("scenario_name"),
    )


def parse_summary(parsed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts as rows: kind, key, count. One aggregation over (label, mapped, reason)."""
    per = parsed.groupBy(*by, "raw_label", "label", "skip_reason").agg(F.count(F.lit(1)).alias("count"))
    ok = F.col("skip_reason").isNull()
    kinds = F.array_compact(
        F.array(
            F.struct(F.lit("total_rows").alias("kind"), F.lit("").alias("key")),
            F.struct(F.lit("raw_label").alias("kind"), F.col("raw_label").alias("key")),
            F.when(ok, F.struct(F.lit("parsed_events").alias("kind"), F.lit("").alias("key"))),
            F.when(ok, F.struct(F.lit("mapped_label").alias("kind"), F.col("label").alias("key"))),
            F.when(~ok, F.struct(F.lit("skipped_rows").alias("kind"), F.lit("").alias("key"))),
            F.when(~ok, F.struct(F.lit("skip_reason").alias("kind"), F.col("skip_reason").alias("key"))),
        )
    )
    return (
        per.select(*by, F.explode(kinds).alias("k"), "count")
        .groupBy(*by, "k.kind", "k.key")
        .agg(F.sum("count").alias("count"))
    )


def parse_research(rows: DataFrame) -> DataFrame:
    """Research events: strict protocol and label, blank port and direction are null, a blank
    scenario is `unknown`. `issue` names the first problem."""

    def raw(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    ts = tx.iso_timestamp(F.trim(raw("timestamp")))
    port, size = tx.integer(F.trim(raw("dst_port")), "dst_port"), tx.integer(F.trim(raw("size_bytes")), "size_bytes")
    issue = tx.first_issue(
        F.when(ts.isNull(), F.concat(F.lit("Invalid timestamp: "), F.coalesce(raw("timestamp"), F.lit("")))),
        F.when(port.value.isNull(), F.lit("dst_port must be an integer.")),
        F.when(~F.coalesce(raw("protocol").isin("tcp", "udp"), F.lit(False)), F.lit("Unsupported protocol")),
        F.when(size.value.isNull(), F.lit("size_bytes must be an integer.")),
        F.when(~F.coalesce(raw("label").isin("benign", "beacon"), F.lit(False)), F.lit("Unsupported label")),
    )
    keep = [c for c in ("source_file", "_block", "_order", "row_number") if c in rows.columns]
    return rows.select(
        F.unix_micros(ts).alias("t_us"),
        "src_ip",
        "dst_ip",
        port.value.cast("int").alias("dst_port"),
        "protocol",
        tx.text_or_null(raw("src_port")).alias("src_port"),
        tx.text_or_null(raw("direction")).alias("direction"),
        size.value.alias("size_bytes"),
        "label",
        F.coalesce(tx.text_or_null(raw("scenario_name")), F.lit("unknown")).alias("scenario_name"),
        issue.alias("issue"),
        *keep,
    )


def read_research_events(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    parsed = parse_research(read_rows(spark, path))
    tx.raise_first_issue(parsed, 2, "Invalid event CSV at row")
    return parsed.drop("issue", "source_file", "_block", "_order")
