"""Registered queries: sources, sinks' tables and bidirectional-flow operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from tidewatch.operators import bidir as bd
from tidewatch.operators import evaluate as ev
from tidewatch.operators import rules as rl
from tidewatch.operators import scoring as sc
from tidewatch.operators.ranks import ensure_checkpoint_dir
from tidewatch.plans.common import (
    RULES,
    as_integers,
    events,
    feature_select,
    feature_table,
    features_sql,
    num,
    stored,
    tidy,
)
from tidewatch.plans.q_eval import CONF_SQL, MET_OUT, MET_SQL
from tidewatch.plans.q_flows import ISO_SQL, RULED_SQL, SCORE_SQL
from tidewatch.plans.views import BIDIR_TEXT_SQL, EVENT_TEXT_SQL, FLOW_EVENTS_SQL, bidir_text, event_text
from tidewatch.schema import FEATURES, FULL_KEY, FeatureParams
from tidewatch.sources import bidirectional as bi
from tidewatch.sources import flowlogs as fg
from tidewatch.sources import normalized as nm
from tidewatch.sources import sinks as sk
from tidewatch.sources import text as tx

Q: dict = {}
S: dict = {}

# --- A: sources -----------------------------------------------------------------------------------

INT_RE = r"^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ISO_RE = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?$"


def _tok(c: str, tokens: str = "''") -> str:
    return f"CASE WHEN trim({c}) IN ({tokens}) THEN NULL ELSE trim({c}) END"


NORM_SQL = f"""tx AS ({EVENT_TEXT_SQL}),
tr AS (SELECT row_number, {', '.join(f'{_tok(x)} AS {x}' for x in ('timestamp', 'src_ip', 'direction', 'dst_ip', 'dst_port',
 'protocol', 'total_bytes', 'src_port', 'duration_seconds', 'total_packets', 'label'))} FROM tx),
nm AS (SELECT *, CASE
 WHEN timestamp IS NULL THEN 'timestamp is required.'
 WHEN NOT regexp_matches(timestamp, '{ISO_RE}') THEN concat('timestamp is not ISO-8601: ', timestamp)
 WHEN src_ip IS NULL THEN 'src_ip is required.' WHEN direction IS NULL THEN 'direction is required.'
 WHEN dst_ip IS NULL THEN 'dst_ip is required.' WHEN dst_port IS NULL THEN 'dst_port is required.'
 WHEN NOT regexp_matches(dst_port, '{INT_RE}') THEN 'dst_port must be an integer.'
 WHEN TRY_CAST(dst_port AS BIGINT) NOT BETWEEN 0 AND 65535 THEN 'dst_port must be between 0 and 65535.'
 WHEN protocol IS NULL THEN 'protocol is required.'
 WHEN lower(protocol) NOT IN ('tcp','udp') THEN concat('Unsupported protocol: ', protocol)
 WHEN total_bytes IS NULL THEN 'total_bytes is required.'
 WHEN NOT regexp_matches(total_bytes, '{INT_RE}') THEN 'total_bytes must be an integer.'
 WHEN TRY_CAST(total_bytes AS BIGINT) < 0 THEN 'total_bytes must be non-negative.'
 WHEN NOT regexp_matches(total_packets, '{INT_RE}') THEN 'total_packets must be an integer.'
 WHEN TRY_CAST(total_packets AS BIGINT) < 0 THEN 'total_packets must be non-negative.'
 WHEN NOT regexp_matches(duration_seconds, '{FLOAT_RE}') THEN 'duration_seconds must be numeric.'
 WHEN TRY_CAST(duration_seconds AS DOUBLE) < 0 THEN 'duration_seconds must be non-negative.'
 WHEN lower(label) NOT IN ('benign','beacon','unknown') THEN concat('Unsupported label: ', label)
 WHEN TRY_CAST(src_port AS BIGINT) NOT BETWEEN 0 AND 65535 THEN 'src_port must be between 0 and 65535.' END AS issue FROM tr)"""
NORM_COLS = ["row_number", "t_us", "src_ip", "direction", "dst_ip", "dst_port", "protocol", "total_bytes", "src_port",
             "duration_seconds", "total_packets", "label"]
NORM_OUT = f"""row_number, epoch_us(CAST(replace(timestamp, 'Z', '') AS TIMESTAMP)) AS t_us, src_ip, direction, dst_ip,
 CAST(dst_port AS INT) AS dst_port, lower(protocol) AS protocol, CAST(total_bytes AS BIGINT) AS total_bytes, src_port,
 {num('TRY_CAST(duration_seconds AS DOUBLE)', 'duration_seconds')}, CAST(total_packets AS BIGINT) AS total_packets, label"""


def _folder(s, name):
    """A new folder that all executors share."""
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def csv_files(s, rows, name, *by):
    """The rows written as CSV files with headers, in folders by the columns of `by`."""
    path = _folder(s, name)
    exact = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**exact).partitionBy(*by).csv(path)
    return path


def zeek_files(s, rows):
    """The rows written as logs, each with its #fields line."""
    names = rows.columns

    def headed(batches):
        head = ["#separator \\x09", "\t".join(["#fields", *names])]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([*head, *b.column(0).to_pylist()], pa.string())], names=["value"])
            head = []

    path = _folder(s, "zeek")
    line = F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in names])
    rows.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)
    return path


def numbered(df):
    """Files carry the number of a row as text."""
    return df.withColumn("row_number", F.col("row_number").cast("bigint"))


def _normalized(s, d):
    p = numbered(nm.read_normalized(s, csv_files(s, event_text(s, d), "normalized"), mode="collect")).filter("issue IS NULL")
    return tidy(p.withColumn("t_us", F.unix_micros("ts")).select(*NORM_COLS))


Q["a01_read_normalized"] = _normalized
S["a01_read_normalized"] = f"WITH {NORM_SQL} SELECT {NORM_OUT} FROM nm WHERE issue IS NULL"
Q["a02_validate_normalized"] = lambda s, d: nm.validate_normalized(event_text(s, d))[0]
S["a02_validate_normalized"] = f"WITH {NORM_SQL} SELECT row_number, CAST(NULL AS VARCHAR) AS column, issue AS message FROM nm WHERE issue IS NOT NULL"
Q["a02_validation_counts"] = lambda s, d: nm.validate_normalized(event_text(s, d))[1]
S["a02_validation_counts"] = f"WITH {NORM_SQL} SELECT count(*) AS row_count, count(*) FILTER (issue IS NULL) AS valid_row_count FROM nm"


def _labelled(s, d):
    t = event_text(s, d).withColumnRenamed("label", "truth")
    t = t.withColumn("truth", F.when(F.col("row_number") % 5 == 0, "").otherwise(F.col("truth")))
    return numbered(nm.read_normalized(s, csv_files(s, t, "labelled"), True, "truth", mode="collect")).select("row_number", "label", "issue")


Q["a03_read_labelled_normalized"] = _labelled
_LAB = NORM_SQL.replace(
    f"{_tok('label')} AS label", f"CASE WHEN row_number % 5 = 0 THEN NULL ELSE {_tok('label')} END AS label"
).replace("'Unsupported label: '", "'Unsupported truth: '").replace(
    " WHEN TRY_CAST(src_port", " WHEN label IS NULL THEN 'truth is required.' WHEN TRY_CAST(src_port"
)
S["a03_read_labelled_normalized"] = f"WITH {_LAB} SELECT row_number, lower(label) AS label, issue FROM nm"

TOK = "'', '-', '(empty)'"


def zeek_text(s, d):
    t = event_text(s, d)
    i = F.col("row_number") - 2
    micros = F.when(i % 113 == 0, "later").otherwise(
        F.format_string("%.6f", F.unix_micros(F.col("timestamp").try_cast("timestamp")) / 1e6)
    )
    half = (F.col("total_bytes").cast("bigint") / 2).cast("bigint")
    return t.select(
        "row_number",
        micros.alias("ts"),
        F.col("src_ip").alias("id.orig_h"),
        F.col("src_port").alias("id.orig_p"),
        F.col("dst_ip").alias("id.resp_h"),
        F.col("dst_port").alias("id.resp_p"),
        F.col("protocol").alias("proto"),
        F.when(i % 3 == 0, "(empty)").otherwise(F.col("duration_seconds")).alias("duration"),
        half.cast("string").alias("orig_bytes"),
        F.when(i % 7 == 0, "-").otherwise((F.col("total_bytes").cast("bigint") - half).cast("string")).alias("resp_bytes"),
        F.col("total_packets").alias("orig_pkts"),
        F.lit("-").alias("resp_pkts"),
    )


Q["a04_read_zeek_conn"] = lambda s, d: tidy(
    numbered(fg.read_zeek_conn(s, zeek_files(s, zeek_text(s, d)), mode="collect")).select(
        "row_number", "skip_reason", "issue",
        *[F.when(F.col("skip_reason").isNull() & F.col("issue").isNull(), F.col(x)).alias(x)
          for x in ("src_ip", "dst_ip", "dst_port", "protocol", "src_port", "total_bytes", "total_packets", "duration_seconds")],
        F.when(F.col("skip_reason").isNull() & F.col("issue").isNull(), F.unix_micros("ts")).alias("t_us"),
    )
)
ZEEK_SQL = f"""tx AS ({EVENT_TEXT_SQL}),
zk AS (SELECT row_number, CASE WHEN (row_number-2) % 113 = 0 THEN 'later' ELSE 'ok' END AS ts,
 epoch_us(TRY_CAST(replace(timestamp, 'Z', '') AS TIMESTAMP)) AS t_us,
 {_tok('src_ip', TOK)} AS src_ip, {_tok('src_port', TOK)} AS src_port, {_tok('dst_ip', TOK)} AS dst_ip, {_tok('dst_port', TOK)} AS dst_port,
 lower({_tok('protocol', TOK)}) AS protocol, CASE WHEN (row_number-2) % 3 = 0 THEN NULL ELSE {_tok('duration_seconds', TOK)} END AS dur,
 CAST(total_bytes AS BIGINT) AS tb, CAST(trunc(CAST(total_bytes AS BIGINT)/2) AS BIGINT) AS half, {_tok('total_packets', TOK)} AS pk FROM tx),
zi AS (SELECT *, CASE WHEN protocol NOT IN ('tcp','udp') THEN 'unsupported_protocol' END AS skip_reason,
 CASE WHEN protocol IS NULL THEN 'Zeek conn.log row is missing proto.' WHEN protocol NOT IN ('tcp','udp') THEN NULL
 WHEN CAST(dst_port AS BIGINT) NOT BETWEEN 0 AND 65535 THEN 'id.resp_p must be between 0 and 65535.'
 WHEN NOT regexp_matches(pk, '{INT_RE}') THEN 'orig_pkts must be an integer.'
 WHEN ts = 'later' THEN 'ts must be numeric.' WHEN src_ip IS NULL THEN 'Zeek conn.log row is missing id.orig_h.' END AS issue FROM zk)"""
S["a04_read_zeek_conn"] = f"""WITH {ZEEK_SQL} SELECT row_number, skip_reason, issue, {', '.join(
 f"CASE WHEN skip_reason IS NULL AND issue IS NULL THEN {e} END AS {n}" for n, e in {
  'src_ip': 'src_ip', 'dst_ip': 'dst_ip', 'dst_port': 'TRY_CAST(dst_port AS INT)', 'protocol': 'protocol', 'src_port': 'src_port',
  'total_bytes': 'half + CASE WHEN (row_number-2) % 7 = 0 THEN 0 ELSE tb-half END', 'total_packets': 'coalesce(TRY_CAST(pk AS BIGINT), 0)',
  'duration_seconds': num('TRY_CAST(dur AS DOUBLE)', 'x').rsplit(' AS ', 1)[0], 't_us': 't_us'}.items())} FROM zi"""


def netflow_text(s, d):
    t = event_text(s, d)
    i = F.col("row_number") - 2
    us = F.unix_micros(F.col("timestamp").try_cast("timestamp"))
    return t.select(
        "row_number",
        F.when(i % 3 == 0, F.col("timestamp")).alias("start_time"),
        F.when((i % 3 == 1) & us.isNotNull(), F.format_string("%.3f", us / 1e3)).alias("flowStartMilliseconds"),
        F.when((i % 3 == 2) & us.isNotNull(), F.format_string("%.6f", us / 1e6)).alias("First"),
        F.when(us.isNull(), None)
        .when(i % 5 == 0, F.format_string("%.6f", us / 1e6 + 2.5))
        .when(i % 5 == 1, F.format_string("%.6f", us / 1e6 - 1))
        .alias("last_switched"),
        F.when(i % 2 == 0, "-").otherwise(F.col("src_ip")).alias("src_ip"),
        F.col("src_ip").alias("sourceIPv4Address"),
        F.col("src_port").alias("srcport"),
        F.col("dst_ip").alias("dstaddr"),
        F.col("dst_port").alias("dstport"),
        F.when(i % 97 == 0, "1").when(i % 4 == 0, F.when(F.col("protocol") == "TCP", "6").otherwise("17")).otherwise(F.col("protocol")).alias("proto"),
        F.col("total_bytes").alias("octetDeltaCount"),
        F.col("total_packets").alias("pkts"),
        F.when(i % 5 == 2, F.col("duration_seconds")).alias("dur"),
    )


def _netflow(s, d):
    p = numbered(fg.read_netflow(s, csv_files(s, netflow_text(s, d), "netflow"), mode="collect"))
    ok = F.col("skip_reason").isNull() & F.col("issue").isNull()
    # the three time formats carry milli- or microseconds, so compare at the millisecond
    return tidy(
        p.select(
            "row_number", "skip_reason", "issue",
            *[F.when(ok, F.col(x)).alias(x) for x in ("src_ip", "dst_ip", "dst_port", "protocol", "src_port", "total_bytes", "total_packets")],
            F.when(ok, F.round(F.col("duration_seconds"), 3)).alias("duration_seconds"),
            F.when(ok, F.round(F.unix_micros("ts") / 1000.0).cast("bigint")).alias("t_ms"),
        )
    )


Q["a05_read_netflow_ipfix"] = _netflow
NF_SQL = f"""tx AS ({EVENT_TEXT_SQL}),
nf AS (SELECT row_number, row_number-2 AS i, timestamp, epoch_us(TRY_CAST(replace(timestamp, 'Z', '') AS TIMESTAMP)) AS us,
 {_tok('src_ip', TOK)} AS src_ip, src_port, dst_ip, dst_port, lower(protocol) AS protocol, total_bytes, {_tok('total_packets', TOK)} AS pk,
 CASE WHEN (row_number-2) % 5 = 2 THEN {_tok('duration_seconds', TOK)} END AS dur FROM tx),
ni AS (SELECT *, CASE WHEN protocol NOT IN ('tcp','udp') THEN 'unsupported_protocol' END AS skip_reason,
 CASE WHEN protocol NOT IN ('tcp','udp') THEN NULL
 WHEN us IS NULL AND i % 3 <> 0 THEN concat('NetFlow/IPFIX CSV row ', row_number, ' is missing one of: {", ".join(fg.ALIASES["timestamp"])}.')
 WHEN us IS NULL THEN concat('Invalid isoformat string: ''', timestamp, '''')
 WHEN CAST(dur AS DOUBLE) < 0 THEN 'duration_seconds must be non-negative.'
 WHEN src_ip IS NULL THEN concat('NetFlow/IPFIX CSV row ', row_number, ' is missing one of: {", ".join(fg.ALIASES["src_ip"])}.')
 WHEN CAST(dst_port AS BIGINT) NOT BETWEEN 0 AND 65535 THEN 'dst_port must be between 0 and 65535.'
 WHEN CAST(total_bytes AS BIGINT) < 0 THEN 'total_bytes must be non-negative.'
 WHEN NOT regexp_matches(pk, '{INT_RE}') THEN 'total_packets must be an integer.' END AS issue FROM nf)"""
S["a05_read_netflow_ipfix"] = f"""WITH {NF_SQL} SELECT row_number, skip_reason, issue, {', '.join(
 f"CASE WHEN skip_reason IS NULL AND issue IS NULL THEN {e} END AS {n}" for n, e in {
  'src_ip': 'src_ip', 'dst_ip': 'dst_ip', 'dst_port': 'TRY_CAST(dst_port AS INT)', 'protocol': 'protocol', 'src_port': 'src_port',
  'total_bytes': 'TRY_CAST(total_bytes AS BIGINT)', 'total_packets': 'TRY_CAST(pk AS BIGINT)',
  'duration_seconds': num("round(CASE WHEN i % 5 = 0 THEN 2.5 WHEN i % 5 = 1 THEN 0 WHEN i % 5 = 2 THEN TRY_CAST(dur AS DOUBLE) END, 3)", 'x').rsplit(' AS ', 1)[0],
  't_ms': 'CAST(round(us/1000.0) AS BIGINT)'}.items())} FROM ni"""
Q["a06_flow_timestamp"] = lambda s, d: netflow_text(s, d).select(
    "row_number",
    F.round(F.unix_micros(fg.flow_timestamp(F.coalesce("start_time", "flowStartMilliseconds", "First"), F.lit(False))) / 1000.0)
    .cast("bigint").alias("t_ms"),
)
S["a06_flow_timestamp"] = f"WITH {NF_SQL} SELECT row_number, CAST(round(us/1000.0) AS BIGINT) AS t_ms FROM nf"
Q["a07_flow_duration"] = lambda s, d: tidy(
    events(s, d).select(
        "src_ip", "t_us",
        fg.flow_duration(
            F.when(F.col("size_bytes") % 3 == 0, F.lit(1.25)),
            F.timestamp_micros("t_us"),
            F.when(F.col("size_bytes") % 2 == 0, F.timestamp_micros(F.col("t_us") + F.col("size_bytes") * 1000 - 2000000)),
        ).alias("duration_seconds"),
    )
)
S["a07_flow_duration"] = f"""WITH fe AS ({FLOW_EVENTS_SQL}) SELECT src_ip, t_us, {num(
 "CASE WHEN size_bytes % 3 = 0 THEN 1.25 WHEN size_bytes % 2 = 0 THEN greatest(0, (size_bytes*1000-2000000)/1e6) END", "duration_seconds")} FROM fe"""
Q["a08_ingest_diagnostics"] = lambda s, d: fg.ingest_diagnostics(fg.parse_zeek(zeek_text(s, d))).select(
    "input_row_count", "loaded_event_count", "skipped_row_count",
    F.coalesce(F.col("skipped_row_reasons")["unsupported_protocol"], F.lit(0)).alias("unsupported_protocol"),
)
S["a08_ingest_diagnostics"] = f"""WITH {ZEEK_SQL} SELECT count(*) AS input_row_count, count(*) FILTER (skip_reason IS NULL) AS loaded_event_count,
 count(*) FILTER (skip_reason IS NOT NULL) AS skipped_row_count, count(*) FILTER (skip_reason='unsupported_protocol') AS unsupported_protocol FROM zi"""


def _formats(s, d):
    cols = ["src_ip", "dst_ip", "dst_port", "protocol", "total_bytes", "skip_reason", "issue"]
    paths = {
        "normalized-csv": csv_files(s, event_text(s, d), "normalized"),
        "zeek-conn": zeek_files(s, zeek_text(s, d)),
        "netflow-ipfix-csv": csv_files(s, netflow_text(s, d), "netflow"),
    }
    x = None
    for fmt, path in paths.items():
        r = fg.read_events(s, path, fmt, mode="collect")
        r = r if "skip_reason" in r.columns else r.withColumn("skip_reason", tx.no_issue())
        r = r.select(*cols).withColumn("fmt", F.lit(fmt))
        x = r if x is None else x.unionByName(r)
    return x.groupBy("fmt").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("issue").isNull() & F.col("skip_reason").isNull()).alias("loaded"),
    )


Q["a09_format_dispatch"] = _formats
S["a09_format_dispatch"] = f"""WITH {NORM_SQL}, {ZEEK_SQL[ZEEK_SQL.index('zk AS'):]},
 {NF_SQL[NF_SQL.index('nf AS'):]}
SELECT 'normalized-csv' AS fmt, count(*) AS rows, count(*) FILTER (issue IS NULL) AS loaded FROM nm
UNION ALL SELECT 'zeek-conn', count(*), count(*) FILTER (issue IS NULL AND skip_reason IS NULL) FROM zi
UNION ALL SELECT 'netflow-ipfix-csv', count(*), count(*) FILTER (issue IS NULL AND skip_reason IS NULL) FROM ni"""



def _a16(s, d):
    """The events written as labelled normalized files, read back through a glob and a plain path."""
    from tidewatch.operators.ranks import ensure_checkpoint_dir

    ensure_checkpoint_dir(s)
    root = f"{s.sparkContext.getCheckpointDir()}/contract/{abs(hash(d))}"
    n = sk.to_normalized(events(s, d))
    for name, rows in (("beacon", n.filter("label = 'beacon'")), ("benign", n.filter("label = 'benign'"))):
        rows.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    back = nm.read_normalized(s, [f"{root}/bea*", f"{root}/benign"], require_label=True)
    return back.groupBy("label", "protocol").agg(
        F.count(F.lit(1)).alias("events"), F.sum("total_bytes").alias("total_bytes"), F.min(F.unix_micros("ts")).alias("first_us")
    )


Q["a16_multi_path_input"] = _a16
S["a16_multi_path_input"] = f"""SELECT label, protocol, count(*) AS events, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, min(t_us) AS first_us
 FROM ({FLOW_EVENTS_SQL}) GROUP BY ALL"""

# --- A10..A15: bidirectional and research ---------------------------------------------------------

PORT_SQL = """CASE Dport WHEN 'domain' THEN 53 WHEN 'http' THEN 80 WHEN '0x7b' THEN 123 WHEN '-' THEN NULL ELSE CAST(Dport AS INT) END"""


def label_sql(background: str = "skip") -> str:
    return f"""CASE WHEN contains(lower(Label),'from-botnet') THEN 'beacon' WHEN contains(lower(Label),'from-normal') THEN 'benign'
 WHEN contains(lower(Label),'background') THEN '{background}' ELSE 'skip' END"""


CAT_SQL = """CASE WHEN Label LIKE 'flow=From-Botnet%' THEN 'ctu13_from_botnet' WHEN Label LIKE 'flow=To-Botnet%' THEN 'ctu13_to_botnet'
 WHEN Label LIKE 'flow=From-Normal%' THEN 'ctu13_from_normal' WHEN Label LIKE 'flow=To-Normal%' THEN 'ctu13_to_normal'
 WHEN Label LIKE 'flow=Background%' THEN 'ctu13_background' ELSE 'ctu13_unknown' END"""


def parsed_sql(name: str = "pb", background: str = "skip", policy: str = "conservative") -> str:
    return f"""{name} AS (SELECT '{policy}' AS policy_name, record_id, scenario_name, epoch_us(strptime(StartTime, '%Y/%m/%d %H:%M:%S.%f')) AS t_us,
 CAST(Dur AS DOUBLE) AS duration_seconds, lower(Proto) AS protocol, SrcAddr AS src_ip, Sport AS src_port, Dir AS direction, DstAddr AS dst_ip,
 {PORT_SQL} AS dst_port, State AS state, CAST(CAST(TotPkts AS DOUBLE) AS BIGINT) AS total_packets, CAST(TotBytes AS BIGINT) AS total_bytes,
 CAST(SrcBytes AS BIGINT) AS src_bytes, Label AS raw_label, {label_sql(background)} AS label, {CAT_SQL} AS label_category,
 CASE WHEN {label_sql(background)} = 'skip' THEN concat('label:', {CAT_SQL})
  WHEN lower(Proto) NOT IN ('tcp','udp') OR {PORT_SQL} IS NULL THEN 'invalid_or_unsupported_schema_value' END AS skip_reason
 FROM ({BIDIR_TEXT_SQL}))"""


REC_COLS = ["record_id", "scenario_name", "t_us", "duration_seconds", "protocol", "src_ip", "src_port", "direction", "dst_ip",
            "dst_port", "state", "total_packets", "total_bytes", "src_bytes", "label", "label_category"]
def _binetflow(s, d):
    """One folder of files for each scenario, all read at once."""
    path = csv_files(s, bidir_text(s, d).withColumn("scenario", F.col("scenario_name")), "binetflow", "scenario")
    scenario = F.url_decode(F.regexp_extract("source_file", "/scenario=([^/]*)/", 1))
    read = bi.read_binetflow(s, path, scenario)
    return read.withColumn("record_id", F.col("record_id").cast("bigint"))


Q["a10_read_binetflow"] = lambda s, d: tidy(
    bi.records(_binetflow(s, d)).withColumn("t_us", F.unix_micros("ts")).select(*REC_COLS)
)
S["a10_read_binetflow"] = f"""WITH {parsed_sql()} SELECT {', '.join(num(x) if x == 'duration_seconds' else x for x in REC_COLS)}
 FROM pb WHERE skip_reason IS NULL"""
Q["a11_service_port_names"] = lambda s, d: bidir_text(s, d).groupBy("Dport", bi.service_port(F.col("Dport")).alias("dst_port")).agg(
    F.count(F.lit(1)).alias("rows")
)
S["a11_service_port_names"] = f"SELECT Dport, {PORT_SQL} AS dst_port, count(*) AS rows FROM ({BIDIR_TEXT_SQL}) GROUP BY ALL"


def _a12(s, d):
    pol = {"conservative": bi.CONSERVATIVE, "background": bi.BACKGROUND_AS_BENIGN, "all": bi.LabelPolicy(True, True, True)}
    return bidir_text(s, d).groupBy("Label").agg(F.count(F.lit(1)).alias("rows")).select(
        "Label", "rows", *[bi.map_label(F.col("Label"), p).alias(n) for n, p in pol.items()]
    )


Q["a12_label_policy"] = _a12
S["a12_label_policy"] = f"""SELECT Label, count(*) AS rows, {label_sql()} AS conservative, {label_sql('benign')} AS background,
 CASE WHEN Label LIKE '%Botnet%' THEN 'beacon' WHEN Label LIKE '%Normal%' OR Label LIKE '%Background%' THEN 'benign' ELSE 'skip' END AS "all"
 FROM ({BIDIR_TEXT_SQL}) GROUP BY Label"""
Q["a13_label_category"] = lambda s, d: bidir_text(s, d).groupBy("Label", bi.label_category(F.col("Label")).alias("category")).agg(
    F.count(F.lit(1)).alias("rows")
)
S["a13_label_category"] = f"SELECT Label, {CAT_SQL} AS category, count(*) AS rows FROM ({BIDIR_TEXT_SQL}) GROUP BY ALL"
Q["a14_parse_summary"] = lambda s, d: bi.parse_summary(bi.parse_bidir(bidir_text(s, d)))
S["a14_parse_summary"] = f"""WITH {parsed_sql()}
SELECT 'total_rows' AS kind, '' AS key, count(*) AS count FROM pb UNION ALL SELECT 'raw_label', raw_label, count(*) FROM pb GROUP BY raw_label
UNION ALL SELECT 'parsed_events', '', count(*) FROM pb WHERE skip_reason IS NULL
UNION ALL SELECT 'mapped_label', label, count(*) FROM pb WHERE skip_reason IS NULL GROUP BY label
UNION ALL SELECT 'skipped_rows', '', count(*) FROM pb WHERE skip_reason IS NOT NULL
UNION ALL SELECT 'skip_reason', skip_reason, count(*) FROM pb WHERE skip_reason IS NOT NULL GROUP BY skip_reason"""


def _research(s, d):
    e = events(s, d)
    i = F.col("size_bytes")
    t = e.select(
        sc.iso(F.col("t_us")).alias("timestamp"), "src_ip", "dst_ip", F.col("dst_port").cast("string").alias("dst_port"), "protocol",
        i.cast("string").alias("size_bytes"), "label",
        F.when(i % 11 == 0, " ").otherwise(F.col("scenario_name")).alias("scenario_name"),
        F.when(i % 5 == 0, "").otherwise(F.col("src_port")).alias("src_port"),
        F.when(i % 3 == 0, "").otherwise(F.col("direction")).alias("direction"),
    )
    return bi.read_research_events(s, csv_files(s, t, "research")).withColumn("issue", tx.no_issue())


Q["a15_read_research_events"] = _research
S["a15_read_research_events"] = f"""SELECT t_us, src_ip, dst_ip, dst_port, protocol, CASE WHEN size_bytes % 5 = 0 THEN NULL ELSE src_port END AS src_port,
 CASE WHEN size_bytes % 3 = 0 THEN NULL ELSE direction END AS direction, size_bytes, label,
 CASE WHEN size_bytes % 11 = 0 THEN 'unknown' ELSE scenario_name END AS scenario_name, CAST(NULL AS VARCHAR) AS issue FROM ({FLOW_EVENTS_SQL})"""

# --- B: sinks -------------------------------------------------------------------------------------

Q["b01_event_rows"] = lambda s, d: sk.event_rows(events(s, d))
S["b01_event_rows"] = f"""SELECT {ISO_SQL.format(c='t_us')} AS timestamp, src_ip, direction, dst_ip, dst_port, protocol, src_port,
 size_bytes, label, scenario_name FROM ({FLOW_EVENTS_SQL})"""
Q["b02_to_normalized"] = lambda s, d: sk.to_normalized(events(s, d))
S["b02_to_normalized"] = f"""SELECT {ISO_SQL.format(c='t_us')} AS timestamp, src_ip, src_port, direction, dst_ip, dst_port, protocol,
 size_bytes AS total_bytes, '' AS duration_seconds, '' AS total_packets, label, scenario_name FROM ({FLOW_EVENTS_SQL})"""
Q["b02_contract_counts"] = lambda s, d: sk.contract_counts(events(s, d))
S["b02_contract_counts"] = f"""WITH fe AS ({FLOW_EVENTS_SQL}) SELECT 'events' AS kind, '' AS key, count(*) AS count FROM fe
UNION ALL SELECT 'label', label, count(*) FROM fe GROUP BY label UNION ALL SELECT 'scenario', scenario_name, count(*) FROM fe GROUP BY scenario_name"""


def _b05(s, d):
    diag = fg.ingest_diagnostics(events(s, d).withColumn("skip_reason", F.when(F.col("size_bytes") % 50 == 0, "unsupported_protocol")))
    r = sk.run_summary(sc.score_flows(feature_table(s, d), RULES), diag, RULES, alert_profile="sensitive")
    return r.select(
        "mode", "detector_name", "alert_profile", F.col("threshold_profile.profile").alias("profile"),
        F.col("threshold_profile.threshold").alias("threshold"), "input_event_count", "scored_flow_count", "alert_count",
        F.col("ingestion.skipped_row_count").alias("skipped_row_count"),
        F.col("ingestion.skipped_row_reasons")["unsupported_protocol"].alias("unsupported_protocol"), "time_windowing",
    )


Q["b05_run_summary"] = _b05
S["b05_run_summary"] = f"""WITH {RULED_SQL} SELECT 'rules_only' AS mode, 'rule_baseline_v2_hardened_final' AS detector_name, 'sensitive' AS alert_profile,
 'conservative' AS profile, 2.2::DOUBLE AS threshold, (SELECT count(*) FROM fe WHERE size_bytes % 50 <> 0) AS input_event_count,
 count(*) AS scored_flow_count, count(*) FILTER (score >= 2.2::DOUBLE) AS alert_count,
 (SELECT count(*) FROM fe WHERE size_bytes % 50 = 0) AS skipped_row_count,
 (SELECT count(*) FROM fe WHERE size_bytes % 50 = 0) AS unsupported_protocol, 'whole_file_batch' AS time_windowing FROM ru"""
Q["b08_experiment_metadata"] = lambda s, d: sk.experiment_metadata(
    "rule_study", {"seeds": [0, 1, 2, 3, 4], "detectors": ["rules"]}, ["summary", "per_case"],
    feature_table(s, d).groupBy(F.col("label").alias("group_name")).agg(F.count(F.lit(1)).alias("count")),
).select("study", "parameters", F.array_join("outputs", ";").alias("outputs"), F.to_json("group_counts").alias("group_counts"))
S["b08_experiment_metadata"] = f"""WITH {features_sql()} SELECT 'rule_study' AS study, '{{"detectors": ["rules"], "seeds": [0, 1, 2, 3, 4]}}' AS parameters,
 'summary;per_case' AS outputs, concat('{{"beacon":', count(*) FILTER (label='beacon'), ',"benign":', count(*) FILTER (label='benign'), '}}') AS group_counts FROM ff"""


def _b07(s, d):
    from tidewatch.operators.ranks import ensure_checkpoint_dir
    from tidewatch.plans.common import PARAMS

    ensure_checkpoint_dir(s)
    root = f"{s.sparkContext.getCheckpointDir()}/snapshots"
    config = {"input": d, "burst_threshold_seconds": PARAMS.burst_threshold_seconds}
    sk.feature_snapshot(s, lambda: feature_table(s, d), root, "features", "flow_events", 0, config)
    df, status = sk.feature_snapshot(s, lambda: feature_table(s, d), root, "features", "flow_events", 0, config)
    return tidy(as_integers(df.select("src_ip", "dst_ip", *FEATURES))).withColumn("status", F.lit(status))


Q["b07_feature_snapshot"] = _b07
S["b07_feature_snapshot"] = f"WITH {features_sql()} SELECT src_ip, dst_ip, {feature_select(FEATURES)}, 'hit' AS status FROM ff"

# --- L: bidirectional operators -------------------------------------------------------------------

BP = FeatureParams(burst_threshold_seconds=3600.0)
BKEY = ["ctu_scenario", *FULL_KEY]
BK = ", ".join(BKEY)
POLICIES = bi.POLICIES


def bidir_features(s, d):
    def make(s, d):
        return bd.bidir_features(bi.records(bi.with_policies(bidir_text(s, d), POLICIES)), BP, by=["policy_name"])

    return stored(s, d, "bidir_features", make)


BIDIR_FE = """SELECT policy_name, scenario_name AS ctu_scenario, t_us, src_ip, src_port, direction, dst_ip, dst_port, protocol,
 total_bytes AS size_bytes, label, concat(scenario_name, ':', label_category) AS scenario_name FROM {t} WHERE skip_reason IS NULL"""
BOTH_PARSED = f"{parsed_sql('pc')}, {parsed_sql('pk', 'benign', 'background_as_benign_sensitivity')}, pb AS (SELECT * FROM pc UNION ALL SELECT * FROM pk)"
BIDIR_FF = f"""{BOTH_PARSED},
{features_sql('policy_name, ' + BK, 3600.0, BIDIR_FE.format(t='pb'))},
bf AS (SELECT * FROM ff WHERE benign_events = 0 OR beacon_events = 0),
bk AS (SELECT *, sha256(concat_ws('|', src_ip, coalesce(src_port,''), coalesce(direction,''), dst_ip, CAST(dst_port AS VARCHAR), protocol,
 coalesce(scenario_name,''), label)) AS row_key FROM bf)"""
CON = "policy_name = 'conservative'"


def _conservative(s, d):
    return bidir_features(s, d).filter(CON).drop("policy_name")


SPLIT_L = """{src}, rk AS (SELECT *, row_number() OVER (PARTITION BY ctu_scenario, label ORDER BY row_key) AS rank,
 count(*) OVER (PARTITION BY ctu_scenario, label) AS nn FROM {t}),
sp AS (SELECT *, CASE WHEN label='benign' AND rank <= greatest(2, CAST(floor(nn*0.5::DOUBLE) AS BIGINT)) THEN 'reference' ELSE 'evaluation' END AS role FROM rk)"""
BACK = "(label='benign' AND scenario_name LIKE '%:ctu13_background')"
ALL_L01 = f"""{BIDIR_FF}, cp AS (SELECT * FROM bk WHERE policy_name='background_as_benign_sensitivity')"""
CAPPED = f"""{BIDIR_FF}, cp0 AS (SELECT *, row_number() OVER (PARTITION BY ctu_scenario, {BACK} ORDER BY row_key) AS cr FROM bk
 WHERE policy_name='background_as_benign_sensitivity'), cp AS (SELECT * FROM cp0 WHERE NOT {BACK} OR cr <= 40)"""


def _l01(s, d):
    parsed = bi.parse_bidir(bidir_text(s, d), bi.BACKGROUND_AS_BENIGN)
    return bd.bidir_dataset(parsed, BP, fraction=0.5).select(*BKEY, "scenario_name", "label", "event_count", "role")


Q["l01_bidir_dataset"] = _l01
S["l01_bidir_dataset"] = f"WITH {SPLIT_L.format(src=ALL_L01, t='cp')} SELECT {BK}, scenario_name, label, event_count, role FROM sp"
Q["l01_bidir_features"] = lambda s, d: tidy(
    as_integers(bd.bidir_features(bi.records(bi.parse_bidir(bidir_text(s, d))), BP).select(*BKEY, "label", "scenario_name", *FEATURES))
)
S["l01_bidir_features"] = f"WITH {BIDIR_FF} SELECT {BK}, label, scenario_name, {feature_select(FEATURES)} FROM bf WHERE {CON}"


def _l02(s, d):
    f = bidir_features(s, d).filter("policy_name = 'background_as_benign_sensitivity'")
    return bd.cap_rows(f, bd.is_background(), 40, ["ctu_scenario"])[1]


Q["l02_cap_background_rows"] = _l02
S["l02_cap_background_rows"] = f"""WITH {CAPPED} SELECT ctu_scenario, count(*) FILTER ({BACK} AND cr > 40) AS capped_background_benign_flow_count
 FROM cp0 GROUP BY ctu_scenario"""
Q["l03_split_reference_eval"] = lambda s, d: bd.split_reference_eval(_conservative(s, d), 0.5, ["ctu_scenario"]).select(*BKEY, "label", "role")
S["l03_split_reference_eval"] = f"""WITH {SPLIT_L.format(src=BIDIR_FF, t=f"(SELECT * FROM bk WHERE {CON})")} SELECT {BK}, label, role FROM sp"""


def native(s, d, policy=bi.CONSERVATIVE):
    return bd.native_features(bi.records(bi.parse_bidir(bidir_text(s, d), policy)))


def bucket_sql(extra: str = "") -> str:
    return f"""CASE dst_port WHEN 53 THEN 'dns_53' WHEN 80 THEN 'http_80' WHEN 123 THEN 'ntp_123' WHEN 443 THEN 'https_443' {extra}
 WHEN 13363 THEN 'ctu_common_13363' WHEN 19083 THEN 'ctu_common_19083' ELSE CASE WHEN dst_port < 1024 THEN 'other_well_known_0_1023'
 WHEN dst_port < 49152 THEN 'registered_1024_49151' ELSE 'ephemeral_49152_plus' END END"""


NATIVE_SQL = f"""nt AS (SELECT policy_name, record_id, scenario_name, label, label_category AS label_group, protocol, state, dst_port,
 {bucket_sql()} AS service_bucket, duration_seconds, total_packets, total_bytes, greatest(0, src_bytes) AS src_bytes,
 greatest(0, total_bytes-src_bytes) AS dst_bytes, src_bytes/nullif(total_bytes,0)::DOUBLE AS src_byte_ratio,
 greatest(0, total_bytes-src_bytes)/nullif(total_bytes,0)::DOUBLE AS dst_byte_ratio, total_packets/nullif(duration_seconds,0) AS packets_per_second,
 total_bytes/nullif(duration_seconds,0) AS bytes_per_second, total_bytes/nullif(total_packets,0)::DOUBLE AS mean_packet_size_bytes,
 src_bytes/nullif(total_packets,0)::DOUBLE AS src_bytes_per_packet,
 greatest(0, total_bytes-src_bytes)/nullif(total_packets,0)::DOUBLE AS dst_bytes_per_packet,
 CAST(protocol='tcp' AS INT) AS protocol_tcp, CAST(protocol='udp' AS INT) AS protocol_udp,
 CAST(dst_port IN (80,443,8080,8443) AS INT) AS is_web_port, CAST(dst_port=53 AS INT) AS is_dns_port,
 CAST(dst_port=123 AS INT) AS is_ntp_port, CAST(dst_port IN (13363,19083) AS INT) AS is_ctu_common_port FROM pb WHERE skip_reason IS NULL)"""
NATIVE_DOUBLES = {"duration_seconds", "src_byte_ratio", "dst_byte_ratio", "packets_per_second", "bytes_per_second",
                  "mean_packet_size_bytes", "src_bytes_per_packet", "dst_bytes_per_packet"}
NATIVE_COLS = ["record_id", "scenario_name", "label", "label_group", "protocol", "state", "service_bucket", *bd.NATIVE_FEATURES]
Q["l04_native_features"] = lambda s, d: tidy(native(s, d).select(*NATIVE_COLS))
S["l04_native_features"] = f"""WITH {parsed_sql()}, {NATIVE_SQL} SELECT {', '.join(num(x) if x in NATIVE_DOUBLES else x for x in NATIVE_COLS)} FROM nt"""
Q["l05_service_bucket"] = lambda s, d: bi.records(bi.parse_bidir(bidir_text(s, d), bi.BACKGROUND_AS_BENIGN)).groupBy(
    "dst_port", bd.service_bucket(F.col("dst_port")).alias("bucket"), bd.service_bucket(F.col("dst_port"), True).alias("diagnostic_bucket")
).agg(F.count(F.lit(1)).alias("rows"))
S["l05_service_bucket"] = f"""WITH {parsed_sql(background='benign')} SELECT dst_port, {bucket_sql()} AS bucket,
 {bucket_sql("WHEN 993 THEN 'imaps_993'")} AS diagnostic_bucket, count(*) AS rows FROM pb WHERE skip_reason IS NULL GROUP BY ALL"""
Q["l06_native_split"] = lambda s, d: bd.native_split(native(s, d)).select("record_id", F.array_join("role", ";").alias("role"))
NSPLIT_SQL = f"""{parsed_sql()}, {NATIVE_SQL}, nk AS (SELECT *, sha256(concat_ws('|', scenario_name, label_group, protocol, state,
 CAST(dst_port AS VARCHAR), format('{{:.6f}}', duration_seconds), CAST(total_packets AS VARCHAR), CAST(total_bytes AS VARCHAR),
 CAST(src_bytes AS VARCHAR), label)) AS row_key FROM nt),
nr AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY row_key, record_id) AS rk, count(*) OVER (PARTITION BY label) AS nn FROM nk),
nc AS (SELECT *, least(greatest(2, CAST(floor(nn*0.5::DOUBLE) AS BIGINT)), nn-1) AS cut FROM nr),
ns AS (SELECT *, CASE WHEN label='beacon' THEN 'evaluation' WHEN rk <= cut THEN 'reference'
 WHEN rk <= cut + greatest(1, (nn-cut)//2) THEN 'calibration' ELSE 'evaluation' END AS role FROM nc)"""
S["l06_native_split"] = f"WITH {NSPLIT_SQL} SELECT record_id, role FROM ns"


def rule_records(s, d):
    det = rl.detect_rules(bidir_features(s, d), RULES)
    return bd.transfer_records(det, F.lit("threshold=2.2"))


BREC_SQL = f"""{BIDIR_FF}, rec AS (SELECT policy_name, 'rule_baseline_v2_hardened_final' AS detector_name, 'threshold=2.2' AS operating_point,
 split_part(scenario_name, ':', 1) AS ctu_scenario, substr(scenario_name, strpos(scenario_name, ':')+1) AS label_group, scenario_name,
 label AS true_label, CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label, score, event_count, protocol, dst_port,
 total_bytes, flow_duration_seconds, mean_size_bytes, size_cv FROM (SELECT *, round({SCORE_SQL}, 9) AS score FROM bf))"""


def _l08(s, d):
    m = ev.classification_metrics(rule_records(s, d).filter(CON), ["detector_name", "operating_point"])
    return tidy(
        bd.compatibility_table(
            m, [("rf_full_threshold_0p6", "threshold=0.6", "needs flow features"), ("rf_full_threshold_0p3", "threshold=0.3", "needs flow features")]
        ).select("detector_name", "operating_point", "feature_path", "compatibility_status", "compatibility_notes", "tp", "fp", "tn", "fn", *ev.METRICS)
    )


Q["l08_compatibility_rows"] = _l08
S["l08_compatibility_rows"] = f"""WITH {BREC_SQL} SELECT detector_name, operating_point, 'ctu_native' AS feature_path,
 'compatible_unsupervised_reference' AS compatibility_status, 'Uses native numeric fields with a held-out benign reference.' AS compatibility_notes,
 tp, fp, tn, fn, {MET_OUT} FROM (SELECT *, {MET_SQL} FROM (SELECT detector_name, operating_point, {CONF_SQL} FROM rec WHERE {CON} GROUP BY ALL))
UNION ALL SELECT 'rf_full_threshold_0p' || x, 'threshold=0.' || x, 'ctu_native', 'not_schema_compatible', 'needs flow features',
 NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES ('6'), ('3')) t(x)"""
Q["l09_leave_one_scenario"] = lambda s, d: bd.leave_one_out(native(s, d)).groupBy("fold_name", "test_scenario", "role", "label").agg(
    F.count(F.lit(1)).alias("rows")
)
S["l09_leave_one_scenario"] = f"""WITH {parsed_sql()}, ok AS (SELECT * FROM pb WHERE skip_reason IS NULL)
SELECT concat('test_', t.s) AS fold_name, t.s AS test_scenario, CASE WHEN scenario_name = t.s THEN 'test' ELSE 'train' END AS role, label,
 count(*) AS rows FROM ok, (SELECT DISTINCT scenario_name AS s FROM ok) t GROUP BY ALL"""


def _l13(s, d):
    parsed = bi.with_policies(bidir_text(s, d), POLICIES)
    f = bidir_features(s, d)
    kept, dropped = bd.cap_rows(f, bd.is_background(), None, ["policy_name", "ctu_scenario"])
    rec = bd.transfer_records(rl.detect_rules(kept, RULES), F.lit("threshold=2.2"))
    return tidy(bd.policy_sensitivity(rec, bd.policy_counts(parsed, kept, dropped)))


Q["l13_policy_sensitivity"] = _l13
S["l13_policy_sensitivity"] = f"""WITH {BREC_SQL}, m AS (SELECT *, {MET_SQL} FROM (SELECT policy_name, detector_name, operating_point, {CONF_SQL},
 count(*) AS feature_rows FROM rec GROUP BY policy_name, detector_name, operating_point)),
p AS (SELECT policy_name, count(*) FILTER (skip_reason IS NULL) AS parsed_events, count(*) FILTER (skip_reason IS NOT NULL) AS skipped_rows FROM pb GROUP BY policy_name),
g AS (SELECT policy_name, count(*) FILTER ({BACK}) AS background FROM bf GROUP BY policy_name),
h AS (SELECT policy_name, count(*) FILTER (true_label='benign' AND scenario_name LIKE '%:ctu13_background') AS evaluated FROM rec GROUP BY policy_name)
SELECT policy_name, detector_name, operating_point, tp, fp, tn, fn, {MET_OUT}, parsed_events, skipped_rows, feature_rows,
 background - evaluated AS capped_background_benign_flows FROM m JOIN p USING (policy_name) JOIN g USING (policy_name) JOIN h USING (policy_name)"""
Q["l14_scenario_rollup"] = lambda s, d: tidy(bd.scenario_rollup(rule_records(s, d), ["policy_name", "detector_name", "operating_point"]))
S["l14_scenario_rollup"] = f"""WITH {BREC_SQL} SELECT policy_name, detector_name, operating_point, ctu_scenario, label_group, tp, fp, tn, fn, flow_count, {MET_OUT}
 FROM (SELECT *, {MET_SQL} FROM (SELECT policy_name, detector_name, operating_point, ctu_scenario,
  CASE WHEN grouping(label_group)=1 THEN 'all' ELSE label_group END AS label_group, {CONF_SQL}, count(*) AS flow_count FROM rec
  GROUP BY GROUPING SETS ((policy_name, detector_name, operating_point, ctu_scenario), (policy_name, detector_name, operating_point, ctu_scenario, label_group))))"""
FKEYS = ["policy_name", "detector_name", "operating_point", "ctu_scenario", "label_group", "protocol", "dst_port"]
FMEANS = ["score", "event_count", "total_bytes", "flow_duration_seconds", "size_cv"]
for _kind, _pred in (("positive", "beacon"), ("negative", "benign")):
    Q[f"l15_false_{_kind}_groups"] = (lambda p: lambda s, d: tidy(bd.failure_groups(rule_records(s, d), FKEYS, FMEANS, p)))(_pred)
    S[f"l15_false_{_kind}_groups"] = f"""WITH {BREC_SQL} SELECT {', '.join(FKEYS)}, count(*) AS false_{_kind}_count,
 {', '.join(num(f'avg({m})', f'mean_{m}') for m in FMEANS)} FROM rec WHERE predicted_label='{_pred}' AND true_label<>'{_pred}' GROUP BY ALL"""


def _l16(s, d):
    r = rule_records(s, d).withColumn("operating_point", F.concat(F.lit("calibrated_on="), F.col("ctu_scenario")))
    return tidy(bd.combine(r, ["policy_name"]))


Q["l16_combine_detector_results"] = _l16
S["l16_combine_detector_results"] = f"""WITH {BREC_SQL} SELECT policy_name, detector_name, operating_point, tp, fp, tn, fn, {MET_OUT} FROM (SELECT *, {MET_SQL} FROM
 (SELECT policy_name, detector_name, concat('per_scenario_calibrated;', array_to_string(list_sort(list(DISTINCT concat('calibrated_on=', ctu_scenario))), ';'))
  AS operating_point, {CONF_SQL} FROM rec GROUP BY policy_name, detector_name))"""


def _l17(s, d):
    f = bidir_features(s, d).select("scenario_name", "ctu_scenario")
    x = F.when(F.col("ctu_scenario") == "scenario_1", F.col("ctu_scenario")).otherwise(F.col("scenario_name"))
    a, b = bd.split_scenario(x)
    return f.groupBy(a.alias("scenario"), b.alias("label_group")).agg(F.count(F.lit(1)).alias("rows"))


Q["l17_scenario_split"] = _l17
S["l17_scenario_split"] = f"""WITH {BIDIR_FF} SELECT ctu_scenario AS scenario, CASE WHEN ctu_scenario='scenario_1' THEN 'unknown'
 ELSE substr(scenario_name, strpos(scenario_name, ':')+1) END AS label_group, count(*) AS rows FROM bf GROUP BY ALL"""


def diagnostic_rows(s, d):
    cols = ["group_name", "source_family", "ctu_scenario", "protocol", "dst_port", *bd.DISTRIBUTION_FEATURES]
    a = bd.diag_group(bidir_features(s, d).filter("policy_name = 'background_as_benign_sensitivity'"), "ctu")
    b = bd.diag_group(feature_table(s, d), "synthetic").withColumn("ctu_scenario", F.lit(None).cast("string"))
    return a.select(*cols).unionByName(b.select(*cols))


_FLOW_FF = features_sql().replace("fe AS", "fe2 AS", 1).replace("FROM fe ", "FROM fe2 ")
for _t in ("fl", "g1", "g2", "g3", "g4", "f0", "ff"):
    _FLOW_FF = _FLOW_FF.replace(f"\n{_t} AS", f"\n{_t}x AS").replace(f"FROM {_t})", f"FROM {_t}x)")
DF = ", ".join(bd.DISTRIBUTION_FEATURES)
DIAG_L = f"""{BIDIR_FF}, {_FLOW_FF},
dg AS (SELECT CASE WHEN contains(scenario_name,'ctu13_from_botnet') THEN 'ctu_from_botnet' WHEN contains(scenario_name,'ctu13_from_normal') THEN 'ctu_from_normal'
  WHEN contains(scenario_name,'ctu13_background') THEN 'ctu_background' END AS group_name, 'ctu' AS source_family, ctu_scenario, protocol, dst_port, {DF}
  FROM bf WHERE policy_name='background_as_benign_sensitivity'
 UNION ALL SELECT concat('synthetic_', label), 'synthetic', NULL, protocol, dst_port, {DF} FROM ffx)"""
Q["l18_diagnostic_group"] = lambda s, d: diagnostic_rows(s, d).groupBy("group_name", "source_family", "ctu_scenario").agg(
    F.count(F.lit(1)).alias("flows")
)
S["l18_diagnostic_group"] = f"WITH {DIAG_L} SELECT group_name, source_family, ctu_scenario, count(*) AS flows FROM dg GROUP BY ALL"


def distribution(s, d):
    return stored(
        s, d, "distribution",
        lambda s, d: bd.distribution_summary(diagnostic_rows(s, d), bd.DISTRIBUTION_FEATURES, ["group_name", "source_family"], "ctu_scenario"),
    )


DIST_SQL = f"""{DIAG_L}, d2 AS (SELECT *, 'pooled' AS slice FROM dg UNION ALL SELECT *, ctu_scenario FROM dg WHERE ctu_scenario IS NOT NULL),
lg AS (SELECT group_name, source_family, slice AS ctu_scenario, unnest([{', '.join(f"'{f}'" for f in bd.DISTRIBUTION_FEATURES)}]) AS feature_name,
 unnest([{', '.join(f'CAST({f} AS DOUBLE)' for f in bd.DISTRIBUTION_FEATURES)}]) AS v FROM d2),
ds AS (SELECT group_name, source_family, ctu_scenario, feature_name, count(v) AS count, count(*)-count(v) AS missing_count, avg(v) AS mean,
 stddev_pop(v) AS std, min(v) AS min, max(v) AS max, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS median,
 quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.9) AS p90 FROM lg GROUP BY ALL)"""
Q["l19_distribution_summary"] = lambda s, d: tidy(distribution(s, d))
S["l19_distribution_summary"] = f"""WITH {DIST_SQL} SELECT group_name, source_family, ctu_scenario, feature_name, count, missing_count,
 {', '.join(num(x) for x in ('mean', 'std', 'min', 'max', 'p10', 'p25', 'median', 'p75', 'p90'))} FROM ds"""
Q["l20_shift_ranking"] = lambda s, d: tidy(
    bd.shift_ranking(distribution(s, d).filter("ctu_scenario = 'pooled'")).select(
        "comparison", "feature_name", "left_group", "right_group", "left_count", "right_count", "left_median", "right_median",
        "median_absolute_difference", "pooled_iqr", "normalized_median_shift",
    )
)
S["l20_shift_ranking"] = f"""WITH {DIST_SQL}, pr(comparison, lg, rg) AS (VALUES {', '.join(str(x) for x in bd.COMPARISONS)}),
sh AS (SELECT comparison, l.feature_name, lg AS left_group, rg AS right_group, l.count AS left_count, r.count AS right_count, l.median AS left_median,
 r.median AS right_median, abs(l.median-r.median) AS df, ((l.p75-l.p25)+(r.p75-r.p25))/2 AS iq FROM pr JOIN ds l ON l.group_name=lg AND l.ctu_scenario='pooled'
 JOIN ds r ON r.group_name=rg AND r.ctu_scenario='pooled' AND r.feature_name=l.feature_name WHERE l.count>0 AND r.count>0)
SELECT comparison, feature_name, left_group, right_group, left_count, right_count, {num('left_median')}, {num('right_median')},
 {num('df', 'median_absolute_difference')}, {num('iq', 'pooled_iqr')},
 {num('df/CASE WHEN iq>0 THEN iq ELSE greatest(abs(left_median), abs(right_median), 1.0) END', 'normalized_median_shift')} FROM sh"""
Q["l21_port_share"] = lambda s, d: tidy(bd.port_share(diagnostic_rows(s, d)))
S["l21_port_share"] = f"""WITH {DIAG_L}, x AS (SELECT group_name, source_family, coalesce(ctu_scenario,'synthetic') AS ctu_scenario, protocol, dst_port,
 {bucket_sql("WHEN 993 THEN 'imaps_993'")} AS dst_port_bucket, count(*) AS flow_count FROM dg GROUP BY ALL)
SELECT *, {num('flow_count/sum(flow_count) OVER (PARTITION BY group_name, source_family, ctu_scenario)', 'group_share')} FROM x"""
Q["l22_label_mapping"] = lambda s, d: bd.label_mapping(bi.parse_bidir(bidir_text(s, d), bi.BACKGROUND_AS_BENIGN))
S["l22_label_mapping"] = f"WITH {parsed_sql(background='benign')} SELECT raw_label, label AS mapped_label, count(*) AS row_count FROM pb GROUP BY ALL"
