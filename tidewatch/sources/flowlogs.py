"""Zeek connection logs and NetFlow/IPFIX CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import EVENT
from tidewatch.sources import text as tx
from tidewatch.sources.normalized import read_normalized, read_rows

TOKENS = ("", "-", "(empty)")
# At this many headers the header table is no longer broadcast but joined by shuffle.
MAX_BROADCAST_HEADERS = 100_000

# Column names a field may have, best first (fixed values).
ALIASES: dict[str, list[str]] = {
    "timestamp": [
        "timestamp", "start_time", "flow_start", "flowstart", "flowstartseconds", "flowstartmilliseconds",
        "first_switched", "firstswitched", "first", "start",
    ],
    "end": [
        "end_time", "flow_end", "flowend", "flowendseconds", "flowendmilliseconds", "last_switched",
        "lastswitched", "last", "end",
    ],
    "src_ip": [
        "src_ip", "source_ip", "srcaddr", "src_addr", "sourceipv4address", "sourceipv6address", "sourceaddress", "src",
    ],
    "dst_ip": [
        "dst_ip", "destination_ip", "dstaddr", "dst_addr", "destinationipv4address", "destinationipv6address",
        "destinationaddress", "dst",
    ],
    "src_port": [
        "src_port", "source_port", "srcport", "sourceport", "spt", "sport", "s_port", "sourcedport",
        "sourcetransportport",
    ],
    "dst_port": [
        "dst_port", "destination_port", "dstport", "destinationport", "dpt", "dport", "d_port",
        "destinationtransportport",
    ],
    "protocol": ["protocol", "proto", "protocolidentifier", "transportprotocol", "ipprotocol", "prot"],
    "bytes": [
        "total_bytes", "bytes", "octets", "in_bytes", "numbytes", "bytestotal", "octetdeltacount", "octettotalcount",
    ],
    "packets": [
        "total_packets", "packets", "pkts", "in_pkts", "numpackets", "packetdeltacount", "packettotalcount",
    ],
    "duration": ["duration_seconds", "duration", "dur", "durationsecs", "flow_duration_seconds", "elapsed"],
}


def epoch_timestamp(seconds: Column) -> Column:
    return F.timestamp_micros(F.rint(seconds * 1e6).cast("bigint"))


def flow_timestamp(value: Column, millis: Column) -> Column:
    """Epoch seconds, milliseconds (by name or size), or ISO-8601."""
    x = F.when(value.rlike(tx.FLOAT), value.try_cast("double"))
    x = F.when(millis | (x >= 1e12), x / 1000.0).otherwise(x)
    return F.when(x.isNotNull(), epoch_timestamp(x)).otherwise(tx.iso_timestamp(value))


def flow_duration(explicit: Column, start: Column, end: Column) -> Column:
    """The given duration, else end - start but not below zero, else null."""
    span = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    return F.coalesce(explicit, F.when(end.isNotNull(), F.greatest(F.lit(0.0), span)))


def parse_zeek(rows: DataFrame) -> DataFrame:
    """Zeek fields as text columns -> event columns, `skip_reason`, `issue`."""

    def raw(name: str) -> Column:
        return tx.text_or_null(F.col(f"`{name}`"), TOKENS) if name in rows.columns else tx.no_issue()

    def need(name: str) -> Column:
        return tx.required(raw(name), f"Zeek conn.log row is missing {name}.").issue

    def zero(p: tx.Parsed) -> Column:
        return F.coalesce(p.value, F.lit(0))

    proto = F.lower(raw("proto"))
    skip = F.when(~proto.isin("tcp", "udp"), "unsupported_protocol")
    counts = {n: tx.integer(raw(n), n) for n in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")}
    dst_port, src_port = tx.port(raw("id.resp_p"), "id.resp_p"), tx.port(raw("id.orig_p"), "id.orig_p")
    ts, duration = tx.number(raw("ts"), "ts"), tx.number(raw("duration"), "duration")
    issue = tx.first_issue(
        need("id.resp_p"),
        dst_port.issue,
        *[p.issue for p in counts.values()],
        need("ts"),
        ts.issue,
        need("id.orig_h"),
        src_port.issue,
        need("id.resp_h"),
        duration.issue,
    )
    keep = [c for c in ("source_file", "_block", "_order", "row_number") if c in rows.columns]
    return rows.select(
        epoch_timestamp(ts.value).alias("ts"),
        raw("id.orig_h").alias("src_ip"),
        F.lit("->").alias("direction"),
        raw("id.resp_h").alias("dst_ip"),
        dst_port.value.alias("dst_port"),
        proto.alias("protocol"),
        (zero(counts["orig_bytes"]) + zero(counts["resp_bytes"])).alias("total_bytes"),
        src_port.value.cast("string").alias("src_port"),
        duration.value.alias("duration_seconds"),
        (zero(counts["orig_pkts"]) + zero(counts["resp_pkts"])).alias("total_packets"),
        tx.no_issue().alias("label"),
        skip.alias("skip_reason"),
        F.when(skip.isNull(), F.coalesce(need("proto"), issue)).alias("issue"),
        *keep,
    )


#: The fields that `parse_zeek` reads.
ZEEK_FIELDS = [
    "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "duration", "orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts",
]


def zeek_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Data lines as text columns named by the `#fields` line of their own file."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = tx.with_place(spark.read.text(paths)).filter("value <> ''")
    heads = lines.filter(F.col("value").startswith("#fields")).select(
        "source_file", F.expr("slice(split(value, '\t'), 2, size(split(value, '\t')))").alias("fields")
    )
    heads = heads.groupBy("source_file").agg(F.collect_set("fields").alias("f")).select(
        F.col("source_file").alias("_file"),
        F.when(F.size("f") > 1, F.raise_error(F.lit("A Zeek file with several #fields lines.")).cast("array<string>"))
        .otherwise(F.col("f")[0])
        .alias("fields"),
    )
    layouts = [r["fields"] for r in heads.select("fields").distinct().limit(2).collect()]  # one, or several
    data = lines.filter(~F.col("value").startswith("#"))
    if len(layouts) == 1:
        # one layout for all files: no lookup; files without a header are still caught
        names = layouts[0]
        data = data.select("*", F.split("value", "\t").alias("v"))
        orphan = lines.select("source_file").distinct().join(
            heads.select(F.col("_file").alias("source_file")), "source_file", "left_anti"
        )
        if not data.select("source_file").join(orphan, "source_file", "left_semi").isEmpty():
            raise ValueError("Zeek conn.log is missing a #fields header.")
        cells = [F.get("v", F.lit(i)).alias(n) for i, n in enumerate(names)]
        return data.select(*cells, "source_file", "_block", "_order")
    small = heads.limit(MAX_BROADCAST_HEADERS + 1).count() <= MAX_BROADCAST_HEADERS
    side = F.broadcast(heads) if small else heads
    data = data.join(side, F.col("source_file") == F.col("_file"), "left")
    missing = F.raise_error(F.lit("Zeek conn.log is missing a #fields header.")).cast("array<string>")
    data = data.withColumn("fields", F.when(F.col("fields").isNull(), missing).otherwise(F.col("fields")))
    values = F.split("value", "\t")
    n = F.least(F.size("fields"), F.size(values))
    cell = F.map_from_arrays(F.slice("fields", 1, n), F.slice(values, 1, n))
    # of several layouts only the fields that events are made of
    names = ZEEK_FIELDS
    return data.withColumn("_m", cell).select(
        *[F.col("_m").getItem(n).alias(n) for n in names], "source_file", "_block", "_order"
    )


def read_zeek_conn(spark: SparkSession, paths: str | Sequence[str], mode: str = "strict") -> DataFrame:
    """Events, with rows of other protocols kept as `skip_reason`."""
    rows = zeek_rows(spark, paths)
    parsed = parse_zeek(rows)
    if mode == "collect":
        return parsed
    tx.require_rows(rows, "Zeek conn.log contains no data rows.")
    tx.raise_first_issue(parsed, 1, "Zeek conn.log row")
    return parsed.select(*EVENT.fieldNames(), "skip_reason", "source_file")


def plain_name(name: str) -> str:
    return "".join(ch.lower() for ch in name if ch.isalnum())


def parse_netflow(rows: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES) -> DataFrame:
    """NetFlow/IPFIX text columns -> event columns, `skip_reason`, `issue`."""
    found = {plain_name(c): c for c in rows.columns}

    def candidates(field: str) -> list[tuple[Column, str]]:
        names = [plain_name(a) for a in aliases[field]]
        return [(tx.text_or_null(F.col(f"`{found[n]}`"), TOKENS), n) for n in names if n in found]

    def pick(field: str) -> Column:
        parts = [c for c, _ in candidates(field)]
        return F.coalesce(*parts) if parts else tx.no_issue()

    def millis(field: str) -> Column:
        """Whether the winning column is named as milliseconds."""
        out = F.lit(False)
        for c, n in reversed(candidates(field)):
            out = F.when(c.isNotNull(), F.lit("millisecond" in n)).otherwise(out)
        return out

    def need(field: str) -> Column:
        names = ", ".join(aliases[field])
        place = F.col("row_number").cast("string") if "row_number" in rows.columns else F.lit("{row}")
        return F.when(
            pick(field).isNull(),
            F.concat(F.lit("NetFlow/IPFIX CSV row "), place, F.lit(f" is missing one of: {names}.")),
        )

    word = F.lower(pick("protocol"))
    proto = F.when(word.isin("tcp", "6"), "tcp").when(word.isin("udp", "17"), "udp")
    skip = F.when(word.isNotNull() & proto.isNull(), "unsupported_protocol")
    start = flow_timestamp(pick("timestamp"), millis("timestamp"))
    end = flow_timestamp(pick("end"), millis("end"))
    explicit = tx.non_negative(tx.number(pick("duration"), "duration_seconds"), "duration_seconds")
    src_port, dst_port = tx.port(pick("src_port"), "src_port"), tx.port(pick("dst_port"), "dst_port")
    total = tx.non_negative(tx.integer(pick("bytes"), "total_bytes"), "total_bytes")
    packets = tx.non_negative(tx.integer(pick("packets"), "total_packets"), "total_packets")

    def bad_time(field: str, parsed: Column) -> Column:
        v = pick(field)
        return F.when(v.isNotNull() & parsed.isNull(), F.concat(F.lit("Invalid isoformat string: '"), v, F.lit("'")))

    issue = tx.first_issue(
        need("protocol"),
        need("timestamp"),
        bad_time("timestamp", start),
        bad_time("end", end),
        explicit.issue,
        need("src_ip"),
        src_port.issue,
        need("dst_ip"),
        need("dst_port"),
        dst_port.issue,
        need("bytes"),
        total.issue,
        packets.issue,
    )
    keep = [c for c in ("source_file", "_block", "_order", "row_number") if c in rows.columns]
    return rows.select(
        start.alias("ts"),
        pick("src_ip").alias("src_ip"),
        F.lit("->").alias("direction"),
        pick("dst_ip").alias("dst_ip"),
        dst_port.value.alias("dst_port"),
        proto.alias("protocol"),
        total.value.alias("total_bytes"),
        src_port.value.cast("string").alias("src_port"),
        flow_duration(explicit.value, start, end).alias("duration_seconds"),
        packets.value.alias("total_packets"),
        tx.no_issue().alias("label"),
        skip.alias("skip_reason"),
        F.when(skip.isNull(), issue).alias("issue"),
        *keep,
    )


def read_netflow(
    spark: SparkSession,
    paths: str | Sequence[str],
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    mode: str = "strict",
) -> DataFrame:
    rows = read_rows(spark, paths)
    parsed = parse_netflow(rows, aliases)
    if mode == "collect":
        return parsed
    tx.require_rows(rows, "NetFlow/IPFIX CSV contains no data rows.")
    try:
        tx.raise_first_issue(parsed, 2, "NetFlow/IPFIX CSV row")
    except ValueError as e:
        place, _, message = str(e).partition(": ")
        if message.startswith("NetFlow/IPFIX CSV row "):
            raise ValueError(message.replace("{row}", place.rsplit(" ", 1)[1])) from None
        raise
    return parsed.select(*EVENT.fieldNames(), "skip_reason", "source_file")


FORMATS = {
    "normalized-csv": read_normalized,
    "zeek-conn": read_zeek_conn,
    "netflow-ipfix-csv": read_netflow,
}


def read_events(spark: SparkSession, paths: str | Sequence[str], fmt: str, mode: str = "strict") -> DataFrame:
    """One schema whatever the format, so results can be combined with unionByName. `collect` keeps
    every row with its issue."""
    if fmt not in FORMATS:
        raise ValueError(f"Unsupported operational input format: {fmt}")
    return FORMATS[fmt](spark, paths, mode=mode)


def load_events(spark: SparkSession, paths: str | Sequence[str], fmt: str, path: str) -> DataFrame:
    """The events of `read_events`, typed and written to `path` as Parquet, then read from there.

    The files are parsed once: counts and issues are read from the typed rows. (Observed metrics of the
    write would do as well, but a session that has any can no longer ship Spark ML's forests.) Only
    where there is an issue the strict reader reads the files again, and fails with the row's number."""
    parsed = read_events(spark, paths, fmt, mode="collect")
    if "skip_reason" not in parsed.columns:
        parsed = parsed.withColumn("skip_reason", tx.no_issue())
    parsed.select(*EVENT.fieldNames(), "skip_reason", "source_file", "issue").write.parquet(path)
    events = spark.read.parquet(path)
    seen = events.agg(F.count(F.lit(1)).alias("rows"), F.count("issue").alias("issues")).first()
    if not seen["rows"] or seen["issues"]:
        read_events(spark, paths, fmt)
        raise ValueError(f"{seen['issues']} of {seen['rows']} rows have issues")
    return events.drop("issue")


def loaded(events: DataFrame) -> DataFrame:
    return events.filter("skip_reason IS NULL").drop("skip_reason")


def ingest_diagnostics(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Row, loaded and skipped counts and the count of every skip reason, in one aggregation.
    Reasons are a handful of names, so their counts are combined into one map."""
    per = events.groupBy(*by, "skip_reason").agg(F.count(F.lit(1)).alias("_c"))
    reason = F.col("skip_reason")
    return per.groupBy(*by).agg(
        F.sum("_c").alias("input_row_count"),
        F.coalesce(F.sum(F.when(reason.isNull(), F.col("_c"))), F.lit(0)).alias("loaded_event_count"),
        F.coalesce(F.sum(F.when(reason.isNotNull(), F.col("_c"))), F.lit(0)).alias("skipped_row_count"),
        F.map_from_entries(
            F.sort_array(F.collect_list(F.when(reason.isNotNull(), F.struct("skip_reason", "_c"))))
        ).alias("skipped_row_reasons"),
    )
