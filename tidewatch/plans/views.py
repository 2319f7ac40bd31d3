"""Adapter views: the test tables seen as flow logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flow_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as flow events: one row per event, time in microseconds."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src_ip"),
        F.col("event_type").alias("dst_ip"),
        (443 + F.col("user_id") % 3).cast("int").alias("dst_port"),
        F.when(F.col("user_id") % 2 == 0, "tcp").otherwise("udp").alias("protocol"),
        F.lit("->").alias("direction"),
        (1024 + F.col("event_id") % 5).cast("string").alias("src_port"),
        F.round(F.col("value") * 100).cast("bigint").alias("size_bytes"),
        F.when(F.col("user_id") % 7 == 0, "beacon").otherwise("benign").alias("label"),
        F.concat(F.lit("profile_"), (F.col("user_id") % 4).cast("string")).alias("scenario_name"),
    )


FLOW_EVENTS_SQL = """
SELECT event_id, epoch_us(ts) AS t_us, concat('u', CAST(user_id AS VARCHAR)) AS src_ip,
       event_type AS dst_ip, CAST(443 + user_id % 3 AS INT) AS dst_port,
       CASE WHEN user_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS protocol, '->' AS direction,
       CAST(1024 + event_id % 5 AS VARCHAR) AS src_port, CAST(round(value*100) AS BIGINT) AS size_bytes,
       CASE WHEN user_id % 7 = 0 THEN 'beacon' ELSE 'benign' END AS label,
       concat('profile_', CAST(user_id % 4 AS VARCHAR)) AS scenario_name
FROM events
"""


def event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`flow_events` rendered as the all-text rows of a normalized CSV, some of them broken."""
    e = flow_events(spark, sf_dir)
    i = F.col("event_id")
    ts = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(
        (i + 2).alias("row_number"),
        F.when(i % 113 == 0, "soon").otherwise(F.concat(ts, F.lit("Z"))).alias("timestamp"),
        F.when(i % 103 == 0, "-").when(i % 127 == 0, " ").otherwise(F.col("src_ip")).alias("src_ip"),
        "direction",
        "dst_ip",
        F.when(i % 101 == 0, "70000").otherwise(F.col("dst_port").cast("string")).alias("dst_port"),
        F.when(i % 97 == 0, "icmp").otherwise(F.upper("protocol")).alias("protocol"),
        F.when(i % 107 == 0, "-5").otherwise(F.col("size_bytes").cast("string")).alias("total_bytes"),
        F.col("src_port"),
        F.when(i % 109 == 0, "-1.0").when(i % 3 == 0, "").otherwise("1.5").alias("duration_seconds"),
        F.when(i % 131 == 0, "many").when(i % 4 == 0, "").otherwise("7").alias("total_packets"),
        F.when(i % 137 == 0, "odd").otherwise(F.col("label")).alias("label"),
    )


EVENT_TEXT_SQL = f"""
SELECT event_id + 2 AS row_number,
       CASE WHEN event_id % 113 = 0 THEN 'soon'
            ELSE strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' END AS timestamp,
       CASE WHEN event_id % 103 = 0 THEN '-' WHEN event_id % 127 = 0 THEN ' ' ELSE src_ip END AS src_ip,
       direction, dst_ip,
       CASE WHEN event_id % 101 = 0 THEN '70000' ELSE CAST(dst_port AS VARCHAR) END AS dst_port,
       CASE WHEN event_id % 97 = 0 THEN 'icmp' ELSE upper(protocol) END AS protocol,
       CASE WHEN event_id % 107 = 0 THEN '-5' ELSE CAST(size_bytes AS VARCHAR) END AS total_bytes,
       src_port,
       CASE WHEN event_id % 109 = 0 THEN '-1.0' WHEN event_id % 3 = 0 THEN '' ELSE '1.5' END AS duration_seconds,
       CASE WHEN event_id % 131 = 0 THEN 'many' WHEN event_id % 4 = 0 THEN '' ELSE '7' END AS total_packets,
       CASE WHEN event_id % 137 = 0 THEN 'odd' ELSE label END AS label
FROM ({FLOW_EVENTS_SQL})
"""


def bidir_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` rendered as the all-text rows of a bidirectional flow CSV."""
    p, s, f = F.col("l_partkey"), F.col("l_suppkey") % 20, F.col("l_returnflag")
    start = F.date_format(
        F.timestamp_micros(
            F.unix_micros(F.col("l_shipdate").cast("timestamp"))
            + (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 131) % 86400 * 1000000
        ),
        "yyyy/MM/dd HH:mm:ss.SSSSSS",
    )
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"),
        F.concat(F.lit("scenario_"), (p % 3).cast("string")).alias("scenario_name"),
        start.alias("StartTime"),
        (F.col("l_linenumber").cast("double") * 1.5).cast("string").alias("Dur"),
        F.when(F.col("l_partkey") % 41 == 0, "icmp")
        .when(p % 2 == 0, "tcp")
        .otherwise("udp")
        .alias("Proto"),
        F.concat(F.lit("h"), s.cast("string")).alias("SrcAddr"),
        (1024 + F.col("l_linenumber")).cast("string").alias("Sport"),
        F.when(p % 4 == 0, "<->").otherwise("->").alias("Dir"),
        F.concat(F.lit("d"), (p % 12).cast("string")).alias("DstAddr"),
        F.when(p % 43 == 0, "-")
        .when(p % 6 == 0, "domain")
        .when(p % 6 == 1, "http")
        .when(p % 6 == 2, "0x7b")
        .when(p % 6 == 3, "443")
        .when(p % 6 == 4, "13363")
        .otherwise((1024 + p % 60000).cast("string"))
        .alias("Dport"),
        F.lit("CON").alias("State"),
        F.lit("0").alias("sTos"),
        F.lit("0").alias("dTos"),
        F.col("l_quantity").cast("string").alias("TotPkts"),
        F.round("l_extendedprice").cast("bigint").cast("string").alias("TotBytes"),
        F.floor(F.col("l_extendedprice") * F.col("l_discount")).cast("string").alias("SrcBytes"),
        F.when((s < 4) | ((s == 4) & (f == "R")), "flow=From-Botnet-V1")
        .when((s < 9) | ((s == 9) & (f == "A")), "flow=From-Normal-V1")
        .when(s == 10, "flow=To-Botnet-V1")
        .when(s == 11, "flow=To-Normal-V1")
        .when(s == 12, "flow=Other")
        .otherwise("flow=Background")
        .alias("Label"),
    )


BIDIR_TEXT_SQL = """
SELECT l_orderkey * 8 + l_linenumber AS record_id,
       concat('scenario_', CAST(l_partkey % 3 AS VARCHAR)) AS scenario_name,
       strftime(make_timestamp(epoch_us(l_shipdate)
         + (l_orderkey * 7919 + l_linenumber * 131) % 86400 * 1000000), '%Y/%m/%d %H:%M:%S.%f') AS StartTime,
       CAST(CAST(l_linenumber AS DOUBLE) * 1.5 AS VARCHAR) AS Dur,
       CASE WHEN l_partkey % 41 = 0 THEN 'icmp' WHEN l_partkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS Proto,
       concat('h', CAST(l_suppkey % 20 AS VARCHAR)) AS SrcAddr,
       CAST(1024 + l_linenumber AS VARCHAR) AS Sport,
       CASE WHEN l_partkey % 4 = 0 THEN '<->' ELSE '->' END AS Dir,
       concat('d', CAST(l_partkey % 12 AS VARCHAR)) AS DstAddr,
       CASE WHEN l_partkey % 43 = 0 THEN '-' WHEN l_partkey % 6 = 0 THEN 'domain'
            WHEN l_partkey % 6 = 1 THEN 'http' WHEN l_partkey % 6 = 2 THEN '0x7b'
            WHEN l_partkey % 6 = 3 THEN '443' WHEN l_partkey % 6 = 4 THEN '13363'
            ELSE CAST(1024 + l_partkey % 60000 AS VARCHAR) END AS Dport,
       'CON' AS State, '0' AS sTos, '0' AS dTos,
       CAST(l_quantity AS VARCHAR) AS TotPkts,
       CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS TotBytes,
       CAST(CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS VARCHAR) AS SrcBytes,
       CASE WHEN l_suppkey % 20 < 4 OR (l_suppkey % 20 = 4 AND l_returnflag = 'R') THEN 'flow=From-Botnet-V1'
            WHEN l_suppkey % 20 < 9 OR (l_suppkey % 20 = 9 AND l_returnflag = 'A') THEN 'flow=From-Normal-V1'
            WHEN l_suppkey % 20 = 10 THEN 'flow=To-Botnet-V1'
            WHEN l_suppkey % 20 = 11 THEN 'flow=To-Normal-V1'
            WHEN l_suppkey % 20 = 12 THEN 'flow=Other'
            ELSE 'flow=Background' END AS Label
FROM lineitem
"""
