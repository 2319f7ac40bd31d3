"""Normalized event CSV: parse, validate, read."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import EVENT, LABELS, PROTOCOLS, REQUIRED
from tidewatch.sources import text as tx


DRIVER_HEADERS = 64  # files whose headers cost less on the driver than in a job


def missing_columns(columns: Sequence[str], require_label: bool = False, label_column: str = "label") -> list[tuple[str, str]]:
    """(column, message) for every header problem."""
    out = [(c, f"Missing required column: {c}") for c in REQUIRED if c not in columns]
    if require_label and label_column not in columns:
        out.append((label_column, f"Missing required label column: {label_column}"))
    return out


def parse_normalized(rows: DataFrame, require_label: bool = False, label_column: str = "label") -> DataFrame:
    """Typed event columns next to `issue`, the first failing check of the row."""

    def raw(name: str) -> Column:
        return tx.text_or_null(F.col(f"`{name}`")) if name in rows.columns else tx.no_issue()

    def need(name: str) -> tx.Parsed:
        return tx.required(raw(name), f"{name} is required.")

    stamp, protocol = raw("timestamp"), raw("protocol")
    ts = tx.iso_timestamp(stamp)
    shown = F.regexp_replace(stamp, "Z$", "+00:00")
    dst_port = tx.port(raw("dst_port"), "dst_port")
    total = tx.non_negative(tx.integer(raw("total_bytes"), "total_bytes"), "total_bytes")
    packets = tx.non_negative(tx.integer(raw("total_packets"), "total_packets"), "total_packets")
    duration = tx.non_negative(tx.number(raw("duration_seconds"), "duration_seconds"), "duration_seconds")
    label = raw(label_column)
    src_port = tx.port(raw("src_port"), "src_port")
    issue = tx.first_issue(
        need("timestamp").issue,
        F.when(ts.isNull(), F.concat(F.lit("timestamp is not ISO-8601: "), shown)),
        need("src_ip").issue,
        need("direction").issue,
        need("dst_ip").issue,
        need("dst_port").issue,
        dst_port.issue,
        need("protocol").issue,
        F.when(~F.lower(protocol).isin(PROTOCOLS), F.concat(F.lit("Unsupported protocol: "), protocol)),
        need("total_bytes").issue,
        total.issue,
        packets.issue,
        duration.issue,
        F.when(~F.lower(label).isin(LABELS), F.concat(F.lit(f"Unsupported {label_column}: "), label)),
        F.when(label.isNull(), f"{label_column} is required.") if require_label else tx.no_issue(),
        src_port.issue,
    )
    keep = [c for c in ("source_file", "_block", "_order", "row_number") if c in rows.columns]
    return rows.select(
        ts.alias("ts"),
        raw("src_ip").alias("src_ip"),
        raw("direction").alias("direction"),
        raw("dst_ip").alias("dst_ip"),
        dst_port.value.alias("dst_port"),
        F.lower(protocol).alias("protocol"),
        total.value.alias("total_bytes"),
        src_port.value.cast("string").alias("src_port"),
        duration.value.alias("duration_seconds"),
        packets.value.alias("total_packets"),
        F.lower(label).alias("label"),
        issue.alias("issue"),
        *keep,
    )


def validate_normalized(
    rows: DataFrame, require_label: bool = False, label_column: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """(issues, counts). Issues: row_number, column, message. Header problems come alone."""
    header = missing_columns(rows.columns, require_label, label_column)
    spark = rows.sparkSession
    if header:
        issues = spark.createDataFrame(
            [(None, c, m) for c, m in header], "row_number bigint, column string, message string"
        )
        return issues, spark.createDataFrame([(0, 0)], "row_count bigint, valid_row_count bigint")
    parsed = parse_normalized(rows, require_label, label_column)
    bad = parsed.filter("issue IS NOT NULL")
    if "row_number" not in parsed.columns:
        bad = tx.number_rows(parsed.select("source_file", "_block", "_order", "issue"), 2).filter("issue IS NOT NULL")
    issues = bad.select(
        F.col("row_number").cast("bigint").alias("row_number"),
        F.lit(None).cast("string").alias("column"),
        F.col("issue").alias("message"),
    )
    counts = parsed.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("issue").isNull()).alias("valid_row_count")
    )
    return issues, counts


def _names(line: str | None) -> tuple[str, ...]:
    return tuple(next(csv.reader([line.removeprefix("\ufeff")]), [])) if line else ()


def header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The column names in the first line of a file; none in an empty one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(path)
    stream = codec.createInputStream(stream) if codec is not None else stream
    try:
        line = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "utf-8")).readLine()
    finally:
        stream.close()
    return _names(line)


def _first_lines(batches):
    """file, line (null if empty) and whether a task can open such a file."""
    for b in batches:
        lines, opened = [], []
        for file in b.column("file").to_pylist():
            line, ok = None, True
            try:
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_stream(path, compression="detect") as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8") as text:
                    line = text.readline().rstrip("\r\n")
            except (pa.ArrowException, OSError, ValueError):
                ok = False
            lines.append(line or None)
            opened.append(ok)
        yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(lines, pa.string()), pa.array(opened, pa.bool_())], names=["file", "line", "opened"])


def headers(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header. Of many files, tasks read the first lines; the driver reads those of a
    few, and those in stores that only Spark's own readers open."""
    out: dict[tuple[str, ...], list[str]] = {}
    rest = list(files)
    if len(rest) > DRIVER_HEADERS:
        listed = spark.createDataFrame([(f,) for f in rest], "file string").repartition(min(len(rest) // DRIVER_HEADERS + 1, 1000))
        found = listed.mapInArrow(_first_lines, "file string, line string, opened boolean").orderBy("file").toArrow().to_pylist()
        for r in found:
            if r["opened"]:
                out.setdefault(_names(r["line"]), []).append(r["file"])
        rest = [r["file"] for r in found if not r["opened"]]
    for file in rest:
        out.setdefault(header(spark, file), []).append(file)
    return out


def read_rows(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Header CSV files as text columns; globs and folders expand.

    Quotes inside a quoted field are doubled and a backslash is an ordinary character. Every file has
    its own header: files of one header are read together, and a column that a file lacks is null.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    layouts = headers(spark, spark.read.text(paths).inputFiles())
    out = None
    for names, files in layouts.items() or [((), paths)]:
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        files = [unquote(f) for f in files]  # listed as URIs, read as paths
        reader = spark.read.option("header", True).option("escape", '"').schema(schema) if names else spark.read
        rows = tx.with_place(reader.csv(files) if names else reader.text(files).drop("value"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    places = ["source_file", "_block", "_order"]
    return out.select(*[c for c in out.columns if c not in places], *places)


def read_normalized(
    spark: SparkSession,
    paths: str | Sequence[str],
    require_label: bool = False,
    label_column: str = "label",
    mode: str = "strict",
) -> DataFrame:
    """Events of one or more files. `strict` fails on the first bad row, on a bad header and on no
    rows; `collect` keeps every row with its `issue`."""
    rows = read_rows(spark, paths)
    kind = "labelled normalized" if require_label else "normalized"
    header = missing_columns(rows.columns, require_label, label_column)
    if header:
        raise ValueError(f"Invalid {kind} CSV at header: {header[0][1]}")
    parsed = parse_normalized(rows, require_label, label_column)
    if mode == "collect":
        return parsed
    tx.require_rows(rows, "Normalized CSV contains no data rows.")
    tx.raise_first_issue(parsed, 2, f"Invalid {kind} CSV at row")
    return parsed.withColumn("skip_reason", tx.no_issue()).select(*EVENT.fieldNames(), "skip_reason", "source_file")
