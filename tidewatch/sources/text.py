"""Reading text columns strictly: every parser gives a value and the message of its first problem."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INT = r"^[+-]?[0-9]+$"
FLOAT = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


@dataclass(frozen=True)
class Parsed:
    value: Column
    issue: Column


def text_or_null(raw: Column, tokens: tuple[str, ...] = ("",)) -> Column:
    """Trimmed text; blank or a null token is null."""
    t = F.trim(raw)
    return F.when(t.isin(*tokens), None).otherwise(t)


def no_issue() -> Column:
    return F.lit(None).cast("string")


def required(text: Column, message: Column | str) -> Parsed:
    m = F.lit(message) if isinstance(message, str) else message
    return Parsed(text, F.when(text.isNull(), m))


def integer(text: Column, name: str) -> Parsed:
    ok = text.rlike(INT)
    v = F.when(ok, text.try_cast("bigint"))
    return Parsed(v, F.when(text.isNotNull() & v.isNull(), f"{name} must be an integer."))


def non_negative(p: Parsed, name: str) -> Parsed:
    return Parsed(p.value, F.coalesce(p.issue, F.when(p.value < 0, f"{name} must be non-negative.")))


def port(text: Column, name: str) -> Parsed:
    p = integer(text, name)
    out = F.when((p.value < 0) | (p.value > 65535), f"{name} must be between 0 and 65535.")
    return Parsed(F.when(p.value.between(0, 65535), p.value).cast("int"), F.coalesce(p.issue, out))


def number(text: Column, name: str) -> Parsed:
    v = F.when(text.rlike(FLOAT), text.try_cast("double"))
    return Parsed(v, F.when(text.isNotNull() & v.isNull(), f"{name} must be numeric."))


def iso_timestamp(text: Column) -> Column:
    """ISO-8601; without an offset it is UTC (the session zone)."""
    return F.when(text.rlike(ISO), text.try_cast("timestamp"))


def first_issue(*issues: Column) -> Column:
    return F.coalesce(*issues)


def with_place(df: DataFrame) -> DataFrame:
    """Where a row came from: file, block of the file, order inside the block."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_order"),
    )


def number_rows(df: DataFrame, first: int) -> DataFrame:
    """`row_number` inside each file. A block is bounded by maxPartitionBytes, so ranking runs per
    block and a small table carries the counts of the blocks before it."""
    blocks = df.groupBy("source_file", "_block").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy("source_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "source_file", "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o")
    )
    local = F.row_number().over(W.partitionBy("source_file", "_block").orderBy("_order"))
    return (
        df.withColumn("_r", local)
        .join(blocks, ["source_file", "_block"])
        .withColumn("row_number", F.col("_o") + F.col("_r") + (first - 1))
        .drop("_r", "_o")
    )


def raise_first_issue(events: DataFrame, first: int, where: str) -> None:
    """Fail with the first bad row, as a strict load does. Ranks rows only when there is one."""
    bad = events.filter("issue IS NOT NULL")
    if not bad.limit(1).count():
        return
    row = (
        number_rows(events.select("source_file", "_block", "_order", "issue"), first)
        .filter("issue IS NOT NULL")
        .orderBy("source_file", "row_number")
        .first()
    )
    raise ValueError(f"{where} {row['row_number']}: {row['issue']}")


def require_rows(df: DataFrame, message: str) -> None:
    if df.isEmpty():
        raise ValueError(message)
