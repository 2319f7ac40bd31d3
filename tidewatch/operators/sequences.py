"""Gaps and bursts as rows, for flows of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators import hot_flows as hot
from tidewatch.operators.flows import keyed, unkeyed


def gaps(events: DataFrame, key: Sequence[str], hot_threshold: int = hot.HOT_EVENTS) -> DataFrame:
    """One row per inter-arrival gap: key, t_us (of the later event), gap_seconds."""
    key = list(key)
    return unkeyed(_gap_rows(keyed(events, key), key, hot_threshold), key).select(
        *key, "t_us", (F.col("gap_us") / F.lit(1e6)).alias("gap_seconds")
    )


def _gap_rows(ev: DataFrame, key: list[str], threshold: int) -> DataFrame:
    lag = F.lag("t_us").over(W.partitionBy(*key).orderBy("t_us"))
    busy_keys = hot.find_hot_keys(ev, key, threshold)
    plain = ev
    if busy_keys is not None:
        plain = ev.join(hot.few(busy_keys.select(*key)), key, "left_anti")
    rows = plain.select(*key, "t_us", (F.col("t_us") - lag).alias("gap_us")).filter("gap_us IS NOT NULL")
    if busy_keys is None:
        return rows
    busy = hot.with_hot_keys(ev, busy_keys, key)
    runs = hot._gap_runs(busy, key)
    # one row per gap again, in two steps so that no array grows with the flow
    step = 1_000_000
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / step)))
    runs = runs.select(*key, "t_us", "gap_us", "c", parts.alias("_p"))
    left = F.least(F.lit(step), F.col("c") - F.col("_p") * step).cast("int")
    runs = runs.withColumn("_r", F.explode(F.array_repeat(F.lit(1), left)))
    return rows.unionByName(runs.select(*key, "t_us", "gap_us"))


def bursts(
    events: DataFrame, key: Sequence[str], threshold_seconds: float, hot_threshold: int = hot.HOT_EVENTS
) -> DataFrame:
    """One row per burst of two or more events: key, first and last time, size."""
    key = list(key)
    ev = keyed(events, key)
    busy_keys = hot.find_hot_keys(ev, key, hot_threshold)
    plain = ev
    if busy_keys is not None:
        plain = ev.join(hot.few(busy_keys.select(*key)), key, "left_anti")
    w = W.partitionBy(*key).orderBy("t_us")
    limit = F.lit(float(threshold_seconds))
    d = plain.select(*key, "t_us", ((F.col("t_us") - F.lag("t_us").over(w)) / F.lit(1e6)).alias("gap"))
    # rows of one time must share an island: the frame ends with the current row, ties have gap 0
    island = F.sum(F.when(F.col("gap") > limit, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = (
        d.withColumn("island", island)
        .groupBy(*key, "island")
        .agg(
            F.min("t_us").alias("burst_start_us"),
            F.max("t_us").alias("burst_end_us"),
            F.count(F.lit(1)).alias("burst_size"),
        )
    )
    if busy_keys is not None:
        out = out.unionByName(hot.hot_bursts(hot.with_hot_keys(ev, busy_keys, key), key, limit))
    return unkeyed(out.filter("burst_size >= 2").drop("island"), key)
