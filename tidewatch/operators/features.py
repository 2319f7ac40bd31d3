"""Flow features: one wide row per flow.

Ordinary flows take one exchange on the flow key, to as many tasks as their events need; every window
and the closing aggregation run on that partitioning. Flows that hold very many events take the sliced path in `hot_flows`, which
never gathers a flow in one task. Both give the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import half_even, holds, ratio, within
from tidewatch.operators import hot_flows as hot
from tidewatch.operators.flows import (
    apply_mixed_policy,
    keyed,
    measure_aggs,
    unkeyed,
)
from tidewatch.schema import FEATURES, OPS_KEY, FeatureParams


def seconds(us: Column) -> Column:
    return us / F.lit(1e6)


def relative_difference(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def sweep_start(v_us: Column, tol: float) -> Column:
    """Smallest centre, on the microsecond grid, whose tolerance band reaches up to v."""
    guess = F.floor(v_us / F.lit(1.0 + tol))

    def reaches(c: Column) -> Column:
        return within(seconds(v_us), seconds(c), tol)

    return (
        F.when(reaches(guess - 1), guess - 1)
        .when(reaches(guess), guess)
        .when(reaches(guess + 1), guess + 1)
        .otherwise(guess + 2)
    )


def sweep_end(v_us: Column, tol: float) -> Column:
    """Largest centre whose tolerance band reaches down to v."""
    if tol >= 1.0:
        return F.when(v_us > 0, F.lit(1 << 60)).otherwise(F.lit(0))
    guess = F.floor(v_us / F.lit(1.0 - tol))

    def reaches(c: Column) -> Column:
        return within(seconds(v_us), seconds(c), tol)

    return (
        F.when(reaches(guess + 1), guess + 1)
        .when(reaches(guess), guess)
        .when(reaches(guess - 1), guess - 1)
        .otherwise(guess - 2)
    )


def flow_features(
    events: DataFrame,
    params: FeatureParams = FeatureParams(),
    key: Sequence[str] = OPS_KEY,
    mixed: str = "reject",
    hot_threshold: int | None = hot.HOT_EVENTS,
    hot_keys: DataFrame | None = None,
) -> DataFrame:
    """All features of every flow.

    `hot_keys` may carry the busiest keys if they are already known (columns: key, event_count,
    start_us, end_us); otherwise one counting pass over the key columns finds them, unless
    `hot_threshold` is None because flows are known to be short; then events are only counted. `key`
    may hold more than the flow key, e.g. a seed or an evidence size.
    """
    key = list(key)
    ev = keyed(events, key)
    if hot_keys is None and hot_threshold is not None:
        total, hot_keys = hot.survey(ev, key, hot_threshold)
    else:
        total = ev.count()
    if hot_keys is None:
        out = _dealt(ev, params, key, total)
    else:
        plain = ev.join(hot.few(hot_keys.select(*key)), key, "left_anti")
        busy = hot.with_hot_keys(ev, hot_keys, key)
        out = _dealt(plain, params, key, total).unionByName(hot.sliced_path(busy, params, key))
    out = finish_features(out)
    if "label" in events.columns:
        out = apply_mixed_policy(out, mixed)
    lead = [c for c in ("label", "scenario_name", "src_ports") if c in out.columns]
    extra = [c for c in ("benign_events", "beacon_events") if c in out.columns]
    return unkeyed(out, key).select(*key, *lead, *extra, "start_us", "end_us", *FEATURES)


def _dealt(ev: DataFrame, params: FeatureParams, key: list[str], total: int) -> DataFrame:
    """The window path over whole flows, in as many tasks as `total` events need.

    Flows are dealt by a hash of their key, which the windows keep as a part of it: parts of the key
    may be constants, which the optimizer takes out of windows, and then a second exchange follows.
    """
    n = -(-total // hot.TASK_EVENTS)
    if n <= 1:
        return _window_path(ev, params, key)
    n = max(n, ev.sparkSession.sparkContext.defaultParallelism)
    spread = ev.withColumn("_p", F.xxhash64(*key)).repartition(n, "_p")
    return _window_path(spread, params, ["_p", *key]).drop("_p")


def _window_path(ev: DataFrame, p: FeatureParams, key: list[str]) -> DataFrame:
    by_time = W.partitionBy(*key).orderBy("t_us")
    so_far = by_time.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*key)
    thr = F.lit(float(p.burst_threshold_seconds))
    gap = F.col("gap")

    # 1. time order: gaps, runs of similar gaps, bursts
    d = ev.withColumn("gap_us", F.col("t_us") - F.lag("t_us").over(by_time))
    d = d.withColumns(
        {
            "gap": seconds(F.col("gap_us")),
            "i": F.row_number().over(by_time),
        }
    )
    prev = F.lag("gap").over(by_time)
    nxt = F.lead("gap").over(by_time)
    d = d.withColumns(
        {
            "similar": relative_difference(gap, prev) <= F.lit(p.adjacent_tolerance),
            "burst_ends": nxt.isNull() | (nxt > thr),
        }
    )
    d = d.withColumns(
        {
            "run_from": F.max(F.when(~holds(F.col("similar")), F.col("i"))).over(so_far),
            "burst_from": F.max(F.when(gap.isNull() | (gap > thr), F.col("i"))).over(so_far),
        }
    )
    # 2. centres over the whole flow (no further sort)
    d = d.withColumns(
        {
            "n_gaps": F.count("gap").over(whole),
            "med": F.percentile("gap", F.lit(0.5)).over(whole),
            "burst_med": F.percentile(F.when(gap <= thr, gap), F.lit(0.5)).over(whole),
            "size_med": F.percentile("size_bytes", F.lit(0.5)).over(whole),
        }
    )
    # 3. size order: bins
    by_size = W.partitionBy(*key).orderBy("size_bytes")
    sized = by_size.rowsBetween(W.unboundedPreceding, 0)
    width = F.greatest(
        F.lit(p.minimum_bin_width), F.abs(F.col("size_med")) * F.lit(p.relative_bin_width)
    )
    d = d.withColumns(
        {"size_bin": half_even(F.col("size_bytes") / width), "s": F.row_number().over(by_size)}
    )
    d = d.withColumn("size_bin_new", ~holds(F.col("size_bin") == F.lag("size_bin").over(by_size)))
    d = d.withColumn("size_bin_from", F.max(F.when(F.col("size_bin_new"), F.col("s"))).over(sized))

    # 4. gap order: ranks, bins and the sweep for the dominant gap. Each gap opens a band of
    # centres it would count for and closes it again; the running sum at a gap is its count.
    width = F.greatest(
        F.lit(p.minimum_bin_width), F.abs(F.col("med")) * F.lit(p.relative_bin_width)
    )
    d = d.withColumn("gap_bin", half_even(gap / width))
    row_columns = [c for c in d.columns if c not in key]
    g = F.col("gap_us")
    tol = p.timing_tolerance
    marks = F.when(
        g.isNotNull(),
        F.array(
            F.struct(sweep_start(g, tol).alias("at"), F.lit(1).alias("step"), F.lit(0).alias("kind")),
            F.struct((sweep_end(g, tol) + 1).alias("at"), F.lit(-1).alias("step"), F.lit(0).alias("kind")),
            F.struct(g.alias("at"), F.lit(0).alias("step"), F.lit(1).alias("kind")),
        ),
    ).otherwise(
        F.array(F.struct(g.alias("at"), F.lit(0).alias("step"), F.lit(1).alias("kind")))
    )
    d = d.withColumn("m", F.explode(marks))
    is_row = F.col("m.kind") == 1
    d = d.select(
        *key,
        F.col("m.at").alias("at"),
        F.col("m.step").alias("step"),
        F.col("m.kind").alias("kind"),
        *[F.when(is_row, F.col(c)).alias(c) for c in row_columns],
    )
    by_gap = W.partitionBy(*key).orderBy(F.col("at").asc_nulls_last(), "kind")
    swept = by_gap.rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns(
        {
            "r": F.count("gap").over(swept),
            "band": F.sum("step").over(swept),
            "bin_before": F.last("gap_bin", ignorenulls=True).over(
                by_gap.rowsBetween(W.unboundedPreceding, -1)
            ),
        }
    )
    d = d.withColumn("bin_new", gap.isNotNull() & ~holds(F.col("gap_bin") == F.col("bin_before")))
    d = d.withColumn("bin_from", F.max(F.when(F.col("bin_new"), F.col("r"))).over(swept))

    n, r, med = F.col("n_gaps"), F.col("r"), F.col("med")
    half = F.floor(n / 2)
    trim = F.floor(n * F.lit(p.trim_fraction))
    trims = (trim > 0) & (n - 2 * trim >= 2)
    kept = F.when(~trims | ((r > trim) & (r <= n - trim)), gap)
    burst_size = F.when(
        F.col("burst_ends") & (F.col("i") > F.col("burst_from")),
        F.col("i") - F.col("burst_from") + 1,
    )
    sleep = F.when(gap > thr, gap)
    in_burst = F.when(gap <= thr, gap)
    size, size_med = F.col("size_bytes"), F.col("size_med")

    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))

    base = measure_aggs(ev.columns, key)
    return d.groupBy(*key).agg(
        *base,
        F.avg("gap").alias("mean_interarrival_seconds"),
        F.max("med").alias("median_interarrival_seconds"),
        F.stddev_pop("gap").alias("std_interarrival_seconds"),
        F.min("gap").alias("min_interarrival_seconds"),
        F.max("gap").alias("max_interarrival_seconds"),
        F.percentile(F.when(r <= half, gap), F.lit(0.5)).alias("_lower"),
        F.percentile(F.when(r > n - half, gap), F.lit(0.5)).alias("_upper"),
        F.percentile(F.abs(gap - med), F.lit(0.5)).alias("_mad"),
        F.stddev_pop(kept).alias("_trim_std"),
        F.avg(kept).alias("_trim_mean"),
        share(within(gap, med, p.timing_tolerance)).alias("near_median_interarrival_fraction"),
        share(within(gap, med, 0.10)).alias("interarrival_within_10pct_median_fraction"),
        share(within(gap, med, 0.20)).alias("interarrival_within_20pct_median_fraction"),
        share(within(gap, med, 0.30)).alias("interarrival_within_30pct_median_fraction"),
        F.max(F.when(gap.isNotNull(), F.col("band"))).alias("_band"),
        F.max(F.when(gap.isNotNull(), r - F.col("bin_from") + 1)).alias("_bin_top"),
        F.count_if("bin_new").alias("_bins"),
        share(F.col("similar")).alias("adjacent_gap_similarity_fraction"),
        F.max(F.when(gap.isNotNull(), F.greatest(F.col("i") - F.col("run_from") + 1, F.lit(1)))).alias(
            "longest_similar_gap_run"
        ),
        F.count("gap").alias("_n_gaps"),
        F.count(burst_size).alias("burst_count"),
        F.avg(burst_size).alias("avg_burst_size"),
        F.max(burst_size).alias("max_burst_size"),
        F.var_pop(burst_size).alias("burst_size_variance"),
        F.avg(sleep).alias("avg_sleep_duration_seconds"),
        F.var_pop(sleep).alias("sleep_duration_variance"),
        share(within(in_burst, F.col("burst_med"), p.within_burst_tolerance)).alias(
            "within_burst_gap_consistency"
        ),
        F.coalesce(F.sum(in_burst), F.lit(0.0)).alias("_burst_seconds"),
        F.sum(sleep).alias("_sleep_seconds"),
        F.avg("size_bytes").alias("mean_size_bytes"),
        F.max("size_med").alias("median_size_bytes"),
        F.stddev_pop("size_bytes").alias("std_size_bytes"),
        F.min("size_bytes").alias("_size_min"),
        F.max("size_bytes").alias("_size_max"),
        F.max(F.col("s") - F.col("size_bin_from") + 1).alias("_size_bin_top"),
        F.count_if("size_bin_new").alias("size_bin_count"),
        share(within(size, size_med, p.size_tolerance)).alias("near_median_size_fraction"),
    )


def finish_features(d: DataFrame) -> DataFrame:
    """The features that follow from other aggregates of the same flow."""
    c = F.col
    n, n_gaps = c("event_count"), c("_n_gaps")
    two = n_gaps >= 2
    dur = seconds(c("end_us") - c("start_us"))
    tcv = F.when(two, ratio(c("_trim_std"), c("_trim_mean")))
    per_second = n / F.when(dur > 0, dur)
    med = c("median_interarrival_seconds")
    return d.withColumns(
        {
            "flow_duration_seconds": dur,
            "interarrival_iqr_seconds": F.when(two, c("_upper") - c("_lower")),
            "interarrival_mad_seconds": F.when(two, c("_mad")),
            "inter_arrival_cv": ratio(c("std_interarrival_seconds"), c("mean_interarrival_seconds")),
            "trimmed_interarrival_cv": tcv,
            "dominant_interval_fraction": ratio(c("_band"), n_gaps),
            "dominant_interval_bin_fraction": ratio(c("_bin_top"), n_gaps),
            "interval_bin_count": F.when(n_gaps > 0, c("_bins")),
            "gap_range_median_ratio": ratio(
                c("max_interarrival_seconds") - c("min_interarrival_seconds"), F.abs(med)
            ),
            "interarrival_median_absolute_percentage_deviation": ratio(c("_mad"), F.abs(med)),
            "periodicity_score": c("near_median_interarrival_fraction") / (F.lit(1.0) + tcv),
            "events_per_second": per_second,
            "events_per_minute": per_second * 60.0,
            "burst_size_cv": ratio(F.sqrt("burst_size_variance"), c("avg_burst_size")),
            "sleep_duration_cv": ratio(
                F.sqrt("sleep_duration_variance"), c("avg_sleep_duration_seconds")
            ),
            "burst_to_idle_ratio": c("_burst_seconds")
            / F.when(c("_sleep_seconds") > 0, c("_sleep_seconds")),
            "size_cv": ratio(c("std_size_bytes"), c("mean_size_bytes")),
            "dominant_size_bin_fraction": c("_size_bin_top") / n,
            "normalized_size_range": ratio(c("_size_max") - c("_size_min"), F.abs(c("median_size_bytes"))),
        }
    )
