"""Features of flows too large for one task.

A flow of very many events is cut into slices of consecutive timestamps (for order) and value cells
(for order statistics). Rows are counted per distinct value before they move, windows run inside a
cell, and a table with one row per cell carries what a cell must know about the cells before it.
Slices are cut by rank, so a burst of any density is spread over as many as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.functions.columns import half_even, holds, within
from tidewatch.operators.ranks import ensure_checkpoint_dir
from tidewatch.schema import FeatureParams

# A flow above this many events is cut into cells.
HOT_EVENTS = 1_000_000
# Tables with a row for each hot flow are broadcast up to this many rows, and joined by key above.
BROADCAST_KEYS = 10_000
# Distinct timestamps wanted per slice.
CELL_EVENTS = 100_000
# Events a task of the window path should hold. An event is three wide rows there, and Spark would
# size tasks by compressed bytes of narrow ones.
TASK_EVENTS = 100_000


def survey(events: DataFrame, key: Sequence[str], threshold: int) -> tuple[int, DataFrame | None]:
    """The number of events, and the keys above the threshold; None when there are none.

    One pass over the key columns with map-side counts. Every such key is listed, and the list is
    written down: it decides the plan and several steps read it. The other keys are one row.
    """
    ensure_checkpoint_dir(events.sparkSession)
    counts = events.groupBy(*key).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("t_us").alias("start_us"),
        F.max("t_us").alias("end_us"),
    )
    busy = F.col("event_count") > threshold
    named = [F.when(busy, F.col(c)).alias(c) for c in (*key, "start_us", "end_us")]
    listed = counts.groupBy(*named, busy.alias("_busy")).agg(F.sum("event_count").alias("event_count")).checkpoint()
    total = listed.agg(F.sum("event_count").alias("n")).first()["n"] or 0
    top = listed.filter("_busy").select(*key, "event_count", "start_us", "end_us")
    return total, None if top.isEmpty() else top


def find_hot_keys(events: DataFrame, key: Sequence[str], threshold: int) -> DataFrame | None:
    """The keys above the threshold; None when there are none."""
    return survey(events, key, threshold)[1]


def few(per_key: DataFrame) -> DataFrame:
    """A table with one row per hot flow, broadcast where its rows are few."""
    return F.broadcast(per_key) if per_key.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else per_key


def with_hot_keys(events: DataFrame, hot_keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """Events of the hot keys, with the size and time span of their flow."""
    names = {"event_count": "_n", "start_us": "_t0", "end_us": "_t1"}
    return events.join(few(hot_keys.withColumnsRenamed(names)), list(key))


def value_cell(v: Column) -> Column:
    """Cells of about 1.5% relative width: a cell at v microseconds holds at most v/64 distinct
    values, and their number is bounded by the range of a long."""
    return F.floor(F.log2(v + F.lit(1.0)) * 64)


def _local(key: list[str], cell: str, *order) -> W:
    return W.partitionBy(*key, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)


def _running(d: DataFrame, key: list[str], at: str, order: list, sums: dict[str, str]) -> DataFrame:
    """Running totals over a flow ordered by a non-negative number, cell by cell."""
    d = d.withColumn("_cell", value_cell(F.col(at)))
    local = _local(key, "_cell", *order)
    before = W.partitionBy(*key).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = (
        d.groupBy(*key, "_cell")
        .agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
        .select(
            *key,
            "_cell",
            *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums],
        )
    )
    d = d.withColumns({f"_l_{k}": F.sum(v).over(local) for k, v in sums.items()})
    d = d.join(cells, [*key, "_cell"])
    d = d.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums})
    return d.drop("_cell", *[f"_l_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def _pick(index: Column, value: Column) -> Column:
    """The value at a 0-based position, from rows that carry `cum` and `c`."""
    return F.max(F.when((F.col("cum") - F.col("c") <= index) & (index < F.col("cum")), value))


def _median(lo: Column, n: Column, value: Column) -> Column:
    """Median of the n values that start at 0-based position lo."""
    a = _pick(lo + F.floor((n - 1) / 2), value)
    b = _pick(lo + F.floor(n / 2), value)
    return (a + b) / 2.0


def _spread(value: Column, mean: Column, weight: Column) -> Column:
    return F.sum(weight * (value - mean) * (value - mean)) / F.sum(weight)


def _bins(counted: DataFrame, key: list[str], bucket: Column, top: str, bins: str) -> DataFrame:
    return (
        counted.groupBy(*key, bucket.alias("_bin"))
        .agg(F.sum("c").alias("_c"))
        .groupBy(*key)
        .agg(F.max("_c").alias(top), F.count(F.lit(1)).alias(bins))
    )


def _gap_runs(busy: DataFrame, key: list[str]) -> DataFrame:
    """The flow's gaps in order, run-length coded: (slice, t_us, sub, gap_us, c).

    Events with one timestamp are counted before they move. A timestamp with c events gives one
    gap to the timestamp before it and c-1 gaps of zero. A slice is a range of the flows' distinct
    timestamps with about CELL_EVENTS of them, wherever in time those lie.
    """
    ensure_checkpoint_dir(busy.sparkSession)
    times = busy.groupBy(*key, "t_us").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    n = -(-times.count() // CELL_EVENTS) or 1
    times = times.repartitionByRange(n, *key, "t_us").withColumn("slice", F.spark_partition_id()).checkpoint()
    edges = (
        times.groupBy(*key, "slice")
        .agg(F.max("t_us").alias("_last"))
        .select(
            *key,
            "slice",
            F.lag("_last").over(W.partitionBy(*key).orderBy("slice")).alias("_before"),
        )
    )
    inside = F.lag("t_us").over(W.partitionBy(*key, "slice").orderBy("t_us"))
    times = times.withColumn("_prev", inside).join(edges, [*key, "slice"])
    first = F.col("t_us") - F.coalesce("_prev", "_before")
    runs = F.filter(
        F.array(
            F.struct(F.lit(0).alias("sub"), first.alias("gap_us"), F.lit(1).cast("bigint").alias("c")),
            F.struct(F.lit(1).alias("sub"), F.lit(0).cast("bigint").alias("gap_us"), (F.col("c") - 1).alias("c")),
        ),
        lambda x: x["gap_us"].isNotNull() & (x["c"] > 0),
    )
    return times.select(*key, "slice", "t_us", F.explode(runs).alias("g")).select(
        *key, "slice", "t_us", "g.sub", "g.gap_us", "g.c"
    )


def _sequence_stats(runs: DataFrame, p: FeatureParams, key: list[str]) -> DataFrame:
    """Adjacent similarity, longest similar run and bursts."""
    from tidewatch.operators.features import relative_difference, seconds

    gap, c = F.col("gap"), F.col("c")
    thr = F.lit(float(p.burst_threshold_seconds))
    order = ["t_us", "sub"]
    d = runs.withColumn("gap", seconds(F.col("gap_us")))
    inside = F.lag("gap").over(W.partitionBy(*key, "slice").orderBy(*order))
    d = d.withColumn("_inner", inside)
    tol = F.lit(p.adjacent_tolerance)
    # A slice's first row is judged against the last gap of the slice before it.
    cut = F.when(F.col("_inner").isNotNull() & (relative_difference(gap, F.col("_inner")) > tol), 1)
    cells = d.groupBy(*key, "slice").agg(
        F.min_by("gap", F.struct(*order)).alias("_first"),
        F.max_by("gap", F.struct(*order)).alias("_final"),
        F.count(cut).alias("_cuts"),
        F.count(F.when(gap > thr, 1)).alias("_sleeps"),
    )
    w = W.partitionBy(*key).orderBy("slice")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.lag("_final").over(w))
    head = F.when(
        holds(relative_difference(F.col("_first"), F.col("_before")) <= tol), 0
    ).otherwise(1)
    cells = cells.withColumn("_all_cuts", F.col("_cuts") + head)
    cells = cells.select(
        *key,
        "slice",
        "_before",
        F.coalesce(F.sum("_all_cuts").over(before), F.lit(0)).alias("_cut_offset"),
        F.coalesce(F.sum("_sleeps").over(before), F.lit(0)).alias("_sleep_offset"),
    )
    d = d.join(cells, [*key, "slice"]).withColumn("_left", F.coalesce("_inner", "_before"))
    similar = relative_difference(gap, F.col("_left")) <= tol
    local = _local(key, "slice", *order)
    d = d.withColumns({"_similar": similar, "_cut": F.when(holds(similar), 0).otherwise(1)})
    d = d.withColumns(
        {
            "_run": F.col("_cut_offset") + F.sum("_cut").over(local),
            "_burst": F.col("_sleep_offset") + F.sum(F.when(gap > thr, 1).otherwise(0)).over(local),
        }
    )
    longest = (
        d.groupBy(*key, "_run")
        .agg(F.sum("c").alias("_len"))
        .groupBy(*key)
        .agg(F.max("_len").alias("longest_similar_gap_run"))
    )
    pairs = d.groupBy(*key).agg(
        (
            (F.sum(c - 1) + F.count_if("_similar")) / F.when(F.sum("c") > 1, F.sum("c") - 1)
        ).alias("adjacent_gap_similarity_fraction")
    )
    size = F.col("_in") + 1
    bursts = (
        d.groupBy(*key, "_burst")
        .agg(F.sum(F.when(gap <= thr, c).otherwise(0)).alias("_in"))
        .filter("_in > 0")
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("burst_count"),
            F.avg(size).alias("avg_burst_size"),
            F.max(size).alias("max_burst_size"),
            F.var_pop(size).alias("burst_size_variance"),
        )
    )
    return longest.join(pairs, key).join(bursts, key, "left").fillna({"burst_count": 0})


def hot_bursts(busy: DataFrame, key: list[str], limit: Column) -> DataFrame:
    """Islands of events whose gaps stay within the limit, numbered through the slices."""
    runs = _gap_runs(busy, key)
    sleep = F.when(F.col("gap_us") / F.lit(1e6) > limit, 1).otherwise(0)
    before = W.partitionBy(*key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    cells = runs.groupBy(*key, "slice").agg(F.sum(sleep).alias("_s")).select(
        *key, "slice", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o")
    )
    d = runs.join(cells, [*key, "slice"]).withColumns(
        {
            "island": F.col("_o") + F.sum(sleep).over(_local(key, "slice", "t_us", "sub")),
            "_start": F.col("t_us") - F.col("gap_us"),
            "_sleep": sleep,
        }
    )
    inside = F.col("_sleep") == 0
    # a gap inside an island starts and ends in it; its first event is the start of its first gap
    return d.groupBy(*key, "island").agg(
        F.min(F.when(inside, F.col("_start"))).alias("burst_start_us"),
        F.max(F.when(inside, F.col("t_us"))).alias("burst_end_us"),
        (F.coalesce(F.sum(F.when(inside, F.col("c"))), F.lit(0)) + 1).alias("burst_size"),
    )


def _gap_stats(runs: DataFrame, p: FeatureParams, key: list[str]) -> DataFrame:
    from tidewatch.operators.features import seconds, sweep_end, sweep_start

    thr = F.lit(float(p.burst_threshold_seconds))
    counted = runs.groupBy(*key, "gap_us").agg(F.sum("c").alias("c")).checkpoint()
    v = _running(counted, key, "gap_us", ["gap_us"], {"cum": "c"}).withColumn(
        "gap", seconds(F.col("gap_us"))
    )
    gap, c, n = F.col("gap"), F.col("c"), F.col("_n_gaps")
    sizes = counted.groupBy(*key).agg(
        F.sum("c").alias("_n_gaps"),
        F.sum(F.when(seconds(F.col("gap_us")) <= thr, F.col("c")).otherwise(0)).alias("_n_in"),
    )
    v = v.join(few(sizes), key)
    half = F.floor(n / 2)
    trim = F.floor(n * F.lit(p.trim_fraction))
    trims = (trim > 0) & (n - 2 * trim >= 2)
    low = F.when(trims, trim).otherwise(0)
    high = F.when(trims, n - trim).otherwise(n)
    kept = F.greatest(F.least(F.col("cum"), high) - F.greatest(F.col("cum") - c, low), F.lit(0))
    v = v.withColumn("kept", kept)
    first = F.first("_n_gaps")
    # _median is called with per-row columns, so group the constants along
    center = v.groupBy(*key, "_n_gaps", "_n_in").agg(
        (F.sum(gap * c) / first).alias("mean_interarrival_seconds"),
        _median(F.lit(0), n, gap).alias("median_interarrival_seconds"),
        F.min("gap").alias("min_interarrival_seconds"),
        F.max("gap").alias("max_interarrival_seconds"),
        F.when(first > 1, _median(F.lit(0), half, gap)).alias("_lower"),
        F.when(first > 1, _median(n - half, half, gap)).alias("_upper"),
        F.when(F.first("_n_in") > 0, _median(F.lit(0), F.col("_n_in"), gap)).alias("_burst_med"),
        (F.sum(gap * F.col("kept")) / F.sum("kept")).alias("_trim_mean"),
    )
    v = v.join(few(center.drop("_n_gaps", "_n_in")), key).checkpoint()
    center = v.select(*key, "_n_gaps", *[c for c in center.columns if c not in (*key, "_n_gaps", "_n_in")]).distinct()
    med = F.col("median_interarrival_seconds")

    def share(cond: Column, of: Column = c) -> Column:
        total = F.sum(F.when(cond.isNotNull(), of))
        return F.sum(F.when(cond, of).otherwise(0)) / F.when(total > 0, total)

    sleep = gap > thr
    sleep_mean = F.col("_sleep_mean")
    v2 = v.join(
        F.broadcast(
            v.groupBy(*key).agg(
                (F.sum(F.when(sleep, gap * c)) / F.sum(F.when(sleep, c))).alias("_sleep_mean")
            )
        ),
        key,
    )
    spread = v2.groupBy(*key).agg(
        F.sqrt(_spread(gap, F.col("mean_interarrival_seconds"), c)).alias("std_interarrival_seconds"),
        F.sqrt(_spread(gap, F.col("_trim_mean"), F.col("kept"))).alias("_trim_std"),
        share(within(gap, med, p.timing_tolerance)).alias("near_median_interarrival_fraction"),
        share(within(gap, med, 0.10)).alias("interarrival_within_10pct_median_fraction"),
        share(within(gap, med, 0.20)).alias("interarrival_within_20pct_median_fraction"),
        share(within(gap, med, 0.30)).alias("interarrival_within_30pct_median_fraction"),
        share(
            F.when(~sleep, within(gap, F.col("_burst_med"), p.within_burst_tolerance)),
            F.when(~sleep, c).otherwise(0),
        ).alias("within_burst_gap_consistency"),
        F.first("_sleep_mean").alias("avg_sleep_duration_seconds"),
        (
            F.sum(F.when(sleep, c * (gap - sleep_mean) * (gap - sleep_mean)))
            / F.sum(F.when(sleep, c))
        ).alias("sleep_duration_variance"),
        F.coalesce(F.sum(F.when(~sleep, gap * c)), F.lit(0.0)).alias("_burst_seconds"),
        F.sum(F.when(sleep, gap * c)).alias("_sleep_seconds"),
    )
    # deviations from the median are values of their own, ranked the same way
    dev = (
        v.withColumn("_dev", F.abs(gap - med))
        .groupBy(*key, "_n_gaps", "_dev")
        .agg(F.sum("c").alias("c"))
        .withColumn("_dev_us", F.rint(F.col("_dev") * 1e6))
    )
    dev = _running(dev, key, "_dev_us", ["_dev"], {"cum": "c"})
    mad = dev.groupBy(*key, "_n_gaps").agg(_median(F.lit(0), n, F.col("_dev")).alias("_mad")).drop("_n_gaps")
    width = F.greatest(F.lit(p.minimum_bin_width), F.abs(med) * F.lit(p.relative_bin_width))
    bins = _bins(v, key, half_even(gap / width), "_bin_top", "_bins")
    g, tol = F.col("gap_us"), p.timing_tolerance
    marks = F.array(
        F.struct(sweep_start(g, tol).alias("at"), c.alias("step"), F.lit(0).alias("kind")),
        F.struct((sweep_end(g, tol) + 1).alias("at"), (-c).alias("step"), F.lit(0).alias("kind")),
        F.struct(g.alias("at"), F.lit(0).cast("bigint").alias("step"), F.lit(1).alias("kind")),
    )
    # marks at one place are summed first, so a popular place is one row per kind
    sweep = (
        counted.select(*key, F.explode(marks).alias("m"))
        .groupBy(*key, F.col("m.at").alias("at"), F.col("m.kind").alias("kind"))
        .agg(F.sum("m.step").alias("step"))
    )
    band = (
        _running(sweep, key, "at", ["at", "kind"], {"band": "step"})
        .filter("kind = 1")
        .groupBy(*key)
        .agg(F.max("band").alias("_band"))
    )
    # every part has one row per hot flow
    return center.drop("_burst_med", "_trim_mean").join(
        few(center.select(*key, "_trim_mean")), key
    ).join(few(spread), key).join(few(mad), key).join(
        few(bins), key
    ).join(few(band), key)


def _size_stats(busy: DataFrame, p: FeatureParams, key: list[str]) -> DataFrame:
    counted = busy.groupBy(*key, "size_bytes").agg(F.count(F.lit(1)).alias("c")).checkpoint()
    v = _running(counted, key, "size_bytes", ["size_bytes"], {"cum": "c"})
    size, c = F.col("size_bytes"), F.col("c")
    totals = counted.groupBy(*key).agg(F.sum("c").alias("_n_sizes"))
    v = v.join(few(totals), key)
    center = v.groupBy(*key, "_n_sizes").agg(
        (F.sum(size * c) / F.sum("c")).alias("mean_size_bytes"),
        _median(F.lit(0), F.col("_n_sizes"), size).alias("median_size_bytes"),
        F.min("size_bytes").alias("_size_min"),
        F.max("size_bytes").alias("_size_max"),
    ).drop("_n_sizes")
    v = v.join(few(center), key)
    med = F.col("median_size_bytes")
    near = F.sum(F.when(within(size, med, p.size_tolerance), c).otherwise(0))
    spread = v.groupBy(*key).agg(
        F.sqrt(_spread(size, F.col("mean_size_bytes"), c)).alias("std_size_bytes"),
        (near / F.sum("c")).alias("near_median_size_fraction"),
    )
    width = F.greatest(F.lit(p.minimum_bin_width), F.abs(med) * F.lit(p.relative_bin_width))
    bins = _bins(v, key, half_even(size / width), "_size_bin_top", "size_bin_count")
    return center.join(few(spread), key).join(few(bins), key)


def sliced_path(busy: DataFrame, p: FeatureParams, key: list[str]) -> DataFrame:
    """Aggregates of hot flows, with the same columns as the window path."""
    from tidewatch.operators.flows import measure_aggs

    columns = [c for c in busy.columns if c not in ("_n", "_t0", "_t1")]
    base = busy.groupBy(*key).agg(*measure_aggs(columns, key))
    ensure_checkpoint_dir(busy.sparkSession)
    runs = _gap_runs(busy, key).checkpoint()  # read by several aggregations below
    out = base
    for part in (_gap_stats(runs, p, key), _sequence_stats(runs, p, key), _size_stats(busy, p, key)):
        out = out.join(few(part), key, "left")
    return out.fillna({"burst_count": 0, "_n_gaps": 0, "_burst_seconds": 0.0})
