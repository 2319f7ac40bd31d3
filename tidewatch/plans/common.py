"""Shared parts of the registered queries and of the SQL that checks them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.features import flow_features
from tidewatch.operators.ranks import ensure_checkpoint_dir
from tidewatch.plans.views import FLOW_EVENTS_SQL, flow_events
from tidewatch.schema import BASELINE_RULES, FEATURES, OPS_KEY, FeatureParams

# The test events are days apart, so the queries use thresholds of that size.
PARAMS = FeatureParams(burst_threshold_seconds=43200.0)
RULES = replace(
    BASELINE_RULES,
    periodic_cv_threshold=0.75,
    strong_periodic_cv_threshold=0.5,
    stable_size_cv_threshold=0.8,
    constant_size_cv_threshold=0.6,
    long_repetition_min_mean_interarrival_seconds=86400.0,
    long_repetition_max_mean_interarrival_seconds=345600.0,
    moderate_jitter_cv_threshold=0.75,
    moderate_jitter_size_cv_threshold=0.8,
    burst_min_avg_sleep_seconds=86400.0,
    burst_strong_sleep_seconds=172800.0,
)
KEY = ", ".join(OPS_KEY)


# Keeps exact decimals off the rounding ties the two engines break differently.
OFF = 1.0000000000012


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to nine significant digits (both engines sum in their own order), arrays to text."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "double":
            c = F.format_string("%.8e", F.round(c * F.lit(OFF), 6) * F.lit(OFF) + 0.0).cast("double")
            c = F.when(F.col(f"`{name}`").isNotNull(), c)
        elif kind == "array<string>":
            c = F.array_join(c, ";")
        out.append(c.alias(name))
    return df.select(*out)


def num(expr: str, name: str | None = None) -> str:
    """The same rounding in SQL."""
    return f"CAST(format('{{:.8e}}', round(CAST({expr} AS DOUBLE) * {OFF}::DOUBLE, 6) * {OFF}::DOUBLE + 0.0) AS DOUBLE) AS {name or expr}"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return flow_events(spark, sf).drop("event_id")


def features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the operational flows, straight from the events."""
    return flow_features(events(spark, sf), PARAMS)


_stored: dict[tuple, DataFrame] = {}


def stored(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """A table several queries read, checkpointed once per session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        ensure_checkpoint_dir(spark)
        _stored[key] = make(spark, sf).checkpoint()
    return _stored[key]


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table the detectors and studies read."""
    return stored(spark, sf, "features", features)


def features_sql(key: str = KEY, thr: float = 43200.0, source: str = FLOW_EVENTS_SQL) -> str:
    """CTEs ending in `ff`, one row per flow with every feature, written with lists."""
    rel = "abs(gaps[j]-gaps[j+1])/greatest(abs(gaps[j]),abs(gaps[j+1]),1e-12::DOUBLE)"
    near = "CASE WHEN n>0 THEN len(list_filter(gaps, lambda x: abs(x-med) <= abs(med)*{t}::DOUBLE))/n::DOUBLE END"
    flags = "array_to_string(list_transform(gaps, lambda x: CASE WHEN x <= {thr} THEN 'x' ELSE 'o' END), '')"
    return f"""
fe AS ({source}),
fl AS (SELECT {key}, count(*) AS event_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  min(t_us) AS start_us, max(t_us) AS end_us, list(t_us ORDER BY t_us) AS ts,
  list(CAST(size_bytes AS DOUBLE) ORDER BY size_bytes) AS sz, min(label) AS label,
  count(*) FILTER (label='benign') AS benign_events, count(*) FILTER (label='beacon') AS beacon_events,
  array_to_string(list_sort(list(DISTINCT scenario_name)), ',') AS scenario_name,
  array_to_string(list_sort(list(DISTINCT src_port)), ';') AS src_ports FROM fe GROUP BY ALL),
g1 AS (SELECT *, list_transform(range(1, len(ts)), lambda j: (ts[j+1]-ts[j])/1e6::DOUBLE) AS gaps FROM fl),
g2 AS (SELECT *, list_sort(gaps) AS sg, len(gaps) AS n, len(sz) AS ns FROM g1),
g3 AS (SELECT *, CASE WHEN n>0 THEN (sg[(n+1)//2]+sg[n//2+1])/2 END AS med, (sz[(ns+1)//2]+sz[ns//2+1])/2 AS smed,
  list_filter(gaps, lambda x: x <= {thr}) AS bg, list_filter(gaps, lambda x: x > {thr}) AS sl,
  list_sort(list_filter(gaps, lambda x: x <= {thr})) AS sbg,
  list_filter(list_transform(string_split({flags.format(thr=thr)}, 'o'), lambda s: len(s)+1), lambda b: b >= 2) AS bursts,
  CASE WHEN CAST(floor(n*0.1::DOUBLE) AS BIGINT)>0 AND n-2*CAST(floor(n*0.1::DOUBLE) AS BIGINT)>=2
    THEN sg[CAST(floor(n*0.1::DOUBLE) AS BIGINT)+1 : n-CAST(floor(n*0.1::DOUBLE) AS BIGINT)] ELSE sg END AS tg,
  sg[1:n//2] AS lo, sg[n-n//2+1:n] AS hi FROM g2),
g4 AS (SELECT *, list_sort(list_transform(gaps, lambda x: abs(x-med))) AS dev, len(lo) AS h,
  CASE WHEN len(bg)>0 THEN (sbg[(len(bg)+1)//2]+sbg[len(bg)//2+1])/2 END AS bmed,
  map_values(list_histogram(list_transform(gaps, lambda x: round_even(x/greatest(1.0::DOUBLE, abs(med)*0.2::DOUBLE), 0)))) AS gb,
  map_values(list_histogram(list_transform(sz, lambda x: round_even(x/greatest(1.0::DOUBLE, abs(smed)*0.2::DOUBLE), 0)))) AS sb,
  (end_us-start_us)/1e6::DOUBLE AS dur FROM g3),
f0 AS (SELECT *, dur AS flow_duration_seconds,
  list_avg(gaps) AS mean_interarrival_seconds, med AS median_interarrival_seconds,
  list_stddev_pop(gaps) AS std_interarrival_seconds, list_min(gaps) AS min_interarrival_seconds,
  list_max(gaps) AS max_interarrival_seconds,
  CASE WHEN n>=2 THEN (hi[(h+1)//2]+hi[h//2+1])/2 - (lo[(h+1)//2]+lo[h//2+1])/2 END AS interarrival_iqr_seconds,
  CASE WHEN n>=2 THEN (dev[(n+1)//2]+dev[n//2+1])/2 END AS interarrival_mad_seconds,
  list_stddev_pop(gaps)/nullif(list_avg(gaps),0) AS inter_arrival_cv,
  CASE WHEN n>=2 THEN list_stddev_pop(tg)/nullif(list_avg(tg),0) END AS trimmed_interarrival_cv,
  {near.format(t=0.2)} AS near_median_interarrival_fraction,
  {near.format(t=0.1)} AS interarrival_within_10pct_median_fraction,
  {near.format(t=0.2)} AS interarrival_within_20pct_median_fraction,
  {near.format(t=0.3)} AS interarrival_within_30pct_median_fraction,
  CASE WHEN n>0 THEN list_max(list_transform(gaps, lambda c: len(list_filter(gaps, lambda v: abs(v-c) <= abs(c)*0.2::DOUBLE))))/n::DOUBLE END
    AS dominant_interval_fraction,
  CASE WHEN n>0 THEN list_max(gb)/n::DOUBLE END AS dominant_interval_bin_fraction,
  CASE WHEN n>0 THEN len(gb) END AS interval_bin_count,
  CASE WHEN n>1 THEN len(list_filter(range(1, n), lambda j: {rel} <= 0.3::DOUBLE))/(n-1)::DOUBLE END
    AS adjacent_gap_similarity_fraction,
  CASE WHEN n>0 THEN 1+list_max(list_transform(string_split(array_to_string(list_transform(range(1, n),
    lambda j: CASE WHEN {rel} <= 0.3::DOUBLE THEN 'x' ELSE 'o' END), ''), 'o'), lambda s: len(s))) END AS longest_similar_gap_run,
  (list_max(gaps)-list_min(gaps))/nullif(abs(med),0) AS gap_range_median_ratio,
  CASE WHEN n>0 THEN (dev[(n+1)//2]+dev[n//2+1])/2/nullif(abs(med),0) END
    AS interarrival_median_absolute_percentage_deviation,
  event_count/nullif(dur,0) AS events_per_second, event_count/nullif(dur,0)*60 AS events_per_minute,
  len(bursts) AS burst_count, list_avg(bursts) AS avg_burst_size, list_max(bursts) AS max_burst_size,
  list_var_pop(bursts) AS burst_size_variance, list_avg(sl) AS avg_sleep_duration_seconds,
  list_var_pop(sl) AS sleep_duration_variance,
  list_stddev_pop(bursts)/nullif(list_avg(bursts),0) AS burst_size_cv,
  list_stddev_pop(sl)/nullif(list_avg(sl),0) AS sleep_duration_cv,
  CASE WHEN len(bg)>0 THEN len(list_filter(bg, lambda x: abs(x-bmed) <= abs(bmed)*0.3::DOUBLE))/len(bg)::DOUBLE END
    AS within_burst_gap_consistency,
  CASE WHEN list_sum(sl)>0 THEN coalesce(list_sum(bg),0)/list_sum(sl) END AS burst_to_idle_ratio,
  list_avg(sz) AS mean_size_bytes, smed AS median_size_bytes, list_stddev_pop(sz) AS std_size_bytes,
  list_stddev_pop(sz)/nullif(list_avg(sz),0) AS size_cv, list_max(sb)/ns::DOUBLE AS dominant_size_bin_fraction,
  len(sb) AS size_bin_count, (list_max(sz)-list_min(sz))/nullif(abs(smed),0) AS normalized_size_range,
  len(list_filter(sz, lambda x: abs(x-smed) <= abs(smed)*0.2::DOUBLE))/ns::DOUBLE AS near_median_size_fraction FROM g4),
ff AS (SELECT * EXCLUDE (ts, sz, gaps, sg, n, ns, med, smed, bg, sl, sbg, bursts, tg, lo, hi, dev, h, bmed, gb, sb, dur),
  near_median_interarrival_fraction/(1+trimmed_interarrival_cv) AS periodicity_score FROM f0)"""


INTEGERS = {
    "event_count", "total_bytes", "interval_bin_count", "longest_similar_gap_run", "burst_count",
    "max_burst_size", "size_bin_count",
}


def feature_select(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c in INTEGERS else num(c) for c in columns)


def feature_sql(columns: list[str], key: str = KEY) -> str:
    return f"WITH {features_sql(key)} SELECT {key}, {feature_select(columns)} FROM ff"


ALL_FEATURES_SQL = feature_select(FEATURES)


def as_integers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in df.columns if c in INTEGERS})
