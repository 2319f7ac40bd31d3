"""Registered queries: z-score detector and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import evaluate as ev
from tidewatch.operators import rules as rl
from tidewatch.operators import zscore as zs
from tidewatch.operators.features import flow_features
from tidewatch.plans.common import KEY, PARAMS, RULES, events, feature_table, features_sql, num, stored, tidy
from tidewatch.plans.q_flows import RULED_SQL, SCORE_SQL, TRIGGERED_SQL
from tidewatch.schema import OPS_KEY, ZSCORE_FEATURES, ZScoreParams

Q: dict = {}
S: dict = {}
T = RULES


def cases(f):
    """Case and seed of a feature row, as a labelled evaluation table would carry them."""
    return f.withColumns(
        {
            "case_name": F.concat(F.lit("case_"), F.col("dst_port").cast("string")),
            "seed": (F.substring("src_ip", 2, 9).cast("int") % 5),
        }
    )


CASES_SQL = "concat('case_', dst_port) AS case_name, CAST(substr(src_ip, 2) AS INT) % 5 AS seed"
KEEP = [*OPS_KEY, "case_name", "seed"]


def records(s, d):
    """Rule predictions over the whole feature table."""
    return ev.prediction_records(rl.detect_rules(cases(feature_table(s, d)), T), KEEP)


REC_SQL = f"""{RULED_SQL}, rec AS (SELECT {KEY}, {CASES_SQL}, 'rule_baseline_v2_hardened_final' AS detector_name, scenario_name,
 label AS true_label, CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label, score,
 2.2::DOUBLE AS threshold, event_count, replace(triggered_rules, ' | ', ';') AS triggered_rules FROM ru)"""
CONF_SQL = """count(*) FILTER (true_label='beacon' AND predicted_label='beacon') AS tp,
 count(*) FILTER (true_label<>'beacon' AND predicted_label='beacon') AS fp,
 count(*) FILTER (true_label<>'beacon' AND predicted_label<>'beacon') AS tn,
 count(*) FILTER (true_label='beacon' AND predicted_label<>'beacon') AS fn"""
MET_SQL = """coalesce(tp/nullif(tp+fp,0)::DOUBLE,0) AS precision, coalesce(tp/nullif(tp+fn,0)::DOUBLE,0) AS recall,
 coalesce(2*tp/nullif(2*tp+fp+fn,0)::DOUBLE,0) AS f1, coalesce(fp/nullif(fp+tn,0)::DOUBLE,0) AS false_positive_rate"""
MET_OUT = f"{num('precision')}, {num('recall')}, {num('f1')}, {num('false_positive_rate')}"
SPREAD_SQL = ", ".join(
    f"avg({m}) AS mean_{m}, coalesce(stddev_pop({m}), 0) AS std_{m}" for m in ev.METRICS
)
SPREAD_OUT = ", ".join(f"{num(f'mean_{m}')}, {num(f'std_{m}')}" for m in ev.METRICS)
MEAN_OUT = ", ".join(num(f"mean_{m}") for m in ev.METRICS)


def metrics_sql(by: str, source: str = "rec", total: bool = True) -> str:
    t = ", count(*) AS total_flows" if total else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""SELECT *, {MET_SQL} FROM (SELECT {by + ',' if by else ''} {CONF_SQL}{t} FROM {source} {g})"""


# --- F: z-score -----------------------------------------------------------------------------------

ZP = ZScoreParams()
Z_SQL_KEY = f"""sha256(concat_ws('|', src_ip, '', coalesce(direction,''), dst_ip, CAST(dst_port AS VARCHAR), protocol,
 coalesce(scenario_name,''), label))"""
ZVALS = "[" + ", ".join(f"coalesce(CAST({f} AS DOUBLE), 0)" for f in ZSCORE_FEATURES) + "]"
NAMES = "[" + ", ".join(f"'{f}'" for f in ZSCORE_FEATURES) + "]"
SPLIT_SQL = f"""{features_sql()},
ks AS (SELECT *, {Z_SQL_KEY} AS row_key, {ZVALS} AS zv FROM ff),
bn AS (SELECT *, row_number() OVER (ORDER BY row_key) AS rk, count(*) OVER () AS nb FROM ks WHERE label='benign'),
sp AS (SELECT *, CASE WHEN rk <= least(greatest({{m}}, CAST(round_even(nb*0.75::DOUBLE, 0) AS BIGINT)), nb-1)
  THEN 'reference' ELSE 'calibration' END AS role FROM bn)"""
FIT_SQL = f"""{SPLIT_SQL.format(m=1)},
rl AS (SELECT unnest({NAMES}) AS feature_name, unnest(zv) AS v, unnest(range(1, {len(ZSCORE_FEATURES) + 1})) AS i
  FROM sp WHERE role='reference'),
fit AS (SELECT feature_name, i, avg(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std FROM rl GROUP BY feature_name, i),
fa AS (SELECT list(mean ORDER BY i) AS mu, list(std ORDER BY i) AS sd FROM fit)"""
ZSCORED_SQL = f"""{FIT_SQL},
zs AS (SELECT ks.*, list_transform(range(1, {len(ZSCORE_FEATURES) + 1}), lambda j: (zv[j]-mu[j])/sd[j]) AS z FROM ks, fa),
zr AS (SELECT *, sqrt(list_avg(list_transform(z, lambda x: x*x))) AS zscore FROM zs),
zc AS (SELECT zscore, row_number() OVER (ORDER BY zscore) AS r, count(*) OVER () AS nc FROM zr
  WHERE row_key IN (SELECT row_key FROM sp WHERE role='calibration')),
th AS (SELECT max(zscore) AS threshold FROM zc WHERE r = CAST(round_even((nc-1)*0.99::DOUBLE, 0) AS BIGINT)+1)"""

Q["f01_stable_row_key"] = lambda s, d: feature_table(s, d).select(
    *OPS_KEY, zs.stable_key([*OPS_KEY, "scenario_name", "label"]).alias("row_key")
)
S["f01_stable_row_key"] = f"WITH {features_sql()} SELECT {KEY}, {Z_SQL_KEY} AS row_key FROM ff"
Q["f02_split_reference"] = lambda s, d: zs.split_reference(feature_table(s, d)).select(
    *OPS_KEY, F.array_join("role", ";").alias("role")
)
S["f02_split_reference"] = f"WITH {SPLIT_SQL.format(m=1)} SELECT {KEY}, role FROM sp"


def _zfit(s, d):
    split = zs.split_reference(feature_table(s, d))
    return zs.fit_reference(zs.in_role(split, "reference"), ZP.features)


Q["f03_fit_zscore"] = lambda s, d: tidy(zs.reference_table(_zfit(s, d), ZP.features, ZP.min_std))
S["f03_fit_zscore"] = f"WITH {FIT_SQL} SELECT feature_name, {num('mean')}, {num('std')} FROM fit"
Q["f04_score_zscore"] = lambda s, d: tidy(
    zs.score_zscore(feature_table(s, d), _zfit(s, d)).select(*OPS_KEY, "score")
)
S["f04_score_zscore"] = f"WITH {ZSCORED_SQL} SELECT {KEY}, {num('zscore', 'score')} FROM zr"


def _f05(s, d):
    z = zs.score_zscore(feature_table(s, d), _zfit(s, d))
    return tidy(
        z.select(*OPS_KEY, F.posexplode("contributions").alias("position", "x")).select(
            *OPS_KEY, (F.col("position") + 1).cast("bigint").alias("position"), "x.rule_name", "x.score", "x.feature_value",
            "x.reference_mean", "x.reference_std", "x.z_score", "x.reason",
        )
    )


Q["f05_top_contributions"] = _f05
S["f05_top_contributions"] = f"""WITH {ZSCORED_SQL},
lg AS (SELECT {KEY}, unnest({NAMES}) AS rule_name, unnest(range(1, {len(ZSCORE_FEATURES) + 1})) AS i, unnest(z) AS z_score,
  unnest(zv) AS feature_value, unnest(mu) AS reference_mean, unnest(sd) AS reference_std FROM zr, fa),
rk AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY abs(z_score) DESC, i) AS position FROM lg)
SELECT {KEY}, position, rule_name, {num('abs(z_score)', 'score')}, {num('feature_value')}, {num('reference_mean')},
 {num('reference_std')}, {num('z_score')}, format('{{}} z-score {{:.3f}} from benign reference', rule_name, z_score) AS reason
FROM rk WHERE position <= 5"""

Q["f06_nearest_rank"] = lambda s, d: tidy(
    zs.nearest_rank(
        zs.score_zscore(zs.in_role(zs.split_reference(feature_table(s, d)), "calibration"), _zfit(s, d)), "score", 0.99
    )
)
S["f06_nearest_rank"] = f"WITH {ZSCORED_SQL} SELECT {num('threshold')} FROM th"
Q["f07_detect_zscore"] = lambda s, d: tidy(
    zs.detect_zscore(feature_table(s, d)).select(*OPS_KEY, "score", "threshold", "predicted_label")
)
S["f07_detect_zscore"] = f"""WITH {ZSCORED_SQL} SELECT {KEY}, {num('zscore', 'score')}, {num('threshold')},
 CASE WHEN zscore >= threshold THEN 'beacon' ELSE 'benign' END AS predicted_label FROM zr, th"""


def _f08(s, d):
    split = zs.split_reference(feature_table(s, d), 0.25, 2)
    fit = zs.fit_reference(zs.in_role(split, "reference"), ZP.features)
    f = zs.attach(feature_table(s, d), fit)
    return tidy(f.select(*OPS_KEY, *[z.alias(n) for z, n in zip(zs.z_columns(ZP.features, None), ZP.features)]))


Q["f08_standard_scaling"] = _f08
S["f08_standard_scaling"] = f"""WITH {SPLIT_SQL.format(m=2)},
rl AS (SELECT unnest(range(1, {len(ZSCORE_FEATURES) + 1})) AS i, unnest(zv) AS v FROM sp WHERE role='reference'),
fit AS (SELECT i, avg(v) AS mean, CASE WHEN stddev_pop(v)=0 THEN 1 ELSE stddev_pop(v) END AS std FROM rl GROUP BY i),
fa AS (SELECT list(mean ORDER BY i) AS mu, list(std ORDER BY i) AS sd FROM fit)
SELECT {KEY}, {', '.join(num(f'(zv[{i}]-mu[{i}])/sd[{i}]', f) for i, f in enumerate(ZSCORE_FEATURES, 1))} FROM ks, fa"""

# --- J: evaluation --------------------------------------------------------------------------------

Q["j01_classification_metrics"] = lambda s, d: tidy(ev.classification_metrics(records(s, d)))
S["j01_classification_metrics"] = f"WITH {REC_SQL} SELECT tp, fp, tn, fn, total_flows, {MET_OUT} FROM ({metrics_sql('')})"
Q["j02_metric_spread"] = lambda s, d: tidy(ev.metric_spread(ev.classification_metrics(records(s, d), ["seed"])))
S["j02_metric_spread"] = f"WITH {REC_SQL} SELECT {SPREAD_OUT} FROM (SELECT {SPREAD_SQL} FROM ({metrics_sql('seed')}))"
Q["j03_prediction_records"] = lambda s, d: tidy(records(s, d))
S["j03_prediction_records"] = f"""WITH {REC_SQL} SELECT {KEY}, case_name, seed, detector_name, scenario_name, true_label,
 predicted_label, {num('score')}, {num('threshold')}, event_count, triggered_rules FROM rec"""
Q["j04_evaluate_cases"] = lambda s, d: tidy(ev.classification_metrics(records(s, d), ["case_name", "seed"]))
S["j04_evaluate_cases"] = f"WITH {REC_SQL} SELECT case_name, seed, tp, fp, tn, fn, total_flows, {MET_OUT} FROM ({metrics_sql('case_name, seed')})"
Q["j05_per_case_metrics"] = lambda s, d: tidy(ev.classification_metrics(records(s, d), ["case_name"]))
S["j05_per_case_metrics"] = f"WITH {REC_SQL} SELECT case_name, tp, fp, tn, fn, total_flows, {MET_OUT} FROM ({metrics_sql('case_name')})"
RATES_SQL = """SELECT {by} coalesce(scenario_name,'unknown') AS scenario_name, count(*) AS total_flows,
 count(*) FILTER (true_label='beacon') AS true_beacon_flows, count(*) FILTER (predicted_label='beacon') AS predicted_beacon_flows
 FROM rec GROUP BY ALL"""
RATE = """predicted_beacon_flows/(CASE WHEN true_beacon_flows>0 THEN true_beacon_flows ELSE total_flows END)::DOUBLE"""
Q["j06_scenario_rates"] = lambda s, d: tidy(ev.scenario_rates(records(s, d)))
S["j06_scenario_rates"] = f"""WITH {REC_SQL} SELECT scenario_name, total_flows, true_beacon_flows, predicted_beacon_flows,
 {num(RATE, 'detection_rate')} FROM ({RATES_SQL.format(by='')})"""
Q["j07_profile_rates"] = lambda s, d: tidy(ev.profile_rates(records(s, d), ["detector_name", "case_name"]))
S["j07_profile_rates"] = f"""WITH {REC_SQL} SELECT detector_name, case_name, scenario_name AS scenario_or_profile_name,
 CASE WHEN true_beacon_flows>0 THEN 'beacon' ELSE 'benign_profile' END AS category,
 CASE WHEN true_beacon_flows>0 THEN 'detection_rate' ELSE 'false_flag_rate' END AS rate_type, {num(RATE, 'rate')},
 total_flows, true_beacon_flows, predicted_beacon_flows FROM ({RATES_SQL.format(by='detector_name, case_name,')})"""


def _j08(s, d):
    r = records(s, d)
    a = ev.failure_summary(r).select(*OPS_KEY, F.col("failure_type").alias("kind"), "top_contributors", "score")
    b = ev.near_threshold(r, 0.3).select(
        *OPS_KEY, F.lit("near_threshold").alias("kind"), F.col("triggered_rules").alias("top_contributors"), "score"
    )
    return tidy(a.unionByName(b))


Q["j08_failures_near_threshold"] = _j08
S["j08_failures_near_threshold"] = f"""WITH {REC_SQL}
SELECT {KEY}, CASE WHEN predicted_label='beacon' THEN 'false_positive' ELSE 'false_negative' END AS kind,
 triggered_rules AS top_contributors, {num('score')} FROM rec WHERE true_label <> predicted_label
UNION ALL SELECT {KEY}, 'near_threshold', triggered_rules, {num('score')} FROM rec WHERE abs(score-threshold) <= 0.3::DOUBLE"""
TIE = ["src_ip", "dst_ip", "dst_port", "protocol", "direction"]
Q["j09_top_false_positives_negatives"] = lambda s, d: tidy(
    ev.top_false_positives(records(s, d), 10, TIE).withColumn("kind", F.lit("fp")).unionByName(
        ev.top_false_negatives(records(s, d), 10, TIE).withColumn("kind", F.lit("fn"))
    ).select(*OPS_KEY, "kind", "score")
)
S["j09_top_false_positives_negatives"] = f"""WITH {REC_SQL}
(SELECT {KEY}, 'fp' AS kind, {num('score')} FROM (SELECT * FROM rec WHERE true_label='benign' AND predicted_label='beacon'
 ORDER BY score DESC, {', '.join(TIE)} LIMIT 10)) UNION ALL
(SELECT {KEY}, 'fn' AS kind, {num('score')} FROM (SELECT * FROM rec WHERE true_label='beacon' AND predicted_label='benign'
 ORDER BY score, {', '.join(TIE)} LIMIT 10))"""
Q["j10_score_distribution"] = lambda s, d: tidy(ev.score_distribution(records(s, d), 0.5))
S["j10_score_distribution"] = f"""WITH {REC_SQL} SELECT {num('b', 'bucket')}, count(*) AS count FROM
 (SELECT round(floor(score/0.5::DOUBLE)*0.5::DOUBLE, 3) AS b FROM rec) GROUP BY b"""
Q["j11_multi_seed_rules"] = lambda s, d: tidy(ev.multi_seed(records(s, d)))
MULTI_SQL = f"""SELECT * FROM (SELECT {{by}}, {SPREAD_SQL} FROM ({{m}}) GROUP BY {{by}}) JOIN
 (SELECT {{by}}, tp, fp, tn, fn, precision AS combined_precision, recall AS combined_recall, f1 AS combined_f1,
  false_positive_rate AS combined_false_positive_rate FROM ({{c}})) USING ({{by}})"""
COMB_OUT = ", ".join(num(f"combined_{m}") for m in ev.METRICS)


def multi_sql(by: str, source: str = "rec") -> str:
    return MULTI_SQL.format(by=by, m=metrics_sql(f"{by}, seed", source), c=metrics_sql(by, source))


S["j11_multi_seed_rules"] = f"WITH {REC_SQL} SELECT detector_name, {SPREAD_OUT}, tp, fp, tn, fn, {COMB_OUT} FROM ({multi_sql('detector_name')})"
Q["j11_seed_metrics"] = lambda s, d: tidy(ev.seed_metrics(records(s, d)))
S["j11_seed_metrics"] = f"""WITH {REC_SQL} SELECT detector_name, seed, tp, fp, tn, fn, total_flows, {MET_OUT} FROM
 (SELECT *, {MET_SQL} FROM (SELECT detector_name, seed, {CONF_SQL}, count(*) AS total_flows FROM rec
  GROUP BY GROUPING SETS ((detector_name, seed), (detector_name))))"""


def _zseed(s, d):
    return zs.detect_zscore(cases(feature_table(s, d)), ZP, by=["seed"])


Q["j11_multi_seed_zscore"] = lambda s, d: tidy(
    ev.multi_seed(ev.prediction_records(_zseed(s, d), KEEP)).join(
        ev.combined_threshold(ev.prediction_records(_zseed(s, d), KEEP)), "detector_name"
    )
)
ZSEED_SQL = f"""{features_sql()},
ks AS (SELECT *, {CASES_SQL}, {Z_SQL_KEY} AS row_key, {ZVALS} AS zv FROM ff),
sp AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY row_key) <= least(greatest(1,
  CAST(round_even(count(*) OVER (PARTITION BY seed)*0.75::DOUBLE, 0) AS BIGINT)), count(*) OVER (PARTITION BY seed)-1) AS isref
  FROM ks WHERE label='benign'),
rl AS (SELECT seed, unnest(zv) AS v, unnest(range(1, {len(ZSCORE_FEATURES) + 1})) AS i FROM sp WHERE isref),
fit AS (SELECT seed, i, avg(v) AS mean, greatest(stddev_pop(v), 1e-6) AS std FROM rl GROUP BY seed, i),
fa AS (SELECT seed, list(mean ORDER BY i) AS mu, list(std ORDER BY i) AS sd FROM fit GROUP BY seed),
zr AS (SELECT ks.*, sqrt(list_avg(list_transform(range(1, {len(ZSCORE_FEATURES) + 1}), lambda j: ((zv[j]-mu[j])/sd[j])**2))) AS score
  FROM ks JOIN fa USING (seed)),
zc AS (SELECT seed, score, row_number() OVER (PARTITION BY seed ORDER BY score) AS r, count(*) OVER (PARTITION BY seed) AS nc
  FROM zr WHERE row_key IN (SELECT row_key FROM sp WHERE NOT isref)),
th AS (SELECT seed, max(score) AS threshold FROM zc WHERE r = CAST(round_even((nc-1)*0.99::DOUBLE, 0) AS BIGINT)+1 GROUP BY seed),
rec AS (SELECT zr.*, label AS true_label, threshold, 'statistical_zscore_baseline_v1' AS detector_name,
  CASE WHEN score >= threshold THEN 'beacon' ELSE 'benign' END AS predicted_label FROM zr JOIN th USING (seed))"""
S["j11_multi_seed_zscore"] = f"""WITH {ZSEED_SQL} SELECT detector_name, {SPREAD_OUT}, tp, fp, tn, fn, {COMB_OUT},
 (SELECT {num('avg(threshold)', 'combined_threshold').rsplit(' AS ', 1)[0]} FROM th) AS combined_threshold FROM ({multi_sql('detector_name')})"""

SWEEP = [0.7, 1.1, 2.2, 2.8, 3.5]
Q["j12_threshold_sweep"] = lambda s, d: tidy(ev.threshold_sweep(records(s, d).drop("threshold"), SWEEP))
SWEEP_SQL = ", ".join(f"({t}::DOUBLE)" for t in SWEEP)
SW_SQL = f"""{REC_SQL}, sw AS (SELECT rec.* EXCLUDE (threshold, predicted_label), t.threshold,
 CASE WHEN score >= t.threshold THEN 'beacon' ELSE 'benign' END AS predicted_label FROM rec, (VALUES {SWEEP_SQL}) t(threshold))"""
S["j12_threshold_sweep"] = f"WITH {SW_SQL} SELECT threshold, tp, fp, tn, fn, {MET_OUT} FROM ({metrics_sql('threshold', 'sw')})"
Q["j12_threshold_sweep_multi_seed"] = lambda s, d: tidy(ev.sweep_summary(records(s, d).drop("threshold"), SWEEP))
S["j12_threshold_sweep_multi_seed"] = f"""WITH {SW_SQL} SELECT threshold, {SPREAD_OUT} FROM
 (SELECT threshold, {SPREAD_SQL} FROM ({metrics_sql('threshold, seed', 'sw')}) GROUP BY threshold)"""
Q["j15_holdout_split"] = lambda s, d: ev.training_counts(ev.holdout_split(feature_table(s, d), ["profile_1", "profile_3"]))
S["j15_holdout_split"] = f"""WITH {features_sql()} SELECT count(*) AS training_flow_count,
 count(*) FILTER (label='beacon') AS training_beacon_flow_count, count(*) FILTER (label='benign') AS training_benign_flow_count
 FROM ff WHERE scenario_name NOT IN ('profile_1','profile_3')"""


def _ladder(s, d):
    e = ev.evidence_ladder(events(s, d), OPS_KEY)
    f = flow_features(e, PARAMS, key=["evidence", *OPS_KEY], hot_threshold=None)  # 24 events at most
    return rl.detect_rules(f, T)


def ladder_records(s, d):
    def make(s, d):
        x = _ladder(s, d)
        return x.select(
            *OPS_KEY,
            "detector_name",
            F.lit("threshold=2.2").alias("operating_point"),
            F.col("scenario_name").alias("scenario_family"),
            F.col("evidence").cast("bigint").alias("event_count"),
            F.col("label").alias("true_label"),
            "predicted_label",
            "score",
        )

    return stored(s, d, "ladder", make)


LADDER_FE = f"""SELECT k.evidence, e.* FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY {KEY}) AS nn
 FROM ({{fe}}) WINDOW w AS (PARTITION BY {KEY} ORDER BY t_us, size_bytes, src_port)) e,
 (VALUES (3),(5),(7),(9),(12),(15),(18),(24)) k(evidence) WHERE rn <= k.evidence AND nn >= k.evidence"""
from tidewatch.plans.views import FLOW_EVENTS_SQL  # noqa: E402

LADDER_SQL = f"""{features_sql('evidence, ' + KEY, source=LADDER_FE.format(fe=FLOW_EVENTS_SQL))},
ru AS (SELECT *, round({SCORE_SQL}, 9) AS score, {TRIGGERED_SQL} AS triggered_rules FROM ff),
lr AS (SELECT {KEY}, 'rule_baseline_v2_hardened_final' AS detector_name, 'threshold=2.2' AS operating_point,
 scenario_name AS scenario_family, CAST(evidence AS BIGINT) AS event_count, label AS true_label,
 CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label, score FROM ru)"""
EVS_SQL = f"""{LADDER_SQL}, es AS (SELECT detector_name, operating_point, scenario_family, event_count,
 count(*) FILTER (true_label='beacon') AS beacon_flow_count, avg(score) FILTER (true_label='beacon') AS mean_score,
 quantile_cont(score, 0.5) FILTER (true_label='beacon') AS median_score,
 min(score) FILTER (true_label='beacon') AS min_score, max(score) FILTER (true_label='beacon') AS max_score,
 coalesce(count(*) FILTER (true_label='beacon' AND predicted_label='beacon')/nullif(count(*) FILTER (true_label='beacon'),0)::DOUBLE, 0)
  AS detection_rate,
 count(*) FILTER (true_label='beacon' AND predicted_label<>'beacon') AS false_negative_count,
 coalesce(count(*) FILTER (true_label='benign' AND predicted_label='beacon')/nullif(count(*) FILTER (true_label='benign'),0)::DOUBLE, 0)
  AS benign_false_positive_rate,
 count(*) FILTER (true_label='benign' AND predicted_label='beacon') AS benign_false_positive_count
 FROM lr GROUP BY ALL)"""
STATS_OUT = ", ".join(
    num(x) for x in ("mean_score", "median_score", "min_score", "max_score", "detection_rate", "benign_false_positive_rate")
)
Q["j17_evidence_summary"] = lambda s, d: tidy(ev.evidence_summary(ladder_records(s, d)))
S["j17_evidence_summary"] = f"""WITH {EVS_SQL} SELECT detector_name, operating_point, scenario_family, event_count, beacon_flow_count,
 {STATS_OUT}, false_negative_count, benign_false_positive_count FROM es"""
Q["j17_detection_curve"] = lambda s, d: tidy(ev.detection_curve(ev.evidence_summary(ladder_records(s, d))))
S["j17_detection_curve"] = f"""WITH {EVS_SQL} SELECT detector_name, operating_point, scenario_family, event_count,
 {num('detection_rate')}, {num('benign_false_positive_rate')} FROM es"""
TARGETS = [0.05, 0.8, 0.9]
Q["j18_reliability_threshold"] = lambda s, d: ev.reliability_threshold(ev.evidence_summary(ladder_records(s, d)), TARGETS)
S["j18_reliability_threshold"] = f"""WITH {EVS_SQL}, su AS (SELECT *, min(detection_rate) OVER (PARTITION BY detector_name, operating_point,
 scenario_family ORDER BY event_count ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fl FROM es)
SELECT detector_name, operating_point, scenario_family, t.x AS reliability_target,
 min(event_count) FILTER (fl >= t.x) AS first_reliable_event_count
FROM su, (VALUES (0.05::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) t(x) GROUP BY ALL"""
Q["j19_evidence_ladder"] = lambda s, d: tidy(
    _ladder(s, d).select("evidence", *OPS_KEY, "event_count", "score", "inter_arrival_cv", "predicted_label")
)
S["j19_evidence_ladder"] = f"""WITH {LADDER_SQL} SELECT evidence, {KEY}, event_count, {num('score')}, {num('inter_arrival_cv')},
 CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label FROM ru"""


def factor_records(s, d):
    return records(s, d).withColumns(
        {
            "feature_set": F.lit("full"),
            "factor_name": F.lit("event_count"),
            "factor_value": F.floor(F.col("event_count") / 4).cast("bigint"),
        }
    )


Q["j20_factor_summary"] = lambda s, d: tidy(ev.factor_summary(factor_records(s, d), "profile_2"))
S["j20_factor_summary"] = f"""WITH {REC_SQL}, fr AS (SELECT *, 'full' AS feature_set, 'event_count' AS factor_name,
 CAST(event_count//4 AS BIGINT) AS factor_value FROM rec), es AS (SELECT detector_name, feature_set, threshold, factor_name, factor_value,
 count(*) FILTER (scenario_name='profile_2') AS target_flow_count, avg(score) FILTER (scenario_name='profile_2') AS mean_score,
 quantile_cont(score, 0.5) FILTER (scenario_name='profile_2') AS median_score,
 min(score) FILTER (scenario_name='profile_2') AS min_score, max(score) FILTER (scenario_name='profile_2') AS max_score,
 coalesce(count(*) FILTER (scenario_name='profile_2' AND predicted_label='beacon')/nullif(count(*) FILTER (scenario_name='profile_2'),0)::DOUBLE, 0) AS detection_rate,
 count(*) FILTER (scenario_name='profile_2' AND predicted_label<>'beacon') AS false_negative_count,
 coalesce(count(*) FILTER (true_label='benign' AND predicted_label='beacon')/nullif(count(*) FILTER (true_label='benign'),0)::DOUBLE, 0) AS benign_false_positive_rate,
 count(*) FILTER (true_label='benign' AND predicted_label='beacon') AS benign_false_positive_count FROM fr GROUP BY ALL)
SELECT detector_name, feature_set, {num('threshold')}, factor_name, factor_value, target_flow_count, {STATS_OUT},
 false_negative_count, benign_false_positive_count FROM es"""


def diagnostic_records(s, d):
    scope = F.when(F.col("seed") == 0, "standard_hardened_grid").when(F.col("seed") == 1, "shortcut_stress").otherwise("supervised_holdout")
    f = rl.detect_rules(cases(feature_table(s, d)), T).withColumns(
        {"true_label": F.col("label"), "feature_set": F.lit("full"), "evaluation_scope": scope}
    )
    f = f.filter(F.col("scenario_name") == "profile_2")
    return f.withColumn("group_name", ev.diagnostic_group(F.col("evaluation_scope"), "profile_2"))


DIAG_SQL = f"""{RULED_SQL}, dg AS (SELECT *, {CASES_SQL}, 'rule_baseline_v2_hardened_final' AS detector_name, 'full' AS feature_set,
 2.2::DOUBLE AS threshold, label AS true_label, CASE WHEN score >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label
 FROM ru WHERE scenario_name='profile_2'),
dr AS (SELECT *, CASE seed WHEN 0 THEN 'standard_hardened_grid' WHEN 1 THEN 'shortcut_stress' ELSE 'supervised_holdout' END AS evaluation_scope,
 concat(CASE WHEN predicted_label='beacon' THEN 'detected' ELSE 'missed' END,
 CASE seed WHEN 0 THEN '_standard' WHEN 1 THEN '_shortcut' ELSE '_holdout' END, '_profile_2') AS group_name FROM dg)"""
DKEY = "detector_name, feature_set, threshold, evaluation_scope, group_name"
DKEY_OUT = f"detector_name, feature_set, {num('threshold')}, evaluation_scope, group_name"
VAL_OUT = f"{num('mean')}, {num('median')}, {num('min')}, {num('max')}"
Q["j21_diagnostic_groups"] = lambda s, d: tidy(ev.diagnostic_groups(diagnostic_records(s, d)))
S["j21_diagnostic_groups"] = f"""WITH {DIAG_SQL} SELECT {DKEY_OUT}, count, {VAL_OUT} FROM (SELECT {DKEY}, count(score) AS count,
 avg(score) AS mean, quantile_cont(score, 0.5) AS median, min(score) AS min, max(score) AS max FROM dr GROUP BY ALL)"""
PF = ", ".join(f"CAST({f} AS DOUBLE)" for f in ev.PROFILE_FEATURES)
PN = ", ".join(f"'{f}'" for f in ev.PROFILE_FEATURES)
Q["j21_diagnostic_features"] = lambda s, d: tidy(ev.diagnostic_features(diagnostic_records(s, d)))
S["j21_diagnostic_features"] = f"""WITH {DIAG_SQL}, lg AS (SELECT {DKEY}, unnest([{PN}]) AS feature_name, unnest([{PF}]) AS v FROM dr)
SELECT {DKEY_OUT}, feature_name, count, {VAL_OUT} FROM (SELECT {DKEY}, feature_name, count(v) AS count, avg(v) AS mean,
 quantile_cont(v, 0.5) AS median, min(v) AS min, max(v) AS max FROM lg GROUP BY ALL)"""
Q["j22_lowest_scored_misses"] = lambda s, d: tidy(
    ev.lowest_misses(diagnostic_records(s, d), 100, TIE).select(
        *OPS_KEY, "score", *[F.col(f).cast("double").alias(f) for f in ev.PROFILE_FEATURES]
    )
)
S["j22_lowest_scored_misses"] = f"""WITH {DIAG_SQL}, x AS (SELECT * FROM dr WHERE true_label='beacon' AND predicted_label='benign'
 ORDER BY score, {', '.join(TIE)} LIMIT 100) SELECT {KEY}, {num('score')}, {', '.join(num(f) for f in ev.PROFILE_FEATURES)} FROM x"""
Q["j25_training_and_reference"] = lambda s, d: cases(feature_table(s, d)).transform(
    lambda f: ev.training_table(f, F.col("seed") < 3).select(*OPS_KEY, "seed", "case_name", "label", F.lit("training").alias("role")).unionByName(
        ev.reference_rows(f.filter(F.col("seed") >= 3)).select(*OPS_KEY, "seed", "case_name", "label", F.lit("reference").alias("role"))
    )
)
S["j25_training_and_reference"] = f"""WITH {features_sql()}, cs AS (SELECT *, {CASES_SQL} FROM ff)
SELECT {KEY}, seed, case_name, label, 'training' AS role FROM cs WHERE seed < 3
UNION ALL SELECT {KEY}, seed, case_name, label, 'reference' FROM cs WHERE seed >= 3 AND label='benign'"""


def all_records(s, d):
    """Records of two detectors in two scopes."""
    z = ev.prediction_records(zs.detect_zscore(cases(feature_table(s, d)), ZP, by=["seed"]), KEEP)
    r = records(s, d)
    both = r.withColumn("operating_point", F.lit("threshold=2.2")).unionByName(
        z.withColumn("operating_point", F.lit("benign_score_quantile=0.99"))
    )
    return both.withColumn(
        "evaluation_scope", F.when(F.col("dst_port") == 443, "standard").otherwise("stress")
    )


Q["j24_detector_comparison"] = lambda s, d: tidy(ev.compare_detectors(all_records(s, d)))
RULE_REC = f"""r0 AS (SELECT *, {CASES_SQL}, 'rule_baseline_v2_hardened_final' AS detector_name, 'threshold=2.2' AS operating_point,
 label AS true_label, CASE WHEN s0 >= 2.2::DOUBLE THEN 'beacon' ELSE 'benign' END AS predicted_label
 FROM (SELECT *, round({SCORE_SQL}, 9) AS s0 FROM ff))"""
ALL_SQL = f"""{ZSEED_SQL}, {RULE_REC}, allr AS (
 SELECT detector_name, 'benign_score_quantile=0.99' AS operating_point, seed, case_name, scenario_name, true_label, predicted_label, dst_port FROM rec
 UNION ALL SELECT detector_name, operating_point, seed, case_name, scenario_name, true_label, predicted_label, dst_port FROM r0),
al AS (SELECT *, CASE WHEN dst_port=443 THEN 'standard' ELSE 'stress' END AS evaluation_scope FROM allr)"""
CK = "evaluation_scope, detector_name, operating_point"
S["j24_detector_comparison"] = f"""WITH {ALL_SQL} SELECT {CK}, {MEAN_OUT}, tp AS combined_tp, fp AS combined_fp, tn AS combined_tn,
 fn AS combined_fn FROM ({multi_sql(CK, 'al')})"""
Q["j26_study_summary"] = lambda s, d: tidy(ev.study_tables(all_records(s, d), CK.split(", "))["summary"])
S["j26_study_summary"] = f"WITH {ALL_SQL} SELECT {CK}, {SPREAD_OUT}, tp, fp, tn, fn, {COMB_OUT} FROM ({multi_sql(CK, 'al')})"
Q["j26_study_per_case"] = lambda s, d: tidy(ev.study_tables(all_records(s, d), CK.split(", "))["per_case"])
S["j26_study_per_case"] = f"WITH {ALL_SQL} SELECT {CK}, case_name, tp, fp, tn, fn, total_flows, {MET_OUT} FROM ({metrics_sql(CK + ', case_name', 'al')})"
Q["j26_study_per_profile"] = lambda s, d: tidy(ev.study_tables(all_records(s, d), CK.split(", "))["per_profile"])
S["j26_study_per_profile"] = f"""WITH {ALL_SQL}, pr AS (SELECT {CK}, scenario_name, count(*) AS total_flows,
 count(*) FILTER (true_label='beacon') AS true_beacon_flows, count(*) FILTER (predicted_label='beacon') AS predicted_beacon_flows
 FROM al GROUP BY ALL) SELECT {CK}, scenario_name AS scenario_or_profile_name,
 CASE WHEN true_beacon_flows>0 THEN 'beacon' ELSE 'benign_profile' END AS category,
 CASE WHEN true_beacon_flows>0 THEN 'detection_rate' ELSE 'false_flag_rate' END AS rate_type, {num(RATE, 'rate')},
 total_flows, true_beacon_flows, predicted_beacon_flows FROM pr"""
