"""Supervised detectors on Spark ML: fit, score, validate, thresholds, calibration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.operators.evaluate import with_metrics
from tidewatch.operators.flows import flow_key_text
from tidewatch.operators.forest import Forest, beacon_score, fit_forest
from tidewatch.operators.ranks import SLICE, POS, ensure_checkpoint_dir, hash_rank, running_sums, sorted_slices
from tidewatch.operators.zscore import fit_reference
from tidewatch.schema import DEFAULT_RF_THRESHOLD, LR_DETECTOR, RF_DETECTOR, ModelParams

c = F.col
NAMES = {"random_forest": RF_DETECTOR, "logistic_regression": LR_DETECTOR}
WEIGHT_NAMES = {
    "random_forest": "global random forest feature importance",
    "logistic_regression": "global logistic regression coefficient",
}


# Below this many rows a fit takes longer to start than to run. Rows of a larger table are dealt out in
# parts of PART_ROWS at most. Forests over more than FOREST_ROWS are grown by operators/forest.py.
FEW_ROWS = 20_000
PART_ROWS = 500_000
FOREST_ROWS = 20_000
FITS = 3


def evenly(rows: DataFrame) -> DataFrame:
    """The rows, written down in parts of like size: every pass of a fit lasts as long as its largest
    part, and a file with few row groups is read in as few parts."""
    ensure_checkpoint_dir(rows.sparkSession)
    d = rows.checkpoint()
    parts = d.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n"))
    size = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.max("n").alias("most")).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if size["all"] <= FEW_ROWS or size["most"] <= 2 * -(-size["all"] // cores):
        return d
    return d.repartition(max(cores, -(-size["all"] // PART_ROWS))).checkpoint()


def in_few_parts(rows: DataFrame, total: int) -> DataFrame:
    """Rows of a larger fit in no more parts than cores and PART_ROWS ask for: in every pass each part
    sends the statistics of all open nodes, however few rows it has."""
    if total <= FEW_ROWS:
        return rows
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // PART_ROWS)))


def side_by_side(spark, call: Callable, items: Sequence) -> list:
    """call(item) of every item, in order, FITS of them at a time: most passes of a fit are too short to
    keep the cores busy."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(inheritable_thread_target(spark)(call), items))


@dataclass(frozen=True)
class Detector:
    """A fitted classifier; `threshold` may be replaced without a refit."""

    kind: str
    params: ModelParams
    model: PipelineModel | Forest

    @property
    def name(self) -> str:
        return NAMES[self.kind]

    @property
    def operating_point(self) -> str:
        return f"threshold={self.params.threshold:g};features={len(self.params.features)}"

    def with_threshold(self, threshold: float) -> Detector:
        return replace(self, params=replace(self.params, threshold=threshold))


def assemble(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """`features` vector as an array column: missing is 0."""
    return rows.withColumn("features", F.array(*[F.coalesce(c(f).cast("double"), F.lit(0.0)) for f in features]))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, count, weight = n / (2 n_class): two rows."""
    d = rows.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return d.withColumn("weight", F.sum("count").over(W.partitionBy()) / (2.0 * c("count")))


def _vector_stages(features: Sequence[str], scale: tuple | None) -> list:
    cells = []
    for i, f in enumerate(features):
        value = f"coalesce(cast(`{f}` as double), 0D)"
        if scale:
            mean, std = scale[0][i], scale[1][i] or 1.0
            value = f"({value} - ({mean!r}D)) / {std!r}D"
        cells.append(f"{value} AS `_x{i}`")
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__")
    names = [f"_x{i}" for i in range(len(features))]
    return [fill, VectorAssembler(inputCols=names, outputCol="_features")]


def fit(rows: DataFrame, kind: str = "random_forest", p: ModelParams = ModelParams()) -> Detector:
    """Balanced classes. Needs two rows and both labels."""
    counts = {r["label"]: (r["count"], r["weight"]) for r in class_weights(rows).collect()}  # two rows
    total = sum(n for n, _ in counts.values())
    if total < 2 or set(counts) != {"benign", "beacon"}:
        raise ValueError("Training needs at least two rows and both labels, benign and beacon.")
    d = rows.withColumns(
        {
            "_y": (c("label") == "beacon").cast("double"),
            "_w": F.when(c("label") == "beacon", counts["beacon"][1]).otherwise(counts["benign"][1]),
        }
    )
    keep = list(dict.fromkeys([*p.features, "_y", "_w"]))
    few = in_few_parts(d.select(*keep), total)
    if kind == "random_forest" and total > FOREST_ROWS:
        weights = (counts["benign"][1], counts["beacon"][1])
        return Detector(kind, p, fit_forest(few, p.features, "_y", total, weights, p.trees, p.max_depth, p.min_leaf, p.seed))
    if kind == "random_forest":
        scale = None  # trees split on order, so scaling changes nothing
        estimator = RandomForestClassifier(
            labelCol="_y",
            weightCol="_w",
            featuresCol="_features",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_prediction",
            numTrees=p.trees,
            maxDepth=p.max_depth,
            minInstancesPerNode=p.min_leaf,
            featureSubsetStrategy="sqrt",
            maxBins=128,
            seed=p.seed,
        )
    elif kind == "logistic_regression":
        s = fit_reference(rows, p.features).first()  # two short arrays
        scale = (s["mean"], s["std"])
        estimator = LogisticRegression(
            labelCol="_y",
            weightCol="_w",
            featuresCol="_features",
            probabilityCol="_probability",
            rawPredictionCol="_raw",
            predictionCol="_prediction",
            regParam=1.0 / total,
            elasticNetParam=0.0,
            standardization=False,
            maxIter=p.max_iter,
        )
    else:
        raise ValueError(f"Unsupported supervised detector: {kind}")
    model = Pipeline(stages=[*_vector_stages(p.features, scale), estimator]).fit(few)
    return Detector(kind, p, model)


FORMATS = {Forest: "forest_table", PipelineModel: "spark_ml"}


def save_model(d: Detector, spark, path: str) -> str:
    """Writes the model, and returns the name of its format."""
    if isinstance(d.model, Forest):
        d.model.table(spark).write.mode("overwrite").parquet(path)
    else:
        d.model.write().overwrite().save(path)
    return FORMATS[type(d.model)]


def load_model(spark, path: str, format_: str = "spark_ml") -> PipelineModel | Forest:
    return Forest.from_table(spark.read.parquet(path)) if format_ == "forest_table" else PipelineModel.load(path)


def feature_weights(d: Detector) -> list[tuple[str, float]]:
    """(feature, importance or coefficient): as long as the feature list."""
    if isinstance(d.model, Forest):
        return [(f, float(v)) for f, v in zip(d.params.features, d.model.importances)]
    m = d.model.stages[-1]
    values = m.featureImportances.toArray() if d.kind == "random_forest" else m.coefficients.toArray()
    return [(f, float(v)) for f, v in zip(d.params.features, values)]


def top_features(d: Detector, k: int | None = None) -> list[tuple[str, float]]:
    """The k features with the largest weight; ties keep feature order."""
    return sorted(feature_weights(d), key=lambda x: -abs(x[1]))[: k or d.params.top_k]


def contributions(d: Detector) -> Column:
    parts = [
        F.struct(
            F.lit(f).alias("rule_name"),
            F.lit(True).alias("fired"),
            F.lit(abs(w)).alias("score"),
            F.lit(f"{f} {WEIGHT_NAMES[d.kind]} {w:.4f}").alias("reason"),
            F.coalesce(c(f).cast("double"), F.lit(0.0)).alias("feature_value"),
        )
        for f, w in top_features(d)
    ]
    return F.array(*parts)


def score(rows: DataFrame, d: Detector, threshold: Column | None = None) -> DataFrame:
    """Adds detector_name, score = P(beacon), threshold, predicted_label, contributions."""
    t = F.lit(float(d.params.threshold)) if threshold is None else threshold
    if isinstance(d.model, Forest):
        out = rows.withColumn("score", beacon_score(d.model))
    else:
        out = d.model.transform(rows).withColumn("score", vector_to_array("_probability")[1])
    out = out.select(*rows.columns, "score")
    return out.withColumns(
        {
            "detector_name": F.lit(d.name),
            "threshold": t,
            "predicted_label": F.when(c("score") >= t, "beacon").otherwise("benign"),
            "contributions": contributions(d),
        }
    )


def as_rf_columns(rows: DataFrame, d: Detector) -> DataFrame:
    """Model columns for hybrid scoring, on the same rows."""
    s = score(rows, d)
    names = F.lit(" | ".join(f for f, _ in top_features(d)))
    return s.withColumnsRenamed(
        {"score": "rf_score", "threshold": "rf_threshold", "predicted_label": "rf_predicted_label"}
    ).drop("detector_name", "contributions").withColumn("top_model_features", names)


# --- validation -------------------------------------------------------------------------------------


def fold_count(rows: DataFrame, requested: int) -> tuple[int, str | None]:
    """(folds, reason for none): the least of the request, beacons, benigns and groups."""
    if requested < 2:
        return 0, "requested_folds must be at least 2"
    n = rows.agg(
        F.count_if(c("label") == "beacon").alias("b"),
        F.count_if(c("label") == "benign").alias("g"),
        F.countDistinct(flow_key_text()).alias("k"),
    ).first()
    k = min(requested, n["b"], n["g"], n["k"])
    if k < 2:
        return 0, "Need at least two benign and two beacon grouped flows for grouped validation."
    return k, None


def kfold(rows: DataFrame, k: int) -> DataFrame:
    """Adds `fold` from 1: the distinct flow keys of each label dealt out in hash order, so that all
    rows of a key are in one fold. A key with both labels goes with `beacon`, the smaller text."""
    d = rows.withColumn("_h", F.sha2(flow_key_text(), 256))
    keys = d.groupBy("_h").agg(F.min("label").alias("label"))
    dealt = hash_rank(keys, "_h", "_rank", "_n", ["label"])
    dealt = dealt.select("_h", ((c("_rank") - 1) % k + 1).cast("int").alias("fold"))
    return d.join(dealt, "_h").drop("_h")


def out_of_fold(folded: DataFrame, k: int, kind: str = "random_forest", p: ModelParams = ModelParams()) -> DataFrame:
    """Every row once, scored by the model that did not see its fold."""
    out, folds = None, range(1, k + 1)
    fits = side_by_side(folded.sparkSession, lambda i: fit(folded.filter(c("fold") != i), kind, p), folds)
    for i, fitted in zip(folds, fits):
        d = score(folded.filter(c("fold") == i), fitted)
        d = d.select("fold", c("label").alias("true_label"), "score", "predicted_label")
        out = d if out is None else out.unionByName(d)
    return out


# --- thresholds -------------------------------------------------------------------------------------


def clipped(score_: Column) -> Column:
    return F.least(F.greatest(score_, F.lit(0.0)), F.lit(1.0))


def _score_steps(oof: DataFrame) -> DataFrame:
    """Distinct clipped scores, highest first, with tp and fp at score >= s and the next lower score."""
    y = c("true_label") == "beacon"
    d = oof.groupBy(clipped(c("score")).alias("s")).agg(F.count_if(y).alias("_b"), F.count_if(~y).alias("_g"))
    d = sorted_slices(d, [F.desc("s")])
    run = running_sums(d, {"tp": "_b", "fp": "_g"})
    inside = F.lead("s").over(W.partitionBy(SLICE).orderBy(POS))
    heads = d.groupBy(SLICE).agg(F.max("s").alias("_head"))  # one row per slice
    heads = heads.select(SLICE, F.lead("_head").over(W.orderBy(SLICE)).alias("_next"))
    run = run.withColumn("lower", inside).join(F.broadcast(heads), SLICE)
    return run.select("s", "tp", "fp", F.coalesce("lower", "_next").alias("lower"))


def candidate_thresholds(oof: DataFrame) -> DataFrame:
    """0, 1, every distinct score and the midpoints between neighbours."""
    return evaluate_thresholds(oof).select("threshold")


def evaluate_thresholds(oof: DataFrame) -> DataFrame:
    """Confusion counts and metrics at every candidate, from one sorted pass."""
    steps = _score_steps(oof)
    totals = oof.agg(
        F.count_if(c("true_label") == "beacon").alias("_pos"),
        F.count_if(c("true_label") != "beacon").alias("_neg"),
        F.coalesce(F.min(clipped(c("score"))), F.lit(2.0)).alias("_low"),
        F.coalesce(F.max(clipped(c("score"))), F.lit(-1.0)).alias("_high"),
    )
    mid = (c("s") + c("lower")) / 2.0
    ends = totals.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        c("_low") > 0,
                        F.struct(F.lit(0.0).alias("threshold"), c("_pos").alias("tp"), c("_neg").alias("fp")),
                    ),
                    F.when(
                        c("_high") < 1,
                        F.struct(
                            F.lit(1.0).alias("threshold"),
                            F.lit(0).cast("bigint").alias("tp"),
                            F.lit(0).cast("bigint").alias("fp"),
                        ),
                    ),
                )
            )
        ).alias("e")
    ).select("e.*")
    d = steps.select(c("s").alias("threshold"), "tp", "fp").unionByName(
        steps.filter((c("lower") < mid) & (mid < c("s"))).select(mid.alias("threshold"), "tp", "fp")
    )
    d = d.unionByName(ends).crossJoin(F.broadcast(totals.select("_pos", "_neg")))  # one row
    d = d.select("threshold", "tp", "fp", (c("_neg") - c("fp")).alias("tn"), (c("_pos") - c("tp")).alias("fn"))
    return with_metrics(d)


PROFILES = {
    "conservative": "min_false_positive_rate_then_precision",
    "balanced": "max_f1",
    "sensitive": "max_recall_then_f1",
}


def threshold_profiles(evaluations: DataFrame) -> DataFrame:
    """Three rows: profile, optimized_metric, threshold, metrics. Full ties take the lowest
    threshold."""
    p, r, f1, fpr, t = (c(x) for x in ("precision", "recall", "f1", "false_positive_rate", "threshold"))
    keys = {
        "conservative": F.struct(-fpr, p, f1, r, t),
        "balanced": F.struct(f1, r, p, -F.abs(fpr - 0.1), -t),
        "sensitive": F.struct(r, f1, p, -fpr, -t),
    }
    row = F.struct("threshold", "tp", "fp", "tn", "fn", "precision", "recall", "f1", "false_positive_rate")
    best = evaluations.agg(*[F.max_by(row, k).alias(n) for n, k in keys.items()])
    cells = F.array(
        *[F.struct(F.lit(n).alias("profile"), F.lit(PROFILES[n]).alias("optimized_metric"), c(n).alias("r")) for n in keys]
    )
    return best.select(F.explode(cells).alias("x")).select("x.profile", "x.optimized_metric", "x.r.*").withColumn(
        "selection_method", F.lit("out_of_fold_grouped_validation")
    )


def default_profiles() -> dict[str, dict]:
    """What is used when there are no out-of-fold predictions."""
    why = "fallback_default_no_grouped_validation_predictions"
    return {n: {"threshold": DEFAULT_RF_THRESHOLD, "optimized_metric": why} for n in PROFILES}


def with_profile(d: Detector, profiles: dict[str, dict], profile: str) -> Detector:
    """The same model at the profile's threshold."""
    found = profiles.get(profile)
    return d.with_threshold(float(found["threshold"])) if found else d


# --- calibration ------------------------------------------------------------------------------------


def reliability_bins(oof: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins: count, mean score, observed rate; empty bins stay, with nulls."""
    s = clipped(c("score"))
    d = oof.groupBy(F.least(F.floor(s * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.avg(s).alias("mean_predicted_score"),
        F.avg((c("true_label") == "beacon").cast("double")).alias("observed_beacon_rate"),
    )
    all_bins = oof.sparkSession.range(bins).select(c("id").cast("int").alias("bin"))
    return all_bins.join(d, "bin", "left").select(
        (c("bin") / bins).alias("lower_bound"),
        ((c("bin") + 1) / bins).alias("upper_bound"),
        F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
        "mean_predicted_score",
        "observed_beacon_rate",
    )


def brier(oof: DataFrame) -> DataFrame:
    y = (c("true_label") == "beacon").cast("double")
    return oof.agg(F.avg(F.pow(clipped(c("score")) - y, 2)).alias("brier_score"), F.count(F.lit(1)).alias("count"))


def fold_metrics(oof: DataFrame) -> DataFrame:
    from tidewatch.operators.evaluate import classification_metrics

    return classification_metrics(oof, ["fold"])


# --- feature sets (fixed values) --------------------------------------------------------------------

TIMING = [
    "flow_duration_seconds",
    "inter_arrival_cv",
    "trimmed_interarrival_cv",
    "interarrival_iqr_seconds",
    "interarrival_mad_seconds",
    "near_median_interarrival_fraction",
    "interarrival_within_10pct_median_fraction",
    "interarrival_within_20pct_median_fraction",
    "interarrival_within_30pct_median_fraction",
    "dominant_interval_fraction",
    "dominant_interval_bin_fraction",
    "interval_bin_count",
    "adjacent_gap_similarity_fraction",
    "longest_similar_gap_run",
    "gap_range_median_ratio",
    "interarrival_median_absolute_percentage_deviation",
    "periodicity_score",
]
BURST = [
    "burst_count",
    "avg_burst_size",
    "burst_size_cv",
    "sleep_duration_cv",
    "within_burst_gap_consistency",
    "burst_to_idle_ratio",
]
SIZE = [
    "size_cv",
    "dominant_size_bin_fraction",
    "size_bin_count",
    "normalized_size_range",
    "near_median_size_fraction",
]


def feature_sets() -> dict[str, list[str]]:
    full = list(ModelParams().features)
    return {
        "full": full,
        "without_event_count": [f for f in full if f != "event_count"],
        "without_size_cv": [f for f in full if f != "size_cv"],
        "without_event_count_and_size_cv": [f for f in full if f not in ("event_count", "size_cv")],
        "timing_only": TIMING,
        "timing_burst": TIMING + BURST,
        "timing_size": TIMING + SIZE,
        "timing_burst_size": TIMING + BURST + SIZE,
    }


def ablation(
    train: DataFrame,
    test: DataFrame,
    sets: Sequence[str] | None = None,
    kinds: Sequence[str] = ("logistic_regression", "random_forest"),
    p: ModelParams = ModelParams(),
) -> DataFrame:
    """Test rows scored by every model and feature set: feature_set and detector_type columns."""
    available = feature_sets()
    out, grid = None, [(name, kind) for name in sets or list(available) for kind in kinds]
    fits = side_by_side(train.sparkSession, lambda x: fit(train, x[1], replace(p, features=tuple(available[x[0]]))), grid)
    for (name, kind), d in zip(grid, fits):
        s = score(test, d).withColumns(
            {"feature_set": F.lit(name), "detector_type": F.lit(kind), "operating_point": F.lit(d.operating_point)}
        )
        s = s.drop("contributions")
        out = s if out is None else out.unionByName(s)
    return out


MODEL_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def threshold_study(
    train: DataFrame,
    test: DataFrame,
    sets: Sequence[str] = ("full", "timing_size"),
    thresholds: Sequence[float] = tuple(MODEL_THRESHOLDS),
    p: ModelParams = ModelParams(),
    by: Sequence[str] = (),
) -> DataFrame:
    """Metrics per feature set and threshold; one fit per set, since the threshold is not in it."""
    from tidewatch.operators.evaluate import threshold_sweep

    scored = ablation(train, test, sets, ["random_forest"], p).withColumnRenamed("label", "true_label")
    return threshold_sweep(scored.drop("threshold"), thresholds, ["feature_set", *by])


def regime_compare(base: DataFrame, stress: DataFrame, test: DataFrame, p: ModelParams = ModelParams()) -> DataFrame:
    """The same evaluation rows scored after training on base and on base with stress rows."""
    out = None
    for name, rows in (("base", base), ("base_plus_stress", base.unionByName(stress))):
        s = score(test, fit(rows, "random_forest", p)).drop("contributions").withColumn("training_regime", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out


def importance_table(d: Detector, spark, **keys: str) -> DataFrame:
    """feature_name, value_type, value, absolute_value of one model."""
    kind = "feature_importance" if d.kind == "random_forest" else "coefficient"
    rows = [(f, kind, w, abs(w)) for f, w in feature_weights(d)]
    df = spark.createDataFrame(rows, "feature_name string, value_type string, value double, absolute_value double")
    return df.select(F.lit(d.name).alias("detector_name"), *[F.lit(v).alias(k) for k, v in keys.items()], *df.columns)


