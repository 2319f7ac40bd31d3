"""Z-score reference: splits, fit, score, contributions, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import fixed3
from tidewatch.operators.ranks import group_quantiles, hash_rank
from tidewatch.schema import ZSCORE_DETECTOR, ZScoreParams

c = F.col


def stable_key(columns: Sequence[str]) -> Column:
    """sha256 over the identity of a feature row; the order of every split."""

    def text(x: str) -> Column:
        return F.coalesce(c(x).cast("string"), F.lit("")) if x in columns else F.lit("")

    parts = ["src_ip", "src_port", "direction", "dst_ip", "dst_port", "protocol", "scenario_name", "label"]
    return F.sha2(F.concat_ws("|", *[text(p) for p in parts]), 256)


def split_reference(
    features: DataFrame,
    calibration_fraction: float = 0.25,
    min_reference: int = 1,
    by: Sequence[str] = (),
) -> DataFrame:
    """Benign rows with `role` reference or calibration, cut at round-half-even((1-f)*n).

    A single row (min_reference 1) or fewer rows than asked for serve as both, so `role` is an
    array.
    """
    benign = features.filter(c("label") == "benign").withColumn("row_key", stable_key(features.columns))
    d = hash_rank(benign, "row_key", "_rank", "_n", by)
    cut = F.least(
        F.greatest(F.lit(min_reference), F.rint(c("_n") * F.lit(1.0 - calibration_fraction)).cast("bigint")),
        c("_n") - 1,
    )
    both = F.array(F.lit("reference"), F.lit("calibration"))
    role = F.when(cut < min_reference, both).when(c("_rank") <= cut, F.array(F.lit("reference"))).otherwise(
        F.array(F.lit("calibration"))
    )
    return d.withColumn("role", role).drop("_rank", "_n")


def in_role(split: DataFrame, role: str) -> DataFrame:
    return split.filter(F.array_contains("role", role))


def fit_reference(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per group: arrays of mean and population std, in feature order; missing is 0."""
    value = {f: F.coalesce(c(f).cast("double"), F.lit(0.0)) for f in features}
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("reference_flow_count"),
        F.array(*[F.avg(v) for v in value.values()]).alias("mean"),
        F.array(*[F.stddev_pop(v) for v in value.values()]).alias("std"),
    )


def reference_table(fit: DataFrame, features: Sequence[str], min_std: float, by: Sequence[str] = ()) -> DataFrame:
    """The reference in long form: feature, mean, std."""
    names = F.array(*[F.lit(f) for f in features])
    return fit.select(*by, F.posexplode(F.arrays_zip(names.alias("f"), "mean", "std")).alias("i", "z")).select(
        *by,
        c("z.f").alias("feature_name"),
        c("z.mean").alias("mean"),
        F.greatest(c("z.std"), F.lit(min_std)).alias("std"),
    )


def attach(rows: DataFrame, side: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Attach a fitted one-row table, or one row per group."""
    return rows.join(side, list(by)) if by else rows.crossJoin(F.broadcast(side))


def z_columns(features: Sequence[str], floor: float | None) -> list[Column]:
    """z of each feature; `floor` bounds std from below, None means the scaler's rule (0 -> 1)."""
    out = []
    for i, f in enumerate(features):
        s = c("std")[i]
        s = F.greatest(s, F.lit(floor)) if floor is not None else F.when(s == 0, F.lit(1.0)).otherwise(s)
        out.append((F.coalesce(c(f).cast("double"), F.lit(0.0)) - c("mean")[i]) / s)
    return out


def top_contributions(features: Sequence[str], k: int, reason: str, with_reference: bool) -> Column:
    """The k features with the largest |z| from the array column `z`; ties keep feature order."""
    parts = []
    for i, f in enumerate(features):
        z = c("z")[i]
        fields = [
            (-F.abs(z)).alias("sort"),
            F.lit(i).alias("i"),
            F.lit(f).alias("rule_name"),
            F.abs(z).alias("score"),
            F.format_string(reason, F.lit(f), fixed3(z)).alias("reason"),
            F.coalesce(c(f).cast("double"), F.lit(0.0)).alias("feature_value"),
            z.alias("z_score"),
        ]
        if with_reference:
            fields += [c("mean")[i].alias("reference_mean"), c("std")[i].alias("reference_std")]
        parts.append(F.struct(*fields))
    top = F.slice(F.array_sort(F.array(*parts)), 1, k)
    names = ["rule_name", "score", "reason", "feature_value", "z_score"]
    names += ["reference_mean", "reference_std"] if with_reference else []
    return F.transform(top, lambda x: F.struct(*[x[n].alias(n) for n in names]))


def score_zscore(rows: DataFrame, fit: DataFrame, p: ZScoreParams = ZScoreParams(), by: Sequence[str] = ()) -> DataFrame:
    """sqrt(mean(z^2)) and the top contributions."""
    d = attach(rows, fit, by)
    d = d.withColumn("z", F.array(*z_columns(p.features, p.min_std)))
    total = F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)
    d = d.withColumn("std", F.transform("std", lambda s: F.greatest(s, F.lit(p.min_std))))
    return d.withColumns(
        {
            "score": F.sqrt(total / float(len(p.features))),
            "contributions": top_contributions(p.features, p.top_k, "%s z-score %s from benign reference", True),
        }
    ).drop("z", "mean", "std")


def nearest_rank(rows: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    return group_quantiles(rows, by, value, {"threshold": q}, "nearest").drop("n")


def detect_zscore(
    features: DataFrame,
    p: ZScoreParams = ZScoreParams(),
    by: Sequence[str] = (),
    fit_rows: DataFrame | None = None,
) -> DataFrame:
    """Fit on benign rows (per group of `by`), calibrate the threshold, score every row."""
    split = split_reference(features if fit_rows is None else fit_rows, p.calibration_fraction, 1, by)
    fit = fit_reference(in_role(split, "reference"), p.features, by)
    calibration = score_zscore(in_role(split, "calibration"), fit, p, by)
    threshold = nearest_rank(calibration, "score", p.benign_score_quantile, by)
    scored = attach(score_zscore(features, fit, p, by), threshold, by)
    return scored.withColumns(
        {
            "detector_name": F.lit(ZSCORE_DETECTOR),
            "predicted_label": F.when(c("score") >= c("threshold"), "beacon").otherwise("benign"),
        }
    )
