"""Local outlier factor and isolation forest as novelty detectors over feature rows.

LOF: Breunig et al. 2000. Isolation forest: Liu, Ting and Zhou 2008.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewatch.operators.neighbors import distinct_vectors, knn, numbered, vector_id
from tidewatch.operators.ranks import ensure_checkpoint_dir, group_quantiles
from tidewatch.operators.zscore import (
    fit_reference,
    in_role,
    nearest_rank,
    split_reference,
    stable_key,
    top_contributions,
    z_columns,
)
from tidewatch.schema import IFOREST_DETECTOR, LOF_DETECTOR, AnomalyParams

c = F.col
SMALLEST = 1e-10  # added to the mean reach distance, as the usual implementation does


def scaled(rows: DataFrame, fit: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds `vec`: features scaled by the reference (population std, 0 counts as 1)."""
    d = rows.crossJoin(F.broadcast(fit.select("mean", "std")))  # one row
    return d.withColumn("vec", F.array(*[z + 0.0 for z in z_columns(features, None)])).drop("mean", "std")


@dataclass
class LofModel:
    """Distinct reference vectors with their k-distance and density, and the score offset."""

    k: int
    features: tuple[str, ...]
    fit: DataFrame
    reference: DataFrame  # rid, vec, w, k_dist, lrd
    offset: DataFrame  # one row: offset


def _density(neighbors: DataFrame, k_dist: DataFrame) -> DataFrame:
    reach = F.greatest(c("dist"), c("k_dist"))
    d = neighbors.join(k_dist.select("rid", "k_dist"), "rid")
    mean = F.sum(reach * c("take")) / F.sum("take")
    return d.groupBy("qid").agg((1.0 / (mean + F.lit(SMALLEST))).alias("lrd"))


def _factor(neighbors: DataFrame, own: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean density of the neighbours over the own density."""
    d = neighbors.join(reference.select("rid", c("lrd").alias("_n")), "rid").groupBy("qid").agg(
        (F.sum(c("_n") * c("take")) / F.sum("take")).alias("_m")
    )
    return d.join(own, "qid").select("qid", (c("_m") / c("lrd")).alias("lof"))


def _vectors(reference_rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame, int]:
    ensure_checkpoint_dir(reference_rows.sparkSession)
    fit = fit_reference(reference_rows, features)
    vectors = distinct_vectors(scaled(reference_rows, fit, features).select("vec"))
    vectors = numbered(vectors, "rid", "_i").select(c("_i").alias("rid"), "vec", "w", c("rid").alias("name")).checkpoint()
    return fit, vectors, vectors.agg(F.sum("w").alias("n")).first()["n"]


def _model(fit: DataFrame, vectors: DataFrame, near: DataFrame, k: int, features: Sequence[str], contamination: float) -> LofModel:
    """Densities and offset from the reference's own neighbours."""
    k_dist = near.groupBy("qid").agg(F.max("dist").alias("k_dist")).withColumnRenamed("qid", "rid")
    lrd = _density(near, k_dist)
    ref = vectors.drop("name").join(k_dist, "rid").join(lrd.withColumnRenamed("qid", "rid"), "rid").checkpoint()
    lof = _factor(near, lrd, ref).withColumnRenamed("qid", "rid").join(vectors.select("rid", "w"), "rid")
    return LofModel(k, tuple(features), fit, ref, _offset(lof.select((-c("lof")).alias("v"), "w"), contamination))


def fit_lof(reference_rows: DataFrame, features: Sequence[str], neighbors: int, contamination: float) -> LofModel:
    fit, vectors, total = _vectors(reference_rows, features)
    k = min(neighbors, max(1, total - 1))
    near = knn(vectors.select(c("rid").alias("qid"), "vec"), vectors.drop("name"), k, exclude_self=True).checkpoint()
    return _model(fit, vectors, near, k, features, contamination)


def without_self(near: DataFrame, own: DataFrame) -> DataFrame:
    """The neighbours of the reference among itself, from a search with the same vectors as queries (`own`
    has qid and the vector's rid): one copy of the own vector is left out. Of k + 1 neighbours k remain."""
    d = near.join(own.select("qid", c("rid").alias("_own")), "qid")
    take = c("take") - (c("rid") == c("_own")).cast("bigint")
    d = d.select(c("_own").alias("qid"), "rid", "dist", take.alias("take")).filter("take > 0")
    w = W.partitionBy("qid").orderBy("dist", "rid").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("before", F.sum("take").over(w) - c("take"))


def fewer(near: DataFrame, k: int) -> DataFrame:
    """The first k of a longer neighbour list (a list has at most as many rows as its k)."""
    take = F.least(c("take"), F.lit(k) - c("before"))
    return near.select("qid", "rid", "dist", take.alias("take"), "before").filter("take > 0")


def _offset(values: DataFrame, contamination: float) -> DataFrame:
    """Linear percentile of the negated reference scores, copies counted by weight."""
    return group_quantiles(values, [], "v", {"offset": contamination}, weight="w").drop("n")


def _scores(near: DataFrame, model: LofModel) -> DataFrame:
    lof = _factor(near, _density(near, model.reference), model.reference)
    return lof.crossJoin(F.broadcast(model.offset))  # one row


def score_lof(rows: DataFrame, model: LofModel) -> DataFrame:
    """Adds `score` = LOF + offset and `vec`. Equal rows are scored once."""
    d = scaled(rows, model.fit, model.features).withColumn("_q", vector_id())
    queries = _queries(d.select("_q", "vec"), "_q")
    near = knn(queries, model.reference.select("rid", "vec", "w"), model.k).checkpoint()
    scores = _scores(near, model).join(queries.select("qid", "_q"), "qid")
    return d.join(scores.select("_q", (c("lof") + c("offset")).alias("score")), "_q").drop("_q")


def _searched(rows: DataFrame, vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (`_q`, see vector_id, and `vec`) that hold all rows of the reference: the queries, k neighbours
    of each, and k neighbours of the reference among itself, all from one search."""
    queries = _queries(rows.select("_q", "vec"), "_q")
    near = knn(queries.select("qid", "vec"), vectors.drop("name"), k + 1).checkpoint()
    own = queries.join(vectors.select("rid", c("name").alias("_q")), "_q")
    return queries, fewer(near, k), fewer(without_self(near, own), k).checkpoint()


def fit_and_score(rows: DataFrame, reference_rows: DataFrame, features: Sequence[str], neighbors: int, contamination: float) -> DataFrame:
    """score_lof of rows that hold all rows of the reference, by a model of the reference."""
    fit, vectors, total = _vectors(reference_rows, features)
    k = min(neighbors, max(1, total - 1))
    if total < 2:  # nothing is left without the own row
        return score_lof(rows, fit_lof(reference_rows, features, neighbors, contamination))
    d = scaled(rows, fit, features).withColumn("_q", vector_id())
    queries, near_all, near_ref = _searched(d, vectors, k)
    model = _model(fit, vectors, near_ref, k, features, contamination)
    scores = _scores(near_all, model).join(queries.select("qid", "_q"), "qid")
    return d.join(scores.select("_q", (c("lof") + c("offset")).alias("score")), "_q").drop("_q")


def _queries(rows: DataFrame, name: str) -> DataFrame:
    """qid, vec: every vector once, numbered; `name` (see vector_id) stays next to them."""
    return numbered(rows.dropDuplicates([name]), name, "qid").select("qid", name, "vec").checkpoint()


def detections(scored: DataFrame, threshold: DataFrame, features: Sequence[str], name: str, k: int) -> DataFrame:
    d = scored.crossJoin(F.broadcast(threshold)).withColumnRenamed("vec", "z")  # one row
    return d.withColumns(
        {
            "detector_name": F.lit(name),
            "predicted_label": F.when(c("score") >= c("threshold"), "beacon").otherwise("benign"),
            "contributions": top_contributions(features, k, "%s standardized feature deviation %s", False),
        }
    ).drop("z")


def detect_lof(features: DataFrame, p: AnomalyParams = AnomalyParams(), fit_rows: DataFrame | None = None) -> DataFrame:
    """Fit on benign rows, calibrate the threshold by nearest rank, score every row once."""
    rows = features if fit_rows is None else fit_rows
    split = split_reference(rows, p.calibration_fraction, 2)
    reference, calibration = in_role(split, "reference"), in_role(split, "calibration")
    if fit_rows is None:
        # reference and calibration rows are among the scored rows already
        keyed = features.withColumn("row_key", stable_key(features.columns))
        scored = fit_and_score(keyed, reference, p.features, p.neighbors, p.contamination).checkpoint()
        scored_cal = scored.join(calibration.select("row_key"), "row_key", "left_semi")
    else:
        model = fit_lof(reference, p.features, p.neighbors, p.contamination)
        scored, scored_cal = score_lof(features, model), score_lof(calibration, model)
    threshold = nearest_rank(scored_cal, "score", 1.0 - p.contamination)
    return detections(scored, threshold, p.features, LOF_DETECTOR, p.top_k)


def native_lof(split: DataFrame, features: Sequence[str], neighbors: int = 20, contamination: float = 0.03, q: float = 0.97) -> DataFrame:
    """LOF over split rows (`role`): linear quantile of the calibration scores as threshold."""
    model = fit_lof(in_role(split, "reference"), features, neighbors, contamination)
    rows = split.filter(F.array_contains("role", "calibration") | F.array_contains("role", "evaluation"))
    scored = score_lof(rows, model).drop("vec").checkpoint()  # threshold and result both read it
    threshold = group_quantiles(in_role(scored, "calibration"), [], "score", {"threshold": q}).drop("n")
    out = in_role(scored, "evaluation").crossJoin(F.broadcast(threshold))  # one row
    return out.withColumns(
        {
            "detector_name": F.lit(LOF_DETECTOR),
            "predicted_label": F.when(c("score") >= c("threshold"), "beacon").otherwise("benign"),
        }
    )


# --- isolation forest -------------------------------------------------------------------------------

NODE = "tree int, node int, feature int, split double, left int, right int, size int, depth int"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=np.float64)
    many = 2.0 * (np.log(np.maximum(n - 1, 1.0)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1.0)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(seed: int, sample: int):
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        x = np.stack(rows.sort_values("row_key")["vec"].to_numpy())
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(x)), 0)]
        free = 1
        while todo:
            node, idx, depth = todo.pop()
            part = x[idx]
            lo, hi = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or len(idx) <= 1 or not len(usable):
                nodes.append((tree, node, -1, 0.0, -1, -1, len(idx), depth))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            go = part[:, f] <= cut
            nodes.append((tree, node, f, cut, free, free + 1, len(idx), depth))
            todo += [(free, idx[go], depth + 1), (free + 1, idx[~go], depth + 1)]
            free += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "split", "left", "right", "size", "depth"])

    return run


@dataclass
class IsolationForest:
    features: tuple[str, ...]
    fit: DataFrame
    nodes: pd.DataFrame  # trees * (2 * 256 - 1) rows at most
    sample: int
    offset: DataFrame | None = None


def tree_samples(rows: DataFrame, trees: int, sample: int, total: int, seed: int) -> DataFrame:
    """`sample` rows for each tree, chosen by hash: `tree`, `row_key`, `vec`.

    A row joins a tree's draw with a chance that makes the draw a bit larger than needed, so rows
    are not copied once per tree; the first `sample` by hash are the sample.
    """
    chance = min(1.0, (sample + 10.0 * sample**0.5) / max(total, 1))
    bar = int(chance * (1 << 31))
    draw = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.pmod(F.xxhash64(F.lit(seed), "row_key", t), F.lit(1 << 31)) <= bar,
    )
    d = rows.select("row_key", "vec", F.explode(draw).alias("tree"))
    w = W.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed + 1), "row_key", "tree"), "row_key")
    return d.withColumn("_r", F.row_number().over(w)).filter(c("_r") <= sample).drop("_r")


def fit_iforest(reference_rows: DataFrame, features: Sequence[str], p: AnomalyParams = AnomalyParams()) -> IsolationForest:
    fit = fit_reference(reference_rows, features)
    rows = scaled(reference_rows, fit, features)
    total = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    sample = min(256, total)
    grown = (
        tree_samples(rows, p.trees, sample, total, p.seed)
        .groupBy("tree")
        .applyInPandas(_grow(p.seed, sample), NODE)
    )
    model = IsolationForest(tuple(features), fit, grown.toPandas(), sample)
    scores = rows.select((-path_score(model)("vec")).alias("v"))
    model.offset = group_quantiles(scores, [], "v", {"offset": p.contamination}).drop("n")
    return model


def path_score(model: IsolationForest):
    """2^(-mean path length / expected length) per vector."""
    trees = []
    for _, t in model.nodes.sort_values(["tree", "node"]).groupby("tree"):
        end = t["depth"].to_numpy() + average_path(t["size"].to_numpy())
        trees.append(tuple(t[n].to_numpy() for n in ("feature", "split", "left", "right")) + (end,))
    expected = float(average_path(np.array([model.sample]))[0])

    @F.pandas_udf(T.DoubleType())
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy())
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, right, end in trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[rows, np.maximum(f, 0)] <= split[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += end[at]
        return pd.Series(np.power(2.0, -total / len(trees) / max(expected, 1e-12)))

    return score


def score_iforest(rows: DataFrame, model: IsolationForest) -> DataFrame:
    d = scaled(rows, model.fit, model.features)
    d = d.crossJoin(F.broadcast(model.offset))  # one row
    return d.withColumn("score", path_score(model)("vec") + c("offset")).drop("offset")


def detect_iforest(features: DataFrame, p: AnomalyParams = AnomalyParams(), fit_rows: DataFrame | None = None) -> DataFrame:
    split = split_reference(features if fit_rows is None else fit_rows, p.calibration_fraction, 2)
    model = fit_iforest(in_role(split, "reference"), p.features, p)
    threshold = nearest_rank(score_iforest(in_role(split, "calibration"), model), "score", 1.0 - p.contamination)
    return detections(score_iforest(features, model), threshold, p.features, IFOREST_DETECTOR, p.top_k)


# --- tuning -----------------------------------------------------------------------------------------

LOF_NEIGHBORS = [10, 20, 35, 50]
LOF_CONTAMINATION = [0.02, 0.03, 0.05]


def lof_name(neighbors: int, contamination: float) -> tuple[str, str]:
    text = str(contamination).replace(".", "p")
    return f"{LOF_DETECTOR}_n{neighbors}_c{text}", f"lof_neighbors={neighbors};contamination={contamination:g}"


def tune_lof(
    features: DataFrame,
    neighbors: Sequence[int] = tuple(LOF_NEIGHBORS),
    contamination: Sequence[float] = tuple(LOF_CONTAMINATION),
    p: AnomalyParams = AnomalyParams(),
) -> DataFrame:
    """Metrics of every candidate. Neighbours are searched once, at the largest count, and cut for
    the smaller ones. Contamination only moves the offset and the threshold, which is a quantile of
    scores that differ by a constant, so its values share a pass."""
    from tidewatch.operators.evaluate import confusion_aggs, with_metrics

    split = split_reference(features, p.calibration_fraction, 2)
    calibration = in_role(split, "calibration").select("row_key")
    fit, vectors, total = _vectors(in_role(split, "reference"), p.features)
    most = min(max(neighbors), max(1, total - 1))
    rows = scaled(features.withColumn("row_key", stable_key(features.columns)), fit, p.features)
    rows = rows.select("row_key", "label", "vec", vector_id().alias("_q")).checkpoint()
    if total < 2:  # nothing is left without the own row
        queries = _queries(rows.select("_q", "vec"), "_q")
        plain = vectors.drop("name")
        near_ref = knn(vectors.select(c("rid").alias("qid"), "vec"), plain, most, exclude_self=True).checkpoint()
        near_all = knn(queries.select("qid", "vec"), plain, most).checkpoint()
    else:
        queries, near_all, near_ref = _searched(rows, vectors, most)
    rows = rows.drop("vec").join(queries.select("qid", "_q"), "_q").drop("_q").checkpoint()
    out = None
    for wanted in neighbors:
        k = min(wanted, most)
        model = _model(fit, vectors, fewer(near_ref, k), k, p.features, contamination[0])
        scores = _scores(fewer(near_all, k), model)
        scored = rows.join(scores.select("qid", (c("lof") + c("offset")).alias("score")), "qid").checkpoint()
        cal = scored.join(calibration, "row_key", "left_semi")
        quantiles = group_quantiles(
            cal, [], "score", {f"t{i}": 1.0 - x for i, x in enumerate(contamination)}, "nearest"
        ).drop("n")
        d = scored.select(c("label").alias("true_label"), "score").crossJoin(F.broadcast(quantiles))  # one row
        aggs = []
        for i in range(len(contamination)):
            named = confusion_aggs(c("score") >= c(f"t{i}"))
            aggs += [a.alias(f"{n}{i}") for a, n in zip(named, ("tp", "fp", "tn", "fn"))]
        cells = F.array(*[_candidate(wanted, x, i) for i, x in enumerate(contamination)])
        m = with_metrics(d.agg(*aggs).select(F.explode(cells).alias("r")).select("r.*"))
        out = m if out is None else out.unionByName(m)
    return out


def _candidate(k: int, contamination: float, i: int) -> Column:
    name, point = lof_name(k, contamination)
    return F.struct(
        F.lit(name).alias("detector_name"),
        F.lit(point).alias("operating_point"),
        F.lit(k).alias("lof_neighbors"),
        F.lit(contamination).alias("contamination"),
        *[c(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")],
    )


def best_candidate(candidates: DataFrame) -> DataFrame:
    """Highest F1, then precision, then recall, then lowest false positive rate; a full tie goes to
    the first of the grid. One row per candidate, so this is a handful of rows."""
    order = [F.desc("f1"), F.desc("precision"), F.desc("recall"), "false_positive_rate", "lof_neighbors", "contamination"]
    return candidates.orderBy(*order).limit(1)
