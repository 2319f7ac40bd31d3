from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidewatch.operators import anomaly as an
from tidewatch.operators import forest as fo
from tidewatch.operators import models as md
from tidewatch.operators import neighbors as nb
from tidewatch.schema import OPS_KEY, AnomalyParams, ModelParams


def brute_lof(ref, rows, k, contamination):
    """Reference by row, copies kept, straight from the definition."""

    def nearest(a, b, skip):
        d = np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(2))
        if skip:
            np.fill_diagonal(d, np.inf)
        o = np.argsort(d, axis=1, kind="stable")[:, :k]
        return np.take_along_axis(d, o, 1), o

    mu, sd = ref.mean(0), ref.std(0)
    sd[sd == 0] = 1
    ref, rows = (ref - mu) / sd, (rows - mu) / sd
    d, o = nearest(ref, ref, True)
    kd = d[:, -1]
    lrd = 1 / (np.maximum(d, kd[o]).mean(1) + 1e-10)
    offset = np.quantile(-(lrd[o].mean(1) / lrd), contamination)
    d, o = nearest(rows, ref, False)
    own = 1 / (np.maximum(d, kd[o]).mean(1) + 1e-10)
    return lrd[o].mean(1) / own + offset


def table(spark, x, label="benign"):
    names = [f"f{i}" for i in range(x.shape[1])]
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"{n} double" for n in names))
    return d.withColumn("label", F.lit(label)), names


@pytest.mark.parametrize("block,leaf,two_step", [(4000, 1000, 8), (7, 10, 64), (7, 10, 1), (4000, 5, 1)])
def test_lof_against_brute_force(spark, monkeypatch, block, leaf, two_step):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)  # small blocks: leaves and visitors are cut up
    monkeypatch.setattr(nb, "TWO_STEP_LEAVES", two_step)
    monkeypatch.setattr(nb, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(5)
    ref = np.vstack([rng.normal(size=(60, 3)), rng.normal(loc=6, size=(40, 3))])
    rows = np.vstack([rng.normal(size=(20, 3)), rng.normal(scale=9, size=(20, 3))])
    r, names = table(spark, ref)
    q, _ = table(spark, rows)
    got = an.score_lof(q, an.fit_lof(r, names, 10, 0.03)).orderBy("id").select("score").toPandas()["score"]
    np.testing.assert_allclose(got, brute_lof(ref, rows, 10, 0.03), rtol=1e-9)


def test_neighbors_of_a_sampled_tree(spark, monkeypatch):
    """A tree grown from a few of the vectors finds the same neighbours, and prunes."""
    monkeypatch.setattr(nb, "SAMPLE_ROWS", 40)
    monkeypatch.setattr(nb, "LEAF_ROWS", 15)
    monkeypatch.setattr(nb, "TWO_STEP_LEAVES", 2)
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(loc=rng.uniform(-30, 30, 4), size=(30, 4)) for _ in range(10)])
    rows = spark.createDataFrame([(f"{i:03}", v.tolist(), 1) for i, v in enumerate(x)], "rid string, vec array<double>, w bigint")
    got = nb.knn(rows.select(F.col("rid").alias("qid"), "vec"), rows, 5, True).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(d[i], kind="stable")[:5]}
    assert {(int(r.qid), int(r.rid)) for r in got} == want
    tree = nb._tree(rows, 300)
    planted, stats = nb._planted(rows, tree)
    assert stats["n"].sum() == 300 and len(stats) > 8
    theta = rows.select(F.col("rid").alias("qid"), "vec", F.lit(3.0).alias("theta"))
    visits = nb._visits(theta, tree, stats, 6, "near").count() + nb._visits(theta, tree, stats, 6, "rest").count()
    assert visits < 300 * len(stats) / 3


def test_lof_with_many_copies(spark):
    """A third of the reference is one record, and queries repeat."""
    rng = np.random.default_rng(6)
    ref = np.vstack([rng.normal(size=(60, 2)), np.tile([[0.5, 0.25]], (30, 1))])
    rows = np.vstack([np.tile([[0.5, 0.25]], (5, 1)), rng.normal(size=(10, 2))])
    r, names = table(spark, ref)
    q, _ = table(spark, rows)
    got = an.score_lof(q, an.fit_lof(r, names, 8, 0.1)).orderBy("id").select("score").toPandas()["score"].to_numpy()
    want = brute_lof(ref, rows, 8, 0.1)
    np.testing.assert_allclose(got, want, rtol=1e-6)


def test_native_lof_threshold(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 3))
    d, names = table(spark, x)
    d = d.withColumn("role", F.when(F.col("id") < 50, F.array(F.lit("reference"))).when(F.col("id") < 70, F.array(F.lit("calibration"))).otherwise(F.array(F.lit("evaluation"))))
    got = an.native_lof(d, names, 20, 0.03, 0.97).orderBy("id").toPandas()
    cal = brute_lof(x[:50], x[50:70], 20, 0.03)
    np.testing.assert_allclose(got["threshold"], np.quantile(cal, 0.97), rtol=1e-9)
    np.testing.assert_allclose(got["score"], brute_lof(x[:50], x[70:], 20, 0.03), rtol=1e-9)


def test_fewer_neighbors(spark):
    rng = np.random.default_rng(9)
    r, names = table(spark, rng.normal(size=(40, 2)))
    fit, v, _ = an._vectors(r, names)
    q = v.select(F.col("rid").alias("qid"), "vec")
    a = an.fewer(nb.knn(q, v, 12, True), 5).collect()
    b = nb.knn(q, v, 5, True).collect()
    key = lambda rows: sorted((x["qid"], x["rid"], x["take"]) for x in rows)
    assert key(a) == key(b)


def test_isolation_forest_separates(spark):
    rng = np.random.default_rng(4)
    r, names = table(spark, rng.normal(size=(300, 3)))
    r = r.withColumn("row_key", F.sha2(F.col("id").cast("string"), 256))
    m = an.fit_iforest(r, names, replace(AnomalyParams(), trees=60))
    assert m.nodes.groupby("tree").size().max() <= 2 * 256 - 1 and m.nodes["tree"].nunique() == 60
    far, _ = table(spark, rng.normal(loc=8, size=(30, 3)))
    near, _ = table(spark, rng.normal(size=(30, 3)))
    a, b = (an.score_iforest(x, m).agg(F.avg("score")).first()[0] for x in (far, near))
    assert a > b and a > 0
    assert an.score_iforest(far, m).select("score").collect() == an.score_iforest(far, m).select("score").collect()


def test_tree_samples_are_exact(spark):
    d = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).alias("row_key"), F.array(F.col("id").cast("double")).alias("vec"))
    got = an.tree_samples(d, 5, 64, 2000, 42).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("row_key").alias("k"))
    assert [(r["n"], r["k"]) for r in got.collect()] == [(64, 64)] * 5


def labelled(spark, n=60):
    rng = np.random.default_rng(2)
    rows = [("a", "->", f"d{i}", 443, "tcp", "beacon" if i % 3 == 0 else "benign", float(rng.normal(3 if i % 3 == 0 else 0)), float(rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "src_ip string, direction string, dst_ip string, dst_port int, protocol string, label string, x double, y double")


@pytest.mark.parametrize("kind", ["random_forest", "logistic_regression"])
def test_classifier(spark, kind):
    d = labelled(spark)
    m = md.fit(d, kind, ModelParams(features=("x", "y"), trees=20))
    assert md.top_features(m)[0][0] == "x"
    s = md.score(d, m)
    right = s.filter("predicted_label = label").count()
    assert right >= 50 and s.filter("score NOT BETWEEN 0 AND 1").count() == 0
    assert md.score(d, m.with_threshold(0.0)).filter("predicted_label = 'benign'").count() == 0
    with pytest.raises(ValueError, match="both labels"):
        md.fit(d.filter("label = 'benign'"), kind, ModelParams(features=("x",)))


def test_balanced_weights(spark):
    w = {r["label"]: r["weight"] for r in md.class_weights(labelled(spark)).collect()}
    assert w == {"beacon": 60 / 40, "benign": 60 / 80}


def test_folds(spark):
    d = labelled(spark)
    k, why = md.fold_count(d, 5)
    f = md.kfold(d, k)
    assert (k, why) == (5, None) and f.count() == 60
    assert {r["count"] for r in f.groupBy("label", "fold").count().collect()} == {4, 8}
    assert md.fold_count(d, 1)[0] == 0 and md.fold_count(d.filter("label='benign'"), 5)[0] == 0


def test_folds_keep_the_rows_of_a_key_together(spark):
    d = labelled(spark)
    f = md.kfold(d.unionByName(d).unionByName(d), 5)
    assert f.count() == 180
    assert {r["n"] for r in f.groupBy(*OPS_KEY).agg(F.countDistinct("fold").alias("n")).collect()} == {1}


def test_profiles_are_ordered(spark):
    benign, beacon = [0.10, 0.20, 0.30, 0.40, 0.45, 0.50, 0.70], [0.25, 0.60, 0.65, 0.80]
    rows = [("benign", s) for s in benign] + [("beacon", s) for s in beacon]
    oof = spark.createDataFrame(rows, "true_label string, score double")
    evals = md.evaluate_thresholds(oof)
    got = {r["threshold"]: r for r in evals.collect()}
    scores = sorted({s for _, s in rows})
    want = {0.0, 1.0, *scores, *[(a + b) / 2 for a, b in zip(scores, scores[1:])]}
    assert set(got) == want
    for t, r in got.items():
        assert r["tp"] == sum(s >= t for s in beacon) and r["fp"] == sum(s >= t for s in benign)
    p = {r["profile"]: r["threshold"] for r in md.threshold_profiles(evals).collect()}
    assert p["conservative"] >= p["balanced"] >= p["sensitive"] and len(set(p.values())) >= 2
    assert (p["conservative"], p["sensitive"]) == (0.8, 0.225)


def test_calibration(spark):
    oof = spark.createDataFrame([("beacon", 1.0), ("benign", 0.05), ("beacon", 0.55)], "true_label string, score double")
    bins = md.reliability_bins(oof).orderBy("lower_bound").collect()
    assert [b["observation_count"] for b in bins] == [1, 0, 0, 0, 0, 1, 0, 0, 0, 1]
    assert bins[1]["mean_predicted_score"] is None and bins[9]["observed_beacon_rate"] == 1.0
    assert md.brier(oof).first()["brier_score"] == pytest.approx((0.0025 + 0.2025) / 3)
    assert md.default_profiles()["balanced"]["threshold"] == 0.65


def test_rows_of_a_fit_are_dealt_evenly(spark, monkeypatch):
    """A table that came in one part, as from a file with one row group, is dealt to all cores."""
    rows = spark.range(0, 400, numPartitions=1).unionByName(spark.range(0, numPartitions=3).limit(0))
    sizes = lambda d: sorted(len(x) for x in d.rdd.glom().collect())
    assert max(sizes(md.evenly(rows))) == 400  # few rows stay as they are
    monkeypatch.setattr(md, "FEW_ROWS", 100)
    got = md.evenly(rows)
    assert max(sizes(got)) <= 110 and sorted(r["id"] for r in got.collect()) == list(range(400))
    monkeypatch.setattr(md, "PART_ROWS", 50)
    assert len(sizes(md.evenly(rows))) == 8
    even = spark.range(0, 400, numPartitions=4)
    assert sizes(md.evenly(even)) == [100] * 4
    assert md.evenly(rows.limit(0)).count() == 0


def test_neighbors_move_blocks_by_groups(spark, monkeypatch):
    """Leaves travel once for each group of queries, in units; as many rows as queries and leaves do not."""
    monkeypatch.setattr(nb, "LEAF_ROWS", 10)
    monkeypatch.setattr(nb, "BLOCK_ROWS", 7)
    monkeypatch.setattr(nb, "TWO_STEP_LEAVES", 2)
    monkeypatch.setattr(nb, "GROUP_ROWS", 60)
    monkeypatch.setattr(nb, "UNIT_BLOCKS", 4)
    moved, search = [], nb._search

    def counted(queries, pairs, *rest):
        moved.append(pairs.count())
        return search(queries, pairs, *rest)

    monkeypatch.setattr(nb, "_search", counted)
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 5))
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rid bigint, vec array<double>, w bigint")
    got = nb.knn(rows.select(F.col("rid").alias("qid"), "vec"), rows, 6, True).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert {(r.qid, r.rid) for r in got} == {(i, int(j)) for i in range(200) for j in np.argsort(d[i], kind="stable")[:6]}
    assert len(moved) == 2 and sum(moved) <= 200  # single queries made 2,000 visits and more


def test_a_fit_reads_few_parts(spark, monkeypatch):
    """A table in many parts, as of many events, is fitted in as many parts as cores."""
    seen, real = [], md.Pipeline

    class Counted:
        def __init__(self, stages):
            self.stages = stages

        def fit(self, rows):
            seen.append(rows.rdd.getNumPartitions())
            return real(stages=self.stages).fit(rows)

    monkeypatch.setattr(md, "Pipeline", Counted)
    rows, p = labelled(spark, 90).repartition(30), ModelParams(features=("x", "y"), trees=5)
    md.fit(rows, "random_forest", p)
    monkeypatch.setattr(md, "FEW_ROWS", 50)
    md.fit(rows, "random_forest", p)
    monkeypatch.setattr(md, "PART_ROWS", 10)
    md.fit(rows, "random_forest", p)
    assert seen == [30, spark.sparkContext.defaultParallelism, 9]


def test_forest_of_many_rows(spark, monkeypatch, tmp_path):
    """Trees that are counted one at a time in a part score as those of Spark ML do, and can be saved."""
    rows, p = labelled(spark, 400).repartition(3).checkpoint(), ModelParams(features=("x", "y"), trees=60)
    small = md.fit(rows, "random_forest", p)
    monkeypatch.setattr(md, "FOREST_ROWS", 100)
    monkeypatch.setattr(fo, "CHUNK_ROWS", 50)
    large = md.fit(rows, "random_forest", p)
    assert isinstance(large.model, fo.Forest) and large.model.feature.shape == (60, 512)
    a, b = (np.array([r["score"] for r in md.score(rows, m).orderBy("dst_ip").collect()]) for m in (small, large))
    assert np.corrcoef(a, b)[0, 1] > 0.97 and abs(a - b).mean() < 0.05 and b.min() >= 0 and b.max() <= 1
    weights = dict(md.feature_weights(large))
    assert weights["x"] > weights["y"] and sum(weights.values()) == pytest.approx(1)
    assert md.save_model(large, spark, str(tmp_path / "m")) == "forest_table"
    again = md.Detector(large.kind, p, md.load_model(spark, str(tmp_path / "m"), "forest_table"))
    assert [r["score"] for r in md.score(rows, again).orderBy("dst_ip").collect()] == b.tolist()


def test_forest_splits(spark):
    """The counted split of a root is the best of all, and missing values count as 0."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 2)), 1)
    y = (x[:, 1] + rng.normal(scale=0.4, size=300) > 0.3).astype(int)
    data = [(None if v == 0 else float(v), float(w), int(z)) for (v, w), z in zip(x, y)]
    rows = spark.createDataFrame(data, "a double, b double, y int").repartition(2).checkpoint()
    f = fo.fit_forest(rows, ["a", "b"], "y", 300, (1.0, 1.0), 40, 1, 2, 5)
    used = f.feature[:, 1] == 1
    assert used.sum() > 30 and f.importances[1] > 0.9

    def loss(cut):
        sides = [y[x[:, 1] <= cut], y[x[:, 1] > cut]]
        return sum(len(s) * s.mean() * (1 - s.mean()) for s in sides if len(s))

    values = np.unique(x[:, 1])
    best = min(loss(c) for c in (values[:-1] + values[1:]) / 2)
    assert np.median([loss(c) for c in f.cut[used, 1]]) < best * 1.05
    left, right = f.beacon[used, 2], f.beacon[used, 3]
    assert (left < 0.4).all() and (right > 0.6).all()
    assert (f.feature[:, 2:] < 0).all()


def test_one_search_for_rows_and_reference(spark, monkeypatch):
    """Rows that hold the reference, with copies of some, are scored from one search as from two."""
    searches, knn = [], an.knn
    monkeypatch.setattr(an, "knn", lambda *a, **b: searches.append(a) or knn(*a, **b))
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(size=(50, 2)), np.tile([[0.5, 0.25]], (9, 1)), rng.normal(size=(15, 2))])
    d, names = table(spark, x)
    reference = d.filter("id < 59 AND id % 5 > 0")
    got = an.fit_and_score(d, reference, names, 6, 0.1).orderBy("id").select("score").toPandas()["score"]
    assert len(searches) == 1
    keep = (np.arange(74) < 59) & (np.arange(74) % 5 > 0)
    np.testing.assert_allclose(got, brute_lof(x[keep], x, 6, 0.1), rtol=1e-6)
