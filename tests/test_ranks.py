import numpy as np
from pyspark.sql import functions as F
from tidewatch.operators.ranks import group_quantiles, hash_rank, with_rank
from tidewatch.operators.zscore import nearest_rank


def test_rank_is_global_and_exact(spark):
    # a third of the rows share one value
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 97).alias("v"))
    rows = with_rank(df, [F.desc("v"), "id"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 3001))
    assert [(-r["v"], r["id"]) for r in rows] == sorted((-r["v"], r["id"]) for r in rows)


def test_hash_rank(spark):
    df = spark.range(500).select("id", (F.col("id") % 2).alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    rows = hash_rank(df, "h", "r", "n", ["g"]).collect()
    for g in (0, 1):
        mine = sorted((r for r in rows if r["g"] == g), key=lambda r: r["r"])
        assert [r["h"] for r in mine] == sorted(r["h"] for r in mine)
        assert [r["r"] for r in mine] == list(range(1, 251)) and {r["n"] for r in mine} == {250}


def test_group_quantiles(spark):
    rng = np.random.default_rng(1)
    data = [("a", float(v)) for v in rng.integers(0, 9, 400)] + [("b", float(v)) for v in rng.normal(size=33)] + [("c", 2.5)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p97": 0.97}).collect()}
    for g in "abc":
        v = [x for k, x in data if k == g]
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p97", 0.97)):
            assert np.isclose(got[g][name], np.quantile(v, q))
    every = sorted(x for _, x in data)
    for q in (0.0, 0.5, 0.99, 1.0):
        want = every[round((len(every) - 1) * q)]
        assert nearest_rank(df, "v", q).first()["threshold"] == want
