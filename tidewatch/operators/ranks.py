"""Exact ranks, running sums and quantiles over data of any size.

Nothing here ranks inside one task. A global order is built by Spark's range partitioning; the
sorted rows are checkpointed once, so every later use sees the same slices, and a table with one
row per slice carries the offsets.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICE, POS = "_slice", "_pos"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; a private one only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors can reach.")
        shared = tempfile.mkdtemp(prefix="tidewatch-checkpoint-")
    sc.setCheckpointDir(shared)


def sorted_slices(df: DataFrame, order: Sequence) -> DataFrame:
    """Globally sorted rows with the number of their slice and their position inside it.

    `order` should be total: then one hot value is spread over several slices, and a lost
    executor recomputes the same slices.
    """
    ensure_checkpoint_dir(df.sparkSession)
    m = F.monotonically_increasing_id()
    s = df.orderBy(*order).withColumn("_m", m)
    return (
        s.select(
            "*",
            F.shiftright("_m", 33).cast("int").alias(SLICE),
            F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias(POS),
        )
        .drop("_m")
        .checkpoint()
    )


def running_sums(sliced: DataFrame, sums: dict[str, str]) -> DataFrame:
    """Inclusive running totals in the global order; `sums` maps new column -> summed column."""
    local = W.partitionBy(SLICE).orderBy(POS).rowsBetween(W.unboundedPreceding, 0)
    before = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    # one row per slice, so at most spark.sql.shuffle.partitions rows
    totals = sliced.groupBy(SLICE).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    offsets = totals.select(
        SLICE, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    out = sliced.withColumns({f"_l_{k}": F.sum(v).over(local) for k, v in sums.items()})
    out = out.join(F.broadcast(offsets), SLICE)
    out = out.withColumns({k: F.col(f"_l_{k}") + F.col(f"_o_{k}") for k in sums})
    return out.drop(*[f"_l_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def with_rank(df: DataFrame, order: Sequence, rank: str = "rank") -> DataFrame:
    """Global row number from 1, without a single-task window."""
    s = sorted_slices(df, order)
    before = W.orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)
    counts = s.groupBy(SLICE).agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.select(SLICE, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return (
        s.join(F.broadcast(offsets), SLICE)
        .withColumn(rank, (F.col("_o") + F.col(POS) + 1).cast("bigint"))
        .drop("_o", SLICE, POS)
    )


def hash_rank(
    df: DataFrame, key: str, rank: str, total: str, by: Sequence[str] = (), digits: int = 4
) -> DataFrame:
    """Row number in the order of a hex hash column that is unique within `by`, and the row count.

    A hash spreads evenly, so its first digits cut the order into 16^digits equal buckets that a
    window can rank on their own; bucket counts give the offsets.
    """
    by = list(by)
    d = df.withColumn("_b", F.substring(key, 1, digits))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*by) if by else W.partitionBy()
    offsets = counts.select(
        *[F.col(c).alias(f"_k_{c}") for c in by],
        F.col("_b").alias("_k_b"),
        F.coalesce(
            F.sum("_c").over(w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_o"),
        F.sum("_c").over(w).alias(total),
    )
    on = F.col("_b") == F.col("_k_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    local = F.row_number().over(W.partitionBy(*by, "_b").orderBy(key))
    # without groups the table has at most 16^digits rows, which bounds the broadcast
    side = offsets if by else F.broadcast(offsets)
    return (
        d.withColumn("_r", local)
        .join(side, on)
        .withColumn(rank, F.col("_o") + F.col("_r"))
        .drop("_b", "_k_b", "_o", "_r", *[f"_k_{c}" for c in by])
    )


def group_quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
    weight: str | None = None,
) -> DataFrame:
    """Exact quantiles per group with no group gathered in one task.

    Values are counted first, the distinct ones sorted globally, and the wanted positions picked
    from running counts. `linear` interpolates between neighbours, `nearest` takes the value at
    round-half-even((n-1)*q). A weight column says how often a row counts. Adds columns named by `probs` next to the group columns and `n`.
    """
    groups = list(groups)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    run = running_sums(sorted_slices(counted, [*groups, value]), {"_cum": "_c"})
    # One row per group. Its end in the global running count is known from its own rows.
    spans = run.groupBy(*groups).agg(F.max("_cum").alias("_end"), F.sum("_c").alias("n"))
    if groups:
        keys = [f"_k_{g}" for g in groups]
        spans = spans.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], "_end", "n")
        on = None
        for g, k in zip(groups, keys):
            c = F.col(g).eqNullSafe(F.col(k))
            on = c if on is None else on & c
        run = run.join(spans, on).drop(*keys)
    else:
        run = run.crossJoin(F.broadcast(spans))  # one row
    hi = F.col("_cum") - (F.col("_end") - F.col("n"))
    lo = hi - F.col("_c")
    aggs: list[Column] = [F.first("n").alias("n")]
    finish = []
    for name, q in probs.items():
        at = (F.col("n") - 1) * F.lit(float(q))
        if method == "nearest":
            i = F.rint(at)
            aggs.append(F.max(F.when((lo <= i) & (i < hi), F.col(value))).alias(name))
            finish.append(F.col(name).cast("double").alias(name))
        else:
            a, b = F.floor(at), F.ceil(at)
            aggs.append(F.max(F.when((lo <= a) & (a < hi), F.col(value))).alias(f"_a_{name}"))
            aggs.append(F.max(F.when((lo <= b) & (b < hi), F.col(value))).alias(f"_b_{name}"))
            frac = at - F.floor(at)
            low, high = F.col(f"_a_{name}"), F.col(f"_b_{name}")
            finish.append((low + (high - low) * frac).cast("double").alias(name))
    return run.groupBy(*groups).agg(*aggs).select(*groups, "n", *finish)
