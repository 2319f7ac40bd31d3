"""Exact k nearest neighbours of vectors, as a blocked and pruned join over a metric tree.

A bounded sample of the reference is halved again and again across its widest direction; the tree of
these cuts sends every reference vector to a leaf. All vectors of a leaf, not the sample, give its
bounding box and the ring around its centre, from which a query gets a lower bound of its distance
to the leaf. A query searches the leaves of least bound first, until they surely hold k vectors, and
then only those whose bound is within the k-th distance it has found.

Leaves are packed into blocks of bounded size, and queries of neighbouring leaves into groups. A
block moves once for each group that visits it, not once for each query, a task takes a bounded number
of blocks and returns at most k + 1 neighbours per query, so neither a dense region nor a popular leaf
ends up in one task, and no list of all pairs exists. Equal reference vectors are one row with a weight,
so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidewatch.operators.ranks import with_rank

# Together these bound what the driver holds: the sample, and a box for each leaf.
SAMPLE_ROWS = 1 << 16
MAX_LEAVES = 1 << 12
LEAF_ROWS = 1000
BLOCK_ROWS = 4000
# Queries that visit leaves together, and blocks that a task of them takes: what a task holds, and how
# often a block and a group move.
GROUP_ROWS = 1 << 14
UNIT_BLOCKS = 64
# With fewer leaves a second search costs more than it prunes.
TWO_STEP_LEAVES = 8


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, dims))


def distinct_vectors(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """rid, vec, w: the distinct vectors and how often each occurs."""
    d = rows.groupBy(vec).agg(F.count(F.lit(1)).alias("w"))
    return d.select(vector_id(vec).alias("rid"), F.col(vec).alias("vec"), "w")


def vector_id(vec: str = "vec"):
    return F.sha2(F.array_join(F.transform(vec, lambda x: (x + 0.0).cast("string")), ","), 256)


@dataclass
class Tree:
    """Cuts x . direction <= cut with the children of both sides; a child below 0 is leaf -1 - child."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    centers: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, leaves: int) -> Tree:
        directions, cuts, children, centers = [], [], [], []

        def split(idx: np.ndarray, wanted: int) -> int:
            x = sample[idx]
            mean = x.mean(axis=0)
            a = x[((x - mean) ** 2).sum(axis=1).argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            side = x @ (b - a)
            cut = float(np.partition(side, (len(side) - 1) // 2)[(len(side) - 1) // 2])
            left = side <= cut
            if wanted < 2 or len(idx) < 2 or left.all():
                centers.append(mean)
                return -len(centers)
            n = len(cuts)
            directions.append(b - a)
            cuts.append(cut)
            children.append([0, 0])
            children[n] = [split(idx[left], wanted // 2), split(idx[~left], wanted - wanted // 2)]
            return n

        split(np.arange(len(sample)), leaves)
        dims = sample.shape[1]
        return cls(np.array(directions).reshape(-1, dims), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), np.array(centers))

    def leaf(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if len(self.cuts) else np.full(len(x), -1)
        inner = np.flatnonzero(at >= 0)
        while len(inner):
            n = at[inner]
            # summed row by row: a vector takes the same way in every batch
            right = (x[inner] * self.directions[n]).sum(axis=1) > self.cuts[n]
            at[inner] = self.children[n, right.astype(np.int64)]
            inner = inner[at[inner] >= 0]
        return -1 - at


def _tree(reference: DataFrame, count: int) -> Tree:
    """Grown from the vectors that come first by hash, SAMPLE_ROWS at most."""
    rows = reference.select("rid", "vec").orderBy("rid").limit(SAMPLE_ROWS).select("vec").toArrow()["vec"]
    sample = np.stack(rows.to_pandas().to_numpy()).astype(np.float64)
    return Tree.grow(sample, int(np.clip(count // LEAF_ROWS, 1, MAX_LEAVES)))


def _planted(reference: DataFrame, tree: Tree) -> tuple[DataFrame, pd.DataFrame]:
    """Reference rows with `at`, their leaf; and of each leaf: at, n, w, the distances lo to hi from its
    centre, and the least and largest value of each dimension."""
    kind = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("radius", T.DoubleType())])
    dims = tree.centers.shape[1]

    @F.pandas_udf(kind)
    def place(vec: pd.Series) -> pd.DataFrame:
        x = _matrix(vec, dims)
        at = tree.leaf(x)
        return pd.DataFrame({"at": at.astype(np.int32), "radius": np.sqrt(((x - tree.centers[at]) ** 2).sum(axis=1))})

    d = reference.withColumn("_a", place("vec")).select("rid", "vec", "w", "_a.at", "_a.radius")
    box = [f(F.get("vec", F.lit(i))) for f in (F.min, F.max) for i in range(dims)]
    stats = d.groupBy("at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.min("radius").alias("lo"), F.max("radius").alias("hi"),
        *[b.alias(f"b{i}") for i, b in enumerate(box)],
    )
    return d.drop("radius"), stats.toPandas().sort_values("at", ignore_index=True)  # at most MAX_LEAVES rows


def _visits(queries: DataFrame, tree: Tree, stats: pd.DataFrame, need: int, step: str) -> DataFrame:
    """The leaves each query visits, as `at`.

    `near`: the leaves of least bound that together hold enough vectors. `rest`: the other leaves that
    can still hold one within `theta`, the k-th distance found in the near ones. `all`: every leaf.
    """
    at = stats["at"].to_numpy(np.int32)
    lo, hi, w = (stats[c].to_numpy(np.float64) for c in ("lo", "hi", "w"))
    dims = tree.centers.shape[1]
    box = stats[[f"b{i}" for i in range(2 * dims)]].to_numpy(np.float64)
    low, high, centers = box[:, :dims], box[:, dims:], tree.centers[at]

    def bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower bounds of the distances to all leaves, and the near ones."""
        ball, outside = np.zeros((len(x), len(at))), np.zeros((len(x), len(at)))
        for j in range(dims):
            v = x[:, j, None]
            ball += (v - centers[:, j]) ** 2
            outside += np.maximum(np.maximum(low[:, j] - v, v - high[:, j]), 0.0) ** 2
        ball = np.sqrt(ball)
        lower = np.maximum(np.maximum(ball - hi, lo - ball), np.sqrt(outside))
        order = np.lexsort((ball, lower), axis=1)
        enough = np.cumsum(w[order], axis=1) >= need
        last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(at) - 1)
        near = np.zeros(lower.shape, dtype=bool)
        np.put_along_axis(near, order, np.arange(len(at)) <= last[:, None], axis=1)
        return lower, near

    def lists(vec: pd.Series, pick) -> pd.Series:
        x, out = _matrix(vec, dims), []
        for i in range(0, len(x), 256):
            out += [at[k] for k in pick(i, *bounds(x[i : i + 256]))]
        return pd.Series(out, dtype=object)

    leaves = T.ArrayType(T.IntegerType())

    @F.pandas_udf(leaves)
    def first(vec: pd.Series) -> pd.Series:
        return lists(vec, lambda i, lower, near: near)

    @F.pandas_udf(leaves)
    def rest(vec: pd.Series, theta: pd.Series) -> pd.Series:
        # a hair of slack keeps rounding from pruning a true neighbour
        within = theta.to_numpy(dtype=np.float64) * (1 + 1e-9) + 1e-9
        return lists(vec, lambda i, lower, near: ~near & (lower <= within[i : i + 256, None]))

    every = F.array(*map(F.lit, at.tolist()))
    picked = {"all": lambda: every, "near": lambda: first("vec"), "rest": lambda: rest("vec", "theta")}[step]()
    return queries.withColumn("at", F.explode(picked)).select("qid", "vec", "at")


def _packed(rows: DataFrame, key: Sequence[str], ids: str, extra: Sequence[str]) -> DataFrame:
    """Rows of a group as blocks: `ids` (64 bits), `vecs` and each of `extra` as arrays in bytes."""
    names = ["ids", "vecs", *extra]
    kinds = {"integer": "int", "long": "bigint"}
    schema = ", ".join([f"{x} {kinds[rows.schema[x].dataType.typeName()]}" for x in key] + [f"{x} binary" for x in names])

    def run(at: tuple, d: pd.DataFrame) -> pd.DataFrame:
        cells = [d[ids].to_numpy(np.int64), np.stack(d["vec"].to_numpy()).astype(np.float64)]
        cells += [d[x].to_numpy(np.float64) for x in extra]
        return pd.DataFrame([[*at, *[x.tobytes() for x in cells]]], columns=[*key, *names])

    return rows.select(*key, ids, "vec", *extra).groupBy(*key).applyInPandas(run, schema)


def _best(i: np.ndarray, dist: np.ndarray, rid: np.ndarray, w: np.ndarray, keep: int):
    """The rows of least (dist, rid) of each query i, `keep` at most."""
    order = np.lexsort((rid, dist, i))
    i = i[order]
    start = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    place = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
    few = place < keep
    order = order[few]
    return i[few], dist[order], rid[order], w[order]


def _nearest_in_block(k: int, dims: int, exclude_self: bool):
    """k nearest of each query of a group among the blocks it visits: exact distances, ties by id.

    A query starts from the distance it already knows (`theta`), or finds one in its home leaf, and
    passes a block whose box is farther away than its k-th neighbour so far."""
    keep = k + 1  # own vector may be among them

    def run(key: tuple, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        columns = ["q", "r", "dist", "w"]
        if not len(q) or not len(r):
            return pd.DataFrame({x: [] for x in columns})
        part = lambda d, x, kind: np.frombuffer(b"".join(d[x]), kind)
        qid, a = part(q, "ids", np.int64), part(q, "vecs", np.float64).reshape(-1, dims)
        home, limit = part(q, "home", np.float64), part(q, "theta", np.float64).copy()
        blocks = []
        for at, ids, vecs, w in zip(r["at"], r["ids"], r["vecs"], r["w"]):
            b = np.frombuffer(vecs, np.float64).reshape(-1, dims)
            blocks.append((at, np.frombuffer(ids, np.int64), b, np.frombuffer(w, np.float64)))
        na = (a * a).sum(axis=1)
        left = np.hstack([a, np.ones((len(a), 1))])
        best = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)]
        found, waiting = [], 0

        def settle() -> None:
            nonlocal best, found, waiting
            best = list(_best(*[np.concatenate([x, *y]) for x, y in zip(best, zip(*found))], keep)) if found else best
            found, waiting = [], 0
            count = np.bincount(best[0], minlength=len(a))
            end = np.cumsum(count) - 1
            full = count >= keep
            limit[full] = np.minimum(limit[full], best[1][end[full]])

        def visit(rows: np.ndarray, rid, b, w) -> None:
            nonlocal waiting
            nb = (b * b).sum(axis=1)
            right = np.vstack([-2.0 * b.T, nb])
            for start in range(0, len(rows), 512):
                at = rows[start : start + 512]
                rough = left[at] @ right + na[at, None]
                cut = limit[at] ** 2
                if len(b) > keep and not np.isfinite(cut).all():
                    cut = np.minimum(cut, np.partition(rough, keep - 1, axis=1)[:, keep - 1])
                i, j = np.nonzero(rough <= (cut + 1e-9 * (na[at] + nb.max()) + 1e-12)[:, None])
                dist = np.sqrt(((b[j] - a[at[i]]) ** 2).sum(axis=1))
                found.append(_best(at[i], dist, rid[j], w[j], keep) if len(i) else (at[i], dist, rid[j], w[j]))
                waiting += len(found[-1][0])
            if waiting > 500_000:
                settle()

        fresh = ~np.isfinite(limit)
        if fresh.any():
            for at, rid, b, w in blocks:
                rows = np.flatnonzero(fresh & (home == at))
                if len(rows):
                    visit(rows, rid, b, w)
            settle()
        for at, rid, b, w in blocks:
            outside = np.maximum(np.maximum(b.min(axis=0) - a, a - b.max(axis=0)), 0.0)
            # a hair of slack keeps rounding from passing a true neighbour
            todo = np.sqrt((outside**2).sum(axis=1)) <= limit * (1 + 1e-9) + 1e-9
            rows = np.flatnonzero(todo & ~(fresh & (home == at)))
            if len(rows):
                visit(rows, rid, b, w)
        settle()
        i, dist, rid, w = best
        w = w.astype(np.int64)
        if exclude_self:
            w = w - (rid == qid[i])
        return pd.DataFrame({"q": qid[i], "r": rid, "dist": dist, "w": w})[w > 0]

    return run


def _grouped(queries: DataFrame, tree: Tree) -> DataFrame:
    """q, vec, home, grp: queries of neighbouring leaves in groups of about GROUP_ROWS."""
    dims = tree.centers.shape[1]

    @F.pandas_udf(T.IntegerType())
    def leaf(vec: pd.Series) -> pd.Series:
        return pd.Series(tree.leaf(_matrix(vec, dims)), dtype="int32")

    d = queries.withColumn("home", leaf("vec"))
    sizes = d.groupBy("home").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("home", ignore_index=True)
    grp, parts, used, free = [], [], 0, 0  # at most MAX_LEAVES rows
    for n in sizes["n"]:
        cut = max(1, -(-int(n) // GROUP_ROWS))
        if used and (cut > 1 or used + n > GROUP_ROWS):
            free, used = free + 1, 0
        grp.append(free)
        parts.append(cut)
        free, used = (free + cut, 0) if cut > 1 else (free, used + int(n))
    table = pd.DataFrame({"home": sizes["home"], "_first": grp, "_cut": parts})
    table = F.broadcast(d.sparkSession.createDataFrame(table, "home int, _first int, _cut int"))
    spread = F.pmod(F.xxhash64("q"), F.col("_cut")).cast("int")
    return d.join(table, "home").select("q", "vec", "home", (F.col("_first") + spread).alias("grp"))


def _search(queries: DataFrame, pairs: DataFrame, blocks: DataFrame, k: int, dims: int, exclude_self: bool) -> DataFrame:
    """q, r, dist, w: candidates among the leaves `pairs` (grp, at) names for a group of queries
    (q, vec, home, grp, theta). Leaves of a group are dealt to units of UNIT_BLOCKS blocks."""
    wide = F.pmod(F.hash("at", "chunk"), F.greatest(F.lit(1), F.ceil(F.col("_n") / UNIT_BLOCKS))).cast("int")
    right = pairs.join(blocks, "at")
    count = pairs.join(blocks.select("at", "chunk"), "at").groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    right = right.join(count, "grp").withColumn("unit", wide)
    units = pairs.join(blocks.select("at", "chunk"), "at").join(count, "grp").select("grp", wide.alias("unit")).distinct()
    left = _packed(queries, ["grp"], "q", ["home", "theta"]).join(units, "grp")
    return (
        left.groupBy("grp", "unit")
        .cogroup(right.select("grp", "unit", "at", "ids", "vecs", "w").groupBy("grp", "unit"))
        .applyInPandas(_nearest_in_block(k, dims, exclude_self), "q bigint, r bigint, dist double, w bigint")
    )


def _with_counts(found: DataFrame) -> DataFrame:
    # at most k+1 rows per unit and query
    w = W.partitionBy("q").orderBy("dist", "r").rowsBetween(W.unboundedPreceding, 0)
    return found.withColumn("_cum", F.sum("w").over(w))


def knn(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool = False) -> DataFrame:
    """qid, rid, dist, take, before: the k nearest reference rows of each query, copies counted in
    `take`, and how many come before.

    queries: qid, vec. reference: rid, vec, w (see distinct_vectors). Ids are 64-bit numbers (see
    numbered); others are numbered here, in their order. With exclude_self one copy of the query's
    own vector (qid = rid) is left out.
    """
    if dict(reference.dtypes)["rid"] != "bigint":
        return _knn_by_name(queries, reference, k, exclude_self)
    total = reference.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    zero = F.lit(0).cast("bigint")
    if not total:
        return queries.select("qid", F.col("qid").alias("rid"), F.lit(0.0).alias("dist"), zero.alias("take"), zero.alias("before")).limit(0)
    tree = _tree(reference, total)
    planted, stats = _planted(reference, tree)
    dims = tree.centers.shape[1]
    need = k + (1 if exclude_self else 0)
    per = planted.join(F.broadcast(_chunks(planted.sparkSession, stats)), "at")
    per = per.withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("_parts")).cast("int"))
    blocks = _packed(per, ["at", "chunk"], "rid", ["w"]).checkpoint()
    grouped = _grouped(queries.select(F.col("qid").alias("q"), "vec"), tree).checkpoint()
    start = grouped.withColumn("theta", F.lit(float("inf")))
    step = "all" if len(stats) < TWO_STEP_LEAVES else "near"
    pairs = _pairs(grouped, tree, stats, need, step)
    found = _search(start, pairs, blocks, k, dims, exclude_self).checkpoint()
    if step == "near":
        # without k neighbours in the near leaves (a tiny reference) nothing may be pruned
        kth = F.min(F.when(F.col("_cum") >= k, F.col("dist")))
        theta = _with_counts(found).groupBy("q").agg(kth.alias("theta"))
        known = grouped.join(theta, "q", "left").withColumn("theta", F.coalesce("theta", F.lit(float("inf")))).checkpoint()
        rest = _pairs(known, tree, stats, need, "rest").join(pairs, ["grp", "at"], "left_anti").checkpoint()
        found = found.unionByName(_search(known, rest, blocks, k, dims, exclude_self))
    before = F.col("_cum") - F.col("w")
    d = _with_counts(found).withColumn("before", before).filter(F.col("before") < k)
    take = F.least(F.col("w"), F.lit(k) - F.col("before"))
    return d.select(F.col("q").alias("qid"), F.col("r").alias("rid"), "dist", take.alias("take"), "before")


def _pairs(grouped: DataFrame, tree: Tree, stats: pd.DataFrame, need: int, step: str) -> DataFrame:
    """grp, at: the leaves that any query of a group visits."""
    keep = [x for x in ("theta",) if x in grouped.columns]
    visits = _visits(grouped.select(F.col("grp").alias("qid"), "vec", *keep), tree, stats, need, step)
    pairs = visits.select(F.col("qid").alias("grp"), "at").distinct()
    if step == "near":  # a query's first distances come from its home leaf
        pairs = pairs.unionByName(grouped.select("grp", F.col("home").alias("at"))).distinct()
    return pairs.checkpoint()


def _chunks(spark, stats: pd.DataFrame) -> DataFrame:
    parts = np.maximum(1, -(-stats["n"] // BLOCK_ROWS)).astype(int)
    return spark.createDataFrame(pd.DataFrame({"at": stats["at"], "_parts": parts}), "at int, _parts int")


def numbered(rows: DataFrame, ids: str, number: str) -> DataFrame:
    """Adds `number` from 0 in the order of a column of distinct ids, written down once."""
    return with_rank(rows, [ids], number).withColumn(number, F.col(number) - 1)


def _knn_by_name(queries: DataFrame, reference: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    ids = queries.select(F.col("qid").alias("id")).union(reference.select("rid")).distinct()
    ids = numbered(ids, "id", "_i").checkpoint()
    q = queries.join(ids.withColumnRenamed("id", "qid"), "qid").select(F.col("_i").alias("qid"), "vec")
    r = reference.join(ids.withColumnRenamed("id", "rid"), "rid").select(F.col("_i").alias("rid"), "vec", "w")
    d = knn(q.checkpoint(), r.checkpoint(), k, exclude_self)
    for x in ("qid", "rid"):
        d = d.join(ids.select("id", F.col("_i").alias(x)), x).drop(x).withColumnRenamed("id", x)
    return d.select("qid", "rid", "dist", "take", "before")
