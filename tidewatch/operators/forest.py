"""A random forest over many rows, one pass over the binned rows for each level of all trees.

The same forest as Spark ML's: bootstrap counts, Gini, a random subset of the features at each node, at
most 128 bins, leaves of like prediction merged. There every row adds to statistics of all open nodes
of all trees, hundreds of MB that no cache holds; here a task counts one tree at a time. Rows are binned once,
a byte for a feature, and written down in chunks. In a pass every part counts, for each tree, the rows of
both classes by open node, feature and bin; the counts of a tree meet in one task, which chooses the splits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 128
SAMPLE_ROWS = BINS * BINS  # the candidate splits come from about so many rows
CHUNK_ROWS = 1 << 16
SPLITS = "tree int, node int, feature int, cut int, gain double, l0 double, l1 double, r0 double, r1 double"


@dataclass
class Forest:
    """Trees in heap order: the children of node i are 2i and 2i + 1, the root is 1. A feature below 0
    is a leaf; x <= cut goes left; `beacon` is the share of the second class in the node."""

    features: tuple[str, ...]
    feature: np.ndarray  # trees x nodes
    cut: np.ndarray
    beacon: np.ndarray
    importances: np.ndarray

    def table(self, spark) -> DataFrame:
        """One row, as it is saved."""
        row = (list(self.features), *[x.ravel().tolist() for x in (self.feature, self.cut, self.beacon)], self.importances.tolist(), len(self.feature))
        return spark.createDataFrame(
            [row], "features array<string>, feature array<int>, cut array<double>, beacon array<double>, importances array<double>, trees int"
        )

    @classmethod
    def from_table(cls, table: DataFrame) -> Forest:
        r = table.first()
        shaped = (np.array(r[x]).reshape(r["trees"], -1) for x in ("feature", "cut", "beacon"))
        return cls(tuple(r["features"]), *shaped, np.array(r["importances"]))


def vector(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])


def beacon_score(forest: Forest) -> Column:
    """The mean share of the second class in the leaves of a row."""
    trees = list(zip(forest.feature, forest.cut, forest.beacon))
    dims, depth = len(forest.features), forest.feature.shape[1].bit_length() - 2

    @F.pandas_udf(T.DoubleType())
    def score(vec: pd.Series) -> pd.Series:
        x = np.stack(vec.to_numpy()).astype(np.float64).ravel() if len(vec) else np.empty(0)
        total, rows = np.zeros(len(vec)), np.arange(len(vec)) * dims
        for feature, cut, beacon in trees:
            at = np.ones(len(vec), np.int64)
            for _ in range(depth):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + (x[rows + np.maximum(f, 0)] > cut[at]), at)
            total += beacon[at]
        return pd.Series(total / len(trees))

    return score(vector(forest.features))


def _candidates(sample: np.ndarray) -> list[np.ndarray]:
    """For each feature at most BINS - 1 cuts, between neighbouring values and evenly by rows."""
    out = []
    for x in sample.T:
        values, counts = np.unique(x, return_counts=True)
        cuts, before = (values[:-1] + values[1:]) / 2, np.cumsum(counts)[:-1]
        if len(cuts) >= BINS:
            wanted = len(x) * np.arange(1, BINS) / BINS
            cuts = cuts[np.unique(np.minimum(np.searchsorted(before, wanted), len(cuts) - 1))]
        out.append(cuts)
    return out


def _binned(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Chunks of rows: their number, x (a byte for each feature of each row) and y (a byte for each row)."""
    dims, most = len(cuts), CHUNK_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            x, y = (np.concatenate(z) for z in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["n", "x", "y"])

        for b in batches:
            v = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            x = np.empty(v.shape, np.uint8)
            for f, c in enumerate(cuts):
                x[:, f] = np.searchsorted(c, v[:, f])
            held.append((x, b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)))
            n += len(v)
            if n >= most:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()

    chunks = rows.mapInArrow(run, "n int, x binary, y binary")
    return chunks.withColumn("id", F.monotonically_increasing_id())


def _counts(seed: int, depth: int, dims: int, feature: np.ndarray, cut: np.ndarray, local: np.ndarray, subsets: list[np.ndarray]):
    """A part's counts of each tree: feature of the subset x open node x class x bin."""
    # Poisson(1) by the share of 2^16 equally likely numbers
    law, p = np.zeros(1 << 16, np.uint8), np.exp(-1.0)
    for k, share in enumerate(np.cumsum([p / np.prod(np.arange(1, k + 1), dtype=float) for k in range(9)])):
        law[int(round(share * (1 << 16))) :] = k + 1
    bins = BINS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = []
        for b in batches:
            for key, x, y in zip(b.column("id").to_pylist(), b.column("x").to_pylist(), b.column("y").to_pylist()):
                chunks.append((key, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8).astype(np.int64) * bins))
        if not chunks:
            return
        for tree, subset in enumerate(subsets):
            if not len(subset):
                continue
            cells, size = [np.ascontiguousarray(x) for x in subset.T], len(subset) * 2 * bins
            own_feature, own_cut, own_local = feature[tree], cut[tree], local[tree]
            total = np.zeros((len(cells), size))
            for key, x, y in chunks:
                bag = law[np.random.default_rng([seed, tree, key]).integers(0, 1 << 16, len(y), dtype=np.uint16)]
                rows = np.flatnonzero(bag)
                start, node = rows * dims, np.ones(len(rows), np.int64)
                for _ in range(depth):
                    f = own_feature.take(node)
                    inner = f >= 0
                    if not inner.all():
                        rows, start, node, f = rows[inner], start[inner], node[inner], f[inner]
                    f += start
                    right = x.take(f) > own_cut.take(node)
                    node += node
                    node += right
                at = own_local.take(node)
                if (at < 0).any():
                    rows, start, at = rows[at >= 0], start[at >= 0], at[at >= 0]
                weight, place = bag.take(rows).astype(np.float64), at * (2 * bins) + y.take(rows)
                for j, cell in enumerate(cells):
                    total[j] += np.bincount(place + x.take(cell.take(at) + start), weight, size)
            kind = np.min_scalar_type(int(total.max()))  # as narrow as the counts allow
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([total.astype(kind).tobytes()], pa.binary())], names=["tree", "counts"])

    return run


def _best(subsets: list[np.ndarray], nodes: list[np.ndarray], weights: tuple[float, float], least: int):
    """The split of largest gain of every open node of a tree, those without one left out."""
    bins = BINS

    def gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a + b
        return 1.0 - np.divide(a * a + b * b, n * n, out=np.ones_like(n), where=n > 0)

    def run(table: pa.Table) -> pa.Table:
        tree = table["tree"][0].as_py()
        subset = subsets[tree]
        counts = np.zeros(subset.size * 2 * bins)
        for x in table["counts"]:
            counts += np.frombuffer(x.as_buffer(), f"u{len(x.as_buffer()) // len(counts)}")
        left = counts.reshape(*subset.T.shape, 2, bins).swapaxes(0, 1).cumsum(axis=3)
        total, left = left[..., -1:], left[..., :-1]
        l0, l1 = left[:, :, 0], left[:, :, 1]
        r0, r1 = total[:, :, 0] - l0, total[:, :, 1] - l1
        w0, w1 = weights
        n, nl = total[:, :, 0] * w0 + total[:, :, 1] * w1, l0 * w0 + l1 * w1
        share = np.divide(nl, n, out=np.zeros_like(nl), where=n > 0)
        gain = gini(total[:, :, 0] * w0, total[:, :, 1] * w1) - share * gini(l0 * w0, l1 * w1) - (1 - share) * gini(r0 * w0, r1 * w1)
        gain = np.where((l0 + l1 >= least) & (r0 + r1 >= least), gain, -1.0).reshape(len(subset), -1)
        at = gain.argmax(axis=1)
        i = np.arange(len(subset))
        j, cut = np.divmod(at, bins - 1)
        out = {"tree": np.full(len(i), tree, np.int32), "node": nodes[tree].astype(np.int32), "feature": subset[i, j].astype(np.int32), "cut": cut.astype(np.int32), "gain": gain[i, at]}
        out |= {k: v[i, j, cut] for k, v in {"l0": l0, "l1": l1, "r0": r0, "r1": r1}.items()}
        return pa.table(out).filter(pa.array(out["gain"] > 0))

    return run


def fit_forest(rows: DataFrame, features: Sequence[str], label: str, total: int, weights: tuple[float, float], trees: int, max_depth: int, min_leaf: int, seed: int) -> Forest:
    """`rows` have a label of 0 or 1; `weights` are those of both classes. The rows are read twice, their
    binned form once for each level."""
    dims, spark = len(features), rows.sparkSession
    d = rows.select(vector(features).alias("v"), F.col(label).cast("int").alias("y"))
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = (d if share == 1.0 else d.sample(False, share, seed)).select("v").toPandas()["v"]
    cuts = _candidates(np.stack(sample.to_numpy()) if len(sample) else np.zeros((1, dims)))
    chunks = _binned(d, cuts).checkpoint()
    wide, most = int(np.ceil(np.sqrt(dims))), 1 << (max_depth + 1)
    feature, cut = np.full((trees, most), -1, np.int64), np.zeros((trees, most), np.int64)
    count, gain = np.zeros((trees, most, 2)), np.zeros((trees, most))
    rng = np.random.default_rng(seed)
    is_open = np.zeros((trees, most), bool)
    is_open[:, 1] = True
    for depth in range(max_depth):
        nodes = [np.flatnonzero(x) for x in is_open]
        if not sum(map(len, nodes)):
            break
        subsets = [rng.random((len(x), dims)).argsort(axis=1)[:, :wide] for x in nodes]
        local = np.full((trees, most), -1, np.int64)
        for t, x in enumerate(nodes):
            local[t, x] = np.arange(len(x))
        found = chunks.mapInArrow(_counts(seed, depth, dims, feature, cut, local, subsets), "tree int, counts binary")
        found = found.repartition(max(2, spark.sparkContext.defaultParallelism), "tree")
        s = found.groupBy("tree").applyInArrow(_best(subsets, nodes, weights, min_leaf), SPLITS).toPandas()  # a row for each open node
        t, i = s["tree"].to_numpy(), s["node"].to_numpy()
        feature[t, i], cut[t, i], gain[t, i] = s["feature"], s["cut"], s["gain"]
        is_open[:] = False
        for side, names in ((0, ["l0", "l1"]), (1, ["r0", "r1"])):
            n = s[names].to_numpy()
            count[t, 2 * i + side] = n * weights
            is_open[t, 2 * i + side] = (n > 0).all(axis=1)
        root = i == 1
        count[t[root], 1] = s.loc[root, ["l0", "l1"]].to_numpy() * weights + s.loc[root, ["r0", "r1"]].to_numpy() * weights
    return _finished(tuple(features), feature, cut, count, gain, cuts, weights, rows, label)


def _finished(features: tuple, feature: np.ndarray, cut: np.ndarray, count: np.ndarray, gain: np.ndarray, cuts: list[np.ndarray], weights: tuple, rows: DataFrame, label: str) -> Forest:
    """Merges leaves of the same prediction, and puts values in the place of bins."""
    trees, most = feature.shape
    whole = count[:, 1].sum(axis=1) == 0  # a root that was not split has the classes of all rows
    if whole.any():
        n = rows.agg(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).first()
        count[whole, 1] = np.array(n) * weights
    says = count[..., 1] > count[..., 0]
    for i in range(most // 2 - 1, 0, -1):
        left, right = 2 * i, 2 * i + 1
        leaves = (feature[:, i] >= 0) & (feature[:, left] < 0) & (feature[:, right] < 0) & (says[:, left] == says[:, right])
        feature[leaves, i] = -1
    # nodes below a merged one are not reached
    importances = np.zeros(len(features))
    for t in range(trees):
        own, todo = np.zeros(len(features)), [1]
        while todo:
            i = todo.pop()
            if feature[t, i] >= 0:
                own[feature[t, i]] += gain[t, i] * count[t, i].sum()
                todo += [2 * i, 2 * i + 1]
        importances += own / own.sum() if own.sum() else own
    importances = importances / importances.sum() if importances.sum() else importances
    at = np.zeros(feature.shape)
    for f, c in enumerate(cuts):
        if len(c):
            at = np.where(feature == f, c[np.minimum(cut, len(c) - 1)], at)
    total = count.sum(axis=2)
    beacon = np.divide(count[..., 1], total, out=np.zeros_like(total), where=total > 0)
    return Forest(features, feature, at, beacon, importances)
