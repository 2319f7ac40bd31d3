"""Embedding near-dedup with an inverted multi-index.

Equal vectors are one class. Two codebooks, one for each half of the vectors, form a grid of cells;
every class is listed in the cell of its two nearest centroids. A query walks the cells in order of
distance (multi-sequence traversal) up to a margin beyond its own cell. The margin is fitted so that
the target recall is met by pairs that are only just similar enough; nearer ones are missed less.
A pair counts for both ends whichever of them visits the other's cell, and is compared exactly.

Visits grow faster than the vectors while there are cells to add, so they are not rows. Cells are
dealt to groups, a task takes two groups (each vector moves once for each of them), and finds there who
visits which cell.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.llm.files import stored
from tidewatch.llm.graph import components

SAMPLE = 8192  # vectors the codebooks and the margin are fitted on, for all sizes
MAX_CENTROIDS = 256
CELL_VECTORS = 8  # wanted in a cell on average, while there are centroids to add
BLOCK = 2048  # vectors of a cell that stay together
# A vector is sent to as many tasks as there are groups: GROUPS, or more where one of them would hold
# more than GROUP_BYTES of vectors; fewer where a group would have less than GROUP_ROWS.
GROUPS, GROUP_ROWS, GROUP_BYTES = 8, 1024, 1 << 25
CHUNK = 1 << 14  # vectors whose distances to all centroids a task holds at a time
PAIRS = 1 << 22  # cosines, and links, that a task holds at a time


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _squares(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ c.T + (c * c).sum(1), 0)


def _centroids(a: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = a[rng.permutation(len(a))[:k]].copy()
    for _ in range(10):
        at = _squares(a, c).argmin(1)
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, a)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class Index:
    """Codebooks of the two halves, and the margin of the walk."""

    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float):
        self.books, self.margin = (first, second), margin

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, threshold: float, recall: float) -> Index:
        """From unit vectors of a sample of `total`."""
        rng = np.random.default_rng(7)
        half = sample.shape[1] // 2
        k = int(min(MAX_CENTROIDS, len(sample), max(1, np.sqrt(total / CELL_VECTORS))))
        index = cls(*(_centroids(x, k if x.shape[1] else 1, rng) for x in (sample[:, :half], sample[:, half:])), 0.0)
        # partners at the threshold, in random directions, and the linked pairs of the sample itself
        away = rng.normal(size=sample.shape)
        away -= (away * sample).sum(1)[:, None] * sample
        norm = np.sqrt((away * away).sum(1))[:, None]
        partner = threshold * sample + np.sqrt(max(1 - threshold**2, 0)) * np.divide(away, norm, out=np.zeros_like(away), where=norm > 0)
        need = np.quantile(index._beyond(sample, partner), recall)
        for i in range(0, len(sample), 1024):
            a, b = np.nonzero(sample[i : i + 1024] @ sample.T >= threshold)
            if len(a):
                need = max(need, float(index._beyond(sample[a + i], sample[b]).max()))
        index.margin = float(need) + 1e-9
        return index

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.books[0].shape[1]
        return _squares(v[:, :half], self.books[0]), _squares(v[:, half:], self.books[1])

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self.distances(v)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def _beyond(self, query: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How much farther than its own cell each query finds the cell of another vector."""
        a, b = self.distances(query)
        i, j = np.divmod(self.cells(other), len(self.books[1]))
        rows = np.arange(len(query))
        return a[rows, i] + b[rows, j] - a.min(1) - b.min(1)

    def sees(self, v: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether each vector (row) walks to each cell (column)."""
        a, b = self.distances(v)
        i, j = np.divmod(cells, len(self.books[1]))
        return a[:, i] + b[:, j] <= (a.min(1) + b.min(1) + self.margin)[:, None]

    def walk(self, v: np.ndarray) -> list[np.ndarray]:
        """Cells of each vector in rising distance, by multi-sequence traversal up to the margin."""
        out = []
        for a, b in zip(*self.distances(v)):
            oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            sa, sb, ia, ib = a[oa].tolist(), b[ob].tolist(), oa.tolist(), ob.tolist()
            end = sa[0] + sb[0] + self.margin
            heap, seen, cells = [(sa[0] + sb[0], 0, 0)], {(0, 0)}, []
            while heap:
                d, i, j = heapq.heappop(heap)
                # the sum is made as in `sees`, so that both agree to the last bit
                if a[ia[i]] + b[ib[j]] > end:
                    break
                cells.append(ia[i] * len(self.books[1]) + ib[j])
                for x, y in ((i + 1, j), (i, j + 1)):
                    if x < len(sa) and y < len(sb) and (x, y) not in seen:
                        seen.add((x, y))
                        heapq.heappush(heap, (sa[x] + sb[y], x, y))
            out.append(np.array(cells, np.int64))
        return out


def _fit(classes: DataFrame, threshold: float, recall: float) -> dict[int, Index]:
    """An index for each length of vector in a sample of SAMPLE rows, picked by hash. Vectors of
    another length share one cell, and are compared with all of their length."""
    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rep", "vec"), "rep").limit(SAMPLE).select("vec").toPandas()["vec"]
    by_length: dict[int, list] = {}
    for v in sample:
        by_length.setdefault(len(v), []).append(v)
    return {n: Index.fit(unit(np.array(v)), max(1, total * len(v) // max(len(sample), 1)), threshold, recall) for n, v in by_length.items()}


def _as_matrix(column: pa.Array, at: np.ndarray, n: int) -> np.ndarray:
    """The rows `at` of a column of lists, all of length n."""
    starts = column.offsets.to_numpy()[at].astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[starts[:, None] + np.arange(n)]


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number each of n points is connected with by pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class Chunk:
    """Unit vectors in the order of their cells, and what their walks need. Vectors of a length that has
    no index share cell 0."""

    def __init__(self, index: Index | None, vectors: np.ndarray, home: np.ndarray, rows: np.ndarray):
        self.index, self.vectors, self.home, self.rows = index, vectors, home, rows
        if index is not None:
            a, b = index.distances(vectors)
            self.least = b.min(1)
            self.end = a.min(1) + self.least + index.margin
            self.first, self.second = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)

    def sees(self, i: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether vector i walks to a cell, pair by pair."""
        if self.index is None:
            return np.ones(len(i), bool)
        x, y = np.divmod(cells, len(self.index.books[1]))
        return self.first[x, i] + self.second[y, i] <= self.end[i]

    def visitors(self, cells: np.ndarray) -> Iterator[np.ndarray]:
        """The vectors that walk to each of the sorted cells."""
        if self.index is None:
            yield from [np.arange(len(self.vectors))] * len(cells)
            return
        last = -1
        for x, y in zip(*(c.tolist() for c in np.divmod(cells, len(self.index.books[1])))):
            if x != last:  # who can reach any cell of this centroid
                able = np.flatnonzero(self.first[x] + self.least <= self.end)
                near, end, last = self.first[x, able], self.end[able], x
            yield able[near + self.second[y, able] <= end]

    def similar(self, other: Chunk, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) of similar vectors where i, of this chunk, walks to the cell of j of the other."""
        cells, start = np.unique(other.home, return_index=True)
        for i, lo, hi in zip(self.visitors(cells), start.tolist(), [*start[1:].tolist(), len(other.home)]):
            if not len(i):
                continue
            step = max(1, PAIRS // len(i))
            q = self.vectors[i]
            for at in range(lo, hi, step):
                a, b = np.nonzero(q @ other.vectors[at : min(at + step, hi)].T >= threshold)
                if len(a):
                    yield i[a], b + at

    def links(self, other: Chunk, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each pair of similar vectors once, if either of them walks to the other's cell."""
        same = self is other
        for i, j in self.similar(other, threshold):
            first = (i < j) | (i > j) & ~self.sees(j, self.home[i]) if same else np.ones(len(i), bool)
            yield i[first], j[first]
        if not same:
            for j, i in other.similar(self, threshold):
                blind = ~self.sees(i, other.home[j])
                yield i[blind], j[blind]


def _tile_links(index: Index | None, vectors: np.ndarray, home: np.ndarray, rows: np.ndarray, first: np.ndarray, alone: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs, as numbers of rows, between the vectors of two groups (`first` or not), or, where it
    is `alone`, among those of the first."""

    def chunks(at: np.ndarray) -> Iterator[Chunk]:
        at = at[np.argsort(home[at], kind="stable")]
        for i in range(0, len(at), CHUNK):
            x = at[i : i + CHUNK]
            yield Chunk(index, vectors[x], home[x], rows[x])

    left = list(chunks(np.flatnonzero(first)))
    others = ((x, y) for y in chunks(np.flatnonzero(~first)) for x in left)
    for x, y in ((x, y) for k, x in enumerate(left) for y in left[k:]) if alone else others:
        for i, j in x.links(y, threshold):
            yield x.rows[i], y.rows[j]


def _dealt(placed: DataFrame, groups: int) -> DataFrame:
    """Every row once for each group: in the task (g, h) all of group g, `first`, meet all of group h."""
    # a cell stays whole up to BLOCK vectors; one row for each larger cell, so at most one for BLOCK vectors
    hot = placed.groupBy("dim", "home").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > BLOCK)
    hot = F.broadcast(hot.select("dim", "home", F.ceil(F.col("m") / BLOCK).cast("int").alias("cut")))
    part = F.pmod(F.xxhash64("rep"), F.coalesce("cut", F.lit(1)))
    d = placed.join(hot, ["dim", "home"], "left")
    d = d.withColumn("_own", F.pmod(F.xxhash64("dim", "home", part), F.lit(groups)).cast("int"))
    d = d.withColumn("_met", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    place = [F.least("_own", "_met").alias("g"), F.greatest("_own", "_met").alias("h"), (F.col("_own") <= F.col("_met")).alias("first")]
    return d.select(*place, *placed.columns)


def similar_vectors(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.95
) -> DataFrame:
    """key, n_links (other rows linked directly), component_id (smallest key reachable, itself
    included) and kept (key = component_id) of every row.

    Rows link when the cosine of their vectors, in double precision, is at least `threshold`. Null
    vectors, those with null or non-finite parts, without parts or of length zero link with nothing,
    and vectors of different lengths do not link. Equal vectors link with each other and have the
    same links; rows that repeat a key count each. A row with a null key has a null component.
    """
    spark = rows.sparkSession
    parts = F.col("_v")
    sound = parts.isNotNull() & (F.size(parts) > 0) & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    typed = rows.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    typed = typed.withColumn("_ok", F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(parts, lambda x: x != 0), F.lit(False)))
    valid = typed.filter("_ok")
    classes = stored(valid.groupBy(F.col("_v").alias("vec")).agg(F.min("_key").alias("rep"), F.count(F.lit(1)).alias("w")).filter(F.col("rep").isNotNull()), "vector-classes")
    known = spark.sparkContext.broadcast(_fit(classes, threshold, recall))  # a few centroids

    kind, key_type = rows.schema[key].dataType.simpleString(), to_arrow_type(rows.schema[key].dataType)
    # vectors move in the type they came in, which holds them exactly
    single = rows.schema[vector].dataType.simpleString() == "array<float>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, moved = known.value, np.float32 if single else np.float64
        for b in batches:
            vecs = b.column(0)
            dims = np.diff(vecs.offsets.to_numpy()).astype(np.int32)
            home, code = np.zeros(len(dims), np.int64), [b""] * len(dims)
            for n in np.unique(dims).tolist():
                at = np.flatnonzero(dims == n)
                v = _as_matrix(vecs, at, n)
                if n in index:
                    home[at] = index[n].cells(unit(v))
                for i, x in zip(at.tolist(), v.astype(moved)):
                    code[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(dims), pa.array(home), pa.array(code, pa.binary())], names=["rep", "w", "dim", "home", "code"]
            )

    placed = stored(classes.mapInArrow(place, f"rep {kind}, w bigint, dim int, home bigint, code binary"), "vector-cells")
    size = placed.agg(F.count(F.lit(1)).alias("n"), F.sum("dim").alias("parts")).first()
    groups = max(min(GROUPS, size["n"] // GROUP_ROWS), -(-8 * (size["parts"] or 0) // GROUP_BYTES), 1)
    dealt = _dealt(placed, groups)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2, min(groups * (groups + 1), 1 << 14))

    def compare(table: pa.Table) -> pa.Table:
        """(rep, links counted here, root of its component here) of the vectors with links."""
        index, moved = known.value, np.float32 if single else np.float64
        reps = table["rep"].to_pylist()
        first, w, dim, home = (table[x].to_numpy() for x in ("first", "w", "dim", "home"))
        alone = table["g"][0] == table["h"][0]
        parts = np.frombuffer(b"".join(table["code"].to_pylist()), moved)
        start = np.cumsum(dim, dtype=np.int64) - dim
        names = sorted(set(reps))
        number = {r: i for i, r in enumerate(names)}
        at = np.array([number[r] for r in reps], np.int64)
        total, linked = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        held, waiting = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
        for n in np.unique(dim).tolist():
            own = np.flatnonzero(dim == n)
            v = unit(parts[start[own, None] + np.arange(n)])
            for i, j in _tile_links(index.get(n), v, home[own], own, first[own], alone, threshold):
                a, b = at[i], at[j]
                other = a != b
                a, b = a[other], b[other]
                np.add.at(total, a, w[j[other]])
                np.add.at(total, b, w[i[other]])
                linked[a] = linked[b] = True
                held.append((a, b))
                waiting += len(a)
                if waiting > PAIRS:
                    root = _joined(len(names), *map(np.concatenate, zip(*held)))
                    held, waiting = [(np.arange(len(names)), root)], 0
        root = _joined(len(names), *map(np.concatenate, zip(*held)))
        out = np.flatnonzero(linked).tolist()
        return pa.table({"rep": pa.array([names[i] for i in out], key_type), "n": total[out], "root": pa.array([names[root[i]] for i in out], key_type)})

    # the number of parts is given, so that each is a task of its own
    found = dealt.repartition(tasks, "g", "h").groupBy("g", "h").applyInArrow(compare, f"rep {kind}, n bigint, root {kind}")
    found = stored(found, "vector-links")
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = (
        classes.join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    out = typed.join(per_class, F.when(F.col("_ok"), F.col("_v")) == F.col("vec"), "left")
    out = out.select(F.col("_key").alias(key), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("c", "_key").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
