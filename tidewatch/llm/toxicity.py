"""Toxicity by class-conditional Kneser-Ney models of letters inside words.

Two models of order 5 are counted, one over toxic and one over ordinary documents. The highest order
is counted for each class; below it both back off to one set of continuation counts, so an expression
too rare to judge gets the same probability from both. A document is judged by length-normalised
ratios of log-likelihoods: that of all its words by their letters, that of its most toxic word by
the letters of that word, and what its suspicious words have beyond a margin by the words of the
document. A logistic curve, fitted on rows that were not counted, turns them into a probability.

The counts, the probabilities and the scores of the words are tables that Spark joins; none is held
by the driver or a task. Only the commonest grams and words, a fixed number at most, are also handed to
the tasks, so that fewer rows are moved: their values are those of the tables.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.files import stored

#: a letter with the letters, digits and signs around it that disguised spellings are made of
WORD = re.compile(r"[\d_@$*#]*[^\W\d_][\w@$*#]*(?:!+[\w@$*#]+)*")
ORDER = 5
SYMBOL = 12  # bits of a symbol
#: a character below PLAIN is one symbol, any other two, of ranges of their own
PLAIN = 0x780
PRIOR_LETTERS, PRIOR_WORDS, PRIOR_TEXT = 5.0, 20.0, 50.0  # added to lengths: very short ones need more evidence
MARGIN = 1.5  # ratio of a single word that is taken for chance
STEPS = 100  # of 1 in a ratio when the curve is fitted
REMEMBER = 200_000  # different words a task holds before it hands on what it has counted
GRID = 1 << 24  # of 1 in a ratio: whole numbers have the same sum in any order
COMMON_GRAMS, COMMON_WORDS = 1 << 19, 1 << 18  # looked up in tasks, all others by joins
LONG = 32  # letters of a word that is named by its digest


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every symbol and word end: its context (up to four symbols, not beyond the word's
    beginning), context and symbol together, and the number of its word."""
    text = "".join("\0" + w for w in words) + "\0"
    flat = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = flat >= PLAIN
    if wide.any():  # the upper bits, then the lower ten
        at = np.cumsum(1 + wide) - 1 - wide
        out = np.empty(len(flat) + int(wide.sum()), np.int64)
        out[at] = np.where(wide, PLAIN + (flat >> 10), flat)
        out[at[wide] + 1] = PLAIN + 0x441 + (flat[wide] & 0x3FF)
        flat = out
    edge = flat == 0
    n = len(flat)
    if n < 2:
        none = np.empty(0, np.int64)
        return none, none, none
    begin = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    t = np.arange(1, n)
    k = np.minimum(t - begin[t - 1], ORDER - 1)
    code = np.zeros(n - 1, np.int64)
    for i in range(ORDER - 1, 0, -1):
        code = np.where(k >= i, (code << SYMBOL) | flat[np.maximum(t - i, 0)], code)
    length = k << (SYMBOL * ORDER)
    return code | length, (code << SYMBOL) | flat[t] | length, np.cumsum(edge)[t - 1] - 1


def context_of(gram: np.ndarray) -> np.ndarray:
    length = gram >> (SYMBOL * ORDER)
    return ((gram & ((1 << SYMBOL * ORDER) - 1)) >> SYMBOL) | (length << (SYMBOL * ORDER))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def shared_backoff(gram: np.ndarray) -> np.ndarray:
    """Probability of every gram's symbol after its context without the first symbol, by
    continuation counts: the number of different grams one symbol longer. `backoff_table` does the
    same for a table; this one is for grams at hand."""
    length = gram >> (SYMBOL * ORDER)
    code = gram & ((1 << SYMBOL * ORDER) - 1)
    types: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    longer = np.empty(0, np.int64)
    for m in range(ORDER, 1, -1):
        pool = np.union1d(code[length + 1 == m], longer)
        longer, n = np.unique(pool & ((1 << SYMBOL * (m - 1)) - 1), return_counts=True)
        types[m - 1] = longer, n
    seen, n = types[1]
    known = {1: (seen, n / max(n.sum(), 1))}
    for m in range(2, ORDER):
        seen, n = types[m]
        _, at = np.unique(seen >> SYMBOL, return_inverse=True)
        total, kinds, d = np.bincount(at, n), np.bincount(at), _discount(n)
        lower, p = known[m - 1]
        p = p[np.searchsorted(lower, seen & ((1 << SYMBOL * (m - 1)) - 1))]
        known[m] = seen, (np.maximum(n - d, 0) + d * kinds[at] * p) / total[at]
    out = np.zeros(len(gram))
    for m in range(1, ORDER):
        own = length == m
        seen, p = known[m]
        if own.any():
            out[own] = p[np.searchsorted(seen, code[own] & ((1 << SYMBOL * m) - 1))]
    return out


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 5; a null key counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "utf-8")) % 5


def count_grams(rows: DataFrame, text: str, label: str) -> DataFrame:
    """gram, ordinary, toxic: how often the rows of either label have each gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(seen[0].keys() | seen[1].keys())
            _, gram, word = grams(words)
            gram, at = np.unique(gram, return_inverse=True)
            n = [np.bincount(at, np.array([c[w] for w in words], np.float64)[word], len(gram)).astype(np.int64) for c in seen]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_pydict({"gram": gram, "ordinary": n[0], "toxic": n[1]})

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                seen[y].update(WORD.findall((t.as_py() or "").lower()))
                if len(seen[0]) + len(seen[1]) > REMEMBER:
                    yield flush()
        if seen[0] or seen[1]:
            yield flush()

    counted = rows.select(text, label).mapInArrow(run, "gram bigint, ordinary bigint, toxic bigint")
    return counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def low(code: Column, symbols: int) -> Column:
    return code.bitwiseAND(F.lit((1 << SYMBOL * symbols) - 1).cast("bigint"))


def discount(table: DataFrame, counts: list[str]) -> list[float]:
    """Of each column of counts, by how many are 1 and 2 in the whole table."""
    row = table.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in counts for k in (1, 2)]).first()
    pairs = [(row[f"{c}1"], row[f"{c}2"]) for c in counts]
    return [once / (once + 2 * twice) if once and twice else 0.5 for once, twice in pairs]


def backoff_table(table: DataFrame) -> DataFrame:
    """shorter, back: the probability of a symbol by continuation counts, for the ends of all grams;
    `shorter` has the length of a context in its upper bits, as grams do. A group has at most
    2^SYMBOL rows."""
    size = SYMBOL * ORDER
    length, code = F.shiftright("gram", size), low(F.col("gram"), ORDER)
    types: dict[int, DataFrame] = {}
    for m in range(ORDER, 1, -1):
        longer = table.filter(length == m - 1).select(code.alias("s"))
        if m in types:
            longer = longer.union(types[m].select("s")).distinct()
        types[m - 1] = stored(longer.groupBy(low(F.col("s"), m - 1).alias("s")).agg(F.count(F.lit(1)).alias("n")), "toxicity-types")
    total = types[1].agg(F.sum("n")).first()[0] or 1
    known = types[1].select("s", (F.col("n") / F.lit(total)).alias("p"))
    out = known.select((F.col("s") + F.lit(1 << size)).alias("shorter"), F.col("p").alias("back"))
    for m in range(2, ORDER):
        d = F.lit(discount(types[m], ["n"])[0])
        after = Window.partitionBy(F.shiftright("s", SYMBOL))
        rows = types[m].select("s", "n", F.sum("n").over(after).alias("total"), F.count(F.lit(1)).over(after).alias("kinds"), low(F.col("s"), m - 1).alias("e"))
        p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("p")) / F.col("total")
        known = stored(rows.join(known.withColumnRenamed("s", "e"), "e").select("s", p.alias("p")), "toxicity-backoff")
        out = out.union(known.select((F.col("s") + F.lit(m << size)).alias("shorter"), F.col("p").alias("back")))
    return out


def fit_ratio(rows: DataFrame, text: str, label: str) -> DataFrame:
    """The model of all rows, a row for each of their grams: gram, context, n, and in GRID-ths the
    log P(toxic) - log P(ordinary) of the gram (`seen`) and of those that neither class has after
    this context (`unseen`): there the shared backoff cancels, and the ratio is that of the
    classes' backoff weights."""
    size = SYMBOL * ORDER
    table = stored(count_grams(rows, text, label), "toxicity-grams")
    classes = ["ordinary", "toxic"]
    discounts = discount(table, classes)
    length, code = F.shiftright("gram", size), low(F.col("gram"), ORDER)
    top = F.col("gram") - code  # the length in its place
    # without the first symbol
    end = F.expr(f"(gram & ((1L << ({SYMBOL} * CAST(gram >> {size} AS INT))) - 1L))")
    model = table.withColumns({"context": F.shiftright(code, SYMBOL) + top, "shorter": end + top}).join(backoff_table(table), "shorter")
    after = Window.partitionBy("context")
    model = model.withColumns({f"{c}_total": F.sum(c).over(after) for c in classes} | {f"{c}_kinds": F.count_if(F.col(c) > 0).over(after) for c in classes})
    logs, weights = [], []
    for c, d in zip(classes, map(F.lit, discounts)):
        n, total = F.col(c), F.col(f"{c}_total")
        left = F.when(total > 0, d * F.col(f"{c}_kinds") / F.greatest(total, F.lit(1))).otherwise(1.0)
        held = F.greatest(n - d, F.lit(0.0)) / F.greatest(total, F.lit(1))
        logs.append(F.log(F.greatest(held + left * F.col("back"), F.lit(1e-300))))
        weights.append(F.log(F.greatest(left, F.lit(1e-12))))
    whole = lambda x: F.rint(x * GRID).cast("bigint")
    return stored(
        model.select("gram", "context", (F.col("ordinary") + F.col("toxic")).alias("n"), whole(logs[1] - logs[0]).alias("seen"), whole(weights[1] - weights[0]).alias("unseen")),
        "toxicity-model",
    )


def name_of(word: str) -> str:
    """The word, or for a long one (a whole line of Han) its digest: no word has a zero."""
    return word if len(word) <= LONG else "\0" + hashlib.sha256(word.encode()).hexdigest()


def count_words(rows: DataFrame, text: str) -> DataFrame:
    """word, n: the different words of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(WORD.findall((t.as_py() or "").lower()))
                if len(seen) > REMEMBER:
                    yield flush()
        if seen:
            yield flush()

    return rows.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def commonest(table: DataFrame, name: str, most: int) -> DataFrame:
    """About so many rows, those of the largest n: from a count on that a histogram tells, and of the
    counts just below it as many as still fit, picked by hash."""
    size = F.floor(F.log2("n") * 16)
    sizes = sorted(tuple(r) for r in table.groupBy(size.alias("size")).count().collect())  # a few hundred at most
    least, part, share = 1 << 30, -1, 0
    for at, n in reversed(sizes):
        if n > most:
            part, share = at, 10_000 * most // n
            break
        least, most = at, most - n
    return table.filter((size >= least) | ((size == part) & (F.pmod(F.xxhash64(name), F.lit(10_000)) < share)))


def rate_words(words: DataFrame, model: DataFrame) -> DataFrame:
    """name, n, total (ratio in GRID-ths) and letters (with the word's end) of a table of words."""
    common = commonest(model.select("gram", "n", "seen"), "gram", COMMON_GRAMS).select("gram", "seen").toArrow()
    held = np.column_stack([common["gram"].to_numpy(), common["seen"].to_numpy()]).astype(np.int64)
    known = words.sparkSession.sparkContext.broadcast(held[np.argsort(held[:, 0])])
    fields = ["name", "n", "total", "letters", "gram", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = known.value.T
        for b in batches:
            own = b.column(0).to_pylist()
            if not own:
                continue
            context, gram, word = grams(own)
            at = np.minimum(np.searchsorted(table, gram), max(len(table) - 1, 0))
            hit = table[at] == gram if len(table) else np.zeros(len(gram), bool)
            # whole numbers below 2^53
            total = np.bincount(word[hit], seen[at[hit]], len(own)).astype(np.int64)
            names = pa.array([name_of(w) for w in own], pa.string())
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([names, b.column(1), pa.array(total), pa.array([len(w) + 1 for w in own], pa.int64()), none, none], names=fields)
            rest = np.flatnonzero(~hit)
            for i in range(0, len(rest), 100_000):
                r = rest[i : i + 100_000]
                zero = pa.array(np.zeros(len(r), np.int64))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(word[r])), zero, zero, zero, pa.array(gram[r]), pa.array(context[r])], names=fields)

    cut = stored(words.select("word", "n").mapInArrow(run, "name string, n bigint, total bigint, letters bigint, gram bigint, context bigint"), "toxicity-words")
    sums = ["n", "total", "letters"]
    rest = cut.filter("gram IS NOT NULL").join(model.select("gram", "seen"), "gram", "left")
    # the context alone is known
    contexts = model.groupBy("context").agg(F.max("unseen").alias("unseen"))
    new = rest.filter("seen IS NULL").join(contexts, "context").select("name", "n", F.col("unseen").alias("total"), "letters")
    old = rest.filter("seen IS NOT NULL").select("name", "n", F.col("seen").alias("total"), "letters")
    rows = cut.filter("gram IS NULL").select("name", *sums).union(old).union(new)
    return stored(rows.groupBy("name").agg(*[F.sum(c).alias(c) for c in sums]), "toxicity-words")


def rate_texts(texts: DataFrame, words: DataFrame) -> DataFrame:
    """digest, and of a text's words: `whole`, the ratio of all of them by their letters, `top`, the
    highest ratio of one by its letters, and `density`, what they have beyond the margin by their
    number; all 0 without words. Copies of a text are one row."""
    rated = words.select(
        "name",
        "n",
        F.greatest(F.col("total") - F.lit(int(MARGIN * GRID)), F.lit(0)).alias("beyond"),
        "total",
        "letters",
        (F.col("total") / GRID / (F.col("letters") + PRIOR_LETTERS)).alias("top"),
    )
    sums = ["beyond", "total", "letters"]
    common = commonest(rated, "name", COMMON_WORDS).select("name", *sums, "top").toArrow()
    known = texts.sparkSession.sparkContext.broadcast(common)
    fields = ["digest", "copies", "words", *sums, "top", "name", "times"]
    kinds = [pa.binary(), *[pa.int64()] * 5, pa.float64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        place = {w: i for i, w in enumerate(table["name"].to_pylist())}
        values = np.column_stack([table[c].to_numpy() for c in sums]).astype(np.int64)
        top = table["top"].to_numpy()
        for b in batches:
            rows: list[tuple] = []
            for digest, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = WORD.findall((t.as_py() or "").lower())
                at = [place.get(w, -1) for w in own]
                found = np.array(at, np.int64)
                found = found[found >= 0]
                rows.append((digest, 1, len(own), *values[found].sum(axis=0).tolist(), float(top[found].max()) if len(found) else None, None, 0))
                if len(found) < len(own):
                    times = Counter(name_of(w) for w, i in zip(own, at) if i < 0)
                    rows += [(digest, 0, 0, 0, 0, 0, None, w, n) for w, n in times.items()]
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=fields)

    schema = "digest binary, copies bigint, words bigint, beyond bigint, total bigint, letters bigint, top double, name string, times bigint"
    cut = stored(texts.select(digest_of(F.col("text")).alias("digest"), "text").mapInArrow(run, schema), "toxicity-texts")
    rare = cut.filter("name IS NOT NULL").select("digest", "copies", "words", "name", "times").join(rated.select("name", *sums, "top"), "name")
    rare = rare.select("digest", "copies", "words", *[(F.col(c) * F.col("times")).alias(c) for c in sums], "top")
    both = cut.filter("name IS NULL").select(*rare.columns).union(rare)
    both = both.groupBy("digest").agg(*[F.sum(c).alias(c) for c in ("copies", "words", *sums)], F.max("top").alias("top"))
    # n copies have n times the sums
    whole = F.col("total") / F.col("copies") / GRID / (F.col("letters") / F.col("copies") + PRIOR_TEXT)
    density = F.col("beyond") / F.col("copies") / GRID / (F.col("words") / F.col("copies") + PRIOR_WORDS)
    return stored(both.select("digest", whole.alias("whole"), F.coalesce("top", F.lit(0.0)).alias("top"), density.alias("density")), "toxicity-ratios")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fit_curve(values: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Slopes and offset of the logistic curve of a label, with the targets smoothed so that a
    perfect split has a finite curve. Without both labels the slopes are 0."""
    pos, neg = float(weight[label == 1].sum()), float(weight[label == 0].sum())
    w = np.zeros(values.shape[1] + 1)
    w[-1] = np.log((pos + 1) / (neg + 2))  # nothing known: not toxic
    if not pos or not neg:
        return w
    y = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.append(np.maximum(values.std(axis=0), 1e-9), 1.0)
    x = np.column_stack([values, np.ones(len(values))]) / scale
    w *= scale
    ridge = np.append(np.full(values.shape[1], 1e-2), 0.0)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), gradient)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w / scale


def score_toxicity(
    docs: DataFrame,
    training: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of `docs` (all columns, or those in `keep`) with held_out, score (0 to 1) and
    predicted (1 from 0.5 on); columns of these names are replaced.

    The model is learned from the texts of `training` that have a label of 0 or 1, but for those
    whose key's crc32 is a multiple of 5 (held_out): of the rest, remainder 1 fits the curve, and the
    others are counted. Every text is scored from its words alone. A text without words has ratios
    of 0. Where a key has several labels the largest counts. With only one label, or none, every score
    is the same. Repeated rows are scored alike; columns of any other name pass through; an empty
    table gives an empty table.
    """
    own = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & (fold_of(F.col(key)) != 0))
    own = own.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label"))
    side = training.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.col("key").isNotNull() & (fold_of(F.col("key")) != 0))
    side = side.join(own.hint("shuffle_hash"), "key")
    fold = fold_of(F.col("key"))

    apart = side.filter(fold == 1)
    texts = docs.select(F.col(text).alias("text"))
    if docs is not training:
        texts = texts.union(apart.select("text"))
    found = rate_texts(texts, rate_words(count_words(texts, "text"), fit_ratio(side.filter(fold != 1), "text", "label")))
    # the curve: counts of labels by the ratios in steps
    inputs = ["whole", "top", "density"]
    rated = apart.select("label", digest_of(F.col("text")).alias("digest")).join(found, "digest")
    steps = [F.rint(F.col(c) * STEPS).alias(c) for c in inputs]
    bins = rated.groupBy(*steps, "label").agg(F.count(F.lit(1)).alias("n")).toPandas()  # few: ratios are small
    curve = fit_curve(bins[inputs].to_numpy(np.float64) / STEPS, bins["label"].to_numpy(np.int64), bins["n"].to_numpy(np.float64))

    added = ["held_out", "score", "predicted"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # the caller's columns travel in one struct, so none can clash with those made here
    rows = docs.select(F.struct(*kept).alias("row"), (fold_of(F.col(key)) == 0).alias("held_out"), digest_of(F.col(text)).alias("digest"))
    z = F.lit(float(curve[-1]))
    for c, slope in zip(inputs, curve):
        z = z + F.lit(float(slope)) * F.col(c)
    scored = rows.join(found, "digest").withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select(*[F.col("row")[c].alias(c) for c in kept], "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
