"""Importance resampling towards a target distribution, by hashed word n-grams.

A task splits ASCII-lowered text with an untrained `Split` pre-tokenizer, which returns words and
their offsets. Pairs of offsets (start of a run's first word, end of its last) are the windows; the
CRC-32 of a window's words, one space between them, picks a bucket. Documents keep their sparse
bucket counts, so texts are read once; the sums of both sides give each bucket a gain, and a
document's weight is the mean gain of its windows. A hash of the key gives the Gumbel noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.files import stored, with_fields
from tidewatch.operators.ranks import with_rank

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, said by what it holds
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: characters handed to the splitter at once, and bytes up to which a word is hashed with others
CHUNK, SHORT = 1 << 16, 64
HISTOGRAM = "n_words bigint, n_features bigint, buckets array<int>, counts array<int>"


@dataclass(frozen=True)
class Resampling:
    """Runs of 1 to `order` words in `buckets` buckets; of the documents with at least `min_words`
    words, `percent` in a hundred are drawn. `seed` names the noise."""

    order: int = 2
    buckets: int = 10_000
    min_words: int = 20
    percent: int = 25
    seed: int = 7


@cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def _is_word(c: str) -> bool:
    return c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z"


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Consecutive parts of about `size` characters that cut no word."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and _is_word(text[end - 1]) and _is_word(text[end]):
            end += 1
        yield text[at:end]
        at = end


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 step of a byte; and, for 0 to SHORT bytes, what a register becomes when as many
    zero bytes follow, by each of its four bytes (the step is linear)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    shift = np.empty((SHORT + 1, 4, 256), np.uint32)
    shift[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(SHORT):
        shift[n + 1] = (shift[n] >> 8) ^ step[shift[n] & 255]
    return step, shift


def span_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of a buffer of bytes."""
    step, _ = _tables()
    size = end - start
    order = np.argsort(-size, kind="stable")
    order = order[size[order] <= SHORT]
    first, sizes = start[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")  # spans longer than j
    for j, n in enumerate(more.tolist()):
        crc[:n] = (crc[:n] >> 8) ^ step[(crc[:n] ^ data[first[:n] + j]) & 255]
    out = np.empty(len(size), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[start[i] : end[i]])
    return out


def window_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, last_of_row: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to `order` words: the number of each run's first word and the CRC-32 of its
    words with one space between. `last_of_row` is the number of the last word of the word's row;
    a run stays within it. A run's value follows from that of the run without its last word."""
    step, shift = _tables()
    own = span_crcs(data, start, end)
    size, run, first = end - start, own, np.arange(len(start))
    out = [(first, run)]
    for k in range(1, order):
        keep = first + k <= last_of_row[first]
        first, run = first[keep], run[keep]
        last = first + k
        register = ~run
        spaced = (register >> 8) ^ step[(register ^ 32) & 255]  # not yet inverted
        n = size[last]
        by = np.minimum(n, SHORT)
        moved = ~spaced  # the value of the run with a space, as a shorter word would have it
        run = own[last].copy()
        for j in range(4):
            run ^= shift[by, j, (moved >> np.uint32(8 * j)) & 255]
        for i in np.flatnonzero(n > SHORT):
            run[i] = zlib.crc32(data[start[last[i]] : end[last[i]]], int(moved[i]))
        out.append((first, run))
    return out


class _Words:
    """Words of many rows as spans of one buffer."""

    def __init__(self) -> None:
        self.data: list[bytes] = []
        self.size = 0
        self.spans: list[np.ndarray] = []
        self.count: list[int] = []

    def add(self, text: str | None) -> None:
        n = 0
        # no byte of another character is an ASCII letter
        lowered = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
        for part in chunks(lowered):
            at = [span for _, span in _splitter().pre_tokenize_str(part)]
            if not at:
                continue
            raw = part.encode("utf-8", "surrogatepass")
            spans = np.array(at, np.int64)
            if len(raw) != len(part):  # offsets count characters
                head = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
                spans = np.append(head, len(raw))[spans]
            self.spans.append(spans + self.size)
            self.data.append(raw)
            self.size += len(raw)
            n += len(at)
        self.count.append(n)

    def histograms(self, order: int, buckets: int) -> list[pa.Array]:
        """n_words, n_features, buckets and counts of every row."""
        words = np.array(self.count, np.int64)
        data = np.frombuffer(b"".join(self.data), np.uint8)
        spans = np.concatenate(self.spans) if self.spans else np.empty((0, 2), np.int64)
        row = np.repeat(np.arange(len(words)), words)
        last = np.cumsum(words)[row] - 1
        keys = [row[first] * buckets + crc % np.uint32(buckets) for first, crc in window_crcs(data, spans[:, 0], spans[:, 1], last, order)]
        key, times = np.unique(np.concatenate(keys).astype(np.int64), return_counts=True)
        at = np.searchsorted(key, np.arange(len(words) + 1) * buckets).astype(np.int32)
        features = sum(np.maximum(words - k, 0) for k in range(order))
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(v.astype(np.int32))) for v in (key % buckets, times)]
        return [pa.array(words), pa.array(features), *lists]


def bucket_counts(rows: DataFrame, text: str, order: int, buckets: int) -> DataFrame:
    """All columns but the text, n_words, n_features, and the buckets of the row's runs with how
    often each occurs. Null texts have no words."""
    kept = [c for c in rows.columns if c != text]
    schema = with_fields(rows.select(*kept).schema, HISTOGRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in schema.fields]
        for b in batches:
            first, words = 0, _Words()
            for i, t in enumerate(b.column(text)):
                words.add(t.as_py())
                if words.size > 1 << 19 or i + 1 == b.num_rows:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *words.histograms(order, buckets)], names=names)
                    first, words = i + 1, _Words()

    return rows.mapInArrow(run, schema)


def summed_buckets(counted: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: all rows of `bucket_counts` added up, in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (np.asarray(b.column(c).flatten(), np.int64) for c in ("buckets", "counts"))
            np.add.at(total, at, n)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "n"])

    parts = counted.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket,
    from tables of `summed_buckets`. Both have at most `buckets` rows, and so has what is collected."""
    both = source.select("bucket", "n", F.lit(0).cast("bigint").alias("m")).union(target.select("bucket", F.lit(0).cast("bigint"), "n"))
    found = both.groupBy("bucket").agg(F.sum("n").alias("s"), F.sum("m").alias("t"))
    held = np.zeros((buckets, 2), np.int64)
    for r in found.collect():
        held[r.bucket] = r.s, r.t
    (s, t), (all_s, all_t) = held.T.astype(float), held.sum(axis=0).astype(float)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def gumbel(key: str, seed: int) -> Column:
    """Noise of a row from the first 32 bits of the hash of its key, in thousandths, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample_documents(
    docs: DataFrame,
    target: DataFrame,
    options: Resampling = Resampling(),
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document (all columns, or those in `keep`) with n_words, n_features, weight, score and
    rank: 1, 2, 3 ... for the drawn ones in order of falling score, then of the key; else null.
    Columns of these names are replaced; any other name may occur.

    Null and empty texts have no features and weight 0. A null key hashes as an empty string and
    comes after all others on ties; rows of one key are judged each on their own. Without documents
    the result is empty; without target rows, or features in them, gains compare with a flat target.
    """
    added = ["n_words", "n_features", "weight", "score", "rank"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # the caller's columns travel in one struct, so none can clash with those made here
    packed = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in kept if c != "_"]) if "_" not in kept else F.struct(*kept)
    rows = docs.select(packed.alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    counted = stored(bucket_counts(rows, "text", options.order, options.buckets), "bucket-counts")
    wanted = bucket_counts(target.select(F.col(target_text).cast("string").alias("text")), "text", options.order, options.buckets)
    gains = bucket_gains(summed_buckets(counted, options.buckets), summed_buckets(wanted, options.buckets), options.buckets)

    held = ["row", "key", "n_words", "n_features"]
    schema = T.StructType([*counted.select(*held).schema.fields, T.StructField("weight", T.LongType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("buckets")
            total = np.append(0, np.cumsum(gains[np.asarray(lists.flatten())] * np.asarray(b.column("counts").flatten(), np.int64)))
            at = np.append(0, np.cumsum(np.asarray(lists.value_lengths())))
            n = np.asarray(b.column("n_features"))
            mean = np.where(n > 0, (total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in held], pa.array(mean, pa.int64())], names=[*held, "weight"])

    weighed = counted.mapInArrow(weigh, schema).withColumn("score", F.col("weight") + gumbel("key", options.seed))
    fit = F.col("n_words") >= options.min_words
    drawn = counted.filter(fit).count() * options.percent // 100
    ranked = with_rank(weighed.withColumn("fit", fit), [F.desc("fit"), F.desc("score"), F.asc_nulls_last("key"), "n_features", "weight"], "rank")
    rank = F.when(F.col("fit") & (F.col("rank") <= drawn), F.col("rank"))
    return ranked.select(*[F.col("row")[c].alias(c) for c in kept], "n_words", "n_features", "weight", "score", rank.alias("rank"))
