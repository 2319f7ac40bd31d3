"""Benchmark passages in documents, found by one Aho-Corasick automaton.

Texts are normalised to lower-case words with one space around each. The automaton holds every
window of consecutive benchmark words (a short item is one window) and reads each document once.
Matches are turned into word numbers, and, where wanted, into character offsets of the original.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.files import publish, with_fields
from tidewatch.llm.text import ALNUM, word_spans

_TABLE = np.where(ALNUM == 0, 32, ALNUM).astype(np.uint8).tobytes()
HITS = "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, spans array<struct<from: bigint, to: bigint>>"


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(item: list[bytes], size: int) -> list[bytes]:
    """The windows of an item; one of fewer words is a window itself, one of none has none."""
    return [b" ".join(item[i : i + size]) for i in range(max(1, len(item) - size + 1))] if item else []


class Passages:
    """An automaton over the windows of all items."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        owners: dict[bytes, set[str]] = {}
        for name, text in items:
            for w in windows(words(text), size):
                owners.setdefault(w, set()).add(name)
        # bytes are held as Latin-1 characters, one for one
        self.automaton = ahocorasick.Automaton()
        for w, names in owners.items():
            key = f" {w.decode('latin-1')} "
            self.automaton.add_word(key, (len(key), w.count(b" ") + 1, tuple(sorted(names))))
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, the numbers of those inside a match, and the items matched."""
        w = words(text)
        if not w or not len(self.automaton):
            return len(w), np.empty(0, np.int64), set()
        plain = f" {b' '.join(w).decode('latin-1')} "
        found = [(end, size, n, names) for end, (size, n, names) in self.automaton.iter(plain)]
        if not found:
            return len(w), np.empty(0, np.int64), set()
        spaces = np.flatnonzero(np.frombuffer(plain.encode("latin-1"), np.uint8) == 32)
        delta, items = np.zeros(len(w) + 1, np.int64), set()
        for end, size, n, names in found:
            first = int(np.searchsorted(spaces, end - size + 1))
            delta[first] += 1
            delta[first + n] -= 1
            items.update(names)
        return len(w), np.flatnonzero(np.cumsum(delta[:-1]) > 0), items


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return list(zip(hit[np.r_[0, cut + 1]].tolist(), hit[np.r_[cut, len(hit) - 1]].tolist()))


def offsets(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Character offsets in the original text, [from, to), of the runs of hit words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    start, end, _ = word_spans(ALNUM[raw], np.array([0, len(raw)]))
    chars = np.cumsum((raw & 0xC0) != 0x80)  # characters up to and with each byte
    return [{"from": int(chars[start[a]]) - 1, "to": int(chars[end[b] - 1])} for a, b in runs(hit)]


def contaminated_words(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 13,
    max_bytes: int = 64 << 20,
    keep: list[str] | None = None,
) -> DataFrame:
    """Every document (all columns, or those in `keep`) with n_words, n_hit (words inside an occurrence of a window), n_items,
    item_ids (sorted as strings) and spans (character offsets of the hit passages in the original);
    columns of these names are replaced.

    Null and empty texts have no words. An item without words has no window; repeated items count
    once. The automaton is held by every task, so a benchmark above `max_bytes` of text is scanned
    for in several of them, one after the other, and the results are united.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    parts = int(-(-total // max_bytes)) or 1
    if parts > 64:
        raise ValueError(f"the benchmark has {total} bytes of text; more than {64 * max_bytes} are not scanned for in one call")
    picked = benchmark.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t"))
    names = []
    for p in range(parts):  # each of bounded size
        own = picked.filter(F.pmod(F.xxhash64("i"), F.lit(parts)) == p) if parts > 1 else picked
        items = sorted({(r.i or "", r.t or "") for r in own.collect()})
        names.append(publish(spark, "benchmark-items", pickle.dumps(items)))
    added = ["n_words", "n_hit", "n_items", "item_ids", "spans"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*dict.fromkeys([*kept, text]))
    schema = with_fields(docs.select(*kept).schema, HITS)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = []
        for name in names:
            with open(SparkFiles.get(name), "rb") as f:
                finders.append(Passages(pickle.load(f), size))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for t in b.column(text):
                t = t.as_py()
                n, hit, items = finders[0].scan(t)
                for f in finders[1:]:
                    _, more, others = f.scan(t)
                    hit, items = np.union1d(hit, more), items | others
                for o, v in zip(out, (n, len(hit), len(items), sorted(items), offsets(t, hit) if len(hit) else [])):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(o, k) for o, k in zip(out, types)]], names=[*kept, *added])

    return rows.mapInArrow(run, schema)


def is_contaminated(share: int = 20):
    """At least one word in `share` is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def items_sha256():
    return F.sha2(F.array_join("item_ids", ","), 256)
