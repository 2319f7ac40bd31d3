"""Line dedup with two Bloom filters.

One filter holds the lines seen at least once, the other those seen at least twice. Every task
fills both from its own lines; filters of two tasks combine as `once = a | b` and
`twice = ta | tb | (a & b)`, which never forgets a repeat. Only lines that the second filter knows
are shuffled: they are counted exactly, and each key keeps one document. The filters have a size
fixed beforehand, so a filter too small for its lines lets more lines through to the exact count
and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.files import stored
from tidewatch.llm.text import SPACE, Hasher, byte_table, mix, utf8

_LOWER = byte_table(b"")
_SPACES = np.zeros(256, bool)
_SPACES[list(SPACE)] = True
PROBES = 4
CHUNK = 1 << 16  # bytes of a filter that travel in one row


def line_key(line: str) -> str:
    """Stripped of `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased."""
    return line.strip(SPACE.decode()).encode().lower().decode()


class Lines:
    """The lines of a batch: row, byte span of the stripped line, code points and hash."""

    def __init__(self, column: pa.Array, hasher: Hasher, min_chars: int):
        data, at = utf8(column)
        self.bytes = _LOWER[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[at] = True
        newline = np.flatnonzero(data == 10)
        # a row's lines begin at its start and after each of its newlines
        start = np.concatenate([at[:-1], newline + 1])
        row = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, newline, side="right") - 1])
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        end = np.empty_like(start)
        last = np.empty(len(row), bool)
        last[:-1], last[-1:] = row[1:] != row[:-1], True
        end[:-1] = start[1:] - 1
        end[last] = at[row[last] + 1]
        self.counts = np.bincount(row, minlength=len(at) - 1)
        solid = np.flatnonzero(~_SPACES[data])
        if not len(solid):
            solid = np.array([len(data)])
        lead = np.searchsorted(solid, start)
        trail = np.searchsorted(solid, end) - 1
        some = trail >= lead
        first = np.where(some, solid[np.minimum(lead, len(solid) - 1)], start)
        stop = np.where(some, solid[np.maximum(trail, 0)] + 1, first)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        keep = chars[stop] - chars[first] >= min_chars
        self.row, self.start, self.end = row[keep], first[keep], stop[keep]
        self.hash = hasher.spans(self.bytes, self.start, self.end)

    def key(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")

    def distinct(self) -> np.ndarray:
        """Numbers of the lines without further copies inside their row."""
        order = np.lexsort((self.hash, self.row))
        row, h = self.row[order], self.hash[order]
        again = np.zeros(len(order), bool)
        again[1:] = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
        return order[~again]


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, one column for each probe."""
    step = mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(PROBES)], axis=1)


def add(once: np.ndarray, twice: np.ndarray, h: np.ndarray, bits: int) -> None:
    """Enter hashes: what `once` has already, or what comes twice here, goes to `twice`."""
    distinct, n = np.unique(h, return_counts=True)
    at = positions(distinct, bits)
    known = once[at].all(axis=1) | (n > 1)
    once[at] = True
    twice[at[known]] = True


def suspects(docs: DataFrame, text: str, bits: int, min_chars: int) -> np.ndarray:
    """The second filter over all lines, as packed bits; 2^bits of them."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        once, twice = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                lines = Lines(b.column(0).slice(i, 256), hasher, min_chars)
                add(once, twice, lines.hash[lines.distinct()], bits)
        a, t = np.packbits(once).tobytes(), np.packbits(twice).tobytes()
        for i in range(0, len(a), CHUNK):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i // CHUNK], pa.int32()), "once": [a[i : i + CHUNK]], "twice": [t[i : i + CHUNK]]})

    def merge(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once = twice = None
        for pdf in parts:
            for a, t in zip(pdf["once"], pdf["twice"]):
                a, t = np.frombuffer(a, np.uint8), np.frombuffer(t, np.uint8)
                once, twice = (a, t) if once is None else (once | a, twice | t | (once & a))
        yield pd.DataFrame({"chunk": [key[0]], "twice": [twice.tobytes()]})

    parts = docs.select(text).mapInArrow(fill, "chunk int, once binary, twice binary")
    merged = parts.groupBy("chunk").applyInPandas(merge, "chunk int, twice binary")
    rows = sorted((r.chunk, bytes(r.twice)) for r in merged.collect())  # 2^bits / 8 bytes in all
    return np.frombuffer(b"".join(t for _, t in rows) or bytes(1 << bits >> 3), np.uint8)


def filter_bits(lines: int, max_bits: int) -> int:
    """A power of two with at least 8 bits for each line, at most `max_bits`."""
    return int(min(max_bits, max(19, np.ceil(np.log2(8 * max(lines, 1))))))


def suspected_lines(docs: DataFrame, key: str, text: str, min_chars: int, max_bits: int) -> DataFrame:
    """The lines that the second filter knows, once for each document: _key, line. The filters'
    bits follow the number of lines, up to 2^max_bits."""
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.regexp_count(text, F.lit("\n")) + 1)).first()[0] or 0
    bits = filter_bits(n, max_bits)
    known = spark.sparkContext.broadcast(suspects(docs, text, bits, min_chars))  # 2^bits / 8 bytes

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        twice = np.unpackbits(known.value).view(bool)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                lines = Lines(part.column(1), hasher, min_chars)
                at = np.flatnonzero(twice[positions(lines.hash, bits)].all(axis=1)).tolist()
                found = dict.fromkeys((int(lines.row[j]), lines.key(j)) for j in at)
                rows = pa.array([r for r, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), pa.array([k for _, k in found], pa.string())], names=["_key", "line"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(pick, f"_key {kind}, line string")


def repeated_lines(found: DataFrame, min_docs: int) -> DataFrame:
    """Exact counts of the suspects: the lines of at least `min_docs` documents, and `last`, the
    largest key among those."""
    once = found.groupBy("line", "_key").agg(F.lit(1).alias("_one"))  # rows of one key count once
    counted = once.groupBy("line").agg(F.count("_key").alias("_n"), F.max("_key").alias("last"))
    return counted.filter(F.col("_n") >= min_docs).select("line", "last")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3, max_bits: int = 28
) -> DataFrame:
    """Every row of `docs` with `kept` (its text without dropped lines), n_lines (before) and
    n_dropped; columns of these names are replaced.

    A line's key is the line stripped and lower-cased (ASCII only). Keys of at least `min_chars`
    code points in at least `min_docs` documents lose all lines except those of the largest `key`
    holding them, which keeps every copy it has. Null and empty texts are one empty line. Rows with
    one `key` count as one document and are cut alike; a row with a null key is no document and
    keeps its lines. An empty table gives an empty table. The filters take at most 2^max_bits bits
    (32 MB), whatever the input.
    """
    found = stored(suspected_lines(docs, key, text, min_chars, max_bits), "suspected-lines")
    drops = (
        found.join(repeated_lines(found, min_docs), "line").filter(F.col("_key") != F.col("last"))
        .groupBy("_key").agg(F.collect_set("line").alias("_drops"))  # lines of one document
    )

    @F.pandas_udf("kept string, n_dropped bigint")
    def cut(body: pd.Series, lines: pd.Series) -> pd.DataFrame:
        out = []
        for t, d in zip(body, lines):
            if t is None:
                out.append((None, 0))
                continue
            own, d = t.split("\n"), set(d)
            kept = [x for x in own if line_key(x) not in d]
            out.append(("\n".join(kept), len(own) - len(kept)))
        return pd.DataFrame(out, columns=["kept", "n_dropped"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.drop("kept", "n_lines", "n_dropped")
    joined = rows.join(drops.hint("shuffle_hash"), rows[key] == drops["_key"], "left").drop("_key")
    # only texts that lose a line go through Python
    joined = joined.withColumn("_cut", cut(F.when(F.col("_drops").isNotNull(), body), "_drops"))
    return joined.withColumns(
        {
            "kept": F.coalesce(F.col("_cut.kept"), body),
            "n_lines": (F.regexp_count(body, F.lit("\n")) + 1).cast("bigint"),
            "n_dropped": F.coalesce(F.col("_cut.n_dropped"), F.lit(0)).cast("bigint"),
        }
    ).drop("_cut", "_drops")
