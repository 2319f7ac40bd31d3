"""Whole-batch work on UTF-8 text with numpy: bytes of a column, words, hashes, shingles.

Everything here works on one Arrow batch inside a task. Words are found on bytes: every separator
used in this package is an ASCII character, and in UTF-8 no byte of another character is below 0x80.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)


def byte_table(separators: bytes) -> np.ndarray:
    """Byte -> byte, A-Z lower-cased, separators 0."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators)] = 0
    return t


#: `[^\x20\x09-\x0D]+` after lower-casing A-Z. NUL is an ordinary character there, so it gets a
#: byte that UTF-8 never uses.
SPACED = byte_table(SPACE)
SPACED[0] = 0xFF
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its rows; null counts as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.empty(0, dtype=np.uint8), at
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, at: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about `size` bytes: number of the first row, bytes, offsets."""
    row, n = 0, len(at) - 1
    while row < n:
        last = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, data[at[row] : at[last]], at[row : last + 1] - at[row]
        row = last


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Hasher:
    """64-bit hashes of many spans of one buffer, from running sums of powers modulo 2^64."""

    def __init__(self, seed: int = 1):
        self.of_byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_byte[0] = 0
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 19)
            self.up, self.down = np.full(n, _MUL, np.uint64), np.full(n, _INV, np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def spans(self, mapped: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(mapped) + 1)
        total = np.zeros(len(mapped) + 1, np.uint64)
        np.cumsum(self.of_byte[mapped] * self.up[: len(mapped)], out=total[1:])
        return mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_spans(mapped: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n+1 offsets of the rows in the list of words."""
    word = mapped != 0
    first = np.zeros(len(mapped) + 1, dtype=bool)  # a row begins here
    first[at] = True
    edge = np.empty(len(mapped) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = (word[1:] != word[:-1]) | first[1:-1]
    edges = np.flatnonzero(edge)
    keep = word[edges[:-1]] if len(mapped) else np.empty(0, bool)
    start, end = edges[:-1][keep], edges[1:][keep]
    return start, end, np.searchsorted(start, at)


_STEP = np.array([pow(0xC2B2AE3D27D4EB4F, k, 1 << 64) for k in range(64)], dtype=np.uint64)


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of k consecutive words for each row; a row with fewer words has its
    whole sequence as one, a row without words none."""
    n = max(0, len(words) - k + 1)
    sums = np.zeros(n, np.uint64)
    for j in range(k):
        sums += words[j : j + n] * _STEP[j]
    sums = mix(sums)
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= k:
            s = np.sort(sums[a : b - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(mix((words[a:b] * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(column: pa.Array, k: int, table: np.ndarray, hasher: Hasher) -> Iterator[np.ndarray]:
    """The set of word k-shingles of every row of a string column."""
    data, at = utf8(column)
    for _, part, offsets in pieces(data, at):
        mapped = table[part]
        start, end, rows = word_spans(mapped, offsets)
        yield from shingles(hasher.spans(mapped, start, end), rows, k)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller views of a batch, so that what is made from it stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
