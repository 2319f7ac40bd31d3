"""Adaptive range coder for blocks of token ids.

A block is cut into equal runs, the lanes, that are coded side by side with numpy: step t codes the
t-th id of every lane with what the model knew after step t-1. The model is shared by the lanes and
starts empty in each block. Three predictions are mixed: order 2 and order 1 each name one id (the
one last seen after the same two ids or the same id, with a confidence), order 0 gives adaptive
frequencies of all ids. A gate learns, for every pair of confidences, how often each order is right;
its weights split the coder's range between "the order-2 id", "the order-1 id" and "another", and
order 0 splits the rest. Each lane has a range coder of its own: 64-bit range, 32-bit words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TWC1"
HEAD = "<4sQIIIII"  # magic, ids, lanes, steps, vocabulary, crc of the ids, crc of the rest
LANES, MIN_STEPS = 4096, 64
GATE_BITS, MAX_VOCABULARY = 12, 1 << 18
_TOP = np.uint64(1 << 32)
_LOW = np.uint64((1 << 32) - 1)
_WORD = np.uint64(32)
_CONTEXTS, _SURE = 128, 7
_PAIRS = 17  # bits of the order-2 table


class Model:
    def __init__(self, vocabulary: int):
        self.v = vocabulary
        self.bits = max(16, int(vocabulary).bit_length() + 2)
        none = vocabulary
        # an id and, in the low three bits, its confidence
        self.table1, self.table2 = np.full(vocabulary + 1, none << 3, np.int32), np.full(1 << _PAIRS, none << 3, np.int32)
        self.gate = np.tile(np.array([1, 1, 2], np.int64), (_CONTEXTS, 1))
        self.count = np.zeros(vocabulary, np.int64)
        self.late: list[np.ndarray] = []  # ids that the counts do not have yet
        self.step = 0
        self._spread()
        self._weigh()

    def _spread(self) -> None:
        """Cumulative order-0 frequencies, every id at least one, 2^bits in all."""
        room = (1 << self.bits) - self.v
        if self.late:
            self.count += np.bincount(np.concatenate(self.late), minlength=self.v)
            self.late = []
        self.cum = np.arange(self.v + 1, dtype=np.int64)
        total = int(self.count.sum())
        if total:
            self.cum[1:] += np.cumsum(self.count) * ((room << 20) // total) >> 20
        self.cum[-1] = 1 << self.bits
        self.slot = None

    def slots(self) -> np.ndarray:
        """Id of every value below 2^bits."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(self.v, dtype=np.int32), np.diff(self.cum))
        return self.slot

    def _weigh(self) -> None:
        g = self.gate
        total = g.sum(axis=1)
        room = (1 << GATE_BITS) - 3
        # where each kind starts and how much of the range it has, at 3 * context + kind
        edges = np.zeros((_CONTEXTS, 4), np.uint64)
        edges[:, 1] = g[:, 0] * room // total + 1
        edges[:, 2] = (g[:, 0] + g[:, 1]) * room // total + 2
        edges[:, 3] = 1 << GATE_BITS
        self.edge2, self.edge1 = edges[:, 1].copy(), edges[:, 2].copy()
        self.start, self.part = edges[:, :3].ravel(), (edges[:, 1:] - edges[:, :3]).ravel()

    def predict(self, prev2: np.ndarray, prev1: np.ndarray) -> None:
        self.at1 = prev1
        self.at2 = ((prev2 * 0x9E3779B1 + prev1 * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - _PAIRS)
        self.p1, self.p2 = p1, p2 = self.table1[prev1], self.table2[self.at2]
        self.c1, self.c2, self.f1, self.f2 = p1 >> 3, p2 >> 3, p1 & 7, p2 & 7
        self.context = (self.f2 << 4) | (self.f1 << 1) | (self.c1 == self.c2)

    def learn(self, ids: np.ndarray, cell: np.ndarray, rest: np.ndarray) -> None:
        """`cell` is 3 * context + kind of every id, `rest` the places of kind 2."""
        self.gate += np.bincount(cell, minlength=3 * _CONTEXTS).reshape(_CONTEXTS, 3)
        fresh = (ids << 3) | 1
        for table, at, p, c, f in ((self.table1, self.at1, self.p1, self.c1, self.f1), (self.table2, self.at2, self.p2, self.c2, self.f2)):
            # a sure prediction loses confidence before it is replaced
            table[at] = np.where(c == ids, p + (f < _SURE), np.where(f > 1, p - 1, fresh))
        self.late.append(ids[rest])
        self.step += 1
        if self.step % 16 == 0 or self.step in (1, 2, 4, 8):
            self._spread()
        self._weigh()
        if self.step % 64 == 0:
            self.gate = (self.gate >> 1) + 1


def _shape(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(1, min(LANES, -(-n // MIN_STEPS)))
    steps = -(-n // lanes)
    return -(-n // steps), steps


def _renew(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose range is below 2^32, with the range cut at the next word where it straddles one."""
    out = np.flatnonzero(size < _TOP)
    a, s = low[out], size[out]
    astride = ((a ^ (a + (s - np.uint64(1)))) >> _WORD) != 0
    return out, np.where(astride, (np.uint64(0) - a) & _LOW, s)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block; ids are below `vocabulary`."""
    if vocabulary > MAX_VOCABULARY:
        raise ValueError(f"ids of {MAX_VOCABULARY} and more are not coded")
    ids = np.asarray(ids, dtype=np.int64)
    n = len(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    if not n:
        return struct.pack(HEAD, MAGIC, 0, 0, 0, vocabulary, crc, zlib.crc32(b""))
    if ids.min() < 0 or ids.max() >= vocabulary:
        raise ValueError("an id is outside the vocabulary")
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(vocabulary)
    shift = np.uint64(model.bits)
    gate = np.uint64(GATE_BITS)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    words, filled = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    prev2 = np.full(lanes, vocabulary, np.int64)
    prev1 = prev2.copy()
    for t in range(steps):
        live = lanes if lanes * steps == n else len(range(t, n, steps))
        s = grid[t, :live]
        model.predict(prev2[:live], prev1[:live])
        off2 = s != model.c2
        off = off2 & (s != model.c1)
        cell = model.context * 3 + off2 + off
        r = size[:live] >> gate
        a, z = low[:live] + r * model.start[cell], r * model.part[cell]
        rest = np.flatnonzero(off)
        if len(rest):
            i = s[rest]
            first = model.cum[i].astype(np.uint64)
            r = z[rest] >> shift
            a[rest] += r * first
            z[rest] = r * (model.cum[i + 1].astype(np.uint64) - first)
        out, cut = _renew(a, z)
        if len(out):
            words[out, filled[out]] = a[out] >> _WORD
            filled[out] += 1
            a[out] <<= _WORD
            z[out] = cut << _WORD
        low[:live], size[:live] = a, z
        model.learn(s, cell, rest)
        prev2[:live], prev1[:live] = prev1[:live], s
    for part in (low >> _WORD, low & _LOW):
        words[np.arange(lanes), filled] = part
        filled += 1
    used = np.arange(steps + 2)[None, :] < filled[:, None]
    body = filled.astype("<u4").tobytes() + words[used].astype("<u4").tobytes()
    return struct.pack(HEAD, MAGIC, n, lanes, steps, vocabulary, crc, zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; a block that was changed raises ValueError."""
    if len(block) < struct.calcsize(HEAD):
        raise ValueError("not a block of token ids")
    magic, n, lanes, steps, vocabulary, crc, body_crc = struct.unpack_from(HEAD, block)
    body = memoryview(block)[struct.calcsize(HEAD) :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("not a block of token ids, or damaged")
    if not n:
        return np.empty(0, np.int64)
    filled = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.zeros((lanes, int(filled.max()) + 1), np.uint64)
    words[np.arange(words.shape[1])[None, :] < filled[:, None]] = np.frombuffer(body, "<u4", offset=4 * lanes)
    model = Model(vocabulary)
    shift = np.uint64(model.bits)
    gate = np.uint64(GATE_BITS)
    most = (1 << model.bits) - 1
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    code = (words[:, 0] << _WORD) | words[:, 1]
    at = np.full(lanes, 2, np.int64)
    prev2 = np.full(lanes, vocabulary, np.int64)
    prev1 = prev2.copy()
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        live = lanes if lanes * steps == n else len(range(t, n, steps))
        model.predict(prev2[:live], prev1[:live])
        e2, e1 = model.edge2[model.context], model.edge1[model.context]
        r = size[:live] >> gate
        d = code[:live] - low[:live]
        in2, in1 = d < r * e2, d < r * e1
        cell = model.context * 3 + ~in2 + ~in1
        s = np.where(in2, model.c2, model.c1)
        a, z = low[:live] + r * model.start[cell], r * model.part[cell]
        rest = np.flatnonzero(~in1)
        if len(rest):
            r = z[rest] >> shift
            value = (code[:live][rest] - a[rest]) // r
            i = model.slots()[np.minimum(value, np.uint64(most)).astype(np.int64)].astype(np.int64)
            first = model.cum[i].astype(np.uint64)
            a[rest] += r * first
            z[rest] = r * (model.cum[i + 1].astype(np.uint64) - first)
            s[rest] = i
        out, cut = _renew(a, z)
        if len(out):
            a[out] <<= _WORD
            z[out] = cut << _WORD
            code[out] = (code[out] << _WORD) | words[out, np.minimum(at[out], words.shape[1] - 1)]
            at[out] += 1
        low[:live], size[:live] = a, z
        model.learn(s, cell, rest)
        prev2[:live], prev1[:live] = prev1[:live], s
        grid[t, :live] = s
    ids = grid.T.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("the ids of the block are damaged")
    return ids
