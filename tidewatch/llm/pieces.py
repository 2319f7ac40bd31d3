"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a Viterbi pass.

The automaton over all pieces reads a word once and names, at every position, the pieces that end
there, longest first, along its output links. Each of them is relaxed with the best path to where
it begins. For a unigram model the path of highest score wins. For a BPE model scores are merge
ranks, and their sum means nothing: a piece is taken if it and the last piece of the path before it
would not have been merged otherwise, which one piece fulfils at each position; the result is that
of the merges. Words of a batch are relaxed side by side, position by position.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.files import with_fields

SPACE = "▁"
REMEMBER = 500_000
UNKNOWN = -1


@dataclass
class Vocabulary:
    """Pieces by id with their scores; `byte_ids` are those of the 256 bytes, or empty."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]  # pieces that text can be cut into: not bytes, controls or the unknown
    byte_ids: list[int]
    unknown: int
    bpe: bool
    prefix: bool  # a space is put before the text
    split: np.ndarray = field(default=None)  # by rank: the two pieces of the last merge

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that leave the text as it is are supported")
        if model.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        kinds = [p.type for p in model.pieces]
        at = {p.piece: i for i, p in enumerate(model.pieces)}
        return cls(
            [p.piece for p in model.pieces],
            [p.score for p in model.pieces],
            [k in (1, 4) for k in kinds],
            [at[f"<0x{b:02X}>"] for b in range(256)] if 6 in kinds else [],
            kinds.index(2),
            model.trainer_spec.model_type == 2,
            rules.add_dummy_prefix,
        ).ranked()

    def ranked(self) -> Vocabulary:
        """Single characters first, then the merged pieces in the order of merging; with the last
        merge of each. Pieces that merging never makes have none."""
        usable = [i for i, u in enumerate(self.usable) if u]
        single = [i for i in usable if len(self.pieces[i]) == 1]
        merged = sorted((i for i in usable if len(self.pieces[i]) > 1), key=lambda i: (-self.scores[i], i))
        self.by_rank = np.array(single + merged, np.int64)
        self.rank = {self.pieces[i]: r for r, i in enumerate(self.by_rank.tolist())}
        if self.bpe:
            self.split = np.stack([np.arange(len(self.by_rank))] * 2, axis=1)
            for r in range(len(single), len(self.by_rank)):
                p = self.pieces[self.by_rank[r]]
                last = self.merge(p)[1]
                self.split[r] = last if last and self.merge(p)[0] == [p] else (-1, -1)
        return self

    def merge(self, word: str) -> tuple[list[str], tuple[int, int] | None]:
        """The pieces of a word by plain merging, and the ranks of the last two that were merged."""
        parts, last = list(word), None
        while True:
            best = None
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or self.scores[self.by_rank[r]] > self.scores[self.by_rank[best[0]]]):
                    best = r, i
            if best is None:
                return parts, last
            i = best[1]
            last = self.rank[parts[i]], self.rank[parts[i + 1]]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]


class Pieces:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        names = [v.pieces[i] for i in v.by_rank.tolist()]
        for r, p in enumerate(names):
            # what merging never makes is no candidate
            if v.split is None or v.split[r, 0] >= 0:
                self.automaton.add_word(p, r)
        self.automaton.make_automaton()
        self.length = np.array([len(p) for p in names], np.int64)
        self.score = np.array([v.scores[i] for i in v.by_rank.tolist()])
        # an unknown character in a unigram path costs more than any piece
        self.unknown_score = (self.score.min() if len(names) else 0.0) - 10.0
        if v.split is not None:
            n = len(names)
            pairs = {int(a) * n + int(b): r for r, (a, b) in enumerate(v.split.tolist()) if a >= 0 and len(names[r]) > 1}
            self.pairs = np.array(sorted(pairs), np.int64)
            self.merged = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)
        alphabet = {c for p in names for c in p}
        # no piece spans these characters, so that words can be cut at them
        cut = "".join(re.escape(c) for c in "\n\t\r" if c not in alphabet)
        self.unit = re.compile(f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" if cut else f"{SPACE}*[^{SPACE}]+|{SPACE}+", re.S)
        self.known: dict[str, bytes] = {}
        self.bytes_of = [SPACE.join(p.split(SPACE)).replace(SPACE, " ").encode() for p in v.pieces]
        for b, i in enumerate(v.byte_ids):
            self.bytes_of[i] = bytes([b])

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a and b stay two pieces: walking down their merges from the seam, no
        pair there may have been merged earlier than what was."""
        n = len(self.length)
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a >= 0) & (b >= 0))
        x, y = a[live], b[live]
        limit = np.full(len(live), np.iinfo(np.int64).max)
        left, right = self.v.split[:, 0], self.v.split[:, 1]
        while len(live):
            code = x * n + y
            at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            broken = (self.pairs[at] == code) & (self.merged[at] < limit) if len(self.pairs) else np.zeros(len(x), bool)
            ok[live[broken]] = False
            down_x, down_y = right[x], left[y]
            stuck_x, stuck_y = down_x == x, down_y == y
            go_x = np.where(x > y, ~stuck_x, stuck_y & ~stuck_x)
            go_y = ~go_x & ~stuck_y
            limit = np.where(go_x, x, y + 1)
            more = ~broken & (go_x | go_y)
            x, y = np.where(go_x, down_x, x)[more], np.where(go_y, down_y, y)[more]
            limit, live = limit[more], live[more]
        return ok

    def _paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pieces of all words, UNKNOWN for a character without one, and where each word
        begins among them."""
        text = "".join("\0" + w for w in words) + "\0"
        sizes = np.array([len(w) for w in words], np.int64)
        begin = np.cumsum(sizes + 1) - sizes  # of the word's characters
        pair = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        # longest first at each end
        pair = pair[np.lexsort((-self.length[pair[:, 1]], pair[:, 0]))]
        first = np.searchsorted(pair[:, 0], np.arange(len(text) + 1))
        last, best = np.full(len(text), UNKNOWN), np.zeros(len(text))
        done = np.ones(len(text), np.int64)  # length of the last piece
        for depth in range(1, int(sizes.max(initial=0)) + 1):
            at = begin[sizes >= depth] + depth - 1
            start = at - depth  # the separator before the word: the empty path
            nth, best[at] = 0, -np.inf
            while len(at):
                k = first[at] + nth
                has = k < first[at + 1]
                none = at[~has]
                fresh = none[best[none] == -np.inf]
                best[fresh] = best[fresh - 1] + self.unknown_score  # last and done say so already
                at, start, k = at[has], start[has], k[has]
                r = pair[k, 1]
                before = at - self.length[r]
                if self.v.split is None:
                    s = best[before] + self.score[r]
                    better = s > best[at]
                    go = np.ones(len(at), bool)
                else:
                    previous = np.where(before == start, UNKNOWN, last[before])
                    better = self._apart(previous, r)
                    s, go = np.zeros(len(at)), ~better
                last[at[better]], best[at[better]], done[at[better]] = r[better], s[better], self.length[r[better]]
                at, start, nth = at[go], start[go], nth + 1
        # back along the last pieces, all words at once
        word, at = np.flatnonzero(sizes), (begin + sizes - 1)[sizes > 0]
        rows, ranks = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(word):
            rows.append(word)
            ranks.append(last[at])
            at = at - done[at]
            on = at >= begin[word]
            word, at = word[on], at[on]
        step = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        rows, ranks = np.concatenate(rows), np.concatenate(ranks)
        order = np.lexsort((-step, rows))
        return ranks[order], np.searchsorted(rows[order], np.arange(len(words) + 1))

    def _unknown(self, c: str) -> list[int]:
        return [self.v.byte_ids[b] for b in c.encode()] if self.v.byte_ids else [self.v.unknown]

    def learn(self, units: set[str]) -> None:
        """Encode words that are not known yet."""
        new = list(units.difference(self.known))
        if not new:
            return
        if len(self.known) + len(new) > REMEMBER:
            self.known, new = {}, list(units)
        # pieces of several spaces have one score, which ranks cannot tell apart
        odd = {u for u in new if u.startswith(SPACE * 2)} if self.v.split is not None else set()
        plain = [u for u in new if u not in odd]
        for u in odd:
            ids = [i for p in self.v.merge(u)[0] for i in ([int(self.v.by_rank[self.v.rank[p]])] if p in self.v.rank else self._unknown(p))]
            self.known[u] = np.array(ids, "<u4").tobytes()
        ranks, at = self._paths(plain)
        raw = (self.v.by_rank[ranks] if len(ranks) else ranks).astype("<u4").tobytes()
        ends = (at * 4).tolist()
        self.known.update((u, raw[i:j]) for u, i, j in zip(plain, ends, ends[1:]))
        for w in np.unique(np.searchsorted(at, np.flatnonzero(ranks == UNKNOWN), side="right") - 1).tolist():
            ids, c = [], 0
            for r in ranks[at[w] : at[w + 1]].tolist():
                ids += [int(self.v.by_rank[r])] if r >= 0 else self._unknown(plain[w][c])
                c += int(self.length[r]) if r >= 0 else 1
            self.known[plain[w]] = np.array(ids, "<u4").tobytes()

    def units(self, text: str | None) -> list[str]:
        if not text:
            return []
        return self.unit.findall((SPACE if self.v.prefix else "") + text.replace(" ", SPACE))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        units = [self.units(t) for t in texts]
        self.learn({u for x in units for u in x})
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), "<u4") for x in units]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, rows_at_once: int = 256) -> DataFrame:
    """Adds `ids`, the piece ids of each whole text, `n_pieces` and `ids_crc32` (of the ids as
    little-endian 32-bit integers); columns of these names are replaced. Null and empty texts have
    no pieces. Characters outside the pieces become their bytes where the vocabulary has those, else
    the unknown piece. Repeated rows are encoded alike."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary
    added = ["ids", "n_pieces", "ids_crc32"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    rows = docs.select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(known.value)
        for b in batches:
            for i in range(0, b.num_rows, rows_at_once):
                part = b.slice(i, rows_at_once)
                ids = pieces.encode(part.column(text).to_pylist())
                sizes = [len(x) for x in ids]
                flat = pa.array(np.concatenate(ids).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
                crc = pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], lists, pa.array(sizes, pa.int64()), crc], names=[*kept, *added])

    return rows.mapInArrow(run, with_fields(docs.select(*kept).schema, "ids array<int>, n_pieces bigint, ids_crc32 bigint"))


def decode_pieces(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of piece ids; null ids give a null text, broken UTF-8 replacement characters.
    The column of ids is dropped."""
    known = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kept = [c for c in rows.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(known.value)
        for b in batches:
            texts = [None if not x.is_valid else pieces.decode(x.values.to_numpy()) for x in b.column(ids)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, out])

    return rows.mapInArrow(run, with_fields(rows.select(*kept).schema, f"{out} string"))
