"""Repair of damaged conversations by the cheapest edits, with an audit string that says which.

A conversation is legal when its role initials read `(s?(ua)+)?`. An automaton of four states reads
them, and a dynamic programme over rows and states finds the cheapest edits. Edit prefixes are nodes
of a trie, shared by all states; a node keeps the rolling hash of its prefix and its ancestors 1, 2,
4 ... steps up, so two prefixes of one cost are compared at their longest common prefix.

Rows are numbered in the order of conversation and turn, and the programme works on pieces of that
order. A piece that holds a whole conversation is settled at once. Of a conversation that goes on
in other pieces, a piece says what it costs to get from each state to each other one, and how the
audits compare; these few numbers are joined along the conversation, so none is read in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.files import stored
from tidewatch.operators.ranks import with_rank

#: what may follow in each state, and the state it leads to; conversations start in 0 and end in 0 or 3
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
NEVER = 1 << 60
PIECE_ROWS = 4096
TASK_ROWS = 1 << 18  # the rows are few bytes, but each takes a while


@dataclass(frozen=True)
class Costs:
    """Edits and their costs. Two deletions must be cheaper than an insertion: then the cheapest
    edits never insert (deleting the other half of the pair, and a system row left alone, costs
    less), all audits of one row have one length, and a least audit starts with a least prefix."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5

    def __post_init__(self) -> None:
        if min(self.keep, self.rerole, self.delete, self.truncated) < 0 or self.insert <= 2 * self.delete:
            raise ValueError("costs are not negative, and an insertion costs more than two deletions")


class Prefixes:
    """Edit prefixes as nodes of a trie; node 0 is the empty prefix, and no prefix has two nodes."""

    def __init__(self, of_op: Callable[[str], int] = ord, modulus: int = (1 << 61) - 1):
        self.ops, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self.known: dict[tuple[int, str], int] = {}
        self.of_op, self.modulus = of_op, modulus

    def node(self, parent: int, op: str) -> int:
        found = self.known.get((parent, op))
        if found is not None:
            return found
        n = self.known[parent, op] = len(self.ops)
        self.ops.append(op)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 1_000_003 + self.of_op(op)) % self.modulus)
        above = [parent]
        while len(above) <= len(self.up[above[-1]]):
            above.append(self.up[above[-1]][len(above) - 1])
        self.up.append(above)
        return n

    def ancestor(self, n: int, depth: int) -> int:
        for k in range((self.depth[n] - depth).bit_length() - 1, -1, -1):
            if self.depth[n] - depth >= 1 << k:
                n = self.up[n][k]
        return n

    def same(self, a: int, b: int) -> bool:
        """Equal prefixes: equal hashes first, and as those may collide, the node itself."""
        return self.hash[a] == self.hash[b] and a == b

    def parting(self, a: int, b: int) -> tuple[int, int]:
        """The first nodes below the longest common prefix of two prefixes of one length."""
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and k < len(self.up[b]) and not self.same(self.up[a][k], self.up[b][k]):
                a, b = self.up[a][k], self.up[b][k]
        return a, b

    def less(self, a: int, x: str, b: int, y: str) -> bool:
        """Whether prefix a and then x sorts before prefix b and then y."""
        if self.same(a, b):
            return x < y
        size = min(self.depth[a], self.depth[b])
        p, q = self.ancestor(a, size), self.ancestor(b, size)
        if not self.same(p, q):
            p, q = self.parting(p, q)
            return self.ops[p] < self.ops[q]
        if self.depth[a] == size:  # a is where b begins
            return x <= self.ops[self.ancestor(b, size + 1)]
        return self.ops[self.ancestor(a, size + 1)] < y

    def text(self, n: int) -> str:
        out = []
        while n:
            out.append(self.ops[n])
            n = self.up[n][0]
        return "".join(reversed(out))


Row = tuple[str, bool, bool]  # role initial, must go, truncated


def cheapest(rows: list[Row], entry: int, costs: Costs, prefixes: Prefixes) -> tuple[list[int], list[int]]:
    """Least cost and node of the least audit for every state after the rows, starting in `entry`."""
    cost, node = [NEVER] * 4, [0] * 4
    cost[entry] = 0

    def inserted() -> None:
        changed = True
        while changed:
            changed = False
            for q, c in enumerate(cost):
                for role, to in NEXT[q].items():
                    if role == "s" or c + costs.insert > cost[to] or c >= NEVER:
                        continue
                    if c + costs.insert < cost[to] or (node[to] and prefixes.less(node[q], "I", prefixes.up[node[to]][0], prefixes.ops[node[to]])):
                        cost[to], node[to], changed = c + costs.insert, prefixes.node(node[q], "I"), True

    inserted()
    for initial, must, cut in rows:
        best: list = [None] * 4
        for q, c in enumerate(cost):
            if c >= NEVER:
                continue
            options = [(c + costs.delete, "D", q)]
            if not must:
                c += costs.truncated if cut else 0
                if initial in NEXT[q]:
                    options.append((c + costs.keep, "K", NEXT[q][initial]))
                options += [(c + costs.rerole, "R", to) for role, to in NEXT[q].items() if role != "s"]
            for total, op, to in options:
                old = best[to]
                if old is None or total < old[0] or (total == old[0] and prefixes.less(node[q], op, old[1], old[2])):
                    best[to] = total, node[q], op
        for q, b in enumerate(best):
            cost[q], node[q] = (NEVER, 0) if b is None else (b[0], prefixes.node(b[1], b[2]))
        inserted()
    return cost, node


def least(cost: list[int], rank: Callable[[int, int], bool], states) -> int:
    """The state of least cost; `rank(a, b)` tells whether a's audit comes first."""
    best = None
    for q in states:
        if best is None or cost[q] < cost[best] or (cost[q] == cost[best] and rank(q, best)):
            best = q
    return best


def edits(rows: list[Row], at: list[int], audit: str, state: int) -> list[dict]:
    """The edit of every row, inserted rows before the row that comes next, with the new role."""
    out, i, step = [], 0, 0
    for op in audit:
        role = None
        if op in "RI":
            role = next(r for r in NEXT[state] if r != "s")
        if op != "D":
            state = NEXT[state][role or rows[i][0]]
        out.append({"at": at[i] if i < len(at) else at[-1] + 1, "step": step, "edit": op, "role": ROLES[role] if role else None})
        step = step + 1 if op == "I" else 0
        i += op != "I"
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_EDITS = "edits array<struct<at: bigint, step: int, edit: string, role: string>>"
_EDIT_TYPE = pa.list_(pa.struct([("at", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
_PIECE = f"whole boolean, illegal bigint, head string, tail string, cost bigint, costs array<bigint>, ranks array<int>, {_EDITS}"


def _runs(batches: Iterator[pa.RecordBatch], key: list[str], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Consecutive rows with one key, whatever batches they lie in: key and columns."""
    held, own = None, [[] for _ in columns]
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in key)))
        values = [b.column(c).to_pylist() for c in columns]
        first = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[first]:
                continue
            if held is not None and keys[first] != held:
                yield held, own
                own = [[] for _ in columns]
            held = keys[first]
            for o, v in zip(own, values):
                o += v[first:i]
            first = i
    if held is not None:
        yield held, own


def _by_piece(rows: DataFrame, total: int) -> DataFrame:
    """Whole pieces in order, in so many tasks that Spark does not put together."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))
    return rows.repartition(tasks, "piece").sortWithinPartitions("piece", "at")


def _pieces(marked: DataFrame, total: int, costs: Costs) -> DataFrame:
    """One row for each conversation in each piece of the order."""
    conv_field = marked.schema["conv"]
    schema = T.StructType([conv_field, T.StructField("piece", T.LongType()), *T.StructType.fromDDL(_PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        runs = _runs(_typed(batches, kinds := []), ["piece", "conv"], ["at", "initial", "fault"])
        ahead = next(runs, None)
        while ahead:
            (piece, conv), (at, initial, fault) = ahead
            ahead = next(runs, None)
            rows = [(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(initial, fault)]
            whole = piece == before and ahead is not None and ahead[0][0] == piece
            before = piece
            prefixes = Prefixes()
            found: list = [[whole], [illegal_pairs(initial)], [initial[0]], [initial[-1]]]
            if whole:
                cost, node = cheapest(rows, 0, costs, prefixes)
                end = least(cost, lambda a, b: prefixes.text(node[a]) < prefixes.text(node[b]), ENDS)
                found += [[cost[end]], [None], [None], [edits(rows, at, prefixes.text(node[end]), 0)]]
            else:
                ways = [cheapest(rows, s, costs, prefixes) for s in range(4)]
                texts = [prefixes.text(n) for _, node in ways for n in node]
                order = {t: i for i, t in enumerate(sorted(set(texts)))}
                found += [[None], [[c for cost, _ in ways for c in cost]], [[order[t] for t in texts]], [None]]
            types = [pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), _EDIT_TYPE]
            arrays = [pa.array([conv], kinds[0]), pa.array([piece], pa.int64()), *[pa.array(v, t) for v, t in zip(found, types)]]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    rows = marked.select("piece", "conv", "at", "initial", "fault")
    return _by_piece(rows, total).mapInArrow(_bundled(run), schema)


def _typed(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[pa.RecordBatch]:
    """The batches as they are; the type of conv is noted."""
    for b in batches:
        if not kinds:
            kinds.append(b.schema.field("conv").type)
        yield b


def _bundled(run, rows: int = 1000):
    """Batches of one row each, put together."""

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in run(batches):
            held.append(b)
            if len(held) == rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return bundled


def _routes(parts: DataFrame) -> DataFrame:
    """For the pieces of conversations that lie in several: the states at which the best edits enter
    and leave; with the first piece, what the conversation costs and the illegal pairs at its joints.
    A task holds a few numbers for each piece of one conversation."""
    conv_field = parts.schema["conv"]
    schema = T.StructType([conv_field, *T.StructType.fromDDL("piece bigint, entry int, exit int, cost bigint, illegal bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(_typed(batches, kinds := []), ["conv"], ["piece", "costs", "ranks", "head", "tail"])
        for (conv,), (piece, costs, ranks, head, tail) in runs:
            total, rank, back = [0, NEVER, NEVER, NEVER], [0] * 4, []
            for c, r in zip(costs, ranks):
                ways = []
                for e in range(4):
                    ways.append(min((min(total[s] + c[4 * s + e], NEVER), rank[s], r[4 * s + e], s) for s in range(4)))
                order = {k: i for i, k in enumerate(sorted({w[1:3] for w in ways}))}
                total, rank = [w[0] for w in ways], [order[w[1:3]] for w in ways]
                back.append(bytes(w[3] for w in ways))
            end = least(total, lambda a, b: rank[a] < rank[b], ENDS)
            leave = [end]
            for b in reversed(back):
                leave.append(b[leave[-1]])
            leave.reverse()
            n = len(piece)
            joints = sum(illegal_pairs([a, b]) for a, b in zip(tail, head[1:]))
            values = [
                pa.array([conv] * n, kinds[0]), pa.array(piece, pa.int64()), pa.array(leave[:-1], pa.int32()), pa.array(leave[1:], pa.int32()),
                pa.array([total[end]] + [0] * (n - 1), pa.int64()), pa.array([joints] + [0] * (n - 1), pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(values, names=schema.names)

    return parts.repartition("conv").sortWithinPartitions("conv", "piece").mapInArrow(_bundled(run), schema)


def _routed(marked: DataFrame, total: int, routes: DataFrame, costs: Costs) -> DataFrame:
    """conv and edits of the pieces whose entry and exit are known."""
    schema = T.StructType([marked.schema["conv"], *T.StructType.fromDDL(_EDITS).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _runs(_typed(batches, kinds := []), ["piece", "conv", "entry", "exit"], ["at", "initial", "fault"])
        for (_, conv, entry, leave), (at, initial, fault) in runs:
            rows = [(r, f in ("blank", "duplicate"), f == "truncated") for r, f in zip(initial, fault)]
            prefixes = Prefixes()
            _, node = cheapest(rows, entry, costs, prefixes)
            found = edits(rows, at, prefixes.text(node[leave]), entry)
            yield pa.RecordBatch.from_arrays([pa.array([conv], kinds[0]), pa.array([found], _EDIT_TYPE)], names=schema.names)

    m, r = marked.alias("m"), routes.alias("r")
    own = m.join(r, (F.col("m.piece") == F.col("r.piece")) & F.col("m.conv").eqNullSafe(F.col("r.conv")))
    rows = own.select("m.piece", "m.conv", "r.entry", "r.exit", "m.at", "m.initial", "m.fault")
    return _by_piece(rows, total).mapInArrow(_bundled(run), schema)


def faults(text: str = "text") -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is not white space ends no sentence."""
    solid = F.rtrim(F.col(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.length(solid) == 0, ~F.substring(solid, -1, 1).isin(".", "!", "?")


class Repaired(NamedTuple):
    """edits: conv, at, step, edit (K, R, D, I), role, text: one row for each edit, in the order of at
    and step; without the deletions, whose role and text are null, the repaired conversations.
    counts: conv, gaps, blank, duplicate, truncated, illegal, cost."""

    edits: DataFrame
    counts: DataFrame


def repair_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs = Costs(), piece_rows: int = PIECE_ROWS
) -> Repaired:
    """The cheapest edits that make every conversation legal, ties to the audit that sorts first.

    A conversation's rows are taken by turn, nulls first, those of one turn by a digest of role and
    text; null roles and texts are one space. The first fault of a row counts: blank, duplicate (its
    role and text were seen before), truncated. Blank and duplicate rows are deleted. Roles of other
    initials than s, u, a, and empty ones, cannot be kept. A null conv is a conversation of its own.
    gaps are the turns missing between the least and the largest, 0 where all are null. Other
    columns of the table are not read, so none can clash; without rows all results are empty.
    """
    picked = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text")
    )
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ranked = with_rank(picked.withColumn("digest", digest), [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "digest"], "at")
    blank, cut = faults()
    slim = stored(ranked.select("at", "conv", "turn", "digest", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), cut.alias("cut")), "repair-rows")
    # counted in tasks first; joined by the row's number, which no two rows share
    firsts = slim.groupBy("conv", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated")
    marked = slim.join(firsts, "at", "left").select("at", "conv", "turn", "initial", fault.alias("fault"), F.floor(F.col("at") / piece_rows).alias("piece"))
    marked = stored(marked, "repair-faults")

    total = marked.count()
    pieces = stored(_pieces(marked, total, costs), "repair-pieces")
    parts = pieces.filter(~F.col("whole"))
    routes = stored(_routes(parts), "repair-routes")
    settled = pieces.filter("whole").select("conv", "edits").union(_routed(marked, total, routes, costs))
    made = settled.select("conv", F.inline("edits")).withColumn("source", F.when(F.col("edit").isin("K", "R"), F.col("at")))
    texts = ranked.select(F.col("at").alias("source"), F.col("role").alias("old"), "text")
    text = F.when(F.col("edit") == "I", "").otherwise(F.col("text"))
    repaired = made.join(texts, "source", "left").select("conv", "at", "step", "edit", F.coalesce("role", "old").alias("role"), text.alias("text"))

    kinds = ("blank", "duplicate", "truncated")
    by_turn = marked.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == k).alias(k) for k in kinds])
    zero = F.lit(0).cast("bigint")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), zero)
    counted = by_turn.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(k).alias(k) for k in kinds])
    prices = pieces.select("conv", "illegal", F.coalesce("cost", zero).alias("cost")).union(routes.select("conv", "illegal", "cost"))
    prices = prices.groupBy(F.col("conv").alias("c")).agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    counts = counted.join(prices, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    return Repaired(stored(repaired, "repair-edits"), counts)


def digests(repaired: Repaired) -> DataFrame:
    """conv, audit, repaired_sha256 (of `role:text` of the repaired rows, one line break between).
    Such a digest is read in order by definition: a conversation streams through a task, which holds
    one batch of rows and the audit."""
    both = repaired.edits.select("conv", "at", "step", "edit", F.concat("role", F.lit(":"), "text").alias("line"))
    schema = T.StructType([both.schema["conv"], *T.StructType.fromDDL("audit string, repaired_sha256 string").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, audit, total, lines = (), [], None, 0

        def done() -> pa.RecordBatch:
            arrays = [pa.array([held[0]], kinds[0]), pa.array(["".join(audit)]), pa.array([total.hexdigest()])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for b in _typed(batches, kinds := []):
            for conv, edit, line in zip(*(b.column(c).to_pylist() for c in ("conv", "edit", "line"))):
                if held != (conv,):
                    if held:
                        yield done()
                    held, audit, total, lines = (conv,), [], hashlib.sha256(), 0
                audit.append(edit)
                if line is not None:
                    total.update((f"\n{line}" if lines else line).encode())
                    lines += 1
        if held:
            yield done()

    return both.repartition("conv").sortWithinPartitions("conv", "at", "step").mapInArrow(_bundled(run), schema)


def damage_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn` (nulls: one space): of
    20 remainders, 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 sets
    its role to user. Null roles and texts become one space first."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    how = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(how == 1, "").when(how == 2, F.translate(text, ".!?", "")).otherwise(text)
    kept = rows.filter(how != 0)
    times = F.explode(F.sequence(F.lit(1), F.when(how == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", F.when(how == 4, "user").otherwise(role).alias("role"), text.alias("text"), times.alias("_")).drop("_")
