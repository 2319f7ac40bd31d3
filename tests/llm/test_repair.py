import hashlib
import random
from functools import cache

import pytest

from tidewatch.llm import repair
from tidewatch.llm.repair import Costs, Prefixes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def in_order(rows):
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def brute(rows, costs=Costs()):
    """Every way to edit the rest of a conversation, from each state, insertions included."""
    rows = in_order(rows)
    seen, faults = set(), []
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    @cache
    def best(i, state, inserted=0):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 3:
            for r, to in after[state].items():
                if r != "s":
                    c, audit, lines = best(i, to, inserted + 1)
                    found.append((costs.insert + c, "I" + audit, (names[r] + ":", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, audit, lines = best(i + 1, state)
            found.append((costs.delete + c, "D" + audit, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = costs.truncated if faults[i] else 0
                for r, to in after[state].items():
                    c, audit, lines = best(i + 1, to)
                    if role[:1] == r:
                        found.append((costs.keep + more + c, "K" + audit, (f"{role}:{text}", *lines)))
                    if r != "s":
                        found.append((costs.rerole + more + c, "R" + audit, (f"{names[r]}:{text}", *lines)))
        return min(found, default=(1 << 40, "~", ()))

    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = best(0, 0)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    counts = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n, longest):
    text = lambda: rng.choice(["a.", "b!", "c", "d, ", " \n", "", None, "é?\t", "f.", "g?", "h!", "i.", "j."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux"])
    return {c: [(rng.choice([None, t, t, t + 1]), role(), text()) for t in range(rng.randint(1, longest))] for c in range(n)}


def results(repaired):
    counts = {r.conv: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) for r in repaired.counts.collect()}
    return {r.conv: (*counts[r.conv], r.audit, r.repaired_sha256) for r in repair.digests(repaired).collect()}


@pytest.mark.parametrize("piece_rows, costs", [(4096, Costs()), (3, Costs()), (4, Costs(1, 1, 2, 5, 0)), (5, Costs(0, 2, 1, 3, 1))])
def test_against_brute_force(spark, piece_rows, costs):
    rows = conversations(random.Random(piece_rows), 60, 14)
    df = spark.createDataFrame([(c, *r) for c, own in rows.items() for r in own], SCHEMA).repartition(3)
    got = results(repair.repair_conversations(df, costs=costs, piece_rows=piece_rows))
    for c, own in rows.items():
        assert got[c] == brute(own, costs), (c, own)


def test_one_long_conversation_in_pieces(spark):
    own = conversations(random.Random(9), 1, 4000)[0]
    own = [(i, *r[1:2], f"{i} {r[2]}") for i, r in enumerate(own)]
    df = spark.createDataFrame([(None, *r) for r in own], SCHEMA)
    whole = results(repair.repair_conversations(df, piece_rows=1 << 20))
    assert results(repair.repair_conversations(df, piece_rows=64)) == whole


def test_prefixes_where_hashes_collide():
    rng = random.Random(2)
    for p in (Prefixes(), Prefixes(of_op=lambda op: 0), Prefixes(modulus=2)):
        held = [(0, "")]
        for _ in range(300):
            n, t = rng.choice(held)
            op = rng.choice("DK")
            held.append((p.node(n, op), t + op))
        for (a, s), (b, t) in zip(held, rng.sample(held, len(held))):
            assert p.text(a) == s and (a == b) == (s == t)
            for x, y in (("D", "K"), ("K", "K"), ("K", "D")):
                assert p.less(a, x, b, y) == (s + x < t + y)


def test_edits_are_the_repaired_rows(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "user", "b."), (1, 3, "user", " "), (1, 4, "user", "c"), (1, 5, "user", "d.")]
    got = repair.repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert [(r.edit, r.role, r.text) for r in got.edits.orderBy("at", "step").collect()] == [
        ("R", "user", "s."), ("K", "assistant", "a."), ("K", "user", "b."), ("D", None, None), ("D", None, None), ("R", "assistant", "d.")
    ]


def test_damage(spark):
    import zlib

    rows = [(i, j, "assistant", "Hi. Ok?") for i in range(30) for j in range(6)] + [(None, None, None, None)] * 2
    got = repair.damage_rows(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for c, t, role, text in rows:
        how = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (x if x is not None else " " for x in (role, text))
        row = (c, t, "user" if how == 4 else role, "" if how == 1 else "Hi Ok" if how == 2 and c is not None else text)
        want += [row] * (0 if how == 0 else 2 if how == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_odd_tables(spark):
    empty = repair.repair_conversations(spark.createDataFrame([], SCHEMA))
    assert repair.digests(empty).count() == 0 and empty.counts.count() == 0 and empty.edits.count() == 0
    rows = [(None, None, None, None), (None, None, None, None), (7, 2, "user", "x" * 200_000 + " " * 50_000 + "."), (7, 3, "assistant", "ok.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "2 AS at", "3 AS digest", "4 AS piece", "5 AS cost")
    got = results(repair.repair_conversations(df))
    assert got[None] == brute([r[1:] for r in rows[:2]]) and got[7] == brute([r[1:] for r in rows[2:]])


def test_costs_that_would_insert():
    with pytest.raises(ValueError):
        Costs(delete=2, insert=4)
