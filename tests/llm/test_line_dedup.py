import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tidewatch.llm import line_dedup
from tidewatch.llm.text import Hasher


def brute(rows, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    for k, t in rows:
        for x in (t or "").split("\n"):
            key = line_dedup.line_key(x)
            if len(key) >= min_chars and k is not None:
                holders[key].add(k)
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if k is None or len(holders[line_dedup.line_key(x)]) < min_docs or max(holders[line_dedup.line_key(x)]) == k]
        out.append((k, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.kept, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    lines = [f"A common line number {i} of the corpus é" for i in range(30)] + ["short", "", "  \t", "x" * 19, "y" * 20, " " + "Y" * 20 + "\r"]
    rows = [(i % 55, "\n".join(rng.choice(lines) if rng.random() < 0.6 else f"unique line {i} {j} with some text" for j in range(rng.randint(0, 9)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert got(line_dedup.drop_repeated_lines(docs)) == brute(rows)
    # filters far too small let everything through to the exact count
    assert got(line_dedup.drop_repeated_lines(docs, max_bits=4)) == brute(rows)


def test_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(line_dedup.drop_repeated_lines(odd, min_docs=2)) == brute(rows, min_docs=2)
    more = odd.selectExpr("*", "1 AS kept", "2 AS n_lines", "3 AS line", "4 AS last", "5 AS _key")
    d = line_dedup.drop_repeated_lines(more.drop("_key"))
    assert d.columns == ["doc_id", "text", "lang", "line", "last", "kept", "n_lines", "n_dropped"] and d.count() == 9
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_filters_forget_no_repeat():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    parts = []
    for part in (h[:300], h[200:]):
        once, twice = np.zeros(1 << 12, bool), np.zeros(1 << 12, bool)
        line_dedup.add(once, twice, part, 12)
        parts.append((once, twice))
    (a, ta), (b, tb) = parts
    twice = ta | tb | (a & b)
    assert twice[line_dedup.positions(h[200:300], 12)].all()


def test_lines():
    found = line_dedup.Lines(pa.array(["a\n\n  HELLO there  \n", "", None, "\n", "\x0b"]), Hasher(), 0)
    assert found.counts.tolist() == [4, 1, 1, 2, 1]
    assert [found.key(i) for i in range(3)] == ["a", "", "hello there"]
