import random
import re

from tidewatch.llm import contamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower().decode())


def brute(text, items, size):
    w = words(text)
    hit, found = set(), set()
    for name, t in items:
        own = words(t)
        n = min(size, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = ["a", "b", "cé", "d9", "É", "e日"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "__", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 9]))) for i in range(12)] + [(12, None), (12, "a b"), (12, "a b"), (None, "d9 d9")]
    docs = [(i, rng.choice([text(rng.randint(0, 60)), (items[rng.randrange(12)][1] or "").upper()])) for i in range(120)] + [(120, None), (121, "")]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, n_hit int").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    named = [("" if k is None else k, t) for k, t in items]
    for limit in (64 << 20, 20):  # one automaton, several
        got = contamination.contaminated_words(d, b, size=4, max_bytes=limit)
        for r in got.collect():
            assert (r.n_words, r.n_hit, r.item_ids) == brute(dict(docs)[r.doc_id], named, 4), r
            # the spans are the hit words of the original
            w = words(dict(docs)[r.doc_id])
            assert [x for s in r.spans for x in words(dict(docs)[r.doc_id][s["from"] : s["to"]])] == [w[i] for i in sorted(_hit(w, named, 4))]


def _hit(w, items, size):
    hit = set()
    for _, t in items:
        own = words(t)
        n = min(size, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i : i + n]) in wins:
                hit.update(range(i, i + n))
    return hit


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "beta gamma delta")], "item_id bigint, text string")
    got = contamination.contaminated_words(odd, items).select("*", contamination.is_contaminated().alias("bad")).collect()
    assert len(got) == 9 and sum(r.bad for r in got) == 4
    assert contamination.contaminated_words(empty, items).count() == 0
    none = contamination.contaminated_words(odd, items.limit(0)).collect()
    assert len(none) == 9 and not any(r.n_hit for r in none)
