import hashlib
import random

import numpy as np

from tidewatch.llm import toxicity

INSULTS = ["zorkface", "blumpkopf", "grizzlewit"]


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "re", "ti", "on", "er"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        text = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(INSULTS))
        rows.append((i, " ".join(text), toxic))
    return rows


def test_backoff_sums_to_one():
    _, gram, _ = toxicity.grams(["abc", "abd", "xabc", "zz", "cab"])
    gram = np.unique(gram)
    p = toxicity.shared_backoff(gram)
    assert ((p > 0) & (p <= 1)).all()


def test_held_out(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, docs, labels).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 60 and sum(a != b for a, b in held) <= 1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    # a label of a held-out row changes nothing
    other = spark.createDataFrame([(i, 1 - y if got[i].held_out else y) for i, _, y in rows], "doc_id bigint, toxic int")
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs, other).collect()} == {i: r.score for i, r in got.items()}


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 0), (6, None), (None, 1), (8, 7)], "doc_id bigint, toxic int")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    more = odd.selectExpr("*", "'x' AS score", "1 AS held_out", "2 AS predicted", "3 AS _top2")
    for rows, own in ((odd, labels), (odd, none), (more, labels)):
        got = toxicity.score_toxicity(rows, rows, own)
        assert got.columns == [c for c in rows.columns if c not in ("score", "held_out", "predicted")] + ["held_out", "score", "predicted"]
        assert got.count() == 9 and got.filter("score BETWEEN 0 AND 1").count() == 9
    assert toxicity.score_toxicity(empty, empty, labels).count() == 0


def reference(rows):
    """Model of (text, label) rows at hand: ratios of grams, and of unseen ones by context."""
    n = {}
    for t, y in rows:
        for g in toxicity.grams(toxicity.WORD.findall(t.lower()))[1].tolist():
            n.setdefault(g, [0, 0])[y] += 1
    gram = np.array(sorted(n), np.int64)
    counts = np.array([n[g] for g in gram.tolist()], np.float64)
    context, at = np.unique(toxicity.context_of(gram), return_inverse=True)
    back, logs, weights = toxicity.shared_backoff(gram), [], []
    for c in counts.T:
        held = np.maximum(c - toxicity._discount(c), 0)
        total = np.bincount(at, c)
        left = np.where(total > 0, (total - np.bincount(at, held)) / np.maximum(total, 1), 1.0)
        logs.append(np.log(held / np.maximum(total, 1)[at] + left[at] * back))
        weights.append(np.log(left))
    return dict(zip(gram.tolist(), logs[1] - logs[0])), dict(zip(context.tolist(), weights[1] - weights[0]))


def test_every_gram_counts(spark, monkeypatch):
    """However few grams and words the tasks hold, those seen once are in the model and all scores
    are the same."""
    rows = corpus(400) + [(400 + i, "日本語文字" * 9 + chr(0x4E00 + 7 * i) + " onceonly" + "abcdefgh"[i % 8], i % 2) for i in range(30)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    whole = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs, labels).collect()}
    monkeypatch.setattr(toxicity, "COMMON_GRAMS", 7)
    monkeypatch.setattr(toxicity, "COMMON_WORDS", 3)
    assert {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs, labels).collect()} == whole
    model = toxicity.fit_ratio(spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int"), "text", "label")
    seen, unseen = reference([(t, y) for _, t, y in rows])
    got = model.collect()
    assert {r.gram for r in got} == set(seen) and sum(r.n == 1 for r in got) > 20
    assert all(abs(r.seen / toxicity.GRID - seen[r.gram]) < 1e-6 and abs(r.unseen / toxicity.GRID - unseen[r.context]) < 1e-6 for r in got)
    words = ["zorkface", "anthe", "日本語文字" * 9, "qqq"]
    rated = {r.name: r for r in toxicity.rate_words(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint"), model).collect()}
    for w in words:
        context, gram, _ = toxicity.grams([w])
        want = sum(seen.get(g, unseen.get(c, 0.0)) for c, g in zip(context.tolist(), gram.tolist()))
        assert abs(rated[toxicity.name_of(w)].total / toxicity.GRID - want) < 1e-5 and rated[toxicity.name_of(w)].letters == len(w) + 1


def test_copies(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5, rows[0][1])] * 3, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = toxicity.score_toxicity(docs, docs, labels).collect()
    assert len(got) == 203 and len({r.score for r in got if r.text == rows[0][1]}) == 1


def test_letters_and_spellings_are_kept_apart():
    a, b = (set(toxicity.grams([w])[1].tolist()) for w in ("你好吗", "㽠䥽䐗"))
    assert not a & b
    assert toxicity.WORD.findall("f*ck, sh1t a$$ 2023 ### b!tch! $h1t (no)") == ["f*ck", "sh1t", "a$$", "b!tch", "$h1t", "no"]
    context, gram, word = toxicity.grams(["aé日", "😀"])
    assert (toxicity.context_of(gram) == context).all() and np.bincount(word).tolist() == [5, 3]


def test_ratios_of_documents(spark):
    rows = corpus(120)
    data = spark.createDataFrame([(t, y) for _, t, y in rows], "text string, label int")
    seen, unseen = reference([(t, y) for _, t, y in rows])
    texts = ["zorkface anthe zorkface", rows[0][1], "日本語 zzz blumpkopf", "", None, "?!", "onthe " * 500]
    frame = spark.createDataFrame([(t,) for t in texts + texts[:1]], "text string")
    got = {bytes(r.digest): r for r in toxicity.rate_texts(frame, toxicity.rate_words(toxicity.count_words(frame, "text"), toxicity.fit_ratio(data, "text", "label"))).collect()}
    for t in texts:
        own = toxicity.WORD.findall((t or "").lower())
        totals = []
        for w in own:
            context, gram, _ = toxicity.grams([w])
            totals.append(sum(seen.get(g, unseen.get(c, 0.0)) for c, g in zip(context.tolist(), gram.tolist())))
        letters = [len(w) + 1 for w in own]
        r = got[hashlib.sha256((t or "").encode()).digest()]
        assert abs(r.whole - sum(totals) / (sum(letters) + toxicity.PRIOR_TEXT)) < 1e-5
        assert abs(r.top - max((x / (n + toxicity.PRIOR_LETTERS) for x, n in zip(totals, letters)), default=0)) < 1e-5
        assert abs(r.density - sum(max(x - toxicity.MARGIN, 0) for x in totals) / (len(own) + toxicity.PRIOR_WORDS)) < 1e-5
