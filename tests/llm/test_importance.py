import hashlib
import math
import random
import re
import zlib

from tidewatch.llm import importance
from tidewatch.llm.importance import Resampling


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, target, o):
    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % o.buckets for k in range(1, o.order + 1) for i in range(len(w) - k + 1)]

    s, t = ([0] * o.buckets for _ in range(2))
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in grams(x):
                side[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + o.buckets) / ((a + 1) * (sum(t) + o.buckets)))) for a, b in zip(s, t)]
    rows = []
    for key, x in docs:
        g = grams(x)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{o.seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    fit = sorted((r for r in rows if r[1] >= o.min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: len(fit) * o.percent // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=str)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "Bé", "c9", "日本", "x" * 70, "É", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "__", "\x00"]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(150)] + [(150, None), (151, ""), (None, text(9)), (152, "日" * 300 + " a")]
    docs += docs[3:6]
    target = [text(12), None, "", "a a a"]
    for o in (Resampling(2, 97, 3, 25), Resampling(3, 10_000, 1, 60, 11), Resampling(1, 5, 0, 100)):
        got = importance.resample_documents(
            spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), o
        )
        rows = got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
        assert sorted(map(tuple, rows), key=str) == brute(docs, target, o)


def test_long_texts_are_cut_between_words():
    text = "ab, " * 50_000 + "q" * 100_000 + " é日 " * 1000
    assert "".join(importance.chunks(text)) == text
    found = importance._Words()
    found.add(text)
    assert found.count == [len(words(text))]


def test_odd_rows_and_clashing_columns(spark, odd, empty):
    from pyspark.sql import functions as F

    named = odd.withColumns({c: F.lit(5) for c in ("key", "row", "rank", "fit", "buckets", "_slice", "_pos", "_", "weight")})
    got = importance.resample_documents(named, odd.filter("doc_id = 1"), Resampling(min_words=1))
    assert got.count() == odd.count()
    assert set(got.columns) == {*named.columns, "n_words", "n_features", "score"}
    r = got.filter("doc_id = 2").first()
    assert (r.n_words, r.n_features, r.weight, r["key"], r["_slice"]) == (0, 0, 0, 5, 5) and r["rank"] is None
    assert got.filter("doc_id = 5").first().n_words == 40_000
    assert importance.resample_documents(empty, odd).count() == 0
    assert importance.resample_documents(odd, empty, Resampling(min_words=0, percent=100)).filter("rank is null").count() == 0
