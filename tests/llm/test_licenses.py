import random

from tidewatch.llm import licenses


def corpus(spark):
    rng = random.Random(9)
    words = ["the", "of", "in", "under", "this", "is", "on", *["".join(rng.choice(["ta", "re", "on", "li"]) for _ in range(3)) for _ in range(80)]]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(3, 20))) + "."
    rows, want = [], {}
    for i in range(300):
        lines = [line() for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            family = rng.choice(sorted(licenses.NOTICES))
            lines.insert(rng.randrange(len(lines) + 1), rng.choice([t for t in licenses.NOTICES[family] if len(t) > 30]))
            want[i] = family
        rows.append((i, "\n".join(lines)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), want


def test_families(spark):
    docs, want = corpus(spark)
    got = {r.doc_id: r.families for r in licenses.license_families(docs).collect()}
    assert len(got) == 300
    wrong = [i for i, f in got.items() if f != want.get(i, "unknown")]
    assert len(wrong) <= 3 and not [i for i in wrong if i not in want]


def test_native(spark):
    docs, _ = corpus(spark)
    plan = licenses.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_odd_rows(spark, odd, empty):
    more = odd.selectExpr("*", "1 AS key", "2 AS words", "3 AS family")
    got = licenses.license_families(more).collect()
    assert len(got) == 9 and {r.families for r in got} == {"unknown"}
    assert licenses.license_families(empty).count() == 0


def test_ordinary_wording_calibrates(spark):
    """Ordinary lines that share wording with notices are trained on, and move the threshold."""
    rng = random.Random(4)
    plain = lambda k: [" ".join("".join(rng.choice(["ta", "re", "on", "li"]) for _ in range(3)) for _ in range(8)) for _ in range(k)]
    shared = ["the builds come in source and binary form for every platform we support today", "members under the terms of the club may use the hall"]
    some = lambda n, extra: spark.createDataFrame([(i, "\n".join([*plain(3), *extra[i % 2 : i % 2 + 1]])) for i in range(n)], "doc_id bigint, text string")
    rows = licenses.ordinary(some(400, shared), "doc_id", "text", 0).collect()
    assert {" ".join(r.words) for r in rows} >= set(shared)
    notice = licenses.NOTICES["mit"][1]
    assert notice.lower() not in {" ".join(r.words) for r in licenses.ordinary(some(400, [notice, shared[0]]), "doc_id", "text", 0).collect()}
    weights, families, intercepts = licenses.train(some(400, shared), "doc_id", "text")
    grams = {r.gram for r in weights.collect()}
    own = {g for r in licenses.notices(spark).select(licenses.ngrams(licenses.F.col("words")).alias("g")).collect() for g in r.g}
    assert grams - own
    held = lambda lines: spark.createDataFrame([(t,) for t in lines], "line string").select(licenses.words(licenses.F.col("line")).alias("words"))
    assert licenses.calibrated(held(plain(20)), weights, families, intercepts) == licenses.LEAST
    near = licenses.calibrated(held(["released under the license of the gnu public domain project for everyone here"]), weights, families, intercepts)
    assert near > licenses.LEAST


def test_every_paragraph_counts(spark):
    """No document is left out: all are trained on or calibrate, and a wording of any number of them counts."""
    text = lambda i: f"plain line {i} of the\nunder the terms of the house {'may use' if i % 7 else 'use may'} x{i}"
    docs = spark.createDataFrame([(i, text(i)) for i in range(1500)], "doc_id bigint, text string")
    rows = [[" ".join(r.words) for r in licenses.ordinary(docs, "doc_id", "text", held).collect()] for held in (0, 1)]
    assert sorted(rows[0] + rows[1]) == sorted(x for i in range(1500) for x in text(i).split("\n"))
    assert len(rows[0]) > 2000 and len(rows[1]) > 400


def test_own_ngrams(spark):
    """The n-grams of the notices' words are those of all n-grams that have no other word."""
    rng = random.Random(2)
    lines = [" ".join(rng.choice(["the", "of", "use", "license", "house", "a|b", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    of = licenses.words(licenses.F.col("line"))
    rows = spark.createDataFrame([(t,) for t in lines], "line string").select(of.alias("words"))
    for r in rows.select(licenses.ngrams(licenses.F.col("words")).alias("a"), licenses.own_ngrams(licenses.F.col("words")).alias("b")).collect():
        assert sorted(r.b) == sorted(g for g in r.a if set(g.split(" ")) <= set(licenses.OWN))
