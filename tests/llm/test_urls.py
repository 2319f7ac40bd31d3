import random

from tidewatch.llm import registry, urls

RULES = [urls.Rule.parse(r) for r in registry.RULES]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = host.encode().lower().decode()
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.key.encode()), len(r.host.encode())), default=None)
    return host, path, best and best.key, best.action if best else default


CASES = [
    None, "", "no scheme", "http://", "://", "http://Example.COM/en/x", "http://www.example.com/en/1?q#f", "https://a.www.example.com/en/",
    "http://badexample.com/en/", "http://x.net/es/1", "http://net/es/", "http://x.net/es", "http://x.net?/es/", "http://x.com#/", "ftp://e.com",
    "http://..com/", "http://.com/", "http://a://b.com/", "http://é.net/fr/ü", "http://x.net/fr/" + "z" * 100_000, "http://x\ny.com/",
]


def test_cases(spark):
    pages = spark.createDataFrame([(i, u, "other") for i, u in enumerate(CASES * 2)], "page_id bigint, url string, host string")
    want = [brute(u, RULES) for u in CASES * 2]
    got = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, RULES).orderBy("page_id").collect()]
    assert got == want
    table = spark.createDataFrame([(r.action, r.host, r.path) for r in RULES], "action string, host string, path string")
    joined = [(r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls_by_join(pages, table).orderBy("page_id").collect()]
    assert joined == want
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, [], default="block").collect()} == {"block"}


def test_many_rules_and_equal_digests(spark, monkeypatch):
    rng = random.Random(8)
    rules = list({r.key: r for r in (urls.Rule(rng.choice(["allow", "block"]), f"h{rng.randint(0, 40)}.t{rng.randint(0, 4)}", rng.choice(["", "/", "/a/", "/é/", "/a/b"])) for _ in range(150))}.values())
    cases = [f"http://{rng.choice(['', 'w.', 'a.b.'])}h{rng.randint(0, 40)}.t{rng.randint(0, 4)}{rng.choice(['', '/', '/a/', '/a/bc', '/é/x', '?a'])}" for _ in range(400)]
    want = [brute(u, rules) for u in cases]
    blob = urls.digests_file(rules)
    check = lambda blob: _judge(blob, want)
    assert check(blob) == [(w[2], w[3]) for w in want]
    # every key with the same digest: the stored strings decide
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda *a: 7)
    assert check(urls.digests_file(rules)) == [(w[2], w[3]) for w in want]


def _judge(blob, want):
    import tempfile

    with tempfile.NamedTemporaryFile() as f:
        f.write(blob)
        f.flush()
        d = urls.Digests(f.name)
        found = d.find([w[0] for w in want], [w[1] for w in want])
        return [(d.key(i).decode(), d.action(i)) if i >= 0 else (None, "allow") for i in found]
