import numpy as np

from tidewatch.llm import embeddings


def brute(rows, threshold=0.9):
    ok = {}
    for i, (k, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float64)
            ok[i] = a / np.sqrt((a * a).sum())
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold} for i in ok}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        c = min(rows[j][0] for j in seen)
        out.append((k, len(links.get(i, ())), c, k == c))
    return sorted(out)


def vectors(n=500, d=16, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    rows = [b + rng.normal(scale=s, size=d) for b in base for s in (0, 0, 0.15, 0.45)]
    hub = base[0] + rng.normal(scale=0.25, size=(60, d))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*rows, *hub])]


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.similar_vectors(df, **more).collect())


def test_against_brute_force(spark, monkeypatch):
    rows = vectors()
    want = brute(rows)
    got = run(spark, rows)
    links, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.95 * all_links <= links <= all_links
    assert run(spark, rows, recall=1.0) == want
    # small blocks cut every hot cell, and change nothing
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    assert run(spark, rows, recall=1.0) == want


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (10, [1.0, 0.0, 0.0]), (11, [-3.0]), (12, [5.0])]
    assert run(spark, rows) == brute(rows)
    twice = spark.createDataFrame([(1, [1.0, 0.0], "x")] * 3, "vec_id bigint, embedding array<float>, dim string")
    assert {(r.n_links, r.component_id) for r in embeddings.similar_vectors(twice).collect()} == {(2, 1)}
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert embeddings.similar_vectors(none).count() == 0


def test_walk_is_in_order():
    v = embeddings.unit(np.array([r[1] for r in vectors()]))
    index = embeddings.Index.fit(v, len(v), 0.9, 0.95)
    cells = np.arange(len(index.books[0]) * len(index.books[1]))
    a, b = index.distances(v)
    for i, walk in enumerate(index.walk(v)):
        s = (a[i][:, None] + b[i][None, :]).ravel()[walk]
        assert (np.diff(s) >= -1e-12).all() and set(walk) == set(cells[index.sees(v[i : i + 1], cells)[0]])


def test_groups_of_cells(spark, monkeypatch):
    """A vector moves once for each group, however many cells it visits, and every two meet in one task."""
    rows = vectors()
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    cells = [(i, 1, 2, i % 7, b"") for i in range(300)]
    placed = spark.createDataFrame(cells, "rep bigint, w bigint, dim int, home bigint, code binary")
    tasks = {}
    for r in embeddings._dealt(placed, 5).collect():
        tasks.setdefault((r.g, r.h), ([], []))[not r.first].append(r.rep)
    assert sum(len(a) + len(b) for a, b in tasks.values()) == 5 * 300
    met = [tuple(sorted((x, y))) for (g, h), (a, b) in tasks.items() for k, x in enumerate(a) for y in (a[k + 1 :] if g == h else b)]
    assert len(met) == len(set(met)) == 300 * 299 // 2
    # many groups, chunks of a few vectors and links that are joined as they come change nothing
    for name, value in (("GROUP_ROWS", 40), ("CHUNK", 16), ("PAIRS", 50)):
        monkeypatch.setattr(embeddings, name, value)
    assert run(spark, rows, recall=1.0) == brute(rows)
