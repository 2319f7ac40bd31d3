import random
import zlib
from collections import defaultdict

from tidewatch.llm import sharding


def test_differencing_is_tight():
    rng = random.Random(4)
    sizes = [rng.randint(1, 1000) for _ in range(500)]
    where, sums = sharding.difference_items(sizes, 8)
    again = [0] * 8
    for s, w in zip(sizes, where):
        again[w] += s
    assert again == sums and max(sums) - min(sums) <= 8
    assert sharding.difference_items([8, 7, 6, 5, 4], 2)[1] in ([14, 16], [16, 14])  # the textbook case
    assert sharding.difference_items([], 3) == ([], [0, 0, 0])


def test_documents(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(sharding, "FINE", 20)
    rng = random.Random(6)
    texts = [None, ""] + ["hot copy"] * 150 + ["t" * rng.randint(0, 400) + str(rng.randint(0, 9)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, shard string").repartition(5)
    rows = sharding.shard_documents(docs, 6).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    shards, groups, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        shards[r.shard] += r.size
        groups[texts[r.doc_id] or ""].add(r.shard)
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(shards) == 6 and max(shards.values()) - min(shards.values()) <= 60
    assert sharding.shard_documents(odd, 3).count() == 9
    assert sharding.shard_documents(empty, 3).count() == 0


def test_group_above_the_mean(spark):
    docs = spark.createDataFrame([(i, "x" * 500 if i < 50 else f"y{i}") for i in range(90)], "doc_id bigint, text string")
    total = defaultdict(int)
    for r in sharding.shard_documents(docs, 4).collect():
        total[r.shard] += r.size
    a, *rest = sorted(total.values(), reverse=True)
    assert a == 50 * 508 and max(rest) - min(rest) <= 11
