"""Shards of nearly equal bytes by Karmarkar-Karp differencing.

Rows with one text form a group that stays whole. Differencing starts with every group as a partial
partition with one filled shard; the two of largest spread are combined again and again, the fullest
shards of one with the emptiest of the other, until one is left. Small groups are dealt to buckets
by their digest and differenced there, in tasks, into bundles of nearly equal bytes. The bundles and
the largest groups, some thousands, are then differenced together on the driver, so that they fill up
what a very large group leaves uneven.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.files import stored, with_fields

PER_BUCKET = 200_000  # groups that one task differences at most
FINE = 500  # largest groups for each shard, and buckets of bundles, that are differenced together


def difference(parts: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions (shard sizes each) into one by Karmarkar-Karp; the result has for
    every part the final shard of each of its shards."""
    if not parts:
        return []
    k = len(parts[0])
    # sizes are kept in falling order, with the shard each of them has in the part
    nodes = []
    for p in parts:
        order = sorted(range(k), key=lambda s: (-p[s], s))
        nodes.append(([p[s] for s in order], order))
    heap = [(s[-1] - s[0], i) for i, (s, _) in enumerate(nodes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = nodes[a][0], nodes[b][0]
        sums = [x[s] + y[k - 1 - s] for s in range(k)]
        order = sorted(range(k), key=lambda s: (-sums[s], s))
        nodes.append(([sums[s] for s in order], order))
        nodes[a], nodes[b] = (None, nodes[a][1]), (None, nodes[b][1])  # the sizes are spent
        merged.append((len(nodes) - 1, a, b, order))
        heapq.heappush(heap, (nodes[-1][0][-1] - nodes[-1][0][0], len(nodes) - 1))
    # from the last node down: `final[n][s]` is the shard of the s-th fullest of node n
    final: list[list[int] | None] = [None] * len(nodes)
    final[heap[0][1]] = list(range(k))
    for node, a, b, order in reversed(merged):
        own = [0] * k
        for rank, s in enumerate(order):
            own[s] = final[node][rank]
        final[a], final[b] = own, own[::-1]
        final[node] = None
    out = []
    for i in range(len(parts)):
        shard = [0] * k
        for rank, s in enumerate(nodes[i][1]):
            shard[s] = final[i][rank]
        out.append(shard)
    return out


def difference_items(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """Shard of each size, and the sums of the shards."""
    where = [f[0] for f in difference([[n] + [0] * (shards - 1) for n in sizes])]
    sums = np.zeros(shards, np.int64)
    np.add.at(sums, where, sizes)
    return where, sums.tolist()


def assign_shards(rows: DataFrame, group: str, size: str, shards: int) -> DataFrame:
    """Adds `shard` (0 to shards-1) such that rows with one value of `group` (a digest, not null)
    share a shard and the sums of `size` are nearly equal. A group above the mean fills its shard
    alone with it. Repeated rows count each. An empty table gives an empty table."""
    spark = rows.sparkSession
    sums = stored(rows.groupBy(group).agg(F.sum(size).cast("bigint").alias("_bytes")), "shard-groups")
    groups = sums.count()
    buckets = max(1, -(-groups // PER_BUCKET), min(FINE, groups // (2 * shards)))
    large = sums.orderBy(F.desc("_bytes"), group).limit(shards * FINE).toPandas()
    rest = F.lit(False)
    if groups > len(large):
        n, g = int(large["_bytes"].iloc[-1]), F.lit(large[group].iloc[-1])
        rest = (F.col("_bytes") < n) | ((F.col("_bytes") == n) & (F.col(group) > g))
    small = sums.filter(rest).withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(buckets)).cast("int"))

    def bundle(pdf: pd.DataFrame) -> pd.DataFrame:
        # falling sizes, then digests: the result does not depend on the order of arrival
        pdf = pdf.sort_values(["_bytes", group], ascending=[False, True], ignore_index=True)
        pdf["_part"], _ = difference_items(pdf["_bytes"].tolist(), shards)
        return pdf

    dealt = stored(small.groupBy("_bucket").applyInPandas(bundle, with_fields(small.schema, "_part int")), "shard-bundles")
    # `shards` rows for a bucket
    bundles = dealt.groupBy("_bucket", "_part").agg(F.sum("_bytes").alias("_bytes")).orderBy("_bucket", "_part").toPandas()
    where, _ = difference_items([*large["_bytes"].tolist(), *bundles["_bytes"].tolist()], shards)
    of_large = [(g, w) for g, w in zip(large[group], where)]
    of_bundle = [(int(b), int(p), w) for b, p, w in zip(bundles["_bucket"], bundles["_part"], where[len(large) :])]
    place = spark.createDataFrame(of_bundle, "_bucket int, _part int, shard int")
    named = spark.createDataFrame(of_large, f"{group} {sums.schema[group].dataType.simpleString()}, shard int")
    found = dealt.join(F.broadcast(place), ["_bucket", "_part"]).select(group, "shard").union(named)
    return rows.drop("shard").join(found, group)


def with_slots(rows: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """Adds `slot`, the place of a row in its shard from 0, in the given order. A shard may be
    larger than a task: rows are range-partitioned, and each partition counts on from those before."""
    n = max(rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    s = rows.drop("slot").repartitionByRange(n, shard, *order).sortWithinPartitions(shard, *order)
    s = stored(s.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "slots")
    counts = s.groupBy("_p", shard).agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_first"))
    before = W.partitionBy(shard).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    # at most one row for each partition and shard that meet, about n + shards rows
    offsets = counts.select("_p", shard, "_first", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    return s.join(F.broadcast(offsets), ["_p", shard]).withColumn("slot", F.col("_o") + F.col("_m") - F.col("_first")).drop("_p", "_m", "_o", "_first")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows in shards of nearly equal bytes: key, size (UTF-8 bytes of the text and 8),
    text_crc32, law `bytes`, shard, slot and grown_shard (null: this law keeps no promise about one
    more shard). Rows with equal texts share a shard; null counts as the empty text."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("bigint").alias("size"),
        F.crc32(F.encode(body, "utf-8")).alias("text_crc32"),
        text_digest(F.col(text)).alias("_group"),
    )
    placed = with_slots(assign_shards(rows, "_group", "size", shards), "shard", [key, "_group"])
    return placed.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
