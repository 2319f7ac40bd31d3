"""URL rules in a sorted array of 64-bit digests.

The keys (host and path of each rule) are hashed with xxhash, sorted, and written to one file that
Spark hands to every executor. A task memory-maps it, hashes the host suffixes and path prefixes of
its URLs, finds them by binary search for a whole batch at once, and compares the stored strings,
so two keys with one digest are no fault.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.files import publish, with_fields

SEED = 42  # of Spark's xxhash64, so that both sides can be made in SQL as well
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, text: str) -> Rule:
        """From `block example.com/en/`."""
        action, key = text.split(" ", 1)
        host, slash, path = key.partition("/")
        return cls(action, host, slash + path)

    @property
    def key(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, ALPHABET, ALPHABET.lower()), path


def digests_file(rules: Iterable[Rule]) -> bytes:
    """Sorted digests, then the offsets and bytes of the keys, host lengths and actions."""
    by_key: dict[str, Rule] = {}
    for r in rules:
        if by_key.setdefault(r.key, r).action != r.action:
            raise ValueError(f"two actions for {r.key!r}")
    keyed = sorted((xxhash.xxh64_intdigest(k.encode(), SEED), k) for k in by_key)
    blobs = [k.encode() for _, k in keyed]
    actions = [by_key[k].action.encode() for _, k in keyed]
    ends = lambda parts: np.cumsum([0, *map(len, parts)]).astype("<u8").tobytes()
    return b"".join(
        [
            np.array([len(keyed)], "<u8").tobytes(),
            np.array([h for h, _ in keyed], "<u8").tobytes(),
            ends(blobs),
            np.array([len(by_key[k].host.encode()) for _, k in keyed], "<u8").tobytes(),
            ends(actions),
            *blobs,
            *actions,
        ]
    )


class Digests:
    """The memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        n = int(raw[:8].view("<u8")[0])
        words = raw[8 : 8 + 8 * (4 * n + 2)].view("<u8")
        self.keys, self.at = words[:n], words[n : 2 * n + 1]
        self.host_len, self.action_at = words[2 * n + 1 : 3 * n + 1], words[3 * n + 1 :]
        self.text = raw[8 + 8 * (4 * n + 2) :]
        self.actions_from = int(self.at[-1])
        self.path_lengths = np.unique(np.diff(self.at.astype(np.int64)) - self.host_len.astype(np.int64)).tolist()

    def key(self, i: int) -> bytes:
        return self.text[int(self.at[i]) : int(self.at[i + 1])].tobytes()

    def action(self, i: int) -> str:
        a, b = (self.actions_from + int(x) for x in self.action_at[i : i + 2])
        return self.text[a:b].tobytes().decode()

    def find(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Number of the longest rule that fits each host and path, -1 for none."""
        rows, keys = [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            h, p = host.encode(), path.encode()
            cut = 0
            while True:
                # a rule's host is the whole host or what follows one of its dots
                for n in self.path_lengths:
                    if n <= len(p):
                        rows.append(row)
                        keys.append(h[cut:] + p[:n])
                dot = h.find(b".", cut)
                if dot < 0:
                    break
                cut = dot + 1
        probes = np.array([xxhash.xxh64_intdigest(k, SEED) for k in keys], dtype=np.uint64)
        found = np.searchsorted(self.keys, probes)
        ok = found < len(self.keys)
        ok[ok] = self.keys[found[ok]] == probes[ok]
        best, size = [-1] * len(hosts), [(-1, -1)] * len(hosts)
        for j in np.flatnonzero(ok).tolist():
            i, row = int(found[j]), rows[j]
            while i < len(self.keys) and self.keys[i] == probes[j]:
                h = hosts[row].encode()
                n = int(self.host_len[i])
                if self.key(i) == keys[j] and (h[len(h) - n :] == keys[j][:n]):
                    if (now := (len(keys[j]), n)) > size[row]:
                        best[row], size[row] = i, now
                i += 1
        return best


def judge_urls(
    pages: DataFrame, rules: Iterable[Rule], url: str = "url", default: str = "allow", max_rules: int = 20_000_000
) -> DataFrame:
    """Adds `host`, `path`, `rule` (null without one) and `verdict` to every row; columns of these
    names are replaced.

    A rule fits its host and all subdomains of it where the path starts with the rule's path. The
    longest fitting key wins, of equal ones that with the longer host. Without a fitting rule the
    verdict is `default`. A null URL or one without `://` has an empty host and path; no rule with
    a host fits it. Repeated rows are judged alike, an empty table gives an empty table. The list is
    held by the driver once and refused above `max_rules`; use `judge_urls_by_join` then.
    """
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; more than {max_rules} need judge_urls_by_join")
    spark = pages.sparkSession
    name = publish(spark, "url-digests", digests_file(rules))
    host, path = host_and_path(F.col(url))
    out = ["host", "path", "rule", "verdict"]
    rows = pages.drop(*out).withColumns({"host": host, "path": path})
    schema = with_fields(rows.schema, "rule string, verdict string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for b in batches:
            found = digests.find(b.column("host").to_pylist(), b.column("path").to_pylist())
            rule = pa.array([digests.key(i).decode() if i >= 0 else None for i in found], pa.string())
            verdict = pa.array([digests.action(i) if i >= 0 else default for i in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], names=[*b.schema.names, "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The same for a list too large for one machine: `rules` has action, host and path, and the
    host suffixes and path prefixes of distinct hosts and paths are joined with it."""
    out = ["host", "path", "rule", "verdict"]
    host, path = host_and_path(F.col(url))
    rows = pages.drop(*out).withColumns({"host": host, "path": path})
    lengths = rules.agg(F.sort_array(F.collect_set(F.octet_length("path"))).alias("_n"))
    labels = F.split("host", r"\.")
    probes = (
        rows.select("host", "path").distinct().crossJoin(F.broadcast(lengths))  # one row
        .select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_h"), "_n")
        .select("host", "path", "_h", F.explode(F.filter("_n", lambda n: n <= F.octet_length("path"))).alias("_n"))
        .select("host", "path", "_h", F.expr("decode(substring(encode(path, 'utf-8'), 1, _n), 'utf-8')").alias("_p"))
    )
    keyed = rules.select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("action").alias("_a"))
    size = F.struct(F.octet_length("_h") + F.octet_length("_p"), F.octet_length("_h"))
    best = (
        probes.join(keyed, ["_h", "_p"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_a").alias("verdict")), size).alias("_b"))
        .select("host", "path", "_b.*")
    )
    return rows.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default))).select(*[c for c in pages.columns if c not in out], *out)
