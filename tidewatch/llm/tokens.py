"""Token ids of a corpus in files of independently coded blocks.

Documents are range-partitioned by key, tokenized in the tasks, and packed into blocks of whole
documents. A block is one row of a Parquet data set: its place (part, seq), the keys and lengths of
its documents, and the coded ids (see `coder`). Any block can be decoded alone, and the order of
the blocks is the order of the keys.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm import coder

BLOCK_IDS = 1 << 20
_ASCII = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
_WORD_END = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
_LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of whole texts from a tokenizer file, remembering words.

    The tokenizer drops white space and looks at no text across it, so a text's ids are those of its
    words. Letters followed by ASCII punctuation are two words to it as well. A word of Latin letters
    is one piece to its splitting rule and needs only the model. The memory is bounded and changes
    no result.
    """

    def __init__(self, path: str, remember: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remember = Tokenizer.from_file(path), remember
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        parts, known, model = self.parts, self.known, self.model.tokenize
        rest: dict[bytes, list[str]] = {}
        for w in words:
            if m := _ASCII(w):
                letters, end = m.groups()
                letters = letters.lower()
                if (x := parts.get(letters)) is None:
                    parts[letters] = x = array("I", [p.id for p in model(letters.decode())]).tobytes()
                if not end:
                    known[w] = x
                    continue
                if (y := parts.get(end)) is not None:
                    known[w] = x + y
                    continue
            t = w.decode()
            m = _WORD_END.fullmatch(t)
            rest[w] = list(m.groups()) if m and "İ" not in t else [t]
        new = {x for p in rest.values() for x in p}.difference(self.others)
        for x in [x for x in new if _LATIN.fullmatch(x)]:
            letters = x.lower().encode().decode("latin-1").translate(self.letters)
            self.others[x] = array("I", [p.id for p in model(letters)]).tobytes()
        new = list(new.difference(self.others))
        for x, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.others[x] = array("I", e.ids).tobytes()
            if x.isascii():
                parts[x.encode()] = self.others[x]
        for w, p in rest.items():
            known[w] = b"".join([self.others[x] for x in p])

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        if new := set(words).difference(self.known):
            if len(self.known) + len(new) > self.remember:
                self.known, self.parts, self.others = {}, {}, {}
                new = set(words)
            self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4")


def write_blocks(
    docs: DataFrame, path: str, encoder: Callable[[], Encoder], key: str = "doc_id", text: str = "text", end_id: int | None = 1, block_ids: int = BLOCK_IDS
) -> None:
    """Encode every whole text and write the blocks in ascending order of `key`.

    `encoder` makes, in a task, a function from text to ids with an attribute `vocabulary`. A null
    text is empty. `end_id` is appended to each document. Rows with one key stay next to each
    other, ordered by a hash of the text; null keys come first. A document longer than `block_ids`
    has a block to itself. An empty table writes no block.
    """
    spark = docs.sparkSession
    n = docs.rdd.getNumPartitions()  # large parts repeat more words
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").select("key", "text")
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        part = TaskContext.get().partitionId()
        vocabulary = max(encode.vocabulary, (end_id or 0) + 1)
        end = np.array([] if end_id is None else [end_id], np.int64)
        keys, ids, held, seq = [], [], 0, 0

        def block(arrow_type) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([seq], pa.int64()),
                    pa.array([held], pa.int64()),
                    pa.array([keys], pa.list_(arrow_type)),
                    pa.array([[len(x) for x in ids]], pa.list_(pa.int64())),
                    pa.array([coder.encode(np.concatenate(ids), vocabulary)], pa.binary()),
                ],
                names=["part", "seq", "n_tokens", "keys", "lengths", "block"],
            )

        arrow_type = None
        for b in batches:
            arrow_type = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.concatenate([encode(t.as_py()), end])
                if keys and held + len(x) > block_ids:
                    yield block(arrow_type)
                    keys, ids, held, seq = [], [], 0, seq + 1
                keys.append(k)
                ids.append(x)
                held += len(x)
        if keys:
            yield block(arrow_type)

    schema = f"part int, seq bigint, n_tokens bigint, keys array<{kind}>, lengths array<bigint>, block binary"
    rows.mapInArrow(run, schema).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def block_starts(blocks: DataFrame) -> DataFrame:
    """part, seq and the number of ids before each block. Only the parts, one row each, meet in one
    task; a part's blocks are counted on their own."""
    sizes = blocks.select("part", "seq", "n_tokens")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    own = sizes.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_i"))
    return own.join(F.broadcast(parts), "part").select("part", "seq", (F.col("_o") + F.col("_i")).alias("start"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The documents of the blocks: key, start (ids before it in all), n_tokens, ids_crc32 (of the
    ids as little-endian 32-bit integers) and, where wanted, ids. A damaged block fails the read."""
    blocks = read_blocks(spark, path)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, seq, lengths = (b.column(c)[i].as_py() for c in ("part", "seq", "lengths"))
                keys = b.column("keys")[i].values
                raw = coder.decode(b.column("block")[i].as_py()).astype("<u4")
                at = np.cumsum([0, *lengths])
                each = [raw[x:y] for x, y in zip(at[:-1], at[1:])]
                columns = {
                    "part": pa.array(np.full(len(each), part, np.int32)),
                    "seq": pa.array(np.full(len(each), seq, np.int64)),
                    "key": keys,
                    "inside": pa.array(at[:-1], pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"part int, seq bigint, key {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    docs = blocks.select("part", "seq", "keys", "lengths", "block").mapInArrow(run, schema)
    out = ["key", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return docs.join(block_starts(blocks), ["part", "seq"]).select(*out)
