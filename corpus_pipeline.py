"""A corpus pipeline of five operators: every stage takes the documents that the one before it kept.

The stages drop toxic documents, repeated lines, near copies and benchmark passages, and encode what
is left. All of them work on whole texts and on every row; rows with a null key are never dropped as
copies. A stage hands a document's columns through the operator in one struct, so columns of any
name come out as they went in. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import contamination, jaccard, line_dedup, pieces, toxicity
from tidewatch.llm.files import stored
from tidewatch.session import tune


OWN = "own columns"


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns as one."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias(OWN))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of this stage's own documents, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = packed(docs)
    scored = toxicity.score_toxicity(own, own, labels, keep=[OWN])
    return scored.filter(F.col("predicted") == 0).select(f"`{OWN}`.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 and more characters found in three documents stay in the last of them only."""
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias(OWN)
    cut = line_dedup.drop_repeated_lines(docs.select("doc_id", "text", rest))
    text = F.when(F.col("text").isNotNull(), F.col("kept"))
    new = cut.select("doc_id", text.alias("text"), (F.col("n_dropped") > 0).alias("changed"), OWN)
    n_chars = F.when(F.col("changed"), F.char_length("text")).otherwise(F.col(OWN)["n_chars"]).cast(docs.schema["n_chars"].dataType)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": n_chars}
    return new.select(*[own.get(c, F.col(OWN)[c]).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 in five words, the smallest doc_id stays."""
    found = jaccard.jaccard_components(docs, jaccard.Similarity(5, 80)).filter(F.col("doc_id") != F.col("component_id"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are words of benchmark passages go."""
    hits = contamination.contaminated_words(packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=[OWN])
    return hits.filter(~contamination.is_contaminated()).select(f"`{OWN}`.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the piece ids of the text, their number and crc32."""
    return pieces.encode_pieces(docs, pieces.Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: The toxicity model cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written down and read by the next."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
