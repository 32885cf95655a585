"""The corpus pipeline: five stages over the documents, each written and read again before the next one.

A stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the columns of documents; the
last adds the token ids (`ids`, `n_tokens`; input columns of these two names are replaced, all others stay as they are).

- Null and empty texts have the classifier's bias for a score; those that are kept are no copies of anything, contain no
  item and no secret, and have no ids. A null text stays null.
- Very long texts are judged, searched and encoded whole.
- Rows without a doc_id are judged like others: their texts have copies, items and secrets, too.
- Repeated rows are copies: one stays. Of rows that share a doc_id but not a text each is judged by its own text.
- Ties: of equal documents the one with the smallest doc_id stays (null ids last).
- An empty table of documents gives an empty result; without labels every score is 0.5 and all documents stay; without
  items of a benchmark nothing is removed for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.llm import byte_bpe, decontamination, jaccard_join, quality, secrets
from kavosh.llm.common import free_name, read, written
from kavosh.llm.queries import tokenizer

#: Documents that score less are rejected: the classifier's own cut.
LEAST_QUALITY = 0.3
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier (6) rejects."""
    weights, score = quality.fit(docs, read(spark, sf_dir, "labels")), free_name(docs, "score")
    return quality.score(docs, weights, out=score).where(F.col(score) >= LEAST_QUALITY).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of the n-gram Jaccard join (1)."""
    return jaccard_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain an item of the benchmark (7)."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret (4); n_chars follows where a text changed."""
    before = free_name(docs, "_before")
    found = secrets.redact(docs.withColumn(before, F.length("text")))
    return found.withColumn("n_chars", F.when(F.length("text").eqNullSafe(F.col(before)), F.col("n_chars")).otherwise(F.length("text").cast("long"))).drop(before)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the ids of each text by byte-level BPE (2), and their number."""
    encoded = byte_bpe.encode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"))
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("byte-level BPE encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of documents that all stages keep, with their columns, ids and n_tokens: see above."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{i}")
    return docs
