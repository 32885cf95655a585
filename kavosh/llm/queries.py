"""The registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontamination, id_files, jaccard_join, lm_score, nearest, quality, secrets, suffix_dedup, token_counts
from .common import read


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(byte_bpe.encode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), decoded=True))


def op3_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = id_files.folder(spark)
    id_files.write(read(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"), end=2)
    return id_files.digests(id_files.read_back(spark, path, packed=True))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs, lm_score.fit(docs)).drop("text")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES = {f.__name__: f for f in (op1_jaccard_join, op2_byte_bpe, op3_id_files, op4_secrets, op5_nearest, op6_quality, op7_decontamination, op8_lm_score, op9_suffix_dedup, op10_token_counts)}
SQL: dict[str, str] = {
    "op1_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w, ' ') AS words, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS sh FROM t WHERE len(w) > 0),
e AS (SELECT doc_id, words, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.words) AS wa, any_value(b.words) AS wb FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-6),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM r GROUP BY a),
c AS (SELECT a AS doc_id, count(*) AS n_links, count(DISTINCT wb) FILTER (wa <> wb) AS n_texts FROM p GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_texts FROM k LEFT JOIN c USING (doc_id)""",
    "op7_decontamination": r"""
WITH every AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
t AS (SELECT kind, id, list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '\S+'), lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), lambda x: x <> '') AS w FROM every),
i AS (SELECT id AS item_id, least(5, len(w)) AS k, list_distinct(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS sh FROM t WHERE kind = 1 AND len(w) > 0),
q AS (SELECT item_id, k, len(sh) AS n_item, unnest(sh) AS x FROM i),
d AS (SELECT DISTINCT id AS doc_id, k, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS x FROM t, (SELECT DISTINCT k FROM i) WHERE kind = 0)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item)::DOUBLE AS containment FROM q JOIN d USING (k, x) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item) - 1e-9""",
}
