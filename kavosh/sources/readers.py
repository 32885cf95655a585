"""Sources and sinks: column-pruned Parquet, tab- and comma-separated lines, JSON lines, treebanks, word lists, sites."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "title", "body")])
QUERY = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "corpus", "base", "target", "type", "subtype", "lemma", "text")])


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def tab_lines(spark: SparkSession, path: str, names: list[str], header: bool = True) -> DataFrame:
    """Lines with exactly so many tab-separated fields; quotes mean nothing. The header is the line equal to `names`."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(fields) == len(names))
    out = rows.select(*(fields[i].alias(n) for i, n in enumerate(names)))
    return out.where(~F.concat_ws("\t", *names).eqNullSafe("\t".join(names))) if header else out


def comma_lines(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Comma-separated lines with quotes doubled inside; lines of another number of fields are dropped."""
    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in names), T.StructField("_bad", T.StringType())])
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", enforceSchema=True)
    return rows.where(F.col("_bad").isNull()).drop("_bad")


def second_field(spark: SparkSession, path: str) -> DataFrame:
    """The second field of each line, as commas alone have it."""
    return spark.read.text(path).select(F.get(F.split("value", ","), F.lit(1)).alias("value")).where("value is not null")


def json_lines(spark: SparkSession, path: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    return spark.read.schema(schema).json(path)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """token, n of tab-separated counts."""
    return spark.read.csv(path, sep="\t", schema="token string, n long", quote="")


def write_counts(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("token", "n").write.mode("overwrite").csv(path, sep="\t", quote="")


def verb_pairs(spark: SparkSession, path: str) -> DataFrame:
    """past, present of past#present lines; lines that start with # are comments."""
    lines = spark.read.text(path).where("value like '%#%' and value not like '#%'")
    parts = F.split("value", "#")
    return lines.select(parts[0].alias("past"), parts[1].alias("present"))


def treebank(spark: SparkSession, path: str) -> DataFrame:
    """sent_id, pos, form, lemma, upos, feats, misc of CoNLL-U files; a multiword token stands for its words."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)

    def kernel(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["sent_id", "pos", "form", "lemma", "upos", "feats", "misc"]
        for frame in frames:
            rows = []
            for block in frame["value"]:
                sent, span, pos = "", (0, 0), 0
                for line in block.split("\n"):
                    if line.startswith("# sent_id"):
                        sent = line.partition("=")[2].strip()
                    f = line.split("\t")
                    if line.startswith("#") or len(f) != 10 or "." in f[0]:
                        continue
                    if "-" in f[0]:
                        a, b = f[0].split("-")
                        span, form, misc = (int(a), int(b)), f[1], f[9]
                        continue
                    n = int(f[0])
                    if span[0] < n <= span[1]:
                        continue
                    pos += 1
                    whole = n == span[0]
                    rows.append((sent, pos, form if whole else f[1], f[2], f[3], f[5], misc if whole else f[9]))
            yield pd.DataFrame(rows, columns=names)

    return blocks.mapInPandas(kernel, "sent_id string, pos int, form string, lemma string, upos string, feats string, misc string")


def site(spark: SparkSession, path: str) -> DataFrame:
    """url, html of all pages under a folder."""
    pages = spark.read.text(path, wholetext=True, pathGlobFilter="*.htm*", recursiveFileLookup=True)
    return pages.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def write_words(words: DataFrame, path: str) -> None:
    """A word list by pieces: a reader that needs one piece reads that folder only."""
    words.repartition("piece").sortWithinPartitions("piece", "key").write.mode("overwrite").partitionBy("piece").parquet(path)


def read_words(spark: SparkSession, path: str, *pieces: str) -> DataFrame:
    schema = "key string, spelling string, count long, piece string"
    words = spark.read.schema(schema).parquet(path)
    return words.where(F.col("piece").isin(*pieces)) if pieces else words


def indexable(pages: DataFrame) -> DataFrame:
    """Pages to index: if any marks its body, those that mark none are left out. pages: url, has_body."""
    marked = pages.agg(F.max("has_body").alias("any_body"))  # one row
    return pages.join(F.broadcast(marked)).where("has_body or not coalesce(any_body, false)").drop("any_body")


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are written, so every line has all columns."""
    rows.write.option("ignoreNullFields", "false").json(path)


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """word: one a line; blank lines and comments are left out."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def write_runs(runs: DataFrame, path: str, asked: str) -> None:
    """Cached runs under what was asked: a hash of the query set and of the configuration."""
    runs.withColumn("asked", F.lit(asked)).write.mode("append").partitionBy("asked").parquet(path)


def read_runs(spark: SparkSession, path: str, asked: str, schema: str) -> DataFrame:
    """The cached runs of what is asked; none if they are stale, for another hash names another folder."""
    return spark.read.schema(f"{schema}, asked string").parquet(path).where(F.col("asked") == asked).drop("asked")
