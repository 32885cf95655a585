"""Labelling: what a model changes by words it has seen, raters against gold, the queue of words to label, its shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.functions.hashing import fnv1a


def seen_unseen(examples: DataFrame, training: DataFrame) -> DataFrame:
    """seen, tokens, fixed, broken, missed, hit (in tokens) of examples(word, base, target, term, count) (Q8).

    base is the term before, target the right one, term the model's; training(word) are the words that it learnt from.
    """
    flagged = examples.join(training.select("word", F.lit(True).alias("seen")).distinct(), "word", "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    was, now = F.col("base") == F.col("target"), F.col("term") == F.col("target")
    total = lambda c: F.sum(F.when(c, F.col("count")).otherwise(0))
    return flagged.groupBy("seen").agg(F.sum("count").alias("tokens"), total(~was & now).alias("fixed"), total(was & ~now).alias("broken"), total(~was).alias("missed"), total(was).alias("hit"))


def rater_scores(answers: DataFrame) -> DataFrame:
    """rater, n, answered, right of answers(gold, a, b): each rater, and both where they agree, else no answer (Q9)."""
    both = F.when(F.col("a") == F.col("b"), F.col("a"))
    each = answers.select("gold", F.inline(F.array(*(F.struct(F.lit(name).alias("rater"), c.alias("said")) for name, c in (("a", F.col("a")), ("b", F.col("b")), ("agree", both))))))
    return each.groupBy("rater").agg(F.count(F.lit(1)).alias("n"), F.count("said").alias("answered"), F.count_if(F.col("said") == F.col("gold")).alias("right"))


def queue(candidates: list[DataFrame], labelled: DataFrame, seed: str) -> DataFrame:
    """word, count, turn: the candidates' words that aren't labelled yet, in an order drawn by a seeded hash (Q10).

    A word of several sources has its largest count.
    """
    every = candidates[0].select("word", "count")
    for c in candidates[1:]:
        every = every.unionByName(c.select("word", "count"))
    new = every.groupBy("word").agg(F.max("count").alias("count")).join(labelled.select("word").distinct(), "word", "left_anti")
    return new.withColumn("turn", fnv1a(F.concat(F.lit(seed + "/"), F.col("word"))))


def write_shards(words: DataFrame, path: str, shards: int, order: Column) -> None:
    """Shards of tab-separated id, word, count, one folder each; an id is the word's hash, so shards can be written alone (IO20)."""
    numbered = words.select(F.pmod(F.xxhash64("word"), F.lit(shards)).alias("shard"), F.xxhash64("word").alias("id"), "word", "count", order.alias("_order"))
    numbered.repartition(shards, "shard").sortWithinPartitions("shard", "_order").drop("_order").write.partitionBy("shard").option("sep", "\t").csv(path)


def read_answers(spark: SparkSession, path: str, shards: str, schema: str) -> DataFrame:
    """word and the answers' columns, from JSON lines with ids and the shards they were asked from; malformed rows are missing."""
    asked = spark.read.schema("id long, word string, count long, shard int").option("sep", "\t").csv(shards).select("id", "word")
    rows = spark.read.schema(f"id long, {schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and id is not null").drop("_corrupt").join(asked, "id").drop("id")
