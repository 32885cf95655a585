"""Seeded sampling: quotas by stratum, first-wins de-duplication, supplements up to a quota, greedy pinning of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.functions.hashing import fnv1a


def shuffled(rows: DataFrame, key: str, n: int, seed: str = "") -> DataFrame:
    """n rows in the order of a seeded hash: a sample that doesn't depend on how rows are laid out."""
    return rows.orderBy(fnv1a(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def quotas(rows: DataFrame, stratum: str, shares: dict[str, float], n: int, key: str, seed: str = "") -> DataFrame:
    """round(n * share) rows of each stratum, in the order of a seeded hash."""
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
    order = Window.partitionBy(stratum).orderBy(fnv1a(F.concat(F.lit(seed), F.col(key).cast("string"))), key)
    picked = rows.withColumn("_quota", F.round(F.try_element_at(share, F.col(stratum)) * n)).where("_quota > 0")
    return picked.withColumn("_row", F.row_number().over(order)).where("_row <= _quota").drop("_row", "_quota")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_row", F.row_number().over(window)).where("_row = 1").drop("_row")


def supplement(rows: DataFrame, kind: str, order: str, least: int = 300) -> DataFrame:
    """Rows of each kind, in order, until it has so many."""
    window = Window.partitionBy(kind).orderBy(order)
    return rows.withColumn("_row", F.row_number().over(window)).where(F.col("_row") <= least).drop("_row")


def pinned(docs: DataFrame, df: DataFrame, terms: Column, most: int = 5, rare: int = 50) -> DataFrame:
    """target, terms: of each document its rarest terms, so many that the rarest of them pins it, at most `most`."""
    each = docs.select("doc_id", F.explode(F.array_distinct(terms)).alias("term")).join(df, "term")
    order = Window.partitionBy("doc_id").orderBy("df", "term")
    first = each.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    need = first.withColumn("pinned", F.min("df").over(Window.partitionBy("doc_id")) <= rare)
    return need.where(F.when(F.col("pinned"), F.col("n") <= 3).otherwise(True)).groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("terms")).withColumnRenamed("doc_id", "target")
