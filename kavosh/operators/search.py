"""Inverted index and match profiles: all words, any word ranked by BM25, prefixes, fields with boosts, top k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.sources.shared import written

K1, B = 1.2, 0.75


def postings(docs: DataFrame, doc_id: str, terms: Column) -> DataFrame:
    """term, doc_id, tf, n_terms (of the document): one shuffle; counts are combined before it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(terms).alias("n_terms"), F.explode(terms).alias("term"))
    return rows.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.first("n_terms").alias("n_terms"))


def _copies(index: DataFrame) -> Column:
    """How many documents a row of the index stands for: its column of that name, or one."""
    return F.col("copies") if "copies" in index.columns else F.lit(1)


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.sum(_copies(index)).alias("df"))


def vocabulary(docs: DataFrame, terms: Column, least: int = 3) -> DataFrame:
    """token, n of all tokens that occur at least so often."""
    return docs.select(F.explode(terms).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _queries(queries: DataFrame) -> DataFrame:
    """query_id, term, n_wanted of queries(query_id, terms array), or of ones that have them already."""
    if "n_wanted" in queries.columns:
        return queries
    wanted = F.array_distinct("terms")
    return queries.select("query_id", F.size(wanted).alias("n_wanted"), F.explode(wanted).alias("term"))


def match_all(index: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of the documents that hold every term; score is the number of occurrences."""
    hits = _queries(queries).join(index, "term").groupBy("query_id", "doc_id", "n_wanted").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("score"))
    return hits.where(F.col("n") == F.col("n_wanted")).select("query_id", "doc_id", F.col("score").cast("double").alias("score"))


def match_any(index: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, BM25 score of the documents that hold any term."""
    lengths = index.groupBy("doc_id").agg(F.first("n_terms").alias("n_terms"), F.first(_copies(index)).cast("long").alias("copies"))
    # One row; the statistics of the whole collection.
    whole = lengths.agg(F.sum("copies").alias("docs"), (F.sum(F.col("n_terms") * F.col("copies")) / F.sum("copies")).alias("mean"))
    weights = _queries(queries).join(document_frequency(index), "term")
    hits = weights.join(index.drop("copies"), "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.col("mean")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def match_prefix(index: DataFrame, queries: DataFrame, longest: int = 12) -> DataFrame:
    """query_id, doc_id, score where every query term begins some term of the document.

    The vocabulary's prefixes are exploded once and joined by equality, so no pair of words is ever compared.
    """
    words = index.select("term").distinct()
    lengths = F.sequence(F.lit(1), F.least(F.length("term"), F.lit(longest)))
    prefixes = words.select("term", F.explode(F.transform(lengths, lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("prefix"))
    wanted = _queries(queries).withColumnRenamed("term", "prefix")
    short = wanted.where(F.length("prefix") <= longest)
    long = wanted.where(F.length("prefix") > longest).withColumn("head", F.substring("prefix", 1, longest))
    by_head = prefixes.where(F.length("prefix") == longest).withColumnRenamed("prefix", "head")
    found = short.join(prefixes, "prefix").select("query_id", "n_wanted", "prefix", "term").unionByName(
        long.join(by_head, "head").where(F.expr("startswith(term, prefix)")).select("query_id", "n_wanted", "prefix", "term")
    )
    hits = found.join(index, "term").groupBy("query_id", "doc_id", "n_wanted").agg(F.countDistinct("prefix").alias("n"), F.sum("tf").alias("score"))
    return hits.where(F.col("n") == F.col("n_wanted")).select("query_id", "doc_id", F.col("score").cast("double").alias("score"))


def boosted(title: DataFrame, body: DataFrame, boost: float = 2.0) -> DataFrame:
    """Scores of two fields, the title's times the boost."""
    rows = title.withColumn("score", F.col("score") * boost).unionByName(body)
    return rows.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def top(scored: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each query, ties to the smaller id; the limit is applied before the shuffle, too."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_of(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """query_id, target, rank of the target among the ranked (0: not there)."""
    hit = ranked.select("query_id", F.col("doc_id").alias("target"), "rank")
    return queries.join(hit, ["query_id", "target"], "left").select("query_id", "target", F.coalesce("rank", F.lit(0)).alias("rank"))


#: What each engine profile asks of a match: every word or any, whole words or prefixes, verbs' form, field boosts.
PROFILES = {
    "static-site": {"match": match_prefix, "verbs": "lemma"},
    "strict": {"match": match_all, "verbs": "lemma"},
    "any-word": {"match": match_any, "verbs": "stem"},
    "any-word-fielded": {"match": match_any, "verbs": "stem", "boost": 2.0},
    "exact-sentinel": {"match": match_any, "verbs": "stem", "sentinel": "_"},
}


def _class_of(bag: str) -> Column:
    """128 bits of a digest, which are taken for equality."""
    return F.substring(F.sha2(F.to_json(bag), 256), 1, 32)


def query_classes(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted, asked): queries that want the same terms are one class. wanted: query_id (the class), term, n_wanted; asked: class, query_id."""
    bags = _queries(queries).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "n_wanted"))).alias("bag"))
    bags = written(bags.select("query_id", "bag", _class_of("bag").alias("class")), "queries")
    wanted = bags.groupBy("class").agg(F.first("bag").alias("bag")).select(F.col("class").alias("query_id"), F.inline("bag"))
    return written(wanted, "wanted"), bags.select("class", "query_id")


def document_classes(fields: list[DataFrame], k: int) -> tuple[list[DataFrame], DataFrame]:
    """(fields, members): documents with the same terms in all fields are one class, whose scores are equal for any query.

    fields: the same indexes, with a class for doc_id, and copies, the number of its documents. members: class, doc_id, n of
    each class's k smallest ids; no other can be among the k best of a query, for ties go to the smaller id.
    """
    rows = [f.select("doc_id", F.struct(F.lit(i).alias("field"), "term", "tf", "n_terms").alias("x")) for i, f in enumerate(fields)]
    bags = reduce(DataFrame.unionByName, rows).groupBy("doc_id").agg(F.array_sort(F.collect_list("x")).alias("bag"))
    bags = written(bags.select("doc_id", "bag", _class_of("bag").alias("class")), "bags")
    each = bags.groupBy("class").agg(F.first("bag").alias("bag"), F.count(F.lit(1)).alias("copies"))
    each = written(each.select(F.col("class").alias("doc_id"), "copies", F.inline("bag")), "classes")
    first = F.row_number().over(Window.partitionBy("class").orderBy("doc_id"))
    members = written(bags.select("class", "doc_id", first.alias("n")).where(F.col("n") <= k), "members")
    return [each.where(F.col("field") == i).drop("field") for i in range(len(fields))], members


def search(index: DataFrame, queries: DataFrame, profile: str = "any-word", k: int = 10, title: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The k best documents of each query by a profile.

    title: an index of the titles beside that of the bodies; a profile's boost multiplies its scores. A sentinel closes
    every term on both sides, so that an engine that matches prefixes matches whole terms only. digits: scores are rounded
    so before they are compared.

    Classes of queries meet classes of documents, so copies on either side don't multiply the matches.
    """
    p = PROFILES[profile]
    if mark := p.get("sentinel"):
        closed = F.concat("term", F.lit(mark))
        index, title = index.withColumn("term", closed), title if title is None else title.withColumn("term", closed)
        queries = queries.withColumn("terms", F.transform("terms", lambda t: F.concat(t, F.lit(mark))))
    fields, members = document_classes([index] if title is None else [index, title], k)
    wanted, asked = query_classes(queries)
    hits = p["match"](fields[0], wanted)
    if title is not None:
        hits = boosted(p["match"](fields[1], wanted), hits, p.get("boost", 1.0))
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    # A class after k others, by its smallest id, has nothing among the k best.
    least = members.where("n = 1").select("class", F.col("doc_id").alias("least"))
    scored = hits.withColumnRenamed("doc_id", "class").join(least, "class").withColumnRenamed("least", "doc_id")
    some = top(scored, k).select("query_id", "class", "score").join(members.drop("n"), "class")
    best = written(top(some.select("query_id", "doc_id", "score"), k), "best")
    return asked.join(best.withColumnRenamed("query_id", "class"), "class").drop("class")


def covered(docs: DataFrame, queries: DataFrame, terms: str = "terms") -> DataFrame:
    """query_id, covered: whether all of a query's terms stand in its target."""
    own = docs.select(F.col("doc_id").alias("target"), F.col(terms).alias("doc_terms"))
    return queries.join(own, "target", "left").select("query_id", (F.size(F.array_except("terms", F.coalesce("doc_terms", F.array().cast("array<string>")))) == 0).alias("covered"))


def fuzzy(index: DataFrame, queries: DataFrame, edits: int = 1) -> DataFrame:
    """query_id, term, word: index words within so many edits of a query's term, of the same first letter."""
    words = index.select(F.col("term").alias("word")).distinct().withColumn("first", F.substring("word", 1, 1))
    wanted = _queries(queries).withColumn("first", F.substring("term", 1, 1)).withColumn("size", F.explode(F.sequence(F.length("term") - edits, F.length("term") + edits)))
    near = wanted.join(words.withColumn("size", F.length("word")), ["first", "size"])
    return near.where(F.levenshtein("term", "word", edits) >= 0).select("query_id", "term", "word")
