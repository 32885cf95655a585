"""Query rescue: wrong keyboard layouts and misspellings, by the words of the collection itself."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kavosh.functions.alphabet import PERSIAN_LETTER
from kavosh.functions.analyzer import Analyzer
from kavosh.functions.distance import is_persian, piece_key, pieces_for, reach, weighted_distance, word_key
from kavosh.functions.keyboard import LAYOUTS, layout_candidates
from kavosh.functions.tokens import tokens_with_offsets
from kavosh.sources.shared import written


def word_list(docs: DataFrame, tokens: Column) -> DataFrame:
    """key, spelling (the most frequent, ties to the smaller), count, piece of all words of three letters and more."""
    spelled = docs.select(F.explode(tokens).alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
    keyed = spelled.withColumn("key", word_key(F.col("spelling"))).where((F.length("key") >= 3) & is_persian(F.col("key")))
    best = keyed.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "spelling")).alias("best"), F.sum("n").alias("count"))
    return best.select("key", F.col("best.spelling").alias("spelling"), "count", piece_key(F.substring("key", 1, 1), F.length("key")).alias("piece"))


def spell(words: DataFrame, keys: DataFrame, rare: bool = False) -> DataFrame:
    """key, fix, count, ratio of the keys that have one within reach.

    The band of lengths and the class of first letters are exploded into piece keys, so candidates come by an equi-join.
    With rare, the key is a word of the list and a fix must be ten times as common; without, it is none.
    """
    own = words.select("key", F.col("count").alias("own"))
    asked = keys.select("key").distinct().withColumn("cap", reach(F.length("key"))).where("cap > 0")
    asked = asked.join(own, "key", "inner" if rare else "left_anti")
    least = F.col("own") * 10 if rare else F.lit(0)
    edits = F.when(F.col("cap") >= 1, pieces_for(F.col("key"), 1)).otherwise(pieces_for(F.col("key"), 0))
    pairs = asked.select("*", F.explode(edits).alias("piece")).join(words.select("piece", F.col("key").alias("other"), "spelling", "count"), "piece")
    near = pairs.where((F.col("other") != F.col("key")) & (F.col("count") >= least) & (F.abs(F.length("other") - F.length("key")) <= F.floor("cap")))
    costed = near.withColumn("cost", weighted_distance("key", "other", "cap")).where(F.col("cost").isNotNull())
    order = Window.partitionBy("key").orderBy("cost", F.desc("count"), "other")
    best = costed.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("key", F.col("spelling").alias("fix"), "count", (F.col("count") / (F.col("own") if rare else F.lit(1))).alias("ratio"), "cost")


def index_terms(docs: DataFrame, text: Column, analyzer: Analyzer | None = None) -> DataFrame:
    """term: all terms that a document's text is found by. What `check` takes for known."""
    return (analyzer or Analyzer()).vocabulary(docs, text).select(F.col("token").alias("term"))


def known_words(words: DataFrame, known: DataFrame, analyzer: Analyzer) -> DataFrame:
    """word: those of words(word) that have terms, all of which are known."""
    each = words.select("word").distinct().select("word", F.explode(analyzer.query_terms(F.col("word"))).alias("term"))
    seen = each.join(known.select("term", F.lit(True).alias("there")).distinct(), "term", "left")
    return seen.groupBy("word").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("all")).where("all").select("word")


_RUN = T.ArrayType(T.StructType([T.StructField("run", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@pandas_udf(_RUN)
def _runs(query: pd.Series) -> pd.Series:
    return query.map(lambda q: [{"run": m[0], "start": m.start(), "end": m.end()} for m in re.finditer(r"\S+", q or "")])


def layout_fixes(runs: DataFrame, known: DataFrame, analyzer: Analyzer) -> DataFrame:
    """query_id, start, end, text: the runs' words on the layout that makes most of them known; earlier layouts win ties.

    runs: query_id, run, start, end, long. On a layout a run becomes its first candidate that is known. A long run counts
    1, a short one 0.1, and a layout has to reach 1.
    """
    each = F.array(*(F.struct(F.lit(i).alias("turn"), layout_candidates(F.col("run"), name).alias("found")) for i, name in enumerate(LAYOUTS)))
    tried = runs.select("*", F.explode(each).alias("x")).select("query_id", "run", "start", "end", "long", "x.turn", F.posexplode("x.found").alias("at", "word")).where("word <> run")
    tried = written(tried, "tried")
    good = tried.join(known_words(tried, known, analyzer), "word")
    first = good.groupBy("query_id", "start", "end", "long", "turn").agg(F.min(F.struct("at", "word")).alias("x"))
    score = F.sum(F.when(F.col("long"), 1.0).otherwise(0.1))
    edits = F.collect_list(F.struct("start", "end", F.col("x.word").alias("text")))
    layouts = first.groupBy("query_id", "turn").agg(F.round(score, 6).alias("score"), edits.alias("edits")).where("score >= 1")
    best = layouts.groupBy("query_id").agg(F.max_by("edits", F.struct("score", -F.col("turn"))).alias("edits"))
    return best.select("query_id", F.inline("edits"))


def known_queries(queries: DataFrame, known: DataFrame) -> DataFrame:
    """query_id, known: whether every term (one at least) is a term of the index. queries: query_id, terms."""
    each = queries.select("query_id", F.explode_outer(F.array_distinct("terms")).alias("term"))
    seen = each.join(known.select("term", F.lit(True).alias("there")).distinct(), "term", "left")
    return seen.groupBy("query_id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("known"))


def _overlapping(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Rows of a that overlap one of b in the same query (left_semi), or none (left_anti)."""
    other = b.select(F.col("query_id").alias("_q"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    return a.join(other, (F.col("query_id") == F.col("_q")) & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), how)


def check(queries: DataFrame, known: DataFrame, words: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """query_id, query, fixed, auto, pieces of weak queries that can be mended.

    queries: query_id, query (raw), found (how many results it had); known: term (index_terms); words: a word_list. A query
    is weak if nothing was found or if it has a token that the index doesn't know.
    1. Keyboard: runs between white space that hold an unknown token, or marks among Latin keys, are tried on the other
       layouts, one layout for the whole query. Latin runs of two keys and Persian ones of two letters prove nothing alone.
    2. Spelling: other unknown tokens become their nearest word of the list, if the index knows it.
    3. Suspects: where nothing was found and nothing else helps, one token that the list has becomes a near word that is at
       least ten times as common, the one with the largest ratio (the first of equals).
    Fixes are spliced into the query as typed. auto: search the fixed query instead (nothing was found, or all fixes are of
    the keyboard); else it is a suggestion. pieces: the parts of the word list that were looked at, in order.
    A query that was typed often is mended once for each number of results.
    """
    analyzer = analyzer or Analyzer()
    typed_as = F.substring(F.sha2(F.to_json(F.struct("query", "found")), 256), 1, 32)
    asked = written(queries.select("query_id", "query", "found", typed_as.alias("class")), "asked")
    base = written(asked.groupBy(F.col("class").alias("query_id")).agg(F.first("query").alias("query"), F.first("found").alias("found")), "base")
    spans = written(base.select("query_id", F.explode(tokens_with_offsets("query")).alias("t")).select("query_id", "t.text", "t.start", "t.end"), "spans")
    good = known_words(spans.select(F.col("text").alias("word")), known, analyzer).select("word", F.lit(True).alias("good"))
    spans = written(spans.join(good, F.col("text") == F.col("word"), "left").select("query_id", "text", "start", "end", F.coalesce("good", F.lit(False)).alias("good")), "spans")
    unknown = spans.where("not good")
    weak = base.join(unknown.select("query_id").distinct().withColumn("any", F.lit(True)), "query_id", "left").where("found = 0 or any").drop("any")

    latin, inner = F.col("run").rlike("^[!-~]*[A-Za-z][!-~]*$"), F.col("run").rlike("^.+[^A-Za-z0-9].*.$") & F.expr("substring(run, 2, length(run) - 2)").rlike("[^A-Za-z0-9]")
    runs = weak.select("query_id", F.explode(_runs("query")).alias("r")).select("query_id", "r.run", "r.start", "r.end").withColumns({"latin": latin, "odd": latin & inner})
    held = _overlapping(runs.where("not odd"), unknown, "left_semi").unionByName(runs.where("odd"))
    size = F.length("run")
    tried = held.where(F.col("latin") | (F.col("run").rlike(PERSIAN_LETTER) & (size >= 3)))
    tried = tried.withColumn("long", ~F.col("latin") | (size >= 3) | F.col("run").rlike("[^A-Za-z0-9]"))
    typed = written(layout_fixes(written(tried, "runs"), known, analyzer).withColumn("kind", F.lit("keyboard")), "typed")

    open_ = _overlapping(spans.join(weak.select("query_id"), "query_id"), typed, "left_anti").withColumn("key", word_key(F.col("text"))).where(is_persian(F.col("key")) & (reach(F.length("key")) > 0))
    open_ = written(open_, "open")
    missing = open_.where("not good")
    near = written(spell(words, missing.select("key")), "near")
    sure = known_words(near.select(F.col("fix").alias("word")), known, analyzer)
    spelled = missing.join(near.join(sure, F.col("fix") == F.col("word"), "left_semi"), "key").select("query_id", "start", "end", F.col("fix").alias("text"), F.lit("spelling").alias("kind"))
    edits = written(typed.unionByName(spelled), "edits")

    left = weak.where("found = 0").select("query_id").join(edits.select("query_id").distinct(), "query_id", "left_anti")
    doubted = open_.join(left, "query_id")
    common = written(spell(words, doubted.select("key"), rare=True), "common")
    surely = known_words(common.select(F.col("fix").alias("word")), known, analyzer)
    picked = doubted.join(common.join(surely, F.col("fix") == F.col("word"), "left_semi"), "key").groupBy("query_id").agg(F.max_by(F.struct("start", "end", F.col("fix").alias("text")), F.struct("ratio", -F.col("start"))).alias("x"))
    edits = edits.unionByName(picked.select("query_id", "x.start", "x.end", "x.text", F.lit("suspect").alias("kind")))

    looked = missing.unionByName(doubted).select("query_id", F.explode(pieces_of(F.col("key"))).alias("piece")).groupBy("query_id").agg(F.array_sort(F.collect_set("piece")).alias("pieces"))
    lists = edits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("edits"), F.bool_and(F.col("kind") == "keyboard").alias("typed"))
    # An edit brings the text between the one before it and itself.
    ends = F.concat(F.array(F.lit(0)), F.col("edits")["end"])
    parts = F.transform("edits", lambda e, i: F.concat(F.substring(F.col("query"), F.element_at(ends, i + 1) + 1, e["start"] - F.element_at(ends, i + 1)), e["text"]))
    fixed = F.concat(F.array_join(parts, ""), F.substring(F.col("query"), F.element_at(ends, -1) + 1, F.length("query")))
    made = weak.join(lists, "query_id").join(looked, "query_id", "left")
    each = made.select(F.col("query_id").alias("class"), fixed.alias("fixed"), ((F.col("found") == 0) | F.col("typed")).alias("auto"), F.coalesce("pieces", F.array().cast("array<string>")).alias("pieces"))
    return asked.join(written(each, "mended"), "class").select("query_id", "query", "fixed", "auto", "pieces")


def pieces_of(key: Column) -> Column:
    """Pieces of the word list in which a fix for the key can be."""
    return F.when(reach(F.length(key)) >= 1, pieces_for(key, 1)).otherwise(pieces_for(key, 0))


def rescue_search(search: Callable[[DataFrame], DataFrame], queries: DataFrame, known: DataFrame, words: DataFrame, analyzer: Analyzer | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, fixes) of queries(query_id, query), searched as typed and, where that is weak and can be mended, as fixed.

    search: queries -> query_id, doc_id, ... A fix is kept only if its search finds something: then its results take the
    place of the ones as typed (auto), or it is a suggestion beside them. fixes: query_id, query, fixed, auto.
    """
    own = queries.select("query_id", "query")
    typed = written(search(own), "hits")
    counts = typed.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"))
    fixes = check(own.join(counts, "query_id", "left").withColumn("found", F.coalesce("found", F.lit(0))), known, words, analyzer)
    fixes = written(fixes, "fixes")
    mended = written(search(fixes.select("query_id", F.col("fixed").alias("query"))), "hits")
    fixes = fixes.join(mended.select("query_id").distinct(), "query_id", "left_semi").drop("pieces")
    instead = fixes.where("auto").select("query_id")
    results = typed.join(instead, "query_id", "left_anti").unionByName(mended.join(instead, "query_id", "left_semi"))
    return results, fixes


@pandas_udf(T.ArrayType(T.StringType()))
def _opened(rests: pd.Series, shared: pd.Series) -> pd.Series:
    def one(pair):
        out, before = [], ""
        for rest, n in zip(*pair, strict=True):
            before = before[:n] + rest
            out.append(before)
        return out

    return pd.Series(map(one, zip(rests, shared, strict=True)), dtype=object)


def front_decoded(coded: DataFrame) -> DataFrame:
    """piece, key, count of front-coded words (piece, line, shared, rest, level); a count is its level's least, 2**level.

    A piece is bounded by its words' first letter and length, and its lines are read in their order.
    """
    rows = coded.groupBy("piece").agg(F.array_sort(F.collect_list(F.struct("line", "shared", "rest", "level"))).alias("w"))
    opened = rows.select("piece", F.arrays_zip(_opened(F.col("w")["rest"], F.col("w")["shared"]).alias("key"), F.col("w")["level"].alias("level")).alias("x"))
    return opened.select("piece", F.inline("x")).select("piece", "key", F.pow(F.lit(2), F.col("level")).cast("long").alias("count"))


def front_coded(words: DataFrame) -> DataFrame:
    """piece, key, line, shared, rest, level: each word as what it shares with the one before it in its piece (9 at most)."""
    order = Window.partitionBy("piece").orderBy("key")
    before = words.withColumn("before", F.coalesce(F.lag("key").over(order), F.lit("")))
    same = [(F.length("key") >= n) & (F.length("before") >= n) & (F.substring("key", 1, n) == F.substring("before", 1, n)) for n in range(1, 10)]
    shared = reduce(lambda total, x: total + x.cast("int"), same, F.lit(0))
    level = F.least(F.lit(9), F.floor(F.log2("count"))).cast("int")
    return before.withColumn("shared", shared).select("piece", "key", F.row_number().over(order).alias("line"), "shared", F.expr("substring(key, shared + 1)").alias("rest"), level.alias("level"))
