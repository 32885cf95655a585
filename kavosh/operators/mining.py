"""Lexicon mining over a corpus vocabulary (token, n): verb pairs, words to keep, look-alikes, exceptions, lemma edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.functions.alphabet import ARABIC, ZWNJ
from kavosh.operators.variants import verb_forms

LONGEST_CUT = 8
EDIT = "struct<verb:boolean,p:string,k:int,a:string>"


def persian_vocabulary(counts: DataFrame, normal: Column) -> DataFrame:
    """token, n of counts under their normal form, Arabic-script words only."""
    return counts.select(normal.alias("token"), "n").where(F.col("token").rlike(f"^{ARABIC}[{ARABIC[1:-1]}{ZWNJ}]*$")).groupBy("token").agg(F.sum("n").alias("n"))


def attested_verbs(verbs: DataFrame, vocabulary: DataFrame, least: int = 20) -> DataFrame:
    """past, present, forms, uses of the verbs of which so many affirmative forms occur; a past stem that is another verb's present form is dropped."""
    forms = verbs.select("past", "present", F.explode(verb_forms(F.col("past"), F.col("present"))).alias("f")).where("not f.negative")
    flat = forms.select("past", "present", F.replace("f.form", F.lit(ZWNJ), F.lit("")).alias("token"), F.col("f.tense").alias("tense"))
    counts = vocabulary.select(F.replace("token", F.lit(ZWNJ), F.lit("")).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    seen = flat.join(counts, "token").groupBy("past", "present").agg(F.countDistinct("token").alias("forms"), F.sum("n").alias("uses")).where(F.col("forms") >= least)
    shadowed = flat.where("tense = 'present'").select(F.col("token").alias("past"), F.col("past").alias("_other")).distinct()
    return seen.join(shadowed.withColumnRenamed("past", "_form"), (F.col("past") == F.col("_form")) & (F.col("past") != F.col("_other")), "left_anti")


def pluralizable(vocabulary: DataFrame, least: int = 3, share: float = 0.01) -> DataFrame:
    """token of the words whose plural occurs often enough beside them."""
    plural = vocabulary.where(F.col("token").rlike(".{2,}ها$")).select(F.regexp_replace("token", f"{ZWNJ}?ها$", "").alias("token"), F.col("n").alias("p")).groupBy("token").agg(F.sum("p").alias("p"))
    return vocabulary.join(plural, "token").where((F.col("p") >= least) & (F.col("p") >= share * F.col("n"))).select("token")


def words_to_keep(vocabulary: DataFrame, stem: Column, least: int = 40, length: int = 3) -> DataFrame:
    """token, n of frequent words that the stemmer would cut though they take a plural themselves; no participles."""
    cut = vocabulary.withColumn("stem", stem).where((F.col("n") >= least) & (F.length("token") >= length) & (F.col("stem") != F.col("token")) & ~F.col("token").rlike("[تد]ه$"))
    return cut.join(pluralizable(vocabulary), "token", "left_semi").select("token", "n")


def negated_lookalikes(vocabulary: DataFrame, least: int = 100, ratio: float = 0.5) -> DataFrame:
    """token, n of words in ن that are no negations: they occur too often beside what would be their positive."""
    own = vocabulary.where(F.col("token").startswith("ن") & (F.col("n") >= least)).withColumn("positive", F.expr("substring(token, 2)"))
    other = vocabulary.select(F.col("token").alias("positive"), F.col("n").alias("m"))
    return own.join(other, "positive").where(F.col("n") > ratio * F.col("m")).select("token", "n")


def collapsed_prefixes(exceptions: DataFrame, verbs: DataFrame, least: int = 3, shortest: int = 4) -> DataFrame:
    """entry: exceptions, many with one beginning under a minimal prefix and a star; no verb-like word has that prefix."""

    def prefixes(words: DataFrame) -> DataFrame:
        lengths = F.sequence(F.lit(shortest), F.greatest(F.lit(shortest), F.length("token")))
        return words.where(F.length("token") >= shortest).select("token", F.explode(F.transform(lengths, lambda n: F.substring(F.col("token"), F.lit(1), n))).alias("prefix"))

    every = prefixes(exceptions.select("token").distinct())
    common = every.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("prefix").join(prefixes(verbs.select("token")).select("prefix").distinct(), "prefix", "left_anti")
    covered = every.join(common, "prefix").groupBy("token").agg(F.min(F.struct(F.length("prefix").alias("l"), "prefix")).alias("x")).select("token", "x.prefix")
    stars = covered.select(F.concat("prefix", F.lit("*")).alias("entry")).distinct()
    return stars.unionByName(exceptions.select("token").distinct().join(covered.select("token"), "token", "left_anti").select(F.col("token").alias("entry")))


def attested(pairs: DataFrame, vocabulary: DataFrame, column: str, least: int = 20) -> DataFrame:
    """Rows of a hand-made list whose word occurs so often."""
    return pairs.join(vocabulary.where(F.col("n") >= least).select(F.col("token").alias(column)), column, "left_semi")


def _shared(a: Column, b: Column) -> Column:
    """Letters that two words have in common from their start."""
    upto = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(a), F.length(b))))
    return F.size(F.filter(upto, lambda n: (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)) & (F.length(a) >= n) & (F.length(b) >= n)))


def encode_edit(word: Column, term: Column) -> Column:
    """The cut and the tail that turn a nominal word into its term; null beyond the longest cut."""
    n = _shared(word, term)
    k = F.length(word) - n
    edit = F.struct(F.lit(False).alias("verb"), F.lit("").alias("p"), k.cast("int").alias("k"), F.substring(term, n + 1, F.length(term)).alias("a"))
    return F.when(k <= LONGEST_CUT, edit)


def apply_edit(word: Column, edit: Column, keep_negation: bool = True) -> Column:
    """The term that an edit gives; null where it does not fit."""
    p, k, a = edit["p"], edit["k"], edit["a"]
    rest = F.substring(word, F.length(p) + 1, F.length(word))
    out = F.concat(F.substring(rest, F.lit(1), F.length(rest) - k), a)
    sign = F.when(p.isin("نمی", "ن"), "ن").otherwise("") if keep_negation else F.lit("")
    return F.when(F.startswith(word, p) & (F.length(rest) - k >= 1) & (F.length(out) >= 2), F.concat(sign, out))


def edit_key(edit: Column) -> Column:
    return F.concat_ws("|", F.when(edit["verb"], "v").otherwise("n"), edit["p"], edit["k"].cast("string"), edit["a"])


def trusted_classes(rows: DataFrame, cls: str, right: str, least: int = 30, share: float = 0.9) -> DataFrame:
    """cls, n, precision of the classes that gold labels confirm."""
    return rows.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(right).cast("double")).alias("precision")).where((F.col("n") >= least) & (F.col("precision") >= share))


def agreed(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """key, label of the rows that two raters label alike; a missing or null label is no agreement."""
    return a.select(key, F.col(label).alias("_a")).join(b.select(key, F.col(label).alias("_b")), key).where("_a = _b").select(key, F.col("_a").alias(label))


def learning_queue(rows: DataFrame, threshold: float, band: float = 0.1, k: int = 1000) -> DataFrame:
    """The k most frequent words on which two models disagree, or whose confidence is near the threshold."""
    return rows.where((F.col("a") != F.col("b")) | (F.abs(F.col("confidence") - threshold) <= band)).orderBy(F.desc("n"), "word").limit(k)


def examples(labelled: DataFrame, mined: DataFrame, key: str = "word") -> DataFrame:
    """word, term, weight of training rows; a labelled row wins over a mined one."""
    rest = mined.join(labelled.select(key), key, "left_anti")
    return labelled.select(key, "term", "n").unionByName(rest.select(key, "term", "n")).select(key, "term", F.log2(1 + F.col("n")).alias("weight"))


def headroom(misses: DataFrame, cause: str = "cause", upos: str = "upos") -> DataFrame:
    """Misses by cause and part of speech, one column a part."""
    return misses.groupBy(cause).pivot(upos, ["NOUN", "ADJ", "VERB"]).agg(F.sum("n")).na.fill(0)


def systematic(rows: DataFrame, kind: str, order: str, n: int) -> DataFrame:
    """Every ceil(size / n)-th row of each kind."""
    window = Window.partitionBy(kind)
    placed = rows.withColumn("_row", F.row_number().over(window.orderBy(order)) - 1).withColumn("_step", F.ceil(F.count(F.lit(1)).over(window) / n))
    return placed.where("_row % _step = 0").drop("_row", "_step")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often than the other; none if they are equal."""
    return a.exceptAll(b).unionByName(b.exceptAll(a))
