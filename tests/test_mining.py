"""Lexicon mining, edits, registered SQL functions, keys and single folds."""

from pyspark.sql import functions as F

from kavosh.functions import normalize, register
from kavosh.functions.alphabet import ZWNJ
from kavosh.operators import mining


def vocab(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "token string, n long")


def test_edits(spark):
    rows = [("بزرگتر", "بزرگ"), ("کتابها", "کتاب"), ("رفته", "رفت"), ("abcdefghijk", "xyz")]
    df = spark.createDataFrame(rows, "w string, t string").withColumn("e", mining.encode_edit(F.col("w"), F.col("t")))
    got = df.select("w", "t", mining.apply_edit(F.col("w"), F.col("e")).alias("back"), mining.edit_key(F.col("e")).alias("key")).collect()
    assert [r.back for r in got] == ["بزرگ", "کتاب", "رفت", None] and got[0].key == "n||2|"
    neg = spark.createDataFrame([("نمیروم", (True, "نمی", 1, ""))], f"w string, e {mining.EDIT}")
    assert neg.select(mining.apply_edit(F.col("w"), F.col("e"))).first()[0] == "نرو"


def test_vocabulary_and_verbs(spark):
    v = vocab(spark, رفتم=9, رفتند=4, بروم=3, میروم=8, کتاب=100, کتابها=9, خانه=50, نامه=400, امه=10, abc=5)
    assert mining.persian_vocabulary(v, F.col("token")).where("token = 'abc'").count() == 0
    verbs = spark.createDataFrame([("رفت", "رو")], "past string, present string")
    r = mining.attested_verbs(verbs, v, 3).first()
    assert (r.forms, r.uses) == (4, 24) and mining.attested_verbs(verbs, v, 9).count() == 0
    assert [x.token for x in mining.pluralizable(v).collect()] == ["کتاب"]
    assert [x.token for x in mining.words_to_keep(v, F.lit("x")).collect()] == ["کتاب"]
    assert [x.token for x in mining.negated_lookalikes(v).collect()] == ["نامه"]
    assert mining.attested(spark.createDataFrame([("کتاب", 1), ("هیچ", 2)], "w string, x int"), v, "w").count() == 1


def test_prefixes_and_labels(spark):
    words = spark.createDataFrame([(w,) for w in ("میزان", "میزانی", "میزانها", "میدان", "میر")], "token string")
    verbs = spark.createDataFrame([("میدانم",), ("میزند",)], "token string")
    assert {r.entry for r in mining.collapsed_prefixes(words, verbs).collect()} == {"میزا*", "میدان", "میر"}
    a = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, y boolean")
    b = spark.createDataFrame([(1, True), (2, True), (3, None)], "k int, y boolean")
    assert [tuple(r) for r in mining.agreed(a, b, "k", "y").collect()] == [(1, True)]
    rows = spark.range(100).select((F.col("id") % 2).alias("c"), (F.col("id") % 20 != 1).alias("ok"))
    assert [(r.c, r.n) for r in mining.trusted_classes(rows, "c", "ok").collect()] == [(0, 50), (1, 50)][:2]
    assert mining.systematic(spark.range(100).withColumn("k", F.lit(1)), "k", "id", 40).count() == 34
    assert mining.same_rows(a, a).count() == 0 and mining.same_rows(a, b).count() == 2
    q = spark.createDataFrame([("x", "p", "p", 0.5, 9), ("y", "p", "q", 0.9, 5), ("z", "p", "p", 0.99, 99)], "word string, a string, b string, confidence double, n long")
    assert [r.word for r in mining.learning_queue(q, 0.55).collect()] == ["x", "y"]
    lab = spark.createDataFrame([("w", "t", 1)], "word string, term string, n long")
    assert mining.examples(lab, lab.union(spark.createDataFrame([("v", "t", 3)], lab.schema))).count() == 2
    m = mining.headroom(spark.createDataFrame([("c", "NOUN", 3), ("c", "VERB", 2)], "cause string, upos string, n long")).first()
    assert (m.NOUN, m.ADJ, m.VERB) == (3, 0, 2)


def test_sql_functions_and_keys(spark):
    names = register.register(spark)
    assert "fa_terms" in names
    r = spark.sql("SELECT fa_normalize('كتاب') n, fa_tokens('می روم') t, fa_canonical_key('b a b') k, fa_distance('صابون', 'سابون') d, fa_title('<title>x</title>') h").first()
    assert (r.n, r.t, r.k, r.d, r.h) == ("کتاب", [f"می{ZWNJ}روم"], "1:a b", 0.3, "x")
    df = spark.createDataFrame([(f"آبِ{ZWNJ}كي۱",)], "w string")
    assert df.select(normalize.site_key(F.col("w"))).first()[0] == "ابکی1"
    assert df.select(normalize.gold_key(F.lit(f"{ZWNJ}مسؤل{ZWNJ}"))).first()[0] == "مسول"
    assert len(normalize.SINGLE_FOLDS) == 13 and df.select(*(f(F.col("w")).alias(k) for k, f in normalize.SINGLE_FOLDS.items())).first()["digits"].endswith("1")
