"""Published input-output pairs of the Persian operators as queries: the operator's answer against the expected value.

The given tables hold no Persian text, so these pairs are the tables here; their SQL is the list of expected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.functions import distance, keyboard, normalize, predicates, tokens
from kavosh.functions.alphabet import ZWNJ
from kavosh.functions.analyzer import Analyzer
from kavosh.functions.stem import Lexicon
from kavosh.operators import rescue, search, variants

# Golden vectors.
NORMAL = {
    "كتاب": "کتاب", "علي": "علی", "مدرسة": "مدرسه", "أحمد": "احمد", "مؤمن": "مومن", "مسئول": "مسیول", "کِتابْ": "کتاب", "کتـــاب": "کتاب", "۱۲۳٤٥": "12345", "iPhone": "iphone",
    f"کتاب{ZWNJ}{ZWNJ}ها": f"کتاب{ZWNJ}ها", "می¬روم": f"می{ZWNJ}روم", "a ¬ b": "a ¬ b", "سلاااام": "سلام", "ﻻ": "لا", "آب": "آب",
}
REJOINED = {
    "می روم به خانه ها": f"می{ZWNJ}روم|به|خانه{ZWNJ}ها", "نمی خواهم": f"نمی{ZWNJ}خواهم", "خسته اید": f"خسته{ZWNJ}اید", "کتاب اید": "کتاب|اید", "خانه، ها": "خانه|ها", "خانه\nها": "خانه|ها",
    "ای خدا": "ای|خدا", "book ها": "book|ها", "بزرگ ترین خانه": f"بزرگ{ZWNJ}ترین|خانه", "می می روم": f"می{ZWNJ}می|روم",
}
LISTS = ("رفت#رو شد#شو گفت#گو آمد#آ کرد#کن", "میدان سازمان", "کتب>کتاب", "n//2/;v//1/د\n0:بزرگتر\n1:کردن")
STEMS = {f"می{ZWNJ}روم": "رفت", "نمیروند": "نرفت", "میگوید": "گفت", "شود": "شد", "بیاید": "آمد", "کتب": "کتاب", "بزرگتر": "بزرگ", "میدانهای": "میدان", "کتابمان": "کتاب", "مهمان": "مهمان", "abc": "abc"}
LAYOUTS = {"sghl": "سلام", "اثممخ": "hello", "nd[d": "دیجی"}
COSTS = {("صابون", "سابون"): 0.3, ("عباس", "اباس"): 0.3, ("بعد", "باد"): 1.0, ("کتتاب", "کتاب"): 0.5, ("کتب", "کتاب"): 0.8, ("کاتب", "کتاب"): 0.8}
SITE = ("تحویل کالا در اهواز", "دیجی کالا فروشگاه", "صابون گیاهی", f"کتاب{ZWNJ}خانه{ZWNJ}ی مرکزی شهر", "كتابهاي قديمي", "گوشی samsung galaxy s23", "ژاپن و چین", "فاصله " * 12 + "اجتماعی فصله")
RESCUED = {
    ("nd[d ;hgh", 0): ("دیجی کالا", True), ("Chmk", 0): ("ژاپن", True), ("طحویل کالا", 1): ("تحویل کالا", False), ("گوشی سشپسعدل", 1): ("گوشی samsung", True), ("سابون", 0): ("صابون", True),
    ("سابون گیاهی", 3): ("صابون گیاهی", False), ("فصله اجتماعی", 0): ("فاصله اجتماعی", True), ("صابون گیاهی", 3): None, ("iphone", 0): None, ("a52", 0): None, ("tv", 0): None, ("کتابخانه", 0): None,
}
DOCS = {"a": "تحویل کالا در اهواز ارسال سریع", "b": "دیجی کالا فروشگاه اینترنتی", "c": f"صابون گیاهی دست{ZWNJ}ساز", "d": "گوشی samsung galaxy s23", "e": "ماشین قرمز خودرو", "f": "كتابهاي قديمي در كتاب‌خانه‌ی شهر"}
FOUND = {"تحويل كالا": "a", "دیجی": "b", "دست ساز": "c", "S23": "d", "کتاب قدیمی": "f", "کتاب خانه": "f"}
FORMS = {("آمد", "آ", "subjunctive", 3, False): "بیاید", ("آمد", "آ", "past", 1, True): "نیامدم", ("افتاد", "افت", "past", 3, True): "نیفتاد", ("گفت", "گو", "participle", 0, True): "نگفته", ("رفت", "رو", "present", 1, False): f"می{ZWNJ}روم"}
ENDED = {("کتابی", "کتاب"): "ezafe/indefinite ی", ("کتابهای", "کتاب"): "ها plural", ("حملات", "حمله"): "ات plural", ("نویسندگان", "نویسنده"): "گان plural", ("بزرگترین", "بزرگ"): "comparative", ("رفت", "کتاب"): "other"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _literal(x) -> str:
    return str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def golden(columns: str, rows: list[tuple]):
    """Registers a query with the rows that it must give."""

    def add(f):
        QUERIES[f.__name__] = f
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
        SQL[f.__name__] = f"SELECT * FROM (VALUES {values}) AS t({columns})"
        return f

    return add


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


@golden("text, normal", list(NORMAL.items()))
def golden_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, [(t,) for t in NORMAL], "text string").select("text", normalize.normalize(F.col("text")).alias("normal"))


@golden("text, tokens", list(REJOINED.items()))
def golden_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, [(t,) for t in REJOINED], "text string").select("text", F.array_join(tokens.tokens(F.col("text")), "|").alias("tokens"))


@golden("word, term", list(STEMS.items()))
def golden_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = Analyzer(profile="full", lexicon=Lexicon.parse(*LISTS))
    return _frame(spark, [(t,) for t in STEMS], "word string").select("word", F.array_join(full.analyze(F.col("word"), "query"), "|").alias("term"))


@golden("run, meant", list(LAYOUTS.items()))
def golden_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, [(t,) for t in LAYOUTS], "run string").select("run", F.element_at(keyboard.keyboard_candidates(F.col("run")), 1).alias("meant"))


@golden("a, b, cost", [(*k, v) for k, v in COSTS.items()])
def golden_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, list(COSTS), "a string, b string").select("a", "b", distance.weighted_distance(F.col("a"), F.col("b"), F.lit(1.0)).alias("cost"))


@golden("query, fixed, auto", [(q, *fix) for (q, _), fix in RESCUED.items() if fix])
def golden_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _frame(spark, [(t,) for t in SITE], "text string")
    log = _frame(spark, [(i, q, n) for i, (q, n) in enumerate(RESCUED)], "query_id long, query string, found long")
    return rescue.check(log, rescue.index_terms(site, F.col("text")), rescue.word_list(site, tokens.tokens(F.col("text")))).select("query", "fixed", "auto")


@golden("query, doc_id", list(FOUND.items()))
def golden_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document by all words, however query and document are spelled."""
    standard = Analyzer()
    docs = _frame(spark, list(DOCS.items()), "doc_id string, text string")
    index = search.postings(docs, "doc_id", standard.analyze(F.col("text")))
    asked = _frame(spark, [(q,) for q in FOUND], "query_id string").withColumn("terms", standard.query_terms(F.col("query_id")))
    return search.search(index, asked, "strict", 1).select(F.col("query_id").alias("query"), "doc_id")


@golden("past, present, tense, person, negative, form", [(*k, v) for k, v in FORMS.items()])
def golden_conjugation(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _frame(spark, list(FORMS), "past string, present string, tense string, person int, negative boolean")
    return variants.generated(asked, asked.select("past", "present").distinct()).select("past", "present", "tense", "person", "negative", "form")


@golden("word, lemma, ending", [(*k, v) for k, v in ENDED.items()])
def golden_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, list(ENDED), "word string, lemma string").select("word", "lemma", predicates.ending(F.col("word"), F.col("lemma")).alias("ending"))
