"""Predicates on words, labelling tables, and the readers and writers that they use."""

from pyspark.sql import functions as F

from kavosh.functions import predicates
from kavosh.functions.alphabet import ZWNJ
from kavosh.operators import labels
from kavosh.sources import readers


def test_endings(spark):
    pairs = {("کتاب", "کتاب"): "same form", ("کتابی", "کتاب"): "ezafe/indefinite ی", ("کتابهای", "کتاب"): "ها plural", ("حملات", "حمله"): "ات plural", ("نویسندگان", "نویسنده"): "گان plural", ("ایرانیان", "ایران"): "ان/یان plural", ("بزرگترین", "بزرگ"): "comparative", ("کتابم", "کتاب"): "clitic", ("کتابدار", "کتاب"): "other ending", ("رفت", "کتاب"): "other"}
    df = spark.createDataFrame(list(pairs), "w string, l string").select("w", "l", predicates.ending(F.col("w"), F.col("l")).alias("e"))
    assert {(r.w, r.l): r.e for r in df.collect()} == pairs


def test_small_predicates(spark):
    words = spark.createDataFrame([("کتاب",), ("abc-1",), ("۱۲",), ("کتاب1",), ("nd[d",), (None,)], "w string")
    w = F.col("w")
    got = {r[0]: tuple(r)[1:] for r in words.select("w", predicates.is_arabic_script(w), predicates.is_latin(w), predicates.has_digit(w), predicates.is_persian_only(w), predicates.latin_keys(w), predicates.punctuated(w)).collect()}
    assert got["کتاب"] == (True, False, False, True, False, True) and got["abc-1"] == (False, True, True, False, True, True)
    assert got["۱۲"][:4] == (False, False, True, False) and got["کتاب1"][:4] == (True, False, True, False) and got["nd[d"][4:] == (True, True)
    raw = spark.createDataFrame([(f"{ZWNJ}الف{ZWNJ}ب{ZWNJ}, {ZWNJ} x",)], "t string").select(predicates.raw_tokens(F.col("t")).alias("r")).first().r
    assert raw == [f"الف{ZWNJ}ب", "x"]
    forms = spark.createDataFrame([("a", "NOUN"), (".", "PUNCT"), ("12", "NUM"), ("%", "NOUN")], "f string, u string")
    assert [r[0] for r in forms.select(predicates.is_word(F.col("f"), F.col("u"))).collect()] == [True, False, False, False]


def test_sensitive_words(spark):
    texts = {"جنگ سرد": True, "جنگل سبز": False, "الاسلامی": True, "اسلام‌شناس": True, "ضد‌جنگ": True, "کتاب": False, "جَنگ": True, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", predicates.sensitive(F.col("t"), ["جنگ"], ["اسلام"]).alias("s"))
    assert {r.t: r.s for r in df.collect()} == texts


def test_overlaps_and_zips(spark):
    df = spark.createDataFrame([([(0, 3), (5, 8)], [1, 2], ["a", "b"])], "s array<struct<start:int,end:int>>, i array<int>, x array<string>")
    at = lambda a, b: predicates.overlaps(F.col("s"), F.lit(a), F.lit(b))
    assert tuple(df.select(at(3, 5), at(2, 4), at(7, 9)).first()) == (False, True, True)
    assert [tuple(r) for r in df.select(F.inline(predicates.zipped(id=F.col("i"), name=F.col("x")))).collect()] == [(1, "a"), (2, "b")]


def test_shards_and_answers(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i}", i) for i in range(40)], "word string, count long")
    labels.write_shards(words, str(tmp_path / "shards"), 4, F.col("count"))
    asked = spark.read.option("sep", "\t").schema("id long, word string, count long, shard int").csv(str(tmp_path / "shards")).collect()
    assert {(r.word, r["count"]) for r in asked} == {(f"w{i}", i) for i in range(40)} and len({r.shard for r in asked}) > 1
    lines = [f'{{"id": {r.id}, "lemma": "{r.word}!"}}' for r in asked[:10]] + ["not json", '{"id": "x"}', '{"lemma": "none"}']
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "out-00.jsonl").write_text("\n".join(lines))
    got = labels.read_answers(spark, str(tmp_path / "out"), str(tmp_path / "shards"), "lemma string").collect()
    assert {(r.word, r.lemma) for r in got} == {(r.word, r.word + "!") for r in asked[:10]}


def test_lines_and_cached_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "ب")], "id long, t string")
    readers.write_jsonl(rows, str(tmp_path / "j"))
    text = sorted(r.value for r in spark.read.text(str(tmp_path / "j")).collect())
    assert text == ['{"id":1,"t":null}', '{"id":2,"t":"ب"}']
    (tmp_path / "stop.dat").write_text("# words\nاز\n\nبه \nاز\n")
    assert {r.word for r in readers.stop_words(spark, str(tmp_path / "stop.dat")).collect()} == {"از", "به"}
    runs = spark.createDataFrame([(1, 3)], "query_id long, rank int")
    readers.write_runs(runs, str(tmp_path / "runs"), "h1")
    read = lambda h: readers.read_runs(spark, str(tmp_path / "runs"), h, "query_id long, rank int").collect()
    assert [tuple(r) for r in read("h1")] == [(1, 3)] and read("h2") == []


def test_sql_functions(spark):
    from kavosh.functions import register

    assert len(register.register(spark)) == 14
    one = lambda expression: spark.sql(f"SELECT {expression}").first()[0]
    assert one("fa_to_persian('nd[d')") == "دیجی" and one("fa_to_latin('دیجی')") == "nd[d" and one("fa_to_persian('`', 'mac-legacy')") == "پ"
    assert one("fa_word_key('آب‌ها')") == "ابها" and one("fa_piece_key('سابون')") == "2.5" and one("fa_distance('سابون', 'صابون')") == 0.3
    assert one("fa_excerpt('کتاب‌های خوب و بد', 'کتاب')") == "<mark>کتاب‌های</mark> خوب و بد" and one("fa_excerpt(NULL, 'x')") is None
    assert [tuple(r) for r in spark.sql("SELECT * FROM fa_tokenize('می روم')").collect()] == [("می‌روم", 0, 6)]
    assert [tuple(r) for r in spark.sql("SELECT weight, text FROM fa_html_regions('<body><h1>a</h1>b')").collect()] == [(1.0, "b"), (7.0, "a")]
