"""Normalisation, tokens, stemming, analysis, keyboard and speller: golden vectors and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kavosh.functions import distance, hashing, html, keyboard, normalize, tokens
from kavosh.functions.alphabet import ZWNJ
from kavosh.functions.analyzer import Analyzer, parts
from kavosh.functions.stem import Lexicon, Stemmer, StemOptions, base_stem
from kavosh.operators import variants

NORMAL = {
    "كتاب": "کتاب", "علي": "علی", "مدرسة": "مدرسه", "أحمد": "احمد", "مؤمن": "مومن", "مسئول": "مسیول", "کِتابْ": "کتاب", "کتـــاب": "کتاب", "۱۲۳٤٥": "12345", "iPhone": "iphone",
    f"کتاب{ZWNJ}{ZWNJ}ها": f"کتاب{ZWNJ}ها", f"{ZWNJ}کتاب{ZWNJ} ها": "کتاب ها", "می¬روم": f"می{ZWNJ}روم", "a ¬ b": "a ¬ b", "سلاااام": "سلام", "ﻻ": "لا", "آب": "آب", "İ": "i̇", None: None, "": "",
}


def test_normalize_natively_and_with_offsets(spark):
    rows = spark.createDataFrame([(k,) for k in NORMAL], "t string").select("t", normalize.normalize(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == NORMAL
    for k, v in NORMAL.items():
        if k is not None:
            text, spans = normalize.with_offsets(k)
            assert text == v and len(spans) == len(text) and all(0 <= a < b <= len(k) for a, b in spans)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("كيابهاللأئ۱٤aZ ¬ـِ") + [ZWNJ, "​", "ﷺ", "𝒳"]), max_size=25))
def test_normalizing_twice_is_once(text):
    once, _ = normalize.with_offsets(text)
    assert normalize.with_offsets(once)[0] == once


def test_native_rejoining_is_the_kernel(spark):
    own = ["می روم به خانه ها", "نمی خواهم", "کتاب های من", "خسته اید", "کتاب اید", "خانه، ها", "خانه\nها", "ای خدا", "book ها", "بزرگ ترین خانه", "می می روم", "خانه ها یی", "", None, "نامه ای ها"]
    rows = spark.createDataFrame([(t,) for t in own], "t string").select("t", tokens.tokens(F.col("t")).alias("a"), tokens.tokens_with_offsets("t").alias("b")).collect()
    for r in rows:
        if r.t is None:
            assert r.a is None and r.b is None
        else:
            assert r.a == [x.text for x in r.b] == [w for w, _, _ in tokens.tokens_of(r.t)]
    assert [w for w, _, _ in tokens.tokens_of("می روم به خانه ها")] == [f"می{ZWNJ}روم", "به", f"خانه{ZWNJ}ها"]
    assert tokens.tokens_of("كِتاب 𝒳 ها")[0] == ("کتاب", 0, 5)


STEMS = {
    f"کتاب{ZWNJ}ها": "کتاب", "کتابها": "کتاب", f"می{ZWNJ}روم": "روم", "میروم": "میروم", f"نمی{ZWNJ}روم": "نمیرو", "كتاب": "کتاب", "ماهی": "ماهی", "ایران": "ایران", "زمان": "زمان", "دانشجویان": "دانشجو",
    "بهترین": "بهتر", "دستگاه": "دست", "زندگی": "زند", "ماهیت": "ماه", "سالانه": "سال", "کارمند": "کار", "هفته": "هفت", f"می{ZWNJ}کنند": "کنن", "رفتند": "رفتند", "میدان": "مید", "مهمان": "مهم", f"نامه{ZWNJ}ای": "نام",
}


@pytest.mark.parametrize("word", STEMS)
def test_base_stem(word):
    assert base_stem(word) == STEMS[word]


LEXICON = Lexicon.parse("رفت#رو شد#شو گفت#گو آمد#آ کرد#کن", "میدان سازمان", "کتب>کتاب", "n//2/;v//1/د\n0:بزرگتر\n1:کردن")


def test_verbs_and_lists():
    verb = LEXICON.verb
    assert verb("میروم") == "رفت" and verb("نمیروند") == "نرفت" and verb("نمیروند", False) == "رفت" and verb("میگوید") == "گفت" and verb("شود") == "شد"
    assert verb("بیاید") == "آمد" and verb("رفتی") is None and verb("کتاب") is None
    assert LEXICON.term("کتب") == "کتاب" and LEXICON.term("بزرگتر") == "بزرگ" and "بزرگتر" not in LEXICON.terms
    full = Stemmer(StemOptions(joined_min=3, single_min=3, lexicon=LEXICON))
    assert full.stem("میدانهای") == "میدان" and full.stem("کتابمان") == full.stem("کتاب") and full.stem(f"می{ZWNJ}روم") == "رفت"
    assert full.stem("abc") == "abc"


def test_protected_words_and_parts():
    assert Stemmer().stem("مهمان") == "مهمان" and Stemmer().stem(f"خانه{ZWNJ}هایمان") == Stemmer().stem("خانه")
    assert parts(f"کتاب{ZWNJ}خانه{ZWNJ}ها") == ["کتاب", f"خانه{ZWNJ}ها"] and parts(f"می{ZWNJ}روم") == [f"می{ZWNJ}روم"]


@pytest.mark.parametrize("profile", ["light", "standard", "full"])
def test_query_terms_are_index_terms(spark, profile):
    a = Analyzer(profile=profile, lexicon=LEXICON if profile == "full" else None)
    own = ["می روم به کتابخانه ها", f"کتاب{ZWNJ}خانه{ZWNJ}های آبی", "سگهای بزرگ", "آستین iPhone ۱۲", "", None]
    rows = spark.createDataFrame([(t,) for t in own], "t string").select("t", a.analyze(F.col("t")).alias("i"), a.analyze(F.col("t"), "query").alias("q"), tokens.tokens(F.col("t")).alias("k"), a.canonical_key(F.col("t")).alias("key")).collect()
    for r in rows:
        if r.t is not None:
            assert set(r.q) <= set(r.i) and len(r.q) == len(r.k) and r.key == "1:" + " ".join(sorted(set(r.q)))
    with pytest.raises(ValueError):
        Analyzer(profile="full")


def test_keyboards(spark):
    rows = [("sghl",), ("SGHL",), ("Sghl",), ("سلام",), ("hello",), ("اثممخ",), ("s70",)]
    df = spark.createDataFrame(rows, "r string").select("r", keyboard.keyboard_candidates(F.col("r")).alias("c"), keyboard.to_persian(F.col("r")).alias("p"), keyboard.to_latin(F.col("r")).alias("l"))
    got = {r.r: r for r in df.collect()}
    assert got["sghl"].p == "سلاخ"[:3] + "م" and "سلام" in got["sghl"].c and got["سلام"].l == "sghl"
    assert "سلام" in got["Sghl"].c and got["اثممخ"].c == ["hello"] and got["s70"].c == []


def test_distances():
    d = distance.distance
    assert d("صابون", "سابون", 1) == 0.3 and d("کتاب", "کتاب", 1) == 0 and d("عباس", "اباس", 1) == 0.3 and d("بعد", "باد", 1) == 1
    assert d("کتتاب", "کتاب", 1) == 0.5 and d("کتب", "کتاب", 1) == 0.8 and d("کاتب", "کتاب", 1) == 0.8 and d("کتاب", "مداد", 1) == float("inf")


def test_word_keys_and_pieces(spark):
    rows = spark.createDataFrame([(f"آب{ZWNJ}ها",), ("صابون",), ("سابون",), ("abc",)], "w string")
    key = distance.word_key(F.col("w"))
    got = {r.w: r for r in rows.select("w", key.alias("k"), distance.is_persian(key).alias("p"), distance.piece_key(F.substring(key, 1, 1), F.length(key)).alias("piece"), distance.pieces_for(key).alias("near")).collect()}
    assert got[f"آب{ZWNJ}ها"].k == "ابها" and got["صابون"].piece == got["سابون"].piece == "2.5" and not got["abc"].p
    assert got["صابون"].near == ["2.4", "2.5", "2.6"]


def test_fnv(spark):
    words = ["", "a", "split/سلام", "Customer#000000001"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", hashing.fnv1a(F.col("w")).alias("h")).collect()
    assert {r.w: r.h for r in got} == {w: hashing.seed_of(w) for w in words} and hashing.seed_of("") == 2166136261
    first = [next(hashing.mulberry32(s)) for s in range(50)]
    assert all(0 <= x < 1 for x in first) and len(set(first)) == 50


PAGE = "<html><head><title>T</title><script>no</script></head><body><h1>Head <b>one</b></h1><p>plain <i>wo</i>rd</p><div data-pagefind-ignore>no</div><label>no</label><footer>no</footer><p data-pagefind-weight=3>hea<time>vy</time></p><p>last &amp; &#1587;</p></body></html>"


def test_html_regions():
    r = html.regions_of(PAGE)
    assert (r["title"], r["has_body"], r["own_title"]) == ("Head one", False, False)
    assert [(x["weight"], x["text"]) for x in r["regions"]] == [(1.0, "plain word last & س"), (7.0, "Head one"), (3.0, "heavy")]  # as weights first occur, breaks included
    assert {PAGE[x["end"] :] for x in r["regions"]} == {"</body></html>"}
    marked = "<body>out<main data-pagefind-body>in <p>side</main>out<b data-pagefind-body=x>two</b><span data-pagefind-meta='title'>t</span></body>"
    r = html.regions_of(marked)
    assert r["has_body"] and r["own_title"] and [(x["region"], x["text"]) for x in r["regions"]] == [(0, "in side"), (1, "two")]
    assert [x["text"] for x in html.regions_of("a <i>frag</i>ment<br>only")["regions"]] == ["a frag ment only"]
    assert html.regions_of("")["regions"] == [] and html.regions_of("<body><p>never closed")["regions"][0]["end"] == len("<body><p>never closed")
    assert html.unescape_text("&lt;&#x645;&#1587;&zwnj;&nope;&amp;lt; &#0;") == "<م\u0633\u200c&nope;&lt; &#0;"


def test_annotated_pages(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<body></body>"), (3, None)], "id long, h string")
    terms = lambda text: F.split(text, " ")
    once = html.annotated_pages(df, "id", "h", terms)
    got = {r.id: r.html for r in once.collect()}
    blocks = '<div hidden data-terms>plain word last &amp; س</div><div hidden data-terms data-pagefind-weight="7">Head one</div><div hidden data-terms data-pagefind-weight="3">heavy</div>'
    title = '<span hidden data-terms data-pagefind-meta="title[data-terms-title], original[data-terms-original]" data-terms-title="Head one" data-terms-original="Head one"></span>'
    assert got == {1: PAGE.replace("</body>", blocks + title + "</body>"), 2: "<body></body>", 3: None}
    assert {r.id: r.html for r in html.annotated_pages(once.withColumnRenamed("html", "h"), "id", "h", terms).collect()} == got


def test_excerpts(spark):
    text = "a, b; <c> d-e"
    spans = [(0, 1), (3, 4), (7, 8), (10, 11), (12, 13)]
    assert html.excerpt_of(text, spans, [False, False, True, True, False], 2) == "<mark>c</mark>&gt; <mark>d</mark>"
    assert html.excerpt_of(text, spans, [False] * 5, 3) == "a, b; &lt;c" and html.excerpt_of("<" * 300, [], [], 3) == "&lt;" * 200
    for n, size in ((9, 4), (3, 5), (12, 3)):
        for bits in range(1 << n):
            hits = [bool(bits >> i & 1) for i in range(n)]
            begin = html.window_of(hits, size)
            assert 0 <= begin <= max(0, n - size) and sum(hits[begin : begin + size]) == max(sum(hits[i : i + size]) for i in range(n))
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(html.unescaped(html.escaped(F.col("t"))).alias("t")).first().t == text


def test_variants(spark):
    df = spark.createDataFrame([("کتاب آبی یک",), ("book",)], "t string").select("t", variants.rewritten(F.col("t")).alias("v"))
    got = {r.t: {x.type: x.text for x in r.v} for r in df.collect()}
    assert got["کتاب آبی یک"]["arabic-yk"] == "كتاب آبي يك" and got["کتاب آبی یک"]["alef-madda"] == "کتاب ابی یک" and "arabic-yk" not in got["book"]
    forms = spark.range(1).select(F.explode(variants.verb_forms(F.lit("رفت"), F.lit("رو"))).alias("f")).select("f.*").collect()
    assert {f.form for f in forms} >= {"رفتم", "نرفتند", f"می{ZWNJ}روم", "بروید", "رفتن"} and len(forms) == 52


def test_conjugation(spark):
    verbs = spark.createDataFrame([("آمد", "آ"), ("افتاد", "افت"), ("گفت", "گو"), ("بایست", "")], "past string, present string")
    forms = {(r.past, r.form): (r.tense, r.person, r.negative) for r in variants.conjugated(verbs).collect()}
    assert forms["آمد", f"می{ZWNJ}آیم"] == ("present", 1, False) and forms["آمد", "بیاید"] == ("subjunctive", 3, False) and forms["آمد", "نیامدم"] == ("past", 1, True)
    assert forms["افتاد", "نیفتاد"] == ("past", 3, True) and forms["گفت", "نگفته"] == ("participle", 0, True)
    assert {t for (p, _), (t, *_) in forms.items() if p == "بایست"} == {"past", "past-progressive", "infinitive", "participle"}
    asked = spark.createDataFrame([("گفت", "گو", "present", 2, True)], "past string, present string, tense string, person int, negative boolean")
    assert [r.form for r in variants.generated(asked, verbs).collect()] == [f"نمی{ZWNJ}گوی"]
    words = spark.createDataFrame([("نیامدند",), ("کتاب",)], "word string")
    assert [(r.word, r.past, r.negative) for r in variants.analyzed(words, verbs).collect()] == [("نیامدند", "آمد", True)]


def test_attested_variants(spark):
    vocab = spark.createDataFrame([("رییس", 30), ("موسسه", 5), (f"کتاب{ZWNJ}ها", 9), ("کتابها", 2), ("کتاب", 90), ("کتابش", 7)], "token string, n long")
    rows = spark.createDataFrame([(1, "رئیس مؤسسه"), (2, "کتاب خوب"), (3, "کتابها"), (4, "")], "id long, t string")
    got = lambda kind, least: {(r.id, r.text) for r in variants.attested(rows, "id", "t", vocab, kind, least).collect()}
    assert got("hamza", 20) == {(1, "رییس مؤسسه")} and got("plural-add", 5) == {(2, f"کتاب{ZWNJ}ها خوب")} and got("plural-drop", 5) == {(3, "کتاب")}
    assert got("zwnj-add", 5) == {(3, f"کتاب{ZWNJ}ها")} and got("clitic-add", 5) == {(2, "کتابش خوب")} and got("clitic-add", 8) == set()
    digit = spark.createDataFrame([("a1۲",), ("۱۲",), ("١",), ("x",)], "t string").select(variants.digits(F.col("t")))
    assert [r[0] for r in digit.collect()] == ["a۱۲", "12", "1", None]


def test_excerpts_keep_the_words_inside(spark):
    """A text's words are no column between two kernels, where they took ten times the text's memory."""
    from kavosh.plans.queries import QUERIES

    plan = QUERIES["excerpts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "rlike" not in plan
    df = spark.createDataFrame([("Tha, <b> the THEN",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(html.excerpts("th[a-z]", 3)("t")).collect()] == ["<mark>Tha</mark>, &lt;b&gt; <mark>the</mark>", "", None]
    for t in ("aÉ 1۲ Ωb", "می روم", "a‌b", "İb", "ککک", "xًy"):
        n, spans = normalize.with_offsets(t)
        got = normalize.in_place(t)
        assert got is None or (got == n and spans == [(i, i + 1) for i in range(len(t))])
    assert normalize.in_place("aÉ 1۲ Ωb") == "aé 12 ωb"


def test_html_regions_go_on_in_slices():
    import pandas as pd

    pages = pd.Series([PAGE, None] * 300)
    got = list(html.regions.func(iter([pages, pages[:0]])))
    assert [len(g) for g in got] == [250, 250, 100] and pd.concat(got)["title"].tolist() == ["Head one", ""] * 300


def test_typos_of_one_file_are_dealt_out(spark):
    from kavosh.plans.queries import QUERIES

    got = QUERIES["typo_variants"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() == 4 and len({r.p_partkey for r in got.collect()}) == got.count()
