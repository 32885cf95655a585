"""Search, rescue, evaluation, sampling, readers, streaming and the registered queries against their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from kavosh.functions import tokens
from kavosh.operators import evaluation, rescue, sampling, search
from kavosh.plans.queries import QUERIES, SQL
from kavosh.sources import readers
from kavosh.streaming import jobs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    assert plain(QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def docs_of(spark):
    rows = [(1, "red big house"), (2, "red house house"), (3, "blue boat"), (4, ""), (5, None)]
    return spark.createDataFrame(rows, "id long, text string")


def test_matches(spark):
    index = search.postings(docs_of(spark), "id", tokens.tokens(F.col("text")))
    queries = spark.createDataFrame([(1, ["red", "house", "red"]), (2, ["boa", "bl"]), (3, ["nothing"])], "query_id long, terms array<string>")
    ids = lambda df: sorted((r.query_id, r.doc_id) for r in df.collect())
    assert ids(search.match_all(index, queries)) == [(1, 1), (1, 2)]
    assert ids(search.match_prefix(index, queries)) == [(1, 1), (1, 2), (2, 3)]
    assert [(r.query_id, r.doc_id, r["rank"]) for r in search.search(index, queries).orderBy("query_id", "rank").collect()] == [(1, 2, 1), (1, 1, 2)]
    assert {r.word for r in search.fuzzy(index, spark.createDataFrame([(1, ["hause"])], "query_id long, terms array<string>")).collect()} == {"house"}
    targets = spark.createDataFrame([(1, 1), (3, 2)], "query_id long, target long")
    assert {(r.query_id, r["rank"]) for r in search.rank_of(targets, search.search(index, queries)).collect()} == {(1, 2), (3, 0)}


def test_profiles_with_titles_and_sentinels(spark):
    cut = lambda rows: search.postings(spark.createDataFrame(rows, "id long, text string"), "id", F.split("text", " "))
    title, body = cut([(1, "red"), (2, "blue"), (3, "green")]), cut([(1, "boat at sea"), (2, "red boat here"), (3, "red_ boat")])
    queries = spark.createDataFrame([(1, ["red"])], "query_id long, terms array<string>")
    fielded = search.search(body, queries, "any-word-fielded", title=title).collect()
    plain_ = {r.doc_id: r.score for r in search.match_any(title, queries).collect()} | {r.doc_id: r.score for r in search.match_any(body, queries).collect()}
    assert {r.doc_id: r.score for r in fielded} == {1: pytest.approx(2 * plain_[1]), 2: pytest.approx(plain_[2])}
    assert [r.doc_id for r in search.search(body, queries, "exact-sentinel").collect()] == [2]


def test_spelling(spark):
    text = " ".join(["صابون"] * 12 + ["کتاب"] * 3 + ["کتاپ"])
    df = spark.createDataFrame([(text,)], "t string")
    words = rescue.word_list(df, tokens.tokens(F.col("t")))
    assert {(r.key, r["count"]) for r in words.collect()} == {("صابون", 12), ("کتاب", 3), ("کتاپ", 1)}
    keys = spark.createDataFrame([("سابون",), ("کتاب",), ("خیابان",), ("صابو",)], "key string")
    assert {(r.key, r.fix, r.cost) for r in rescue.spell(words, keys).collect()} == {("سابون", "صابون", 0.3), ("صابو", "صابون", 1.0)}
    log = spark.createDataFrame([(1, "sghl سابون", 0), (2, "صابون", 3), (3, "سابون", 2)], "query_id long, query string, found long")
    known = spark.createDataFrame([("صابون",), ("سلام",)], "term string")
    got = {r.query_id: (r.fixed, r.auto) for r in rescue.check(log, known, words).collect()}
    assert got == {1: ("سلام صابون", True), 3: ("صابون", False)}


def _site(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return rescue.index_terms(df, F.col("t")), rescue.word_list(df, tokens.tokens(F.col("t")))


def _fixes(spark, site, *asked):
    """What each (query, found) becomes, and whether by itself; None where it is left alone."""
    log = spark.createDataFrame([(i, q, n) for i, (q, n) in enumerate(asked)], "query_id long, query string, found long")
    got = {r.query_id: (r.fixed, r.auto) for r in rescue.check(log, *site).collect()}
    return [got.get(i) for i in range(len(asked))]


def test_rescue_of_layouts_and_typos(spark):
    """Golden vectors: keyboards, typos, what is left alone, splicing as typed."""
    site = _site(spark, "تحویل کالا در اهواز", "دیجی کالا فروشگاه", "صابون گیاهی", "کتاب\u200cخانه\u200cی مرکزی شهر", "كتابهاي قديمي", "گوشی samsung galaxy s23", "ژاپن و چین")
    mended = {("nd[d ;hgh", 0): ("دیجی کالا", True), ("Chmk", 0): ("ژاپن", True), ("طحویل کالا", 1): ("تحویل کالا", False), ("گوشی سشپسعدل", 1): ("گوشی samsung", True), ("سابون", 0): ("صابون", True), ("سابون گیاهی", 3): ("صابون گیاهی", False), ("  «سابون»،  گیاهی ", 3): ("  «صابون»،  گیاهی ", False)}
    alone = [("صابون گیاهی", 3), *((q, 0) for q in ("کتابخانه", "كتاب", "دیجی", "samsung", "S23", "تحویل", "iphone", "a52", "۱۴۰۲", "tv", "فر", "", "  "))]
    got = _fixes(spark, site, *mended, *alone, (None, 0))
    assert got == [*mended.values(), *[None] * (len(alone) + 1)]


def test_rescue_takes_one_layout_for_a_query(spark):
    assert _fixes(spark, _site(spark, "مکعب صنایع تحویل شد", "شر"), ("l;uf wkhdu jpmdg av", 0)) == [("مکعب صنایع تحویل شد", True)]


def test_rescue_suspects(spark):
    text = "فاصله " * 12 + "اجتماعی فصله"
    assert _fixes(spark, _site(spark, text), ("فصله اجتماعی", 0), ("فصله اجتماعی", 1)) == [("فاصله اجتماعی", True), None]
    assert _fixes(spark, _site(spark, text, "فصله", "فصله"), ("فصله اجتماعی", 0)) == [None]  # 12 against 3
    assert _fixes(spark, _site(spark, "برنج وارداتی صد"), ("بنج", 0), ("سد", 0)) == [None, None]  # three letters: sounds only


def test_rescue_search_keeps_a_fix_that_finds_something(spark):
    site = _site(spark, "تحویل کالا در اهواز", "دیجی کالا فروشگاه", "صابون گیاهی")
    stock = spark.createDataFrame([(1, "صابون"), (2, "گیاهی"), (3, "کالا")], "doc_id long, word string")
    search_ = lambda q: q.join(stock, F.expr("contains(query, word)")).select("query_id", "doc_id")
    asked = spark.createDataFrame([(1, "سابون"), (2, "سابون گیاهی"), (3, "nd[d ;hgh"), (4, "دیجی"), (5, "فروشگاح")], "query_id long, query string")
    results, fixes = rescue.rescue_search(search_, asked, *site)
    assert sorted(tuple(r) for r in results.select("query_id", "doc_id").collect()) == [(1, 1), (2, 2), (3, 3)]
    assert sorted((r.query_id, r.fixed, r.auto) for r in fixes.collect()) == [(1, "صابون", True), (2, "صابون گیاهی", False), (3, "دیجی کالا", True)]


def test_front_coding_round_trip(spark):
    words = rescue.word_list(spark.createDataFrame([("کتاب کتاب کتابها کتابهای کتابی سلام سلامت سلامت",)], "t string"), tokens.words(F.col("t")))
    back = rescue.front_decoded(rescue.front_coded(words))
    assert {(r.piece, r.key, r["count"]) for r in back.collect()} == {(r.piece, r.key, 1 << (r["count"].bit_length() - 1)) for r in words.collect()}


def test_statistics(spark):
    pairs = spark.createDataFrame([("t", 1, 0)] * 8 + [("t", 0, 1)] * 1 + [("t", 2, 2)], "type string, rank_a int, rank_b int")
    r = evaluation.mcnemar(pairs, "type").first()
    assert (r.lost, r.gained) == (8, 1) and r.p == pytest.approx(2 * (1 + 9) / 2**9)
    cells = spark.createDataFrame([(0.01,), (0.02,), (0.03,), (0.5,)], "p double")
    assert [round(r.q, 6) for r in evaluation.benjamini_hochberg(cells).orderBy("p").collect()] == [0.04, 0.04, 0.04, 0.5]
    w = evaluation.wilcoxon(spark.createDataFrame([("x", float(i), float(i + i % 3 - 1)) for i in range(30)], "g string, a double, b double"), "g").first()
    assert w.n == 20 and w.w == 105.0 and w.p == pytest.approx(1.0, abs=1e-6)
    assert evaluation.nearest_rank(spark.range(10), "id", 0.95).first().value == 9
    assert evaluation.nearest_rank(spark.range(10), "id", 0.95, inner=True).first().value == 8
    low, high = spark.range(1).select(*evaluation.wilson(F.lit(8.0), F.lit(10.0))).first()
    assert (round(low, 3), round(high, 3)) == (0.49, 0.943)
    a, b = (evaluation.fingerprint(spark.range(50).repartition(n), "id").first() for n in (1, 7))
    assert a == b and evaluation.fingerprint(spark.range(51), "id").first() != a
    assert math.isclose(spark.range(1).select(evaluation.normal_tail(F.lit(1.96))).first()[0], 0.025, abs_tol=1e-4)


@pytest.mark.parametrize("name", ["and_search_top10", "or_bm25_top10", "prefix_search_top10"])
def test_searches_ask_every_20th_part(spark, duck, name):
    asked = duck.execute("SELECT p_partkey FROM part WHERE p_partkey % 20 = 0").fetchall()
    assert {r.query_id for r in QUERIES[name](spark, SF).collect()} == {k for (k,) in asked}


def _q_values(cells):
    """(group, p) -> q by one sort."""
    out = {}
    for g in {g for g, _ in cells}:
        ps, q = sorted(p for h, p in cells if h == g), 1.0
        for r in range(len(ps), 0, -1):
            q = min(q, ps[r - 1] * len(ps) / r)
            out.setdefault((g, ps[r - 1]), q)
    return out


def test_q_values_of_all_customers(spark):
    big = SF.replace("0.001", "0.1")
    keys = [r.c_custkey for r in spark.read.parquet(f"{big}/customer.parquet").select("c_custkey").collect()]
    p = {k: k * 7919 % 10007 / 10007.0 for k in keys}
    want = _q_values([("", x) for x in p.values()])
    got = {r.c_custkey: r.q for r in QUERIES["bh_qvalues"](spark, big).collect()}
    assert len(keys) == 15_000 and set(got) == set(keys)
    assert all(got[k] == pytest.approx(want["", p[k]], abs=2e-9) for k in keys)


def test_q_values_by_group_in_ranges(spark):
    cells = [(g, round((i * 37 % 101 / 101) ** 4, 6)) for g, n in (("a", 300), ("b", 7), (None, 40)) for i in range(n)]
    df = spark.createDataFrame([(i, g, p, "x") for i, (g, p) in enumerate(cells)], "id long, g string, p double, q string").repartition(3)
    got = evaluation.benjamini_hochberg(df, "p", "g", parts=9)
    want = _q_values(cells)
    rows = got.collect()
    assert got.columns == ["id", "g", "p", "q"] and len(rows) == len(cells)
    assert all(r.q == pytest.approx(want[r.g, r.p], abs=1e-12) for r in rows)


def test_mcnemar_of_all_orders_against_brute_force(spark, duck):
    place = lambda key, m: 0 if key % m > 10 else key % m
    want = {}
    for key, kind in duck.execute("SELECT o_orderkey, o_orderpriority FROM orders").fetchall():
        a, b = place(key, 13) > 0, place(key, 17) > 0
        lost, gained = want.get(kind, (0, 0))
        want[kind] = (lost + (a and not b), gained + (b and not a))
    got = {r.type: (r.lost, r.gained, r.p) for r in QUERIES["mcnemar"](spark, SF).collect()}
    assert {k: v[:2] for k, v in got.items()} == want
    for lost, gained, p in got.values():
        tail = sum(math.comb(lost + gained, i) for i in range(min(lost, gained) + 1))
        assert p == pytest.approx(min(1.0, 2 * tail / 2 ** (lost + gained)), abs=2e-9)


def test_samples(spark):
    rows = spark.range(1000).withColumn("kind", F.col("id") % 4)
    assert sampling.supplement(rows, "kind", "id", 30).count() == 120
    one, two = (sorted(r.id for r in sampling.shuffled(rows.repartition(n), "id", 20, "s").collect()) for n in (1, 9))
    assert one == two and len(one) == 20


def test_readers(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('id\ttitle\n1\t"a\n2\tb\tc\n3\td\n')
    assert [tuple(r) for r in readers.tab_lines(spark, str(tmp_path / "t.tsv"), ["id", "title"]).orderBy("id").collect()] == [("1", '"a'), ("3", "d")]
    (tmp_path / "c.csv").write_text('id,title\n1,"a, ""b"""\n2,x,y\n3,z\n')
    assert [tuple(r) for r in readers.comma_lines(spark, str(tmp_path / "c.csv"), ["id", "title"]).orderBy("id").collect()] == [("1", 'a, "b"'), ("3", "z")]
    (tmp_path / "v.dat").write_text("# c\nرفت#رو\n")
    assert [tuple(r) for r in readers.verb_pairs(spark, str(tmp_path / "v.dat")).collect()] == [("رفت", "رو")]
    lines = ["# sent_id = s1", "1-2\tکتابم\t_\t_\t_\t_\t_\t_\t_\tSpaceAfter=No", "1\tکتاب\tکتاب\tNOUN\t_\t_\t0\troot\t_\t_", "2\tم\tمن\tPRON\t_\t_\t1\tx\t_\t_", "2.1\tx\tx\tX\t_\t_\t_\t_\t_\t_", "3\tاست\tاست\tAUX\t_\t_\t1\tx\t_\t_"]
    (tmp_path / "u.conllu").write_text("\n".join(lines) + "\n\n")
    assert [(r.pos, r.form, r.lemma) for r in readers.treebank(spark, str(tmp_path / "u.conllu")).collect()] == [(1, "کتابم", "کتاب"), (2, "است", "است")]
    words = spark.createDataFrame([("abc", "abc", 3, "97.3"), ("abcd", "abcd", 1, "97.4")], "key string, spelling string, count long, piece string")
    readers.write_words(words, str(tmp_path / "words"))
    assert [r.key for r in readers.read_words(spark, str(tmp_path / "words"), "97.4").collect()] == ["abcd"]


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:10:00", "b a", 1), ("2024-01-01 00:20:00", "a b", 2), ("2024-01-01 01:20:00", "a", 2)], "ts string, q string, user_id long").withColumn("ts", F.to_timestamp("ts"))
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    key = F.array_join(F.array_sort(F.split("q", " ")), " ")
    job = jobs.key_counts(stream, key).writeStream.format("memory").queryName("keys").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert {(r.key, r.searches, r.users) for r in spark.table("keys").collect()} == {("a b", 2, 2), ("a", 1, 1)}


def test_the_entry_lists_every_query():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())


@pytest.mark.parametrize("profile", ["strict", "any-word", "static-site"])
def test_copies_do_not_multiply_the_matches(spark, monkeypatch, profile):
    """The matches are of classes of queries and documents; the best are those of all queries and documents."""
    names = ["red big house", "red house", "big blue boat", "red red house"]
    index = search.postings(spark.createDataFrame([(i, names[i % 4]) for i in range(90)], "id long, text string"), "id", F.split("text", " "))
    queries = spark.createDataFrame([(i, names[i % 3].split()[:2]) for i in range(60)], "query_id long, terms array<string>")
    match, met = search.PROFILES[profile]["match"], []

    def spied(*args):
        met.append(match(*args).count())
        return match(*args)

    exact = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 6)) for r in df.collect())
    wanted = exact(search.top(match(index, queries).withColumn("score", F.round("score", 6)), 7))
    monkeypatch.setitem(search.PROFILES, profile, search.PROFILES[profile] | {"match": spied})
    found = search.search(index, queries, profile, 7)
    assert exact(found) == wanted and len(wanted) > 60 and found.columns == ["query_id", "doc_id", "score", "rank"]
    assert met[0] <= 3 * 4


def test_a_query_typed_often_is_mended_once(spark, monkeypatch):
    site, sizes, write = _site(spark, "سلام دنیا"), {}, rescue.written

    def spied(df, name):
        out = write(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(rescue, "written", spied)
    assert _fixes(spark, site, *[("sghl", 0)] * 20, ("sghl", 3), (None, 0)) == [("سلام", True)] * 21 + [None]
    assert sizes["spans"] == sizes["runs"] == 2
