"""Registered queries of the library's own operators, over whole tables, and their oracle SQL.

The given tables hold no Persian text, so Persian operators run on Latin text moved to Persian letters by the keyboard
operator (`bridge`), a plain character map that both engines have. Facts for the metric queries (ranks, ratings) are
drawn from keys by arithmetic, alike in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.functions import distance, hashing, html, keyboard, normalize, predicates, tokens
from kavosh.functions import alphabet as A
from kavosh.functions.analyzer import Analyzer
from kavosh.operators import evaluation, labels, rescue, sampling, search, variants
from kavosh.plans import golden

_FROM, _TO = keyboard.persian_table("isiri9147")
_BACK = keyboard.latin_table("isiri9147")


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def _translate(column: str, source: str, target: str) -> str:
    return f"translate({column}, {_q(source)}, {_q(target)})"


def bridge(text: Column) -> Column:
    return keyboard.to_persian(F.lower(text))


_BRIDGE = _translate("lower({0})", _FROM, _TO)
_NORM = _translate("{0}", *A.tables())
_WORDS = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}\\p{{M}}‌]+')"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH t AS (SELECT unnest({_WORDS.format(_NORM.format('text'))}) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token HAVING count(*) >= 3")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(_read(spark, sf_dir, "documents", "text"), tokens.tokens(F.col("text"), rejoin=False))


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(normalize.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len({_WORDS.format(_NORM.format('text'))}) AS n_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(tokens.tokens(F.col("text"), rejoin=False)).cast("long").alias("n_tokens"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({_WORDS.format(_NORM.format('text'))}) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    return search.document_frequency(search.postings(docs, "doc_id", tokens.tokens(F.col("text"), rejoin=False)))


def _part_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_name")
    return search.postings(parts, "p_partkey", tokens.words(bridge(F.col("p_name"))))


def _part_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two words of every part whose key is divisible by 20: the query set of the searches."""
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_name").where("p_partkey % 20 = 0")
    return parts.select(F.col("p_partkey").alias("query_id"), F.slice(tokens.words(bridge(F.col("p_name"))), 1, 2).alias("terms"))


_INDEX = f"""post AS (SELECT term, p_partkey AS doc_id, count(*) AS tf, any_value(n_terms) AS n_terms FROM (SELECT p_partkey, unnest(w) AS term, len(w) AS n_terms FROM (SELECT p_partkey, {_WORDS.format(_BRIDGE.format('p_name'))} AS w FROM part)) GROUP BY ALL),
wanted AS (SELECT query_id, unnest(t) AS term, len(t) AS n_wanted FROM (SELECT p_partkey AS query_id, list_distinct({_WORDS.format(_BRIDGE.format('p_name'))}[1:2]) AS t FROM part WHERE p_partkey % 20 = 0))"""


@query(f"WITH {_INDEX} SELECT term, doc_id, tf, n_terms FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_index(spark, sf_dir)


_TOP = "SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM hits) WHERE rank <= 10"


@query(f"WITH {_INDEX}, hits AS (SELECT query_id, doc_id, sum(tf)::DOUBLE AS score FROM wanted JOIN post USING (term) GROUP BY query_id, doc_id, n_wanted HAVING count(*) = n_wanted) {_TOP}")
def and_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_part_index(spark, sf_dir), _part_queries(spark, sf_dir), "strict")


@query(f"""WITH {_INDEX}, df AS (SELECT term, count(*) AS df FROM post GROUP BY term), d AS (SELECT count(*) AS docs, avg(n_terms) AS mean FROM (SELECT doc_id, any_value(n_terms) AS n_terms FROM post GROUP BY doc_id)),
hits AS (SELECT query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n_terms / mean))), 6) AS score FROM wanted JOIN df USING (term) JOIN post USING (term) CROSS JOIN d GROUP BY query_id, doc_id) {_TOP}""")
def or_bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_part_index(spark, sf_dir), _part_queries(spark, sf_dir), "any-word", digits=6)


@query(f"""WITH {_INDEX}, short AS (SELECT DISTINCT query_id, left(term, 3) AS prefix FROM wanted), n AS (SELECT query_id, count(*) AS n FROM short GROUP BY query_id),
hits AS (SELECT query_id, doc_id, sum(tf)::DOUBLE AS score FROM short JOIN n USING (query_id) JOIN post ON starts_with(term, prefix) GROUP BY query_id, doc_id, n HAVING count(DISTINCT prefix) = n) {_TOP}""")
def prefix_search_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = _part_queries(spark, sf_dir).withColumn("terms", F.transform("terms", lambda t: F.substring(t, 1, 3)))
    return search.search(_part_index(spark, sf_dir), queries, "static-site")


@query(f"SELECT p_partkey, {_translate('p_name', _FROM, _TO)} AS persian FROM part")
def kbd_to_persian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", keyboard.to_persian(F.col("p_name")).alias("persian"))


@query(f"SELECT p_partkey, {_translate(_BRIDGE.format('p_name'), *_BACK)} AS latin FROM part")
def kbd_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", keyboard.to_latin(bridge(F.col("p_name"))).alias("latin"))


@query()
def kbd_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _read(spark, sf_dir, "part", "p_name").select(F.explode(F.split("p_name", " ")).alias("run")).distinct()
    return words.select("run", F.array_join(keyboard.keyboard_candidates(F.col("run")), "|").alias("candidates"))


_CASES = " ".join(f"WHEN left(key, 1) IN ({', '.join(_q(c) for c in g)}) THEN '{i}'" for i, g in enumerate(distance.CLASSES))
_SPELLED = f"""spelled AS (SELECT spelling, count(*) AS n FROM (SELECT unnest({_WORDS.format(_BRIDGE.format('text'))}) AS spelling FROM documents) GROUP BY spelling),
keyed AS (SELECT *, translate(spelling, 'آ‌', 'ا') AS key FROM spelled),
list AS (SELECT key, arg_min(spelling, (-n, spelling)) AS spelling, sum(n)::BIGINT AS count FROM keyed WHERE length(key) >= 3 AND regexp_full_match(key, {_q(A.PERSIAN_LETTER + '+')}) GROUP BY key)"""


@query(f"WITH {_SPELLED} SELECT key, spelling, count, CASE {_CASES} ELSE unicode(left(key, 1))::VARCHAR END || '.' || least(length(key), 15) AS piece FROM list")
def word_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.word_list(_read(spark, sf_dir, "documents", "text"), tokens.words(bridge(F.col("text"))))


@query()
def spelling_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes for the words of all part names among the words of part names with one letter dropped."""
    names = _read(spark, sf_dir, "part", "p_name")
    words = rescue.word_list(names, tokens.words(bridge(F.col("p_name"))))
    wrong = words.select(F.concat(F.substring("key", 1, 2), F.expr("substring(key, 4)")).alias("key"))
    return rescue.spell(words, wrong)


@query()
def query_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name typed on the wrong layout, mended by the words of all part names."""
    names = variants.spread(_read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey")
    typed = names.select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("query"), F.lit(0).alias("found"))
    words = rescue.word_list(names, tokens.words(bridge(F.col("p_name"))))
    return rescue.check(typed, rescue.index_terms(names, bridge(F.col("p_name"))), words)


@query(f"""WITH {_SPELLED}, w AS (SELECT key, count, CASE {_CASES} ELSE unicode(left(key, 1))::VARCHAR END || '.' || least(length(key), 15) AS piece FROM list),
b AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY piece ORDER BY key), '') AS before, row_number() OVER (PARTITION BY piece ORDER BY key) AS line FROM w),
s AS (SELECT *, list_sum(list_transform(range(1, 10), lambda n: (length(key) >= n AND length(before) >= n AND left(key, n) = left(before, n))::INT))::BIGINT AS shared FROM b)
SELECT piece, key, line, shared, substr(key, shared + 1) AS rest, least(9, floor(log2(count)))::INT AS level FROM s""")
def front_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescue.front_coded(word_list(spark, sf_dir))


@query(f"""SELECT key, count(*) AS searches FROM (SELECT '1:' || array_to_string(list_sort(list_distinct({_WORDS.format(_NORM.format(_BRIDGE.format('p_name')))})), ' ') AS key FROM part) GROUP BY key""")
def canonical_key_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Analyzer(profile="light", rejoin=False).canonical_key(bridge(F.col("p_name")))
    return _read(spark, sf_dir, "part", "p_name").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("searches"))


@query()
def analyzed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all documents moved to Persian letters, by the standard profile, with their frequencies."""
    return Analyzer().vocabulary(_read(spark, sf_dir, "documents", "text"), bridge(F.col("text")))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT c_custkey, {_FNV.format('c_name')} AS hash, CASE WHEN {_FNV.format("('split/' || c_name)")} % 2 = 1 THEN 'test' ELSE 'dev' END AS half FROM customer")
def fnv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", hashing.fnv1a(F.col("c_name")).alias("hash"), hashing.split_of(F.col("c_name")).alias("half"))


@query(f"""WITH q AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY {_FNV.format('p_partkey::VARCHAR')}, p_partkey) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#22'))
SELECT p_partkey, p_brand FROM q WHERE n <= CASE p_brand WHEN 'Brand#11' THEN 25 ELSE 15 END""")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.quotas(_read(spark, sf_dir, "part", "p_partkey", "p_brand"), "p_brand", {"Brand#11": 0.25, "Brand#22": 0.15}, 100, "p_partkey")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def title_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_of(_read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_name", "p_partkey")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    rank = lambda m: F.when(F.col("o_orderkey") % m > 10, 0).otherwise(F.col("o_orderkey") % m)
    return o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("type"), F.col("o_orderstatus").alias("lemma"), rank(13).cast("int").alias("rank"), rank(17).cast("int").alias("rank_b"))


_RUNS = "runs AS (SELECT o_orderkey, o_custkey, o_orderpriority AS type, o_orderstatus AS lemma, CASE WHEN o_orderkey % 13 > 10 THEN 0 ELSE o_orderkey % 13 END AS rank, CASE WHEN o_orderkey % 17 > 10 THEN 0 ELSE o_orderkey % 17 END AS rank_b FROM orders)"


@query(f"WITH {_RUNS} SELECT type, count(*) AS n, round(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 9) AS recall, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END), 9) AS mrr FROM runs GROUP BY type")
def recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.recall_mrr(_runs(spark, sf_dir), "type").select("type", "n", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@query(f"""WITH {_RUNS}, t AS (SELECT type, count(*) FILTER (rank > 0)::DOUBLE AS k, count(*)::DOUBLE AS n FROM runs GROUP BY type)
SELECT type, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS low, round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 9) AS high FROM t""")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _runs(spark, sf_dir).groupBy("type").agg(F.count_if(F.col("rank") > 0).cast("double").alias("k"), F.count(F.lit(1)).cast("double").alias("n"))
    low, high = evaluation.wilson(F.col("k"), F.col("n"))
    return t.select("type", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query(f"""WITH {_RUNS}, v AS (SELECT o_custkey AS base, CASE WHEN type LIKE '1%' THEN 'canonical' ELSE type END AS type, rank FROM runs)
SELECT type, count(*) AS n, round(avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END), 9) AS kept FROM v WHERE type <> 'canonical' AND base IN (SELECT base FROM v WHERE type = 'canonical' AND rank > 0) GROUP BY type""")
def kept_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select(F.col("o_custkey").alias("base"), F.when(F.col("type").startswith("1"), "canonical").otherwise(F.col("type")).alias("type"), "rank")
    return evaluation.kept_rate(rows, "type").withColumn("kept", F.round("kept", 9))


@query(f"WITH {_RUNS} SELECT type, round(avg(m), 9) AS macro, count(*) AS groups FROM (SELECT type, lemma, avg(CASE WHEN rank > 0 THEN 1.0 ELSE 0.0 END) AS m FROM runs GROUP BY type, lemma) GROUP BY type")
def macro_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).withColumn("hit", F.when(F.col("rank") > 0, 1.0).otherwise(0.0))
    return evaluation.macro_mean(rows, "hit", "lemma", "type").withColumn("macro", F.round("macro", 9))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumnRenamed("rank", "rank_a")


@query(f"""WITH RECURSIVE {_RUNS}, c AS (SELECT type, count(*) FILTER (rank > 0 AND rank_b = 0) AS lost, count(*) FILTER (rank = 0 AND rank_b > 0) AS gained FROM runs GROUP BY type),
tail AS (SELECT type, lost, gained, 0 AS i, -(lost + gained) * ln(2.0) AS l FROM c UNION ALL SELECT type, lost, gained, i + 1, l + ln((lost + gained - i) / (i + 1.0)) FROM tail WHERE i < least(lost, gained))
SELECT type, lost, gained, round(least(1.0, 2 * sum(exp(l))), 9) AS p FROM tail GROUP BY type, lost, gained""")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mcnemar(_pairs(spark, sf_dir), "type").withColumn("p", F.round("p", 9))


_WILCOXON = f"""{_RUNS}, d AS (SELECT type, (rank_b - rank)::DOUBLE AS d FROM runs WHERE rank_b <> rank),
r AS (SELECT type, d, rank() OVER (PARTITION BY type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY type, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY type, abs(d)) AS t FROM d),
w AS (SELECT type, count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY type),
z AS (SELECT *, greatest(0, abs(w - n * (n + 1) / 4.0) - 0.5) / sqrt(n * (n + 1.0) * (2 * n + 1) / 24 - ties / 48) / sqrt(2.0) AS x FROM w),
p AS (SELECT type, n, w, least(1.0, exp(-x * x) * (0.254829592 * t + -0.284496736 * t * t + 1.421413741 * t ** 3 + -1.453152027 * t ** 4 + 1.061405429 * t ** 5)) AS p FROM (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z))"""


@query(f"WITH {_WILCOXON} SELECT type, n, w, round(p, 9) AS p FROM p")
def wilcoxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _runs(spark, sf_dir).select("type", F.col("rank").cast("double").alias("a"), F.col("rank_b").cast("double").alias("b"))
    return evaluation.wilcoxon(rows, "type").select("type", F.col("n").cast("long").alias("n"), F.col("w").cast("double").alias("w"), F.round("p", 9).alias("p"))


_BH = """SELECT c_custkey, p, q FROM (SELECT c_custkey, p, least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM
(SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS r FROM (SELECT c_custkey, (c_custkey * 7919 % 10007) / 10007.0 AS p FROM customer)))"""


@query(f"SELECT c_custkey, round(p, 9) AS p, round(q, 9) AS q FROM ({_BH})")
def bh_qvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family of tests: all customers."""
    cells = _read(spark, sf_dir, "customer", "c_custkey").withColumn("p", F.col("c_custkey") * 7919 % 10007 / F.lit(10007.0))
    return evaluation.benjamini_hochberg(cells).select("c_custkey", F.round("p", 9).alias("p"), F.round("q", 9).alias("q"))


@query("""SELECT p_partkey, CASE WHEN q < 0.05 AND n >= 10 THEN CASE WHEN d <= -0.02 THEN 'block' WHEN d < 0 THEN 'down' WHEN d > 0 THEN 'up' ELSE 'none' END ELSE 'none' END AS verdict
FROM (SELECT p_partkey, p_partkey % 100 / 1000.0 AS q, (p_partkey % 7 - 3) / 100.0 AS d, p_size AS n FROM part)""")
def gate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _read(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", (F.col("p_partkey") % 100 / F.lit(1000.0)).alias("q"), ((F.col("p_partkey") % 7 - 3) / F.lit(100.0)).alias("delta"), F.col("p_size").alias("n"))
    return evaluation.gate(cells).select("p_partkey", "verdict")


@query("""WITH t AS (SELECT o_orderpriority AS type, count(*) AS n, avg((o_orderkey % 3 = 0)::INT) AS x, avg((o_orderkey % 6 < 3)::INT) AS y, avg(((o_orderkey % 3 = 0) = (o_orderkey % 6 < 3))::INT) AS a FROM orders GROUP BY 1)
SELECT type, n, round(a, 9) AS agreement, round((a - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 9) AS kappa FROM t""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select(F.col("o_orderpriority").alias("type"), (F.col("o_orderkey") % 3 == 0).alias("a"), (F.col("o_orderkey") % 6 < 3).alias("b"))
    out = evaluation.kappa(rows, "a", "b", "type")
    return out.select("type", "n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL), b AS (SELECT o_custkey, sum(n)::BIGINT AS total, arg_min(o_orderstatus, (-n, o_orderstatus)) AS o_orderstatus, max(n) AS n FROM c GROUP BY o_custkey)
SELECT o_custkey, o_orderstatus, n, total FROM b WHERE n >= 0.6 * total""")
def dominant_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.dominant(_read(spark, sf_dir, "orders", "o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus", 0.6)


@query("SELECT type, value FROM (SELECT o_orderpriority AS type, o_totalprice AS value, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE r = floor(0.95 * n)")
def nearest_rank_pctl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders", "o_orderpriority", "o_totalprice").withColumnRenamed("o_orderpriority", "type")
    return evaluation.nearest_rank(rows, "o_totalprice", 0.95, "type")


@query("""WITH f AS (SELECT DISTINCT p_brand AS lemma, left(p_name, 4) AS term, p_name AS form FROM part), c AS (SELECT lemma, term, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT sum(n) * (sum(n) - 1) / 2 AS within, sum(n * (n - 1) / 2) AS together FROM c GROUP BY lemma), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS same, sum(n * (n - 1) / 2) AS own FROM c GROUP BY term),
a AS (SELECT sum(within) AS within, sum(within - together) AS apart FROM l), b AS (SELECT sum(same - own) AS met FROM t), x AS (SELECT count(*) * (count(*) - 1) / 2 AS every FROM f)
SELECT within::DOUBLE AS within, apart::DOUBLE AS apart, (every - within)::DOUBLE AS across, met::DOUBLE AS met, round(apart / within, 9) AS ui, round(met / (every - within), 9) AS oi FROM a, b, x""")
def pair_counts_ui_oi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_brand", "p_name").select(F.col("p_brand").alias("lemma"), F.substring("p_name", 1, 4).alias("term"), F.col("p_name").alias("form"))
    return evaluation.conflation(rows, "lemma", "term", "form").withColumns({"ui": F.round("ui", 9), "oi": F.round("oi", 9)})


@query(f"""WITH v AS (SELECT token, count(*) AS n FROM (SELECT unnest({_WORDS.format('text')}) AS token FROM documents) GROUP BY token),
g AS (SELECT {_NORM.format('token')} AS key, count(*) AS forms, list_reverse_sort(list(n)) AS c FROM v GROUP BY 1) SELECT key, forms, c[2] AS weight FROM g WHERE forms >= 2""")
def collision_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = search.vocabulary(_read(spark, sf_dir, "documents", "text"), tokens.words(F.col("text")), 1)
    return evaluation.collisions(words, "token", F.col("token"), normalize.fold(F.col("token")), "n")


@query("""WITH s AS (SELECT conv_id, turn, sum((length(text) % 3 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h FROM conversations)
SELECT conv_id, arg_min(turn, (-h, turn)) AS at, max(h)::BIGINT AS hits FROM s GROUP BY conv_id""")
def sliding_max_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.max_window(_read(spark, sf_dir, "conversations", "conv_id", "turn", "text"), F.length("text") % 3 == 0, 3, "turn", "conv_id")


@query(f"""WITH d AS (SELECT p_partkey AS target, {_WORDS.format('p_name')} AS dt FROM part), q AS (SELECT p_partkey AS query_id, p_partkey + p_partkey % 2 AS target, {_WORDS.format('p_name')} AS qt FROM part)
SELECT query_id, list_has_all(coalesce(dt, []), qt) AS covered FROM q LEFT JOIN d USING (target)""")
def coverage_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _read(spark, sf_dir, "part", "p_partkey", "p_name").withColumn("terms", tokens.words(F.col("p_name")))
    queries = parts.select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") + F.col("p_partkey") % 2).alias("target"), F.col("terms"))
    return search.covered(parts.select(F.col("p_partkey").alias("doc_id"), "terms").withColumnRenamed("doc_id", "target").withColumnRenamed("target", "doc_id"), queries)


@query(f"""WITH w AS (SELECT DISTINCT unnest({_WORDS.format(_NORM.format('text'))}) AS token FROM documents), k AS (SELECT DISTINCT unnest({_WORDS.format(_NORM.format('text'))}) AS token FROM benchmark) SELECT token FROM w ANTI JOIN k USING (token)""")
def anti_known_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.explode(tokens.tokens(F.col("text"), rejoin=False)).alias("token")
    docs, known = (_read(spark, sf_dir, t, "text").select(cut).distinct() for t in ("documents", "benchmark"))
    return docs.join(known, "token", "left_anti")


@query("""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS digest FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.md5(html.tag_free(F.col("html"))).alias("digest"))


@query()
def html_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _read(spark, sf_dir, "pages", "page_id", "html").select("page_id", html.regions("html").alias("r"))
    return r.select("page_id", "r.title", "r.has_body", F.posexplode_outer("r.regions").alias("pos", "x")).select("page_id", "title", "has_body", "pos", "x.region", "x.weight", "x.text", "x.end")


@query(f"""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM documents""")
def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(html.escaped(F.col("text"))).alias("digest"))


@query(f"SELECT p_partkey, {_translate(_BRIDGE.format('p_name'), 'یک', 'يك')} AS arabic, {_translate(_BRIDGE.format('p_name'), 'آ', 'ا')} AS bare FROM part")
def letter_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bridge(F.col("p_name"))
    return _read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.coalesce(variants.arabic_letters(text), text).alias("arabic"), F.coalesce(variants.without_madda(text), text).alias("bare"))


@query()
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", F.explode(variants.rewritten(bridge(F.col("p_name")))).alias("v"))
    return rows.select("p_partkey", "v.type", "v.text")


@query()
def typo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = bridge(F.col("p_name"))
    kinds = ("adjacent", "delete", "transpose", "uniform", "homophone")
    parts = variants.spread(_read(spark, sf_dir, "part", "p_partkey", "p_name"), "p_partkey")
    return parts.select("p_partkey", *(variants.typo(k)(text, F.col("p_partkey").cast("string")).alias(k) for k in kinds))


@query()
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 30 words of each document for the words of three letters that start with 'th'."""
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", html.excerpts("th[a-z]")("text").alias("excerpt"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders")
def content_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders", "o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("keys"))


_WORD32 = " + ".join(f"('0x' || substr(d, {{0}} + {2 * i}, 2))::BIGINT * {1 << 8 * (3 - i)}" for i in range(4))


@query(f"""WITH r AS (SELECT sha256(o_orderkey::VARCHAR || chr(31) || o_custkey::VARCHAR) AS d FROM orders), s AS (SELECT count(*) AS n, {", ".join(f"sum({_WORD32.format(1 + 8 * i)})::BIGINT AS s{i}" for i in range(4))} FROM r)
SELECT n, left(sha256(concat_ws(',', s0, s1, s2, s3, n)), 16) AS fingerprint FROM s""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fingerprint(_read(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")


@query(f"WITH {_RUNS} SELECT type AS row, round(avg(m), 9) AS mean, count(*) AS cells FROM (SELECT type, lemma, avg((rank > 0)::INT) AS m FROM runs GROUP BY ALL) GROUP BY type")
def cell_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _runs(spark, sf_dir).withColumn("hit", (F.col("rank") > 0).cast("int")).withColumnRenamed("type", "row")
    return evaluation.cell_means(hits, "hit", "row", "lemma").withColumn("mean", F.round("mean", 9))


@query("SELECT p_brand AS lemma, count(*) AS forms, count(DISTINCT left(p_name, 4)) AS terms, count(DISTINCT left(p_name, 4)) = 1 AS whole FROM part GROUP BY p_brand")
def lemma_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.families(_read(spark, sf_dir, "part", "p_brand", "p_name").select(F.col("p_brand").alias("lemma"), F.substring("p_name", 1, 4).alias("term")), "lemma", "term")


@query(f"WITH {_RUNS}, c AS (SELECT type, count(*) FILTER (rank = 0 AND rank_b > 0) AS fixed, count(*) FILTER (rank > 0 AND rank_b = 0) AS broken FROM runs GROUP BY type) SELECT *, fixed - broken AS net FROM c")
def fixed_broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.fixed_broken(_pairs(spark, sf_dir), "type")


@query("""WITH c AS (SELECT l_returnflag AS type, count(*) FILTER (l_orderkey % 3 = 0 AND l_partkey % 2 = 0) AS "right", count(*) FILTER (l_orderkey % 3 = 0) AS made, count(*) FILTER (l_partkey % 2 = 0) AS wanted FROM lineitem GROUP BY 1)
SELECT *, round("right" / made, 9) AS precision, round("right" / wanted, 9) AS recall FROM c""")
def join_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem", "l_returnflag", "l_orderkey", "l_partkey").select(F.col("l_returnflag").alias("type"), (F.col("l_orderkey") % 3 == 0).alias("made"), (F.col("l_partkey") % 2 == 0).alias("wanted"))
    return evaluation.join_precision(rows, "type").withColumns({"precision": F.round("precision", 9), "recall": F.round("recall", 9)})


def _offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).withColumn("fixed_rank", F.when(F.col("o_orderkey") % 4 == 0, F.col("rank_b")))


_OFFERS = f"{_RUNS}, o AS (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN rank_b END AS f FROM runs)"


@query(f"WITH {_OFFERS} SELECT type, count(*) AS n, round(avg((f IS NOT NULL)::INT), 9) AS noticed, round(avg(coalesce(rank = 0 AND f > 0, false)::INT), 9) AS helped, round(avg(coalesce(rank > 0 AND f = 0, false)::INT), 9) AS harmed FROM o GROUP BY type")
def notice_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.notice_rates(_offers(spark, sf_dir), "type").withColumns({c: F.round(c, 9) for c in ("noticed", "helped", "harmed")})


@query(f"WITH {_OFFERS} SELECT type, count(*) AS n, round(avg((rank > 0 OR coalesce(f, 0) > 0)::INT), 9) AS reached FROM o GROUP BY type")
def one_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.one_click(_offers(spark, sf_dir), "type").withColumn("reached", F.round("reached", 9))


@query("SELECT left(p_name, 4) AS term, count(DISTINCT p_brand) AS lemmas, (count(DISTINCT p_brand) * (count(DISTINCT p_brand) - 1) // 2)::BIGINT AS pairs FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2")
def wrong_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.wrong_merges(_read(spark, sf_dir, "part", "p_brand", "p_name").select(F.col("p_brand").alias("lemma"), F.substring("p_name", 1, 4).alias("term")), "lemma", "term")


@query("""WITH c AS (SELECT l_linestatus AS type, count(*) FILTER (l_orderkey % 3 = 0 AND l_partkey % 2 = 0) AS tp, count(*) FILTER (l_orderkey % 3 <> 0 AND l_partkey % 2 = 0) AS fp, count(*) FILTER (l_orderkey % 3 = 0 AND l_partkey % 2 <> 0) AS fn FROM lineitem GROUP BY 1)
SELECT *, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem", "l_linestatus", "l_orderkey", "l_partkey").select(F.col("l_linestatus").alias("type"), (F.col("l_orderkey") % 3 == 0).alias("gold"), (F.col("l_partkey") % 2 == 0).alias("said"))
    return evaluation.pair_metrics(rows, "gold", "said", "type").withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


_RAW = "list_filter(list_transform({0}, lambda w: regexp_replace(w, '^‌+|‌+$', '', 'g')), lambda w: w <> '')"


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_RAW.format(_WORDS.format('text'))}) AS token FROM documents) GROUP BY token")
def raw_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.vocabulary(_read(spark, sf_dir, "documents", "text"), predicates.raw_tokens(F.col("text")), 1)


@query(f"""WITH t AS (SELECT DISTINCT unnest({_WORDS.format("text || ' ' || " + _BRIDGE.format('text'))}) AS token FROM documents)
SELECT token, regexp_matches(token, '{predicates.SCRIPT}') AS arabic, regexp_matches(token, '^[A-Za-z][A-Za-z0-9-]*$') AS latin, regexp_matches(token, '[0-9۰-۹٠-٩]') AS digit, regexp_matches(token, '{predicates.PERSIAN_ONLY}') AS persian FROM t""")
def token_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("text", F.lit(" "), bridge(F.col("text")))
    words = _read(spark, sf_dir, "documents", "text").select(F.explode(tokens.words(both)).alias("token")).distinct()
    t = F.col("token")
    return words.select("token", predicates.is_arabic_script(t).alias("arabic"), predicates.is_latin(t).alias("latin"), predicates.has_digit(t).alias("digit"), predicates.is_persian_only(t).alias("persian"))


@query("SELECT doc_id, n_chars FROM documents WHERE length(text) >= 2000")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text", "n_chars").where(predicates.long_text(F.col("text"))).select("doc_id", "n_chars")


@query(f"SELECT word, CASE WHEN {_FNV.format("('lemma/' || word)")} % 10 = 0 THEN 'dev' WHEN {_FNV.format("('lemma/' || word)")} % 10 = 1 THEN 'test' ELSE 'train' END AS half FROM (SELECT DISTINCT p_name AS word FROM part)")
def lemma_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part", "p_name").select(F.col("p_name").alias("word")).distinct().select("word", hashing.lemma_split(F.col("word")).alias("half"))


@query("SELECT conv_id, turn, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM conversations")
def squashed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.md5(normalize.squash(F.col("text"))).alias("digest"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.select(F.col("l_partkey").alias("word"), (F.col("l_orderkey") % 3).alias("base"), (F.col("l_partkey") % 3).alias("target"), (F.col("l_suppkey") % 3).alias("term"), F.col("l_linenumber").cast("long").alias("count"))


@query("""WITH e AS (SELECT l_partkey IN (SELECT ps FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem)) AS seen, l_orderkey % 3 AS base, l_partkey % 3 AS target, l_suppkey % 3 AS term, l_linenumber AS n FROM lineitem)
SELECT seen, sum(n)::BIGINT AS tokens, sum(CASE WHEN base <> target AND term = target THEN n ELSE 0 END)::BIGINT AS fixed, sum(CASE WHEN base = target AND term <> target THEN n ELSE 0 END)::BIGINT AS broken,
sum(CASE WHEN base <> target THEN n ELSE 0 END)::BIGINT AS missed, sum(CASE WHEN base = target THEN n ELSE 0 END)::BIGINT AS hit FROM e GROUP BY seen""")
def seen_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.seen_unseen(_examples(spark, sf_dir), _read(spark, sf_dir, "lineitem", "l_suppkey").withColumnRenamed("l_suppkey", "word"))


@query("""WITH a AS (SELECT o_orderkey % 4 AS gold, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 4 END AS a, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 4 END AS b FROM orders),
e AS (SELECT gold, 'a' AS rater, a AS said FROM a UNION ALL SELECT gold, 'b', b FROM a UNION ALL SELECT gold, 'agree', CASE WHEN a = b THEN a END FROM a)
SELECT rater, count(*) AS n, count(said) AS answered, count(*) FILTER (said = gold) AS "right" FROM e GROUP BY rater""")
def rater_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = _read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((o % 4).alias("gold"), F.when(c % 5 > 0, c % 4).alias("a"), F.when(o % 7 > 0, o % 4).alias("b"))
    return labels.rater_scores(rows)


@query(f"""WITH c AS (SELECT p_name AS word, p_size AS n FROM part WHERE p_size >= 10 UNION ALL SELECT p_type, p_size FROM part), w AS (SELECT word, max(n)::BIGINT AS count FROM c GROUP BY word)
SELECT word, count, {_FNV.format("('bulk/' || word)")} AS turn FROM w WHERE word NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0)""")
def labelling_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size").withColumn("count", F.col("p_size").cast("long"))
    sources = [p.where("p_size >= 10").withColumnRenamed("p_name", "word"), p.withColumnRenamed("p_type", "word")]
    return labels.queue(sources, p.where("p_partkey % 3 = 0").withColumnRenamed("p_name", "word"), "bulk")


@query(f"WITH {_RUNS}, b AS (SELECT o_orderkey, rank_b FROM runs WHERE o_orderkey % 5 <> 0) SELECT o_orderkey, rank AS rank_a, coalesce(b.rank_b, 0) AS rank_b FROM runs LEFT JOIN b USING (o_orderkey)")
def paired_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of one query set; a query that the second lacks counts as missing there."""
    runs = _runs(spark, sf_dir)
    second = runs.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("rank_b").alias("rank"))
    return evaluation.paired(runs.select("o_orderkey", "rank"), second, ["o_orderkey"])


QUERIES |= golden.QUERIES
SQL |= golden.SQL
