"""SQL names for the text functions of a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from .alphabet import ZWNJ
from .analyzer import Analyzer
from .distance import CLASSES, LONGEST, distance
from .html import excerpt_of, regions_of
from .keyboard import LAYOUTS, latin_table, persian_table
from .normalize import with_offsets
from .tokens import tokens_of


def register(spark: SparkSession, analyzer: Analyzer | None = None) -> list[str]:
    """Registers the fa_* functions; each works on a whole batch of rows."""
    a = analyzer or Analyzer()

    def terms(text: str, mode: str) -> list[str]:
        stemmer = a.stemmer()
        stem = stemmer.stem if stemmer else (lambda t: t.replace(ZWNJ, ""))
        return [t for w, _, _ in tokens_of(text, a.hamza_yeh, a.rejoin) for t in a.terms_of(w, stem, mode == "index")]

    each = lambda f: lambda s: s.map(lambda t: None if t is None else f(t))
    functions = {
        "fa_normalize": ("string", each(lambda t: with_offsets(t)[0])),
        "fa_tokens": ("array<string>", each(lambda t: [w for w, _, _ in tokens_of(t)])),
        "fa_terms": ("array<string>", each(lambda t: terms(t, "index"))),
        "fa_query_terms": ("array<string>", each(lambda t: list(dict.fromkeys(terms(t, "query"))))),
        "fa_canonical_key": ("string", each(lambda t: "1:" + " ".join(sorted(set(terms(t, "query")))))),
        "fa_title": ("string", each(lambda t: regions_of(t)["title"])),
    }
    for name, (kind, f) in functions.items():
        spark.udf.register(name, _udf(f, kind))
    spark.udf.register("fa_distance", _udf2(lambda x, y: distance(x, y, 1.0), "double"))

    def excerpt(text: str, query: str) -> str:
        wanted = tuple(dict.fromkeys(terms(query, "query")))
        found = tokens_of(text, a.hamza_yeh, a.rejoin)
        hits = [bool(wanted) and any(x.startswith(wanted) for x in (w.replace(ZWNJ, ""), *terms(w, "index"))) for w, _, _ in found]
        return excerpt_of(text, [span[1:] for span in found], hits)

    spark.udf.register("fa_excerpt", _udf2(excerpt, "string"))
    # What is one expression stays one: SQL functions are inlined into the plan.
    for head, kind, body in _native():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("fa_tokenize", udtf(_Tokens, returnType="token string, start int, end int"))
    spark.udtf.register("fa_html_regions", udtf(_Regions, returnType="region int, weight double, text string"))
    return [*functions, "fa_distance", "fa_excerpt", *(head.partition("(")[0] for head, _, _ in _native()), "fa_tokenize", "fa_html_regions"]


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _native() -> list[tuple[str, str, str]]:
    """(name and parameters, type, expression) of the functions that need no Python."""
    layouts = lambda table: "CASE layout " + " ".join(f"WHEN '{name}' THEN translate(text, {_text(table(name)[0])}, {_text(table(name)[1])})" for name in LAYOUTS) + " END"
    classes = " ".join(f"WHEN left(word, 1) IN ({', '.join(map(_text, g))}) THEN '{i}'" for i, g in enumerate(CLASSES))
    return [
        ("fa_to_persian(text STRING, layout STRING DEFAULT 'isiri9147')", "STRING", layouts(persian_table)),
        ("fa_to_latin(text STRING, layout STRING DEFAULT 'isiri9147')", "STRING", layouts(latin_table)),
        ("fa_word_key(word STRING)", "STRING", f"translate(word, {_text('آ' + ZWNJ)}, 'ا')"),
        ("fa_piece_key(word STRING)", "STRING", f"concat_ws('.', CASE {classes} ELSE string(ascii(left(word, 1))) END, string(least(length(word), {LONGEST})))"),
    ]


class _Tokens:
    """A row for each token of a text, with its offsets in the original."""

    def eval(self, text: str):
        for token, start, end in tokens_of(text or ""):
            yield token, start, end


class _Regions:
    """A row for each region and weight of a page."""

    def eval(self, page: str):
        for r in regions_of(page or "")["regions"]:
            yield r["region"], r["weight"], r["text"]


def _udf(f, kind: str):
    @pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return f(s)

    return run


def _udf2(f, kind: str):
    @pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64" if kind == "double" else object)

    return run
