"""Rewriters that turn a query into the ways people type it. Each gives a Column: the variant, or null if it has none."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kavosh.functions.alphabet import ZWNJ
from kavosh.functions.distance import ROWS
from kavosh.functions.hashing import fnv1a, seed_of
from kavosh.functions.keyboard import latin_table, persian_table
from kavosh.functions.normalize import standard_typing

_PERSIAN_DIGITS = "".join(chr(0x6F0 + d) for d in range(10))
_ARABIC_DIGITS = "".join(chr(0x660 + d) for d in range(10))


def _changed(text: Column, new: Column) -> Column:
    return F.when(new != text, new)


def arabic_letters(text: Column) -> Column:
    return _changed(text, F.translate(text, "یک", "يك"))


def standard(text: Column) -> Column:
    return _changed(text, standard_typing(text))


def without_madda(text: Column) -> Column:
    return _changed(text, F.translate(text, "آ", "ا"))


def hamza(text: Column) -> Column:
    return _changed(text, F.translate(text, "أإؤئ", "ااوی"))


def heh_yeh(text: Column) -> Column:
    """The ezafe of a final ه, written with its mark or with a half-space and ی."""
    return _changed(text, F.regexp_replace(F.replace(text, F.lit("ۀ"), F.lit("ه" + ZWNJ + "ی")), "هٔ", "ه" + ZWNJ + "ی"))


def without_marks(text: Column) -> Column:
    return _changed(text, F.regexp_replace(text, "[ً-ْٰ]", ""))


def digits(text: Column) -> Column:
    """The digits in another script: Latin ones become Persian; without any, Persian or else Arabic ones become Latin."""
    every = "0123456789"
    persian, arabic = text.rlike("[۰-۹]"), text.rlike("[٠-٩]")
    return F.when(text.rlike("[0-9]"), F.translate(text, every, _PERSIAN_DIGITS)).when(persian, F.translate(text, _PERSIAN_DIGITS, every)).when(arabic, F.translate(text, _ARABIC_DIGITS, every))


def half_space_as_space(text: Column) -> Column:
    return _changed(text, F.replace(text, F.lit(ZWNJ), F.lit(" ")))


def half_space_dropped(text: Column) -> Column:
    return _changed(text, F.replace(text, F.lit(ZWNJ), F.lit("")))


def half_space_added(text: Column) -> Column:
    """A joined plural with its half-space."""
    return _changed(text, F.regexp_replace(text, "(\\p{L}{2,})(?<!‌)(ها|های)(?=\\s|$)", f"$1{ZWNJ}$2"))


def plural_added(text: Column) -> Column:
    return _changed(text, F.regexp_replace(text, "^(\\p{L}{3,})(?=\\s|$)", f"$1{ZWNJ}ها"))


def plural_dropped(text: Column) -> Column:
    return _changed(text, F.regexp_replace(text, "‌?(هایی|های|ها)(?=\\s|$)", ""))


def clitic_added(text: Column, clitic: str = "ش") -> Column:
    return _changed(text, F.regexp_replace(text, "(\\p{L}{3,})$", f"$1{clitic}"))


def verb_negated(text: Column) -> Column:
    return _changed(text, F.regexp_replace(text, "(^|\\s)می‌", f"$1نمی{ZWNJ}"))


def on_layout(text: Column, typed: str, active: str) -> Column:
    """What appears when the keys of `text` on one Persian layout are pressed while another is active."""
    return _changed(text, F.translate(F.translate(text, *latin_table(typed)), *persian_table(active)))


def latin_on_persian(text: Column, layout: str = "isiri9147") -> Column:
    return _changed(text, F.translate(F.lower(text), *persian_table(layout)))


def typo(kind: str):
    """A seeded misspelling of the longest word: adjacent, delete, transpose, uniform or homophone. Args: text, seed."""
    rows = ROWS.split()
    near = {c: [r[j] for j in (i - 1, i + 1) if 0 <= j < len(r)] for r in rows for i, c in enumerate(r)}
    alike = {c: [x for x in g if x != c] for g in ("زذضظ", "ثسص", "تط", "حه", "غق") for c in g}
    letters = sorted(near)

    def change(text: str, seed: str) -> str | None:
        rng = random.Random(seed_of(f"{kind}/{seed}"))
        found = sorted(re.finditer(r"[^\W\d_]{4,}", text), key=lambda m: (-len(m[0]), m.start()))
        if not found:
            return None
        m = found[0]
        w = m[0]
        choices = {"adjacent": near, "homophone": alike}.get(kind)
        places = [i for i, c in enumerate(w) if choices is None or choices.get(c)]
        if kind == "transpose":
            places = [i for i in range(len(w) - 1) if w[i] != w[i + 1]]
        if not places:
            return None
        i = rng.choice(places)
        if kind == "delete":
            new = w[:i] + w[i + 1 :]
        elif kind == "transpose":
            new = w[:i] + w[i + 1] + w[i] + w[i + 2 :]
        else:
            new = w[:i] + rng.choice(choices[w[i]] if choices else [c for c in letters if c != w[i]]) + w[i + 1 :]
        return text[: m.start()] + new + text[m.end() :]

    @pandas_udf("string")
    def run(text: pd.Series, seed: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else change(t, str(s)) for t, s in zip(text, seed, strict=True)], dtype=object)

    return run


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that cost much work each, dealt to all of the shuffle's partitions by a key: their file may be one split."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def prefixed(prefix: str, stem: Column) -> Column:
    """A stem after ب or ن: an initial آ is written یا, an initial ا is written ی."""
    rest = F.regexp_replace(stem, "^.", "")
    return F.concat(F.lit(prefix), F.when(stem.startswith("آ"), F.concat(F.lit("یا"), rest)).when(stem.startswith("ا"), F.concat(F.lit("ی"), rest)).otherwise(stem))


# Personal endings of the past and of the present.
PERSONS = (("م", "م"), ("ی", "ی"), ("", "د"), ("یم", "یم"), ("ید", "ید"), ("ند", "ند"))


def verb_forms(past: Column, present: Column) -> Column:
    """The forms of a verb: an array of (form, tense, person: 1 to 6, 0 for none, negative).

    A present stem that ends in ا or آ takes a glide ی before its endings; a verb without a present stem has past forms only.
    """
    stem = F.when(present.rlike("[اآ]$"), F.concat(present, F.lit("ی"))).otherwise(present)
    has = F.coalesce(F.length(present) > 0, F.lit(False))
    made = []
    for negative in (False, True):
        no = "ن" if negative else ""
        own = prefixed("ن", past) if negative else past
        for person, (of_past, of_present) in enumerate(PERSONS, 1):
            made += [
                (F.concat(own, F.lit(of_past)), "past", person, negative),
                (F.concat(F.lit(f"{no}می{ZWNJ}"), past, F.lit(of_past)), "past-progressive", person, negative),
                (F.when(has, F.concat(F.lit(f"{no}می{ZWNJ}"), stem, F.lit(of_present))), "present", person, negative),
                (F.when(has, F.concat(prefixed("ن" if negative else "ب", stem), F.lit(of_present))), "subjunctive", person, negative),
            ]
        made += [(F.concat(own, F.lit("ن")), "infinitive", 0, negative), (F.concat(own, F.lit("ه")), "participle", 0, negative)]
    forms = F.array(*(F.struct(f.alias("form"), F.lit(t).alias("tense"), F.lit(p).alias("person"), F.lit(n).alias("negative")) for f, t, p, n in made))
    return F.filter(forms, lambda x: x["form"].isNotNull())


def conjugated(verbs: DataFrame) -> DataFrame:
    """past, present, form, tense, person, negative of verbs(past, present): what analysing and generating look up."""
    return verbs.select("past", "present", F.inline(verb_forms(F.col("past"), F.col("present"))))


def analyzed(words: DataFrame, verbs: DataFrame, word: str = "word") -> DataFrame:
    """words with each reading as a verb form; words without one have no row."""
    return words.join(conjugated(verbs).withColumnRenamed("form", word), word)


def generated(asked: DataFrame, verbs: DataFrame) -> DataFrame:
    """asked(past, present, tense, person, negative) with the form that says so."""
    return asked.join(conjugated(verbs), ["past", "present", "tense", "person", "negative"])


#: (pattern of a token, replacement, subtype): forms of one token that count only where a vocabulary has them.
HAMZA = tuple((a, b, f"{a}>{b}") for a, b in (("ئ", "ی"), ("ئ", "ا"), ("ئ", "أ"), ("أ", "ا"), ("أ", "ئ"), ("ؤ", "و"), ("إ", "ا")))
_NO_PLURAL = f"^(?!.*ها(?:ی|یی)?$)([^{ZWNJ}]{{3,}})$"
ATTESTED = {
    "hamza": HAMZA,
    "plural-add": tuple((_NO_PLURAL, f"$1{gap}{end}", f"{end}/{name}") for end in ("ها", "های") for gap, name in ((ZWNJ, "zwnj"), ("", "joined"))),
    "plural-drop": (("^(.{2,}?)‌(?:ها|های|هایی)$", "$1", "zwnj"), (f"^([^{ZWNJ}]{{2,}}?)(?:ها|های|هایی)$", "$1", "joined")),
    "zwnj-add": ((f"^([^{ZWNJ}]{{2,}})(ها|های|هایی)$", f"$1{ZWNJ}$2", "plural"), (f"^(ن?می)([^{ZWNJ}]{{2,}})$", f"$1{ZWNJ}$2", "verb")),
    "clitic-add": tuple(x for c in ("م", "ت", "ش", "مان", "تان", "شان") for x in ((f"^([^{ZWNJ}]{{3,}})$", f"$1{c}", c), (f"^([^{ZWNJ}]{{2,}}[هی])$", f"$1{ZWNJ}ا{c}", c))),
}


def attested(rows: DataFrame, key: str, text: str, vocabulary: DataFrame, kind: str, least: int) -> DataFrame:
    """key, text, subtype: a variant with one token changed into a form that the vocabulary (token, n) has so often.

    Of several the one drawn by a seeded hash of the key and the form. Texts without one have no row.
    """
    cut = rows.select(key, F.split(text, " ").alias("w")).select(key, "w", F.posexplode("w").alias("i", "token"))
    forms = F.array(*(F.struct(F.regexp_replace("token", pattern, to).alias("form"), F.lit(name).alias("subtype")) for pattern, to, name in ATTESTED[kind]))
    tried = cut.select(key, "w", "i", "token", F.inline(F.array_distinct(forms))).where("form <> token")
    common = vocabulary.where(F.col("n") >= least).select(F.col("token").alias("form"))
    found = tried.join(common, "form", "left_semi")
    turn = F.struct(fnv1a(F.concat_ws("/", F.lit(kind), F.col(key).cast("string"), F.col("form"))), "i", "form", "subtype")
    best = found.groupBy(key).agg(F.min_by(F.struct("w", "i", "form", "subtype"), turn).alias("x"))
    changed = F.transform(F.col("x.w"), lambda w, j: F.when(j == F.col("x.i"), F.col("x.form")).otherwise(w))
    return best.select(key, F.array_join(changed, " ").alias("text"), F.col("x.subtype").alias("subtype"))


#: Every rewriter that needs nothing but the text.
REWRITERS = {
    "std-typing": standard, "arabic-yk": arabic_letters, "alef-madda": without_madda, "hamza": hamza, "heh-yeh": heh_yeh, "diacritics": without_marks,
    "digits": digits,
    "zwnj-space": half_space_as_space, "zwnj-join": half_space_dropped, "zwnj-add": half_space_added, "plural-add": plural_added, "plural-drop": plural_dropped,
    "clitic-add": clitic_added, "verb-negation": verb_negated, "layout-latin-on-fa": latin_on_persian,
    "layout-win-legacy": lambda t: on_layout(t, "isiri9147", "win-legacy"), "layout-mac-legacy": lambda t: on_layout(t, "isiri9147", "mac-legacy"),
}


def rewritten(text: Column) -> Column:
    """All variants of a text: an array of (type, text), without those that change nothing."""
    every = F.array(*(F.struct(F.lit(k).alias("type"), f(text).alias("text")) for k, f in REWRITERS.items()))
    return F.filter(every, lambda v: v["text"].isNotNull())
