"""Predicates and small rules on tokens and words, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A

# Letters of Arabic script without digits and marks, and the letters of a Persian word.
SCRIPT = "[ؠ-يٮ-ۓەۮۯۺ-ۼۿ]"
PERSIAN_ONLY = "^[ء-غف-يپچژکگیآ‌]+$"
# Endings of inflected words, with the names of their kinds; the first that fits counts.
ENDINGS = (
    ("^$", "same form"), ("^(ی|ای|یی)$", "ezafe/indefinite ی"), ("^ها", "ها plural"), ("^ات$", "ات plural"), ("^گان$", "گان plural"), ("^ی?ان$", "ان/یان plural"),
    ("^ین$", "ین plural"), ("^تر(ین)?$", "comparative"), ("^(م|ت|ش|مان|تان|شان|یم|یت|یش|یمان|یتان|یشان|ام|ات|اش)$", "clitic"),
)


def raw_tokens(text: Column) -> Column:
    """Runs of letters, marks, digits and half-spaces as they are, without half-spaces at their edges."""
    cut = F.regexp_extract_all(text, F.lit(A.WORD), F.lit(0))
    return F.filter(F.transform(cut, lambda w: F.regexp_replace(w, f"^{A.ZWNJ}+|{A.ZWNJ}+$", "")), lambda w: w != "")


def is_arabic_script(token: Column) -> Column:
    return token.rlike(SCRIPT)


def is_latin(token: Column) -> Column:
    return token.rlike("^[A-Za-z][A-Za-z0-9\\-]*$")


def has_digit(token: Column) -> Column:
    return token.rlike("[0-9۰-۹٠-٩]")


def is_persian_only(word: Column) -> Column:
    return word.rlike(PERSIAN_ONLY)


def latin_keys(run: Column) -> Column:
    """A run of the keys of a Latin keyboard, one letter at least."""
    return run.rlike("^[!-~]*[A-Za-z][!-~]*$")


def punctuated(run: Column) -> Column:
    return run.rlike("[^A-Za-z0-9]")


def is_word(form: Column, upos: Column) -> Column:
    """A treebank word that a stemmer should see."""
    return form.rlike("\\p{L}") & ~upos.isin("PUNCT", "NUM", "SYM")


def long_text(text: Column, least: int = 2_000) -> Column:
    """Texts long enough for a collection."""
    return F.length(text) >= least


def ending(word: Column, lemma: Column) -> Column:
    """The kind of ending that parts a form from its lemma (F14); a lemma's final ه may have gone."""
    rest = F.substr(word, F.length(lemma) + 1)
    kind = F.coalesce(*(F.when(rest.rlike(pattern), name) for pattern, name in ENDINGS), F.lit("other ending"))
    short = F.substr(word, F.length(lemma))
    bare = F.regexp_replace(lemma, "ه$", "")
    kind_short = F.coalesce(*(F.when(short.rlike(pattern), name) for pattern, name in ENDINGS), F.lit("other ending"))
    return F.when(F.startswith(word, lemma), kind).when(lemma.endswith("ه") & F.startswith(word, bare), kind_short).otherwise("other")


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans (array of structs with start and end) overlaps [start, end)."""
    return F.exists(spans, lambda s: (s["start"] < end) & (s["end"] > start))


def zipped(**arrays: Column) -> Column:
    """One struct for each position of parallel arrays."""
    return F.arrays_zip(*(c.alias(name) for name, c in arrays.items()))


def sensitive(text: Column, words: list[str], stems: list[str]) -> Column:
    """Whether a token, whole or in parts, with or without the article ال, is one of the words or begins with a stem."""
    cut = F.regexp_extract_all(text, F.lit("[\\p{L}\\p{M}‌]+"), F.lit(0))
    folded = F.transform(cut, lambda w: F.regexp_replace(F.translate(w, "يىك", "ییک"), "[ً-ٰٟـ]", ""))
    forms = F.flatten(F.transform(folded, lambda w: F.concat(F.array(F.replace(w, F.lit(A.ZWNJ), F.lit(""))), F.split(w, A.ZWNJ))))
    both = F.concat(forms, F.transform(forms, lambda w: F.regexp_replace(w, "^ال", "")))
    begins = "^(" + "|".join(s.replace(A.ZWNJ, "") for s in stems) + ")" if stems else "(?!)"
    return F.exists(both, lambda w: w.isin(*words) | w.rlike(begins))
