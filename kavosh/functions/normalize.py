"""Normalisation of mixed Arabic and Persian spellings as Column expressions, and with offsets as an Arrow kernel."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import alphabet as A

_SOFT = "\u200c\u200b"
_RUN = re.compile(f"({A.ARABIC})\\1{{2,}}")
_ONE_TO_ONE = {hamza: str.maketrans(A.FOLDS | (A.HAMZA_YEH if hamza else {}) | A.DIGITS | A.LOWER) for hamza in (False, True)}
_SHIFTS = re.compile("[" + "".join(map(chr, A.REMOVED)) + "".join(A.PRESENTATION) + "İ\u200c\u200b\u00ac]")


def presentation_forms(text: Column) -> Column:
    """Presentation forms in their plain letters; rows without any are left alone."""
    forms = F.create_map(*(F.lit(x) for pair in A.PRESENTATION.items() for x in pair))
    plain = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(forms, c), c)), "")
    return F.when(text.rlike("[\ufb50-\ufdff\ufe70-\ufefe]"), plain).otherwise(text)


def fold(text: Column, hamza_yeh: bool = True) -> Column:
    """Letters, digits and case folded, marks dropped: one translate."""
    source, target = A.tables(hamza_yeh)
    return F.translate(F.replace(text, F.lit("İ"), F.lit("i̇")), source, target)


def half_spaces(text: Column) -> Column:
    """Runs of half-spaces (and what is typed for them) between letters become one; others go, a lone not-sign stays."""
    one = F.regexp_replace(text, "(?<=\\p{L})[\u200c\u200b\u00ac]+(?=\\p{L})", A.ZWNJ)
    return F.regexp_replace(F.regexp_replace(one, f"(?<!\\p{{L}})[{_SOFT}]+", ""), f"[{_SOFT}]+(?!\\p{{L}})", "")


def stretches(text: Column) -> Column:
    """Three or more of one Arabic letter become one."""
    return F.regexp_replace(text, f"({A.ARABIC})\\1{{2,}}", "$1")


def normalize(text: Column, hamza_yeh: bool = True) -> Column:
    """The whole normalisation, inside code generation. Null stays null."""
    return stretches(half_spaces(fold(presentation_forms(text), hamza_yeh)))


def standard_typing(text: Column) -> Column:
    """Letters folded and marks dropped as a careful typist would; digits and case stay."""
    source = "".join(A.FOLDS)
    return F.translate(text, source + "".join(map(chr, [*range(0x064B, 0x0653), 0x0640])), "".join(A.FOLDS.values()))


def site_key(word: Column) -> Column:
    """A key of words as a site spells them: lower case, letters and digits folded, no half-spaces, no marks."""
    digits = "".join(A.DIGITS)
    return F.translate(F.lower(word), "يىكآ" + digits + A.ZWNJ + "".join(map(chr, range(0x064B, 0x0653))), "ییکا" + "".join(A.DIGITS.values()))


def gold_key(word: Column) -> Column:
    """A treebank's spelling without its noise: standard typing, hamza forms folded, no half-space at the edges."""
    return F.regexp_replace(F.translate(standard_typing(word), "ۀأإؤئ", "هااوی"), f"^{A.ZWNJ}+|{A.ZWNJ}+$", "")


#: Each fold alone, for finding which words it would bring together.
SINGLE_FOLDS = {
    "yeh": lambda t: F.translate(t, "يى", "یی"), "kaf": lambda t: F.translate(t, "كڪ", "کک"), "teh-marbuta": lambda t: F.translate(t, "ة", "ه"), "heh": lambda t: F.translate(t, "ۀہۂ", "ههه"),
    "alef-hamza": lambda t: F.translate(t, "أإٱ", "ااا"), "waw-hamza": lambda t: F.translate(t, "ؤ", "و"), "yeh-hamza": lambda t: F.translate(t, "ئ", "ی"), "alef-madda": lambda t: F.translate(t, "آ", "ا"),
    "marks": lambda t: F.regexp_replace(t, "[ً-ٰٟ]", ""), "tatweel": lambda t: F.translate(t, "ـ", ""), "digits": lambda t: F.translate(t, "".join(A.DIGITS), "".join(A.DIGITS.values())),
    "case": lambda t: F.lower(t), "half-space": lambda t: F.translate(t, A.ZWNJ, ""),
}


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_marks(text: pd.Series) -> pd.Series:
    """Lower case without combining marks or half-spaces (canonical decomposition isn't a built-in function)."""
    out = text.str.lower().map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M") and c != A.ZWNJ))
    return out


def in_place(text: str, hamza_yeh: bool = True) -> str | None:
    """The normalised text, where each of its characters stays at its place; None where one moves."""
    if text.isascii():
        return text.lower()
    out = None if _SHIFTS.search(text) else text.translate(_ONE_TO_ONE[hamza_yeh])
    return None if out is None or _RUN.search(out) else out


def with_offsets(text: str, hamza_yeh: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The normalised text, and for each of its characters the span of code points that it came from.

    Characters of one expansion share a span; a mark that is dropped widens the span before it.
    """
    pairs = A.FOLDS | (A.HAMZA_YEH if hamza_yeh else {}) | A.DIGITS | A.LOWER | {"İ": "i̇"}
    gone = set(map(chr, A.REMOVED))
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        made = "".join("" if x in gone else pairs.get(x, x) for x in A.PRESENTATION.get(c, c))
        if not made and spans:
            spans[-1] = (spans[-1][0], i + 1)
        for x in made:
            chars.append(x)
            spans.append((i, i + 1))
    out: list[str] = []
    kept: list[tuple[int, int]] = []
    i, n = 0, len(chars)
    while i < n:
        if chars[i] in "\u200c\u200b\u00ac":
            j = i
            while j < n and chars[j] in "\u200c\u200b\u00ac":
                j += 1
            if out and out[-1].isalpha() and j < n and chars[j].isalpha():
                out.append(A.ZWNJ)
                kept.append((spans[i][0], spans[j - 1][1]))
            else:
                for k in range(i, j):
                    if chars[k] == "\u00ac":
                        out.append(chars[k])
                        kept.append(spans[k])
            i = j
        else:
            out.append(chars[i])
            kept.append(spans[i])
            i += 1
    joined = "".join(out)
    final: list[str] = []
    final_spans: list[tuple[int, int]] = []
    at = 0
    for m in _RUN.finditer(joined):
        final.append(joined[at : m.start() + 1])
        final_spans += kept[at:m.start()] + [(kept[m.start()][0], kept[m.end() - 1][1])]
        at = m.end()
    return "".join(final) + joined[at:], final_spans + kept[at:]
