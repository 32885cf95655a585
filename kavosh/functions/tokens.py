"""Words, the rejoining of affixes typed apart, and tokens with offsets into the original text."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import alphabet as A
from .normalize import in_place, normalize, with_offsets

# Prefixes and suffixes that belong to their neighbour.
PREFIXES = ("می", "نمی")
SUFFIXES = ("ها", "های", "هایی", "هایم", "هایت", "هایش", "هایمان", "هایتان", "هایشان", "تر", "ترین")
VOWEL_SUFFIXES = ("ی", "ای", "ام", "اش", "اید", "ایم", "اند")
VOWELS = "هاوی"
_GAP = "[^\\S\\n\\r\\x{2028}\\x{2029}]+"
_WORD = regex.compile(r"[\p{L}\p{N}\p{M}\u200C]+")
_SPACES = regex.compile(r"[^\S\n\r\u2028\u2029]+")
_ARABIC = regex.compile(A.ARABIC)


def words(text: Column) -> Column:
    """Maximal runs of letters, digits, marks and half-spaces."""
    return F.regexp_extract_all(text, F.lit(A.WORD), F.lit(0))


# Two characters that stand for gaps: one that may have been a half-space, and any other.
_NEAR, _FAR = "\x01", "\x02"
_IN = f"[^{_NEAR}{_FAR}]"
_END = f"(?=[{_NEAR}{_FAR}]|$)"
#: What rejoins a text whose gaps are marked: (pattern, replacement), each in one pass from left to right.
_REJOIN = (
    # After a word of another script, a gap is none.
    (f"(?<!{_IN})((?:(?!{A.ARABIC}){_IN})+){_NEAR}", f"$1{_FAR}"),
    # A prefix takes the next word of two letters or more; that word is then no prefix of its own.
    (f"(?<!{_IN})({'|'.join(PREFIXES)}){_NEAR}(?={_IN}*{A.ARABIC})({_IN}{{2,}})", f"$1{A.ZWNJ}$2"),
    (f"{_NEAR}({'|'.join(SUFFIXES)}|(?<=[{VOWELS}]{_NEAR})(?:{'|'.join(VOWEL_SUFFIXES)})){_END}", f"{A.ZWNJ}$1"),
)


def rejoined(text: Column) -> Column:
    """words(), with spaced prefixes and suffixes joined to their host by a half-space; linear in the text's length."""
    inner = "\\p{L}\\p{N}\\p{M}\\x{200C}"
    marked = F.translate(text, _NEAR, _FAR)
    marked = F.regexp_replace(marked, f"(?U)(?<=[{inner}]){_GAP}(?=[{inner}])", _NEAR)
    marked = F.regexp_replace(marked, f"[^{inner}{_NEAR}]+", _FAR)
    for pattern, to in _REJOIN:
        marked = F.regexp_replace(marked, pattern, to)
    joined = F.filter(F.split(marked, f"[{_NEAR}{_FAR}]"), lambda w: w != "")
    # Text without a candidate takes the path that needs one pattern only.
    some = text.rlike(f"(^|[^{inner}])(" + "|".join((*PREFIXES, *SUFFIXES, *VOWEL_SUFFIXES)) + f")([^{inner}]|$)")
    return F.when(some, joined).otherwise(words(text))


def tokens(text: Column, hamza_yeh: bool = True, rejoin: bool = True) -> Column:
    """Tokens of the normalised text."""
    n = normalize(text, hamza_yeh)
    return rejoined(n) if rejoin else words(n)


def tokens_of(text: str, hamza_yeh: bool = True, rejoin: bool = True) -> list[tuple[str, int, int]]:
    """(token, start, end) with code-point offsets into the original text."""
    n = in_place(text, hamza_yeh)
    if n is not None and not (rejoin and _ARABIC.search(n)):
        return [(m[0], *m.span()) for m in _WORD.finditer(n)]
    n, spans = with_offsets(text, hamza_yeh)
    found = [m.span() for m in _WORD.finditer(n)]
    # Which words go to the one before them. A prefix that itself went to one takes nothing.
    goes = [False] * len(found)
    for i, ((a, b), (c, d)) in enumerate(zip(found, found[1:], strict=False), 1) if rejoin else ():
        host, word = n[a:b], n[c:d]
        if _SPACES.fullmatch(n, b, c) and _ARABIC.search(host) and _ARABIC.search(word):
            goes[i] = word in SUFFIXES or (word in VOWEL_SUFFIXES and host[-1] in VOWELS) or (host in PREFIXES and d - c >= 2 and not goes[i - 1])
    groups = np.cumsum(~np.array(goes, bool)).tolist()
    out = []
    for _, run in itertools.groupby(zip(groups, found, strict=True), key=lambda x: x[0]):
        members = [span for _, span in run]
        out.append((A.ZWNJ.join(n[a:b] for a, b in members), spans[members[0][0]][0], spans[members[-1][1] - 1][1]))
    return out


@pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def tokens_with_offsets(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"text": w, "start": a, "end": b} for w, a, b in tokens_of(t)])
