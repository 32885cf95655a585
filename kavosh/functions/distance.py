"""The speller's weighted distance, word keys and pieces."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .alphabet import PERSIAN_LETTER, ZWNJ

# Letters that sound alike, the keyboard's letter rows, costs, and first letters that share a piece.
SOUND = ("زذضظ", "ثسص", "تط", "حه", "غق")
ROWS = "ضصثقفغعهخحجچ شسیبلاتنمکگ ظطزرذدپو"
SOUND_COST, KEY_COST, DOUBLE_COST, VOWEL_COST, SWAP_COST = 0.3, 0.6, 0.5, 0.8, 0.8
CLASSES = ("اع", "تط", "ثسص", "حه", "ذزضظ", "غق")
LONGEST = 15


def _pairs() -> dict[tuple[str, str], float]:
    """Cost of each cheap substitution, from the groups and rows."""
    out = {}
    for row in ROWS.split():
        for a, b in zip(row, row[1:], strict=False):
            out[a, b] = out[b, a] = KEY_COST
    for group in SOUND:
        out |= {(a, b): SOUND_COST for a in group for b in group if a != b}
    return out


_CHEAP = _pairs()


def distance(a: str, b: str, cap: float) -> float:
    """Optimal string alignment with costs for Persian; infinity beyond cap."""

    def gaps(s: str) -> list[float]:
        near = [(i and s[i - 1] == c) or s[i + 1 : i + 2] == c for i, c in enumerate(s)]
        return [DOUBLE_COST if n else VOWEL_COST if c in "اوی" else 1.0 for c, n in zip(s, near, strict=True)]

    drop, add = gaps(a), gaps(b)
    table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for j, g in enumerate(add, 1):
        table[0][j] = table[0][j - 1] + g
    for i, x in enumerate(a, 1):
        row, above = table[i], table[i - 1]
        row[0] = above[0] + drop[i - 1]
        for j, y in enumerate(b, 1):
            if x == y:
                change = 0.0
            elif i == j == 1 and {x, y} == set("اع"):
                change = SOUND_COST
            else:
                change = _CHEAP.get((x, y), 1.0)
            best = min(above[j] + drop[i - 1], row[j - 1] + add[j - 1], above[j - 1] + change)
            if i > 1 and j > 1 and x != y and a[i - 2] == y and b[j - 2] == x:
                best = min(best, table[i - 2][j - 2] + SWAP_COST)
            row[j] = best
        if min(row) > cap:
            return float("inf")
    return table[-1][-1] if table[-1][-1] <= cap else float("inf")


@pandas_udf(T.DoubleType())
def weighted_distance(a: pd.Series, b: pd.Series, cap: pd.Series) -> pd.Series:
    """Costs to a tenth, so that sums in another order compare equal."""
    return pd.Series([round(d * 10) / 10 if (d := distance(x, y, c)) != float("inf") else None for x, y, c in zip(a, b, cap, strict=True)], dtype="float64")


def reach(length: Column) -> Column:
    """How far a word of this length may be from its fix."""
    return F.when(length < 3, 0.0).when(length < 4, SOUND_COST).otherwise(1.0)


def word_key(word: Column) -> Column:
    return F.translate(word, "آ" + ZWNJ, "ا")


def is_persian(key: Column) -> Column:
    return key.rlike(f"^{PERSIAN_LETTER}+$")


def piece_key(first: Column, length: Column) -> Column:
    """First letter's class and the length: words that a search for a fix has to look at together."""
    cls = F.coalesce(*(F.when(first.isin(*g), F.lit(str(i))) for i, g in enumerate(CLASSES)), F.ascii(first).cast("string"))
    return F.concat_ws(".", cls, F.least(length, F.lit(LONGEST)).cast("string"))


def pieces_for(key: Column, edits: int = 1) -> Column:
    n = F.length(key)
    lengths = F.sequence(F.greatest(F.lit(3), n - edits), F.greatest(F.lit(3), n + edits))
    return F.array_distinct(F.transform(lengths, lambda k: piece_key(F.substring(key, 1, 1), k)))
