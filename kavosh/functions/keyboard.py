"""Text typed on the wrong keyboard layout: both directions, and what a run may have been meant as."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alphabet import PERSIAN_LETTER

# The US keys, and what each types on three Persian layouts (\0: nothing that a search keeps).
KEYS = "`qwertyuiop[]\\asdfghjkl;'zxcvbnm,/ASDFGHJZXCVBNM"
LAYOUTS = {
    "isiri9147": "\0ضصثقفغعهخحجچ\\شسیبلاتنمکگظطزرذدپو/ؤئيإأآةكطژ\0\u200c\0ء",
    "win-legacy": "÷ضصثقفغعهخحجچپشسیبلاتنمکگظطزرذدئو/\0\0\0\0ۀآ\0ةيژؤإأء",
    "mac-legacy": "پضصثقفغعهخحجچ\\شسیبلاتنمکگظطذدزرو،ژ«»ي\0\0آ\0'\0ئءأأؤ",
}


def persian_table(layout: str) -> tuple[str, str]:
    """FROM and TO of a translate(); keys that type nothing come last in FROM."""
    pairs = list(zip(KEYS, LAYOUTS[layout], strict=True))
    kept = [(k, v) for k, v in pairs if v != "\0"]
    return "".join(k for k, _ in kept) + "".join(k for k, v in pairs if v == "\0"), "".join(v for _, v in kept)


def latin_table(layout: str) -> tuple[str, str]:
    """FROM and TO back to the keys; of two keys with one letter the unshifted comes first. Persian digits are digits."""
    back: dict[str, str] = {}
    for key, letter in zip(KEYS, LAYOUTS[layout], strict=True):
        if letter != "\0":
            back.setdefault(letter, key)
    for d in range(10):
        back.setdefault(chr(0x6F0 + d), str(d))
    return "".join(back), "".join(back.values())


def to_persian(text: Column, layout: str = "isiri9147") -> Column:
    return F.translate(text, *persian_table(layout))


def to_latin(text: Column, layout: str = "isiri9147") -> Column:
    return F.translate(text, *latin_table(layout))


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def layout_candidates(run: Column, layout: str) -> Column:
    """What a run without spaces may have been meant as on one layout: an array of at most two."""
    latin = to_latin(run, layout)
    name = F.when(latin.rlike("^[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*$"), F.array(F.lower(latin))).otherwise(F.array().cast("array<string>"))
    small = F.concat(F.lower(F.substring(run, 1, 1)), F.substring(run, 2, 1 << 30))
    typed = F.when(run.rlike("^[A-Z][^A-Z]*$"), F.array(run, small)).otherwise(F.array(run))

    def fits(c: Column) -> Column:
        letters = _count(c, PERSIAN_LETTER)
        return (F.length(c) == F.length(run)) & ~c.rlike("[A-Za-z]") & (letters >= _count(run, "[A-Za-z]")) & ((letters >= 3) | ~run.rlike("[0-9]"))

    persian = F.filter(F.transform(typed, lambda t: to_persian(t, layout)), fits)
    return F.when(run.rlike("[\u0600-\u06ff]"), name).otherwise(persian)


def keyboard_candidates(run: Column) -> Column:
    """Candidates of all layouts in their order, each once, without the run itself."""
    every = F.concat(*(layout_candidates(run, name) for name in LAYOUTS))
    return F.array_remove(F.array_distinct(every), run)
