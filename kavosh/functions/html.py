"""Indexable text of HTML pages: regions with weights, titles, escapes, and excerpts."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .tokens import tokens_of

# Elements left out of an index, that stand alone, and that don't break a word; weights of headings; marks.
SKIPPED = frozenset("head style script noscript label form svg footer nav iframe template title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data em i kbd mark q s small span strong sub sup time u var".split())
HEADINGS = {"h1": 7.0, "h2": 6.0, "h3": 5.0, "h4": 4.0, "h5": 3.0, "h6": 2.0}
BODY, IGNORE, WEIGHT, META = "data-pagefind-body", "data-pagefind-ignore", "data-pagefind-weight", "data-pagefind-meta"
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "zwnj": "\u200c", "zwj": "\u200d", "lrm": "", "rlm": "", "shy": ""}
_BODY = re.compile(rf"\s{BODY}[\s=>]", re.I)


class _Page(HTMLParser):
    """Turns a page into pieces: (region, weight, text), where text None ends a word.

    Regions are the elements marked as body, or <body> where a page marks none; they don't nest.
    """

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.marked = bool(_BODY.search(page))
        self.open: list[tuple[str, bool, float, bool]] = []  # tag, skipped, weight, whether it is a region
        self.pieces: list[tuple[int, float, str | None]] = []
        self.ends: list[int] = []
        self.inside, self.own_title = False, False
        self.heading: list[str] | None = None
        self.heading_at, self.title = -1, None
        self.lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self.size = len(page)
        self.feed(page)
        self.close()
        self.ends += [self.size] * (self.inside and len(self.ends) < self._regions)

    _regions = 0

    def _state(self) -> tuple[bool, float]:
        return self.open[-1][1:3] if self.open else (False, 1.0)

    def _put(self, text: str | None) -> None:
        skipped, weight = self._state()
        if self.inside and not skipped:
            self.pieces.append((self._regions - 1, weight, text))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        marks = dict(attrs)
        self.own_title |= "title" in re.split(r"\W+", marks.get(META) or "")
        ignored = IGNORE in marks
        if tag not in INLINE or ignored or tag in SKIPPED:
            self._put(None)
        if tag in VOID:
            return
        skipped, weight = self._state()
        try:
            weight = float(marks[WEIGHT])
        except (KeyError, TypeError, ValueError):
            weight = HEADINGS.get(tag, weight)
        begins = not self.inside and (BODY in marks if self.marked else tag == "body")
        if begins:
            self.inside, self._regions = True, self._regions + 1
        skipped = skipped or ignored or tag in SKIPPED
        if tag == "h1" and self.heading is None and not skipped:
            self.heading, self.heading_at = [], len(self.open)
        self.open.append((tag, skipped, weight, begins))
        if tag == "title" and self.title is None:
            self.title = ""

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE or tag in SKIPPED or IGNORE in dict(attrs):
            self._put(None)

    def handle_endtag(self, tag: str) -> None:
        depth = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if depth is None:
            return
        closed, self.open = self.open[depth:], self.open[:depth]
        if any(x[3] for x in closed):
            line, column = self.getpos()
            self.ends.append(self.lines[line - 1] + column)
            self.inside = False
        if depth <= self.heading_at:
            self.heading_at = -1
        if tag not in INLINE or closed[0][1]:
            self._put(None)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "title":
            self.title = (self.title or "") + data
        if self.heading_at >= 0 and not self._state()[0]:
            self.heading.append(data)
        self._put(data)


def _squashed(text: str) -> str:
    return " ".join(text.split())


def regions_of(page: str) -> dict:
    """title, has_body (whether the page marks one), own_title, and the regions' text by weight.

    regions: region, weight, text, end (where in the page the region ends); a region's weights come as they first occur.
    A fragment without <body> is one region of weight 1. The title is the first <h1> that isn't skipped, else <title>.
    """
    p = _Page(page)
    texts: dict[tuple[int, float], list[str]] = {}
    for region, weight, text in p.pieces:
        texts.setdefault((region, weight), []).append(" " if text is None else text)
    found = [{"region": r, "weight": w, "text": t, "end": p.ends[r]} for (r, w), parts in texts.items() if (t := _squashed("".join(parts)))]
    if not p.ends and not p.marked and (plain := _squashed(unescape_text(re.sub("<!--.*?-->|<[^>]*>", " ", page, flags=re.S)))):
        found = [{"region": 0, "weight": 1.0, "text": plain, "end": len(page)}]
    heading = p.title or "" if p.heading is None else "".join(p.heading)
    return {"title": _squashed(heading), "has_body": p.marked, "own_title": p.own_title, "regions": found}


REGIONS = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("has_body", T.BooleanType()), T.StructField("own_title", T.BooleanType()),
    T.StructField("regions", T.ArrayType(T.StructType([
        T.StructField("region", T.IntegerType()), T.StructField("weight", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("end", T.IntegerType()),
    ]))),
])


#: Pages whose regions a worker holds at once.
PAGES = 250


@pandas_udf(REGIONS)
def regions(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """regions_of each page; a batch goes on in slices, so its regions are never all in memory."""
    for pages in batches:
        for at in range(0, len(pages), PAGES):
            yield pd.DataFrame([regions_of(p or "") for p in pages.iloc[at : at + PAGES]], columns=["title", "has_body", "own_title", "regions"])


def unescape_text(text: str) -> str:
    """Named entities of the list and numeric ones; others stay as they are."""

    def one(m: re.Match) -> str:
        name = m[1].lower()
        if not name.startswith("#"):
            return {**ENTITIES, "amp": "&"}.get(name, m[0])
        number = int(name[2:], 16) if name[1] == "x" else int(name[1:])
        return chr(number) if 0 < number < 0x110000 and not 0xD800 <= number < 0xE000 else m[0]

    return re.sub(r"&(#x[0-9a-fA-F]+|#[0-9]+|[A-Za-z]+);", one, text)


@pandas_udf(T.StringType())
def unescaped_all(text: pd.Series) -> pd.Series:
    """unescape_text as a Column, where numeric entities matter; unescaped() is its native part."""
    return text.map(lambda t: None if t is None else unescape_text(t))


def escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    """The named entities of the list; the ampersand comes last."""
    for entity, plain in (*ENTITIES.items(), ("#39", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{entity};"), F.lit(plain))
    return text


def tag_free(page: Column) -> Column:
    """Text without tags, scripts and styles, spaces squashed: the native way where weights don't matter."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"[ \t\n\r]+", " "))


def spliced(page: str, blocks: list[tuple[int, str]]) -> str:
    """The page with each text put in at its place; an earlier run's blocks were taken out before."""
    out, at = [], 0
    for place, text in sorted(blocks, key=lambda b: b[0]):
        out += [page[at:place], text]
        at = place
    return "".join([*out, page[at:]])


@pandas_udf(T.StringType())
def _annotated(page: pd.Series, ends: pd.Series, blocks: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else spliced(p, [] if e is None else list(zip(e.tolist(), b, strict=True))) for p, e, b in zip(page, ends, blocks, strict=True)], dtype=object)


_BLOCK = r"(?s)<(div|span) hidden data-terms[^>]*>[^<]*</\1>"


def annotated_pages(pages, page_id: str, page: str, terms):
    """page_id, html: pages with a hidden block of index terms, by weight, at the end of each region, and of the title's.

    terms: text Column -> array of terms. Blocks of an earlier run are replaced, so twice is once. Pages without text stay.
    """
    clean = pages.select(page_id, F.regexp_replace(page, _BLOCK, "").alias("html")).withColumn("r", regions("html"))
    rows = clean.select(page_id, F.posexplode("r.regions").alias("pos", "x"))
    weight = F.when(F.col("x.weight") == 1, F.lit("")).otherwise(F.concat(F.lit(f' {WEIGHT}="'), F.regexp_replace(F.col("x.weight").cast("string"), r"\.0$", ""), F.lit('"')))
    block = F.concat(F.lit("<div hidden data-terms"), weight, F.lit(">"), escaped(F.array_join(terms(F.col("x.text")), " ")), F.lit("</div>"))
    blocks = rows.select(page_id, "pos", F.col("x.end").alias("end"), block.alias("block"))
    lists = blocks.groupBy(page_id).agg(F.array_sort(F.collect_list(F.struct("pos", "end", "block"))).alias("b"))
    title = F.concat(F.lit(f'<span hidden data-terms {META}="title[data-terms-title], original[data-terms-original]" data-terms-title="'), escaped(F.array_join(terms(F.col("r.title")), " ")), F.lit('" data-terms-original="'), escaped(F.col("r.title")), F.lit('"></span>'))
    both = clean.join(lists, page_id, "left")
    own = F.when((F.col("r.title") != "") & ~F.col("r.own_title") & F.col("b").isNotNull(), F.array(F.struct(F.lit(1 << 30).alias("pos"), F.col("b")[0]["end"].alias("end"), title.alias("block")))).otherwise(F.array().cast("array<struct<pos:int,end:int,block:string>>"))
    every = F.concat(F.coalesce("b", F.array().cast("array<struct<pos:int,end:int,block:string>>")), own)
    return both.select(page_id, _annotated(F.col("html"), every["end"], every["block"]).alias("html"))


def window_of(hits: list[bool], size: int) -> int:
    """Where the window of `size` words starts that has most hits (the earliest of equals), centred on its hits."""
    total = [0]
    for h in hits:
        total.append(total[-1] + bool(h))
    inside = [total[i + 1] - total[max(0, i + 1 - size)] for i in range(len(hits))]
    best = max(0, inside.index(max(inside)) + 1 - size) if inside else 0
    marked = [i for i in range(best, min(len(hits), best + size)) if hits[i]]
    if marked:
        best = max(0, min(len(hits) - size, math.floor((marked[0] + marked[-1] - size + 1) / 2 + 0.5)))
    return best


def excerpt_of(text: str, spans: list[tuple[int, int]], hits: list[bool], size: int = 30) -> str:
    """The best window of the text's words with all that stands between them, escaped, its hits in marks.

    Without words it is the text's first 200 characters.
    """
    if not spans:
        return escape(text[:200], quote=False)
    begin = window_of(hits, size)
    out, at = [], spans[begin][0]
    for (a, b), hit in zip(spans[begin : begin + size], hits[begin : begin + size], strict=True):
        word = escape(text[a:b], quote=False)
        out += [escape(text[at:a], quote=False), f"<mark>{word}</mark>" if hit else word]
        at = b
    return "".join(out)


def excerpts(hit: str, size: int = 30):
    """excerpt_of a text Column, whose hits are the words that the pattern matches in full.

    A text's words stay inside the kernel, one text at a time: as a column they take many times the text's memory.
    """

    @pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        is_hit = re.compile(hit).fullmatch

        def one(t: str | None) -> str | None:
            if t is None:
                return None
            words = tokens_of(t)
            return excerpt_of(t, [w[1:] for w in words], [is_hit(w[0]) is not None for w in words], size)

        return pd.Series([one(t) for t in text], dtype=object)

    return run
