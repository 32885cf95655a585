"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns run at their places only, checksums decide.

Base kinds, each leftmost and non-overlapping on its own: assign, access, hex. Added kinds carry a checksum of their
own, and only spans whose checksum holds are reported: github and npm (prefix, 30 characters, base-62 CRC-32 of six).
A null text is taken as empty and has no spans. Every row is scanned on its own and over its whole text; offsets are
code points, ends exclusive. `scan` keeps all columns and replaces one named `spans`.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import steps

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm")
ASSIGN = re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
GITHUB = re.compile("gh[oprsu]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile("npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# The keywords of each kind, in lower case.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "gho_": "github", "ghp_": "github", "ghr_": "github", "ghs_": "github", "ghu_": "github", "npm_": "npm"}
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def checksum(body: str) -> str:
    """CRC-32 of the body as six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


@cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Runs of 24 or more of [0-9a-f]: every such run covers a multiple of 24, and only those places are looked at."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[::24]
    near = np.flatnonzero(((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 102)))
    out, end = [], -1
    for i in (near * 24).tolist():
        if i < end:
            continue
        a = i
        while a and text[a - 1] in "0123456789abcdef":
            a -= 1
        if m := HEX.match(text, a):
            out.append(m.span())
            end = m.end()
    return out


def find(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text, by start, then by kind as listed."""
    low = text.lower()
    if len(low) != len(text):  # a letter that grows would shift the places
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    hits = sorted({(end + 1 - size, kind) for end, (size, kind) in automaton().iter(low)})
    out, past = [("hex", a, b) for a, b in hex_runs(text)], dict.fromkeys(KINDS, 0)
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[1]) >= 6:
                    out.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= 20:
                    out.append((kind, at, m.end()))
        elif m := (GITHUB if kind == "github" else NPM).match(text, at):
            past[kind] = m.end()
            if checksum(m[0][4:34]) == m[0][34:]:
                out.append((kind, at, m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `spans array<struct<kind,start,end>>`. Narrow: no shuffle."""
    kept = docs.drop("spans")
    schema = T.StructType([*kept.schema.fields, T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def kernel(batches):
        for batch, texts in steps(batches, text):
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "spans"])

    return kept.mapInArrow(kernel, schema)


def redact(docs: DataFrame, mark: str = "<secret>", text: str = "text") -> DataFrame:
    """docs with each span of its text replaced by the mark; overlapping spans become one. Null texts stay null."""

    def clean(t: str | None) -> str | None:
        if t is None or not (spans := find(t)):
            return t
        out, end = [], 0
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if a >= end:
                out += [t[end:a], mark]
            end = max(end, b)
        return "".join([*out, t[end:]])

    def kernel(batches):
        for batch in batches:
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, batch.schema.field(i), pa.array([clean(t) for t in batch.column(i).to_pylist()], batch.schema.field(i).type))

    return docs.mapInArrow(kernel, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of scanned rows."""
    s = F.col("spans")
    return scanned.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(_of_kinds(s, k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(_of_kinds(s, *BASE)), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
    )
