"""Seeded hashes and splits: 32-bit FNV-1a over a string's characters, as a Column fold and in Python; mulberry32."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

BASIS, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-16 units (code points, for text of the basic plane), as a long."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(BASIS).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * PRIME).bitwiseAND(F.lit(MASK).cast("long")))


def seed_of(text: str) -> int:
    h = BASIS
    raw = text.encode("utf-16-le")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * PRIME) & MASK
    return h


def mulberry32(seed: int) -> Iterator[float]:
    """A small seeded generator of numbers in [0, 1)."""
    state = seed & MASK
    while True:
        state = (state + 0x6D2B79F5) & MASK
        t = state
        t = ((t ^ (t >> 15)) * (t | 1)) & MASK
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & MASK)) & MASK
        yield ((t ^ (t >> 14)) & MASK) / 4294967296


def split_of(base: Column) -> Column:
    """dev or test; all variants of a base fall into the same half."""
    return F.when(fnv1a(F.concat(F.lit("split/"), base)) % 2 == 1, "test").otherwise("dev")


def lemma_split(lemma: Column) -> Column:
    """One tenth dev, one tenth test, the rest train."""
    d = fnv1a(F.concat(F.lit("lemma/"), lemma)) % 10
    return F.when(d == 0, "dev").when(d == 1, "test").otherwise("train")
