"""Helpers shared by the training-data operators: batches, shared folders, word hashes."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Text handled by one vectorised step of a kernel, in characters; one longer document makes a step of its own.
STEP_CHARS = 1_500_000
#: Entries that a worker's word or pre-token cache may hold before it is emptied.
CACHE_ENTRIES = 400_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one of our own in local mode (tests).

    On a cluster without that setting there is no folder to trust, so this fails rather than write where others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found or f"/tmp/checkpoints/{os.getpid()}"


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df doesn't have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: cuts the lineage and survives lost executors.

    The shuffle files behind it are of no more use, so they go at once, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def steps(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about `limit` characters together; null texts become empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand. strip: edge punctuation is dropped, and a word of nothing else gets 0."""

    def __init__(self, strip: bool = False):
        super().__init__()
        self.strip = strip

    def __missing__(self, word: str) -> int:
        import xxhash

        key = _EDGE.sub("", word) if self.strip else word
        h = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) | 1 if key else 0
        self[word] = h
        return h

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all lower-cased words of the texts, and the offsets of the texts in them."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        get, parts, offsets = self.__getitem__, [], [0]
        for t in texts:
            words = t.lower().split()
            a = np.fromiter(map(get, words), U64, len(words))
            if self.strip:
                a = a[a != 0]
            parts.append(a)
            offsets.append(offsets[-1] + len(a))
        return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.array(offsets, np.int64)


_ODD = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, in order, and their offsets.

    A text of fewer than n words, but at least one, has one shingle: all its words. An empty text has none.
    """
    lengths = np.diff(offsets)
    counts = np.where(lengths >= n, lengths - n + 1, np.minimum(lengths, 1))
    out_offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(out_offsets[-1]), U64)
    if not len(words):
        return out, out_offsets
    m = len(words) - n + 1
    if m > 0:
        h = np.zeros(m, U64)
        for j in range(n):
            h = (h ^ words[j : j + m]) * _ODD[j % 5]
            h ^= h >> U64(29)
        for at, o, k in zip(offsets[:-1][lengths >= n], out_offsets[:-1][lengths >= n], counts[lengths >= n], strict=True):
            out[o : o + k] = h[at : at + k]
    for i in np.flatnonzero((lengths < n) & (lengths > 0)):
        h = U64(int(lengths[i]))
        for w in words[offsets[i] : offsets[i + 1]]:
            h = mix(np.array([h ^ w], U64))[0]
        out[out_offsets[i]] = h
    return mix(out), out_offsets
