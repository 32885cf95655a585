"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document if at least `threshold` of the item's distinct shingles (five words, lower case, edge
punctuation dropped) stand in the document. Items are partitioned by their number of shingles, in powers of two; the
sketch of an item is its k smallest shingle hashes, with k one more than the number of shingles that an item of its
partition's upper bound may miss. So a document that contains an item holds at least one shingle of the item's sketch:
the search loses nothing, and costs one lookup for each shingle of a document however long it is. The candidates'
containment is then counted exactly, over whole texts.

An item of fewer than five words is one shingle of all its words and is looked for as such. Null or empty items and
documents match nothing. Rows without an id are left out. Repeated rows of documents give repeated results; repeated
items with one id give its largest containment. Hashes have 64 bits.

The items are dealt into blocks of about BLOCK shingles. One block at a time is collected, broadcast, searched for in all
documents and released, so what is sent and held does not grow with the benchmark; the documents are read once a block.
Only the id and the text are read of either table, so other columns' names cannot clash. Empty tables give no rows.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, free_name, shingles, steps, written

WORDS = 5
THRESHOLD = 0.8
BLOCK = 1_000_000
FILTER_BITS = 22


class Sketches:
    """Sorted sketch hashes of the items, by size partition, and all items' shingles."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], threshold: float):
        """items: (item id, shingle width, distinct shingles in ascending order)."""
        self.items, self.threshold = items, threshold
        self.widths: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        groups: dict[tuple[int, int], list[int]] = {}
        for i, (_, width, s) in enumerate(items):
            groups.setdefault((width, math.ceil(math.log2(len(s)))), []).append(i)
        for (width, power), members in sorted(groups.items()):
            k = int((1 - threshold) * 2**power + 1e-9) + 1
            hashes = np.concatenate([items[i][2][:k] for i in members])
            of = np.repeat(members, [min(k, len(items[i][2])) for i in members])
            order = np.argsort(hashes, kind="stable")
            self.widths.setdefault(width, []).append((hashes[order], of[order]))
        self.near = {}
        for width, parts in self.widths.items():
            self.near[width] = np.zeros(1 << FILTER_BITS, bool)
            for hashes, _ in parts:
                self.near[width][(hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, words: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, shared shingles) of all texts that contain an item."""
        out = []
        for width, parts in self.widths.items():
            s, at = shingles(words, offsets, width)
            hits = np.flatnonzero(self.near[width][(s >> U64(64 - FILTER_BITS)).astype(np.int64)])
            if not len(hits):
                continue
            text = np.searchsorted(at, hits, "right") - 1
            pairs: set[tuple[int, int]] = set()
            for hashes, of in parts:
                low, high = np.searchsorted(hashes, s[hits], "left"), np.searchsorted(hashes, s[hits], "right")
                for j in np.flatnonzero(high > low):
                    pairs.update((int(text[j]), int(i)) for i in of[low[j] : high[j]])
            have: tuple[int, np.ndarray | None] = (-1, None)
            for t, i in sorted(pairs):
                if have[0] != t:
                    have = (t, np.unique(s[at[t] : at[t + 1]]))
                item = self.items[i][2]
                shared = int((have[1][np.minimum(np.searchsorted(have[1], item), len(have[1]) - 1)] == item).sum())
                if shared >= self.threshold * len(item) - 1e-9:
                    out.append((t, i, shared))
        return out


def _prepared(items: DataFrame, n: int) -> DataFrame:
    """item_id, width, shingles (distinct, ascending as unsigned) of the items that have words."""

    def kernel(batches):
        hashes = WordHashes(strip=True)
        for batch, texts in steps(batches):
            words, at = hashes.of(texts)
            rows = []
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if b > a:
                    width = min(n, int(b - a))
                    rows.append((i, width, np.unique(shingles(words[a:b], np.array([0, b - a]), width)[0]).view(np.int64)))
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item_id", "width", "shingles"])

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    return own.mapInArrow(kernel, "item_id long, width int, shingles array<long>")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: one row for each document and item that it contains."""
    spark = docs.sparkSession
    prepared = _prepared(items, n)
    total = prepared.agg(F.sum(F.size("shingles"))).collect()[0][0] or 0
    blocks = max(1, -(-total // block))
    if blocks > 1:  # what is read for each block is made once
        prepared = written(prepared, "items")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")

    def search(number: int) -> DataFrame:
        rows = prepared.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()
        sent = spark.sparkContext.broadcast([(r[0], r[1], np.array(r[2], np.int64).view(U64)) for r in rows])

        def kernel(batches):
            sketches, hashes = Sketches(sent.value, threshold), WordHashes(strip=True)
            for batch, texts in steps(batches):
                ids, best = batch.column(0).to_pylist(), {}
                for t, i, shared in sketches.find(*hashes.of(texts)):
                    item, _, s = sketches.items[i]
                    key = (t, item)
                    if key not in best or shared / len(s) > best[key][0] / best[key][1]:
                        best[key] = (shared, len(s))
                rows = [(ids[t], item, a, b, a / b) for (t, item), (a, b) in best.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(),) * 4 + (pa.float64(),), strict=True)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

        found = own.mapInArrow(kernel, "doc_id long, item_id long, n_shared long, n_item long, containment double")
        if blocks == 1:
            return found
        found = written(found, "found")
        sent.unpersist()
        return found

    return reduce(DataFrame.unionByName, [search(i) for i in range(blocks)])


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item; their columns stay as they are. Documents without an id are searched, too.

    Rows are told apart by doc_id and text, so of rows that share an id only those whose own text has an item go.
    """
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), F.col("doc_id").isNull(), F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    row, gone = free_name(docs, "_row"), free_name(docs, "_gone")
    keyed = docs.withColumn(row, F.struct(*key))
    # The search hands on a long id, so each row gets a hash of its key for one.
    found = contained_items(keyed.select(F.xxhash64(row).alias("doc_id"), "text"), items, **options)
    found = found.select(F.col("doc_id").alias(gone)).distinct()
    return keyed.join(found, F.xxhash64(row) == F.col(gone), "left_anti").drop(row)
