"""N-gram Jaccard join: a MinHash LSH forest proposes, exact shingle sets decide.

Documents with the same words (lower case, split at white space) are one text. Each text has TREES labels, one a tree, of
MAX_DEPTH MinHash values of BITS bits: a label's numeric order is the order of the tree's prefix trie, and a prefix of d
values is a node at depth d. The search starts at the full depth. Texts that share a node are candidates; clusters of
candidates are found as connected components and verified exactly, all pairs of a cluster, in blocks of bounded size, so
a hot group is spread over tasks and no pair is ever a row.

Then the matched prefixes are shortened by one value as long as the target is missed: from the exact similarity s of
every pair found at depth d, which had the chance p(s) = 1 - (1 - s^d)^TREES to be found, the pairs that were missed are
estimated (the sum of (1 - p) / p), and with them the recall. So a corpus of close copies is done at the full depth, and
one with many pairs near the threshold goes down; it always goes down while a pair at the threshold itself would be
missed more often than FLOOR allows, and never below the depth at which such a pair meets the target by itself.

Results, one row for each row with a doc_id: class_id, the smallest doc_id among all documents linked directly or through
others; n_links, the number of other documents at or above the threshold, copies counted each; n_texts, the number of
other texts among them. Rows without words (null, empty, blank) are linked to nothing, not even to each other. Texts
of fewer than n words have one shingle, all their words. Rows that share a doc_id are documents of their own, each with
its text. Rows without a doc_id count as documents in links and are linked, but have no row. Columns other than doc_id
and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, free_name, mix, shingles, steps, written
from .components import components

WORDS, THRESHOLD, RECALL, FLOOR = 5, 0.8, 0.9999, 0.999
TREES, MAX_DEPTH, BITS = 20, 5, 12
#: Texts, and words, of a block; a task holds two blocks.
BLOCK_TEXTS, BLOCK_WORDS = 512, 2_000_000
COLUMNS = 8192
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, TREES * MAX_DEPTH, dtype=np.uint64) | U64(1)


def met(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The chance that a pair of that similarity shares a node at that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def labels(sh: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The labels of the texts that have shingles, one row each."""
    have = np.flatnonzero(np.diff(offsets))
    begins, out = offsets[have], np.zeros((len(have), TREES), U64)
    if len(have):
        for i, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(sh * factor, begins)
            tree = i // MAX_DEPTH
            out[:, tree] = (out[:, tree] << U64(BITS)) | (mix(least + U64(i)) >> U64(64 - BITS))
    return out


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """docs: id, t1, t2, text -> id, t1, t2, the key of its words, their number, labels."""

    def kernel(batches):
        import xxhash

        hashes = WordHashes()
        for batch, texts in steps(batches):
            words, at = hashes.of(texts)
            sh, off = shingles(words, at, n)
            sizes = np.diff(at)
            rows, keys = labels(sh, off).view(np.int64), np.zeros((len(texts), 2), np.int64)
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                if b > a:
                    keys[i] = np.frombuffer(xxhash.xxh3_128_digest(words[a:b].tobytes()), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, TREES, 0))]).astype(np.int32)), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sizes.astype(np.int64)), lists], ["id", "t1", "t2", "k1", "k2", "n_words", "labels"])

    return docs.mapInArrow(kernel, "id long, t1 long, t2 long, k1 long, k2 long, n_words long, labels array<long>")


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which sets (sorted distinct hashes) are similar, left x right or left x left without the diagonal; and how much."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.float64)
    of = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    new = np.cumsum(times > 1) - 1  # shingles of one set only can't be shared
    keep = times[column] > 1
    of, column = of[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    n, m = len(left), len(sets)
    shared = np.zeros((n, m if right is None else m - n), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for a in range(0, last, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        part = np.zeros((m, min(COLUMNS, last - a)), np.float32)
        part[of[x:y], column[x:y] - a] = 1
        shared += part[:n] @ (part if right is None else part[n:]).T
    a, b = sizes[:n, None], (sizes if right is None else sizes[n:])[None, :]
    every = a + b - shared
    out = shared >= threshold * every - 1e-6
    if right is None:
        np.fill_diagonal(out, False)
    return out, shared / np.maximum(every, 1)


def _roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each one's component. linked: symmetric."""
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == root).all():
            return root
        root = new


def _verified(rows: DataFrame, threshold: float, n: int, depth: int) -> DataFrame:
    """rows: cluster, i, j, block, node, n_same, text, sorted by cluster, i, j -> node, root, n_links, n_texts, missed.

    missed: how many pairs like the node's own, by their similarity, the candidate search must have missed.
    """

    def group(key, block, node, same, texts, hashes):
        _, i, j = key
        sh, off = shingles(*hashes.of(texts), n)
        sets = [np.unique(sh[a:b]) for a, b in zip(off, off[1:], strict=False)]
        node, same, block = np.array(node, np.int64), np.array(same, np.int64), np.array(block)
        if i == j:
            linked, how = similar(sets, None, threshold)
        else:
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            linked, how = np.zeros((len(sets), len(sets)), bool), np.zeros((len(sets), len(sets)))
            if len(left) and len(right):
                cross, much = similar([sets[x] for x in left], [sets[x] for x in right], threshold)
                linked[np.ix_(left, right)], linked[np.ix_(right, left)] = cross, cross.T
                how[np.ix_(left, right)], how[np.ix_(right, left)] = much, much.T
        found = np.where(linked, met(how, depth), 1.0)
        missed = ((1 - found) / np.maximum(found, 1e-9)).sum(axis=1)
        return node, _roots(linked, node), linked @ same, linked.sum(axis=1), missed

    def kernel(batches):
        hashes, key, held = WordHashes(), None, []
        names = ["node", "root", "n_links", "n_texts", "missed"]

        def done():
            columns = group(key, *map(list, zip(*held, strict=True)), hashes)
            return pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in columns[:4]), pa.array(columns[4])], names)

        for batch in batches:
            cluster, i, j = (batch.column(k).to_pylist() for k in range(3))
            rest = [batch.column(k).to_pylist() for k in range(3, 7)]
            for x, row in enumerate(zip(*rest, strict=True)):
                if (cluster[x], i[x], j[x]) != key:
                    if held:
                        yield done()
                    key, held = (cluster[x], i[x], j[x]), []
                held.append((*row[:3], row[3] or ""))
        if held:
            yield done()

    return rows.mapInArrow(kernel, "node long, root long, n_links long, n_texts long, missed double")


class _Found:
    """What a join found: signed rows, their texts, the links between texts by node, and the depths that were tried."""

    def __init__(self, docs: DataFrame, threshold: float, recall: float, n: int, block_texts: int, block_words: int):
        text = F.col("text").cast("string")
        # A row's id is its doc_id; t1 and t2 tell rows apart that share one, or have none.
        own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"), text.alias("text"))
        self.signed = written(_signatures(own, n), "signatures")
        # A text's row is the one with the least id, null ids last.
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2", "n_words", "labels"))
        texts = self.signed.where("n_words > 0").groupBy("k1", "k2").agg(least.alias("x"), F.count(F.lit(1)).alias("n_same"))
        self.texts = written(texts.select("k1", "k2", "x.id", "x.t1", "x.t2", "x.n_words", "x.labels", "n_same", F.monotonically_increasing_id().alias("node")), "texts")
        self.own, self.parts = own, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.block_texts, self.block_words = block_texts, block_words
        self.depths: list[int] = []
        for d in range(MAX_DEPTH, 0, -1):
            self.depths.append(d)
            self.links = written(_verified(self._blocks(d), threshold, n, d), "links")
            if met(threshold, d) >= recall:
                break
            if met(threshold, d) >= FLOOR:
                pairs, missed = self.links.agg(F.coalesce(F.sum("n_texts"), F.lit(0)), F.coalesce(F.sum("missed"), F.lit(0.0))).collect()[0]
                if pairs >= recall * (pairs + missed):
                    break

    def _blocks(self, d: int) -> DataFrame:
        """All pairs of blocks of the clusters at depth d."""
        # Nodes of the tries that at least two texts share.
        prefix = F.shiftright(F.col("label"), BITS * (MAX_DEPTH - d))
        nodes = self.texts.select("node", F.posexplode("labels").alias("tree", "label")).select("node", "tree", prefix.alias("prefix"))
        hubs = nodes.groupBy("tree", "prefix").agg(F.min("node").alias("hub"), F.max("node").alias("most")).where("hub <> most").drop("most")
        edges = nodes.join(hubs, ["tree", "prefix"]).where("node <> hub").groupBy("node", "hub").agg(F.lit(1).alias("_")).select(F.col("node").alias("a"), F.col("hub").alias("b"))
        clusters = components(written(edges, "candidates"))
        sized = clusters.join(self.texts.drop("labels"), "node").withColumnRenamed("root", "cluster")
        totals = sized.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / self.block_texts), F.ceil(F.sum("n_words") / self.block_words)).cast("int").alias("blocks"))
        placed = sized.join(totals, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # Rows that are equal in id and text may be many: one of them brings the text, before it is dealt out.
        same_row = [placed["id"].eqNullSafe(self.own["id"]), placed["t1"] == self.own["t1"], placed["t2"] == self.own["t2"]]
        brought = self.own.join(placed, same_row).select("cluster", "block", "blocks", "node", "n_same", self.own["text"])
        held = written(brought.groupBy("cluster", "block", "blocks", "node", "n_same").agg(F.first("text").alias("text")), "clusters")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        pairs = held.select("*", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n_same", "text")
        return pairs.repartition(self.parts, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def classes(self) -> DataFrame:
        """k1, k2, n_same, root (the class's smallest node), n_links, n_texts, id, t1, t2 of each text with words."""
        # A text links within several block pairs, and a class may reach over them.
        counted = self.links.groupBy("node").agg(F.sum("n_links").alias("n_links"), F.sum("n_texts").alias("n_texts"))
        roots = components(self.links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = self.texts.drop("labels").join(counted, "node", "left").join(roots, "node", "left")
        zero = F.lit(0).cast("long")
        return found.select("k1", "k2", "id", "t1", "t2", F.coalesce("root", "node").alias("root"), (F.coalesce("n_links", zero) + F.col("n_same") - 1).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, class_id, n_links, n_texts: see above."""
    found = _Found(docs, threshold, recall, n, block_texts, block_words)
    texts = found.classes()
    # A class of one text needs no sum; the others' smallest ids are few rows.
    least = texts.groupBy("root").agg(F.min("id").alias("class_id"))
    known = texts.join(least, "root").select("k1", "k2", "class_id", "n_links", "n_texts")
    rows = found.signed.where("id is not null").select(F.col("id").alias("doc_id"), "k1", "k2")
    zero = F.lit(0).cast("long")
    return rows.join(known, ["k1", "k2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_texts", zero).alias("n_texts"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS, block_texts: int = BLOCK_TEXTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One document of each class, the one with its smallest doc_id (null ids last); its columns stay as they are.

    Of rows that are equal in doc_id and text one stays, whatever their other columns. Rows without words are no copies
    of others; all of them stay.
    """
    found = _Found(docs, threshold, recall, n, block_texts, block_words)
    texts = found.classes()
    stays = texts.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")).alias("x")).select("x.id", "x.t1", "x.t2")
    # Equal rows among those that stay are counted first, which combines before it shuffles; single ones need no more.
    times = found.signed.where("n_words > 0").groupBy("id", "t1", "t2").agg(F.count(F.lit(1)).alias("times"))
    stays = stays.withColumnRenamed("id", "sid").withColumnRenamed("t1", "s1").withColumnRenamed("t2", "s2")
    kept = times.join(stays, times["id"].eqNullSafe(stays["sid"]) & (times["t1"] == stays["s1"]) & (times["t2"] == stays["s2"])).select("id", "t1", "t2", "times")
    wordless = found.signed.where("n_words = 0").groupBy("id", "t1", "t2").agg(F.lit(1).cast("long").alias("times"))
    kept = written(kept.unionByName(wordless), "kept")

    key = free_name(docs, "_key")
    text = F.col("text").cast("string")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2")))
    same = lambda k: keyed[key]["id"].eqNullSafe(k["id"]) & (keyed[key]["t1"] == k["t1"]) & (keyed[key]["t2"] == k["t2"])
    once, often = kept.where("times = 1"), kept.where("times > 1")
    single = keyed.join(once, same(once), "left_semi").drop(key)
    if not often.limit(1).count():
        return single
    repeated = keyed.join(often, same(often), "left_semi")
    first = repeated.groupBy(key).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return single.unionByName(first.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))
