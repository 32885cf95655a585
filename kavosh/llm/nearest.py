"""Approximate nearest neighbours by inner product: multi-index hashing over learned rotated binary codes.

Vectors are lengthened by one component that makes all norms equal (the inner product's order is then the angle's),
centred, and coded by the signs of learned rotations (principal axes, then rotations that lessen the loss of taking
signs); CODE bits altogether, from as many rotations as it takes. A code is split into substrings of 16 bits and each
is indexed: its distinct values, and the rows of each value. By the pigeonhole principle a code within Hamming radius r
of the query's agrees with it in some substring up to floor(r / substrings) bits, so probing all values within that
distance in each index retrieves every code within r; those are reranked by exact inner products in double precision.
The first radius is the one that held REACH of the true neighbours in the sample. Queries that it leaves with fewer than
k + 1 rows, or with a row at the radius itself, are searched again with the radius CODE, which every row lies within, so
exactly: each query ends with k rows, or with all candidates if there are fewer.

The rotations and the radius are fitted on at most SAMPLE rows (smallest hashes of vec_id); all rows are indexed.
Equal vectors are searched once and stand for all their rows: only the k + 1 smallest ids of each are kept in the
index, which is all that can appear among k. Queries and rows are dealt out in blocks of bounded size.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than
the most frequent one (the longer, if tied), or rows without an id. An id that stands in several rows is a candidate by
each; own rows of the query's id are left out. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

CODE, SUB = 256, 16
SAMPLE, CALIBRATION, REACH = 10_000, 500, 0.99
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 4_096


class Coder:
    """mean, longest norm, rotations -> codes of CODE bits as substrings of SUB bits."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest = longest
        x = self.lengthened(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        p = min(64, x.shape[1])
        _, _, axes = np.linalg.svd(x.T @ x if len(x) else np.eye(x.shape[1]))
        base, rng = axes[:p].T, np.random.default_rng(5)
        y, self.rotations = x @ base, []
        for _ in range(-(-CODE // p)):
            r = np.linalg.qr(rng.normal(size=(p, p)))[0]
            for _ in range(12):
                u, _, vt = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
                r = (u @ vt).T
            self.rotations.append(base @ r)
        self.radius = self._radius(sample, k)

    def lengthened(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(0, self.longest**2 - (v * v).sum(axis=1)))
        v = v * (self.longest / np.sqrt((v * v).sum(axis=1)))[:, None] if query else v
        return np.concatenate([v, extra[:, None]], axis=1)

    def codes(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        x = self.lengthened(v, query) - self.mean
        bits = np.concatenate([x @ r >= 0 for r in self.rotations], axis=1)[:, :CODE]
        return np.packbits(bits, axis=1).view(np.uint16)

    def _radius(self, sample: np.ndarray, k: int) -> int:
        q = sample[: min(len(sample), CALIBRATION)]
        score = q @ sample.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        near = np.argsort(-score, axis=1)[:, : min(k, len(sample) - 1)]
        far = hamming(self.codes(q, True), self.codes(sample))
        each = np.take_along_axis(far, near, axis=1)
        return int(np.quantile(each, REACH)) if each.size else CODE


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    return sum(np.bitwise_count(a[:, None, i] ^ b[None, :, i]).astype(np.int32) for i in range(a.shape[1]))


class Index:
    """The rows of a block by the values of each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.subs = []
        for s in range(codes.shape[1]):
            values, which = np.unique(codes[:, s], return_inverse=True)
            self.subs.append((values, which))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code differs in at most `radius` bits."""
        near = radius // len(self.subs)
        found = np.zeros(len(self.codes), bool)
        for s, (values, which) in enumerate(self.subs):
            probes = np.bitwise_count(values ^ code[s]) <= near
            found |= probes[which]
        rows = np.flatnonzero(found)
        return rows[self.far(code, rows) <= radius]

    def far(self, code: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The bits in which the codes of the rows differ from the code."""
        word = np.ascontiguousarray(code).view(np.uint64)
        return np.bitwise_count(self.words[rows] ^ word).sum(axis=1, dtype=np.int64)


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner products of each query row but itself.

    rows: vec_id, embedding; is_query: a condition on vec_id.
    """
    spark = rows.sparkSession
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sizes = own.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("longest")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, longest = sizes[0]["d"], float(np.sqrt(sizes[0]["longest"]))
    # 0.0 and -0.0 are one value; a key of 128 bits stands for the vector.
    own = own.where(F.size("v") == d).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    keyed = own.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))

    from pyspark.sql import Window

    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    classes = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    asked = keyed.where(is_query).select("k1", "k2", F.lit(True).alias("asked")).distinct()
    classes = written(classes.join(asked, ["k1", "k2"], "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "vectors")
    n, n_asked = classes.agg(F.count(F.lit(1)), F.sum(F.col("asked").cast("long"))).collect()[0]
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64(F.col("ids")[0]), F.col("ids")[0]).select("v").limit(SAMPLE).collect()], np.float64)
    fitted = Coder(sample, longest, k)
    coder = spark.sparkContext.broadcast(fitted)

    def search(left: pa.Table, right: pa.Table, radius: int) -> pa.Table:
        matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(-1, d)
        out = {"k1": [], "k2": [], "vec_id": [], "score": [], "far": []}
        if left.num_rows and right.num_rows:
            q, x, ids = matrix(left), matrix(right), right["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            found = Index(coder.value.codes(x))
            keys = list(zip(left["k1"].to_pylist(), left["k2"].to_pylist(), strict=True))
            for (k1, k2), v, code in zip(keys, q, coder.value.codes(q, True), strict=True):
                at = found.within(code, radius)
                scores = (x[at] * v).sum(axis=1)
                if len(at) > 4 * k:  # all that tie with the last one stay
                    keep = scores >= np.partition(scores, -(k + 1))[-(k + 1)]
                    at, scores = at[keep], scores[keep]
                order = np.lexsort((least[at], -scores))[: k + 1]
                far = found.far(code, at[order])
                best = sorted((-s, i, f) for s, a, f in zip(scores[order].tolist(), at[order].tolist(), far.tolist(), strict=True) for i in ids[a])[: k + 1]
                for s, i, f in best:
                    for name, value in zip(out, (k1, k2, i, -s, f), strict=True):
                        out[name].append(value)
        return pa.table({name: pa.array(values, pa.float64() if name == "score" else pa.int64()) for name, values in out.items()})

    spread = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    hashed = F.xxhash64("k1", "k2")
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")

    def hits(wanted: DataFrame, n_wanted: int, radius: int) -> DataFrame:
        """k1, k2, vec_id, score, far: the k + 1 best rows within the radius of each vector wanted."""
        blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-n_wanted // block_queries))
        index = classes.select("k1", "k2", "ids", "v", F.pmod(hashed, F.lit(blocks)).alias("ib"), spread(query_blocks).alias("qb"))
        queries = wanted.select("k1", "k2", "v", F.pmod(hashed, F.lit(query_blocks)).alias("qb"), spread(blocks).alias("ib"))
        parts = queries.groupBy("qb", "ib").cogroup(index.groupBy("qb", "ib")).applyInArrow(lambda a, b: search(a, b, radius), "k1 long, k2 long, vec_id long, score double, far long")
        return written(parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).drop("n"), "hits")

    wanted = classes.where("asked")
    best = hits(wanted, n_asked or 0, fitted.radius)
    done = best.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).where((F.col("n") > k) & (F.col("far") < fitted.radius)).select("k1", "k2")
    short = written(wanted.join(done, ["k1", "k2"], "left_anti"), "short")
    n_short = short.count()
    if n_short:
        best = best.join(done, ["k1", "k2"], "left_semi").unionByName(hits(short, n_short, CODE))
    lists = best.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("found"))
    asking = keyed.where(is_query).select("vec_id", "k1", "k2").withColumnRenamed("vec_id", "query_id")
    other = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = asking.join(lists, ["k1", "k2"]).select("query_id", F.posexplode(other).alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.less")).alias("score"))
