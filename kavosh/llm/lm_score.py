"""LM scoring: masked pseudo-likelihood of a bidirectional window network and of the windows that the corpus repeats.

The network. Words (lower case, split at white space) are hashed into 2**18 buckets; a bucket's upper bits come from the
word's last two letters. The most frequent buckets are a class each, all others share a class with the buckets of the
same ending. Two passes over the whole corpus gather how often each bucket occurs and how often each class stands between
each pair of neighbouring classes (a text's edge is a class, too). A network with one hidden layer is trained in numpy on
all those windows: from the left and the right neighbour of a masked word it predicts the word's class. A word's
probability is that of its class times that of its bucket within the class, by smoothed corpus counts. This part has a
fixed size, so it is broadcast (9 MB).

The memory. Of every pair of a left and a right neighbour (whole words) in the corpus each word that stands between them
is counted, wherever it stands. These counts grow with the corpus, are never in one place and nothing of them reaches the
driver. A masked word is predicted from the other occurrences of its neighbours: with C other windows of the pair, n of
them with the word and D different words in them, its probability is (max(n - d, 0) + d * D * P_network) / C, d = 0.75
(absolute discounting, a distribution over all words as the network's is). Where the pair stands nowhere else, the network
alone speaks. When the documents are not those that the model was fitted on, all occurrences count, as none is the masked
one.

How it runs. The texts are split once: a chunk of some texts becomes a row with the hashes of its words, in the shared
folder, and all further passes read these chunks. To be scored, a chunk deals its windows, each different one once with
how often it stands there, to buckets by the hash of the pair; a bucket counts those of all chunks and answers each chunk
in the order of its questions, so neither carries a place. Buckets grow in number with the corpus; what a bucket holds of
one pair is a row for each different word of each chunk. Answers about pairs that stand nowhere else are empty. A pair is told from the others of its bucket by 36 bits of its hash, a word from the others of its pair by 28.

A document's pseudo-log-likelihood is the sum over all its words. Counts are combined within a task before they are
shuffled, and equal texts share a score. Of texts that a model was said to be fitted on but was not, nothing is known:
their results are null.
Documents without words (null, empty, blank) have n_tokens 0, pll 0.0 and a null mean. Repeated rows count and are scored
each. Ties between buckets for a class of their own go to the smaller bucket. Columns named like the results are
replaced. Of an empty table nothing is learnt and nothing returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, WordHashes, free_name, mix, steps, written  # noqa: F401

BUCKET_BITS, ENDING_BITS = 18, 5
OWN = 95
CLASSES = 128  # 1 edge, OWN frequent buckets, 32 endings
HIDDEN, ROUNDS, RATE = 32, 120, 0.05
MEMORY, DISCOUNT = 1, 0.75  # one in MEMORY pairs is counted: all of them
PAIR_BITS, WORD_BITS = 36, 28
CHUNK_CHARS = 4_000_000
BUCKET_WINDOWS = 1 << 20  # windows of a bucket, at most about
_HASH_BITS = 64 - ENDING_BITS


#: ASCII white space as str.split() has it.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte, and n powers of the base."""
    powers = np.full(n, 0x9E3779B97F4A7C15, U64)
    powers[0] = 1
    return np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64), np.multiply.accumulate(powers)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the different words of the texts (lower case, split at white space), the number among them of each word of
    the texts laid end to end, and the numbers of words. A value is a word's ending, in the upper bits, and its hash.
    """
    lower = [t.lower() for t in texts]
    raw = [(t if t.isascii() else " ".join(t.split())).encode("utf-8", "surrogatepass") for t in lower]
    data = np.frombuffer(b"\n".join(raw), np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)])))
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64), sizes
    data, upto = data[inside], np.cumsum(ends - starts)
    lengths = ends - starts
    starts = upto - lengths
    byte, powers = _tables(1 << max(8, int(lengths.max()).bit_length()))
    hashes = mix(np.add.reduceat(byte[data] * powers[np.arange(len(data)) - np.repeat(starts, lengths)], starts))
    each = pa.array(hashes).dictionary_encode()
    of, hashes = each.indices.to_numpy().astype(np.int64), each.dictionary.to_numpy()
    # The last two characters of each different word, at most eight bytes, where it stands first.
    some = np.zeros(len(hashes), np.int64)
    some[of[::-1]] = np.arange(len(of))[::-1]
    begins = (data & 0xC0) != 0x80
    characters, last = np.flatnonzero(begins), np.cumsum(begins)[upto[some] - 1]
    at, ending = np.maximum(characters[np.maximum(last - 2, 0)], starts[some]), np.zeros(len(hashes), U64)
    for i in range(8):
        x = at + i
        ending |= np.where(x < upto[some], data[np.minimum(x, len(data) - 1)], 0).astype(U64) << U64(8 * i)
    return (mix(ending) >> U64(_HASH_BITS) << U64(_HASH_BITS)) | (hashes >> U64(ENDING_BITS)), of, sizes


def bucket_of(values: np.ndarray) -> np.ndarray:
    rest = BUCKET_BITS - ENDING_BITS
    return ((values >> U64(_HASH_BITS)) << U64(rest) | (values & U64((1 << rest) - 1))).astype(np.int32)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words of the texts laid end to end, and the numbers of words."""
    values, of, sizes = split(texts)
    return bucket_of(values)[of], sizes


def neighbours(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The left and the right neighbour of each of x, which has texts of the given sizes end to end; 0 at their edges."""
    left, right = np.zeros_like(x), np.zeros_like(x)
    left[1:], right[:-1] = x[:-1], x[1:]
    ends = np.cumsum(sizes)[sizes > 0]
    right[ends - 1] = 0
    left[ends - sizes[sizes > 0]] = 0
    return left, right


def windows(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(left * CLASSES + right) * CLASSES + class of each word; an edge is class 0."""
    left, right = neighbours(classes.astype(np.int64), sizes)
    return (left * CLASSES + right) * CLASSES + classes


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest ones first, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    n, w = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(raw[8:], n * w, "zstd"), np.uint8)
    return np.ascontiguousarray(flat.reshape(w, n).T).reshape(-1).view(kind)


_CHUNK = "chunk long, n long, keys binary, sizes binary, values binary, of binary"


def _chunks(texts: DataFrame) -> DataFrame:
    """One row for each chunk of texts: key long, text."""

    def kernel(batches):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for batch, found in steps(batches, limit=CHUNK_CHARS):
            values, of, sizes = split(found)
            parts = [np.asarray(batch.column(0)), sizes.astype(np.int64), values, of.astype(np.uint32)]
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(of)]), *(pa.array([_packed(x)], pa.binary()) for x in parts)], ["chunk", "n", "keys", "sizes", "values", "of"])
            chunk += 1

    return written(texts.mapInArrow(kernel, _CHUNK), "chunks")


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """values, of, sizes of a chunk, as split has them."""
    return _unpacked(row["values"], U64), _unpacked(row["of"], np.uint32).astype(np.int64), _unpacked(row["sizes"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _counts(chunks: DataFrame, places: int, of) -> np.ndarray:
    """How often each place occurs in the corpus, as of(values, of, sizes) has the places and how often each is there."""

    def kernel(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(places, np.int64)
        for row in _rows(batches):
            at, n = of(*_opened(row))
            total += np.bincount(at, n, places).astype(np.int64)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 65_536].astype(np.int32)), pa.array(total[at[i : i + 65_536]])], ["place", "n"])

    rows = chunks.mapInArrow(kernel, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(places, np.float64)
    out[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return out


class Model:
    """classes of buckets, log-probability of a bucket in its class, and of a class in its window; the memory.

    memory: the chunks of the corpus, whose windows are counted when documents are scored, or None.
    """

    def __init__(self, classes: np.ndarray, word: np.ndarray, window: np.ndarray, memory: DataFrame | None = None):
        self.classes, self.word, self.window, self.memory = classes, word, window, memory

    def each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The conditional log-probability of every word, and the numbers of words."""
        b, sizes = buckets(texts)
        return self.window[windows(self.classes[b].astype(np.int64), sizes)].astype(np.float64) + self.word[b], sizes


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each bucket, and its smoothed log-probability within the class."""
    rest = BUCKET_BITS - ENDING_BITS
    classes = (1 + OWN + (np.arange(len(counts)) >> rest)).astype(np.int16)
    top = np.lexsort((np.arange(len(counts)), -counts))[:OWN]
    top = top[counts[top] > 0]
    classes[top] = 1 + np.arange(len(top))
    total, size = np.bincount(classes, counts + 1, CLASSES), np.bincount(classes, minlength=CLASSES)
    return classes, (np.log(counts + 1) - np.log(np.where(size > 0, total, 1))[classes]).astype(np.float32)


def train(seen: np.ndarray, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE) -> np.ndarray:
    """log P(class | left, right) for all windows, from how often each was seen (a CLASSES**3 array)."""
    c = seen.reshape(CLASSES * CLASSES, CLASSES)
    rows = np.flatnonzero(c.sum(axis=1))
    rng = np.random.default_rng(8)
    left, right = (rng.normal(0, 0.3, (CLASSES, hidden)).astype(np.float32) for _ in range(2))
    weights = [left, right, np.zeros(hidden, np.float32), rng.normal(0, 0.1, (hidden, CLASSES)).astype(np.float32), np.log((c.sum(axis=0) + 1) / (c.sum() + CLASSES)).astype(np.float32)]

    def forward(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(weights[0][at // CLASSES] + weights[1][at % CLASSES] + weights[2])
        x = h @ weights[3] + weights[4]
        x -= x.max(axis=1, keepdims=True)
        return h, x - np.log(np.exp(x).sum(axis=1, keepdims=True))

    if len(rows):
        target = (c[rows] / c.sum()).astype(np.float32)
        mass = target.sum(axis=1, keepdims=True)
        every = np.eye(CLASSES, dtype=np.float32)
        m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, rounds + 1):
            grads = [np.zeros_like(w) for w in weights]
            for a in range(0, len(rows), 4096):
                at, t, k = rows[a : a + 4096], target[a : a + 4096], mass[a : a + 4096]
                h, logp = forward(at)
                d = np.exp(logp) * k - t
                grads[3] += h.T @ d
                grads[4] += d.sum(axis=0)
                dh = (d @ weights[3].T) * (1 - h * h)
                grads[0] += every[at // CLASSES].T @ dh
                grads[1] += every[at % CLASSES].T @ dh
                grads[2] += dh.sum(axis=0)
            for w, g, mi, vi in zip(weights, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                w -= rate * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.99**step)) + 1e-8)
    return np.concatenate([forward(np.arange(a, a + 4096))[1] for a in range(0, CLASSES * CLASSES, 4096)]).astype(np.float32).ravel()


def different(values: np.ndarray, of: np.ndarray, sizes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket (2**bits of them), key and times of a chunk's windows, and which one each of its words is; buckets ascend.

    A window is here more than once only where another one has the same bits to be sorted by; the bucket adds up all.
    """
    mixed = mix(values)[of]
    left, right = neighbours(mixed, sizes)
    pair = mix(left * U64(3) ^ right)
    key = (pair << U64(WORD_BITS)) | (mixed >> U64(64 - WORD_BITS))
    n, low = len(of), U64(max(1, len(of).bit_length()))
    rank = (pair >> U64(40) << U64(40)) | (key * U64(0x9E3779B97F4A7C15) >> U64(24))
    # Sorting the numbers with their places in their lowest bits is several times faster than sorting the places by them.
    order = (np.sort((rank >> low << low) | np.arange(n, dtype=U64)) & ((U64(1) << low) - U64(1))).astype(np.int64)
    bucket, key = (pair[order] >> U64(64 - bits)).astype(np.int64), key[order]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])
    which = np.zeros(n, np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return bucket[first], key[first], np.diff(np.append(first, n)), which


def _asked(chunks: DataFrame, bits: int, asks: bool, counts: bool) -> DataFrame:
    """bucket, chunk, asks, counts, keys, times: the windows of chunks, dealt to buckets."""

    def kernel(batches):
        for row in _rows(batches):
            bucket, key, times, _ = different(*_opened(row), bits)
            edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)).tolist(), len(bucket)]
            raw, once = key.tobytes(), times == 1
            spans = list(zip(edges, edges[1:]))  # noqa: B905, RUF007
            columns = [
                pa.array(bucket[edges[:-1]], pa.int64()), pa.array([row["chunk"]] * len(spans), pa.int64()), pa.array([asks] * len(spans), pa.bool_()), pa.array([counts] * len(spans), pa.bool_()),
                pa.array([raw[8 * a : 8 * b] for a, b in spans], pa.binary()), pa.array([b"" if once[a:b].all() else times[a:b].tobytes() for a, b in spans], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "asks", "counts", "keys", "times"])

    return chunks.mapInArrow(kernel, "bucket long, chunk long, asks boolean, counts boolean, keys binary, times binary")


def counted(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often each window is in the bucket, how often its pair is, and with how many different words."""
    order = np.argsort(key)
    s, t = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n, pair = np.add.reduceat(t, first), s[first] >> U64(WORD_BITS)
    begin = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    size = np.diff(np.append(begin, len(first)))
    each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(s))))
    out = []
    for x in (n, np.repeat(np.add.reduceat(n, begin), size), np.repeat(np.add.reduceat((n > 0).astype(np.int64), begin), size)):
        own = np.zeros(len(key), np.int64)
        own[order] = x[each]
        out.append(own)
    return tuple(out)


def _answers(asked: DataFrame, least: int, parts: int) -> DataFrame:
    """chunk, bucket, answer: whether the pair of each window asked for is there `least` times, and the counts if so."""

    def answered(held: list[dict]) -> pa.RecordBatch:
        keys = [np.frombuffer(r["keys"], U64) for r in held]
        times = [np.zeros(len(k), np.int64) if not r["counts"] else np.frombuffer(r["times"], np.int64) if r["times"] else np.ones(len(k), np.int64) for r, k in zip(held, keys, strict=True)]
        n, total, kinds = counted(np.concatenate(keys), np.concatenate(times))
        chunk, answer, at = [], [], 0
        for r, k in zip(held, keys, strict=True):
            if r["asks"]:
                own = [x[at : at + len(k)] for x in (n, total, kinds)]
                told = own[1] >= least
                chunk.append(r["chunk"])
                answer.append(len(k).to_bytes(8, "little") + np.packbits(told).tobytes() + _packed(np.concatenate([x[told] for x in own])))
            at += len(k)
        return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array([held[0]["bucket"]] * len(chunk), pa.int64()), pa.array(answer, pa.binary())], ["chunk", "bucket", "answer"])

    def kernel(batches):
        held = []
        for row in _rows(batches):
            if held and row["bucket"] != held[0]["bucket"]:
                yield answered(held)
                held = []
            held.append(row)
        if held:
            yield answered(held)

    return written(asked.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(kernel, "chunk long, bucket long, answer binary"), "answers")


def _told(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each window of a chunk was told, and (n, total, kinds) of those that were."""
    flags, counts = [np.zeros(0, bool)], [np.zeros((3, 0), np.int64)]
    for raw in answers:
        n = int.from_bytes(raw[:8], "little")
        upto = 8 + -(-n // 8)
        flags.append(np.unpackbits(np.frombuffer(raw[8:upto], np.uint8), count=n).astype(bool))
        counts.append(_unpacked(raw[upto:], np.int64).reshape(3, -1))
    return np.concatenate(flags), np.concatenate(counts, axis=1)


def _keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(own).alias("key"), own.alias("text"))


def fit(docs: DataFrame) -> Model:
    """docs: text. One pass over all texts, two over all their words."""
    spark, chunks = docs.sparkSession, _chunks(_keyed(docs))
    classes, word = classes_of(_counts(chunks, 1 << BUCKET_BITS, lambda values, of, sizes: (bucket_of(values), np.bincount(of, minlength=len(values)))))
    sent = spark.sparkContext.broadcast(classes)

    def triples(values, of, sizes):
        return windows(sent.value[bucket_of(values)].astype(np.int64)[of], sizes), None

    return Model(classes, word, _trained(spark, _counts(chunks, CLASSES**3, triples)), chunks)


def _trained(spark: SparkSession, seen: np.ndarray) -> np.ndarray:
    """train() in a task, where linear algebra keeps to one thread; the windows and the table have a fixed size."""
    sent = spark.sparkContext.broadcast(seen)

    def kernel(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([train(sent.value).tobytes()], pa.binary())], ["table"])

    return np.frombuffer(bytes(spark.range(0, 1, 1, 1).mapInArrow(kernel, "table binary").collect()[0][0]), np.float32)


def adjusted(logp: np.ndarray, own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """log(own + share * P) of the network's log P."""
    return np.logaddexp(np.log(np.maximum(own, 1e-300)), np.log(share) + logp)


def score(docs: DataFrame, model: Model, text: str = "text", masked: bool = True) -> DataFrame:
    """docs with n_tokens, pll (the summed conditional log-probabilities) and mean_logp.

    masked: the documents are those that the model was fitted on, so each word is left out of the counts that predict it.
    """
    names = ["n_tokens", "pll", "mean_logp"]
    kept, spark, one = docs.drop(*names), docs.sparkSession, int(masked)
    known = model.memory
    chunks = known if masked and known is not None else _chunks(_keyed(docs, text))
    sent = spark.sparkContext.broadcast((model.classes, model.word, model.window))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.withColumn("bucket", F.lit(-1).cast("long")).withColumn("answer", F.lit(None).cast("binary"))
    bits = 1
    if known is not None:
        total = known.agg(F.sum("n")).collect()[0][0] or 0
        bits = min(20, max(4, (total // BUCKET_WINDOWS).bit_length()))
        asked = _asked(known, bits, True, True) if masked else _asked(chunks, bits, True, False).unionAll(_asked(known, bits, False, True))
        rows = rows.unionByName(_answers(asked, 1 + one, parts), allowMissingColumns=True)

    def scored(row: dict, answers: list[bytes]) -> pa.RecordBatch:
        own = Model(*sent.value)
        values, of, sizes = _opened(row)
        bucket = bucket_of(values)
        each = own.window[windows(own.classes[bucket].astype(np.int64)[of], sizes)].astype(np.float64) + own.word[bucket][of]
        if answers:
            told, (n, total, kinds) = _told(answers)
            *_, which = different(values, of, sizes, bits)
            at = np.flatnonzero(told[which])
            x = (np.cumsum(told) - 1)[which[at]]
            lone = (n == 1) if masked else np.zeros(len(n), bool)
            by = total - one
            each[at] = adjusted(each[at], (np.maximum(n - one - DISCOUNT, 0) / by)[x], (DISCOUNT * (kinds - lone) / by)[x])
        pll, some = np.zeros(len(sizes)), sizes > 0
        if some.any():
            pll[some] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[some])
        return pa.RecordBatch.from_arrays([pa.array(_unpacked(row["keys"], np.int64)), pa.array(sizes), pa.array(pll)], ["key", "n_tokens", "pll"])

    def kernel(batches):
        row, answers = None, []
        for r in _rows(batches):
            if r["bucket"] >= 0:
                answers.append(r["answer"])
                continue
            if row is not None:
                yield scored(row, answers)
            row, answers = r, []
        if row is not None:
            yield scored(row, answers)

    each = rows.repartition(parts, "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(kernel, "key long, n_tokens long, pll double")
    key = free_name(kept, "_key")
    # Equal texts have equal sums, so any of them will do.
    found = each.groupBy("key").agg(F.max("n_tokens").alias("n_tokens"), F.max("pll").alias("pll")).withColumnRenamed("key", key)
    mean = F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens")).alias("mean_logp")
    keyed = kept.withColumn(key, F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return keyed.join(found, key, "left").select(*(F.col(f"`{c}`") for c in kept.columns), "n_tokens", "pll", mean)
