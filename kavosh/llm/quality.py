"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader (proximal) updates.

Features: words, pairs of neighbouring words, and the same of word shapes, hashed into 2**BITS places; a document's
values are occurrences over the root of their number. Trained on at most SAMPLE labelled rows (the smallest hashes of
doc_id, so the choice doesn't depend on the order of rows); scored as sparse dot products over whole texts.
Null and empty texts have the bias only. Without labelled rows all scores are 0.5. A doc_id that is labelled more than
once, or that stands in several rows, trains once per labelled row. Labels with nulls are not used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, U64, mix, steps

BITS = 18
SAMPLE = 8_000
EPOCHS = 2
_LETTERS, _CAPS, _DIGITS, _RUN = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+"), re.compile(r"(\W)\1+")


class _Words(dict):
    """word -> (word hash, shape hash) packed in one row of an array."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, int]] = []

    def __missing__(self, word: str) -> int:
        import xxhash

        shape = _RUN.sub(r"\1\1", _DIGITS.sub("0", _LETTERS.sub("a", _CAPS.sub("A", word))))
        self[word] = len(self.rows)
        self.rows.append((xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(("\0" + shape).encode("utf-8", "surrogatepass"))))
        return len(self.rows) - 1


_words = _Words()


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all features of the texts laid end to end, with repetitions, and how many each text has."""
    global _words
    if len(_words) > CACHE_ENTRIES:
        _words = _Words()
    split = [t.split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    at = np.fromiter((i for w in split for i in map(_words.__getitem__, w)), np.int64, int(sizes.sum()))
    hashes = np.array(_words.rows, U64).reshape(-1, 2)
    doc = np.repeat(np.arange(len(texts)), sizes)
    out, of = [], []
    for k in (0, 1):
        h = hashes[at, k] if len(at) else np.zeros(0, U64)
        same = doc[1:] == doc[:-1]
        pair = mix((h[:-1] * U64(3)) ^ h[1:])
        pair[at[1:] == at[:-1]] = U64(7 + k)  # a word said twice running is one feature, whatever the word
        out += [h, pair[same]]
        of += [doc, doc[1:][same]]
    place = (mix(np.concatenate(out)) >> U64(64 - BITS)).astype(np.int64)
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return place[order], np.bincount(of, minlength=len(texts))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> np.ndarray:
    """Weights, with the bias last, of rows (places, values, label) in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    bias = 1 << BITS
    for _ in range(EPOCHS):
        for place, value, label in rows:
            i, x = np.append(place, bias), np.append(value, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(np.arange(bias + 1)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> bytes:
    """Float32 weights. labels: doc_id and the label column; only rows whose crc32(doc_id) mod 5 isn't 0 are learnt."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where("doc_id is not null and label in (0, 1)").where(~held_out())
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    )

    def hashed(batches):
        for batch, texts in steps(batches):
            place, sizes = features(texts)
            cuts = np.cumsum(sizes)[:-1]
            each = [np.unique(p, return_counts=True) for p in np.split(place, cuts)]
            values = [c / np.sqrt(max(1, s)) for (_, c), s in zip(each, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p for p, _ in each], pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "label", "place", "value"])

    def learn(batches):
        rows = []
        for b in batches:
            ids, labs = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows += [(i, lab, np.asarray(p.values, dtype=np.int32), np.asarray(v.values, dtype=np.float32)) for i, lab, p, v in zip(ids, labs, b.column(2), b.column(3), strict=True)]
        rows.sort(key=lambda r: (mix(np.array([r[0]], np.int64).view(U64))[0], r[1], len(r[2])))
        yield pa.RecordBatch.from_arrays([pa.array([train([(p, v.astype(float), lab) for _, lab, p, v in rows]).tobytes()], pa.binary())], ["weights"])

    # At most `sample` small rows: bounded, so they are broadcast, and one task learns.
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    rows = both.mapInArrow(hashed, "doc_id long, label int, place array<long>, value array<double>").repartition(1)
    return bytes(rows.mapInArrow(learn, "weights binary").collect()[0][0])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def score_texts(texts: list[str], weights: np.ndarray) -> np.ndarray:
    place, sizes = features(texts)
    total = np.concatenate([[0.0], np.cumsum(weights[place].astype(np.float64))])
    ends = np.cumsum(sizes)
    return 1 / (1 + np.exp(-np.clip((total[ends] - total[ends - sizes]) / np.sqrt(np.maximum(sizes, 1)) + weights[-1], -30, 30)))


def score(docs: DataFrame, weights: bytes, text: str = "text", out: str = "score") -> DataFrame:
    """docs with `score double`, in place of a column of that name. Narrow; the weights (1 MB, a fixed size) are broadcast."""
    from pyspark.sql import types as T

    sent = docs.sparkSession.sparkContext.broadcast(weights)
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])

    def kernel(batches):
        w = np.frombuffer(sent.value, np.float32)
        for batch, texts in steps(batches, text):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score_texts(texts, w))], [*batch.schema.names, out])

    return kept.mapInArrow(kernel, schema)
