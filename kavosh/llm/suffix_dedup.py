"""Suffix-array deduplication: every byte covered by a 100-byte string that also starts earlier is removed.

1. Anchors. A window of LENGTH bytes belongs to its minimiser, the leftmost least hash among its KGRAM-byte strings.
   Equal windows have equal minimisers at equal places, so a window can only repeat if its anchor's hash does. All
   anchors are dealt out by hash; those whose hash occurs twice go on. Nothing else is lost or guessed: an anchor that
   repeats for another reason is sorted out below.
2. Suffix buckets. Each repeating anchor brings the text of its own windows (at most LENGTH + KGRAM gap bytes) into the
   bucket of its hash. A bucket's suffixes are sorted alone: by their first COVER bytes, and where those tie by the
   ranks of the next positions in a difference cover, which were computed for the bucket beforehand. Neighbours in the
   order that share LENGTH bytes are equal windows; the one that starts first stays, the others are removed.
3. The removed windows of a document are united, and the rest of it is kept.

Memory is bounded by a bucket, and buckets grow in number with the corpus, not in size. Contexts that are equal in full
are settled before they are sent and again before a bucket is sorted (all but the first are removed), and anchors known
to repeat go to any bucket. A task remembers what it has sent (a bounded number of anchors and contexts), so a passage
that stands in a third of all documents adds one anchor a task to its bucket, and the few contexts that are earlier than
all that the task met before.

Null and empty texts have 0 bytes; texts shorter than LENGTH keep all of theirs. Rows that share a doc_id are documents
of their own, in the order of a hash of their texts; equal rows follow each other. Rows without a doc_id are left out.
Columns other than doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, written
from .pieces import ragged

LENGTH, KGRAM, COVER = 100, 32, 32
WINDOW = LENGTH - KGRAM + 1
#: Bytes of text whose anchors, or contexts, make a bucket, about.
BUCKET_BYTES = 16 << 20
CONTEXT_BYTES = 4 << 20
STEP_BYTES = 2_000_000
#: Anchors, and contexts, that a task remembers.
REMEMBERED = 200_000
_BASE = 0x9E3779B97F4A7C15


@cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each byte, and the powers of the base and of its inverse."""
    inverse = pow(_BASE, -1, 1 << 64)
    powers, back = np.full(n, _BASE, U64), np.full(n, inverse, U64)
    powers[0] = back[0] = 1
    return np.random.default_rng(9).integers(1, 1 << 63, 256, dtype=np.uint64), np.multiply.accumulate(powers), np.multiply.accumulate(back)


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KGRAM bytes at each place."""
    byte, powers, back = _tables(1 << max(22, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(byte[data] * powers[: len(data)], out=total[1:])
    return mix((total[KGRAM:] - total[:-KGRAM]) * back[: len(data) - KGRAM + 1])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place, first window, last window) of all anchors of texts laid end to end, without the texts' numbers.

    ends: where each text ends. All places count from the start of data.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(U64), none, none, none
    h = kgram_hashes(data)
    value, place, width = h, np.arange(len(h), dtype=np.int32), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        right = value[step:]
        left = value[: len(right)]
        less = right < left
        place = np.where(less, place[step:], place[: len(right)])
        value = np.where(less, right, left)
        width += step
    starts = np.concatenate([[0], ends[:-1]])
    sizes = np.maximum(0, ends - starts - LENGTH + 1)
    windows = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    if not len(windows):
        return none.astype(U64), none, none, none
    at = place[windows]
    # Texts don't share places, so a new place is a new anchor.
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]], at[first].astype(np.int64), windows[first], windows[last]


def _texts(batches, limit: int = STEP_BYTES):
    """Slices of the batches with their texts as bytes laid end to end and their ends."""
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        begin, size = 0, 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (size and size + len(texts[i]) > limit):
                if i > begin:
                    part = texts[begin:i]
                    yield batch.slice(begin, i - begin), np.frombuffer(b"".join(part), np.uint8), np.cumsum([len(t) for t in part])
                begin, size = i, 0
            if i < len(texts):
                size += len(texts[i])


def _dealt(bucket: np.ndarray, columns: list[np.ndarray], names: list[str], text: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
    """One row for each bucket, with its part of each column as bytes. text: flat bytes, starts and lengths."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else np.zeros(0, int)
    edges = np.append(cuts, len(order)).tolist()
    out = {"bucket": pa.array(bucket[order][cuts], pa.int64())}
    for name, c in zip(names, columns, strict=True):
        raw, w = np.ascontiguousarray(c[order]).tobytes(), c.itemsize
        out[name] = pa.array([raw[a * w : b * w] for a, b in zip(edges, edges[1:])], pa.binary())  # noqa: RUF007
    if text is not None:
        flat, start, size = text
        raw = ragged(flat, start[order], size[order]).tobytes()
        ends = np.concatenate([[0], np.cumsum(size[order])])
        out["text"] = pa.array([raw[ends[a] : ends[b]] for a, b in zip(edges, edges[1:])], pa.binary())  # noqa: RUF007
    return pa.RecordBatch.from_arrays(list(out.values()), list(out))


def _by_bucket(batches, names: list[str], kinds: list[type]):
    """The columns of each bucket; the rows of a partition come sorted by bucket."""
    key, held = None, []

    def whole():
        out = []
        for i, kind in enumerate(kinds):
            out.append(np.frombuffer(b"".join(r[i] for r in held), kind))
        return out

    for batch in batches:
        keys = batch.column(0).to_pylist()
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        for i, k in enumerate(keys):
            if k != key:
                if held:
                    yield whole()
                key, held = k, []
            held.append([c[i].as_py() for c in columns])
    if held:
        yield whole()


def _repeating(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """doc_id, place of all anchors whose hash occurs more than once."""
    names, kinds = ["hash", "doc", "at", "known"], [np.uint64, np.int64, np.int64, np.uint8]

    def find(batches):
        sent = np.zeros(0, U64)  # hashes, in order, that this task has shown to repeat
        for batch, data, ends in _texts(batches):
            h, at, _, _ = anchors(data, ends)
            text = np.searchsorted(ends, at, "right")
            doc = np.asarray(batch.column(0))[text] if len(at) else np.zeros(0, np.int64)
            each, first, of, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            shown = sent[np.minimum(np.searchsorted(sent, each), len(sent) - 1)] == each if len(sent) else np.zeros(len(each), bool)
            known = np.where((times > 1) | shown, 1, 0).astype(np.uint8)[of]  # 1: repeats, needs no bucket; 2: repeats, and shows others
            new = (times > 1) & ~shown
            known[first[new]] = 2
            sent = np.sort(np.concatenate([sent, each[new][: REMEMBERED - len(sent)]]))
            bucket = np.where(known == 1, mix(h + at.astype(U64)), h) % U64(buckets)
            yield _dealt(bucket.astype(np.int64), [h, doc.astype(np.int64), at - np.concatenate([[0], ends])[text], known], names)

    def check(batches):
        for h, doc, at, known in _by_bucket(batches, names, kinds):
            _, of, times = np.unique(np.where(known == 1, mix(h) ^ U64(1), h), return_inverse=True, return_counts=True)
            keep = (known > 0) | (times[of] > 1)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[keep].astype(np.int32))], ["doc_id", "at"])

    dealt = docs.mapInArrow(find, "bucket long, hash binary, doc binary, at binary, known binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(check, "doc_id long, at int")


@cache
def difference_cover(v: int = COVER) -> tuple[int, ...]:
    """Residues such that any two positions reach two of them by one step below v: the greedy choice."""
    cover, left = [0], set(range(1, v))
    while left:
        gain = lambda c: len(left & {(c - d) % v for d in cover} | left & {(d - c) % v for d in cover})
        best = max((c for c in range(v) if c not in cover), key=gain)
        left -= {(best - d) % v for d in cover} | {(d - best) % v for d in cover}
        cover.append(best)
    return tuple(sorted(cover))


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes at each place, as a number in their order; data ends with seven bytes to spare."""
    w = np.zeros(len(data) - 7, U64)
    for j in range(8):
        w = (w << U64(8)) | data[j : len(w) + j]
    return w


def cover_ranks(w: np.ndarray, n: int, depth: int, v: int = COVER) -> np.ndarray:
    """Ranks by at least `depth` bytes of the places below n in the difference cover; other places have 0."""
    sample = np.flatnonzero(np.isin(np.arange(n) % v, difference_cover(v)))
    rank = np.zeros(n + 4 * depth, np.int64)
    order = np.lexsort([w[np.minimum(sample + 8 * i, len(w) - 1)] for i in reversed(range(v // 8))])
    s = sample[order]
    new = np.zeros(len(s), bool)
    for i in range(v // 8):
        x = w[np.minimum(s + 8 * i, len(w) - 1)]
        new[1:] |= x[1:] != x[:-1]
    rank[s] = np.cumsum(new) + 1
    length = v
    while length < depth:  # a place and the one `length` further on are both in the cover
        _, of = np.unique((rank[sample] << 32) | rank[sample + length], return_inverse=True)
        rank[sample] = of + 1
        length *= 2
    return rank


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int = LENGTH, v: int = COVER) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at `at`, and which of them equals its predecessor in it over `depth` bytes.

    Suffixes of one residue modulo v that tie over v bytes are in order of the next v + depth bytes; suffixes of
    different residues are in order of their first v bytes only. data has depth + 4 * v bytes to spare at its end.
    """
    w = words(data)
    rank = cover_ranks(w, len(data) - 7 - v, depth, v)
    cover = difference_cover(v)
    step = np.array([min((c - r) % v for c in cover) for r in range(v)])[at % v]
    order = np.lexsort([rank[at + step], at % v, *(w[at + 8 * i] for i in reversed(range(v // 8)))])
    s = at[order]
    same = np.ones(len(s), bool)
    same[:1] = False
    for i in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        x = w[s + i]
        same[1:] &= x[1:] == x[:-1]
    return order, same


def repeated_windows(doc: np.ndarray, at: np.ndarray, before: np.ndarray, n: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, end) of the runs of removed windows of a bucket's contexts.

    A context is n windows long and starts `before` bytes ahead of its anchor, which is at place `at` of its document.
    """
    size = n + LENGTH - 1
    # Anchors stand at multiples of COVER, so equal windows start at equal residues.
    slot = -(-(before + size + COVER) // COVER) * COVER
    base = np.cumsum(slot) - slot
    start = base + (-before) % COVER
    data = np.zeros(int(slot.sum()) + LENGTH + 5 * COVER + 8, np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(start, size) + inner] = text
    of = np.repeat(np.arange(len(n)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    order, same = suffix_order(data, start[of] + offset)
    # Equal windows have equal distances from their anchors, so the order of (document, anchor) is that of their starts.
    turn = np.lexsort((at, doc))
    rank = np.zeros(len(n), np.int64)
    rank[turn] = np.cumsum(np.concatenate([[0], (np.diff(doc[turn]) != 0) | (np.diff(at[turn]) != 0)]))
    heads = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(rank[of[order]], heads), np.diff(np.append(heads, len(order))))
    gone = np.zeros(len(of), bool)
    gone[order] = rank[of[order]] != least
    edge = np.concatenate([[True], of[1:] != of[:-1]])
    first = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    last = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]]))
    origin = at[of[first]] - before[of[first]]
    return doc[of[first]], origin + offset[first], origin + offset[last] + LENGTH


def settled(raw: bytes, start: np.ndarray, size: np.ndarray, before: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which contexts are equal in full, anchor and all, to one that stands earlier: all their windows are removed."""
    import xxhash

    whole = np.array([xxhash.xxh3_64_intdigest(raw[a : a + s]) for a, s in zip(start.tolist(), size.tolist(), strict=True)], U64)
    order = np.lexsort((at, doc, before, size, whole))
    same = np.zeros(len(order), bool)
    same[1:] = True
    for x in (whole, size, before):
        y = x[order]
        same[1:] &= y[1:] == y[:-1]
    done, first = np.zeros(len(order), bool), -1
    order_, flags = order.tolist(), same.tolist()
    for i, k in enumerate(order_):
        if not flags[i]:
            first = k
            continue
        a, b, s = int(start[first]), int(start[k]), int(size[k])
        if raw[a : a + s] != raw[b : b + s]:  # the hash is not trusted to remove text
            first = k
        elif (doc[first], at[first]) != (doc[k], at[k]):
            done[k] = True
    return done


class _Sent(dict):
    """The earliest place of each context that a task has sent, by its bytes and where its anchor stands in it."""

    def later(self, raw: bytes, start: np.ndarray, size: np.ndarray, before: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which contexts are equal in full to one that was sent and stands earlier; the others are remembered."""
        out = np.zeros(len(start), bool)
        for i, (a, s, b, place) in enumerate(zip(start.tolist(), size.tolist(), before.tolist(), zip(doc.tolist(), at.tolist(), strict=True), strict=True)):
            key = (raw[a : a + s], b)
            found = self.get(key)
            if found is not None and found < place:
                out[i] = True
            elif found is not None or len(self) < REMEMBERED:
                self[key] = place
        return out


def _removed(docs: DataFrame, repeating: DataFrame, buckets: int, parts: int) -> DataFrame:
    """doc_id, a, b: the removed runs, which may overlap."""
    names, kinds = ["doc", "at", "before", "n", "done"], [np.int64, np.int64, np.int64, np.int64, np.uint8]

    def contexts(batches):
        sent = _Sent()
        for batch, data, ends in _texts(batches):
            h, at, low, high = anchors(data, ends)
            text = np.searchsorted(ends, at, "right")
            starts = np.concatenate([[0], ends])[text]
            wanted = batch.column(2)
            counts = np.diff(np.asarray(wanted.offsets)) if len(wanted) else np.zeros(0, int)
            flat = np.asarray(wanted.flatten()).astype(np.int64) + np.repeat(np.concatenate([[0], ends])[:-1], counts)
            keep = np.isin(at, flat)
            h, at, low, high, text, starts = (x[keep] for x in (h, at, low, high, text, starts))
            doc = np.asarray(batch.column(0)).astype(np.int64)[text]
            size = high - low + LENGTH
            raw = data.tobytes()
            done = settled(raw, low, size, at - low, doc, at - starts)
            left = np.flatnonzero(~done)
            done[left] = sent.later(raw, low[left], size[left], (at - low)[left], doc[left], (at - starts)[left])
            done = done.astype(np.uint8)
            bucket = np.where(done == 1, mix(h + at.astype(U64)), h) % U64(buckets)
            kept = np.where(done == 1, 0, size)
            yield _dealt(bucket.astype(np.int64), [doc, at - starts, at - low, high - low + 1, done], names, (data, low, kept))

    def settle(batches):
        for doc, at, before, n, done, text in _by_bucket(batches, [*names, "text"], [*kinds, np.uint8]):
            size = np.where(done == 1, 0, n + LENGTH - 1)
            start = np.cumsum(size) - size
            d = done == 1
            open_ = np.flatnonzero(~d)
            d[open_] = settled(text.tobytes(), start[open_], size[open_], before[open_], doc[open_], at[open_])
            out = [(doc[d], (at - before)[d], (at - before + n - 1 + LENGTH)[d])]
            # A context whose anchor is now the only one of its first bytes has nothing to be equal to.
            left = np.flatnonzero(~d)
            if len(left):
                key = words(text)[start[left] + before[left]]
                _, of, times = np.unique(key, return_inverse=True, return_counts=True)
                left = left[times[of] > 1]
            if len(left):
                out.append(repeated_windows(doc[left], at[left], before[left], n[left], ragged(text, start[left], size[left])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "a", "b"])

    places = repeating.groupBy("doc_id").agg(F.collect_list("at").alias("places"))
    joined = docs.join(places, "doc_id").select("doc_id", "text", "places")
    dealt = joined.mapInArrow(contexts, "bucket long, doc binary, at binary, before binary, n binary, done binary, text binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(settle, "doc_id long, a long, b long")


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [a, b); runs that touch are one."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def _numbered(own: DataFrame) -> DataFrame:
    """suffix_dedup where rows share ids: each row gets a number of its own, in the order of doc_id and of its text's hash."""
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = own.withColumn("h", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(parts, "doc_id", "h", "tie").sortWithinPartitions("doc_id", "h", "tie")
    # Partitions are ranges in order, so these numbers are, too.
    rows = written(ordered.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    found = suffix_dedup(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    return rows.select("row", "doc_id").join(found, "row").drop("row")


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept binary, spans array<struct<a,b>>: the bytes that stay, and the maximal removed runs."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    if own.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        return _numbered(own)
    total = own.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    repeating = written(_repeating(own, max(4 * parts, -(-total // BUCKET_BYTES)), parts), "anchors")
    contexts = repeating.count() * (LENGTH + WINDOW // 2)
    removed = written(_removed(own, repeating, max(4 * parts, -(-contexts // CONTEXT_BYTES)), parts), "removed")

    def keep(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            kept, spans = [], []
            for t, runs in zip(texts, batch.column(2), strict=True):
                pairs = runs.values
                a, b = united(pairs.field(0).to_numpy(), np.minimum(pairs.field(1).to_numpy(), len(t))) if runs.is_valid else ([], [])
                spans.append([{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *b], [*a, len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], ["doc_id", "n_bytes", "kept", "spans"])

    runs = removed.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    return own.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(keep, "doc_id long, n_bytes long, kept binary, spans array<struct<a:long,b:long>>")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, bytes]:
    """The kept bytes of each document, by a set of all strings seen so far. For tests."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        t = texts[i]
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            x = hashlib.blake2b(t[s : s + length], digest_size=16).digest()
            if x in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(x)
        out[i] = bytes(c for c, g in zip(t, gone, strict=True) if not g)
    return out
