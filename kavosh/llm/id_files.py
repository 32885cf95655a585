"""Token-ID files: ids by the tokenizers library, coded by a context-mixing range coder (id_coder) in checksummed blocks.

The library encodes; but as white space ends a word in such a vocabulary, each distinct word is encoded once and its ids
are kept (a bounded number of words a worker), so a text costs a look-up a word. Words are cut on the bytes of many texts
at once. A word of Latin letters is put in small letters and parted from the marks at its end; the file's normaliser and
pattern leave it whole then, so it goes to the library's model without those two steps.

A file is a Parquet file, so Spark's committer makes a retried task harmless and any file system will do. Its rows are
segments of whole documents: part, start (ids of the part before the segment), doc_ids, ends (of each document's ids in
the segment) and payloads, the segment's blocks. Blocks are reset and read independently; no document reaches over two
rows, so reading needs no shuffle and no order, and a lost task reads its own rows again. Parts are ranges of doc_id in
ascending order, as many as the size of the texts asks for; ids before a part are added up from the files' own columns.

Rows without a doc_id are left out; null and empty texts have the end id only. Repeated doc_ids stand next to each
other, in order of their texts. A very long text is one row of many blocks, coded a bounded number at a time. Columns
other than doc_id and text are not read, so their names cannot clash. An empty table gives files without rows. A block
whose checksum fails stops the reader with an error.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .common import shared_folder, steps
from .id_coder import BLOCK, compress, expand

LANES = 2_560  # blocks coded side by side, about: a part of usual text
WORDS = 400_000  # words whose ids a worker keeps
STEP = 4_000_000  # characters of the texts that are encoded at once
SEGMENT = 16 * BLOCK  # ids at which a segment is closed
PART_BYTES = 24 << 20  # text of a part, about
_JOINED = 1_000  # words that the library gets at once


#: A plain word: small letters of which one match of the pattern is made; none composes with another.
_PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+$"

#: Bytes of UTF-8 by kind: letters, white space, marks at a word's end that the pattern always parts from a letter before
#: them, and the first and second bytes of the letters \xc0 to \xff.
_LETTER, _SPACE, _TRAIL, _LEAD, _NEXT = range(1, 6)
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[[*range(9, 14), 32]] = _SPACE
_KIND[list(b'.,;:!?*&$%#)"')] = _TRAIL
_KIND[0xC3] = _LEAD
_KIND[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = _NEXT  # those two are signs


class _Words:
    """The ids of strings without white space by the library, a thousand strings a call; those met so far are kept.

    Emptied when it holds more than WORDS of them, so its memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has one core
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        # A special string that the library finds whatever stands around it can part words; ids tell where it stood.
        plain = [t for t in file.get("added_tokens", []) if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        self.mark, self.mark_id = (plain[-1]["content"], plain[-1]["id"]) if plain else (None, None)
        # Plain words need the model alone, if the file takes letters together; the last id of each then ends in the suffix.
        end = file["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        first = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        whole = "|[\\p{L}]+|" in first.get("pattern", {}).get("Regex", "")
        self.model = None
        self.clear()
        if end and steps == ["NFC", "Replace", "Lowercase"] and whole:
            self.model = Tokenizer(Tokenizer.from_file(path).model)
            self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(self.size, bool)
            self.last[[i for t, i in file["model"]["vocab"].items() if t.endswith(end)]] = True

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, words: pa.LargeStringArray) -> np.ndarray:
        """The index of each of some different words in start and count; those that are new are encoded first."""
        if len(self.known) > WORDS:
            self.clear()
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(at.is_null())
        index = at.fill_null(-1).to_numpy().astype(np.int64)
        if len(new):
            index[index < 0] = np.arange(len(self.known), len(self.known) + len(new))
            ids, count = self.encode(new)
            self.known = pa.concat_arrays([self.known, new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.count, count])
        return index

    def _plain(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words, and how many each has."""
        bounds = np.append(np.arange(0, len(words), _JOINED), len(words))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = [np.array(self.model.encode_batch_fast([t], add_special_tokens=False)[0].ids, np.int64) for t in joined]
        ids = np.concatenate([np.zeros(0, np.int64), *ids])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)

    def _called(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(strings, add_special_tokens=False)]

    def encode(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words laid end to end, and how many each word has."""
        if self.model is None:
            return self._marked(words.to_pylist())
        plain = pc.match_substring_regex(words, _PLAIN)
        mine, sizes = self._plain(words.filter(plain))
        rest, others = self._marked(words.filter(pc.invert(plain)).to_pylist())
        plain = plain.to_numpy(zero_copy_only=False)
        count, start = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        count[plain], count[~plain] = sizes, others
        start[plain], start[~plain] = np.cumsum(sizes) - sizes, len(mine) + np.cumsum(others) - others
        return pieces.ragged(np.concatenate([mine, rest]), start, count), count

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of any words, through all steps of the library."""
        odd = {i for i, w in enumerate(words) if self.mark is None or self.mark in w}  # these go one by one
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), _JOINED):
            part = words[i : i + _JOINED]
            here = [j for j in range(len(part)) if i + j in odd]
            own, count = np.zeros(0, np.int64), np.zeros(len(part), np.int64)
            if len(here) < len(part):
                joined = part if not here else ["" if i + j in odd else w for j, w in enumerate(part)]
                [whole] = self._called([self.mark.join([*joined, ""])])
                all_ids = np.array(whole, np.int64)
                marks = all_ids == self.mark_id
                own, count = all_ids[~marks], np.diff(np.concatenate([[-1], np.flatnonzero(marks)])) - 1
            if here:
                alone = self._called([part[j] for j in here])
                sizes = np.array([len(x) for x in alone], np.int64)
                own = np.insert(own, np.repeat((np.cumsum(count) - count)[here], sizes), [x for one in alone for x in one])
                count[here] = sizes
            ids.append(own)
            counts.append(count)
        return np.concatenate(ids), np.concatenate(counts)


# White space beyond ASCII, as the library has it.
_WIDE = re.compile(r"[\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]")


def _cut(texts: list[str]) -> tuple[np.ndarray, pa.LargeStringArray, np.ndarray]:
    """Of all words and marks of the texts the place in an array of the distinct ones, that array, and their number by text."""
    coded = [(_WIDE.sub(" ", t) if not t.isascii() else t).encode() for t in texts]
    data = np.frombuffer(bytearray(b"\n".join([*coded, b""])), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    kind = _KIND[data]
    word, letter, trail = kind != _SPACE, kind == _LETTER, kind == _TRAIL
    lead = np.flatnonzero((kind[:-1] == _LEAD) & (kind[1:] == _NEXT))
    letter[lead] = letter[lead + 1] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string()), np.zeros(len(texts), np.int64)

    def of_plain(places: np.ndarray) -> np.ndarray:
        return places[plain[np.searchsorted(starts, places, "right") - 1]]

    # A plain word has letters, then marks; other words stay whole and as they are.
    odd = word & ~letter & ~trail
    odd[1:] |= letter[1:] & trail[:-1]
    plain = letter[starts]
    plain[np.searchsorted(starts, np.flatnonzero(odd), "right") - 1] = False
    marks = trail.copy()
    marks[0] = False
    marks[1:] &= letter[:-1]
    begins[of_plain(np.flatnonzero(marks))] = True
    high = lead[data[lead + 1] < 0x9F] + 1  # second bytes of \xc0 to \xde
    data[of_plain(np.concatenate([np.flatnonzero((data >= 65) & (data <= 90)), high]))] += 32
    begun = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(word, dtype=np.int32)[begun].astype(np.int64) - 1, np.count_nonzero(word))
    found = pa.LargeStringArray.from_buffers(len(begun), pa.py_buffer(offsets), pa.py_buffer(data[word])).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary, np.diff(np.searchsorted(begun, ends), prepend=0)


@cache
def _of_words(path: str) -> _Words:
    return _Words(path)


def encode_texts(texts: list[str], path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each closed by the end id, and how many each text has."""
    own = _of_words(path)
    words, distinct, sizes = _cut(texts)
    at = own.find(distinct)
    start, count = own.start[at][words], own.count[at][words]
    per_text = pieces.sums(count, sizes)
    return np.insert(pieces.ragged(own.flat, start, count), np.cumsum(per_text), end), per_text + 1


def _rounds(blocks: list, lanes: int) -> Iterator[list]:
    """The blocks in rounds of equal size, about `lanes` each: a round of few blocks takes nearly as long as a full one."""
    each = -(-len(blocks) // max(1, -(-len(blocks) // (lanes + lanes // 8))))
    return (blocks[i : i + each] for i in range(0, len(blocks), max(1, each)))


_ROWS = "part int, start long, doc_ids array<long>, ends array<long>, payloads array<binary>"


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 2, block: int = BLOCK, lanes: int = LANES, segment: int = SEGMENT, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of docs (doc_id, text) to `path`. One shuffle: the texts, by ranges of doc_id."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    total = own.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0

    def kernel(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId(), _of_words(tokenizer).size
        begun, open_ids, doc_ids, ends = 0, [], [], []  # the segment that is filled
        waiting, blocks = [], 0  # closed segments

        def close() -> None:
            nonlocal begun, open_ids, doc_ids, ends, blocks
            ids = np.concatenate(open_ids)
            cut = [ids[i : i + block] for i in range(0, len(ids), block)]
            waiting.append((begun, doc_ids, ends, cut))
            begun, blocks = begun + len(ids), blocks + len(cut)
            open_ids, doc_ids, ends = [], [], []

        def coded() -> pa.RecordBatch:
            nonlocal waiting, blocks
            flat = [b for *_, cut in waiting for b in cut]
            payloads = [p for some in _rounds(flat, lanes) for p in compress(some, size)]
            at = np.concatenate([[0], np.cumsum([len(cut) for *_, cut in waiting])]).tolist()
            columns = [
                pa.array([part] * len(waiting), pa.int32()), pa.array([w[0] for w in waiting], pa.int64()),
                pa.array([w[1] for w in waiting], pa.list_(pa.int64())), pa.array([w[2] for w in waiting], pa.list_(pa.int64())),
                pa.array([payloads[a:b] for a, b in zip(at, at[1:])], pa.list_(pa.binary())),  # noqa: RUF007
            ]
            waiting, blocks = [], 0
            return pa.RecordBatch.from_arrays(columns, ["part", "start", "doc_ids", "ends", "payloads"])

        for batch, texts in steps(batches, limit=STEP):
            ids, counts = encode_texts(texts, tokenizer, end)
            upto = np.cumsum(counts).tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), [0, *upto], upto):  # noqa: B905
                open_ids.append(ids[a:b])
                doc_ids.append(doc_id)
                ends.append((ends[-1] if ends else 0) + b - a)
                if ends[-1] >= segment:
                    close()
                    if blocks >= lanes:
                        yield coded()
        batch = texts = None  # their memory is of use to the coder
        if doc_ids:
            close()
        if waiting:
            yield coded()

    parts = max(1, -(-total // part_bytes))
    own.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(kernel, _ROWS).write.parquet(path)


def read_back(spark, path: str, lanes: int = LANES, packed: bool = False) -> DataFrame:
    """doc_id, start, ids of all documents of the files at `path`: array<int>, or bytes of four a little-endian id."""
    rows = spark.read.schema(_ROWS).parquet(path)

    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary() if packed else pa.list_(pa.int32()))

    def opened(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        flat = [p for *_, payloads in held for p in payloads]
        blocks = iter([b for some in _rounds(flat, lanes) for b in expand(some)])
        for part, start, doc_ids, ends, payloads in held:  # a batch a segment
            ids = np.concatenate([next(blocks) for _ in payloads]).astype("<u4" if packed else np.int32)
            own = [ids[a:b].tobytes() if packed else ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905
            out = ([part] * len(own), doc_ids, [start + a for a in [0, *ends[:-1]]], own)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["part", "doc_id", "offset", "ids"])

    def kernel(batches: Iterator[pa.RecordBatch]):
        held, blocks = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                blocks += len(row[-1])
                if blocks >= lanes:
                    yield from opened(held)
                    held, blocks = [], 0
        if held:
            yield from opened(held)

    docs = rows.mapInArrow(kernel, f"part int, doc_id long, offset long, ids {'binary' if packed else 'array<int>'}")
    # One row a part, of which there is one for each PART_BYTES of text: a small sum on one task, and a small broadcast.
    sizes = rows.groupBy("part").agg(F.max(F.col("start") + F.element_at("ends", -1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back packed."""
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def folder(spark) -> str:
    import uuid

    return f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
