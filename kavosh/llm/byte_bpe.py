"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts longer than one chunk are pre-tokenised chunk by chunk and stitched where the boundaries of neighbouring chunks
resynchronise (pretokens.chunk_bounds); the pieces are then encoded by rank, each alone. Decoding concatenates the raw
bytes of the ids. A null text is taken as empty: no ids, no bytes. Repeated rows are encoded each; an empty table gives
no rows. `encode` keeps all columns of its input and replaces columns named like its own.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import merges, pieces, pretokens
from .common import steps

CHUNK, OVERLAP = 65_536, 256


@cache
def _bytes_of(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens = merges.token_bytes(path)
    count = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(count) - count, count


def encode_texts(texts: list[str], path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts laid end to end, and how many each text has."""
    short = [t if len(t) <= chunk else "" for t in texts]
    tokens, sizes = pretokens.cut(short)
    if any(len(t) > chunk for t in texts):
        out, at = [], 0
        for i, (t, n) in enumerate(zip(texts, sizes.tolist(), strict=True)):
            if len(t) > chunk:
                b = [*pretokens.chunk_bounds(t, chunk, overlap).tolist(), len(t)]
                out += [t[x:y] for x, y in zip(b, b[1:])]  # noqa: RUF007
                sizes[i] = len(b) - 1
            else:
                out += tokens[at : at + n]
            at += n
        tokens = out
    ids, count = pieces.of_ranks(path).ids(tokens)
    return ids, pieces.sums(count, sizes)


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[bytes]:
    """The bytes of each of the id lists, which are laid end to end."""
    flat, start, size = _bytes_of(path)
    raw = pieces.ragged(flat, start[ids], size[ids]).tobytes()
    ends = np.cumsum(pieces.sums(size[ids], counts)).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs with `ids array<int>`, and with `decoded binary` too if asked for. Narrow: no shuffle."""
    own = [("ids", T.ArrayType(T.IntegerType())), *([("decoded", T.BinaryType())] if decoded else [])]
    kept = docs.drop(*(n for n, _ in own))
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, t) for n, t in own)])

    def kernel(batches):
        for batch, texts in steps(batches, text):
            ids, counts = encode_texts(texts, path)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            new = [pa.ListArray.from_arrays(offsets, pa.array(ids))]
            if decoded:
                new.append(pa.array(decode_ids(ids, counts, path), pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *(n for n, _ in own)])

    return kept.mapInArrow(kernel, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """rows with `decoded binary`: the bytes of the ids. A null list gives no bytes; an id outside the vocabulary fails."""
    kept = rows.drop("decoded")
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())])

    def kernel(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            flat = np.asarray(lists.flatten()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decode_ids(flat, counts, path), pa.binary())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(kernel, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows with decoded bytes."""
    return encoded.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
