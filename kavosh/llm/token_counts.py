"""Token counts: rank-synchronous merging over ragged arrays, without building any token strings.

Nulls and empty texts count 0 bytes and 0 tokens. Repeated rows are counted each. An empty table gives no rows.
Columns of the input other than the id and the text are not read, so clashing names cannot arise.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces, pretokens
from .common import steps


@cache
def special_strings(path: str) -> tuple[str, ...]:
    """Special strings that the library takes as one token wherever they stand in a text."""
    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f).get("added_tokens", []) if t.get("special"))


def split_special(text: str, special: tuple[str, ...]) -> tuple[list[str], int]:
    """The parts of a text between special strings, and the number of those."""
    if not any(s in text for s in special):
        return [text], 0
    import re

    parts = re.split("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text)
    return parts, len(parts) - 1


def count_texts(texts: list[str], path: str) -> np.ndarray:
    special, parts, of, extra = special_strings(path), [], [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        p, n = split_special(t, special)
        parts += p
        of += [i] * len(p)
        extra[i] = n
    tokens, sizes = pretokens.cut(parts)
    per_part = pieces.sums(pieces.of_json(path).counts(tokens), sizes)
    return extra + np.bincount(np.array(of, np.int64), per_part, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row. Narrow: no shuffle; memory is bounded by one batch."""

    def kernel(batches):
        for batch, texts in steps(batches):
            n = count_texts(texts, path)
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n)], ["doc_id", "n_bytes", "n_tokens"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(kernel, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
