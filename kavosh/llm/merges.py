"""Byte-pair merging of many pre-tokens at once, as ragged numpy arrays."""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np

NONE = np.int64(1 << 62)


@cache
def byte_letters() -> dict[int, str]:
    """byte -> the printable letter that byte-level vocabularies write for it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Applies the lowest-ranked pair of each sequence, round by round, to all sequences at once.

    A round merges every occurrence of a sequence's lowest pair (from the left, without overlap) where no pair that a
    merge can create ranks below that merge; else only the leftmost one, which is always right.
    """

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        """pairs: (left, right) -> (rank, merged id)."""
        left, right = (np.fromiter((p[i] for p in pairs), np.int64, len(pairs)) for i in (0, 1))
        rank, new = (np.fromiter((v[i] for v in pairs.values()), np.int64, len(pairs)) for i in (0, 1))
        keys = (left << 32) | right
        order = np.argsort(keys)
        self.keys, self.rank, self.new = keys[order], rank[order], new[order]
        made: dict[int, int] = {}
        for r, n in zip(rank.tolist(), new.tolist(), strict=True):
            made[n] = max(made.get(n, -1), r)
        self.all_at_once = all(made.get(a, -1) < r and made.get(b, -1) < r for (a, b), (r, _) in pairs.items())

    def __call__(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The surviving symbols of the sequences laid end to end, and their numbers."""
        n = len(lengths)
        sym, seq = symbols.astype(np.int64), np.repeat(np.arange(n), lengths)
        done_sym, done_seq = [], []
        while len(sym):
            same = seq[1:] == seq[:-1]
            keys = (sym[:-1] << 32) | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == keys), self.rank[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            ranks = np.append(rank, NONE)  # the last symbol has no pair
            least = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.append(first, len(sym)))
            least_each = np.repeat(least, sizes)
            ended = least_each == NONE
            if ended.any():
                done_sym.append(sym[ended])
                done_seq.append(seq[ended])
            pick = (ranks == least_each) & ~ended
            where = np.flatnonzero(pick)
            if not len(where):
                break
            if self.all_at_once:
                # Within a run of neighbouring picks (a pair of equal symbols), every other one from the left.
                begins = np.concatenate([[True], np.diff(where) != 1])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
            else:
                where = where[np.concatenate([[True], seq[where[1:]] != seq[where[:-1]]])]
            sym[where] = self.new[at[where]]
            keep = ~ended
            keep[where + 1] = False
            sym, seq = sym[keep], seq[keep]
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        sym, seq = np.concatenate(done_sym), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        return sym[order], np.bincount(seq, minlength=n)


class Vocabulary:
    """A byte-level vocabulary: the first symbol of each byte, and the merger."""

    def __init__(self, merger: Merger, first: np.ndarray, last: np.ndarray | None = None):
        self.merger, self.first, self.last = merger, first, last

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        sym = self.first[raw]
        if self.last is not None and len(raw):
            ends = np.cumsum(lengths)[lengths > 0] - 1
            sym[ends] = self.last[raw[ends]]
        return self.merger(sym, lengths)

    def encode_strings(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode([p.encode("utf-8", "surrogatepass") for p in pieces])


def _ids(vocab: dict[str, int], suffix: str = "") -> np.ndarray:
    return np.array([vocab[byte_letters()[b] + suffix] for b in range(256)], np.int64)


def from_json(path: str) -> Vocabulary:
    """A BPE file of the tokenizers library, with or without an end-of-word suffix."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
    pairs = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
    return Vocabulary(Merger(pairs), _ids(vocab), _ids(vocab, end) if end else None)


def token_bytes(path: str) -> list[bytes]:
    """The tokens of a rank file by id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    out = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        out[i] = token
    return out


def from_ranks(path: str) -> Vocabulary:
    """A rank file: two neighbours merge if their bytes together are a token, lowest id first."""
    tokens = token_bytes(path)
    ranks = {t: i for i, t in enumerate(tokens) if t}
    pairs = {}
    for t, i in ranks.items():
        for k in range(1, len(t)):
            if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None:
                pairs[a, b] = (i, i)
    return Vocabulary(Merger(pairs), np.array([ranks[bytes([b])] for b in range(256)], np.int64))
