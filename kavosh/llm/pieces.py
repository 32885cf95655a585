"""Pre-tokens to symbol ids, with a bounded cache of the pieces met so far; everything is gathered from flat arrays."""

from __future__ import annotations

from functools import cache

import numpy as np

from . import merges
from .common import CACHE_ENTRIES


def ragged(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The runs flat[start:start+count], laid end to end."""
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]


class PieceIds:
    """ids of pieces by a vocabulary. Emptied when it holds more than `limit` pieces, so its memory is bounded."""

    def __init__(self, vocabulary: merges.Vocabulary, limit: int = CACHE_ENTRIES):
        self.vocabulary, self.limit = vocabulary, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def find(self, pieces: list[str]) -> np.ndarray:
        """The index of each piece in start and count; pieces that are new are merged together first."""
        if len(self.index) > self.limit:
            self.clear()
        if new := list(set(pieces).difference(self.index)):
            ids, count = self.vocabulary.encode_strings(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.flat, self.count = np.concatenate([self.flat, ids.astype(np.int32)]), np.concatenate([self.count, count])
        return np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))

    def counts(self, pieces: list[str]) -> np.ndarray:
        at = self.find(pieces)
        return self.count[at]

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces laid end to end, and how many each piece has."""
        at = self.find(pieces)
        return ragged(self.flat, self.start[at], self.count[at]), self.count[at]


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of the given sizes, which may be 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


@cache
def of_json(path: str) -> PieceIds:
    return PieceIds(merges.from_json(path))


@cache
def of_ranks(path: str) -> PieceIds:
    return PieceIds(merges.from_ranks(path))
