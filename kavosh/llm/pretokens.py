"""The pre-tokeniser of byte-level BPE as array operations: one character class lookup, then boundary masks.

The pattern that it stands for:
's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
A boundary depends on the classes of the neighbouring characters only, so any number of texts is cut at once.
"""

from __future__ import annotations

from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, END = range(5)


@cache
def classes() -> np.ndarray:
    """The class of each code point, as the tokenizer library itself has it.

    A Unicode table of another version would cut differently at the letters that are newer or older than it. So the
    library is asked: with a pattern of one class and a vocabulary of the 256 bytes, it gives back what matches.
    """
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(asked.encode_ordinary(every)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Positions at which pre-tokens start. kind: the classes of the points; END is a text's end and stands alone."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty_like(kind)
    before[0], before[1:] = END, kind[:-1]
    blank = points == 32
    blank &= kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    space = kind == SPACE
    new = (kind != before) & (space | (kind == END) | ~after_blank)
    new[kind == END] = True
    last = space & (before == SPACE)
    last[:-1] &= (kind[1:] != SPACE) & (kind[1:] != END)
    last[-1] = False
    new |= last
    marks = np.flatnonzero((points == 39) & new & (kind == OTHER))
    if len(marks):
        one = points[np.minimum(marks + 1, n - 1)]
        two = points[np.minimum(marks + 2, n - 1)]
        ok1, ok2 = (marks + 1 < n), (marks + 2 < n)
        ok1 &= kind[np.minimum(marks + 1, n - 1)] == LETTER
        ok2 &= ok1 & (kind[np.minimum(marks + 2, n - 1)] == LETTER)
        short = ok1 & np.isin(one, [ord(c) for c in "stmd"])
        long = ok2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((marks[short], 2), (marks[long], 3)):
            new[at + 1] = False
            at = at + size
            new[at[at < n]] = True
    return np.flatnonzero(new)


def cut(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all texts, and how many each text has."""
    joined = "\n".join([*texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    kind[ends] = END
    at = starts(points, kind)
    bounds = at.tolist()
    bounds.append(len(points))
    tokens = [joined[a:b] for a, b in zip(bounds, bounds[1:])]  # noqa: RUF007
    # A text's end is a token of its own: drop it.
    index = np.searchsorted(at, ends)
    for i in index.tolist()[::-1] if len(index) < 64 else ():
        del tokens[i]
    if len(index) >= 64:
        keep = np.ones(len(tokens), bool)
        keep[index] = False
        tokens = [t for t, k in zip(tokens, keep.tolist(), strict=True) if k]
    counts = np.diff(np.concatenate([[-1], index])) - 1
    return tokens, counts


def chunk_bounds(text: str, chunk: int = 65_536, overlap: int = 256) -> np.ndarray:
    """Starts of the pre-tokens of one text, found chunk by chunk.

    Chunk i is scanned alone, over [i*chunk - overlap, (i+1)*chunk + overlap). The scan may begin inside a
    pre-token, so its first boundaries can be false; from any boundary that it shares with the true sequence on, both
    are the same. Chunk i takes over at the first boundary at or after i*chunk that the scans of chunks i-1 and i
    share in their overlap. Where they share none (a pre-token longer than the overlap), the previous scan goes on
    through as many more chunks as it takes to meet the next one.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    table = classes()

    def scan(a: int, b: int) -> np.ndarray:
        kind = table[points[a:b]]
        return starts(points[a:b], kind) + a

    edges = list(range(0, n, chunk)) or [0]
    scans = [scan(max(0, a - overlap), min(n, a + chunk + overlap)) for a in edges]
    found, true, end = [], scans[0], min(n, chunk + overlap)
    for i, a in enumerate(edges[1:], 1):
        own, own_end = scans[i], min(n, a + chunk + overlap)
        # The last three points before a scan's end can look like boundaries for want of what follows.
        shared = np.intersect1d(true[(true >= a) & (true < (end if end == n else end - 3))], own, assume_unique=True)
        if len(shared):
            found.append(true[true < shared[0]])
            true, end = own[own >= shared[0]], own_end
        else:
            since = true[true < a][-1] if (true < a).any() else 0
            found.append(true[true < since])
            true, end = scan(int(since), own_end), own_end
    found.append(true)
    return np.concatenate(found)
