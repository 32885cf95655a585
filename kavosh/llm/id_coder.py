"""A context-mixing range coder for token ids, many blocks side by side as the lanes of numpy arrays.

For each id three models speak. Order 2 and order 1 keep, for the two ids before it and for the one before it, the id
that last followed, and how far it may be trusted: an adaptive probability for each confidence and for whether the two
agree. Order 0 is the block's own history: an id's share is its count. The probability that order 2's id comes next, and
that order 1's does if order 2's doesn't, are logistic mixtures of both models' opinions, with weights that learn from
every id of the block; what is left goes to order 0 and, by an adaptive probability, to ids that its table doesn't have,
which are coded uniformly. So an id's interval of the range coder is cut out of the mixture of all three.

Guesses follow every id. Probabilities, weights and the order-0 table (a sorted copy of the history, so a place in it is an
id) are made again each time the block has grown by a quarter, from all ids since: within such an epoch both guesses'
confidences name a cell, whose shares are looked up. So the coder knows all shares of many steps before it cuts
intervals, and the decoder mixes once an epoch, not once an id. All arithmetic is in integers (the decoder's in doubles
that hold integers below 2**53, where quotients of such sizes round down right), so a block reads the same on any machine.

A payload, all little-endian: magic b"KVID", version u32, ids in the block u32, alphabet u32, crc32 of the
ids (as u32) u32, then 16-bit words. Every block starts from the same state; a block whose checksum fails is an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

I64, I32 = np.int64, np.int32
MAGIC, VERSION, HEAD = b"KVID", 3, struct.Struct("<4sIIII")
BLOCK = 4_096  # ids of a block; at most 65,535
SLOT_BITS = 11
SHARES = 28  # an id's interval is cut out of 2**SHARES
LOW, TOP = (1 << 32) - 1, 1 << 32  # the coder's numbers have 48 bits
_BITS = 2  # of a confidence
_MOST = (1 << _BITS) - 1
_CELLS = 2 << 2 * _BITS  # order 2's confidence, order 1's, whether they agree
_GROUP = 128  # blocks whose ids are sorted or turned at once, for the cache
_STEPS = 32  # ids of a lane that the coder looks up at once

_X = np.arange(-2047, 2048)
#: Probability (12 bits) of a logit in 256ths, and back. Its upper bound leaves every id of order 0 a share.
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-_X / 256))), 1, 3900).astype(I32)
_P = np.arange(4096)
STRETCH = np.clip(np.round(256 * np.log((_P + 0.5) / (4096 - _P - 0.5))), -2047, 2047).astype(I32)
#: First probabilities that a guess is right, by its confidence; they weigh as much as 4 ids.
_FIRST = np.array([0.02, 0.12, 0.45, 0.75])


def _table_sizes(length: int) -> list[int]:
    """How much of a block the order-0 table holds, one size after the other."""
    sizes, at = [], 16
    while at < length:
        sizes.append(at)
        at += max(16, at // 4)
    return sizes


class _Mixer:
    """Orders 2 and 1 (rows 0 and 1 of all arrays) and their mixture, for n blocks."""

    def __init__(self, n: int):
        self.n = n
        self.base = np.arange(2 * n).reshape(2, n) << SLOT_BITS
        self.slots = np.zeros(2 * n << SLOT_BITS, I32)  # id << _BITS | confidence
        self.cells = np.arange(n) * _CELLS
        self.met = np.zeros((n * _CELLS, 4), I64)  # ids by lane and cell, and by whether order 2 and order 1 were right
        self.tried = np.full((2, n, _MOST + 1, 2), 64, I64)  # ids by order, lane, confidence and agreement, in 16ths
        self.right = np.broadcast_to((_FIRST * 64).astype(I64)[:, None], self.tried.shape).copy()
        self.weights = np.repeat(np.array([[40_000, 20_000, 0], [8_000, 50_000, 0]], I64)[:, :, None], n, axis=2)
        self.others, self.fresh = np.full(n, 8, I64), np.full(n, 5, I64)

    def places(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slots of the ids after `one`, before which `two` stood; blocks are the last axis."""
        s = np.empty((2, *one.shape), I64)
        np.multiply(one, 40_503, out=s[1])
        np.multiply(two, 60_493, out=s[0])
        s[0] += s[1]
        s += 40_503
        s >>= 3
        s &= (1 << SLOT_BITS) - 1
        return s

    def cell(self, v: np.ndarray, agree: np.ndarray) -> np.ndarray:
        """The cell of slots' contents (orders on the first axis, blocks on the last one)."""
        c = v & _MOST
        k = c[0] << (_BITS + 1)
        k += c[1] << 1
        k += agree
        return k + self.cells[: k.shape[-1]]

    def learn(self, s: np.ndarray, v: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> None:
        """The slots s, which held v, after the ids."""
        c = v & _MOST
        new = np.where(c > 1, v - 1, ((ids << _BITS) | 1).astype(I32))
        np.copyto(new, v + (c < _MOST), where=hit)
        self.slots[s] = new

    def count(self, cell: np.ndarray, hit: np.ndarray, fresh: np.ndarray, m: int) -> None:
        """Some steps of the first m blocks (steps, blocks): their cells, hits of both orders, and which ids were new."""
        key = cell << 2
        key += hit[0].view(np.int8) << 1
        key += hit[1]
        self.met[: m * _CELLS] += np.bincount(key.ravel(), minlength=m * _CELLS * 4).reshape(-1, 4)
        self.others[:m] += 2 * (~(hit[0] | hit[1])).sum(axis=0)
        self.fresh[:m] += 2 * fresh.sum(axis=0)

    def shares(self, held: int) -> np.ndarray:
        """By lane and cell the ends of the shares of order 2's guess, of order 1's and of new ids, and a place's share."""
        n, levels = self.n, _MOST + 1
        wrong, one, two, both = np.ascontiguousarray(self.met.T).reshape(4, n, levels, levels, 2)
        met, hits = wrong + one + two + both, (two + both, one + both)
        if held > 1:
            self._adapt(met, hits[0], one)
        for i, axis in ((0, 3), (1, 2)):
            self.tried[i] += 16 * met.sum(axis=axis - 1)
            self.right[i] += 16 * hits[i].sum(axis=axis - 1)
        self.met[:] = 0
        self._mix()
        a = self.p[0] << (SHARES - 12)
        left = ((1 << SHARES) - a) >> 12
        left *= self.p[1]
        left[..., 1] = 0  # where the guesses agree
        left += a
        escape = np.clip(self.fresh * 65_536 // self.others, 1_024, 61_440)[:, None, None, None]
        new = (((1 << SHARES) - left) >> 16) * escape + left
        self.others = np.maximum(self.others >> 1, 1)
        self.fresh >>= 1
        return np.stack([a, left, new, ((1 << SHARES) - new) // held], axis=-1).reshape(n * _CELLS, 4)

    def _mix(self) -> None:
        """Probabilities (12 bits) of both orders' guesses by lane and cell."""
        q = STRETCH[np.minimum((self.right << 12) // self.tried, 4095)].astype(I64)
        shape = (self.n, _MOST + 1, _MOST + 1, 2)
        two, one = np.broadcast_to(q[0][:, :, None], shape), np.broadcast_to(q[1][:, None], shape)
        self.logits = (two, one, np.full(shape, 256, I64))
        w = self.weights[:, :, :, None, None, None]
        x = [sum(w[i, j] * st for j, st in enumerate(self.logits)) >> 16 for i in (0, 1)]
        self.p = SQUASH[np.clip(np.stack(x), -2047, 2047) + 2047].astype(I64)

    def _adapt(self, met: np.ndarray, hits: np.ndarray, second: np.ndarray) -> None:
        """The weights after the epoch: each id moves them as far as the mixture was wrong. second: order 1 was right alone."""
        miss = met - hits
        miss[..., 1] = 0
        for i, (hits, seen) in enumerate(((hits, met), (second, miss))):  # noqa: B020
            wrong = (hits << 12) - seen * self.p[i]
            for j, st in enumerate(self.logits):
                self.weights[i, j] += ((st * wrong).sum(axis=(1, 2, 3)) * 3) >> 16
        np.clip(self.weights, -200_000, 200_000, out=self.weights)


def _order(sizes: list[int]) -> np.ndarray:
    """Blocks from the longest to the shortest, so that those still running are always the first ones."""
    return np.argsort(-np.array(sizes, I64), kind="stable")


def _numbered(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each id of each block (rows) among the block's distinct ones, by step and block, and how many it has."""
    n, length = held.shape
    number, counts = np.empty((length, n), np.uint16), np.zeros(n, I64)
    if not length:
        return number, counts
    kind, bits = (np.uint32, 16) if held.dtype == np.uint16 else (I64, 32)
    places = np.arange(length, dtype=kind)
    for at in range(0, n, _GROUP):
        key = np.sort((held[at : at + _GROUP].astype(kind) << kind(bits)) | places, axis=1)
        ids = key >> kind(bits)
        new = np.zeros(key.shape, bool)
        np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
        own = np.cumsum(new, axis=1, dtype=np.uint16)
        back = np.empty(key.size, np.uint16)
        back[(key & kind((1 << bits) - 1)) + np.arange(len(key))[:, None] * length] = own
        number[:, at : at + _GROUP] = back.reshape(key.shape).T
        counts[at : at + _GROUP] = own[:, -1] + I64(1)
    return number, counts


def compress(blocks: list[np.ndarray], alphabet: int) -> list[bytes]:
    """The payloads of the blocks."""
    order = _order([len(b) for b in blocks])
    sizes = np.array([len(blocks[i]) for i in order], I64)
    if not len(sizes):
        return []
    n, length = len(sizes), int(sizes[0])
    # All ids are known here, so order 0 is looked up many steps at a time: by an id's number among its block's own.
    held = np.zeros((n, length), np.uint16 if alphabet <= 1 << 16 else I32)
    for row, i in enumerate(order):
        held[row, : sizes[row]] = blocks[i]
    truth = np.zeros((length + 2, n), held.dtype)
    for at in range(0, n, _GROUP):
        truth[2:, at : at + _GROUP] = held[at : at + _GROUP].T
    number, count = _numbered(held)
    del held
    first, distinct = np.cumsum(count) - count, int(count.sum())
    own = np.repeat(first, count)
    times, table = np.zeros(distinct, I64), np.zeros(distinct, np.uint32)  # how often an id was met; with the ids before it
    running = np.searchsorted(-sizes, -np.arange(length), "left").tolist()
    model, low, span = _Mixer(n), np.zeros(n, I64), np.full(n, (1 << 48) - 1, I64)
    out, filled = np.zeros((n, length // 2 + 512), np.uint32), np.zeros(n, I64)
    words, leaves, rows = np.zeros((8 * _STEPS, n), np.uint32), np.zeros((8 * _STEPS, n), bool), 0

    def normalise(which: np.ndarray) -> None:
        nonlocal rows
        while len(which):
            x = low[which]
            words[rows, which], leaves[rows, which] = x >> 32, True
            rows += 1
            low[which] = (x & LOW) << 16
            x = span[which] << 16
            span[which] = x
            which = which[x < TOP]

    changes, counted = [0, *_table_sizes(length), length], 0
    for begin, end in zip(changes, changes[1:]):  # noqa: RUF007
        if begin:
            # An ended block counts what stands after its end, which no one asks for.
            times = times + np.bincount((number[counted:begin] + first).ravel(), minlength=distinct)
            total = np.cumsum(times) - times
            table = (((total - total[own]) << 16) | times).astype(np.uint32)
        counted = begin
        shares = model.shares(max(1, begin))
        for at in range(begin, end, _STEPS):
            upto, m = min(end, at + _STEPS), running[at]
            seen = truth[at : upto + 2, :m].astype(I32)
            ids = seen[2:]
            s = model.places(seen[1:-1], seen[:-2])
            which = number[at:upto, :m] + first[:m]
            s += model.base[:, None, :m]
            v = np.empty(s.shape, I32)
            for step in range(upto - at):
                x = model.slots[s[:, step]]
                v[:, step] = x
                model.learn(s[:, step], x, (x >> _BITS) == ids[step], ids[step])
            guess = v >> _BITS
            hit = guess == ids
            either = hit[0] | hit[1]
            cell = model.cell(v, guess[0] == guess[1])
            a, ab, abn, place = np.moveaxis(shares.take(cell, axis=0), -1, 0)
            x = table.take(which)
            have = (x & 0xFFFF).astype(I64)
            fresh = have == 0
            fresh &= ~either
            starts = (x >> 16).astype(I64)
            starts *= place
            starts += abn
            have *= place
            for where, x, y in ((fresh, ab, abn - ab), (hit[1], a, ab - a), (hit[0], 0, a)):
                np.copyto(starts, x, where=where)
                np.copyto(have, y, where=where)
            model.count(cell, hit, fresh, m)
            rows = 0
            leaves[:] = False
            for step in range(upto - at):
                m = running[at + step]
                l, r = low[:m], span[:m]
                unit = r >> SHARES
                l += unit * starts[step, :m]
                np.multiply(unit, have[step, :m], out=r)
                need = r < TOP
                leaves[rows, :m] = need
                np.right_shift(l, 32, out=words[rows, :m], casting="unsafe")
                rows += 1
                x = l & LOW
                x <<= 16
                np.copyto(l, x, where=need)
                np.left_shift(r, need * I64(16), out=r)
                normalise(np.flatnonzero(r < TOP))
                w = np.flatnonzero(fresh[step, :m])
                if len(w):
                    unit = span[w] // alphabet
                    low[w] += unit * ids[step, w]
                    span[w] = unit
                    normalise(w[unit < TOP])
            # Words leave by lane, in the order of the steps.
            left = leaves[:rows].view(np.uint8).sum(axis=0, dtype=np.int16).astype(I64)
            if (room := int((filled + left).max()) + 8) > out.shape[1]:
                out = np.concatenate([out, np.zeros((n, room + length // 4 - out.shape[1]), np.uint32)], axis=1)
            to = np.repeat(np.arange(n) * out.shape[1] + filled - (np.cumsum(left) - left), left)
            to += np.arange(len(to))
            out.reshape(-1)[to] = words[:rows].T[leaves[:rows].T]
            filled += left
    for _ in range(3):  # the rest of `low`
        out[np.arange(n), filled] = low >> 32
        filled += 1
        low = (low & LOW) << 16
    # A word of more than 16 bits carries into the one before it.
    for i in range(int(filled.max()) - 1, 0, -1):
        out[:, i - 1] += out[:, i] >> np.uint32(16)
    result: list[bytes] = [b""] * n
    for row, i in enumerate(order):
        head = HEAD.pack(MAGIC, VERSION, int(sizes[row]), alphabet, zlib.crc32(np.asarray(blocks[i]).astype("<u4").tobytes()))
        result[i] = head + (out[row, : filled[row]] & np.uint32(0xFFFF)).astype("<u2").tobytes()
    return result


def expand(payloads: list[bytes]) -> list[np.ndarray]:
    """The ids of the payloads; a ValueError if one is damaged."""
    try:
        heads = [HEAD.unpack_from(p) for p in payloads]
        if any(h[0] != MAGIC or h[1] != VERSION for h in heads):
            raise ValueError("not a block of token ids")
        result: list = [None] * len(payloads)
        for alphabet in {h[3] for h in heads}:
            own = [i for i, h in enumerate(heads) if h[3] == alphabet]
            with np.errstate(over="ignore", invalid="ignore"):  # numbers of a damaged block can grow without end
                found = _expanded([payloads[i] for i in own], [heads[i] for i in own], alphabet)
            for i, ids in zip(own, found, strict=True):
                result[i] = ids
        return result
    except (IndexError, struct.error, MemoryError) as e:  # a damaged block can ask for words, or guess ids, that don't exist
        raise ValueError("a block of token ids is damaged") from e


def _history(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order-0 table: the run of equal ids in which each place of each block's sorted history lies, counted by block;
    the number of the block's first run among all; and of each run the id, where it begins and how long it is."""
    m, held = ids.shape
    ranks, firsts, runs, total = np.empty((m, held), np.uint16), [], [], 0
    for i in range(0, m, _GROUP):
        s = np.sort(ids[i : i + _GROUP], axis=1)
        new = np.ones(s.shape, bool)
        np.not_equal(s[:, 1:], s[:, :-1], out=new[:, 1:])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, s.size))
        np.cumsum(new, axis=1, dtype=np.uint16, out=ranks[i : i + _GROUP])
        runs.append((s.reshape(-1)[at].astype(I64) << 32) | ((at % held) << 16) | size)
        first = np.searchsorted(at, np.arange(len(s)) * held) + total
        firsts.append(first - 1)  # ranks begin at 1
        total += len(at)
    return ranks.reshape(-1), np.concatenate(firsts), np.concatenate(runs)


def _expanded(payloads: list[bytes], heads: list[tuple], alphabet: int) -> list[np.ndarray]:
    order = _order([h[2] for h in heads])
    sizes = np.array([heads[i][2] for i in order], I64)
    n, length = len(sizes), int(sizes[0])
    width = (max(len(p) for p in payloads) - HEAD.size) // 2 + 8
    if length > 240 * width:  # an id takes 0.07 bits at least
        raise ValueError("a block of token ids is damaged")
    data = np.zeros((n, width), np.uint16)
    for row, i in enumerate(order):
        w = np.frombuffer(payloads[i], "<u2", offset=HEAD.size)
        data[row, : len(w)] = w
    code = (data[:, 0] * 65_536.0 + data[:, 1]) * 65_536.0 + data[:, 2]
    flat, taken = data.reshape(-1), np.arange(n) * width + 3
    model, span = _Mixer(n), np.full(n, (1 << 48) - 1, np.float64)
    found, whole = np.zeros((_STEPS + 2, n), I32), np.zeros((n, length), np.uint16 if alphabet <= 1 << 16 else I32)
    running = np.searchsorted(-sizes, -np.arange(length), "left").tolist()

    def normalise(which: np.ndarray) -> None:
        while len(which):
            t = taken[which]
            code[which] = code[which] * 65_536 + flat[t]
            taken[which] = t + 1
            x = span[which] * 65_536
            span[which] = x
            which = which[x < TOP]

    changes, most = [0, *_table_sizes(length), length], (1 << SHARES) - 1.0
    for begin, end in zip(changes, changes[1:]):  # noqa: RUF007
        m = running[begin] if begin < length else 0
        if begin == length:  # no ids at all
            break
        held = max(1, begin)
        ranks, firsts, runs = _history(whole[:m, :begin] if begin else np.zeros((m, 1), whole.dtype))
        places = np.arange(m) * held
        shares = model.shares(held).astype(np.float64)
        for at in range(begin, end, _STEPS):
            upto, m = min(end, at + _STEPS), running[at]
            cells, hits, news = np.broadcast_to(model.cells[:m], (upto - at, m)).copy(), np.zeros((2, upto - at, m), bool), np.zeros((upto - at, m), bool)
            for step in range(at, upto):
                m = running[step]
                s = model.places(found[step - at + 1, :m], found[step - at, :m])
                s += model.base[:, :m]
                v = model.slots[s]
                guess = v >> _BITS
                cell = model.cell(v, guess[0] == guess[1])
                a, ab, abn, place = shares.take(cell, axis=0).T
                r, k = span[:m], code[:m]
                unit = r * (1 / (1 << SHARES))
                np.floor(unit, out=unit)
                u = k / unit
                np.floor(u, out=u)
                np.minimum(u, most, out=u)
                c = u - abn
                c /= place
                np.minimum(c, held - 1, out=c)
                np.maximum(c, 0, out=c)
                c = c.astype(I64)
                c += places[:m]
                packed = runs.take(firsts[:m] + ranks.take(c))
                start = ((packed >> 16) & 0xFFFF) * place
                start += abn
                size = (packed & 0xFFFF) * place
                packed >>= 32
                ids = packed.astype(I32)
                fresh, below, first = u < abn, u < ab, u < a
                abn -= ab
                np.copyto(start, ab, where=fresh)
                np.copyto(size, abn, where=fresh)
                ab -= a
                np.copyto(start, a, where=below)
                np.copyto(size, ab, where=below)
                np.copyto(ids, guess[1], where=below)
                np.copyto(start, 0, where=first)
                np.copyto(size, a, where=first)
                np.copyto(ids, guess[0], where=first)
                fresh &= ~below
                start *= unit
                k -= start
                np.multiply(unit, size, out=r)
                need = r < TOP
                t = taken[:m]
                np.copyto(k, k * 65_536 + flat[t], where=need)
                t += need
                r *= need * 65_535.0 + 1
                normalise(np.flatnonzero(r < TOP))
                w = np.flatnonzero(fresh)
                if len(w):
                    unit = np.floor(span[w] / alphabet)
                    y = np.minimum(np.floor(code[w] / unit), alphabet - 1)
                    code[w] -= unit * y
                    span[w] = unit
                    ids[w] = y
                    normalise(w[unit < TOP])
                found[step - at + 2, :m] = ids
                hit = guess == ids
                model.learn(s, v, hit, ids)
                cells[step - at, :m], hits[:, step - at, :m], news[step - at, :m] = cell, hit, fresh
            model.count(cells, hits, news, cells.shape[1])
            whole[:, at:upto] = found[2 : upto - at + 2].T
            found[:2] = found[upto - at : upto - at + 2]
    result = [np.zeros(0, np.int32)] * n
    for row, i in enumerate(order):
        result[i] = whole[row, : sizes[row]]
        if zlib.crc32(result[i].astype("<u4").tobytes()) != heads[i][4]:
            raise ValueError("a block of token ids is damaged")
    return result
