"""Adaptive context-mixing range coder for blocks of token ids.

A block starts from a reset state and is coded alone. Its ids are dealt to lanes, runs of equal length that share one model: step t
codes the t-th id of every lane in a few numpy calls and then teaches the model all of them, so no Python loop runs per id and
every lane profits from what the others have seen.

The model mixes three predictions of the next id:

* order-2: the id that followed the last two ids, with a confidence;
* order-1: the id that followed the last id, with a confidence;
* order-0: adaptive frequencies of the ids that the other two did not foresee, in the order in which the block showed them; an id
  that is new to the block has a share of one.

The mixing weights are adaptive too: for every state of the confidences, of their agreement and of what came true at the lane's last
step, the shares with which order-2, order-1 and order-0 were right. An id is range-coded as who
foresees it and, if only order-0 does, its place in the cumulated frequencies. All arithmetic is integer, so that
encoder and decoder agree everywhere.

Coded block: number of lanes (4 bytes), ids per lane (4), largest id (4), 16-bit words of each lane (4 each), the lanes' words.
"""

from __future__ import annotations

import numpy as np

MAX_ID = (1 << 20) - 1
#: Lanes of a block, at most, and the fewest ids that are worth a lane.
LANES, LEAST = 8192, 256
#: Tables of the order-2 and order-1 predictions; entries: id 20 bits, confidence 4 bits, and 8 bits of the context's hash.
_BITS2, _BITS1 = 20, 17
_SHARE_BITS = 15
#: Order-0: what each sight adds to a frequency, the total at which all are halved, and the width (a power of two) of the
#: slices by which the decoder finds an id's place.
_ADD, _FULL, _SLICE = 16, 1 << 20, 3
#: Steps between two renewals of the cumulated tables, after the first steps, which renew them every time.
_EARLY, _PAUSE = 24, 12
_U16, _U32, _MASK16, _MASK32, _LEAST_RANGE = np.uint64(16), np.uint64(32), np.uint64(0xFFFF), np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
_SHARE_SHIFT = np.uint64(_SHARE_BITS)
#: Level of a confidence of 0 to 15, for order-2 and for order-1.
_LEVEL2 = np.array([0, 1, 2, 3, 3, 4, 4, 4, 5, 5, 5, 5, 6, 6, 6, 6], np.int64) * 24
_LEVEL1 = np.array([0, 1, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3], np.int64) * 6
_STATES = 7 * 4 * 2 * 3
#: Confidence after a miss (0 to 15) and after a hit (16 to 31): a hit adds one, a miss halves it, what was not sure begins anew with 1.
_NEXT = np.array([1, 1, *[c >> 1 for c in range(2, 16)], *[min(c + 1, 15) for c in range(16)]], np.int64) << 20


class _Model:
    def __init__(self, lanes: int, largest: int):
        self.two, self.one = np.zeros(1 << _BITS2, np.uint32), np.zeros(1 << _BITS1, np.uint32)
        self.x1, self.x2, self.last = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), np.full(lanes, 2, np.int64)
        self.seen = np.full(3 * _STATES, 2, np.int64)
        # order-0: place of each id seen (-1: none yet), id and frequency of each place, ids to be placed
        self.place = np.full(largest + 1, -1, np.int64)
        self.ids, self.freq = np.zeros(largest + 1, np.int64), np.zeros(largest + 1, np.int64)
        self.n, self.fresh, self.step = 0, [], 0
        self._renew()

    def _renew(self) -> None:
        seen = self.seen.reshape(_STATES, 3)
        total = seen.sum(1)
        if total.max() > 1 << 16:
            big = total > 1 << 16
            seen[big] = (seen[big] + 1) >> 1
            total = seen.sum(1)
        # where the outcomes end, 16 bits each; every outcome keeps one share at least
        ends = np.cumsum(seen, axis=1) * ((1 << _SHARE_BITS) - 3) // total[:, None] + np.arange(1, 4)
        self.shares = (ends[:, 0] | ends[:, 1] << 16 | ends[:, 2] << 32).astype(np.uint64)
        if self.fresh:
            new = np.unique(np.concatenate(self.fresh))
            self.place[new] = np.arange(self.n, self.n + len(new))
            self.ids[self.n : self.n + len(new)], self.freq[self.n : self.n + len(new)] = new, _ADD
            self.n += len(new)
            self.fresh = []
        freq = self.freq[: self.n]
        if freq.sum() > _FULL:
            freq += 1
            freq >>= 1
        self.cum = np.zeros(self.n + 1, np.int64)
        np.cumsum(freq, out=self.cum[1:])
        self.known = int(self.cum[-1])
        self.total = np.uint64(self.known + len(self.place))
        self.slices = None

    def zero(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of ids in the order-0 frequencies."""
        at = self.place[ids]
        new = at < 0
        low = self.cum[at]  # of a new id: the end of the known ones
        return low + ids * new, np.where(new, 1, self.cum[at + 1] - low)

    def of_zero(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids at places v of the order-0 frequencies, their begins and widths."""
        if self.slices is None:  # the place in which each slice begins
            ends = (self.cum[1:] + (1 << _SLICE) - 1) >> _SLICE
            self.slices = np.cumsum(np.bincount(ends, minlength=(self.known >> _SLICE) + 2))
        new = v >= self.known
        at = self.slices[np.where(new, 0, v) >> _SLICE]
        at[new] = 0
        low, high = self.cum[at], self.cum[np.minimum(at + 1, self.n)]
        far = np.flatnonzero((high <= v) & ~new)
        while len(far):
            at[far] += 1
            low[far], high[far] = high[far], self.cum[at[far] + 1]
            far = far[high[far] <= v[far]]
        return np.where(new, v - self.known, self.ids[at]), np.where(new, v, low), np.where(new, 1, high - low)

    def predict(self, k: int) -> np.ndarray:
        """The shares of the outcomes for the first k lanes; sets the candidates."""
        x1 = self.x1[:k]
        h = x1 * 0x9E3779B1
        h += self.x2[:k] * 0x85EBCA77
        h ^= h >> 23
        h *= 0x2C1B3C6D
        h &= 0xFFFFFFFFFF
        self.at2 = h >> (40 - _BITS2)
        h &= 0xFF
        h <<= 24
        self.check = h
        self.at1 = x1 & ((1 << _BITS1) - 1)
        e2, e1 = self.two[self.at2].astype(np.int64), self.one[self.at1].astype(np.int64)
        self.p2, self.p1 = e2 & MAX_ID, e1 & MAX_ID
        e2 ^= h
        c2 = e2 >> 20
        c2 *= c2 < 16  # another context's entry
        e1 >>= 20
        self.c2, self.c1 = c2, e1
        state = (self.p2 == self.p1) * 3
        state += _LEVEL2[c2]
        state += _LEVEL1[e1]
        state += self.last[:k]
        self.state = state
        return self.shares[state]

    def foreseen(self, x: np.ndarray) -> np.ndarray:
        """0: by order-2, 1: by order-1, 2: by order-0 only."""
        s = 2 - ((x == self.p1) & (self.c1 > 0))
        s *= (x != self.p2) | (self.c2 == 0)
        return s

    def learn(self, k: int, s: np.ndarray, x: np.ndarray, new: np.ndarray) -> None:
        """What came true: s and x of every lane, and the ids that only order-0 had."""
        self.state *= 3
        self.state += s
        self.seen += np.bincount(self.state, minlength=3 * _STATES)
        at = self.place[new]
        np.add.at(self.freq, at[at >= 0], _ADD)
        self.fresh.append(new[at < 0])
        # a sure prediction outlives a miss
        c = self.c2
        e = np.where(c > 1, self.p2, x)
        e |= _NEXT[c + (self.p2 == x) * 16]
        e |= self.check
        self.two[self.at2] = e
        c = self.c1
        e = np.where(c > 1, self.p1, x)
        e |= _NEXT[c + (self.p1 == x) * 16]
        self.one[self.at1] = e
        self.x2[:k] = self.x1[:k]
        self.x1[:k] = x
        self.last[:k] = s
        self.step += 1
        if self.step < _EARLY or self.step % _PAUSE == 0:
            self._renew()


def _shape(n: int) -> tuple[int, int]:
    """Lanes of a block of n ids, and ids of a lane; the last lane may be short."""
    lanes = max(1, min(LANES, n // LEAST))
    size = -(-n // lanes)
    return -(-n // size) if n else 0, size


def encode(ids: np.ndarray) -> bytes:
    """The coded block."""
    n, largest = len(ids), int(ids.max()) if len(ids) else 0
    if largest > MAX_ID:
        raise ValueError("an id needs more than 20 bits")
    lanes, size = _shape(n)
    if not n:
        return np.zeros(3, "<u4").tobytes()
    table = np.zeros(lanes * size, np.int64)
    table[:n] = ids
    table = np.ascontiguousarray(table.reshape(lanes, size).T)
    short = size - (lanes * size - n)  # ids of the last lane
    model = _Model(lanes, largest)
    low, rng = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
    digits = np.zeros((size // 2 + 8, lanes), np.uint32)
    count = np.zeros(lanes, np.int64)

    def shift(at: np.ndarray) -> None:
        """Lanes with a small range give off a word."""
        own = low[at]
        digits[count[at], at] = own >> _U32
        count[at] += 1
        low[at] = (own & _MASK32) << _U16
        rng[at] <<= _U16

    for t in range(size):
        if t % 64 == 0 and count.max() + 2 * 64 + 8 > len(digits):  # two words a step at most
            digits = np.concatenate([digits, np.zeros((len(digits) + 256, lanes), np.uint32)])
        k = lanes if t < short else lanes - 1
        x = table[t, :k]
        shares = model.predict(k)
        s = model.foreseen(x)
        by = (s << 4).view(np.uint64)
        a = (shares << _U16 >> by) & _MASK16
        r = rng[:k] >> _SHARE_SHIFT
        low[:k] += r * a
        rng[:k] = r * ((shares >> by & _MASK16) - a)
        shift(np.flatnonzero(rng[:k] < _LEAST_RANGE))
        rest = np.flatnonzero(s == 2)
        y = x[rest]
        if len(rest):
            r = rng[rest] // model.total
            begin, width = model.zero(y)
            low[rest] += r * begin.view(np.uint64)
            r *= width.view(np.uint64)
            rng[rest] = r
            shift(rest[r < _LEAST_RANGE])
        model.learn(k, s, x, y)
    for _ in range(3):  # the rest of low
        digits[count, np.arange(lanes)] = low >> _U32
        count += 1
        low = (low & _MASK32) << _U16
    digits = digits[: count.max()]
    while (digits > 0xFFFF).any():  # carries
        over = digits >> 16
        digits &= 0xFFFF
        digits[:-1] += over[1:]
    words = digits.astype("<u2").T
    kept = np.arange(words.shape[1])[None, :] < count[:, None]
    return np.array([lanes, size, largest], "<u4").tobytes() + count.astype("<u4").tobytes() + words[kept].tobytes()


def decode(coded: bytes, n: int) -> np.ndarray:
    """The n ids of a coded block."""
    lanes, size, largest = (int(v) for v in np.frombuffer(coded, "<u4", 3))
    if not n:
        return np.zeros(0, np.uint32)
    count = np.frombuffer(coded, "<u4", lanes, 12).astype(np.int64)
    words = np.append(np.frombuffer(coded, "<u2", -1, 12 + 4 * lanes), np.zeros(4, np.uint16)).astype(np.uint64)
    if count.sum() + 4 != len(words) or not (lanes - 1) * size < n <= lanes * size:
        raise ValueError("a coded block is cut short")
    at = np.cumsum(count) - count
    code = (words[at] << _U32) | (words[at + 1] << _U16) | words[at + 2]
    at += 3
    last = len(words) - 1
    short = size - (lanes * size - n)
    model = _Model(lanes, largest)
    rng = np.full(lanes, 1 << 48, np.uint64)
    out = np.zeros((size, lanes), np.uint32)

    def shift(own: np.ndarray) -> None:
        p = at[own]
        code[own] = (code[own] << _U16) | words[np.minimum(p, last)]
        at[own] = p + 1
        rng[own] <<= _U16

    for t in range(size):
        k = lanes if t < short else lanes - 1
        shares = model.predict(k)
        r = rng[:k] >> _SHARE_SHIFT
        v = code[:k] // r
        s = (v >= (shares & _MASK16)).astype(np.int64)
        s += v >= (shares >> _U16 & _MASK16)
        by = (s << 4).view(np.uint64)
        a = (shares << _U16 >> by) & _MASK16
        code[:k] -= r * a
        rng[:k] = r * ((shares >> by & _MASK16) - a)
        shift(np.flatnonzero(rng[:k] < _LEAST_RANGE))
        x = np.where(s == 0, model.p2, model.p1)
        rest = np.flatnonzero(s == 2)
        y = rest
        if len(rest):
            r = rng[rest] // model.total
            v = np.minimum(code[rest] // r, model.total - np.uint64(1))
            y, begin, width = model.of_zero(v.view(np.int64))
            x[rest] = y
            code[rest] -= r * begin.view(np.uint64)
            r *= width.view(np.uint64)
            rng[rest] = r
            shift(rest[r < _LEAST_RANGE])
        out[t, :k] = x
        model.learn(k, s, x, y)
    return np.ascontiguousarray(out.T).ravel()[:n]
