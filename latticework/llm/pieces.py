"""Splitting of a batch of texts into a tokenizer's pieces, and a table of pieces already encoded, in flat numpy arrays.

No Python object is made per piece: a batch is one array of code points, a piece is a range of it, and its table row is
found by a 64-bit hash and then compared, character by character, with what the table holds (pieces of at most `SHORT` characters).
"""

from __future__ import annotations

import numpy as np
import regex

from . import shingles as S

SPACE, LETTER, NUMBER, OTHER, HARD = range(5)
#: Longest piece that is kept in a table.
SHORT = 256
#: Characters on which all Unicode versions agree, composed, with one-character small letters.
PLAIN = r"[\t\n\r\x20-\x7E¡-¬®-ÿĀ-įĲ-ňŊ-žΑ-ΡΤ-ρσ-ωА-я‐-‧‰-⁞€一-龥]"
_APOSTROPHE, _BLANK = 39, 32


def _classes() -> np.ndarray:
    """Class of every character of the first plane, HARD for those that are not plain."""
    plane = "".join(chr(c) for c in range(0xD800)) + "" * 0x2800
    out = np.full(1 << 16, HARD, np.uint8)
    for pattern, kind in ((r"[^\s\p{L}\p{N}]", OTHER), (r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
        at = [m.start() for m in regex.finditer(f"(?={PLAIN}){pattern}", plane)]
        out[at] = kind
    return out


_class_table: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _class_table:
        _class_table.append(_classes())
    return _class_table[0]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def classes_of(codes: np.ndarray) -> np.ndarray:
    return class_table()[np.minimum(codes, 0xFFFF)]


def split(codes: np.ndarray, kinds: np.ndarray, edges: np.ndarray, word: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pieces. edges: where units begin (0 first); a unit is split as if it stood alone.

    word: contractions, runs of letters, single numbers, runs of other characters; white space is no piece.
    Otherwise: contractions and runs with the blank before them; white space but for its last character before a run.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.ones(n + 1, bool)
    begin[1:n] = kinds[1:] != kinds[:-1]
    edges = edges[edges < n]
    begin[edges] = True
    if word:
        begin[:n] |= kinds == NUMBER
    else:
        # a run after white space: the last character of that white space begins a piece, with the run if it is a blank
        run = np.flatnonzero(begin[1:n] & (kinds[1:] != SPACE) & (kinds[:-1] == SPACE)) + 1
        at_edge = np.zeros(n + 1, bool)
        at_edge[edges] = True
        run = run[~at_edge[run]]
        begin[run - 1] = True
        begin[run[codes[run - 1] == _BLANK]] = False
    quote = np.flatnonzero((codes == _APOSTROPHE) & begin[:n])
    quote = quote[quote < n - 1]
    if len(quote):
        quote = quote[begin[quote + 1]]
        if not len(edges) == 1:
            inner = np.zeros(n + 1, bool)
            inner[edges] = True
            quote = quote[~inner[quote + 1]]
        else:
            inner = None
        one = codes[quote + 1]
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        third = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & (True if inner is None else ~inner[third]), codes[third], 0)
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for own, size in ((quote[short], 2), (quote[long], 3)):
            begin[own + 1] = False
            begin[own + size] = True
    starts = np.flatnonzero(begin[:n])
    ends = np.append(starts[1:], n)
    if word:
        solid = kinds[starts] != SPACE
        starts, ends = starts[solid], ends[solid]
    return starts, ends


def hashes_of(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, never 0."""
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * S._power("b", S._B, n), out=sums[1:])
    h = S.mix((sums[ends] - sums[starts]) * S._power("inv", S._B_INV, n)[starts] + (ends - starts).astype(np.uint64))
    return np.maximum(h, np.uint64(1))


class Table:
    """Ids of known pieces: open addressing by hash, one pool of ids."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.bits = 12
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        self.n, self.used, self.chars = 0, 0, 0
        self.start, self.count, self.pool = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)
        self.text_at, self.length, self.text = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64), np.zeros(1 << 12, np.uint32)

    def find(self, h: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Row of each piece, -1 for unknown hashes, -2 for hashes that another piece has."""
        mask, shift = (1 << self.bits) - 1, np.uint64(64 - self.bits)
        slot = (h >> shift).astype(np.int64)
        got = self.keys[slot]
        out = np.where(got == h, self.rows[slot], -1)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            got = self.keys[slot[left]]
            hit = got == h[left]
            out[left[hit]] = self.rows[slot[left[hit]]]
            left = left[~hit & (got != 0)]
        hit = np.flatnonzero(out >= 0)
        size = (end - begin)[hit]
        row = out[hit]
        wrong = self.length[row] != size
        size = np.where(wrong, 0, size)
        ends = np.cumsum(size)
        if len(ends) and ends[-1]:
            inside = np.arange(ends[-1])
            before = np.repeat(ends - size, size)
            same = codes[np.repeat(begin[hit], size) + inside - before] == self.text[np.repeat(self.text_at[row], size) + inside - before]
            if not same.all():
                wrong[np.searchsorted(ends, np.flatnonzero(~same), side="right")] = True
        out[hit[wrong]] = -2
        return out

    def _place(self, h: np.ndarray, rows: np.ndarray) -> None:
        mask, slot = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            own = free & (self.keys[slot] == h)
            self.rows[slot[own]] = rows[own]
            h, rows, slot = h[~own], rows[~own], (slot[~own] + 1) & mask

    def append(self, counts: np.ndarray, ids: np.ndarray, texts: np.ndarray | None = None, sizes: np.ndarray | None = None) -> np.ndarray:
        """Rows that no hash leads to: ids per piece, all ids; texts and sizes: all characters, and those of each."""
        texts = np.zeros(0, np.uint32) if texts is None else texts
        sizes = np.zeros(len(counts), np.int64) if sizes is None else sizes
        n, used, chars = self.n + len(counts), self.used + len(ids), self.chars + len(texts)
        for name, size, need in (("start", self.n, n), ("count", self.n, n), ("pool", self.used, used), ("text_at", self.n, n), ("length", self.n, n), ("text", self.chars, chars)):
            old = getattr(self, name)
            if need > len(old):
                new = np.zeros(max(need, 2 * len(old)), old.dtype)
                new[:size] = old[:size]
                setattr(self, name, new)
        self.start[self.n : n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : n] = counts
        self.pool[self.used : used] = ids
        self.text_at[self.n : n] = self.chars + np.cumsum(sizes) - sizes
        self.length[self.n : n] = sizes
        self.text[self.chars : chars] = texts
        rows = np.arange(self.n, n)
        self.n, self.used, self.chars = n, used, chars
        return rows

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """New pieces: distinct unknown hashes, ids per piece, all ids, and where the pieces lie."""
        size = end - begin
        at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rows = self.append(counts, ids, codes[at], size)
        n = self.n
        if 3 * n > 1 << self.bits:
            full = self.keys != 0
            old_keys, old_rows = self.keys[full], self.rows[full]
            while 3 * n > 1 << self.bits:
                self.bits += 1
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
            self._place(old_keys, old_rows)
        self._place(h, rows)

    def expand(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows one after the other, and the number of ids before each row (one more entry)."""
        counts = self.count[rows]
        ends = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(counts, out=ends[1:])
        at = np.repeat(self.start[rows] - ends[:-1], counts)
        at += np.arange(ends[-1])
        return self.pool[at], ends
