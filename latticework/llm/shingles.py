"""Words and word shingles of a batch of texts as flat numpy arrays, straight from an Arrow string buffer.

No Python string is made per word. A word's hash takes its bytes eight at a time and mixes after each eight, so that no two words
are equal by the algebra of a polynomial; a word of more than `LONG` bytes has a BLAKE2 digest. A shingle's hash combines the
hashes of its words with odd factors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTORS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(64)], np.uint64)
#: Words of more bytes than this are hashed one by one.
LONG = 256
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        full = np.full(max(n, 1 << 20), base, np.uint64)
        full[0] = 1
        _powers[name] = np.cumprod(full)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slices(batch: pa.RecordBatch, column: int, limit: int = 1 << 20):
    """Parts of a batch of about so many bytes of text, one row at least: the arrays below take some 60 times the bytes of a part."""
    texts = batch.column(column).cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        stop = min(stop, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; a null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return (offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)), raw


def _hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    size = end - begin
    out = mix(size.astype(np.uint64) + _B)
    held = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray((len(raw) + 1,), "<u8", held, 0, (1,))  # the eight bytes from each place on
    who, at = np.flatnonzero(size <= LONG), 0
    while len(who):
        left = size[who] - at
        x = eight[begin[who] + at]
        part = left < 8
        x[part] &= (np.uint64(1) << (left[part] * 8).astype(np.uint64)) - np.uint64(1)
        out[who] = mix((out[who] ^ x) * _B + np.uint64(at))
        at += 8
        who = who[left > 8]
    for k in np.flatnonzero(size > LONG):
        out[k] = np.frombuffer(hashlib.blake2b(raw[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "<u8")[0]
    return out


def words(texts: pa.Array, folded: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word of each text (len + 1 entries), then per word its hash and its byte range within the batch.

    A word is a run of bytes other than white space [\\x20\\x09-\\x0D]. folded: a run of letters and digits, in which
    ASCII and Latin-1 capitals count as small letters.
    """
    offsets, raw = _buffers(texts)
    if folded:
        raw = raw.copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        latin = np.zeros(len(raw), bool)
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw[latin] += 32
        inside = ((raw >= 97) & (raw <= 122)) | ((raw >= 48) & (raw <= 57)) | (raw >= 128)
    else:
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    n = len(raw)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]  # texts lie side by side
    ends[edges - 1] = inside[edges - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    hashes = _hashes(raw, a, b)
    return np.searchsorted(a, offsets), hashes, a, b


def shingles(first: np.ndarray, hashes: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """First shingle of each text (len + 1 entries) and the shingles in text order; a text of 1 to n - 1 words has one of all its words."""
    count = np.diff(first)
    many = np.maximum(count - n + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(many, out=begin[1:])
    # all runs of n words, then those that begin early enough in their text
    runs = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for k in range(n):
        runs += hashes[k : k + len(runs)] * _FACTORS[k]
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], many)
    out = runs[np.minimum(at, max(len(runs) - 1, 0))] if len(runs) else np.zeros(len(at), np.uint64)
    for t in np.flatnonzero((count > 0) & (count < n)):
        out[begin[t]] = (hashes[first[t] : first[t + 1]] * _FACTORS[: count[t]]).sum()
    return begin, mix(out)
