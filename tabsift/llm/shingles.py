"""Word shingles of Arrow text as flat numpy arrays of 64-bit hashes.

Words are the runs of bytes other than space and \\x09-\\x0D, after A-Z became a-z. A word's hash is
a polynomial over its bytes, taken from prefix sums; a shingle's hash combines those of its words.
A document with fewer words than the width has one shingle of all its words; one without words has
none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import flat_bytes

_r = np.random.default_rng(20240611)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
VALUE = _r.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE = VALUE[LOWER]
BASE = int(_r.integers(1 << 61, 1 << 63)) | 5
BACK = pow(BASE, -1, 1 << 64)
MULTIPLIERS = _r.integers(1 << 61, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def _edges(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends; a word ends with its row."""
    inside = ~IS_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    tail = inside.copy()
    tail[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and the number of words up to the start of each row (one more than rows)."""
    raw, off = flat_bytes(text)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(text) + 1, np.int64)
    start, end = _edges(raw, off)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUE[raw] * _power(BASE, len(raw)), out=total[1:])
    h = mix((total[end] - total[start]) * _power(BACK, len(raw))[start])
    return h, np.searchsorted(start, off)


#: Rows and columns of a table of byte pairs: the 256 bytes, and the border of a word.
BORDER = 256
PAIRS = (BORDER + 1) ** 2


def byte_pairs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each byte its pair with the byte before it in its word (or the border), where words start and end, and
    for each word the pair of its last byte and the border. Pairs are numbers below PAIRS."""
    raw, off = flat_bytes(text)
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start, end = _edges(raw, off)
    low = LOWER[raw].astype(np.int32)
    before = np.append(BORDER, low[:-1]).astype(np.int32)
    before[start] = BORDER
    return before * (BORDER + 1) + low, start, end, low[end - 1] * (BORDER + 1) + BORDER


def shingles(text: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted within the row, and the offsets of the rows."""
    h, off = words(text)
    n_words = np.diff(off)
    rows = len(n_words)
    first = np.zeros(len(h), np.int64)  # words left in the row, from this one on
    row = np.repeat(np.arange(rows), n_words)
    first = off[1:][row] - np.arange(len(h))
    whole = np.minimum(n_words, width)[row]
    at = np.flatnonzero((first >= width) | ((np.arange(len(h)) == off[:-1][row]) & (first < width)))
    span = whole[at]
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        more = span > k
        out[more] = out[more] * MULTIPLIERS[k] + h[at[more] + k]
    out = mix(out + span.astype(np.uint64))
    counts = np.bincount(row[at], minlength=rows)
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    owner = np.repeat(np.arange(rows), counts)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    counts = np.bincount(owner[keep], minlength=rows)
    return out[keep], np.append(0, np.cumsum(counts))


def signatures(sets: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set, whatever its order."""
    total = np.zeros((2, len(sets) + 1), np.uint64)
    np.cumsum(mix(sets + np.uint64(0x9E3779B97F4A7C15)), out=total[0, 1:])
    np.cumsum(mix(sets ^ np.uint64(0xD6E8FEB86659FD93)), out=total[1, 1:])
    n = np.diff(off).astype(np.uint64)
    return tuple(mix(t[off[1:]] - t[off[:-1]] + n).view(np.int64) for t in total)
