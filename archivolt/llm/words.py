"""Vectorised words: hashes of lower-cased words of a whole batch at once.

A word is a run of ASCII letters, digits, underscores and any characters beyond ASCII.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_R = 0x9E3779B97F4A7C15
_R_INVERSE = pow(_R, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    _WORD[_c] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n; kept for the next batch."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_R, _R_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ np.uint64((seed * _R + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in order, and its row. Null texts have no words."""
    texts = pc.utf8_lower(pc.fill_null(column, "")).cast(pa.large_string())
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or not len(texts) or edges[-1] == edges[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    word = _WORD[raw]
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    inner = edges[1:-1]
    before[inner[inner < len(raw)]] = False
    after[inner[inner > 0] - 1] = False
    begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    up, down = _power(len(raw))
    sums = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)
    low = np.where(begin > 0, sums[np.maximum(begin, 1) - 1], np.uint64(0))
    hashes = mix((sums[end] - low) * down[begin])
    return hashes, np.searchsorted(edges, begin, side="right") - 1


def shingles(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The set of word shingles of each row: (hashes, rows), sorted by row and hash, and the number per row.

    A text with fewer words than the width has one shingle, all its words; a text without words has none.
    """
    h, row = word_hashes(column)
    n = len(column)
    words = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    parts, rows = [], []
    if len(h) >= width:
        x = np.zeros(len(h) - width + 1, np.uint64)
        for i in range(width):
            x = mix(x ^ h[i : len(h) - width + 1 + i], i + 1)
        inside = row[: len(x)] == row[width - 1 :]
        parts.append(x[inside])
        rows.append(row[: len(x)][inside])
    for r in np.flatnonzero((words > 0) & (words < width)):
        x = np.zeros(1, np.uint64)
        for i in range(words[r]):
            x = mix(x ^ h[first[r] + i : first[r] + i + 1], i + 1)
        parts.append(x)
        rows.append(np.array([r]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(n, np.int64)
    x, r = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((x, r))
    x, r = x[order], r[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (r[1:] != r[:-1])])
    x, r = x[new], r[new]
    return x, r, np.bincount(r, minlength=n)
