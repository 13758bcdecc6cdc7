"""Vectorised hashing of words and word windows over Arrow string columns.

A batch of texts is cut into slices of a few megabytes; every step below is a
numpy pass over the bytes or words of a slice, so memory stays bounded by the
slice and by the longest single text.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word hash is a
polynomial over random byte values, mixed to 64 bits; the hash of a window is a
polynomial over the word hashes. Both depend only on content, never on position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser; a seed gives another permutation."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(256, dtype=np.uint64), 77)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, kept for the longest slice so far."""

    def __init__(self) -> None:
        self.n, self.up, self.down = 0, None, None

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
            self.n = n
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Words:
    """Word hashes of consecutive rows; ``first`` has the start of each row and the end of the last."""

    hashes: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def rows(self) -> int:
        return len(self.first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows()), self.counts())


def text_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number of the first row, bytes and row offsets of slices of whole rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of the rows that ``offsets`` cuts ``data`` into."""
    n, rows = len(data), len(offsets) - 1
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(np.empty(0, np.uint64), np.zeros(rows + 1, np.int64), none, none, data)
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins, stops = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:n]
    stops[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _POWERS.of(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(hashes, np.searchsorted(starts, offsets).astype(np.int64), starts, ends, data)


def window_hashes(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and whether they lie in one row."""
    h, n = words.hashes, len(words.hashes)
    out = np.zeros(n, np.uint64)
    inside = np.zeros(n, dtype=bool)
    if n >= width:
        h = mix(h, seed) if seed else h
        m = n - width + 1
        total = np.zeros(m, np.uint64)
        for k in range(width):
            total *= np.uint64(_BASE)
            total += h[k:k + m]
        out[:m] = mix(total, seed + 1)
        last = np.repeat(words.first[1:], words.counts())
        inside[:m] = np.arange(m) + width <= last[:m]
    return out, inside


def shingle_hashes(words: Words, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows and their row: windows, or the whole row where it has 1 to width - 1 words."""
    out, inside = window_hashes(words, width, seed)
    row_of, counts = words.row_of(), words.counts()
    parts, owners = [out[inside]], [row_of[inside]]
    for n in range(1, width):
        short = np.flatnonzero(counts == n)
        if len(short):
            whole, _ = window_hashes(words, n, seed)
            parts.append(mix(whole[words.first[short]], 1000 + n))
            owners.append(short)
    if len(parts) == 1:
        return parts[0], owners[0]
    hashes, rows = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]
