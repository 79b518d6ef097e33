"""Word and word n-gram hashes of a whole batch of texts at once, in numpy.

Words are runs of bytes other than ASCII white space (or other separators), A-Z lower-cased. A batch is
handled in slices of a few hundred kilobytes, so memory does not depend on the batch;
only a single text that is longer makes a larger slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np

SLICE_BYTES = 1 << 18  # working arrays take some 40 bytes for each byte, and a worker keeps the room
KEPT = (1 << 20) + 1  # powers that a worker keeps of a base, at most

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
# Everything in ASCII but letters and digits, so that punctuation does not belong to words.
NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next slice unless it is of one long text."""
    if base in _powers and len(_powers[base]) >= n:
        return _powers[base][:n]
    row = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
    row[0] = 1
    row = np.cumprod(row, dtype=np.uint64)
    if n <= KEPT:
        _powers[base] = row
    return row[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of consecutive texts: hash, text number, first and past-last byte of each."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int, separators: np.ndarray = SPACE):
        n = len(data)
        space = separators[data]
        begins = np.zeros(n + 1, dtype=bool)
        begins[bounds] = True
        inside = ~space
        joined = inside[1:] & inside[:-1] & ~begins[1:n]
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~joined
        ends[:-1] &= ~joined
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.count = np.diff(np.searchsorted(self.start, bounds))
        self.text = np.repeat(np.arange(len(bounds) - 1), self.count)
        self.offset = np.concatenate([[0], np.cumsum(self.count)])
        self.data, self.bounds, self.first = data, bounds, first

    @cached_property
    def _sums(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER[self.data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=total[1:])
        return total

    def span_hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        """A hash of the bytes from each start to each end."""
        total = self._sums
        return mixed((total[end] - total[start]) * _power(_INVERSE, len(self.data) + 1)[start] + np.uint64(salt))

    @cached_property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams of words and the number of the word at which each starts.

        A text of fewer than n words, but at least one, has a single gram of all of them.
        """
        m = len(self.hash)
        short = np.flatnonzero((self.count > 0) & (self.count < n))
        if m >= n:
            inside = self.text[n - 1 :] == self.text[: m - n + 1]
            at = np.flatnonzero(inside)
        else:
            at = np.zeros(0, dtype=np.int64)
        gram = np.zeros(len(at), dtype=np.uint64)
        factor = 1
        for k in range(n):
            factor = factor * _BASE % (1 << 64)
            gram += self.hash[at + k] * np.uint64(factor)
        gram = mixed(gram)
        if len(short):
            starts = self.offset[short]
            sums = np.array([self._gram_of(i) for i in short], dtype=np.uint64)
            at, gram = np.concatenate([at, starts]), np.concatenate([gram, sums])
            order = np.argsort(at, kind="stable")
            at, gram = at[order], gram[order]
        return gram, at

    def _gram_of(self, i: int) -> np.uint64:
        h = self.hash[self.offset[i] : self.offset[i + 1]]
        return mixed((h * _power(_BASE, len(h) + 1)[1:]).sum(keepdims=True) + np.uint64(len(h)))[0]


def buffers(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string array (null: empty) and the bounds of each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def byte_slices(texts, size: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts of an Arrow array in order, in slices of whole texts: bytes, bounds, first text."""
    data, bounds = buffers(texts)
    low, n = 0, len(bounds) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1)
        yield data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low], low
        low = high


def word_slices(texts, separators: np.ndarray = SPACE, size: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of the texts of an Arrow array, slice by slice."""
    for data, bounds, first in byte_slices(texts, size):
        yield Words(data, bounds, first, separators)
