"""Whole Arrow columns of text as one byte buffer: words, 64-bit word hashes and shingles in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``; A-Z count as a-z.  All functions work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The six white-space bytes that part words.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: A run of texts makes some twenty arrays of eight bytes for each of its own.
SLICE_BYTES = 512 << 10

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = np.random.default_rng(20_240_607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** (0 .. n-1) modulo 2 ** 64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of some texts: [start, end) in ``buffer``, the text each is in, and its hash."""

    buffer: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    def count(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes; a null has none.

    A text longer than ``limit`` makes a run alone, so a run never cuts a text.
    """
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, bytes_[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    pa.default_memory_pool().release_unused()


def power(n: int) -> np.ndarray:
    return _power(_BASE, n)


def inverse_power(n: int) -> np.ndarray:
    return _power(_BASE_INVERSE, n)


def hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte runs [start, end) of a polynomial over ``values``."""
    n = len(values)
    if not len(start):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * power(n), out=total[1:])
    return mix((total[end] - total[start]) * inverse_power(n)[start])


def words(buffer: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(buffer)
    solid = ~_SPACE[buffer]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    if n:
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[offsets[:-1][offsets[:-1] < n]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(buffer, offsets, start, end, text, hashes(_VALUE[LOWER[buffer]], start, end))


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text with fewer words is one run, one without words none."""
    h, text = found.hash, found.text
    counts = found.count()
    out_text, out_hash = [], []
    if len(h) >= size:
        whole = text[: len(text) - size + 1] == text[size - 1 :]
        value = np.zeros(int(whole.sum()), np.uint64)
        at = np.flatnonzero(whole)
        for k in range(size):
            value = mix(value * np.uint64(3) + h[at + k])
        out_text.append(text[at])
        out_hash.append(value)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate(([0], np.cumsum(counts)))[:-1]
        value = np.full(len(short), 0x5EED, np.uint64) + counts[short].astype(np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            value[has] = mix(value[has] * np.uint64(3) + h[first[short][has] + k])
        out_text.append(short)
        out_hash.append(value)
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_text), np.concatenate(out_hash)


def distinct(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, sorted."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]
