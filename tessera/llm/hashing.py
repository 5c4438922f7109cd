"""Vectorised words and word-window fingerprints over Arrow string columns.

A word is a run of bytes outside 0x20 and 0x09-0x0D. Its 64-bit fingerprint is a polynomial over byte codes, read off
prefix sums, then mixed; a window's fingerprint is the same over word fingerprints. All of it is numpy on the column's
own buffer: no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, on an array of its own."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values; on codes a sort is some ten times as fast as np.unique()."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def common(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two arrays of distinct values share."""
    both = np.concatenate([x, y])
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))


_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(0x9E3779B97F4A7C15), (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def parts(offsets: np.ndarray, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `size` bytes each, at least one row."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of some rows: byte starts and ends, fingerprints, and each row's first word."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    codes: np.ndarray
    rows: np.ndarray

    def windows(self, n: int, seed: int = 0) -> np.ndarray:
        """Fingerprints of all windows of n words; those over a row's end mean nothing."""
        return spans(prefix(self.codes, seed), np.arange(max(0, len(self.codes) - n + 1)), n, seed)


def prefix(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * _WORDS[seed](len(codes))[0], out=out[1:])
    return out


def spans(sums: np.ndarray, first: np.ndarray, length, seed: int = 0) -> np.ndarray:
    """Fingerprints of the spans of words [first, first + length)."""
    return mix((sums[first + length] - sums[first]) * _WORDS[seed](len(sums))[1][first] + _U(0x632BE59BD9B4E019) * np.asarray(length).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows in data; lower folds A-Z."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = True
    after[inner - 1] = True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    codes, table = np.empty(len(starts), np.uint64), _LOWER if lower else _CODES
    i = 0
    while i < len(starts):  # pieces of whole words, so that the sums stay in cache
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + (1 << 17), "right")))
        at, to = starts[i], ends[j - 1]
        up, down = _BYTES(to - at + 1)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(table[data[at:to]] * up[: to - at], out=sums[1:])
        s = starts[i:j] - at
        codes[i:j] = (sums[ends[i:j] - at] - sums[s]) * down[s]
        i = j
    return Words(data, starts, ends, mix(codes), np.searchsorted(starts, offsets))


def batches(texts: pa.Array, lower: bool = False, size: int = 1 << 21) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, their words), in parts of bounded size."""
    data, offsets = buffers(texts)
    for lo, hi in parts(offsets, size):
        yield lo, hi, words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lower)
