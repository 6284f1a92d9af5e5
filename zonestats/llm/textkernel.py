"""Vectorised text kernels for Arrow batches: word boundaries and 64-bit word
hashes of many documents at once, straight from the Arrow string buffers.

Hashes depend on bytes and on fixed constants only, so every task, retry and
executor computes the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # text handled at once; a longer text is handled alone

_U = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters and digits alone: every other ASCII character divides.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


_CHAR = stream(256, 1) | _U(1)
_STEP = _U(0xD1342543DE82EF95)
_POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(255, _STEP)]), dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POW
    if n > len(_POW):
        _POW = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _STEP)]), dtype=np.uint64)
    return _POW


class Words:
    """Words of a slice of documents. ``first[d]:first[d + 1]`` are document
    ``d``'s words; ``start``/``end`` are byte positions in ``data``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, white: np.ndarray = _WHITE):
        self.data, self.offsets = data, offsets
        dark = ~white[data]
        begins = dark.copy()
        begins[1:] &= ~dark[:-1]
        at = offsets[:-1][offsets[:-1] < len(data)]
        begins[at] = dark[at]
        self.start = np.flatnonzero(begins)
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.end, self.length, self.hash = self.start, self.start, np.zeros(0, np.uint64)
            self.letters = self._begin = np.zeros(0, np.int64)
            return
        self.letters = data[dark]
        if lower:
            self.letters = _LOWER[self.letters]
        self._begin = np.cumsum(dark, dtype=np.int64)[self.start] - 1
        self.length = np.diff(np.append(self._begin, len(self.letters)))
        self.end = self.start + self.length
        self.hash = self.hashes(self.length)

    def hashes(self, length: np.ndarray) -> np.ndarray:
        """Hash of the ``length`` first bytes of each word."""
        n = self.length
        pos = np.arange(len(self.letters), dtype=np.int64) - np.repeat(self._begin, n)
        value = _CHAR[self.letters]
        if length is not n:
            value[pos >= np.repeat(length, n)] = 0
        value *= _powers(int(n.max()))[pos]
        with np.errstate(over="ignore"):
            return mix(np.add.reduceat(value, self._begin) + length.astype(np.uint64) * _U(0x2545F4914F6CDD1D))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows whose
    texts take about ``limit`` bytes; null texts are empty."""
    arr = batch.column(column).fill_null("")
    n = len(arr)
    if n == 0:
        return
    wide = pa.types.is_large_string(arr.type)
    _, off, buf = arr.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_MUL = stream(8, 7) | _U(1)


def shingles(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its runs of ``k``
    words; with fewer words, of the whole sequence; without words, none."""
    h = w.hash
    n = len(h)
    with np.errstate(over="ignore"):
        if n >= k:
            run = h[: n - k + 1] * _MUL[0]
            for i in range(1, k):
                run += h[i: n - k + 1 + i] * _MUL[i]
            run = mix(run)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            m = b - a
            if m >= k:
                yield np.unique(run[a: b - k + 1])
            elif m:
                yield mix((h[a:b] * _MUL[:m]).sum(keepdims=True) + _U(m))
            else:
                yield h[:0]
