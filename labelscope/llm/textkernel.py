"""Vectorised text kernels over Arrow string columns.

A batch of texts is one byte buffer with offsets, so words are found with byte
tables and hashed with prefix sums instead of a Python loop over words. Both
word classes of the contracts are decidable on UTF-8 bytes: every byte of a
non-ASCII character is >= 0x80 and belongs to a word.

Work is done on slices of at most ``CHUNK`` bytes of whole texts, so memory is
bounded by the larger of ``CHUNK`` and the longest single text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: [^\x20\x09-\x0D]
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[0x20, 9, 10, 11, 12, 13]] = False

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C13)  # 3 mod 4
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK)
        for i, base in enumerate((_BASE, _BASE_INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def release() -> None:
    """Give memory of finished work back to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection), element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def slices(raw: np.ndarray, offs: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, bytes, offsets from 0) for runs of whole texts of about ``chunk`` bytes."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + chunk, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(raw: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of words, and words per text as offsets into them."""
    starts, ends = runs(member[raw], offs)
    return starts, ends, np.searchsorted(starts, offs)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values; none crosses an offset."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offs] = True
    left, right = inside.copy(), inside.copy()
    if len(inside):
        left[1:] &= ~inside[:-1] | edge[1:-1]
        right[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(left), np.flatnonzero(right) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words (of lower-cased bytes where ``raw`` is so)."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_word(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])


class HashIndex:
    """Places of 64-bit hashes in a bounded list of distinct ones."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        hashes = np.asarray(hashes, dtype=np.uint64)
        self._order = np.argsort(hashes)
        self._sorted = hashes[self._order]
        self._maybe = np.zeros(1 << self.BITS, dtype=bool)
        self._maybe[self._low(hashes)] = True

    def _low(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 for those outside."""
        out = np.full(len(hashes), -1, np.int32)
        at = np.flatnonzero(self._maybe[self._low(hashes)])
        if len(at) and len(self._sorted):
            place = np.searchsorted(self._sorted, hashes[at])
            place[place == len(self._sorted)] = 0
            ok = self._sorted[place] == hashes[at]
            out[at[ok]] = self._order[place[ok]]
        return out


class Vocabulary(HashIndex):
    """Ids (from 0) of a bounded set of words by their hashes."""

    def __init__(self, words: list[str]):
        self.words = list(words)
        super().__init__(np.array([hash_word(w) for w in self.words], dtype=np.uint64))


_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, woffs: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words of each text, and their offsets.

    A text of fewer words gives its whole sequence as one, none if it has no words.
    """
    counts = np.diff(woffs)
    n = len(hashes)
    per = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    soffs = np.concatenate([[0], np.cumsum(per)])
    every = np.zeros(max(n - width + 1, 0), np.uint64)
    for j in range(width):
        every += hashes[j : j + len(every)] * _SHINGLE[j]
    out = np.zeros(int(soffs[-1]), np.uint64)
    full = np.flatnonzero(counts >= width)
    if len(full):
        at = np.repeat(woffs[full] - soffs[full], per[full]) + _ranges(soffs[full], per[full])
        out[_ranges(soffs[full], per[full])] = mix(every[at])
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        w = hashes[woffs[d] : woffs[d + 1]]
        out[soffs[d]] = mix((w * _SHINGLE[: len(w)]).sum(dtype=np.uint64)[None] + _SHINGLE[32 + len(w) : 33 + len(w)])[0]
    return out, soffs


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of range(s, s + n)."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1])) + np.repeat(starts - (ends - lengths), lengths)


ranges = _ranges
