"""An FM-index over a sequence of small integers, searched for many patterns at once.

The text is a concatenation of runs of symbols, each ended by a break (symbol 0).
Breaks are distinct to the suffix order (by position), so no match crosses one.
Ranks come from a wavelet tree in its level-wise (matrix) form; suffix positions
are sampled every ``SAMPLE`` symbols and at the first symbol of every run, which
is as far as a walk backwards can go.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling; equal to a sort with distinct breaks."""
    n = len(text)
    breaks = text == 0
    key = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + n)
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        both = rank * (n + 1) + after
        order = np.argsort(both, kind="stable")
        ordered = both[order]
        new = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1 or width >= n:
            return order
        width *= 2


class WaveletTree:
    """Rank of a symbol before a position, for arrays of symbols and positions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        current = symbols.astype(np.int64)
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            self.levels.append((level, ones, len(current) - int(ones[-1])))
            current = np.concatenate([current[bit == 0], current[bit == 1]])
        self._begin: dict[int, int] = {}

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(symbol), np.int64), at.astype(np.int64)
        for level, ones, zeros in self.levels:
            bit = (symbol >> level) & 1 == 1
            one_low, one_high = ones[low], ones[high]
            low = np.where(bit, zeros + one_low, low - one_low)
            high = np.where(bit, zeros + one_high, high - one_high)
        return high - low


class FMIndex:
    """Search over ``text`` (1-based symbols, 0 after every run)."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.text_length = len(text)
        order = suffix_array(text)
        self.bwt = text[order - 1].astype(np.int64)
        counts = np.bincount(text, minlength=n_symbols + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = WaveletTree(self.bwt, max(1, int(n_symbols + 1).bit_length()))
        begins = np.concatenate([[True], text[:-1] == 0]) if len(text) else np.zeros(0, bool)
        sampled = begins[order] | (order % SAMPLE == 0)
        self.sampled = sampled
        self.sample_of = np.cumsum(sampled) - 1
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of each row of ``patterns``, by backward search."""
        m = len(patterns)
        low, high = np.zeros(m, np.int64), np.full(m, self.text_length, np.int64)
        live = np.arange(m)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.first[symbol] + self.ranks.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.ranks.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        dead = np.ones(m, bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to a sampled suffix."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[rows])
        while len(todo):
            symbol = self.bwt[rows[todo]]
            rows[todo] = self.first[symbol] + self.ranks.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self.sampled[rows[todo]]]
        return self.samples[self.sample_of[rows]] + steps
