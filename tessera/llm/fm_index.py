"""An FM-index over a sequence of symbols: suffix order, Burrows-Wheeler transform, wavelet matrix and sampled positions.

All work is on NumPy arrays, over all phrases at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling over those suffixes that are not yet told apart."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    ordered = symbols[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    # Suffixes in groups of more than one, kept in suffix order; places[i] is where active[i] stands in it.
    places = np.flatnonzero(~new | ~np.concatenate([new[1:], [True]])) if n else np.zeros(0, np.int64)
    k = 1
    while len(places):
        active = order[places]
        after = active + k
        key = rank[active] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        order[places] = active
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[active] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        places = places[~new | ~np.concatenate([new[1:], [True]])]
        k *= 2
    return order


class WaveletMatrix:
    """Access and rank over symbols below ``2 ** bits``: for each bit, from the highest, the counts of ones so far."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        symbols = symbols.astype(np.int32)
        for b in reversed(range(bits)):
            bit = (symbols >> b & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.first = np.zeros(1 << bits, np.int32)
        begin = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]])) if len(symbols) else np.zeros(0, np.int64)
        self.first[symbols[begin]] = begin

    def rank(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before place i."""
        i = i.astype(np.int32)
        for level, b in enumerate(reversed(range(self.bits))):
            ones = self.ones[level][i]
            i = np.where(symbols >> b & 1, self.zeros[level] + ones, i - ones)
        return i - self.first[symbols]

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place i, and how often it stands before i."""
        symbols, i = np.zeros(len(i), np.int32), i.astype(np.int32)
        for level in range(self.bits):
            ones = self.ones[level][i]
            bit = self.ones[level][i + 1] - ones
            symbols = symbols << 1 | bit
            i = np.where(bit, self.zeros[level] + ones, i - ones)
        return symbols, i - self.first[symbols]


class FmIndex:
    """Counts and places of phrases in ``symbols``, whose entries are from 0 to ``size - 1``."""

    SAMPLE = 8

    def __init__(self, symbols: np.ndarray, size: int):
        # One end mark, smaller than all symbols, makes the order of suffixes that of rotations.
        text = np.concatenate([symbols.astype(np.int64) + 1, [0]])
        order = suffix_array(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        self.matrix = WaveletMatrix(text[order - 1], max(1, int(size).bit_length()))
        sampled = order % self.SAMPLE == 0
        self.sampled_before = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.samples = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase, by backward search; row p holds phrase p's symbols at its end.

        A symbol below 0 occurs nowhere.
        """
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.before[-1])
        width = phrases.shape[1]
        alive = np.flatnonzero(((phrases >= 0) | (np.arange(width) < width - lengths[:, None])).all(1))
        high[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for back in range(width):
            alive = alive[(lengths[alive] > back) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbols = phrases[alive, width - 1 - back] + 1
            low[alive] = self.before[symbols] + self.matrix.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.matrix.rank(symbols, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The place in the text of each suffix, from the nearest sampled place before it."""
        found, rows, at = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        steps = 0
        while len(at):
            hit = self.sampled_before[rows + 1] > self.sampled_before[rows]
            found[at[hit]] = self.samples[self.sampled_before[rows[hit]]] + steps
            at, rows = at[~hit], rows[~hit]
            if len(rows):
                symbols, before = self.matrix.step(rows)
                rows = self.before[symbols] + before
            steps += 1
        return found
