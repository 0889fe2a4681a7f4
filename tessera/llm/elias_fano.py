"""Elias-Fano coding of monotone sequences, and an n-gram trie of three levels built of them, for many queries at once."""

from __future__ import annotations

import tempfile

import numpy as np

#: Of each byte: its ones, and the place of its k-th one.
_BYTES = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.uint8)
_ONES = _BYTES.sum(1).astype(np.uint8)
_PLACE = np.argsort(1 - _BYTES, axis=1, kind="stable").astype(np.uint8)


class EliasFano:
    """A sequence of integers in ascending order: low bits as they are, high bits as gaps in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.low_bits = max(0, (int(universe) // max(1, self.n)).bit_length() - 1)
        low = values & np.uint64((1 << self.low_bits) - 1)
        parts = []
        lanes = np.arange(self.low_bits, dtype=np.uint64)
        for a in range(0, self.n, 1 << 14):  # a multiple of eight values fills whole bytes
            bits = (low[a : a + (1 << 14), None] >> lanes) & np.uint64(1)
            parts.append(np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little"))
        self.low = np.concatenate([*parts, np.zeros(16, np.uint8)])
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.top = int(high[-1]) if self.n else -1
        bits = np.zeros(-(-(self.top + 2 + self.n) // 64) * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        self.high = np.packbits(bits, bitorder="little").view(np.uint64)
        self._count()

    def _count(self) -> None:
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.ones_before = np.concatenate([[0], np.cumsum(ones)])
        self.zeros_before = np.arange(len(self.high) + 1) * 64 - self.ones_before

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high]

    def replace(self, arrays: list[np.ndarray]) -> None:
        """Use the same content from elsewhere, say a mapped file."""
        self.low, self.high = arrays

    def _select(self, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
        """The place of the k-th one (or zero) of the high bits: its word by bisection, its byte and bit by tables."""
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 1 << 16):
            mine = k[a : a + (1 << 16)]
            word = np.searchsorted(before, mine, "right") - 1
            bits = np.asarray(self.high[word])
            parts = (~bits if flip else bits).view(np.uint8).reshape(-1, 8)
            until = np.cumsum(_ONES[parts], axis=1, dtype=np.uint8)
            rank = (mine - before[word]).astype(np.uint8)
            byte = (until <= rank[:, None]).sum(1)
            row = np.arange(len(mine))
            rank -= np.where(byte > 0, until[row, byte - 1], 0).astype(np.uint8)
            out[a : a + (1 << 16)] = word * 64 + byte * 8 + _PLACE[parts[row, byte], rank]
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        words = np.ndarray((len(self.low) - 7,), "<u8", np.ascontiguousarray(self.low), strides=(1,))
        return (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        high = self._select(self.ones_before, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value that is at least x, whether it is x)."""
        x = x.astype(np.uint64)
        high = (x >> np.uint64(self.low_bits)).astype(np.int64)
        low = x & np.uint64((1 << self.low_bits) - 1)
        place, equal = np.full(len(x), self.n), np.zeros(len(x), bool)
        inside = np.flatnonzero(high <= self.top)
        h = high[inside]
        # The values with the same high bits lie between two zeros; among them, which may be many, by bisection.
        at = np.zeros(len(inside), np.int64)
        later = h > 0
        at[later] = self._select(self.zeros_before, h[later] - 1, True) + 1 - h[later]
        end = self._select(self.zeros_before, h, True) - h
        until = end.copy()
        wanted = low[inside]
        going = np.flatnonzero(at < until)
        while len(going):
            middle = (at[going] + until[going]) >> 1
            less = self._low(middle) < wanted[going]
            at[going[less]] = middle[less] + 1
            until[going[~less]] = middle[~less]
            going = going[at[going] < until[going]]
        there = np.flatnonzero(at < end)
        equal[inside[there]] = self._low(at[there]) == wanted[there]
        place[inside] = at
        return place, equal


class Codebook:
    """Probabilities in one byte, rounded down: 0 stands for none, 1 to 255 for equal steps of the logarithm."""

    LOWEST = -8.0

    def __init__(self) -> None:
        self.values = np.concatenate([[0.0], 10 ** np.linspace(self.LOWEST, 0.0, 255)])

    def encode(self, p: np.ndarray) -> np.ndarray:
        """The code of each probability above 0; those below the lowest step get that."""
        return np.maximum(1, np.searchsorted(self.values, p * (1 + 1e-12), "right") - 1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.values[codes]


class Trie:
    """An n-gram trie of three levels: contexts, their successors with codes, and the successors' successors with codes.

    A successor is stored relative to its parent, the parent's place above and the word below, so each level is one monotone
    sequence, and monotone pointers bound a parent's children in it. The levels lie in a temporary file that is mapped.
    """

    def __init__(self, contexts: np.ndarray, context_bits: int, levels: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]]):
        """``contexts`` ascending; of each level (parents' places, words, bits of a word, codes), ascending by the first two."""
        self.first = EliasFano(contexts, 1 << context_bits)
        self.bits = [bits for _, _, bits, _ in levels]
        self.pointers, self.words = [], []
        above = len(contexts)
        for parents, words, bits, _ in levels:
            self.pointers.append(EliasFano(np.searchsorted(parents, np.arange(above + 1)), len(parents) + 1))
            self.words.append(EliasFano((parents.astype(np.uint64) << np.uint64(bits)) | words.astype(np.uint64), max(1, above) << bits))
            above = len(parents)
        self._map([codes for *_, codes in levels])

    def _map(self, codes: list[np.ndarray]) -> None:
        parts = [self.first, *self.pointers, *self.words]
        levels = [x for part in parts for x in part.arrays()] + codes
        with tempfile.TemporaryFile() as file:  # without a name from the start, so nothing is left behind
            places = []
            for x in levels:
                file.seek(-file.tell() % 8, 1)
                places.append(file.tell())
                file.write(x.tobytes())
            file.write(b"\0" * 8)
            file.flush()
            mapped = [np.memmap(file, x.dtype, "r", at, x.shape) if len(x) else x for x, at in zip(levels, places, strict=True)]
        for k, part in enumerate(parts):
            part.replace(mapped[2 * k : 2 * k + 2])
        self.codes = mapped[2 * len(parts) :]

    def context(self, contexts: np.ndarray) -> np.ndarray:
        """The place of each context, -1 where it is not there."""
        place, known = self.first.successor(contexts)
        return np.where(known, place, -1)

    def children(self, level: int, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The place on ``level`` of each word below its parent, -1 where there is none; a parent of -1 has no children."""
        out = np.full(len(words), -1)
        asked = np.flatnonzero(parents >= 0)
        at = parents[asked]
        begin, end = (self.pointers[level].access(x).astype(np.int64) for x in (at, at + 1))
        some = begin < end
        asked, at, begin, end = asked[some], at[some], begin[some], end[some]
        found, equal = self.words[level].successor((at.astype(np.uint64) << np.uint64(self.bits[level])) | words[asked].astype(np.uint64))
        equal &= (found >= begin) & (found < end)
        out[asked[equal]] = found[equal]
        return out

    def code(self, level: int, places: np.ndarray) -> np.ndarray:
        """The codes at some places, 0 at -1."""
        if not len(self.codes[level]):
            return np.zeros(len(places), np.uint8)
        return np.where(places >= 0, self.codes[level][np.maximum(places, 0)], 0).astype(np.uint8)
