"""Words and their 64-bit hashes over the byte buffer of an Arrow string array, without a Python object per word.

A word is a longest run of bytes that are not separators. Separators are ASCII, so a UTF-8 character is never cut.
Null texts have no bytes and so no words.
"""

from __future__ import annotations

import ctypes
import os
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: `[^\x20\x09-\x0D]+`
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
NON_ALNUM = np.isin(np.arange(256), [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers (fixed values): they make the first of two combined hashes differ from the second.
_LEFT, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: The lowest k bytes of eight.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
#: Bytes handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20


@dataclass
class Words:
    """``data[starts[i]:ends[i]]`` is word i; document d has words ``first[d]`` to ``first[d + 1] - 1``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def strings(self) -> pa.Array:
        """The words as an Arrow binary array, copied once."""
        lengths = self.ends - self.starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        take = np.repeat(self.starts - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[take])])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def as_text(array) -> pa.LargeStringArray:
    """One contiguous array with 64-bit offsets, from whatever string array or chunks Spark hands over."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks() if array.num_chunks != 1 else array.chunk(0)
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    return array.cast(pa.large_string()).fill_null("")


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; the offsets begin at 0."""
    array = as_text(array)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts ``data[offsets[d]:offsets[d + 1]]``."""
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(separators[data], out=inside[1:-1])
    cuts = offsets[1:-1]
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] |= inside[cuts + 1]
    ends[cuts - 1] |= inside[cuts]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word; equal words have equal hashes wherever they stand.

    Eight bytes at a time are mixed into what came before, so no arithmetic relation between words makes their hashes
    meet. Memory grows with the number of words, not of bytes; the few words of over LONG_WORD bytes go to a digest.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    lengths = words.ends - words.starts
    out = mix(lengths.astype(np.uint64) * _LENGTH)
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(words.data) + 1,), "<u8", padded, strides=(1,))
    rest = np.flatnonzero(lengths <= LONG_WORD)
    at = words.starts[rest]
    left = lengths[rest]
    while len(rest):
        value = eights[at]
        last = left < 8
        value[last] &= _TAIL[left[last]]
        out[rest] = mix(out[rest] ^ value)
        going = left > 8
        rest, at, left = rest[going], at[going] + 8, left[going] - 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = int.from_bytes(blake2b(words.data[words.starts[i] : words.ends[i]], digest_size=8).digest(), "little")
    return out


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive entries of h, by the place of the first; those over an end of a document are for the caller to leave out.

    Runs of twice a length are made of two runs of that length, and of such pieces any length.
    """
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, done, piece, length = None, 0, h, 1
    while True:
        if n & length:
            mine = piece[done : done + len(h) - n + 1]
            out = mix(mine + np.uint64(length)) if out is None else mix(out * _LEFT + mine)
            done += length
        if 2 * length > n:
            return out
        piece = mix(piece[:-length] * _LEFT + piece[length:])
        length *= 2


def chunks(sizes: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of rows with at most ``limit`` together, or a single row. After a large batch the freed memory goes back to the system."""
    begin, total, whole = 0, 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
        whole += size
    if begin < len(sizes):
        yield begin, len(sizes)
    if whole > CHUNK_BYTES:
        give_back()


def give_back() -> None:
    """Python workers serve one stage after the other and keep what they freed; where the C library can, return it."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
