"""Words of whole texts as arrays: bounds, hashes and k-grams for a slice of an Arrow batch at a time.

A text of any length is worked on whole.  Temporary arrays are bounded by PIECE bytes, because hashes are
summed piece by piece, cut between words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
WHITE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: White space of the contracts, and white space together with ASCII punctuation.
SPACES = np.isin(np.arange(256), WHITE)
MARKS = SPACES | np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_WORD_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of a word that one polynomial covers; longer words mix the sums of their blocks with the block's place.
HASHED = 512
_POWERS = np.cumprod(np.full(HASHED, _WORD_BASE), dtype=np.uint64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value; another salt gives another function."""
    x = x ^ np.uint64((int(salt) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `limit` bytes each; a longer document is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of some documents: hash64, first and past-the-end byte, and number of the document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators=SPACES, lower: bool = False):
        self.base = int(offsets[0])
        data = data[self.base : int(offsets[-1])]
        self.offsets = offsets - self.base
        self.data = LOWER[data] if lower else data
        apart = separators[self.data]
        before = np.empty(len(apart) + 1, bool)
        before[0] = True
        before[1:] = apart
        edge = self.offsets[:-1]
        before[edge] = True
        self.starts = np.flatnonzero(before[:-1] & ~apart)
        after = np.empty(len(apart) + 1, bool)
        after[:-1] = apart
        after[-1] = True
        after[edge] |= True
        # A word ends where the next byte is apart or belongs to the next document.
        self.ends = np.flatnonzero(after[1:] & ~apart) + 1
        self.doc = np.searchsorted(self.offsets, self.starts, "right") - 1
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        a = 0
        while a < len(out):
            b = max(a + 1, int(np.searchsorted(self.ends, self.starts[a] + PIECE, "right")))
            first, lengths = self.starts[a:b], self.ends[a:b] - self.starts[a:b]
            ends = np.cumsum(lengths)
            place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            terms = self.data[np.repeat(first, lengths) + place].astype(np.uint64) + np.uint64(1)
            terms *= _POWERS[place % HASHED]
            edges = np.flatnonzero(place % HASHED == 0)
            blocks = np.add.reduceat(terms, edges)
            later = place[edges] // HASHED
            blocks = np.where(later > 0, mix(blocks ^ mix(later.astype(np.uint64), 400), 401), blocks)
            total = np.add.reduceat(blocks, np.flatnonzero(later == 0))
            out[a:b] = mix(total + lengths.astype(np.uint64))
            a = b
        return out

    def stems(self, length: int) -> np.ndarray:
        """Hash of the first `length` bytes of every word; a shorter word counts whole."""
        out = np.zeros(len(self.starts), np.uint64)
        for i in range(length):
            inside = self.starts + i < self.ends
            byte = self.data[np.minimum(self.starts + i, self.ends - 1)]
            out = out * np.uint64(257) + np.where(inside, byte, 0).astype(np.uint64)
        return mix(out, 300 + length)

    def counts(self) -> np.ndarray:
        """Words of each document."""
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def grams(hashes: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for j in range(k):
        out = out * factor + hashes[j : j + n]
    return mix(out, salt)


def pack(values: np.ndarray) -> bytes:
    """Eight-byte integers with equal bytes of all values side by side, which shuffles compress well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def give_back() -> None:
    """Return free memory of this process: a worker keeps what a task has used while it waits for the next one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A mapInArrow function that gives memory back when its partition is done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped
