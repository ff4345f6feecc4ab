"""Compact arrays over bytes: fixed-width integers and Elias-Fano sequences, read in place for many places at once."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _bits(x: int) -> int:
    return int(x).bit_length()


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct non-negative integers and the place of each among them.

    Places are sorted along in the low bits where there is room, which is several times faster than sorting places by value.
    """
    if (values[1:] >= values[:-1]).all():
        new = np.r_[True, values[1:] != values[:-1]][: len(values)]
        return values[new], np.cumsum(new) - 1
    bits = _bits(len(values))
    if _bits(values.max()) + bits <= 63:
        both = np.sort(values << bits | np.arange(len(values)))
        at, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        at = np.argsort(values, kind="stable")
        ordered = values[at]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    out = np.empty(len(values), np.int64)
    out[at] = np.cumsum(new) - 1
    return ordered[new], out


#: Place of the k-th set bit of a byte.
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [i for i in range(8) if _byte >> i & 1]
    _PLACE[_byte, : len(_set)] = _set


def _kth(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each 64-bit word."""
    parts = np.ascontiguousarray(words).view(np.uint8).reshape(-1, 8)
    counts = np.bitwise_count(parts).cumsum(1, dtype=np.uint8)
    which = (counts <= k[:, None]).sum(1)
    at = np.arange(len(k))
    before = np.where(which > 0, counts[at, np.maximum(which - 1, 0)], 0)
    return 8 * which + _PLACE[parts[at, which], k - before]


class Packed:
    """Unsigned integers of `width` bits each in 64-bit words, one word to spare behind them."""

    def __init__(self, words: np.ndarray, width: int):
        self.words, self.width = words, width

    @classmethod
    def of(cls, values: np.ndarray, width: int) -> Packed:
        values = values.astype(np.uint64)
        words = np.zeros((len(values) * width >> 6) + 2, np.uint64)
        if width:
            at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
            place, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(words, place, values << shift)
            over = np.flatnonzero(shift + np.uint64(width) > np.uint64(64))
            np.bitwise_or.at(words, place[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
        return cls(words, width)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        at = at.astype(np.uint64) * np.uint64(self.width)
        place, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.words[place] >> shift
        over = np.flatnonzero(shift > np.uint64(64 - self.width))
        out[over] |= self.words[place[over] + 1] << (np.uint64(64) - shift[over])
        return (out & np.uint64((1 << self.width) - 1)).astype(np.int64)


class EliasFano:
    """A monotone sequence below `top`: low bits packed, high parts in unary with a directory of zeros."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, Packed(low, width), high, zeros
        self._listed = None

    @classmethod
    def of(cls, values: np.ndarray, top: int) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        width = max(0, _bits(max(top, 1) // max(n, 1)) - 1)
        parts = values >> width
        places = parts + np.arange(n)
        size = (max(top, 1) >> width) + n + 2
        bits = np.zeros(-(-size // 64) * 64, bool)
        bits[places] = True
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.r_[0, np.cumsum(64 - np.bitwise_count(high).astype(np.int64))].astype(np.uint64)
        return cls(n, width, Packed.of(values & ((1 << width) - 1), width).words, high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.uint64), self.low.words, self.high, self.zeros]

    @classmethod
    def read(cls, arrays) -> EliasFano:
        head, low, high, zeros = (next(arrays) for _ in range(4))
        return cls(int(head[0]), int(head[1]), low, high, zeros)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits; for many questions all places are listed once."""
        if self._listed is None and 4 * len(k) > self.n:
            bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
            self._listed = np.flatnonzero(bits == 0).astype(np.int32 if len(bits) < 1 << 31 else np.int64)
        if self._listed is not None:
            return self._listed[k].astype(np.int64)
        block = np.searchsorted(self.zeros, k.astype(np.uint64), "right") - 1
        return 64 * block + _kth(~self.high[block], k - self.zeros[block].astype(np.int64))

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each value in the sequence, -1 where it is missing: the successor in its high part, by halving."""
        values = values.astype(np.int64)
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        part = values >> self.width
        open_ = np.flatnonzero((values >= 0) & (part < int(self.zeros[-1])))
        part = part[open_]
        # Entries of one high part lie between two zeros.
        end = self._zero(part) - part
        left = np.where(part > 0, self._zero(np.maximum(part - 1, 0)) + 1 - part, 0)
        some = np.flatnonzero(left < end)
        open_, left, end = open_[some], left[some], end[some]
        want = values[open_] & ((1 << self.width) - 1)
        wide = np.flatnonzero(end - left > 1)
        low, high, searched = left[wide], end[wide] - 1, want[wide]
        while len(wide):
            middle = (low + high) >> 1
            less = self.low[middle] < searched
            low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
            left[wide] = low
            more = np.flatnonzero(low < high)
            wide, low, high, searched = wide[more], low[more], high[more], searched[more]
        hit = self.low[left] == want
        out[open_[hit]] = left[hit]
        return out

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at some places."""
        ones = np.r_[0, np.cumsum(np.bitwise_count(self.high).astype(np.int64))]
        block = np.searchsorted(ones, at, "right") - 1
        place = _kth(self.high[block], at - ones[block])
        return ((64 * block + place - at) << self.width) | self.low[at]
