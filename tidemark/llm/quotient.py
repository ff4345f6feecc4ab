"""Counting quotient filters of fingerprints of `bits` bits.

The upper bits of a fingerprint name its slot (quotient), the lower ones (remainder) are what the slot keeps.  Remainders
of one quotient form a sorted run that begins at the slot or, where runs before it reach farther, behind them.  Three bits
for each slot tell what is there: whether a run belongs to this quotient (occupied), whether a run ends here, and
whether the slot holds a digit of a counter: a fingerprint counted more than once has its count in the slots behind its
remainder.  Nothing is lost: quotient and remainder together are the fingerprint.

A filter takes (remainder bits + 3) / LOAD bits for each fingerprint, and as many more for each counter digit.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.succinct import Packed

#: Share of the slots that are in use, about (a power of two has to fit).
LOAD = 0.75


class QuotientFilter:
    def __init__(self, bits: int, quotient_bits: int, occupied: np.ndarray, ends: np.ndarray, digits: np.ndarray, slots: Packed):
        self.bits, self.quotient_bits = bits, quotient_bits
        self.occupied, self.ends, self.digits, self.slots = occupied, ends, digits, slots

    @classmethod
    def of(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints (unsigned) and how often each was seen."""
        values, counts = values.astype(np.uint64), counts.astype(np.uint64)
        size = int(len(values) + (counts > 1).sum())
        quotient_bits = min(max(1, round(np.log2(max(size, 1) / LOAD))), bits - 1)
        width = bits - quotient_bits
        quotient = (values >> np.uint64(width)).astype(np.int64)
        # Digits of a counter, the lowest first, behind the remainder.
        parts, owner, order, digit = [values & np.uint64((1 << width) - 1)], [np.arange(len(values))], [np.zeros(len(values), np.int64)], 1
        rest, who = counts[counts > 1], np.flatnonzero(counts > 1)
        while len(who):
            parts.append(rest & np.uint64((1 << width) - 1))
            owner.append(who)
            order.append(np.full(len(who), digit))
            rest = rest >> np.uint64(width)
            who, rest, digit = who[rest > 0], rest[rest > 0], digit + 1
        content, owner, order = (np.concatenate(x) for x in (parts, owner, order))
        by = np.lexsort((order, owner))
        content, order = content[by], order[by]
        home = quotient[owner[by]]
        # A slot is its quotient's own or the one behind the last, whichever comes later.
        at = np.maximum.accumulate(home - np.arange(len(home))) + np.arange(len(home)) if len(home) else home
        slots = max(1 << quotient_bits, int(at[-1]) + 1 if len(at) else 0)
        occupied, ends, digits = (np.zeros(slots, bool) for _ in range(3))
        occupied[quotient] = True
        if len(home):
            ends[at[np.r_[home[1:] != home[:-1], True]]] = True
        digits[at[order > 0]] = True
        kept = np.zeros(slots, np.uint64)
        kept[at] = content
        return cls(bits, quotient_bits, occupied, ends, digits, Packed.of(kept, width))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        quotient, last = np.flatnonzero(self.occupied), np.flatnonzero(self.ends)
        first = np.maximum(quotient, np.r_[-1, last[:-1]][: len(quotient)] + 1)
        sizes = last - first + 1
        at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        content, digit = self.slots[at].astype(np.uint64), self.digits[at]
        width = self.bits - self.quotient_bits
        head = np.flatnonzero(~digit)
        values = (np.repeat(quotient, sizes)[head].astype(np.uint64) << np.uint64(width)) | content[head]
        counts = np.ones(len(head), np.int64)
        place = np.arange(len(at)) - head[np.cumsum(~digit) - 1] if len(at) else np.zeros(0, np.int64)
        owner = np.cumsum(~digit) - 1
        counted = np.unique(owner[digit])
        counts[counted] = 0
        np.add.at(counts, owner[digit], (content[digit] << ((place[digit] - 1) * width).astype(np.uint64)).astype(np.int64))
        return values, counts

    def __bytes__(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.occupied)], np.uint64)
        flags = b"".join(np.packbits(x).tobytes() for x in (self.occupied, self.ends, self.digits))
        return head.tobytes() + self.slots.words.tobytes() + flags

    @classmethod
    def read(cls, data: bytes) -> QuotientFilter:
        bits, quotient_bits, slots = (int(x) for x in np.frombuffer(data, np.uint64, 3))
        width, flags = bits - quotient_bits, -(-slots // 8)
        words = np.frombuffer(data, np.uint64, (len(data) - 24 - 3 * flags) // 8, 24)
        raw = np.frombuffer(data, np.uint8, 3 * flags, len(data) - 3 * flags).reshape(3, flags)
        return cls(bits, quotient_bits, *(np.unpackbits(x, count=slots).astype(bool) for x in raw), Packed(words, width))


def merged(filters: list[QuotientFilter]) -> QuotientFilter:
    """All fingerprints of some filters, whose sorted runs are merged; counts of equal ones add up."""
    items = [f.items() for f in filters]
    values, counts = (np.concatenate(x) for x in zip(*items))
    # Runs are sorted already, which a stable sort makes use of.
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]][: len(values)])
    totals = np.add.reduceat(counts, first) if len(first) else counts
    return QuotientFilter.of(values[first], totals, filters[0].bits)
