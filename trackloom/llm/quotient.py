"""A counting quotient filter in numpy: exact multiset of fingerprints, built from and decoded to sorted arrays."""

from __future__ import annotations

import struct

import numpy as np

HEAD = struct.Struct("<BBQQ")


class CountingQuotientFilter:
    """Fingerprints of ``q + r`` bits; the first q bits (quotient) name a home slot, the other r (remainder) are stored.

    Remainders of one quotient are a run of consecutive slots in ascending order, at their home or pushed right by
    earlier runs. Three bits describe a slot: ``occupied`` (some fingerprint has this home), ``runend`` (last slot of
    a run) and ``digit`` (the slot holds r bits of the repeat count of the remainder before it, low bits first). So
    the multiset can be read back without loss, in ascending order.
    """

    def __init__(self, q: int, r: int, occupied: np.ndarray, runend: np.ndarray, digit: np.ndarray, slots: np.ndarray):
        self.q, self.r, self.occupied, self.runend, self.digit, self.slots = q, r, occupied, runend, digit, slots

    @classmethod
    def build(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """``values``: ascending distinct uint64 below 2**bits; ``counts``: how often each occurs, at least 1."""
        q = max(1, min(bits - 1, int(np.ceil(np.log2(max(2, len(values) / 0.9))))))
        r = bits - q
        quotient = (values >> np.uint64(r)).astype(np.int64)
        remainder = values & np.uint64((1 << r) - 1)
        more = counts.astype(np.uint64) - np.uint64(1)
        digits = np.zeros(len(values), np.int64)
        rest = more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> np.uint64(r)
        width = 1 + digits
        first = np.flatnonzero(np.r_[True, quotient[1:] != quotient[:-1]]) if len(values) else np.empty(0, np.int64)
        home = quotient[first]
        length = np.add.reduceat(width, first) if len(first) else np.empty(0, np.int64)
        before = np.cumsum(length) - length
        start = before + np.maximum.accumulate(home - before) if len(first) else before
        size = max(1 << q, int(start[-1] + length[-1]) if len(first) else 0)
        run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(values)]))
        at = np.cumsum(width) - width
        place = start[run] + at - at[first][run] if len(first) else at
        occupied, runend, digit = (np.zeros(size, bool) for _ in range(3))
        slots = np.zeros(size, np.uint64)
        occupied[home] = True
        runend[start + length - 1] = True
        slots[place] = remainder
        mask = np.uint64((1 << r) - 1)
        for k in range(1, int(width.max(initial=1))):
            has = digits >= k
            digit[place[has] + k] = True
            slots[place[has] + k] = (more[has] >> np.uint64(r * (k - 1))) & mask
        return cls(q, r, occupied, runend, digit, slots)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending distinct fingerprints and their counts."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.runend)
        if not len(home):
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        start = np.maximum(home, np.r_[0, end[:-1] + 1])
        length = end - start + 1
        run = np.repeat(np.arange(len(home)), length)
        place = np.arange(len(run)) - np.repeat(np.cumsum(length) - length, length) + start[run]
        is_digit = self.digit[place]
        values = (home[run].astype(np.uint64) << np.uint64(self.r)) | self.slots[place]
        at = np.flatnonzero(~is_digit)
        counts = np.ones(len(at), np.int64)
        owner = np.cumsum(~is_digit) - 1
        where = np.flatnonzero(is_digit)
        shift = (where - at[owner[where]] - 1) * self.r
        np.add.at(counts, owner[where], (self.slots[place[where]] << shift.astype(np.uint64)).astype(np.int64))
        return values[at], counts

    def to_bytes(self) -> bytes:
        used = self.occupied | self.runend | self.digit | (self.slots > 0)
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.runend, self.digit)]
        kind = np.uint32 if self.r <= 32 else np.uint64
        mask = np.packbits(used).tobytes()
        return HEAD.pack(self.q, self.r, len(self.slots), int(used.sum())) + b"".join(bits) + mask + self.slots[used].astype(kind).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        q, r, size, used = HEAD.unpack_from(data)
        n, at = (size + 7) // 8, HEAD.size
        fields = [np.unpackbits(np.frombuffer(data, np.uint8, n, at + k * n), count=size).astype(bool) for k in range(4)]
        slots = np.zeros(size, np.uint64)
        slots[fields[3]] = np.frombuffer(data, np.uint32 if r <= 32 else np.uint64, used, at + 4 * n)
        return cls(q, r, *fields[:3], slots)

    @staticmethod
    def merge(parts: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """The multiset union: the parts' items come as sorted runs, which a stable sort (a merge of the runs that it
        finds) interleaves by value; equal ones add up."""
        read = [p.items() for p in parts]
        values = np.concatenate([v for v, _ in read]) if read else np.empty(0, np.uint64)
        counts = np.concatenate([c for _, c in read]) if read else np.empty(0, np.int64)
        order = np.argsort(values, kind="stable")
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        return CountingQuotientFilter.build(values[first], np.add.reduceat(counts, first) if len(first) else counts, bits)
