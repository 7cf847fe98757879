"""An FM-index over a sequence of symbols in numpy: suffix array, wavelet matrix over the BWT, sampled positions."""

from __future__ import annotations

import numpy as np

WORD = 64


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` (non-negative ints; shorter before longer) in ascending order.

    Prefix doubling: the first key packs as many symbols as fit in 62 bits; later rounds sort only positions that are
    still tied, by the rank of what follows.
    """
    n = len(s)
    if not n:
        return np.empty(0, np.int64)
    bits = max(1, int(s.max() + 1).bit_length())
    span = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.r_[s.astype(np.int64) + 1, np.zeros(span, np.int64)]
    for k in range(span):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    head = np.r_[True, key[order][1:] != key[order][:-1]]
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group's rank is its first place
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    while True:
        last = np.r_[head[1:], True]
        tied = np.flatnonzero(~(head & last))
        if not len(tied):
            return order
        at = order[tied]
        after = rank[np.minimum(at + span, n)] + 1
        by = np.lexsort((after, group[tied]))
        at, after, own = at[by], after[by], group[tied][by]
        order[tied] = at
        new = np.r_[True, (own[1:] != own[:-1]) | (after[1:] != after[:-1])]
        head[tied] |= new
        group[tied] = np.maximum.accumulate(np.where(new, tied, 0))
        rank[at] = group[tied]
        span *= 2


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-len(bits) // WORD) * WORD + WORD, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))[:-1]]
        self.ones = int(bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w, b = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Rank and access over symbols, a bit vector per bit of a symbol from the highest."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels: list[tuple[Bits, int]] = []
        for k in range(bits - 1, -1, -1):
            bit = ((s >> k) & 1).astype(bool)
            b = Bits(bit)
            self.levels.append((b, len(s) - b.ones))
            s = np.concatenate([s[~bit], s[bit]])
        self.bits = bits

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``i`` symbols."""
        a = np.zeros_like(i)
        for k, (b, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            ra, ri = b.rank(a), b.rank(i)
            a, i = np.where(one, zeros + ra, a - ra), np.where(one, zeros + ri, i - ri)
        return i - a

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i``, and how often it is among the first ``i`` symbols."""
        symbol, a = np.zeros_like(i), np.zeros_like(i)
        for k, (b, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = b.get(i)
            symbol |= one.astype(np.int64) << k
            ra, ri = b.rank(a), b.rank(i)
            a, i = np.where(one, zeros + ra, a - ra), np.where(one, zeros + ri, i - ri)
        return symbol, i - a


class FMIndex:
    """Counts and locates sequences of symbols in ``text``. Symbol 0 is kept for the end of the text."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        s = np.r_[text.astype(np.int64), 0]
        self.n = len(s)
        sa = suffix_array(s)
        bits = max(1, int(s.max()).bit_length())
        self.alphabet = 1 << bits
        self.wavelet = WaveletMatrix(s[sa - 1], bits)
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=self.alphabet))]
        kept = sa % sample == 0
        self.marked, self.samples = Bits(kept), sa[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each pattern. ``patterns``: symbols, aligned right."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        width = patterns.shape[1] if patterns.ndim == 2 else 0
        for k in range(1, width + 1):
            c = patterns[:, width - k]
            live = np.flatnonzero((lengths >= k) & (low < high))
            if not len(live):
                break
            c = c[live]
            known = c < self.alphabet
            c = np.where(known, c, 0)
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = np.where(known, self.first[c] + self.wavelet.rank(c, high[live]), low[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back through the BWT until a sampled row."""
        out, row, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        left = np.arange(len(rows))
        while len(left):
            hit = self.marked.get(row[left])
            done = left[hit]
            out[done] = self.samples[self.marked.rank(row[done])] + steps[done]
            left = left[~hit]
            if len(left):
                c, before = self.wavelet.step(row[left])
                row[left] = self.first[c] + before
                steps[left] += 1
        return out
