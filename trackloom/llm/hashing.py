"""64-bit hashes of all words of a text at once, in numpy, in memory that does not grow with a text's length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np

#: Bytes that are hashed at a time. A word of so many bytes or more is hashed on its own.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
SPACE = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to BLOCK."""
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(BLOCK + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def blocks(raw: bytes) -> Iterator[tuple[int, int]]:
    """Cuts of ``raw``, which ends with a space, after spaces: of up to BLOCK bytes, or one word that is longer."""
    at = 0
    while at < len(raw):
        cut = raw.rfind(b" ", at, at + BLOCK)
        cut = (raw.find(b" ", at + BLOCK) if cut < 0 else cut) + 1
        yield at, cut
        at = cut


def hashed(raw: bytes, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Where each word of ``raw`` starts, and its hash; for each length of ``heads`` the numbers of the words that are
    longer, and the hashes of their first so many bytes. Words stand between spaces; ``raw`` ends with one.

    Equal bytes have equal hashes wherever they stand.
    """
    up, down = powers()
    sized = lambda h, n: mixed(h ^ (n.astype(np.uint64) << np.uint64(56)))
    starts, words, parts, before = [], [], [([], []) for _ in heads], 0
    for a, e in blocks(raw):
        b = np.frombuffer(raw, np.uint8, e - a, a)
        if e - a > BLOCK:
            digest = hashlib.blake2b(raw[a : e - 1], digest_size=8).digest()
            start, full, size = np.zeros(1, np.int64), np.frombuffer(digest, "<u8"), np.full(1, e - a - 1)
            b = b[: max(heads, default=0) + 1]
        else:
            space = b == SPACE
            start = np.flatnonzero(~space & np.r_[True, space[:-1]])
            stop = np.flatnonzero(space & np.r_[False, ~space[:-1]])
            size, full = stop - start, None
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(b.astype(np.uint64) * up[: len(b)], out=total[1:])
        starts.append(start + a)
        words.append(sized((total[start + size] - total[start]) * down[start], size) if full is None else full)
        for n, (numbers, hashes) in zip(heads, parts, strict=True):
            longer = np.flatnonzero(size > n)
            s = start[longer]
            numbers.append(longer + before)
            hashes.append(sized((total[s + n] - total[s]) * down[s], np.full(len(s), n)))
        before += len(start)
    join = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
    return join(starts, np.int64), join(words, np.uint64), [(join(n, np.int64), join(h, np.uint64)) for n, h in parts]


def joined(texts: list[str | None], table: bytes) -> tuple[bytes, np.ndarray]:
    """The texts' UTF-8 bytes, each translated by ``table`` and with a space after it, and where each text ends."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    return (b" ".join(raw) + b" ").translate(table), ends
