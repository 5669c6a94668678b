"""Words and shingles of UTF-8 texts as arrays of 64-bit hashes, without a Python object per word.

Words are runs of [^\\x20\\x09-\\x0D] with A-Z lower-cased.  A word's hash is the
polynomial sum of its bytes' random values; differences of one running sum
over the text give all words at once (an odd base has an inverse mod 2**64).
"""

from __future__ import annotations

from functools import cache

import numpy as np

PIECE = 1 << 18
_P = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_VALUE = np.random.default_rng(20240603).integers(1, 1 << 63, 256, np.uint64)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_VALUE[_SPACE] = 0


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        x = np.full(n, np.uint64(base & (2**64 - 1)))
        x[0] = 1
        return np.multiply.accumulate(x)

    return of(_P), of(pow(_P, -1, 2**64))


def _piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.concatenate(([True], _SPACE[b], [True]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    power, inverse = _powers(max(PIECE, 1 << (len(b) - 1).bit_length()))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * power[: len(b)], dtype=np.uint64)))
    return start, end, mixed((run[end] - run[start]) * inverse[start])


def spans(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of a text's words; starts and ends in bytes.  Long texts go in pieces that end at a space."""
    b = np.frombuffer(text or b"", np.uint8)
    if not len(b):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(b) <= PIECE:
        return _piece(b)
    parts, at = [], 0
    while at < len(b):
        to = min(at + PIECE, len(b))
        while to < len(b):
            gap = np.flatnonzero(_SPACE[b[to : to + PIECE]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(to + PIECE, len(b))
        s, e, h = _piece(b[at:to])
        parts.append((s + at, e + at, h))
        at = to
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def hashes(text: bytes | None) -> np.ndarray:
    return spans(text)[2]


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; shorter texts are one shingle, those without words none."""
    w = hashes(text)
    n = len(w)
    if n == 0:
        return w
    m = min(k, n)
    x = np.full(n - m + 1, np.uint64(m))
    for i in range(m):
        x *= np.uint64(_P)
        x += w[i : n - m + 1 + i]
    return np.unique(mixed(x))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
