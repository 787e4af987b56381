"""Sets of hashed word shingles, computed for many texts at once.

Words are runs of characters other than space and the controls 9 to 13, with
A-Z in lower case. A text's set has one 64-bit hash per distinct shingle of five
words; with fewer words the whole sequence is its one shingle, and without words
the set is empty. Hashes come from sums over the bytes of a text, so that a batch
of texts is a handful of array operations.

Two shingles of one pair of texts share a hash by chance in about one of 2^64
cases times the product of the set sizes, that is practically never.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes that are hashed at a time; a longer word is taken whole.
SEGMENT_BYTES = 1 << 18

_U = np.uint64
_R = 0x9E3779B97F4A7C15
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))
_STEP = _U(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _MIX[0]
    h = (h ^ (h >> _U(33))) * _MIX[1]
    return h ^ (h >> _U(33))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A random number per byte, the same for both cases of a letter, and which bytes end words."""
    numbers = _mixed(np.arange(1, 257, dtype=_U) * _STEP)
    numbers[65:91] = numbers[97:123]
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return numbers, space


_NUMBERS, _SPACE = _tables()


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_R, -1, 1 << 64)
    both = []
    for base in (_R, inverse):
        powers = np.full(n, base, dtype=_U)
        powers[0] = 1
        both.append(np.cumprod(powers, dtype=_U))
    return both[0], both[1]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word."""
    hashes, starts = [np.zeros(0, dtype=_U)], [np.zeros(0, dtype=np.int64)]
    at, n = 0, len(data)
    whole = np.frombuffer(data, dtype=np.uint8)
    while at < n:
        stop = min(n, at + SEGMENT_BYTES)
        while stop < n:  # cut at white space, further on if a word is longer than a segment
            spaces = np.flatnonzero(_SPACE[whole[at:stop]])
            if len(spaces):
                stop = at + int(spaces[-1]) + 1
                break
            stop = min(n, stop + SEGMENT_BYTES)
        part = whole[at:stop]
        inside = np.concatenate([[False], ~_SPACE[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        begin, end = edge[0::2], edge[1::2]
        up, down = _powers(1 << max(18, (len(part) - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, dtype=_U), np.cumsum(_NUMBERS[part] * up[: len(part)], dtype=_U)])
        hashes.append(_mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U) * _STEP))
        starts.append(begin + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(starts)


def _batches(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1])
        if size > SEGMENT_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def shingle_sets(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for encoded in _batches(texts):
        hashes, starts = word_hashes(b"\n".join(encoded))
        bounds = np.cumsum([0, *(len(e) + 1 for e in encoded)])
        cuts = np.searchsorted(starts, bounds)
        rolled = hashes[: max(0, len(hashes) - WORDS + 1)].copy()
        for i in range(1, WORDS):
            rolled = (rolled ^ (rolled >> _U(29))) * _STEP + hashes[i : len(rolled) + i]
        rolled = _mixed(rolled)
        for first, last in zip(cuts[:-1], cuts[1:]):
            n = last - first
            if n >= WORDS:
                yield np.unique(rolled[first : last - WORDS + 1])
            elif n:
                short = np.array([n], dtype=_U)
                for h in hashes[first:last]:
                    short = _mixed(short * _STEP + h)
                yield short
            else:
                yield np.zeros(0, dtype=_U)


def linked(a: np.ndarray, b: np.ndarray, percent: int = 80) -> bool:
    """Whether the intersection is at least so many hundredths of the union of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)
