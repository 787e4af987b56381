"""Merging of one word by ranked pairs, held in contiguous arrays.

Two parallel lists describe a word: where its parts begin, and the rank of
joining each part with the next. A merge deletes one boundary and looks two
ranks up again, which for short words is quicker than any linked structure.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Mapping
from itertools import repeat

#: Longer words go through a heap, as scanning them takes quadratic time.
SCANNED_PARTS = 160
_NEVER = float("inf")


def pair(left: str, right: str) -> tuple[str, str]:
    """The key of merges that are listed by their two parts; ``operator.add`` is that of merges listed by result."""
    return left, right


def merge_scanning(parts: list[str], ranks: Mapping, key: Callable) -> list[str]:
    """Merge the adjacent pair of least rank, the leftmost first, until none has a rank."""
    rank_of = ranks.get
    follows = map(rank_of, map(key, parts, parts[1:]) if key is not pair else zip(parts, parts[1:]), repeat(_NEVER))
    adjacent = list(follows)
    while adjacent:
        least = min(adjacent)
        if least == _NEVER:
            break
        at = adjacent.index(least)
        parts[at] += parts[at + 1]
        del parts[at + 1], adjacent[at]
        if at < len(adjacent):
            adjacent[at] = rank_of(key(parts[at], parts[at + 1]), _NEVER)
        if at:
            adjacent[at - 1] = rank_of(key(parts[at - 1], parts[at]), _NEVER)
    return parts


def merge_heap(parts: list[str], ranks: Mapping, key: Callable) -> list[str]:
    """The same result for long words, in O(n log n)."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    version = [0] * n
    queue = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(key(parts[i], parts[j]))) is not None:
            heapq.heappush(queue, (rank, i, version[i], version[j]))

    for i in range(n - 1):
        offer(i)
    while queue:
        _, i, mine, theirs = heapq.heappop(queue)
        j = after[i] if version[i] == mine else n
        if j >= n or version[j] != theirs:
            continue
        parts[i] += parts[j]
        version[i] += 1
        version[j] = -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [part for part, v in zip(parts, version) if v >= 0]


def merge(letters: Iterable[str], ranks: Mapping, key: Callable) -> list[str]:
    """Merge the letters of one word; pairs whose key has no rank stay apart."""
    parts = list(letters)
    return (merge_scanning if len(parts) <= SCANNED_PARTS else merge_heap)(parts, ranks, key)


class Bounded(dict):
    """A cache that starts anew when it is full, so that a worker's memory stays bounded."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        self[key] = value = self.make(key)
        return value
