"""Suffixes of bytes in order: a mergesort whose comparisons find common extensions by hashes and binary search."""

from __future__ import annotations

import numpy as np

#: Bases of the prefix hashes (odd, so that their powers have inverses). Another one is taken where two strings collide.
BASES = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Suffixes are put in order by so many bytes before the mergesort.
HEAD = 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


class Extensions:
    """Prefix hashes of bytes, for the common extension of two suffixes: polynomials modulo 2**64, from one running sum over inverse powers."""

    def __init__(self, data: np.ndarray, base: int, depth: int):
        self.data, self.power = data, _powers(base, depth + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(pow(base, -1, 2**64), len(data)), out=self.prefix[1:])
        self.prefix *= _powers(base, len(data) + 1)

    def hashes(self, at: np.ndarray, length) -> np.ndarray:
        """Hashes of `length` bytes from each place on."""
        return self.prefix[at + length] - self.prefix[at] * self.power[length]

    def common(self, a: np.ndarray, b: np.ndarray, known: int, most: int) -> np.ndarray:
        """How many bytes, up to `most`, the suffixes at a and b share; `known` of them are known to be equal."""
        out = np.full(len(a), most)
        open_ = np.flatnonzero(self.hashes(a, most) != self.hashes(b, most))
        a, b = a[open_], b[open_]
        low, high = np.full(len(a), known), np.full(len(a), most - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hashes(a, middle) == self.hashes(b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        out[open_] = low
        return out

    def less(self, a: np.ndarray, b: np.ndarray, known: int, depth: int) -> np.ndarray:
        """Whether the suffix at a comes before the one at b, by their first `depth` bytes; the first `known` are equal."""
        n = self.common(a, b, known, depth)
        at = np.minimum(n, depth - 1)
        return (n < depth) & (self.data[a + at] < self.data[b + at])


def heads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that orders like them; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data), ">u8", padded, strides=(1,))


def merged(order: np.ndarray, sizes: np.ndarray, less) -> np.ndarray:
    """Sorts each stretch of `order` (of these sizes, in a row) by mergesort, all stretches at once.

    Two runs are merged by binary search of the left one's elements in the right one; the others take up
    the places left over, in their order. Equal elements keep their order. Stretches that are done drop out.
    """
    order, at, width = order.copy(), np.arange(len(order)), 1
    while True:
        longer = sizes > width
        if not longer.all():
            at, sizes = at[np.repeat(longer, sizes)], sizes[longer]
        if not len(sizes):
            return order
        own, here = order[at], np.arange(len(at))
        last = np.repeat(np.cumsum(sizes), sizes)
        first = last - np.repeat(sizes, sizes)
        run = (here - first) // width
        left = run % 2 == 0
        begin = first + (run + 1) * width
        moving = np.flatnonzero(left & (begin < last))
        low, high = begin[moving], np.minimum(begin + width, last)[moving]
        start, mover = low.copy(), own[moving]
        active = np.arange(len(moving))
        while len(active):
            middle = (low[active] + high[active]) // 2
            smaller = less(own[middle], mover[active])
            low[active] = np.where(smaller, middle + 1, low[active])
            high[active] = np.where(smaller, high[active], middle)
            active = active[low[active] < high[active]]
        shift = np.zeros(len(own), np.int64)
        shift[moving] = low - start
        target = (here + shift)[left]
        free = np.ones(len(own), bool)
        free[target] = False
        out = np.empty_like(own)
        out[target], out[free] = own[left], own[~left]
        order[at] = out
        width *= 2


def _steps(depth: int) -> list[int]:
    """Where stretches of eight bytes begin that cover `depth` bytes."""
    return [*range(0, depth - 8, 8), depth - 8]


def compared(words: np.ndarray, order: np.ndarray, depth: int) -> tuple[np.ndarray, bool]:
    """(whether each suffix begins with the same `depth` bytes as the one before, whether they are in order): by the bytes themselves, eight at a time, without hashes."""
    equal, ordered = np.ones(max(len(order) - 1, 0), bool), True
    for k in _steps(depth):
        x = words[order + k].astype(np.uint64)
        ordered &= bool((~equal | (x[:-1] <= x[1:])).all())
        equal &= x[:-1] == x[1:]
    return np.concatenate([np.zeros(min(len(order), 1), bool), equal]), ordered


def by_head(words: np.ndarray, suffixes: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `known` bytes, how many share each head)."""
    start = words[suffixes].astype(np.uint64)
    order = np.argsort(start)
    start, given = start[order], suffixes[order]
    new = np.concatenate([[True], start[1:] != start[:-1]]) if len(start) else np.empty(0, bool)
    if known > 8:
        size = np.diff(np.append(np.flatnonzero(new), len(start)))
        several = np.flatnonzero(np.repeat(size > 1, size))
        group, then = np.cumsum(new)[several], words[given[several] + known - 8].astype(np.uint64)
        order = np.lexsort((then, group))
        given[several], then = given[several[order]], then[order]
        new[several[1:]] |= then[1:] != then[:-1]
    return given, np.diff(np.append(np.flatnonzero(new), len(start)))


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by hash, how many there are of each, one of each)."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else np.empty(0, np.int64)
    return order, np.diff(np.append(first, len(order))), order[first]


def sort(data: np.ndarray, suffixes: np.ndarray, depth: int, bases=BASES) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first `depth` bytes, whether each shares all of them with the one before).

    Each suffix has `depth` bytes at least. Suffixes with the same hash of those are sorted once. Order and equality are verified on the bytes
    themselves between neighbours; where hashes collided, everything is sorted again with another base, and
    after the last base by the bytes alone.
    """
    words, known = heads(data), min(HEAD, depth)
    for base in bases:
        extensions = Extensions(data, base, depth)
        own, count, one = distinct(extensions.hashes(suffixes, depth))
        given, size = by_head(words, suffixes[one], known)
        several = np.repeat(size > 1, size)
        given[several] = merged(given[several], size[size > 1], lambda a, b: extensions.less(a, b, known, depth))  # noqa: B023  used at once
        number = np.empty(len(data), np.int64)
        number[suffixes[one]] = np.arange(len(one))
        number = number[given]
        count, first = count[number], (np.cumsum(count) - count)[number]
        order = suffixes[own[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(own))]]
        equal, ordered = compared(words, order, depth)
        if ordered:
            return order, equal
    order = suffixes[np.lexsort([words[suffixes + k].astype(np.uint64) for k in reversed(_steps(depth))])]
    return order, compared(words, order, depth)[0]
