"""Sequence alignment: what has no relational form. Each alignment is small; Spark deals the pairs of sequences to tasks."""

from __future__ import annotations

import difflib
import itertools
from collections.abc import Callable
from functools import lru_cache

import numpy as np

MATCH, COARSE, OTHER, EMPTY, GAP = 2.0, 1.0, -0.5, -0.4, -0.6
#: A token heard that isn't in the text; a word of the text not heard, and the most that a run of those costs; going back.
EXTRA, MISSED, SKIP, BACK, BACK_WORD = 0.60, 0.60, 1.80, 1.60, 0.40


def global_pairs(ref: list[str], heard: list[str], coarse: Callable[[str], str]) -> list[tuple[int, int]]:
    """(ref place, heard place) that match in the best global alignment; of equal ways the diagonal, then the one that skips a ref word."""
    worth = lambda a, b: EMPTY if not a or not b else MATCH if a == b else COARSE if coarse(a) == coarse(b) else OTHER
    n, m = len(ref), len(heard)
    best = np.zeros((n + 1, m + 1))
    best[:, 0], best[0] = np.arange(n + 1) * GAP, np.arange(m + 1) * GAP
    move = np.zeros((n + 1, m + 1), np.int8)
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        ways = (best[i - 1, j - 1] + worth(ref[i - 1], heard[j - 1]), best[i - 1, j] + GAP, best[i, j - 1] + GAP)
        move[i, j] = int(np.argmax(ways))
        best[i, j] = ways[move[i, j]]
    out, i, j = [], n, m
    while i and j:
        if move[i, j] == 0 and worth(ref[i - 1], heard[j - 1]) > 0:
            out.append((i - 1, j - 1))
        i, j = i - (move[i, j] != 2), j - (move[i, j] != 1)
    return out[::-1]


@lru_cache(maxsize=1 << 17)
def alike(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio of two words, remembered by pair for as long as a worker lives, up to a fixed number of pairs."""
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def back_cost(words: int) -> float:
    return BACK + BACK_WORD * words


def with_restarts(ref: list[str], heard: list[str], likeness: Callable[[str, str], float] | None = None) -> tuple[list[tuple[int, int, float]], list[tuple[int, int, int]]]:
    """(events, restarts) of tokens heard against a text that may be taken up again from an earlier word.

    events: (heard place, ref place, likeness); restarts: (heard place, from ref, to ref). The way of
    least cost starts and ends at any word. A step ahead over several words costs at most SKIP, a step
    back BACK and BACK_WORD a word, which is dearer than any detour can save, and cheaper than hearing
    two or more words again is worth.
    """
    like = likeness or alike
    n, m = len(heard), len(ref)
    if not n or not m:
        return [], []
    apart = np.arange(m + 1)[None, :] - np.arange(m + 1)[:, None]
    place = np.arange(m + 1)
    forward = np.where(apart > 0, np.minimum(MISSED * apart, np.where(apart > 1, SKIP, np.inf)), np.where(apart == 0, 0.0, np.inf))
    backward = np.where(apart < 0, BACK - BACK_WORD * apart, np.where(apart == 0, 0.0, np.inf))
    def relaxed(row: np.ndarray) -> tuple[np.ndarray, list[dict]]:
        """Costs after moves within the text, and for each of the three passes where each state came from."""
        passes = []
        for ahead in (True, False, True):
            price = forward if ahead else backward
            ways = row[:, None] + price
            ways[place, place] -= 1e-12  # staying wins a tie
            source = ways.argmin(0)
            row = row[source] + price[source, place]
            passes.append((ahead, source))
        return row, passes

    row, passes = relaxed(np.zeros(m + 1))
    trail = [passes]
    ops = []
    for h in heard:
        cost = np.array([1 - 2 * like(h, r) for r in ref])
        stay, step = row + EXTRA, np.append(np.inf, row[:-1] + cost)
        matched = step < stay
        ops.append((matched, cost))
        row, passes = relaxed(np.where(matched, step, stay))
        trail.append(passes)
    j = int(row.argmin())
    events: list[tuple[int, int, float]] = []
    steps: list[tuple[int, int, int]] = []
    for i in range(n, -1, -1):
        for ahead, source in reversed(trail[i]):
            s = int(source[j])
            if not ahead and s != j:
                steps.append((i, s, j))
            j = s
        if i:
            matched, cost = ops[i - 1]
            if matched[j]:
                events.append((i - 1, j - 1, (1 - cost[j - 1]) / 2))
                j -= 1
    events.reverse()
    restarts = []
    for i, s, to in reversed(steps):
        last = [r for h, r, _ in events if h < i]
        came = last[-1] if last else s
        if to < came:
            restarts.append((i, came, to))
    return events, restarts


def weighted_lcs(a: list[tuple[str, float]], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence of the largest weight, a row at a time: what a row adds is its matches before all that follows them."""
    words = np.array(b, object)
    rows = [np.zeros(len(b) + 1)]
    for word, weight in reversed(a):
        below = rows[-1]
        matched = np.where(words == word, below[1:] + weight, 0.0)
        rows.append(np.maximum.accumulate(np.append(np.maximum(below[:-1], matched), 0.0)[::-1])[::-1])
    rows.reverse()
    out, j = [], 0
    for i, row in enumerate(rows[:-1]):
        # What a row adds over the ones below is a match at the last place from which its best is still reached.
        if row[j] > rows[i + 1][j]:
            j = int(np.flatnonzero(row == row[j])[-1])
            out.append((i, j))
            j += 1
    return out
