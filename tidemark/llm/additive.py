"""Generalised additive models with pairwise interactions: cyclic boosting of shallow trees into lookup tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> int:
    """Where splitting ordered bins in two gains the most; 0: nowhere."""
    if len(g) < 2:
        return 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + lam) + (g.sum() - gl) ** 2 / (h.sum() - hl + lam) - g.sum() ** 2 / (h.sum() + lam)
    k = int(np.argmax(gain))
    return k + 1 if gain[k] > 1e-9 else 0


def _tree(g: np.ndarray, h: np.ndarray, depth: int, lam: float) -> np.ndarray:
    """Newton step of each bin by a tree of that depth over the ordered bins."""
    cut = _best_cut(g, h, lam) if depth else 0
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + lam))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, lam), _tree(g[cut:], h[cut:], depth - 1, lam)])


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    """Newton step of each cell by the two cuts, one of either axis, whose four quarters gain the most together."""
    gs, hs = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (g, h))

    def quarters(s: np.ndarray) -> tuple[np.ndarray, ...]:
        first, left, top, all_ = s, s[:, -1:], s[-1:, :], s[-1, -1]
        return first, left - first, top - first, all_ - left - top + first

    gain = sum(a**2 / (b + lam) for a, b in zip(quarters(gs), quarters(hs)))
    a, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows in (slice(0, a), slice(a, None)):
        for columns in (slice(0, b), slice(b, None)):
            out[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + lam)
    return out


@dataclass
class AdditiveModel:
    names: list[str]
    cuts: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.intercept)
        for k, t in enumerate(self.tables):
            total += t[bins[:, k]]
        for a, b, t in self.pairs:
            total += t[bins[:, a], bins[:, b]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(self.bins(np.nan_to_num(x))))


def fit(names: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 150, n_bins: int = 24, n_pairs: int = 3, rate: float = 0.15, lam: float = 1.0) -> AdditiveModel:
    """Fits the main effects in turn for `rounds` cycles, then the pairs whose cells explain most of what is left. Without rows of both classes: the constant share."""
    x = np.nan_to_num(x)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for k in range(len(names))]
    model = AdditiveModel(names, cuts)
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(c) + 1) for c in cuts]
    if not 0 < y.sum() < len(y):
        return model
    bins = model.bins(x)
    margin = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            p = sigmoid(margin)
            g = np.bincount(bins[:, k], y - p, len(t))
            h = np.bincount(bins[:, k], p * (1 - p), len(t))
            step = rate * _tree(g, h, 2, lam)
            t += step
            margin += step[bins[:, k]]
    p = sigmoid(margin)
    worth = []
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            shape = (len(model.tables[a]), len(model.tables[b]))
            cell = bins[:, a] * shape[1] + bins[:, b]
            g, h = np.bincount(cell, y - p, shape[0] * shape[1]), np.bincount(cell, p * (1 - p), shape[0] * shape[1])
            worth.append((float((_pair_tree(g.reshape(shape), h.reshape(shape), lam).ravel() * g).sum()), a, b, shape, cell))
    for _, a, b, shape, cell in sorted(worth, key=lambda w: -w[0])[:n_pairs]:
        t = np.zeros(shape)
        for _ in range(rounds // 3):
            p = sigmoid(margin)
            g, h = np.bincount(cell, y - p, t.size).reshape(shape), np.bincount(cell, p * (1 - p), t.size).reshape(shape)
            step = rate * _pair_tree(g, h, lam)
            t += step
            margin += step.ravel()[cell]
        model.pairs.append((a, b, t))
    return model
