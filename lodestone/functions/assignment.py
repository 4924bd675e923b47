"""One-to-one assignment in numpy: the only primitive Spark has no expression for."""

from __future__ import annotations

import numpy as np


def assign_max(gain: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of largest total gain, for (m, n) with m <= n.

    Shortest augmenting paths with dual prices; each step relaxes all columns at once.
    """
    m, n = gain.shape
    cost = gain.max(initial=0.0) - gain
    row_price, col_price = np.zeros(m), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(m):
        reach, came = np.full(n, np.inf), np.full(n, -1)
        closed = np.zeros(n, bool)
        row, low, last = start, 0.0, -1
        while True:
            path = low + cost[row] - row_price[row] - col_price
            better = ~closed & (path < reach)
            reach[better], came[better] = path[better], last
            col = int(np.argmin(np.where(closed, np.inf, reach)))
            low = reach[col]
            closed[col] = True
            last = col
            if owner[col] < 0:
                break
            row = owner[col]
        inside = closed & (reach < low)
        row_price[start] += low
        held = np.flatnonzero(inside & (owner >= 0))
        row_price[owner[held]] += low - reach[held]
        col_price[inside] -= low - reach[inside]
        while last >= 0:
            before = came[last]
            owner[last] = start if before < 0 else owner[before]
            last = before
    out = np.full(m, -1)
    out[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return out


def assignment_scores(sim: np.ndarray, threshold: float) -> tuple[float, float]:
    """``(quality, ratio)`` of the assignment with most pairs at ``threshold``, then most total similarity.

    Quality is the mean similarity over all min(m, n) pairs, ratio the hits by all rows; 0 for an empty side.
    """
    m, n = sim.shape
    if not m or not n:
        return 0.0, 0.0
    small = min(m, n)
    gain = np.clip(sim, -1.0, 1.0) + (sim >= threshold) * (2.0 * small + 1.0)
    if m <= n:
        rows, cols = np.arange(m), assign_max(gain)
    else:
        cols, rows = np.arange(n), assign_max(gain.T)
    chosen = sim[rows, cols]
    return float(chosen.mean()), float((chosen >= threshold).sum() / m)
