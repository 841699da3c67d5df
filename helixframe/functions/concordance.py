"""Kendall's concordance of many pairs of vectors at once, in O(n log n) time and linear memory."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Concordance:
    """Per vector pair: n, S (concordant less discordant pairs), and of each side the sums over groups of t ties of
    t (t - 1), t (t - 1) (t - 2) and t (t - 1) (2 t + 5)."""

    n: np.ndarray
    s: np.ndarray
    x: tuple[np.ndarray, np.ndarray, np.ndarray]
    y: tuple[np.ndarray, np.ndarray, np.ndarray]

    def tau_b(self) -> np.ndarray:
        pairs = self.n * (self.n - 1.0)
        bottom = np.sqrt(np.maximum(pairs - self.x[0], 0) * np.maximum(pairs - self.y[0], 0))
        return np.divide(2.0 * self.s, bottom, out=np.zeros(len(self.n)), where=bottom > 0)

    def z(self) -> np.ndarray:
        """S over its standard deviation without association, corrected for ties; 0 where that is 0."""
        n = self.n.astype(float)
        var = (n * (n - 1) * (2 * n + 5) - self.x[2] - self.y[2]) / 18
        two, three = 2 * n * (n - 1), 9 * n * (n - 1) * (n - 2)
        var += np.divide(self.x[0] * self.y[0], two, out=np.zeros(len(n)), where=two > 0)
        var += np.divide(self.x[1] * self.y[1], three, out=np.zeros(len(n)), where=three > 0)
        return np.divide(self.s, np.sqrt(np.maximum(var, 0)), out=np.zeros(len(n)), where=var > 0)

    def untied(self) -> np.ndarray:
        return (self.x[0] == 0) & (self.y[0] == 0)


def _ties(group: np.ndarray, new: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over runs of equal values in order; ``new`` marks where one begins, ``group`` is each value's vector."""
    first = np.flatnonzero(new)
    t = np.diff(np.append(first, len(new))).astype(float)
    own = group[first]
    return tuple(np.bincount(own, w, groups) for w in (t * (t - 1), t * (t - 1) * (t - 2), t * (t - 1) * (2 * t + 5)))


def inversions(keys: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Per group, pairs in order whose first key is the larger one. Groups stand together; keys are 0 or more.

    The keys are merge-sorted from the top: a stable partition by each bit, from the highest, puts zeros before ones
    within their run of equal higher bits, and a zero passes every one that stands before it there.
    """
    total, n = np.zeros(groups, np.int64), len(keys)
    if not n:
        return total
    runs = np.append(0, np.flatnonzero(np.diff(group)) + 1)  # where runs of equal higher bits begin
    for bit in range(int(keys.max()).bit_length() - 1, -1, -1):
        one = (keys >> bit) & 1
        size = np.diff(np.append(runs, n))
        before = np.cumsum(one) - one  # ones before, from the start
        at_start = before[runs]
        ones = np.append(at_start[1:], before[-1] + one[-1]) - at_start
        inside = before - np.repeat(at_start, size)
        zero = one == 0
        total += np.bincount(group[zero], inside[zero], groups).astype(np.int64)
        place = np.where(zero, np.arange(n) - inside, np.repeat(runs + size - ones, size) + inside)
        keys_, group_ = np.empty_like(keys), np.empty_like(group)
        keys_[place], group_[place] = keys, group
        keys, group = keys_, group_
        runs = np.unique(np.concatenate([runs, (runs + size - ones)[(ones > 0) & (ones < size)]]))
    return total


def concordance(x: np.ndarray, y: np.ndarray, group: np.ndarray, groups: int) -> Concordance:
    """Knight's method for vectors that stand one after another: ``group`` is each value's vector, from 0, not falling.

    Rows are ordered by x, then y; the y's inversions are the discordant pairs, and concordant ones are all the others
    without ties.
    """
    n = np.bincount(group, minlength=groups)
    order = np.lexsort((y, x, group))
    xs, ys = x[order], y[order]
    first = np.append(True, np.diff(group) != 0) if len(group) else np.zeros(0, bool)
    new_x = first | np.append(True, xs[1:] != xs[:-1])[: len(xs)]
    new_xy = new_x | np.append(True, ys[1:] != ys[:-1])[: len(ys)]
    by_y = np.lexsort((y, group))
    yy = y[by_y]
    new_y = first | np.append(True, yy[1:] != yy[:-1])[: len(yy)]
    rank = np.empty(len(y), np.int64)
    rank[by_y] = np.cumsum(new_y)  # equal within a vector where values are
    tx, ty, both = _ties(group, new_x, groups), _ties(group, new_y, groups), _ties(group, new_xy, groups)
    # ranks from 0 in each vector, so that there are no more bits than one vector needs
    start = np.full(groups, len(y) + 1)
    np.minimum.at(start, group, rank)
    discordant = inversions(rank[order] - start[group], group, groups)
    s = (n * (n - 1) - tx[0].astype(np.int64) - ty[0].astype(np.int64) + both[0].astype(np.int64)) // 2 - 2 * discordant
    return Concordance(n, s, tx, ty)
