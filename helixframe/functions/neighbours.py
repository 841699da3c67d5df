"""Nearest neighbours in the plane by the larger coordinate difference, exact, on integer coordinates.

A k-d tree of equal leaves is built and searched level by level in numpy: at every level all open (query, node) pairs
are tested together, so there is no step a point in Python and memory is linear in the points and the hits.
"""

from __future__ import annotations

import numpy as np

#: Points of a leaf.
LEAF = 16
#: Queries searched together.
AT_ONCE = 1 << 14
#: No distance; coordinates are within a quarter of it.
FAR = np.int64(1) << np.int64(62)


class KdTree:
    """Points ``x``, ``y`` (integers of at most 60 bits); leaves in order of their bounding boxes' halves."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n = len(x)
        self.levels = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        leaves = 1 << self.levels
        order = np.arange(n)
        node = np.zeros(n, np.int64)
        for level in range(self.levels):
            # each node is cut in the middle of its wider side
            start = np.searchsorted(node, np.arange(1 << level))
            if n == 0:
                break
            filled = np.diff(np.append(start, n)) > 0
            at = np.minimum(start, n - 1)
            spans = []
            for c in (x[order], y[order]):
                span = np.zeros(len(at))
                lows, highs = np.minimum.reduceat(c, at[filled]), np.maximum.reduceat(c, at[filled])
                span[filled] = highs.astype(float) - lows
                spans.append(span)
            wide_y = spans[1] > spans[0]
            key = np.where(wide_y[node], y[order], x[order])
            turn = np.lexsort((key, node))
            order, node = order[turn], node[turn]
            size = np.diff(np.append(start, n))
            place = np.arange(n) - start[node]
            node = node * 2 + (place >= (size[node] + 1) // 2)
        start = np.searchsorted(node, np.arange(leaves))
        size = np.diff(np.append(start, n))
        self.width = int(size.max(initial=1))
        slot = np.arange(n) - start[node] if n else np.zeros(0, np.int64)
        self.x, self.y = np.full((leaves, self.width), FAR // 2), np.full((leaves, self.width), FAR // 2)
        self.x[node, slot], self.y[node, slot] = x[order], y[order]
        self.leaf = np.empty(n, np.int64)
        self.leaf[order] = node
        inside = self.x < FAR // 2
        box = [np.where(inside, c, v).min(axis=1) if low else np.where(inside, c, v).max(axis=1) for c, low, v in ((self.x, True, FAR // 2), (self.x, False, -FAR // 2), (self.y, True, FAR // 2), (self.y, False, -FAR // 2))]
        self.boxes = [None] * (self.levels + 1)
        self.boxes[self.levels] = box
        for level in range(self.levels - 1, -1, -1):
            box = [b.reshape(-1, 2).min(axis=1) if k % 2 == 0 else b.reshape(-1, 2).max(axis=1) for k, b in enumerate(box)]
            self.boxes[level] = box

    def _distances(self, leaf: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(self.x[leaf] - x[:, None]), np.abs(self.y[leaf] - y[:, None]))

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
        """(queries, k): the k least distances to points, rising. Distances over ``bound`` may be missing, as FAR, as are
        those that are not there. ``own``: a leaf of each query whose points give a first bound."""
        out = np.full((len(x), k), FAR)
        for i in range(0, len(x), AT_ONCE):
            part = slice(i, i + AT_ONCE)
            out[part] = self._nearest(x[part], y[part], k, None if bound is None else bound[part], None if own is None else own[part])
        return out

    def _nearest(self, x: np.ndarray, y: np.ndarray, k: int, bound: np.ndarray | None, own: np.ndarray | None) -> np.ndarray:
        m = len(x)
        limit = np.full(m, FAR) if bound is None else bound.copy()
        if own is not None and self.width >= k:
            limit = np.minimum(limit, np.partition(self._distances(own, x, y), k - 1, axis=1)[:, k - 1])
        query, node = np.arange(m), np.zeros(m, np.int64)
        for level in range(self.levels + 1):
            if level:
                query, node = np.repeat(query, 2), np.repeat(node * 2, 2)
                node[1::2] += 1
            x0, x1, y0, y1 = (b[node] for b in self.boxes[level])
            qx, qy = x[query], y[query]
            gap = np.maximum(np.maximum(x0 - qx, qx - x1), np.maximum(y0 - qy, qy - y1))
            near = (gap <= limit[query]) & (x0 <= x1)
            query, node = query[near], node[near]
        d = self._distances(node, x[query], y[query])
        if d.shape[1] > k:
            d = np.partition(d, k - 1, axis=1)[:, :k]
        each, d = np.repeat(query, d.shape[1]), d.ravel()
        there = d < FAR // 4
        each, d = each[there], d[there]
        order = np.lexsort((d, each))
        each, d = each[order], d[order]
        first = np.searchsorted(each, np.arange(m))
        rank = np.arange(len(d)) - first[each]
        out = np.full((m, k), FAR)
        best = rank < k
        out[each[best], rank[best]] = d[best]
        return out


def nearest_others(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, KdTree]:
    """(points, k): the k least distances of every point to the other points, and the tree of the points."""
    tree = KdTree(x, y)
    return tree.nearest(x, y, k + 1, own=tree.leaf)[:, 1:], tree
