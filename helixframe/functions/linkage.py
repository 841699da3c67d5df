"""Average-linkage clustering of a small matrix of distances by nearest-neighbour chains."""

from __future__ import annotations

import numpy as np


def average_linkage(distances: np.ndarray) -> list[tuple[int, int, float]]:
    """The merges (one member of either side, height) from the lowest up, of a symmetric matrix of distances.

    A chain goes from cluster to nearest cluster until two are each other's nearest; they merge, and the distances to the
    merged one are the size-weighted means of theirs (Lance and Williams). Merges can be sorted afterwards, as average
    linkage never inverts heights.
    """
    d = distances.astype(float).copy()
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, chain, merges = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            row = np.where(alive, d[chain[-1]], np.inf)
            near = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]  # ties stay with where the chain came from, or it might not end
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        merges.append((a, b, float(d[a, b])))
        d[b] = d[:, b] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[b, b] = np.inf
        size[b] += size[a]
        alive[a] = False
    return [merges[i] for i in np.argsort([m[2] for m in merges], kind="stable")]


def leaf_order(distances: np.ndarray) -> list[int]:
    """Items in the order of the tree's leaves; of two merged clusters the one that was made earlier stands left (items
    before clusters, by number)."""
    n = len(distances)
    number, leaves = {i: i for i in range(n)}, {i: [i] for i in range(n)}
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (a, b, _) in enumerate(average_linkage(distances)):
        a, b = root(a), root(b)
        left, right = sorted((a, b), key=number.__getitem__)
        leaves[a] = leaves[left] + leaves[right]
        parent[b], number[a] = a, n + k
    return leaves[root(0)] if n else []
