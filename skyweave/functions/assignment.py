"""One-to-one assignment of a small contingency table, on the driver."""

import numpy as np


def best_match(counts: np.ndarray) -> dict[int, int]:
    """row -> column with the largest total count (Hungarian method with potentials, O(n^3))."""
    n = max(counts.shape) if counts.size else 0
    cost = np.zeros((n + 1, n + 1))
    cost[1 : counts.shape[0] + 1, 1 : counts.shape[1] + 1] = -counts
    u, v, owner = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int)
    for row in range(1, n + 1):
        owner[0], column = row, 0
        least, way, used = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while True:
            used[column] = True
            r = owner[column]
            reduced = cost[r] - u[r] - v
            better = ~used & (reduced < least)
            better[0] = False
            least[better], way[better] = reduced[better], column
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nxt = int(np.argmin(free))
            delta = free[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            column = nxt
            if owner[column] == 0:
                break
        while column:
            owner[column] = owner[way[column]]
            column = way[column]
    return {int(owner[c]) - 1: c - 1 for c in range(1, n + 1) if owner[c] <= counts.shape[0] and c <= counts.shape[1]}
