"""Cheapest transport between two sets of masses over edges that are known.

Costs and masses are whole numbers, so that an edge is tight or it isn't. A plan
is found by shortest augmenting paths from all rows with mass left at once: a
phase finds the distances to the nearest half of the columns that lack some,
adds them to the prices, and sends mass along the trees of these paths.
"""

from __future__ import annotations

import numpy as np

FAR = np.int64(1) << 62
#: share of the lacking columns that a phase looks for; of the open rows, those nearest, that a step takes
SHARE, PART = 0.5, 0.2


def corners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the edges of a plan that serves masses in their order."""
    a, b = np.cumsum(a), np.cumsum(b)
    ends = np.union1d(a, b)
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def plan(i: np.ndarray, j: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray) -> None:
    """Brings prices u (rows) and v (columns) and masses x (edges) to a cheapest
    plan, in place. Edges are in the order of rows i; u[i] + v[j] <= c on all of
    them, with equality where x isn't nought; some plan over them serves all masses."""
    n, m = len(a), len(b)
    start = np.searchsorted(i, np.arange(n + 1))
    left, lack = a.copy(), b.copy()
    np.subtract.at(left, i, x)
    np.subtract.at(lack, j, x)
    while (sources := np.flatnonzero(left)).size:
        wanting = np.flatnonzero(lack)
        many = int(len(wanting) * SHARE)
        r = c - u[i]
        r -= v[j]
        used = np.flatnonzero(x)
        used_i, used_j = i[used], j[used]
        # distances of rows and columns, and the edges by which they are reached
        to_row, to_col = np.full(n, FAR), np.full(m, FAR)
        by_row, by_col = np.full(n, -1), np.full(m, -1)
        to_row[sources] = 0
        front, bound = sources, FAR
        while front.size:
            later = front[:0]
            if len(front) > 64:
                d = to_row[front]
                near = d <= np.partition(d, int(len(d) * PART))[int(len(d) * PART)]
                later, front = front[~near], front[near]
            size = start[front + 1] - start[front]
            e = np.repeat(start[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
            d, q = np.repeat(to_row[front], size) + r[e], j[e]
            better = (d < to_col[q]) & (d < bound)
            e, d, q = e[better], d[better], q[better]
            np.minimum.at(to_col, q, d)
            won = d == to_col[q]
            by_col[q[won]] = e[won]
            bound = min(bound, np.partition(to_col[wanting], many)[many] + 1)
            # back along the edges in use, at no cost
            fresh = np.zeros(m, bool)
            fresh[q] = True
            e = used[fresh[used_j] & (to_col[used_j] < to_row[used_i])]
            p, d = i[e], to_col[j[e]]
            np.minimum.at(to_row, p, d)
            won = d == to_row[p]
            by_row[p[won]] = e[won]
            front = np.union1d(p, later)
            front = front[to_row[front] < bound]
        top = bound - 1 if bound < FAR else max(d[d < FAR].max(initial=0) for d in (to_row, to_col))
        u -= np.minimum(to_row, top)
        v += np.minimum(to_col, top)
        ends = wanting[to_col[wanting] <= top]
        for end in ends[np.argsort(to_col[ends], kind="stable")].tolist():
            col, most, path = end, int(lack[end]), []
            while most:
                path.append(int(by_col[col]))
                row = int(i[path[-1]])
                back = int(by_row[row])
                if back < 0:
                    most = min(most, int(left[row]))
                    break
                path.append(back)
                most, col = min(most, int(x[back])), int(j[back])
            if most:
                for k, e in enumerate(path):
                    x[e] += -most if k % 2 else most
                left[row] -= most
                lack[end] -= most
