"""Density regimes: mixtures, boundaries, Potts labelling, directed growth."""

from __future__ import annotations

from heapq import heappop, heappush
from math import inf, log, pi, sqrt

import numpy as np

from .near import joined

Adjacency = tuple[np.ndarray, np.ndarray]

MOST_ROUNDS, SETTLED, STARVED = 100, 1e-5, 1e-12


def mixture(x: np.ndarray, k: int) -> dict[str, list[float]] | None:
    """A Gaussian mixture of k parts on a line by expectation maximisation, parts by ascending mean; None if it fails."""
    x = np.asarray(x, float)
    n = len(x)
    if n < k or x.min() == x.max():
        return None
    s = np.sort(x)
    mean = np.array([s[min(int(j / (k + 1) * n), n - 1)] for j in range(1, k + 1)])
    var, weight = np.full(k, max(x.var(ddof=1), 1e-10)), np.full(k, 1 / k)
    before = -inf
    for _ in range(MOST_ROUNDS):
        t = np.log(weight) - 0.5 * np.log(2 * pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        top = t.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(t - top).sum(1))
        r = np.exp(t - total[:, None])
        mass = r.sum(0)
        if (mass < STARVED).any():
            return None
        mean = (r * x[:, None]).sum(0) / mass
        var = np.maximum((r * (x[:, None] - mean) ** 2).sum(0) / mass, 1e-12)
        weight = mass / n
        now = total.sum()
        if abs(now - before) < SETTLED:
            break
        before = now
    o = np.argsort(mean, kind="stable")
    return {"means": mean[o].tolist(), "vars": var[o].tolist(), "weights": weight[o].tolist()}


def boundary(m1: float, v1: float, w1: float, m2: float, v2: float, w2: float) -> float:
    """Where two weighted Gaussians are equal, between their means; their midpoint if nowhere."""
    a = 1 / (2 * v2) - 1 / (2 * v1)
    b = m1 / v1 - m2 / v2
    c = m2 * m2 / (2 * v2) - m1 * m1 / (2 * v1) + log(w1 / sqrt(v1)) - log(w2 / sqrt(v2))
    if abs(a) < 1e-12:
        roots = [-c / b] if b else []
    else:
        disc = b * b - 4 * a * c
        roots = [(-b + sgn * sqrt(disc)) / (2 * a) for sgn in (1, -1)] if disc >= 0 else []
    found = [r for r in roots if m1 <= r <= m2]
    return found[0] if found else (m1 + m2) / 2


def costs(x: np.ndarray, gaussians: dict | None = None, thresholds: list[float] | None = None) -> np.ndarray:
    """A cost for each point and regime: negative log weighted density, or 0 in its own bin and 1e6 elsewhere."""
    if thresholds is not None:
        own = np.searchsorted(np.asarray(thresholds, float), x, side="right")
        return np.where(own[:, None] == np.arange(len(thresholds) + 1), 0.0, 1e6)
    m, v, w = (np.asarray(gaussians[c], float) for c in ("means", "vars", "weights"))
    w = w / w.sum()
    return 0.5 * np.log(2 * pi * v) + (x[:, None] - m) ** 2 / (2 * v) - np.log(w)


def smoothness(u: np.ndarray) -> float:
    """Median absolute deviation of the costs' range, floored."""
    r = u.max(1) - u.min(1)
    return max(1e-6, float(np.median(np.abs(r - np.median(r)))))


def potts(u: np.ndarray, near: Adjacency, smooth: float, rounds: int) -> np.ndarray:
    """Regimes from 0: points in order take the cheapest given their neighbours, until none changes.

    A round looks only at points that may change: those that are not the cheapest as things stand, and neighbours of those that change.
    """
    n, k = u.shape
    z = u.argmin(1)
    first, to = near
    counts = np.zeros((n, k), np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    for j in range(k):
        counts[:, j] = np.bincount(owner[z[to] == j], minlength=n)
    del owner
    size = np.diff(first)
    best = z.copy()
    for i in range(0, n, 1 << 16):
        at = slice(i, i + (1 << 16))
        best[at] = np.where(size[at] > 0, (u[at] + smooth * (size[at, None] - counts[at])).argmin(1), u[at].argmin(1))
    now, later = np.flatnonzero(best != z).tolist(), set()
    for _ in range(rounds):
        if not now:
            break
        waits, later = set(now), set()
        while now:
            i = heappop(now)
            waits.discard(i)
            c = u[i] + smooth * (size[i] - counts[i]) if size[i] else u[i]
            j = int(c.argmin())
            if j == z[i]:
                continue
            q = to[first[i] : first[i + 1]]
            counts[q, z[i]] -= 1
            counts[q, j] += 1
            z[i] = j
            for m in q.tolist():
                if m <= i:
                    later.add(m)
                elif m not in waits:
                    waits.add(m)
                    heappush(now, m)
        now = sorted(later)
    return z


def neighbours(n: int, edges: np.ndarray) -> Adjacency:
    """Adjacency of undirected edges (each once), ascending: where each point's neighbours begin, and the neighbours."""
    a, b = (edges[:, i].astype(np.int32) for i in (0, 1)) if len(edges) else (np.empty(0, np.int32),) * 2
    code = np.r_[a.astype(np.int64) * n + b, b.astype(np.int64) * n + a]
    code.sort()
    at = np.searchsorted(code, np.arange(n + 1, dtype=np.int64) * n)
    code %= max(n, 1)
    return at, code.astype(np.int32)


def parts(n: int, near: Adjacency, inside: np.ndarray) -> np.ndarray:
    """Components among the points inside, numbered from 1 in the order of their first point; 0 elsewhere."""
    first, to = near
    i = np.repeat(np.arange(n, dtype=np.int32), np.diff(first))
    ok = inside[i] & inside[to] & (i < to)
    root = joined(np.arange(n), i[ok], to[ok])
    out = np.zeros(n, int)
    out[inside] = np.unique(root[inside], return_inverse=True)[1] + 1
    return out


def grown(near: list[np.ndarray], seed: np.ndarray, support: np.ndarray, min_points: int) -> np.ndarray:
    """Growth along directed edges over support points, from each in order that no growth has met; kept with a seed and min_points, numbered from 1."""
    n = len(seed)
    met, out, k = np.zeros(n, bool), np.zeros(n, int), 0
    for i in range(n):
        if met[i] or not support[i]:
            continue
        met[i], group, todo = True, [i], [i]
        while todo:
            for j in near[todo.pop(0)].tolist():
                if support[j] and not met[j]:
                    met[j] = True
                    group.append(j)
                    todo.append(j)
        if len(group) >= min_points and seed[group].any():
            k += 1
            out[group] = k
    return out
