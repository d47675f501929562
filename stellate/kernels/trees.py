"""Cluster trees: density-based hierarchies and agglomerative linkage."""

from __future__ import annotations

import numpy as np


class Sets:
    """Disjoint sets by size, with path halving."""

    def __init__(self, n: int):
        self.up, self.size = list(range(n)), [1] * n

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        if self.size[i] < self.size[j]:
            i, j = j, i
        self.up[j] = i
        self.size[i] += self.size[j]
        return True


def _spanning_tree(x: np.ndarray, src: np.ndarray, dst: np.ndarray, d: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of mutual reachability on the given edges, with nearest-point bridges between parts that they leave apart."""
    n = len(x)
    w = np.maximum(d, np.maximum(core[src], core[dst]))
    sets, tree = Sets(n), []
    for e in np.lexsort((dst, src, w)).tolist():
        if sets.join(int(src[e]), int(dst[e])):
            tree.append((float(w[e]), int(src[e]), int(dst[e])))
            if len(tree) == n - 1:
                return tree
    while len(tree) < n - 1:
        part = np.array([sets.find(i) for i in range(n)])
        bridges = []
        for i in range(n):
            q = ((x - x[i]) ** 2).sum(1)
            q[part == part[i]] = np.inf
            j = int(q.argmin())
            bridges.append((float(max(np.sqrt(q[j]), core[i], core[j])), i, j))
        for b in sorted(bridges):
            if sets.join(b[1], b[2]):
                tree.append(b)
    return tree


def _linkage(tree: list[tuple[float, int, int]], n: int) -> list[tuple[int, int, float, int]]:
    """Single linkage: (left, right, height, size) for inner nodes n, n + 1, ..."""
    sets, node, out = Sets(n), list(range(n)), []
    size = [1] * n
    for w, a, b in sorted(tree):
        i, j = sets.find(a), sets.find(b)
        l, r = node[i], node[j]
        out.append((l, r, w, size[i] + size[j]))
        s = size[i] + size[j]
        sets.join(i, j)
        k = sets.find(i)
        node[k], size[k] = n + len(out) - 1, s
    return out


def hdbscan(x: np.ndarray, src: np.ndarray, dst: np.ndarray, d: np.ndarray, core: np.ndarray, min_size: int, method: str = "eom", allow_single: bool = False, halo: float = 0.10) -> tuple[np.ndarray, list[float], list[float]]:
    """(labels from 1, persistence and birth density of each cluster); 0 is noise."""
    n = len(x)
    labels = np.zeros(n, int)
    if n < min_size or n < 2:
        return labels, [], []
    merges = _linkage(_spanning_tree(x, src, dst, d, core), n)
    size_of = lambda v: 1 if v < n else merges[v - n][3]
    birth, parent, death, stability = [0.0], [-1], [np.inf], [0.0]
    fell = [(0, np.inf)] * n  # cluster and density at which each point leaves it
    stable = np.zeros(n, bool)
    kids: list[list[int]] = [[]]

    def leaves(v: int) -> list[int]:
        out, todo = [], [v]
        while todo:
            u = todo.pop()
            if u < n:
                out.append(u)
            else:
                todo += merges[u - n][:2]
        return out

    todo = [(n + len(merges) - 1, 0)]
    while todo:
        v, c = todo.pop()
        l, r, height, _ = merges[v - n]
        lam = np.inf if height == 0 else 1.0 / height
        add = lambda k: stability.__setitem__(c, stability[c] + (lam - birth[c]) * k if np.isfinite(lam) else stability[c])  # noqa: B023, E731
        big = [u for u in (l, r) if size_of(u) >= min_size]
        if len(big) == 2:
            add(size_of(l) + size_of(r))
            death[c] = lam
            for u in (l, r):
                k = len(birth)
                birth.append(lam)
                parent.append(c)
                death.append(np.inf)
                stability.append(0.0)
                kids.append([])
                kids[c].append(k)
                todo.append((u, k)) if u >= n else fell.__setitem__(u, (k, np.inf))
        elif len(big) == 1:
            small = r if big[0] == l else l
            add(size_of(small))
            for q in leaves(small):
                fell[q] = (c, lam)
            todo.append((big[0], c)) if big[0] >= n else fell.__setitem__(big[0], (c, lam))
        else:
            add(size_of(v))
            death[c] = lam
            for q in leaves(v):
                fell[q] = (c, lam)
                stable[q] = True
    chosen = [False] * len(birth)
    if method == "leaf":
        for c in range(1, len(birth)):
            chosen[c] = not kids[c]
    else:
        best = list(stability)
        for c in range(len(birth) - 1, -1, -1):
            if c == 0 and not allow_single:
                continue
            below = sum(best[k] for k in kids[c])
            if not kids[c] or stability[c] >= below:
                chosen[c] = True
                todo2 = list(kids[c])
                while todo2:
                    k = todo2.pop()
                    chosen[k] = False
                    todo2 += kids[k]
            else:
                best[c] = below
    ids = {c: i + 1 for i, c in enumerate(c for c in range(len(birth)) if chosen[c])}
    for i in range(n):
        own, lam = fell[i]
        c = own
        while c >= 0 and not chosen[c]:
            c = parent[c]
        if c < 0:
            continue
        span = death[own] - birth[own]
        if not stable[i] and halo > 0 and np.isfinite(span) and lam - birth[own] < halo * span:
            continue
        labels[i] = ids[c]
    return labels, [stability[c] for c in ids], [birth[c] for c in ids]


def linkage_labels(x: np.ndarray, method: str, threshold: float | None, n_clusters: int | None) -> np.ndarray:
    """Agglomerative labels from 1 by first appearance: merges up to a height, or down to a number of clusters.

    Distances are updated by the formulas of Lance and Williams along nearest-neighbour chains.
    """
    n = len(x)
    if n == 1:
        return np.ones(1, int)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    size, alive, name = np.ones(n), np.ones(n, bool), list(range(n))
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            i = chain[-1]
            j = int(d[i].argmin())
            if len(chain) > 1 and d[i, chain[-2]] <= d[i, j]:
                j = chain[-2]
                break
            chain.append(j)
        chain = chain[:-2]
        h = d[i, j]
        merges.append((float(h), i, j))
        k = alive.copy()
        k[[i, j]] = False
        a, b = d[i, k], d[j, k]
        si, sj, sk = size[i], size[j], size[k]
        if method == "single":
            new = np.minimum(a, b)
        elif method == "complete":
            new = np.maximum(a, b)
        elif method == "average":
            new = (si * a + sj * b) / (si + sj)
        else:
            new = np.sqrt(np.maximum(((si + sk) * a * a + (sj + sk) * b * b - sk * h * h) / (si + sj + sk), 0))
        d[i, k] = d[k, i] = new
        size[i] += sj
        alive[j] = False
        d[j, :] = d[:, j] = np.inf
    sets = Sets(n)
    merges.sort(key=lambda m: m[0])
    for t, (h, i, j) in enumerate(merges):
        if (threshold is not None and h > threshold) or (n_clusters is not None and t >= n - n_clusters):
            break
        sets.join(i, j)
    del name
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(sets.find(i), len(seen) + 1) for i in range(n)])
