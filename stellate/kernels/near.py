"""Pairs of points within a radius, over a grid of cells and a bounded number at a time."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

#: Cells to a radius, and candidates that are tested at once; for `Close`: cells to a radius, and halvings of them for small widths.
FINE, CHUNK, PARTS, HALVINGS = 2, 1 << 20, 3, 7


class Near:
    """Points of many tiles, put in the order of their cells (`order`); tiles are numbered from 0."""

    def __init__(self, x: np.ndarray, tile: np.ndarray, origin: np.ndarray, width: float, radius: float):
        """x: (n, D); origin: the low corner of each point's tile, whose sides are `width`."""
        self.radius, self.width, self.cell = radius, width, radius / FINE
        self.span = int(np.ceil(width / self.cell)) + 2 * FINE + 5
        c = self._cells(x - origin)
        self.order = np.argsort(self._code(tile, c), kind="stable")
        self.x, self.tile, self.origin = x[self.order], tile[self.order], origin[self.order]
        self.code = self._code(self.tile, c[self.order])

    def _cells(self, y: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(y / self.cell) + FINE + 2, 0, self.span - 1).astype(np.int64)

    def _code(self, tile: np.ndarray, c: np.ndarray) -> np.ndarray:
        out = tile.astype(np.int64)
        for i in range(c.shape[1]):
            out = out * self.span + c[:, i]
        return out

    def pairs(self, ask: np.ndarray, strict: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, squared distance), places in the order of cells, for i in `ask` and all j of its tile in the radius, i itself included."""
        x = self.x[ask]
        # the same rounded steps as for cells, so that no neighbour is missed
        reach = self.radius * (1 + 1e-9) + np.abs(x) * 1e-15
        low, high = self._cells(x - reach - self.origin[ask]), self._cells(x + reach - self.origin[ask])
        r2, dims = self.radius * self.radius, x.shape[1]
        most = (high - low).max(0, initial=0)
        for step in product(*[range(m + 1) for m in most[:-1]]):
            at = low[:, :-1] + np.array(step, np.int64)
            use = np.flatnonzero((at <= high[:, :-1]).all(1))
            row = self._code(self.tile[ask[use]], at[use]) * self.span
            a, b = np.searchsorted(self.code, row + low[use, -1]), np.searchsorted(self.code, row + high[use, -1], side="right")
            ends = np.cumsum(b - a)
            first = 0
            while first < len(use):
                before = ends[first - 1] if first else 0
                last = max(int(np.searchsorted(ends, before + CHUNK, side="right")), first + 1)
                n = (b - a)[first:last]
                total = int(ends[last - 1] - before)
                if total:
                    i = np.repeat(ask[use[first:last]], n)
                    j = np.arange(total) + np.repeat(a[first:last] - (ends[first:last] - n - before), n)
                    d = self.x[i, 0] - self.x[j, 0]
                    d2 = d * d
                    for k in range(1, dims):
                        d = self.x[i, k] - self.x[j, k]
                        d2 = d2 + d * d
                    ok = d2 < r2 if strict else d2 <= r2
                    yield i[ok], j[ok], d2[ok]
                first = last

    def rim(self) -> np.ndarray:
        """Whether a point is so near its tile's border, or beyond it, that another tile may have it too."""
        y, reach = self.x - self.origin, self.radius * (1 + 1e-6) + np.abs(self.x) * 1e-12
        return ((y <= reach) | (y >= self.width - reach)).any(1)

    def largest(self, some: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Whether each of the places `some` is of its tile's root that has most of them, the last of equals."""
        n = np.bincount(root[some], minlength=len(root))
        head = np.flatnonzero(n)
        head = head[np.lexsort((n[head], self.tile[head]))]
        most = np.zeros(len(root), bool)
        most[head[np.r_[self.tile[head][1:] != self.tile[head][:-1], True]] if len(head) else head] = True
        return most[root[some]]

    def settled(self, some: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Whether each of the places `some` (in order) has only such of its own root among `some` in reach; False where that isn't known."""
        if not len(some) or float(np.abs(self.x).max()) * 1e-15 > self.cell / 4:
            return np.zeros(len(some), bool)
        code, r = self.code[some], root[some]
        turns = np.r_[0, np.cumsum(r[1:] != r[:-1])]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        c, rest = [], code[first]
        for _ in range(self.x.shape[1]):
            rest, at = np.divmod(rest, self.span)
            c.insert(0, at)
        wide, ok = FINE + 1, np.ones(len(first), bool)
        low, high = np.maximum(c[-1] - wide, 0), np.minimum(c[-1] + wide, self.span - 1)
        for step in product(range(-wide, wide + 1), repeat=len(c) - 1):
            row, there = rest, np.ones(len(first), bool)
            for at, d in zip(c[:-1], step, strict=True):
                there &= (at + d >= 0) & (at + d < self.span)
                row = row * self.span + at + d
            row = row * self.span
            a, b = np.searchsorted(code, row + low), np.searchsorted(code, row + high, side="right")
            a, b = np.where(there, a, 0), np.where(there, b, 0)
            to = np.minimum(a, len(some) - 1)
            ok &= (a == b) | ((turns[np.maximum(b - 1, 0)] == turns[to]) & (r[to] == r[first]))
        return np.repeat(ok, np.diff(np.r_[first, len(some)]))


class Close:
    """Cells of points that are all neighbours of each other, and pairs of cells of which that holds too.

    It is shown by the cells' boxes, in the same rounded steps as for points: none of these is as far apart as a box's corners.
    With widths, a point's cell is as small as its own width asks.
    """

    def __init__(self, near: Near, rows: np.ndarray, sigma: np.ndarray | None = None, nsigma: float | None = None):
        """rows: places of near; those that fit no cell have none."""
        level, (n, dims) = np.zeros(len(rows), np.int64), (len(rows), near.x.shape[1])
        if nsigma is not None:
            with np.errstate(all="ignore"):
                level = np.ceil(np.log2(near.radius / np.minimum(near.radius, nsigma * 2 * sigma[rows])))
            fits = level <= HALVINGS
            rows, level = rows[fits], level[fits].astype(np.int64)
        tile = near.tile[rows]
        c = np.floor((near.x[rows] - near.origin[rows]) / (near.radius / PARTS) * (1 << level)[:, None]).astype(np.int64)
        # beyond a tile there is a radius, and a cell of margin
        self._span = ((near.span // FINE + 4) * PARTS << HALVINGS) + 4
        code = self._code(tile, level, c)
        order = np.argsort(code, kind="stable")
        self.rows, code = rows[order], code[order]
        self.first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
        self.cell = np.repeat(np.arange(len(self.first)), np.diff(np.r_[self.first, len(code)]))
        self._code_of = code[self.first]
        tile, level, c = (v[order][self.first] for v in (tile, level, c))
        self._r2, self._nsigma = near.radius * near.radius, nsigma
        x = near.x[self.rows]
        self._low, self._high = (f.reduceat(x, self.first, axis=0) if len(x) else np.empty((0, dims)) for f in (np.minimum, np.maximum))
        self._least = None if nsigma is None else np.minimum.reduceat(sigma[self.rows], self.first) if len(x) else np.empty(0)
        every = np.arange(len(self.first))
        self.whole = self._close(every, every)
        found = []
        for step in product((-1, 0, 1), repeat=dims):
            if step > (0,) * dims:
                found.append((every, self._code(tile, level, c + np.array(step))))
        for up in range(1, int(level.max(initial=0)) + 1):
            deep = np.flatnonzero(level >= up)
            found.append((deep, self._code(tile[deep], level[deep] - up, c[deep] >> up)))
        ends = []
        for a, to in found:
            b = np.searchsorted(self._code_of, to)
            b[b == len(self._code_of)] = 0
            ok = self._code_of[b] == to if len(self._code_of) else np.zeros(len(a), bool)
            a, b = a[ok], b[ok]
            ok = self._close(a, b)
            ends.append((a[ok], b[ok]))
        self.a, self.b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))

    def _code(self, tile: np.ndarray, level: np.ndarray, c: np.ndarray) -> np.ndarray:
        span = (self._span >> HALVINGS << level) + 4
        out = np.clip(c[:, 0] + (2 * PARTS << level), 0, span - 1)
        for i in range(1, c.shape[1]):
            out = out * span + np.clip(c[:, i] + (2 * PARTS << level), 0, span - 1)
        return (tile * (HALVINGS + 1) + level) * (self._span + 4) ** c.shape[1] + out

    def _close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all points of cells a are neighbours of all points of cells b."""
        d = np.maximum(self._high[a], self._high[b]) - np.minimum(self._low[a], self._low[b])
        d2 = d[:, 0] * d[:, 0]
        for i in range(1, d.shape[1]):
            d2 = d2 + d[:, i] * d[:, i]
        ok = d2 <= self._r2
        if self._nsigma is not None:
            ok &= np.sqrt(d2) < self._nsigma * (self._least[a] + self._least[b])
        return ok

    def weights(self, n: np.ndarray) -> np.ndarray:
        """For each place of near, the sum of n over neighbours that cells show, itself included; 0 where they show none."""
        own = np.bincount(self.cell, n[self.rows], len(self.first))
        total = np.where(self.whole, own, 0)
        for i, j in ((self.a, self.b), (self.b, self.a)):
            total = total + np.where(self.whole, np.bincount(i, own[j], len(own)), 0)
        out = np.zeros(len(n))
        out[self.rows] = total[self.cell]
        return out

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): places that join the points of cells, and cells, that are neighbours."""
        head = self.rows[self.first]
        own = self.whole[self.cell]
        return np.r_[self.rows[own], head[self.a]], np.r_[head[self.cell[own]], head[self.b]]


def joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the sets of i and j are joined, pair by pair; each set's root is its smallest member."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root
