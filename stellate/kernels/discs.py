"""Sums over all points within a radius in the plane, cell by cell: cells that lie wholly within it count as one, others point by point."""

from __future__ import annotations

import numpy as np

from .near import Near

#: Cells to a radius that are tried; points of a mean point's cell that make the widest cells worth it, and that a cell should hold at most; Chebyshev nodes to a cell's side, of wide cells and of those from FINE to a radius; tests of a block; what a cell's side may be in sigmas.
CELLS, WORTH, FULL, NODES, FINE, BLOCK, SMOOTH = (16, 24, 32, 48, 64, 96), 8, 30, (9, 7), 48, 1 << 15, 0.25


def dense_tiles(near: Near) -> list[tuple[int, int, int]]:
    """(first, end, cells to a radius) of near's tiles that are so full that cells pay."""
    if not len(near.x) or near.x.shape[1] != 2:
        return []
    cuts = np.flatnonzero(near.tile[1:] != near.tile[:-1]) + 1
    out = []
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(near.tile)], strict=True):
        # a cell's margin must be far above what rounding moves a point
        if end - first < 4096 or float(np.abs(near.x[first:end]).max()) * 1e-13 > near.radius:
            continue
        for k in CELLS:
            _, code, _ = _cells(near, first, end, k)
            n = np.bincount(code)
            full = float((n.astype(float) ** 2).sum() / n.sum())
            if k == CELLS[0] and full < WORTH:
                break
            if full <= FULL or k == CELLS[-1]:
                out.append((first, end, k))
                break
    return out


def _cells(near: Near, first: int, end: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Coordinates in the tile, codes of cells (a column of them stands together), and cells to a side of the grid; k + 2 or more on each side hold no asking point."""
    y = near.x[first:end] - near.origin[first]
    side = int(np.ceil(near.width * k / near.radius)) + 2 * k + 6
    c = np.clip(np.floor(y * (k / near.radius)).astype(np.int64) + k + 3, 0, side - 1)
    return y, c[:, 0] * side + c[:, 1], side


def disc_sums(near: Near, first: int, end: int, k: int, ask: np.ndarray, w: np.ndarray, sigma: float | None = None) -> np.ndarray:
    """For each place of `ask` (of the tile at first:end) over the tile's points within the radius: sum of w * exp(-d^2 / (2 sigma^2)) with sigma, else (sum of w, of w * (x_j - x), of w * (y_j - y))."""
    y, code, side = _cells(near, first, end, k)
    order = np.argsort(code, kind="stable")
    code, y, x, w = code[order], y[order], near.x[first:end][order], w[first:end][order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    asks = place[ask - first]
    h, r2 = near.radius / k, near.radius * near.radius
    # columns of cells around an asking one: up to `whole` all corners are within the radius (-1: none), beyond `part` none can be
    dx = np.arange(-k - 1, k + 2)
    far, close = np.abs(dx) + 1, np.maximum(np.abs(dx) - 1, 0)
    whole = np.floor(np.sqrt(np.maximum((k * (1 - 1e-6)) ** 2 - far.astype(float) ** 2, 0)) - 1).astype(int)
    whole[far > k * (1 - 1e-6)] = -1
    part = np.minimum(np.floor(np.sqrt(np.maximum((k * (1 + 1e-6)) ** 2 - close.astype(float) ** 2, 0)) + 1).astype(int), k + 1)
    cells, start = np.unique(code[asks[np.argsort(asks)]], return_index=True)
    sorted_asks, back = np.sort(asks), np.argsort(np.argsort(asks, kind="stable"), kind="stable")
    start = np.r_[start, len(asks)]
    base = cells[:, None] + dx * side
    edge = lambda c, s: np.searchsorted(code, c.ravel(), side=s).reshape(c.shape)
    a, b = edge(base - part, "left"), edge(base + part, "right")
    inner = whole >= 0
    m, n = a.copy(), a.copy()
    m[:, inner], n[:, inner] = edge((base - whole)[:, inner], "left"), edge((base + whole)[:, inner], "right")
    m[:, ~inner] = n[:, ~inner] = b[:, ~inner]
    values = np.column_stack([w] if sigma is not None else [w, w * y[:, 0], w * y[:, 1]])
    out = np.zeros((len(asks), values.shape[1]))
    if sigma is None:
        total = np.vstack([np.zeros(3), np.cumsum(values, axis=0)])
        held = (total[n] - total[m]).sum(1)
        out += np.repeat(held, np.diff(start), axis=0)
    else:
        out[:, 0] = _smooth(y, code, side, w, h, k, dx, whole, sigma, sorted_asks)
    low, high = np.concatenate([a, n], axis=1), np.concatenate([m, b], axis=1)
    px, py = np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])
    for c in range(len(cells)):
        i = sorted_asks[start[c] : start[c + 1]]
        size = high[c] - low[c]
        ends = np.cumsum(size)
        if not ends[-1]:
            continue
        j = np.arange(ends[-1]) + np.repeat(low[c] - (ends - size), size)
        qx, qy, v = px[j], py[j], values[j]
        rows = min(len(i), 32)
        step = max(1, BLOCK // rows)
        for p in range(0, len(i), rows):
            ax, ay = px[i[p : p + rows], None], py[i[p : p + rows], None]
            at = slice(start[c] + p, start[c] + p + ax.shape[0])
            for q in range(0, len(j), step):
                d2 = ax - qx[q : q + step]
                d2 *= d2
                e = ay - qy[q : q + step]
                e *= e
                d2 += e
                ok = d2 <= r2
                if sigma is None:
                    out[at] += ok.astype(float) @ v[q : q + step]
                else:
                    d2 *= -1 / (2 * sigma * sigma)
                    np.exp(d2, out=d2)
                    d2 *= ok
                    out[at] += d2 @ v[q : q + step]
    if sigma is None:
        # sums of coordinates in the tile become sums of differences
        out[:, 1:] -= out[:, :1] * y[sorted_asks]
    return out[back]


def _smooth(y: np.ndarray, code: np.ndarray, side: int, w: np.ndarray, h: float, k: int, dx: np.ndarray, whole: np.ndarray, sigma: float, asks: np.ndarray) -> np.ndarray:
    """Kernel sums over cells wholly within the radius, by values at Chebyshev nodes of cells: as exact as doubles for cells this small."""
    p = NODES[k >= FINE]
    node = np.cos((2 * np.arange(p) + 1) * np.pi / (2 * p)) * 0.5  # in cells, from a cell's middle
    weight = (-1.0) ** np.arange(p) * np.sin((2 * np.arange(p) + 1) * np.pi / (2 * p))

    def basis(at: np.ndarray) -> np.ndarray:
        """Values of the p polynomials at places in cells."""
        d = at[:, None] - node
        hit = d == 0
        t = weight / np.where(hit, 1, d)
        t /= t.sum(1, keepdims=True)
        some = hit.any(1)
        t[some] = hit[some]
        return t

    cx, cy = np.divmod(code, side)
    middle = lambda c: c - k - 3 + 0.5
    bx, by = (basis(y[:, i] / h - middle(c)) for i, c in ((0, cx), (1, cy)))
    moments = np.zeros((side * side, p, p))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    for i, j in zip(first, np.r_[first[1:], len(code)], strict=True):
        moments[code[i]] = (bx[i:j] * w[i:j, None]).T @ by[i:j]
    moments = moments.reshape(side, side, p, p)
    kernel = lambda d: np.exp(-(((node[:, None] - node[None, :] - d) * h) ** 2) / (2 * sigma * sigma))
    # asking cells are k + 3 or more from the grid's border but for points that lie at a tile's very edge
    lo, hi = k + 1, side - k - 1
    around = np.zeros((side, hi - lo, p, p))
    field = np.zeros((hi - lo, hi - lo, p, p))  # the axes of nodes are y, x
    reach = {int(d): int(v) for d, v in zip(dx, whole, strict=True) if d >= 0}
    taken, turned = -1, None
    for d in sorted(reach, reverse=True):
        for e in range(taken + 1, reach[d] + 1):
            for s in {e, -e}:
                around += (moments[:, lo + s : hi + s].reshape(-1, p) @ kernel(s).T).reshape(around.shape)
            turned = None
        taken = max(taken, reach[d])
        if taken >= 0:
            turned = np.ascontiguousarray(around.swapaxes(2, 3)) if turned is None else turned
            for s in {d, -d}:
                field += (turned[lo + s : hi + s].reshape(-1, p) @ kernel(s).T).reshape(field.shape)
    f = field[cx[asks] - lo, cy[asks] - lo]
    return ((f @ bx[asks][:, :, None])[:, :, 0] * by[asks]).sum(1)
