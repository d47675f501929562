"""Delaunay triangulation by incremental insertion over a map of directed edges.

The plane is closed by one vertex at infinity, so the hull needs no outer triangle and is
exact. Predicates are evaluated in floats and, where rounding could matter, in rationals.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

AT_INFINITY = -1


def orient(a, b, c) -> float:
    """> 0 if a, b, c turn left; the sign is exact."""
    l, r = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = l - r
    if abs(det) > 4e-16 * (abs(l) + abs(r)):
        return det
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def in_circle(a, b, c, p) -> float:
    """> 0 if p lies strictly inside the circle through a, b, c (turning left); the sign is exact."""

    def det(ax, ay, bx, by, cx, cy):
        return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)

    x = (a[0] - p[0], a[1] - p[1], b[0] - p[0], b[1] - p[1], c[0] - p[0], c[1] - p[1])
    d = det(*x)
    s = max(map(abs, x))
    if abs(d) > 1e-13 * s * s * s * s:
        return d
    q = [Fraction(v) for v in (*a, *b, *c)]
    px, py = Fraction(p[0]), Fraction(p[1])
    e = det(*(v - (py if i % 2 else px) for i, v in enumerate(q)))
    return (e > 0) - (e < 0)


class Triangulation:
    """third[(a, b)] is the vertex c of the triangle a, b, c that lies left of a -> b."""

    def __init__(self, points: list[tuple[float, float]]):
        self.p, self.third = points, {}
        self.last = None

    def _put(self, a: int, b: int, c: int) -> None:
        self.third[a, b], self.third[b, c], self.third[c, a] = c, a, b
        self.last = (a, b, c)

    def _drop(self, a: int, b: int, c: int) -> None:
        del self.third[a, b], self.third[b, c], self.third[c, a]

    def start(self, a: int, b: int, c: int) -> None:
        if orient(self.p[a], self.p[b], self.p[c]) < 0:
            b, c = c, b
        self._put(a, b, c)
        for x, y in ((a, b), (b, c), (c, a)):
            self._put(y, x, AT_INFINITY)

    def _conflicts(self, a: int, b: int, c: int, v) -> bool:
        """Whether the (open) circle of the triangle holds v; a half-plane and its open edge for one at infinity."""
        while c != AT_INFINITY and AT_INFINITY in (a, b):
            a, b, c = b, c, a
        p = self.p
        if c != AT_INFINITY:
            return in_circle(p[a], p[b], p[c], v) > 0
        side = orient(p[a], p[b], v)
        if side:
            return side > 0
        (ax, ay), (bx, by) = p[a], p[b]
        return min(ax, bx) <= v[0] <= max(ax, bx) and min(ay, by) <= v[1] <= max(ay, by)

    def _locate(self, v) -> tuple[int, int, int]:
        """A triangle whose closed face, or half-plane outside the hull, holds v."""
        a, b, c = self.last
        if AT_INFINITY in (a, b, c):
            while c != AT_INFINITY:
                a, b, c = b, c, a
            a, b = b, a
            c = self.third[a, b]
        p, third, came = self.p, self.third, 0
        for _ in range(4 * len(p) + 100):
            for x, y, z in ((a, b, c), (b, c, a), (c, a, b)):
                if orient(p[x], p[y], v) < 0:
                    w = third[y, x]
                    if w == AT_INFINITY:
                        return y, x, w
                    a, b, c = y, x, w
                    break
            else:
                return a, b, c
            came += 1
        raise RuntimeError("point location didn't end")

    def insert(self, i: int) -> None:
        v = self.p[i]
        a, b, c = self._locate(v)
        if not self._conflicts(a, b, c, v):
            raise RuntimeError("the triangle found doesn't hold the point")
        self._drop(a, b, c)
        todo, rim = [(a, b), (b, c), (c, a)], []
        while todo:
            x, y = todo.pop()
            z = self.third.get((y, x))
            if z is None:  # its triangle went meanwhile
                continue
            if self._conflicts(y, x, z, v):
                self._drop(y, x, z)
                for e in ((x, z), (z, y)):
                    todo.append(e)
            else:
                rim.append((x, y))
        for x, y in rim:
            if (y, x) in self.third and (x, y) not in self.third:
                self._put(x, y, i)

    def triangles(self) -> np.ndarray:
        out = [(a, b, c) for (a, b), c in self.third.items() if a != AT_INFINITY and b != AT_INFINITY and c != AT_INFINITY and a < b and a < c]
        return np.array(sorted(out), np.int64).reshape(-1, 3)


def distinct(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct points in the order of first appearance (-0.0 as 0.0), and the place of each point among them."""
    if not np.isfinite(xy).all():
        raise ValueError("coordinates must be finite")
    xy = xy + 0.0
    _, first, inverse = np.unique(xy, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return xy[first[order]], place[inverse.ravel()]


def triangulate(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(triangles, distinct points, place of each point): triangles turn left; none for fewer than three points or points on a line."""
    xy = np.asarray(xy, float).reshape(-1, 2)
    pts, place = distinct(xy)
    none = np.empty((0, 3), np.int64)
    if len(pts) < 3:
        return none, pts, place
    p = [tuple(v) for v in pts.tolist()]
    # near points follow each other: rows of a grid, walked back and forth
    low, size = pts.min(0), np.maximum(np.ptp(pts, axis=0), 1e-300)
    rows = np.minimum((pts[:, 1] - low[1]) / size[1] * max(1, int(np.sqrt(len(pts)) / 2)), 1e9).astype(int)
    order = np.lexsort((np.where(rows % 2, -pts[:, 0], pts[:, 0]), rows)).tolist()
    a, b = order[0], order[1]
    c = next((i for i in order[2:] if orient(p[a], p[b], p[i])), None)
    if c is None:
        return none, pts, place
    t = Triangulation(p)
    t.start(a, b, c)
    for i in order[2:]:
        if i != c:
            t.insert(i)
    return t.triangles(), pts, place


def edges_of(triangles: np.ndarray) -> np.ndarray:
    """Undirected edges, each once."""
    e = np.sort(np.concatenate([triangles[:, [0, 1]], triangles[:, [1, 2]], triangles[:, [2, 0]]]), axis=1) if len(triangles) else np.empty((0, 2), np.int64)
    return np.unique(e, axis=0)


def hull(pts: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, turning left."""
    order = [tuple(v) for v in np.unique(pts, axis=0).tolist()]

    def half(points):
        out = []
        for q in points:
            while len(out) > 1 and orient(out[-2], out[-1], q) <= 0:
                out.pop()
            out.append(q)
        return out

    low, high = half(order), half(order[::-1])
    return np.array(low[:-1] + high[:-1])


def shoelace(ring) -> float:
    r = np.asarray(ring, float)
    return float((r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]).sum() / 2)


def _cut(ring: list[tuple[float, float]], nx: float, ny: float, c: float) -> list[tuple[float, float]]:
    """The part of a convex ring where nx x + ny y <= c."""
    out = []
    side = [nx * x + ny * y - c for x, y in ring]
    for i, (q, s) in enumerate(zip(ring, side, strict=True)):
        r, t = ring[(i + 1) % len(ring)], side[(i + 1) % len(ring)]
        if s <= 0:
            out.append(q)
        if (s < 0 < t) or (t < 0 < s):
            f = s / (s - t)
            out.append((q[0] + f * (r[0] - q[0]), q[1] + f * (r[1] - q[1])))
    return out


def voronoi_areas(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(areas of the cells cut to the convex hull, Delaunay edges); NaN and no edges where no triangle exists. Points must be distinct."""
    tri, pts, place = triangulate(xy)
    if len(pts) != len(xy):
        raise ValueError("duplicate coordinates")
    if not len(tri):
        return np.full(len(xy), np.nan), np.empty((0, 2), np.int64)
    edges = edges_of(tri)
    corners = hull(pts)
    base = [tuple(v) for v in corners.tolist()]
    a, b, c = pts[tri[:, 0]], pts[tri[:, 1]], pts[tri[:, 2]]
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    u2, v2 = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = a + np.column_stack([(v[:, 1] * u2 - u[:, 1] * v2) / d, (u[:, 0] * v2 - v[:, 0] * u2) / d])
    nxt = np.roll(corners, -1, axis=0) - corners
    inside = np.ones(len(tri), bool)
    for q, e in zip(corners, nxt, strict=True):
        inside &= e[0] * (centre[:, 1] - q[1]) - e[1] * (centre[:, 0] - q[0]) >= 0
    around: list[list[int]] = [[] for _ in range(len(pts))]
    for t, vs in enumerate(tri.tolist()):
        for w in vs:
            around[w].append(t)
    near: list[list[int]] = [[] for _ in range(len(pts))]
    for x, y in edges.tolist():
        near[x].append(y)
        near[y].append(x)
    areas = np.empty(len(pts))
    for i, (px, py) in enumerate(pts.tolist()):
        ts = around[i]
        if len(ts) == len(near[i]) and inside[ts].all():
            o = centre[ts] - (px, py)
            areas[i] = abs(shoelace(o[np.argsort(np.arctan2(o[:, 1], o[:, 0]), kind="stable")]))
            continue
        ring = base
        for j in near[i]:
            qx, qy = pts[j]
            nx, ny = qx - px, qy - py
            ring = _cut(ring, nx, ny, nx * (px + qx) / 2 + ny * (py + qy) / 2)
            if len(ring) < 3:
                break
        areas[i] = abs(shoelace(ring)) if len(ring) > 2 else 0.0
    return areas, edges
