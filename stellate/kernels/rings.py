"""Rings: alpha-shape boundaries, cell masks, membership, distances, raster footprints."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from .delaunay import shoelace, triangulate

Ring = list[tuple[float, float]]


def circumradius(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    u, v = b - a, c - a
    d = 2 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    u2, v2 = (u * u).sum(1), (v * v).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.hypot((v[:, 1] * u2 - u[:, 1] * v2) / d, (u[:, 0] * v2 - v[:, 0] * u2) / d)
    return np.where(np.abs(d) < 1e-30, np.inf, r)


def nearest_distance(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """Distance of each point to its k-th neighbour (k clamped to the points there are), over a grid of cells."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.zeros(n)
    out = np.full(n, np.nan)
    width = max(float(np.sqrt(np.prod(np.maximum(np.ptp(x, axis=0), 1e-12)) * (k + 1) / n)), 1e-12)
    whole = float(np.ptp(x, axis=0).max()) + 1e-12
    todo = np.arange(n)
    while len(todo):
        cell = np.floor((x - x.min(0)) / width).astype(np.int64) + 1
        code = cell[:, 0] * (cell[:, 1].max() + 3) + cell[:, 1]
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        span = cell[:, 1].max() + 3
        groups: dict[int, list[int]] = defaultdict(list)
        for i in todo.tolist():
            groups[int(code[i])].append(i)
        left = []
        for c, members in groups.items():
            near = np.concatenate([order[np.searchsorted(sorted_code, c + dx * span - 1) : np.searchsorted(sorted_code, c + dx * span + 1, side="right")] for dx in (-1, 0, 1)])
            for a in range(0, len(members), block):
                m = np.array(members[a : a + block])
                if len(near) <= k:
                    left += m.tolist()
                    continue
                d = np.sqrt(((x[m, None] - x[None, near]) ** 2).sum(-1))
                kth = np.partition(d, k, axis=1)[:, k]  # the point itself is the nearest
                ok = (kth <= width) | (width >= whole)
                out[m[ok]] = kth[ok]
                left += m[~ok].tolist()
        todo, width = np.array(left, np.int64), width * 2
    return out


def trace(edges: list[tuple[int, int]]) -> list[list[int]]:
    """Closed loops of undirected edges, each edge once; walks start at and prefer the smallest, so outcomes don't depend on order."""
    near: dict[int, list[int]] = defaultdict(list)
    for a, b in sorted(edges):
        near[a].append(b)
        near[b].append(a)
    free = {tuple(sorted(e)) for e in edges}
    out = []
    for first in sorted(free):
        if first not in free:
            continue
        free.discard(first)
        loop = list(first)
        while True:
            here = loop[-1]
            step = next((v for v in sorted(near[here]) if (min(here, v), max(here, v)) in free), None)
            if step is None:
                break
            free.discard((min(here, step), max(here, step)))
            if step == loop[0]:
                if len(loop) >= 3:
                    out.append(loop)
                break
            loop.append(step)
    return out


def alpha_loops(xy: np.ndarray, alpha: float, knn: int | None = None, scale: float = 2.0) -> list[Ring]:
    """Boundary loops of the alpha shape of distinct points, largest first; with knn, alpha also adapts to each triangle's spacing."""
    tri, pts, _ = triangulate(xy)
    if not len(tri):
        return []
    limit: np.ndarray | float = alpha
    if knn is not None:
        spacing = nearest_distance(pts, knn)
        limit = np.minimum(scale * np.median(spacing[tri], axis=1), max(alpha, scale * float(np.median(spacing))))
    kept = tri[circumradius(*(pts[tri[:, i]] for i in range(3))) <= limit]
    if not len(kept):
        return []
    e, count = np.unique(np.sort(np.concatenate([kept[:, [0, 1]], kept[:, [1, 2]], kept[:, [2, 0]]]), axis=1), axis=0, return_counts=True)
    rings = [[tuple(pts[v].tolist()) for v in loop] for loop in trace([tuple(x) for x in e[count == 1].tolist()])]
    return sorted(rings, key=lambda r: (-abs(shoelace(r)), min(r)))


def inside(x: np.ndarray, y: np.ndarray, ring: Ring) -> np.ndarray:
    """Even-odd membership; edges are half-open in y and strict in x."""
    out = np.zeros(len(x), bool)
    r = np.asarray(ring, float)
    low, high = r.min(0), r.max(0)
    at = np.flatnonzero((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1]))
    at = at[np.argsort(y[at], kind="stable")]
    px, py, odd = x[at], y[at], np.zeros(len(at), bool)
    # an edge is asked only by the points of its heights, which stand together
    nxt = np.roll(r, -1, axis=0)
    first, last = np.searchsorted(py, np.minimum(r[:, 1], nxt[:, 1])), np.searchsorted(py, np.maximum(r[:, 1], nxt[:, 1]))
    for (ax, ay), (bx, by), i, j in zip(r.tolist(), nxt.tolist(), first.tolist(), last.tolist(), strict=True):
        if i < j:
            odd[i:j] ^= px[i:j] < (bx - ax) * (py[i:j] - ay) / (by - ay) + ax
    out[at] = odd
    return out


def simple_rings(ring: Ring) -> list[Ring]:
    """A ring cut at vertices that it visits again."""
    out, path, place = [], [], {}
    for v in ring:
        if v in place:
            cut = path[place[v] :]
            out.append(cut)
            for w in cut:
                place.pop(w, None)
            path = path[: len(path) - len(cut)]
        place[v] = len(path)
        path.append(v)
    return [r for r in [*out, path] if len(r) >= 3]


def ring_in_ring(a: Ring, b: Ring) -> bool:
    """Whether more than half of a's vertices (rounded down) lie in b."""
    v = np.asarray(a, float)
    return int(inside(v[:, 0], v[:, 1], b).sum()) > len(a) // 2


def build_mask(loops: list[Ring], keep_internal: bool = False, min_cell_frac: float = 1 / 3, min_hole_frac: float = 0.0) -> list[dict]:
    """Cells {outer, holes} from loops, largest first: rings of even nesting bound cells, rings one deeper are their holes."""
    if not (0 <= min_cell_frac < 1 and 0 <= min_hole_frac < 1):
        raise ValueError("min_cell_frac and min_hole_frac must be in [0, 1)")
    rings = [r for loop in loops for r in simple_rings([tuple(map(float, v)) for v in loop])]
    if any(not np.isfinite(r).all() for r in rings):
        raise ValueError("rings must be finite")
    rings = [r for r in rings if shoelace(r)]
    area = [abs(shoelace(r)) for r in rings]
    holds = [[i != j and ring_in_ring(r, s) for j, s in enumerate(rings)] for i, r in enumerate(rings)]
    depth = [sum(h) for h in holds]
    cells = []
    for i, r in enumerate(rings):
        if depth[i] % 2:
            continue
        holes = [rings[j] for j in range(len(rings)) if keep_internal and depth[j] == depth[i] + 1 and holds[j][i] and area[j] >= min_hole_frac * area[i]]
        cells.append({"outer": r, "holes": holes, "area": area[i]})
    largest = max((c["area"] for c in cells), default=0.0)
    return sorted((c for c in cells if c["area"] >= min_cell_frac * largest), key=lambda c: -c["area"])


def region_area(cells: list[dict]) -> float:
    return sum(abs(shoelace(c["outer"])) - sum(abs(shoelace(h)) for h in c["holes"]) for c in cells)


def in_region(x: np.ndarray, y: np.ndarray, cells: list[dict]) -> np.ndarray:
    out = np.zeros(len(x), bool)
    for c in cells:
        here = inside(x, y, c["outer"])
        for h in c["holes"]:
            here &= ~inside(x, y, h)
        out |= here
    return out


def segments(rings: list[Ring]) -> np.ndarray:
    """Rows (ax, ay, bx, by)."""
    return np.array([(*a, *b) for r in rings for a, b in zip(r, [*r[1:], r[0]], strict=True)], float).reshape(-1, 4)


def on_cut(s: np.ndarray, fov: tuple[float, float, float, float], tol: float, sides: dict[str, bool]) -> np.ndarray:
    """Segments whose both ends lie at one side of the field of view that cuts the cell."""
    out = np.zeros(len(s), bool)
    for name, i, at in (("L", 0, fov[0]), ("R", 0, fov[1]), ("B", 1, fov[2]), ("T", 1, fov[3])):
        if sides[name]:
            out |= (np.abs(s[:, i] - at) <= tol) & (np.abs(s[:, i + 2] - at) <= tol)
    return out


def segment_distance(x: np.ndarray, y: np.ndarray, s: np.ndarray, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(distance to the nearest segment, which one, the first of equals); inf and -1 without segments.

    Points are asked by small boxes, each against the segments that may be the nearest to any place of it; of few segments all are asked.
    """
    if not len(s):
        return np.full(len(x), np.inf), np.full(len(x), -1)
    dist, which = np.where(np.isnan(x) | np.isnan(y), np.nan, np.inf), np.zeros(len(x), int)
    a, u = s[:, :2], s[:, 2:] - s[:, :2]
    length = (u * u).sum(1)
    q = np.column_stack([x, y])
    at = np.flatnonzero(np.isfinite(q).all(1))
    if len(s) <= 32:
        for i in range(0, len(at), block):
            m = at[i : i + block]
            d = _to_segments(q[m], a, u, length)
            which[m] = d.argmin(1)
            dist[m] = d[np.arange(len(m)), which[m]]
        return dist, which
    for here in _boxes(q, at):
        low, high = q[here].min(0), q[here].max(0)
        # a box's places are within its half diagonal of its middle
        middle, half = (low + high) / 2, float(np.hypot(*(high - low))) / 2
        d = _to_segments(middle[None], a, u, length)[0]
        may = np.flatnonzero(d <= (d.min() + 2 * half) * (1 + 1e-9) + np.abs(middle).max() * 1e-12)
        for i in range(0, len(here), block):
            m = here[i : i + block]
            d = _to_segments(q[m], a[may], u[may], length[may])
            near = d.argmin(1)
            which[m], dist[m] = may[near], d[np.arange(len(m)), near]
    return dist, which


def _to_segments(q: np.ndarray, a: np.ndarray, u: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distances of points (rows) to segments (columns)."""
    p = q[:, None] - a
    t = np.clip(np.where(length > 0, (p * u).sum(-1) / np.where(length > 0, length, 1), 0), 0, 1)
    return np.hypot(*np.moveaxis(p - t[..., None] * u, -1, 0))


def _boxes(q: np.ndarray, at: np.ndarray, most: int = 64) -> list[np.ndarray]:
    """Places `at` of q in parts near each other, halved along their longer side down to `most`."""
    out, todo = [], [at]
    while todo:
        m = todo.pop()
        if len(m) <= most:
            out += [m] if len(m) else []
            continue
        axis = int(np.ptp(q[m], axis=0).argmax())
        m = m[np.argpartition(q[m, axis], len(m) // 2)]
        todo += [m[: len(m) // 2], m[len(m) // 2 :]]
    return out


def raster(box: tuple[float, float, float, float], fov: tuple[float, float, float, float], bin_size: float) -> tuple[float, float, int, int]:
    """(x0, y0, columns, rows) of bins over the points' box (x0, x1, y0, y1), up to one field of view beyond it."""
    out = []
    for (a, b), (lo, hi) in ((box[:2], fov[:2]), (box[2:], fov[2:])):
        a, b = (min(max(v, lo - (hi - lo)), hi + (hi - lo)) for v in (a, b))
        out.append((a, max(1, int(np.ceil((b - a) / bin_size)) + 1)))
    return out[0][0], out[1][0], out[0][1], out[1][1]


def filled(i: np.ndarray, j: np.ndarray, shape: tuple[int, int], closing: int) -> np.ndarray:
    """Raster of the bins (i, j), and of what they enclose from the border once dilated."""
    held = np.zeros(shape, bool)
    held[i, j] = True
    wide = np.zeros(shape, bool)
    for a, b in zip(*np.nonzero(held), strict=True):
        wide[max(a - closing, 0) : a + closing + 1, max(b - closing, 0) : b + closing + 1] = True
    outer = np.zeros(shape, bool)
    outer[[0, -1], :] = outer[:, [0, -1]] = True
    outer &= ~wide
    todo = list(zip(*np.nonzero(outer), strict=True))
    while todo:
        a, b = todo.pop()
        for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
            if 0 <= c < shape[0] and 0 <= d < shape[1] and not wide[c, d] and not outer[c, d]:
                outer[c, d] = True
                todo.append((c, d))
    return held | (~outer & ~wide)


def footprint(x: np.ndarray, y: np.ndarray, dense: np.ndarray, fov: tuple[float, float, float, float], bin_size: float, closing: int) -> np.ndarray:
    """Points in bins that hold dense points, or that those enclose."""
    x0, y0, columns, rows = raster((x.min(), x.max(), y.min(), y.max()), fov, bin_size)
    i = np.clip(np.floor((x - x0) / bin_size).astype(int), 0, columns - 1)
    j = np.clip(np.floor((y - y0) / bin_size).astype(int), 0, rows - 1)
    return filled(i[dense], j[dense], (columns, rows), closing)[i, j]
