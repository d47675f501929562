import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellate.kernels import delaunay as D
from stellate.kernels import fields, rings, trees

R = np.random.default_rng(0)


@pytest.mark.parametrize("n", [3, 5, 40, 400])
def test_triangles_follow_eulers_count_and_areas_fill_the_hull(n):
    x = R.random((n, 2))
    tri, pts, _ = D.triangulate(x)
    hull = D.hull(pts)
    assert len(tri) == 2 * n - 2 - len(hull)
    assert D.voronoi_areas(x)[0].sum() == pytest.approx(D.shoelace(hull))


def test_circles_are_empty():
    x = R.random((60, 2))
    tri, p, _ = D.triangulate(x)
    assert not any(D.in_circle(p[a], p[b], p[c], q) > 0 for a, b, c in tri for q in p)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=0, max_size=25))
def test_grids_with_ties(points):
    xy = np.array(points, float).reshape(-1, 2)
    tri, p, place = D.triangulate(xy)
    if len(tri):
        area = sum(D.shoelace(p[t]) for t in tri)
        assert area == pytest.approx(D.shoelace(D.hull(p)))
    assert (p[place] == xy).all() if len(xy) else True


@pytest.mark.parametrize(("points", "count"), [([(0, 0), (-0.0, 0), (1, 0), (0, 1)], 1), ([(0, 0), (1, 0), (1, 1), (0, 1)], 2), ([(0, 0), (1, 0), (0, 1)], 1), ([(0, 0), (1, 1), (2, 2), (3, 3)], 0)])
def test_triangle_counts(points, count):
    assert len(D.triangulate(np.array(points, float))[0]) == count


def test_non_finite_and_duplicates_raise():
    with pytest.raises(ValueError):
        D.triangulate(np.array([[0, 0], [1, np.nan], [2, 1.0]]))
    with pytest.raises(ValueError):
        D.voronoi_areas(np.array([[0, 0], [0, 0], [1, 0], [0, 1.0]]))


SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10)]


def box(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_masks():
    one = rings.build_mask([SQUARE])
    assert len(one) == 1 and rings.region_area(one) == 100
    assert rings.in_region(np.array([5.0, 20]), np.array([5.0, 20]), one).tolist() == [True, False]
    holed = rings.build_mask([SQUARE, box(3, 3, 4)], keep_internal=True)
    assert rings.region_area(holed) == 84 and not rings.in_region(np.array([5.0]), np.array([5.0]), holed)[0]
    assert rings.region_area(rings.build_mask([SQUARE, box(3, 3, 4)])) == 100


@pytest.mark.parametrize(("frac", "holes"), [(0, 2), (0.05, 1), (0.2, 0)])
def test_small_holes_go(frac, holes):
    assert len(rings.build_mask([SQUARE, box(1, 1, 4), box(7, 7, 1)], True, min_hole_frac=frac)[0]["holes"]) == holes


def test_debris_and_figure_eight():
    far, tiny = box(20, 20, 10), box(40, 40, 1)
    assert len(rings.build_mask([SQUARE, far, tiny])) == 2
    assert len(rings.build_mask([SQUARE, far, tiny], min_cell_frac=0)) == 3
    eight = [(0, 0), (5, 5), (10, 0), (10, 10), (5, 5), (0, 10)]
    cells = rings.build_mask([eight], min_cell_frac=0)
    assert cells and all(len(c["outer"]) >= 3 for c in cells)


def test_nearest_distance_is_exact():
    x = R.random((300, 2))
    d = np.sort(np.sqrt(((x[:, None] - x) ** 2).sum(-1)), axis=1)
    assert np.allclose(rings.nearest_distance(x, 5), d[:, 5])


def test_potts_and_mixtures():
    u = fields.costs(np.array([0.49, 1, 1]), {"means": [0, 1], "vars": [1, 1], "weights": [0.5, 0.5]})
    near = fields.neighbours(3, np.array([[0, 1], [0, 2], [1, 2]]))
    assert (fields.potts(u, near, 1.0, 50) + 1).tolist() == [2, 2, 2]
    hard = fields.costs(np.array([0.49, 1, 1]), thresholds=[0.5])
    assert (fields.potts(hard, near, 1.0, 50) + 1).tolist() == [1, 2, 2]
    g = fields.mixture(np.r_[R.normal(0, 1, 400), R.normal(6, 1, 400)], 2)
    assert g["means"] == pytest.approx([0, 6], abs=0.3)
    assert 2 < fields.boundary(0, 1, 0.5, 6, 1, 0.5) < 4
    assert fields.mixture(np.ones(10), 2) is None


def test_growth_needs_seed_and_size():
    near = [np.array([1]), np.array([0]), np.array([3]), np.array([2])]
    grown = fields.grown(near, np.array([True, False, False, False]), np.ones(4, bool), 2)
    assert grown.tolist() == [1, 1, 0, 0]


@pytest.mark.parametrize("method", ["single", "complete", "average", "ward"])
def test_linkage_finds_blobs(method):
    x = np.r_[R.normal(0, 0.01, (20, 2)), R.normal(1, 0.01, (15, 2))]
    assert np.bincount(trees.linkage_labels(x, method, None, 2)).tolist() == [0, 20, 15]


def _knn(x, k):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    o = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(x)), k), o.ravel(), np.take_along_axis(d, o, 1).ravel(), np.sort(d, axis=1)[:, 4]


def test_hdbscan_two_blobs_and_bridges():
    x = np.r_[R.normal((1, 1), 0.015, (60, 2)), R.normal((3, 1), 0.008, (80, 2))]
    for k in (10, 5):
        labels = trees.hdbscan(x, *_knn(x, k), 5, halo=0.0)[0]
        assert len({*labels[:60]} - {0}) >= 1 and not ({*labels[:60]} & {*labels[60:]}) - {0}
    none = np.empty(0, int)
    assert not trees.hdbscan(x[:3], none, none, np.empty(0), np.ones(3), 5)[0].any()


def test_distances_to_many_segments_and_rings_are_those_by_definition():
    r = np.random.default_rng(4)
    t = np.sort(r.random(3000)) * 2 * np.pi
    x, y = np.round(r.normal(size=(2, 4000)), 2)
    began = time.time()
    for ring in ([(5 * np.cos(a), 5 * np.sin(a)) for a in t], [(round(np.cos(a), 1), round(np.sin(a), 1)) for a in t[::50]]):
        ring = [(float(a), float(b)) for a, b in ring]
        s = rings.segments([ring])
        d, which = rings.segment_distance(x, y, s)
        odd = np.zeros(len(x), bool)
        for ax, ay, bx, by in s:
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        assert (rings.inside(x, y, ring) == odd).all()
        for i in range(0, len(x), 40):
            p, u = np.array([x[i], y[i]]) - s[:, :2], s[:, 2:] - s[:, :2]
            n = (u * u).sum(1)
            e = np.hypot(*(p - np.clip(np.where(n > 0, (p * u).sum(1) / np.where(n > 0, n, 1), 0), 0, 1)[:, None] * u).T)
            assert d[i] == e.min() and which[i] == e.argmin()
    assert time.time() - began < 20
