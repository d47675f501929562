"""Edge queries' plans: what is moved and kept, and kernels against definitions."""

from __future__ import annotations

import tempfile

import numpy as np
import pytest

import __spark_entry__ as entry
from stellate.sources import artifacts

SF = "/root/testdata/sf0.001"


def test_classified_lines_use_no_file_of_the_driver(spark, monkeypatch):
    def none(*a, **b):
        raise AssertionError("a temporary folder of the driver")

    monkeypatch.setattr(tempfile, "TemporaryDirectory", none)
    got = entry.queries()["artifact_classified"](spark, SF).orderBy("line_no").collect()
    assert [r[0] for r in got] == list(range(len(got)))
    assert len(got) == 6 + spark.read.parquet(f"{SF}/events.parquet").count()


def test_numbers_follow_the_order_with_nulls_and_copies(spark):
    rows = [(i * 7919 % 1009, float(i)) for i in range(1009)] + [(None, -1.0), (5, -2.0), (5, -3.0)]
    p = spark.createDataFrame(rows, "emitter_idx long, x double").repartition(5)
    got = artifacts.numbered(p, "emitter_idx").collect()
    assert [r["_row"] for r in got] == list(range(1, len(rows) + 1))  # partitions are in order
    ids = [r["emitter_idx"] for r in got]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert sorted(r["x"] for r in got) == sorted(x for _, x in rows)


def _cloud(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.uniform(0, 1.5, n), rng.exponential(0.3, n)])
    x[: n // 50] = x[n // 50 : 2 * (n // 50)]  # copies
    x[:4, 0] = 0.6  # on borders of tiles
    return x


@pytest.mark.parametrize("sigma", [None, 0.1])
def test_sums_of_discs_are_those_of_pairs(sigma):
    from stellate.kernels import discs
    from stellate.kernels.near import Near

    x, r = _cloud(12_000), 0.3
    near = Near(x, np.zeros(len(x), int), np.zeros((len(x), 2)), 3.0, r)
    w = np.arange(len(x)) % 3 + 1.0
    ask = np.flatnonzero(near.x[:, 1] < 3.0)[::-1]
    for k in (16, 48):
        got = discs.disc_sums(near, 0, len(x), k, ask, w, sigma)
        for at in range(0, len(ask), 301):
            d = near.x - near.x[ask[at]]
            d2 = d[:, 0] ** 2 + d[:, 1] ** 2
            ok = w * (d2 <= r * r)
            want = [(ok * np.exp(-d2 / (2 * sigma**2))).sum()] if sigma else [ok.sum(), *(ok @ d)]
            assert np.allclose(got[at], want, rtol=1e-12, atol=1e-9)
            assert sigma or got[at][0] == want[0]


def test_dense_tiles_take_cells_and_sparse_ones_do_not():
    from stellate.kernels import discs
    from stellate.kernels.near import Near

    x = np.vstack([_cloud(20_000), np.random.default_rng(1).uniform(0, 3, (20_000, 2)) * 10])
    tile = np.repeat([0, 1], 20_000)
    near = Near(x, tile, np.zeros((len(x), 2)), 30.0, 0.3)
    assert [(a, b) for a, b, _ in discs.dense_tiles(near)] == [(0, 20_000)]


def test_density_of_crowded_places(spark):
    from stellate.backends import edges as E

    x = _cloud(15_000)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(15_000, None, 1.0), (15_001, float("nan"), 1.0)]
    got = {r[0]: r[1] for r in E.kde_density(spark.createDataFrame(rows, "emitter_idx long, x double, y double"), 0.1).collect()}
    assert len(got) == len(rows) and got[15_000] == got[15_001] == 0
    for i in range(0, 15_000, 500):
        d2 = ((x - x[i]) ** 2).sum(1)
        want = (np.exp(-d2 / 0.02) * (d2 <= 0.3 * 0.3)).sum() - 1
        assert abs(got[i] - want / (2 * np.pi * 0.01)) < 1e-8


def test_potts_sweeps_are_those_point_by_point():
    from stellate.kernels import fields

    rng = np.random.default_rng(5)
    for k in (2, 3):
        n = 400
        edges = np.unique(np.sort(rng.integers(0, n, (1500, 2)), axis=1), axis=0)
        edges = edges[edges[:, 0] < edges[:, 1]]
        near = [np.r_[edges[edges[:, 0] == i, 1], edges[edges[:, 1] == i, 0]] for i in range(n)]
        u = rng.normal(size=(n, k))
        for rounds in (1, 2, 30):
            want = u.argmin(1)
            for _ in range(rounds):
                before = want.copy()
                for i in range(n):
                    want[i] = (u[i] + 0.7 * (len(near[i]) - np.bincount(want[near[i]], minlength=k))).argmin() if len(near[i]) else want[i]
                if (before == want).all():
                    break
            flat = fields.neighbours(n, edges)
            assert all(isinstance(a, np.ndarray) for a in flat)  # no array for each point
            assert (fields.potts(u, flat, 0.7, rounds) == want).all()
        inside = rng.random(n) < 0.4
        got = fields.parts(n, flat, inside)
        assert ((got > 0) == inside).all()
        ok = inside[edges].all(1)
        assert (got[edges[ok, 0]] == got[edges[ok, 1]]).all()
        assert np.array_equal(np.unique(got[inside], return_index=True)[1], np.sort(np.unique(got[inside], return_index=True)[1]))
