import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate import api, configs as C
from stellate.backends import labeling
from stellate.operators import labels as L
from stellate.operators import tiles
from stellate.operators.range_join import NeighborGraph, range_join
from stellate.points import from_vectors, point_set

R = np.random.default_rng(8)


def cloud(spark, copies=6, spread=0.4):
    """Clumps of copies: x, and a point set with an index for each row, copies far apart in it."""
    x = np.r_[R.random((120, 2)) * spread, R.random((40, 2)) * 4]
    x = np.tile(x, (copies, 1))
    return x, from_vectors(spark, x[:, 0], x[:, 1], dataset=1 + (np.arange(len(x)) % 160) % 2, sigma=None)


def defined(x, g, near, least, min_points):
    """Density labels by definition, one loop after another."""
    n = len(x)
    core = near.sum(1) >= least
    label, k = np.zeros(n, int), 0
    for first in range(n):
        if core[first] and not label[first]:
            k += 1
            todo = [first]
            label[first] = k
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if not label[j]:
                        label[j] = k
                        todo.append(j)
    out = label.copy()
    for i in np.flatnonzero(~core):
        out[i] = min(label[near[i] & core], default=0)
    final = np.zeros(n, int)
    for d in set(g):
        kept = [c for c in sorted({int(c) for c in out[g == d] if c}) if (out[g == d] == c).sum() >= min_points]
        for new, c in enumerate(kept, 1):
            final[(g == d) & (out == c)] = new
    return final


def pairs_of(x, g, radius):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    near = (d <= radius) & (g[:, None] == g)
    np.fill_diagonal(near, False)
    return near, d


@pytest.fixture(params=["whole", "sliced"])
def slices(request, monkeypatch):
    if request.param == "sliced":
        monkeypatch.setattr(tiles, "SLICE", 8)
        monkeypatch.setattr(tiles, "SHARED", 16)


def test_labels_of_copies_are_those_by_definition(spark, slices):
    x, ps = cloud(spark)
    g = 1 + (np.arange(len(x)) % 160) % 2
    near, _ = pairs_of(x, g, 0.05)
    want = defined(x, g, near, 11, 20)
    got, _ = api.cluster(ps, C.DBSCANConfig(eps_nm=50, min_points=12))
    out = L.range_labels(ps.points.select("dataset", "emitter_idx", "x", "y"), 0.05, ["x", "y"], ["dataset"], 11, 20)
    assert [r["label"] for r in out.orderBy("emitter_idx").collect()] == want.tolist() and want.max() > 1
    assert got.points.count() == len(x)


def test_precision_labels_of_copies_are_those_by_definition(spark, slices):
    x, _ = cloud(spark, 3)
    n = len(x)
    sigma = 0.01 * (1 + np.arange(n) % 3)
    sigma[::7] = 0.0
    rows = [(i + 1, float(a), float(b), float(s)) for i, ((a, b), s) in enumerate(zip(x, sigma, strict=True))]
    p = spark.createDataFrame(rows, "emitter_idx long, x double, y double, sigma double")
    near, d = pairs_of(x, np.ones(n), 0.12)
    near &= d < 1.5 * (sigma[:, None] + sigma)
    for least in (0, 4):
        out = labeling.precision_labels(NeighborGraph(p, 0.12, ["x", "y"]), p.select("emitter_idx", "sigma"), 1.5, min_points=least + 1 if least else 0)
        assert [r["label"] for r in out.orderBy("emitter_idx").collect()] == defined(x, np.ones(n), near, least, 0).tolist()


def test_points_without_coordinates_are_alone(spark):
    rows = [(1, 0.0, 0.0), (2, None, 0.0), (3, 0.01, 0.0), (4, float("nan"), 0.0), (5, None, 0.0), (6, float("inf"), 0.0)]
    p = spark.createDataFrame(rows, "emitter_idx long, x double, y double")
    got = {least: [r["label"] for r in L.range_labels(p, 0.1, ["x", "y"], [], least).orderBy("emitter_idx").collect()] for least in (0, 1)}
    assert got == {0: [1, 2, 1, 3, 4, 5], 1: [1, 0, 1, 0, 0, 0]}


def test_range_join_of_copies_and_of_two_sides(spark, slices):
    x, ps = cloud(spark, 2)
    g = 1 + (np.arange(len(x)) % 160) % 2
    near, _ = pairs_of(x, g, 0.03)
    p = ps.points
    got = {(r["src"] - 1, r["dst"] - 1) for r in range_join(p, p, 0.03, ["x", "y"], ["dataset"]).collect()}
    assert got == set(zip(*np.nonzero(near), strict=True))
    some = p.filter("emitter_idx % 5 = 0")
    two = {(r["src"] - 1, r["dst"] - 1) for r in range_join(some, p, 0.03, ["x", "y"], ["dataset"]).collect()}
    assert two == {(a, b) for a, b in got if (a + 1) % 5 == 0}


def test_pairs_of_copies_are_not_moved(spark):
    """Rows that leave the tiles stay within the points' number, and not the pairs'."""
    p = spark.range(4000).select(F.col("id").alias("emitter_idx"), (F.col("id") % 40 / 1000.0).alias("x"), F.lit(0.0).alias("y"))
    rooted = L.range_roots(p, 0.01, ["x", "y"], [], 4)
    assert rooted.count() == 40 and {r["root"] for r in rooted.collect()} == {0} and rooted.agg(F.sum("n")).first()[0] == 4000


def test_sums_over_copies_are_those_by_definition(spark, slices):
    from stellate.backends import edges as E

    x, ps = cloud(spark, 4)
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    near = d <= 0.3
    k = np.where(near, np.exp(-d * d / 0.02), 0)
    want = (k.sum(1) - 1) / (2 * np.pi * 0.01)
    got = [r["rho"] for r in E.kde_density(ps.points, 0.1, 0.3 / 0.1).orderBy("emitter_idx").collect()]
    assert np.allclose(got, want, rtol=1e-9)
    n = near.sum(1) - 1
    held = {r["emitter_idx"] - 1 for r in E.core_gate(ps.points, 0.3, 0.8).collect()}
    assert held == set(np.flatnonzero(n >= 0.8 * np.median(n)))
    some = ps.points.filter("emitter_idx % 3 = 0").select("emitter_idx", "x", "y")
    sums = {(r["x"], r["y"]): (r["m"], r["d_x"], r["d_y"]) for r in tiles.near_sums(some, ps.points, 0.3, ["x", "y"], ["d_x", "d_y"]).collect()}
    for i in range(2, len(x), 3):
        m, sx, sy = sums[tuple(x[i])]
        assert m == near[i].sum() and np.allclose([sx, sy], (x[near[i]] - x[i]).sum(0), atol=1e-9)


def test_kth_distances_count_copies_but_not_the_point_itself(spark, slices):
    x = np.r_[np.tile(R.random((80, 2)), (3, 1)), R.random((5, 2)) * 1000]
    p = from_vectors(spark, x[:, 0], x[:, 1]).points
    d = np.sort(np.sqrt(((x[:, None] - x) ** 2).sum(-1)), axis=1)
    got = {(r["x"], r["y"]): r for r in tiles.kth_distances(p, p, [2, 7, 400], ["x", "y"], True).collect()}
    assert len(got) == 85 and all(r["d400"] is None for r in got.values())
    for i in range(len(x)):
        assert (got[tuple(x[i])]["d2"], got[tuple(x[i])]["d7"]) == (d[i, 2], d[i, 7])
    some = p.filter("emitter_idx <= 10").withColumn("emitter_idx", -F.col("emitter_idx")).select("emitter_idx", "x", "y")
    two = {(r["x"], r["y"]): r["d4"] for r in tiles.kth_distances(some, p, [4], ["x", "y"], False).collect()}
    assert two == {tuple(x[i]): d[i, 3] for i in range(10)}


#: What is asked of 20,000 points at one place and three apart: pairs of copies alone would be 4 * 10^8 rows.
OF_COPIES = {
    "cluster_sizes": (lambda ps, info: L.cluster_sizes(ps.points, ["dataset"]), False, [(1, 1, 20_000)]),
    "cluster_info": (lambda ps, info: info.summary.select("n_locs_in", "n_clustered", "n_noise", "n_clusters"), False, [(20_003, 20_000, 3, 1)]),
    "dbscan_remove_unclustered": (lambda ps, info: ps.points.groupBy("id").agg(F.count("*"), F.max("emitter_idx")), True, [(1, 20_000, 19_999)]),
}


@pytest.mark.parametrize("name", OF_COPIES)
def test_many_copies(spark, name):
    ask, removed, want = OF_COPIES[name]
    p = spark.range(20_003).select(F.col("id").alias("emitter_idx"), F.greatest(F.col("id") - 19_999, F.lit(0)).cast("double").alias("x"), F.lit(0.0).alias("y"))
    got = ask(*api.cluster(point_set(p), C.DBSCANConfig(eps_nm=100, remove_unclustered=removed)))
    assert [tuple(r) for r in got.collect()] == want


def test_places_are_classified_once(spark, monkeypatch):
    """Kernels get distinct places, and not each of their copies."""
    from stellate.backends import edges as E

    p = spark.range(9000).select(F.col("id").alias("emitter_idx"), (F.col("id") % 30 + 0.5).alias("x"), (F.floor(F.col("id") / 30) % 10 + 0.5).alias("y"))
    given = E.places(p, ["x", "y"])
    assert given.count() == 300 and given.agg(F.sum("n")).first()[0] == 9000
    mask = [{"outer": [(5.0, 2.0), (25.0, 2.0), (25.0, 8.0), (5.0, 8.0)], "holes": []}]
    got = E.labelled(p.unionByName(spark.createDataFrame([(9000, None, 1.0)], p.schema)), mask, 1.0, (0.0, 30.0, 0.0, 10.0), 0.1, dict.fromkeys("LRBT", False))
    assert {r["class"]: r["count"] for r in got.groupBy("class").count().collect()} == {"outside": 5401, "membrane": 30 * 48, "interior": 30 * 72}
    loops = E.loop_diagnostics(p, [mask[0]["outer"]], mask, (0.0, 30.0, 0.0, 10.0), 1.0)
    assert [d["n_emitters_inside"] for d in loops] == [3600]


def test_regimes_by_neighbours_find_no_pairs_of_points_without_density(spark, monkeypatch):
    """More copies than density_k leave a place without a density: its points ask for no neighbours, and are in no regime."""
    x = np.r_[np.tile(R.random((30, 2)), (12, 1)), 5 + R.random((150, 2)) * np.repeat([[0.3], [3.0]], 75, 0)]
    p = from_vectors(spark, x[:, 0], x[:, 1])
    asked = []
    join = labeling.knn_join
    monkeypatch.setattr(labeling, "knn_join", lambda queries, *a, **k: asked.append(queries.count()) or join(queries, *a, **k))
    got, _ = api.cluster(p, C.MRFDensityConfig(density_estimator="knn", graph_kind="knn", density_k=10, per_dataset=False))
    regime = [r["regime"] for r in got.metadata["mrf_regime_per_emitter"].orderBy("emitter_idx").collect()]
    assert asked == [150]
    d = np.sort(np.sqrt(((x[:, None] - x) ** 2).sum(-1)), axis=1)[:, 10]
    assert [r == 0 for r in regime] == (d == 0).tolist() and set(regime[360:]) == {1, 2}


def test_widths_are_tested_where_pairs_are_found(spark):
    """Pairs beyond their widths don't leave the tiles' kernel; a null width has none."""
    x = np.tile(R.random((40, 2)) * 0.5, (2, 1))
    sigma = [None if i % 13 == 0 else 0.01 * (1 + i % 5) for i in range(80)]
    p = spark.createDataFrame([(i, float(a), float(b), s) for i, ((a, b), s) in enumerate(zip(x, sigma, strict=True))], "emitter_idx long, x double, y double, sigma double")
    got = NeighborGraph(p.drop("sigma"), 0.15, ["x", "y"]).active(p.select("emitter_idx", "sigma"), 1.5)
    s = np.array([np.nan if v is None else v for v in sigma])
    near, d = pairs_of(x, np.ones(80), 0.15)
    assert {(r["src"], r["dst"]) for r in got.collect()} == set(zip(*np.nonzero(near & (d < 1.5 * (s[:, None] + s))), strict=True))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("MapInArrow")[0]


def counted_pairs(monkeypatch):
    """A list that gets, for each tile, how many places asked for their pairs."""
    from stellate.kernels.near import Near

    asked, pairs = [], Near.pairs
    monkeypatch.setattr(Near, "pairs", lambda self, ask, strict=False: asked.append(len(ask)) or pairs(self, ask, strict))
    return asked


@pytest.mark.parametrize("widths", [None, 1.5])
def test_dense_distinct_points_need_no_pairs(monkeypatch, widths):
    """Points that are cores for sure, and whose surroundings are one component, aren't asked for pairs; sums and roots are those by definition."""
    from stellate.kernels.near import Near
    from stellate.operators.labels import _counted, _forest

    n = 3000
    x = np.r_[R.random((n - 40, 2)) * 0.8, R.random((40, 2)) * [3, 1] + [1, 0]]
    sigma = 0.01 * (1 + np.arange(n) % 5)
    near = Near(x, np.zeros(n, np.int64), np.zeros((n, 2)), 4.0, 0.15)
    cols = {"site": np.arange(n)[near.order], "n": np.ones(n, np.int64), "sigma": sigma[near.order], "_cut": np.zeros(n, bool)}
    asked = counted_pairs(monkeypatch)
    ask = np.arange(n)
    core = next(_counted(0.15, widths, 4)(cols, ask, near))["core"]
    out = next(_forest(widths)(cols | {"core": core}, ask, near))
    assert len(asked) == 2 and max(asked) < n / 4
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    linked = d <= 0.15 if widths is None else (d <= 0.15) & (d < widths * (sigma[:, None] + sigma))
    np.fill_diagonal(linked, False)
    held = linked.sum(1) >= 4
    assert (core == held[near.order]).all()
    want, got = defined(x, np.ones(n), linked, 4, 0), {}
    for a, b, kind in zip(out["a"].tolist(), out["b"].tolist(), out["kind"].tolist(), strict=True):
        if kind != L.TIE:
            got.setdefault(a, set()).add(int(want[b]))
    assert {a: min(v) for a, v in got.items()} == {i: int(v) for i, v in enumerate(want) if v}


@pytest.mark.parametrize("times", [1, 32])
def test_labels_across_tiles_and_slices(spark, slices, monkeypatch, times):
    monkeypatch.setattr(L, "TIMES", times)
    x = R.random((700, 2)) * [3.0, 0.3]
    ps = from_vectors(spark, x[:, 0], x[:, 1])
    for least in (0, 3):
        near, _ = pairs_of(x, np.ones(len(x)), 0.04)
        out = L.range_labels(ps.points.select("emitter_idx", "x", "y"), 0.04, ["x", "y"], [], least, 2)
        assert [r["label"] for r in out.orderBy("emitter_idx").collect()] == defined(x, np.ones(len(x)), near, least, 2).tolist()


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()


def test_finished_shuffles_are_let_go_at_once(spark, tmp_path):
    """What a finished step has shuffled doesn't lie beside what the next one shuffles."""
    import time

    from stellate.operators.shared import release

    release(spark)
    time.sleep(1)
    before = shuffle_files(spark)
    spark.range(10_000).groupBy(F.col("id") % 1000).count().write.parquet(f"{tmp_path}/out")
    release(spark)
    time.sleep(1)
    assert shuffle_files(spark) <= before


def test_points_alone_at_their_place_are_labelled_without_a_join_by_place(spark):
    """Sites of one point give its label themselves, so that all points and sites aren't shuffled again; sites of several are looked up."""
    x = R.random((400, 2)) * [2.0, 0.3]
    for copies in (1, 2):
        y = np.r_[x, x[: 20 * (copies - 1)]]
        ps = from_vectors(spark, y[:, 0], y[:, 1])
        near, _ = pairs_of(y, np.ones(len(y)), 0.05)
        p = ps.points.select("emitter_idx", "x", "y")
        out = L.range_labels(p, 0.05, ["x", "y"], [], 3, 4)
        assert [r["label"] for r in out.orderBy("emitter_idx").collect()] == defined(y, np.ones(len(y)), near, 3, 4).tolist()
        assert ("_s_x" in out._jdf.queryExecution().analyzed().toString()) == (copies > 1)


@pytest.mark.parametrize("removed", [False, True])
def test_counts_of_labels_are_those_of_the_points(spark, slices, removed):
    """Sizes come from sites and not from another pass over all points; points without coordinates or dataset count as noise."""
    x, ps = cloud(spark, 2)
    odd = spark.createDataFrame([(9001, None, 1.0, 1), (9002, float("nan"), 1.0, 2), (9003, 0.1, 0.1, None)], "emitter_idx long, x double, y double, dataset int")
    ps = point_set(ps.points.select("emitter_idx", "x", "y", "dataset").unionByName(odd))
    got, info = api.cluster(ps, C.DBSCANConfig(eps_nm=50, min_points=12, remove_unclustered=removed))
    counts = {(r["dataset"], r["id"]): r["n"] for r in got.metadata["cluster_counts"].collect()}
    found = {(r["dataset"], r["id"]): r["count"] for r in got.points.groupBy("dataset", "id").count().collect()}
    assert found == {k: n for k, n in counts.items() if k[1] or not removed} and sum(counts.values()) == len(x) + 3
    row = info.row()
    assert (row["n_locs_in"], row["n_clusters"]) == (len(x) + 3, sum(k[1] > 0 for k in counts))


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_few_and_of_many_edges(spark, few):
    from stellate.operators.components import components

    e = [(int(a), int(b)) for a, b in R.integers(0, 300, (200, 2))] + [(1000, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(e, "a long, b long"), "a", "b", few).collect()}
    root = {n: n for p in e[:-1] for n in p}
    for _ in range(300):
        for a, b in e[:-1]:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {n: r for n, r in root.items() if n != r}


@pytest.mark.parametrize("least", [0, 3])
def test_names_of_tiles_that_are_too_many_to_broadcast(spark, monkeypatch, least):
    from stellate.operators import shared

    monkeypatch.setattr(tiles, "SLICE", 8)
    monkeypatch.setattr(tiles, "SHARED", 16)
    monkeypatch.setattr(L, "TIMES", 1)
    monkeypatch.setattr(L, "FEW", 0)
    monkeypatch.setattr(shared, "FEW", 0)
    x = R.random((400, 2)) * [2.0, 0.3]
    x = np.r_[x, x[:50]]
    ps = from_vectors(spark, x[:, 0], x[:, 1])
    near, _ = pairs_of(x, np.ones(len(x)), 0.04)
    out = L.range_labels(ps.points.select("emitter_idx", "x", "y"), 0.04, ["x", "y"], [], least, 2)
    assert [r["label"] for r in out.orderBy("emitter_idx").collect()] == defined(x, np.ones(len(x)), near, least, 2).tolist()
