import numpy as np
import pytest
from pyspark.sql import functions as F

from stellate import api, configs as C
from stellate.backends import edges as E
from stellate.operators.components import components
from stellate.operators.knn import _widths, knn_join
from stellate.operators.range_join import NeighborGraph, range_join
from stellate.points import from_vectors, point_set
from stellate.sources import artifacts

R = np.random.default_rng(3)


def labels(ps):
    return [r["id"] for r in ps.points.orderBy("emitter_idx").collect()]


def test_range_join_is_the_theta_join(spark):
    x = R.random((150, 2))
    ps = from_vectors(spark, x[:, 0], x[:, 1])
    got = {(r["src"], r["dst"]) for r in range_join(ps.points, ps.points, 0.1, ["x", "y"]).collect()}
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    assert got == {(i + 1, j + 1) for i, j in zip(*np.nonzero(d <= 0.1)) if i != j}


def test_knn_join_is_exact_with_gaps_and_ties(spark):
    x = np.r_[R.random((60, 2)), R.random((20, 2)) * 0.01 + 50, [[0, 0], [0, 0], [1, 0]]]
    ps = from_vectors(spark, x[:, 0], x[:, 1])
    got = {}
    for r in knn_join(ps.points, ps.points, 4, ["x", "y"]).collect():
        got.setdefault(r["src"] - 1, {})[r["rank"]] = r["dst"] - 1
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][k] for k in range(1, 5)] == np.lexsort((np.arange(len(x)), d[i]))[:4].tolist()


def test_far_points_do_not_widen_the_first_cells(spark):
    x = np.r_[R.random((200, 2)), [[1e9, -1e9], [1e9, -1e9 + 3]]]
    near, far = (from_vectors(spark, p[:, 0], p[:, 1]).points.withColumn("g", F.lit(0)) for p in (x[:200], x))
    narrow, wide = (_widths(p, 3, ["x", "y"], ["g"]).first()["_w"] for p in (near, far))
    assert wide < 2 * narrow
    got = {(r["src"], r["rank"]): r["dst"] for r in knn_join(far, far, 3, ["x", "y"]).collect()}
    d = ((x[:, None] - x) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert len(got) == 3 * len(x)
    for i in range(len(x)):
        assert sorted(d[i][[got[i + 1, k] - 1 for k in (1, 2, 3)]]) == sorted(d[i])[:3]


def test_knn_join_of_few_points(spark):
    ps = from_vectors(spark, [0, 1, 5], [0, 0, 0])
    assert knn_join(ps.points, ps.points, 9, ["x", "y"]).count() == 6


def test_components_of_a_long_chain(spark):
    e = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(e, "a", "b").collect()
    assert len(got) == 300 and {r["root"] for r in got} == {0}


def precision(spark, xs, sigma, nsigma, min_points):
    from stellate.backends.labeling import precision_labels

    ps = from_vectors(spark, xs, [0.0] * len(xs), sigma=sigma)
    g = NeighborGraph(ps.points, 2.5, ["x", "y"])
    s = ps.points.select("emitter_idx", F.col("sigma_x").alias("sigma"))
    return [r["label"] for r in precision_labels(g, s, nsigma, min_points).orderBy("emitter_idx").collect()]


@pytest.mark.parametrize(("xs", "sigma", "nsigma", "mp", "want"), [
    ([0, 1, 2], 1.0, 0.6, 0, [1, 1, 1]), ([0, 1, 2], 1.0, 0.4, 0, [1, 2, 3]), ([0, 1, 2, 10], 1.0, 0.6, 2, [1, 1, 1, 0]),
    ([0, 1, 2, 10], 1.0, 0.6, 0, [1, 1, 1, 2]), ([0, 1], 0.5, 1.0, 0, [1, 2]), ([0, 1], 0.5, 1.01, 0, [1, 1]), ([0, 0.01, 1, 1.01], 0.1, 1.0, 1, [1, 1, 2, 2]),
])
def test_precision_labels(spark, xs, sigma, nsigma, mp, want):
    assert precision(spark, xs, [sigma] * len(xs), nsigma, mp) == want


def test_neighbor_graph_guards(spark):
    ps = from_vectors(spark, [0, 1], [0, 0], sigma=[1, 1])
    with pytest.raises(ValueError):
        NeighborGraph(ps.points, 0, ["x", "y"])
    with pytest.raises(ValueError):
        NeighborGraph(ps.points, 1.0, ["x", "y"]).active(ps.points.select("emitter_idx", F.col("sigma_x").alias("sigma")), 5)


@pytest.fixture(scope="module")
def blobs(spark):
    b = np.r_[R.normal((2, 2), 0.01, (40, 2)), R.normal((4, 2), 0.01, (40, 2)), R.normal((3, 4), 0.01, (40, 2)), R.random((30, 2)) * 6]
    return from_vectors(spark, b[:, 0], b[:, 1], sigma=[0.01] * len(b))


@pytest.mark.parametrize("config", [C.DBSCANConfig(eps_nm=100), C.PrecisionDBSCANConfig(nsigma=3), C.HierarchicalConfig(cut_threshold=100, linkage="single"), C.VoronoiConfig(), C.MRFDensityConfig(density_estimator="knn", graph_kind="knn")])
def test_three_blobs(blobs, config):
    ps, info = api.cluster(blobs, config)
    row, ids = info.row(), labels(ps)
    assert row["n_clusters"] == 3 and sum(row["cluster_sizes"]) == row["n_clustered"] == sum(i > 0 for i in ids)
    assert row["n_clustered"] + row["n_noise"] == row["n_locs_in"] == 150
    assert all(ids.count(k + 1) == n for k, n in enumerate(row["cluster_sizes"]))
    assert set(labels(blobs)) == {0}


def test_groups_removal_and_three_dimensions(spark):
    x = np.r_[R.normal((1, 1), 0.005, (20, 2)), R.normal((3, 3), 0.005, (20, 2))]
    both = np.r_[x, x, [[9, 9]]]
    ps = from_vectors(spark, both[:, 0], both[:, 1], z=np.zeros(81), dataset=[1] * 40 + [2] * 41)
    for use_3d in (False, True):
        out, info = api.cluster(ps, C.DBSCANConfig(eps_nm=100, remove_unclustered=True, use_3d=use_3d))
        assert info.row()["cluster_sizes"] == [20, 20, 20, 20] and out.points.count() == 80
    assert api.cluster(ps, C.DBSCANConfig(eps_nm=100, per_dataset=False))[1].row()["cluster_sizes"] == [40, 40]
    with pytest.raises(RuntimeError):
        api.cluster(from_vectors(spark, [0], [0]), C.DBSCANConfig(eps_nm=1, use_3d=True))


def test_hysteresis(blobs):
    _, info = api.cluster(blobs, C.PointHysteresisConfig(graph_k=5, min_points=20), seed=F.col("emitter_idx") <= 40, support=F.col("emitter_idx") <= 120)
    assert info.row()["n_clusters"] == 1
    with pytest.raises(ValueError):
        api.cluster(blobs, C.PointHysteresisConfig(), seed=F.lit(True), support=F.lit(False))


def test_statistics(blobs, spark):
    u = R.random((300, 2)) * 5
    uniform = from_vectors(spark, u[:, 0], u[:, 1])
    h = lambda ps, **k: api.cluster_statistics(ps, C.HopkinsConfig(**{"n_samples": 50, "random_repeats": 2, **k}))[1].value
    assert 0.35 < h(uniform) < 0.65 < 0.7 < h(blobs)
    assert h(uniform, seed=1) == h(uniform, seed=1)
    assert np.isnan(h(uniform, n_samples=1000))
    d = api.cluster_statistics(uniform, C.VoronoiDensityConfig())[1]
    assert 0.7 * 12 < d.value < 1.3 * 14
    c = api.cluster_statistics(blobs, C.LocalContrastFeature(density_k=5, background_k=60))[1]
    assert c.points.filter("isnan(local_contrast)").count() == 0
    assert np.isnan(api.cluster_statistics(from_vectors(spark, range(8), [0] * 8), C.LocalContrastFeature(density_k=10, background_k=20))[1].value)


@pytest.mark.parametrize("bad", [lambda: C.DBSCANConfig(eps_nm=0), lambda: C.HierarchicalConfig(), lambda: C.LocalContrastFeature(density_k=5, background_k=5), lambda: C.VoronoiConfig(use_3d=True), lambda: C.OuterPolygonConfig(k_list=()), lambda: C.KdeValleyConfig(valley_nbins=1)])
def test_bad_configurations_raise(bad):
    with pytest.raises(ValueError):
        bad().validate()


def test_unknown_configurations_raise(blobs):
    for verb in (api.cluster, api.cluster_statistics, api.classify_emitters):
        with pytest.raises(RuntimeError):
            verb(blobs, object())


def test_points_need_columns(spark):
    with pytest.raises(ValueError):
        point_set(spark.createDataFrame([(1.0,)], "x double"))
    with pytest.raises(ValueError):
        from_vectors(spark, [1], [])


def test_edges_and_artifacts(spark, tmp_path):
    n = 1500
    t, q = R.random(n) * 2 * np.pi, 2 * np.sqrt(R.random(n))
    ps = from_vectors(spark, np.r_[5 + q * np.cos(t), R.random(60) * 10], np.r_[5 + q * np.sin(t), R.random(60) * 10], fov=(0, 10, 0, 10))
    config = C.OuterPolygonConfig(k_list=(8,), rho_k_thresh=30, alpha_nm=600)
    out, info = api.classify_emitters(ps, config)
    counts = info.class_counts()
    assert sum(counts.values()) == n + 60 and counts["interior"] > 700
    assert info.outer_polygon == info.cells[0]["outer"] == out.metadata["edge_outer_polygon"]
    assert not info.points.filter("inside_outer <> (class <> 'outside')").count()
    report = artifacts.write_edge_report(info, str(tmp_path), "c", "n")
    lines = (tmp_path / "c/n/classified.tsv").read_text().splitlines()
    assert lines[0] == "# schema_version: 2" and "in_cell" in lines[5] and len(lines) == 6 + n + 60
    assert report["frac_interior"] == pytest.approx(counts["interior"] / (n + 60))
    assert (tmp_path / "c/n/manifest.json").exists() and (tmp_path / "c/n/loop_diagnostics.csv").read_text().count("\n") == 2 + len(info.loops)
    metric, suspects = E.concavity_metric(info)
    assert metric["n_suspect"] == suspects.count() <= metric["n_eligible"] <= metric["n_interior"]
    toml = tmp_path / "p.toml"
    toml.write_text('method = "kde_valley"\nalpha_nm = 500.0\n')
    assert artifacts.config_from_toml(str(toml)) == C.KdeValleyConfig(alpha_nm=500.0)


def test_edge_errors(spark):
    same = from_vectors(spark, [1.0] * 12, [1.0] * 12, fov=(0, 10, 0, 10))
    with pytest.raises(RuntimeError):
        api.classify_emitters(same, C.OuterPolygonConfig(k_list=(2,), rho_k_thresh=0))
    with pytest.raises(ValueError):
        api.classify_emitters(from_vectors(spark, [1.0], [1.0]), C.OuterPolygonConfig())


def test_numbers_of_artifacts_are_rounded_as_in_sql():
    import duckdb

    at = 1704067200000000 + 1632566318400  # a half after scaling, and less than it in decimals
    values = [18.8954435, at / 86400000000.0 - 19723 + 0.0, -18.8954435, 0.0000005, 2.5e-7, 0.49999999999999994e-6, -0.0, 1e300, *(k / 16 + 5e-7 for k in range(200))]
    want = [duckdb.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values]
    assert [artifacts.rounded(v, 6) for v in values] == want and want[0] != round(values[0], 6)
