import os

import pytest

SF = "/root/testdata/sf0.001"


def test_the_contract_has_a_flagship_and_named_queries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(SF):
        assert e.entry(spark).columns == ["dataset", "id", "n"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", ["range_join", "knn_density", "dbscan", "in_region", "log_density_histogram", "voronoi_areas", "hierarchical_ward", "edge_report"])
def test_against_sql(spark, name):
    import duckdb

    from stellate.plans import registry

    c = duckdb.connect()
    for t in ("events", "embeddings", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    want = c.execute(registry.ORACLE[name]).to_arrow_table().select(got.columns).to_pylist()
    assert sorted(map(str, (r.asDict() for r in got.collect()))) == sorted(map(str, want))


def matches_sql(spark, name, sf):
    import duckdb

    from stellate.plans import registry

    c = duckdb.connect()
    for t in ("events", "embeddings", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = registry.QUERIES[name](spark, sf)
    want = c.execute(registry.ORACLE[name]).to_arrow_table().select(got.columns).to_pylist()
    rows = [r.asDict() for r in got.collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))
    return rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_whole_boundary_edges_grow_with_the_table(spark):
    small, large = (len(matches_sql(spark, "boundary_edges", sf)) for sf in (SF, SF.replace("0.001", "0.01")))
    assert large > 8 * small


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_every_consecutive_triple_has_a_circumradius(spark):
    from stellate.plans import registry

    points = registry.QUERIES["scan_embeddings_cloud_3d"](spark, SF)
    assert len(matches_sql(spark, "circumradius", SF)) == points.count() - 2 * points.select("dataset").distinct().count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_footprint_on_bins_is_that_of_points(spark):
    from stellate import configs as C
    from stellate.backends import edges as E
    from stellate.kernels import rings as R
    from stellate.points import events_cloud

    p, fov, c = events_cloud(spark, SF).points, (0.0, 30.0, 0.0, 6.0), C.KdeValleyConfig(sigma_nm=400, valley_nbins=40, valley_floorfrac=0.3)
    d = p.join(E.valley_gate(p, c), "emitter_idx").select("emitter_idx", "x", "y", "dense").toPandas()
    held = R.footprint(d["x"].to_numpy(), d["y"].to_numpy(), d["dense"].to_numpy(), fov, c.footprint_bin_um, c.footprint_closing_px)
    assert held.any() and {r[0] for r in E.footprint_gate(p, c, fov).collect()} == set(d["emitter_idx"][held].tolist())
