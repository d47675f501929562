"""Labelling configurations.

Density clustering (dbscan, precision_dbscan) and single linkage at a height are plans of
joins and components. Voronoi, MRF, hysteresis, HDBSCAN and other linkages run a kernel for
each group over rows in index order, on neighbour edges that Spark has joined beforehand;
pooled points are one group and one task.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..api import label_points
from ..configs import DBSCANConfig, HDBSCANConfig, HierarchicalConfig, MRFDensityConfig, PointHysteresisConfig, PrecisionDBSCANConfig, VoronoiConfig
from ..functions.geometry import sigma_eff
from ..kernels import delaunay, fields, trees
from ..operators import labels as L
from ..operators.knn import knn_join
from ..operators.range_join import NeighborGraph
from ..operators.shared import written
from ..operators.tiles import kth_distances
from ..points import PointSet, axes


def grouped(points: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns g (the group), emitter_idx and others; one group when pooled."""
    return points.select((F.col(keys[0]) if keys else F.lit(0)).cast("int").alias("g"), "emitter_idx", *columns)


def _edges(pdf: pd.DataFrame, edges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge ends as places in pdf."""
    ids = pdf["emitter_idx"].to_numpy()
    e = edges.sort_values(["src", "rank"] if "rank" in edges else ["src", "dst"], kind="stable")
    return np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy()), e["d"].to_numpy(float)


def _with_knn(points: DataFrame, keys: list[str], k: int, xs: list[str], columns: list[str]) -> tuple:
    g = grouped(points, keys, columns)
    near = knn_join(g, g, k, xs, ["g"])
    return g, near


def _with_kth(g: DataFrame, k: int) -> DataFrame:
    """g with far, the distance to the k-th other point of the group; null if there are fewer. Copies are one site with a count."""
    p = written(g, "points")
    d = kth_distances(p, p, [k], ["x", "y"], True, ["g"]).select(*[F.col(c).alias(f"_{c}") for c in ("g", "x", "y")], F.col(f"d{k}").alias("far"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("g", "x", "y")]
    return written(p.join(d, same, "left").select(*g.columns, "far"), "far")


LABELS = "g int, emitter_idx long, label int"


def _named(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.select(*[F.col("g").alias(k) for k in keys], "emitter_idx", "label")


def _counted(found: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, dict[str, Any]]:
    """Labels, and metadata with the number of points of each, as sites have them."""
    return found[0], {"cluster_counts": found[1]}


@label_points.register
def _(config: DBSCANConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    xs = axes(ps.points, config.use_3d)
    p = ps.points.select(*config.keys, "emitter_idx", *xs)
    return _counted(L.range_labelled(p, config.eps_nm / 1000, xs, config.keys, config.min_points - 1, config.min_points))


@label_points.register
def _(config: PrecisionDBSCANConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    xs = axes(ps.points, config.use_3d)
    p = ps.points.select(*config.keys, "emitter_idx", *xs, sigma_eff(config.use_3d).alias("sigma"))
    top = p.agg(F.max("sigma")).first()[0] or 0.0
    if top <= 0:
        raise ValueError("localization uncertainties must be positive")
    return _counted(L.range_labelled(p, config.nsigma * 2 * top, xs, config.keys, config.min_points - 1, config.min_points, config.nsigma))


def precision_labels(graph: NeighborGraph, sigma: DataFrame, nsigma: float, min_points: int = 1, check_superset: bool = True) -> DataFrame:
    """Labels on a kept graph: without noise and from the components of active edges if min_points is 0."""
    if min_points < 0 or nsigma <= 0:
        raise ValueError("nsigma must be > 0 and min_points >= 0")
    if check_superset:
        graph.check(sigma, nsigma)
    p = written(graph.points.select(*graph.keys, "emitter_idx", *graph.axes).join(sigma.select("emitter_idx", "sigma"), "emitter_idx", "left"), "points")
    return L.range_labels(p, graph.max_radius, graph.axes, graph.keys, max(min_points - 1, 0), nsigma=nsigma)


@label_points.register
def _(config: HierarchicalConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    xs, keys = axes(ps.points, config.use_3d), config.keys
    cut = config.cut_threshold if config.cut_threshold is None or config.linkage == "ward" else config.cut_threshold / 1000
    if config.linkage == "single" and cut is not None:
        return _counted(L.range_labelled(ps.points.select(*keys, "emitter_idx", *xs), cut, xs, keys, 0, config.min_points))
    else:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("emitter_idx", kind="stable")
            n = None if config.n_clusters is None else min(config.n_clusters, len(pdf))
            return pdf[["g", "emitter_idx"]].assign(label=trees.linkage_labels(pdf[xs].to_numpy(float), config.linkage, cut, n).astype("int32"))

        raw = _named(grouped(ps.points, keys, xs).groupBy("g").applyInPandas(run, LABELS), keys)
    return L.compacted(raw, config.min_points, keys), {}


@label_points.register
def _(config: HDBSCANConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    xs, keys = axes(ps.points, config.use_3d), config.keys
    size = config.min_cluster_size or max(config.min_points, 2)
    g, near = _with_knn(ps.points, keys, max(config.knn_graph_k, config.min_points), xs, xs)

    def run(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("emitter_idx", kind="stable")
        src, dst, d = _edges(pdf, edges)
        rank, x, n = edges.sort_values(["src", "rank"], kind="stable")["rank"].to_numpy(), pdf[xs].to_numpy(float), len(pdf)
        core = np.zeros(n)
        at = rank == min(config.min_points, n - 1)
        core[src[at]] = d[at]
        used = rank <= config.knn_graph_k
        labels, persistence, birth = trees.hdbscan(x, src[used], dst[used], d[used], core, size, config.cluster_selection_method, config.allow_single_cluster, config.halo_trim_frac)
        of = lambda v: [v[k - 1] if k else None for k in labels]
        return pdf[["g", "emitter_idx"]].assign(label=labels.astype("int32"), persistence=pd.array(of(persistence), "Float64"), lambda_birth=pd.array(of(birth), "Float64"))

    out = written(g.groupBy("g").cogroup(near.groupBy("g")).applyInPandas(run, LABELS + ", persistence double, lambda_birth double"), "hdbscan")
    clusters = out.filter("label > 0").groupBy("g", "label").agg(F.first("persistence").alias("persistence"), F.first("lambda_birth").alias("lambda_birth"))
    return _named(out, keys), {"hdbscan_clusters": clusters}


def voronoi_cells(points: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (g, emitter_idx, area): cells cut to the group's convex hull; null for groups of fewer than three points or on a line. Duplicates raise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("emitter_idx", kind="stable")
        area = delaunay.voronoi_areas(pdf[["x", "y"]].to_numpy(float))[0] if len(pdf) > 2 else np.full(len(pdf), np.nan)
        return pdf[["g", "emitter_idx"]].assign(area=pd.array([None if np.isnan(a) else a for a in area], "Float64"))

    return grouped(points, keys, ["x", "y"]).groupBy("g").applyInPandas(run, "g int, emitter_idx long, area double")


@label_points.register
def _(config: VoronoiConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    keys = config.keys

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("emitter_idx", kind="stable")
        labels = np.zeros(len(pdf), int)
        if len(pdf) > 2:
            area, edges = delaunay.voronoi_areas(pdf[["x", "y"]].to_numpy(float))
            if len(edges):
                labels = fields.parts(len(pdf), fields.neighbours(len(pdf), edges), area < area.sum() / len(pdf) / config.density_factor)
        return pdf[["g", "emitter_idx"]].assign(label=labels.astype("int32"))

    raw = written(grouped(ps.points, keys, ["x", "y"]).groupBy("g").applyInPandas(run, LABELS), "voronoi")
    return L.compacted(_named(raw, keys), config.min_points, keys), {}


def regime_labels(points: pa.Table, edges: pa.Table | None, config: MRFDensityConfig) -> pa.Table:
    """Regimes (from 1; 0 where there is no density) and foreground components of one group; all in flat arrays, as a group is one task."""
    points = points.sort_by("emitter_idx")
    n, ids = points.num_rows, points["emitter_idx"].to_numpy()
    regime, labels, smooth, means = np.zeros(n, int), np.zeros(n, int), np.nan, [np.nan] * config.n_regimes
    x = np.column_stack([points[c].to_numpy() for c in ("x", "y")]).astype(float)

    def done() -> pa.Table:
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(means), pa.array(np.tile(np.asarray(means, float), n), from_pandas=True))
        return pa.table({"g": points["g"], "emitter_idx": points["emitter_idx"], "label": pa.array(labels.astype(np.int32)), "regime": pa.array(regime.astype(np.int32)), "smooth": pa.array(np.full(n, smooth, float), from_pandas=True), "means": lists})

    if n < 3:
        return done()
    pairs = np.empty((0, 2), np.int64)
    density = np.full(n, np.nan)
    if config.density_estimator == "voronoi" or config.graph_kind == "delaunay":
        area, pairs = delaunay.voronoi_areas(x)
        if config.density_estimator == "voronoi":
            with np.errstate(divide="ignore"):
                density = np.where(area > 0, 1 / area, np.nan)
    if config.density_estimator == "knn":
        far = points["far"].to_numpy().astype(float)
        at = far > 0
        density[at] = config.density_k / (np.pi * far[at] ** 2)
    if edges is not None and edges.num_rows:
        code, at = np.empty(edges.num_rows, np.int64), 0
        for batch in edges.to_batches(max_chunksize=1 << 16):
            src, dst = (np.searchsorted(ids, batch[c].to_numpy()) for c in ("src", "dst"))
            code[at : at + len(src)] = np.minimum(src, dst) * n + np.maximum(src, dst)
            at += len(src)
        code.sort()
        code = code[np.r_[True, code[1:] != code[:-1]]]
        pairs = np.column_stack([(code // n).astype(np.int32), (code % n).astype(np.int32)])
        del code
    valid = np.isfinite(density) & (density > 0)
    if valid.sum() < config.n_regimes:
        return done()
    v = np.flatnonzero(valid)
    log_density = np.log(density[v])
    gaussians = config.regime_gaussians
    if config.regime_thresholds is None and gaussians is None:
        gaussians = fields.mixture(log_density, config.n_regimes)
        if gaussians is None:
            regime[v] = 1
            return done()
    u = fields.costs(log_density, gaussians, None if config.regime_thresholds is None else list(config.regime_thresholds))
    smooth = fields.smoothness(u) if config.smoothness_lambda is None else config.smoothness_lambda
    place = np.full(n, -1, np.int32)
    place[v] = np.arange(len(v))
    pairs = place[pairs] if len(pairs) else pairs
    pairs = pairs[(pairs >= 0).all(1)] if len(pairs) else pairs
    near = fields.neighbours(len(v), pairs)
    z = fields.potts(u, near, smooth, config.icm_iters)
    regime[v] = z + 1
    labels[v] = fields.parts(len(v), near, z > 0)
    means = gaussians["means"] if gaussians else means
    return done()


@label_points.register
def _(config: MRFDensityConfig, ps: PointSet) -> tuple[DataFrame, dict[str, Any]]:
    keys = config.keys
    schema = LABELS + ", regime int, smooth double, means array<double>"
    g = grouped(ps.points, keys, ["x", "y"])
    asks = None
    if config.density_estimator == "knn":
        g = _with_kth(g, config.density_k)
        # only points with a density have edges
        asks = g.filter("far > 0")
    if config.graph_kind == "knn":
        near = knn_join(g if asks is None else asks, g, config.graph_k, ["x", "y"], ["g"])
        raw = g.groupBy("g").cogroup(near.select("g", "src", "dst").groupBy("g")).applyInArrow(lambda a, b: regime_labels(a, b, config), schema)
    else:
        raw = g.groupBy("g").applyInArrow(lambda a: regime_labels(a, None, config), schema)
    raw = written(raw, "regimes")
    groups = raw.groupBy("g").agg(F.first("smooth").alias("smoothness_lambda"), F.first("means").alias("regime_means"))
    return L.compacted(_named(raw, keys), config.min_points, keys), {"mrf_regime_per_emitter": raw.select("emitter_idx", "regime"), "mrf_groups": groups}


def calibrate_regime_gaussians(ps: PointSet, n_regimes: int = 2, density_estimator: str = "knn", density_k: int = 20) -> dict[str, list[float]]:
    """A mixture of log densities, all datasets pooled, by expectation maximisation over partial sums in the cluster."""
    if n_regimes < 2 or density_k < 1:
        raise ValueError(f"calibration needs n_regimes >= 2 and density_k >= 1; got {n_regimes} and {density_k}")
    x = log_densities(ps, density_estimator, density_k)
    return distributed_mixture(written(x, "density"), n_regimes)


def log_densities(ps: PointSet, density_estimator: str = "knn", density_k: int = 20) -> DataFrame:
    """Rows (emitter_idx, x): finite log densities."""
    if density_estimator == "voronoi":
        area = voronoi_cells(ps.points, [])
        return area.filter("area > 0").select("emitter_idx", (-F.ln("area")).alias("x"))
    if density_estimator != "knn":
        raise ValueError(f"unknown density_estimator {density_estimator}")
    near = knn_join(ps.points, ps.points, density_k, ["x", "y"]).filter(F.col("rank") == density_k).filter("d > 0")
    return near.select(F.col("src").alias("emitter_idx"), (F.log(F.lit(float(density_k))) - F.log(F.lit(float(np.pi))) - 2 * F.log("d")).alias("x"))


def distributed_mixture(x: DataFrame, k: int) -> dict[str, list[float]]:
    """As the kernel's mixture, a round of sums at a time; the start is at the same order statistics."""
    s = x.agg(F.count("*").alias("n"), F.var_samp("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    n = s["n"]
    if n < k or s["lo"] == s["hi"]:
        raise RuntimeError("too few distinct densities for a mixture")
    # the value at place floor(j n / (k + 1)), from 0
    starts = x.agg(*[F.expr(f"percentile_disc({(min(int(j / (k + 1) * n), n - 1) + 0.5) / n!r}D) WITHIN GROUP (ORDER BY x)").alias(f"q{j}") for j in range(1, k + 1)]).first()
    mean, var, weight, before = list(starts), [max(s["v"], 1e-10)] * k, [1 / k] * k, -np.inf
    for _ in range(fields.MOST_ROUNDS):
        logs = [F.lit(float(np.log(w) - 0.5 * np.log(2 * np.pi * v))) - (F.col("x") - F.lit(float(m))) * (F.col("x") - F.lit(float(m))) / F.lit(2 * float(v)) for m, v, w in zip(mean, var, weight, strict=True)]
        top = F.greatest(*logs)
        total = top + F.ln(sum((F.exp(l - top) for l in logs[1:]), F.exp(logs[0] - top)))
        rows = x.select("x", total.alias("t"), *[F.exp(l - total).alias(f"r{j}") for j, l in enumerate(logs)])
        sums = rows.agg(F.sum("t").alias("t"), *[F.sum(F.col(f"r{j}") * (F.col("x") ** e if e else F.lit(1.0))).alias(f"s{j}_{e}") for j in range(k) for e in (0, 1, 2)]).first()
        mass = [sums[f"s{j}_0"] for j in range(k)]
        if min(mass) < fields.STARVED:
            raise RuntimeError("a regime starved")
        mean = [sums[f"s{j}_1"] / mass[j] for j in range(k)]
        var = [max(sums[f"s{j}_2"] / mass[j] - mean[j] ** 2, 1e-12) for j in range(k)]
        weight = [m / s["n"] for m in mass]
        if abs(sums["t"] - before) < fields.SETTLED:
            break
        before = sums["t"]
    o = np.argsort(mean, kind="stable")
    return {"means": [mean[i] for i in o], "vars": [var[i] for i in o], "weights": [weight[i] for i in o]}


def calibrate_regime_thresholds(ps: PointSet, n_regimes: int = 2, density_estimator: str = "knn", density_k: int = 20) -> list[float]:
    g = calibrate_regime_gaussians(ps, n_regimes, density_estimator, density_k)
    parts = list(zip(g["means"], g["vars"], g["weights"], strict=True))
    return [fields.boundary(*a, *b) for a, b in zip(parts, parts[1:], strict=False)]


@label_points.register
def _(config: PointHysteresisConfig, ps: PointSet, seed: Column | str = "seed", support: Column | str = "support") -> tuple[DataFrame, dict[str, Any]]:
    xs, keys = axes(ps.points, config.use_3d), config.keys
    masks = [(F.expr(m) if isinstance(m, str) else m) for m in (seed, support)]
    p = ps.points.withColumns({"_seed": F.coalesce(masks[0], F.lit(False)), "_support": F.coalesce(masks[1], F.lit(False))})
    if p.filter("_seed and not _support").limit(1).count():
        raise ValueError("every seed must be a support point")
    g, near = _with_knn(p, keys, config.graph_k, xs, [*xs, "_seed", "_support"])

    def run(pdf: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("emitter_idx", kind="stable")
        n = len(pdf)
        labels = np.zeros(n, int)
        if n >= config.min_points and n > 1:
            src, dst, _ = _edges(pdf, edges)
            at = np.searchsorted(src, np.arange(n + 1))
            labels = fields.grown([dst[a:b] for a, b in zip(at, at[1:], strict=False)], pdf["_seed"].to_numpy(bool), pdf["_support"].to_numpy(bool), config.min_points)
        return pdf[["g", "emitter_idx"]].assign(label=labels.astype("int32"))

    return _named(written(g.groupBy("g").cogroup(near.groupBy("g")).applyInPandas(run, LABELS), "grown"), keys), {}
