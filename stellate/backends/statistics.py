"""Statistics configurations: Hopkins, Voronoi density, local contrast."""

from __future__ import annotations

import math
import time
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import StatisticsInfo, measure_points
from ..configs import HopkinsConfig, LocalContrastFeature, VoronoiDensityConfig
from ..functions.geometry import hash_uniform, in_mask, in_ring
from ..operators.knn import knn_join, kth_distance
from ..operators.shared import written
from ..points import PointSet, axes
from .labeling import grouped, voronoi_cells

TRIES = 1000


def _value(df: DataFrame, column: str, how) -> float:
    v = df.agg(how(column)).first()[0]
    return math.nan if v is None else float(v)


def log_knn_density(points: DataFrame, k: int, xs: list[str]) -> DataFrame:
    """Rows (g, emitter_idx, f): ln(k / (pi r^2)), the disk area in 3D too; null at r = 0."""
    r = kth_distance(knn_join(points, points, k, xs, ["g"]), k, ["g"])
    return r.select("g", "emitter_idx", (F.ln(F.lit(k / math.pi)) - 2 * F.ln(F.nullif(F.col("r"), F.lit(0.0)))).alias("f"))


def local_contrast(points: DataFrame, keys: list[str], density_k: int, background_k: int, xs: list[str]) -> DataFrame:
    """Rows (g, emitter_idx, f, contrast): log density less the median of the background_k nearest points' log densities.

    Groups of density_k points or fewer have nulls.
    """
    g = written(grouped(points, keys, xs), "points")
    near = written(knn_join(g, g, background_k, xs, ["g"]), "background")
    at = near.filter(F.col("rank") == density_k)
    f = at.select("g", F.col("src").alias("emitter_idx"), (F.ln(F.lit(density_k / math.pi)) - 2 * F.ln(F.nullif(F.col("d"), F.lit(0.0)))).alias("f"))
    base = near.join(f.select("g", F.col("emitter_idx").alias("dst"), "f"), ["g", "dst"]).groupBy("g", F.col("src").alias("emitter_idx")).agg(F.median("f").alias("baseline"))
    out = g.select("g", "emitter_idx").join(f, ["g", "emitter_idx"], "left").join(base, ["g", "emitter_idx"], "left")
    return out.select("g", "emitter_idx", "f", (F.col("f") - F.col("baseline")).alias("contrast"))


@measure_points.register
def _(config: LocalContrastFeature, ps: PointSet) -> StatisticsInfo:
    began = time.time()
    out = written(local_contrast(ps.points, config.keys, config.density_k, config.background_k, axes(ps.points, config.use_3d)), "contrast")
    groups = out.groupBy("g").agg(F.median("contrast").alias("median_local_contrast"))
    points = ps.points.join(out.select("emitter_idx", F.coalesce("f", F.lit(math.nan)).alias("log_density"), F.coalesce("contrast", F.lit(math.nan)).alias("local_contrast")), "emitter_idx")
    return StatisticsInfo(config.statistic_name, _value(out, "contrast", F.median), groups, points, time.time() - began)


@measure_points.register
def _(config: VoronoiDensityConfig, ps: PointSet) -> StatisticsInfo:
    began = time.time()
    out = written(voronoi_cells(ps.points, config.keys).select("g", "emitter_idx", F.when(F.col("area") > 0, 1 / F.nullif(F.col("area"), F.lit(0.0))).alias("density")), "density")
    groups = out.groupBy("g").agg(F.median("density").alias("median_density"))
    points = ps.points.join(out.select("emitter_idx", F.coalesce("density", F.lit(math.nan)).alias("voronoi_density")), "emitter_idx")
    return StatisticsInfo(config.statistic_name, _value(out, "density", F.median), groups, points, time.time() - began)


def _regions(config: HopkinsConfig, ps: PointSet) -> Any:
    """A ring, a mask, a ring for each dataset, or nothing."""
    region = config.region
    if region == "metadata":
        region = ps.metadata.get("edge_cells") or ps.metadata.get("edge_outer_polygon")
        if region is None:
            raise ValueError("the point set has no region in its metadata")
    for ring in region.values() if isinstance(region, dict) else [region] if region and not isinstance(region[0], dict) else []:
        if len(ring) < 3 or not np.isfinite(ring).all():
            raise ValueError("a region needs three or more finite vertices")
    return region


def hopkins_ratios(ps: PointSet, config: HopkinsConfig) -> DataFrame:
    """Rows (g, rep, h): sum u^d / (sum u^d + sum w^d) for each group and repeat; null where it isn't defined.

    Draws are hashes of (seed, group, repeat, draw, axis), so they don't depend on order or
    partitions. References are uniform in the bounding box, or the first of TRIES draws in it
    that fall in the region; data points are those of least hash, without replacement.
    """
    xs = axes(ps.points, config.use_3d)
    region, m, seed = _regions(config, ps), config.n_samples, config.seed or 0
    g = written(grouped(ps.points, config.keys, xs), "points")
    box = g.groupBy("g").agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in xs for p, f in (("lo", F.min), ("hi", F.max))])
    if region is not None:
        of = region if isinstance(region, dict) else None
        if of:
            lost = [r["g"] for r in box.select("g").collect() if r["g"] not in of]
            if lost:
                raise ValueError(f"no region for datasets {lost}")
        rings = of or ([c["outer"] for c in region] if isinstance(region[0], dict) else [region])
        bounds = lambda v: (min(p[0] for p in v), max(p[0] for p in v), min(p[1] for p in v), max(p[1] for p in v))
        if of:
            edges = {k: bounds(v) for k, v in of.items()}
            pick = lambda i: F.coalesce(*[F.when(F.col("g") == k, F.lit(float(e[i]))) for k, e in edges.items()])
        else:
            whole = bounds([p for v in rings for p in v])
            pick = lambda i: F.lit(float(whole[i]))
        box = box.withColumns({"lo_x": pick(0), "hi_x": pick(1), "lo_y": pick(2), "hi_y": pick(3)})
    fine = (F.col("n") >= max(2, m))
    for c in xs:
        fine = fine & (F.col(f"hi_{c}") > F.col(f"lo_{c}"))
    good = written(box.filter(fine), "boxes")
    reps = good.select("*", F.explode(F.sequence(F.lit(1), F.lit(config.random_repeats))).alias("rep"))
    draws = reps.select("*", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("draw"))
    key = lambda what, *more: F.concat_ws("/", F.lit(str(seed)), F.lit(what), "g", "rep", *more)
    at = lambda c, *more: F.col(f"lo_{c}") + hash_uniform(key(c, "draw", *more)) * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))
    if region is None:
        refs = draws.select("g", "rep", "draw", *[at(c).alias(c) for c in xs])
    else:
        tries = draws.select("*", F.explode(F.sequence(F.lit(1), F.lit(TRIES))).alias("try")).select("g", "rep", "draw", "try", *[at(c, "try").alias(c) for c in xs])
        if isinstance(region, dict):
            held = F.coalesce(*[F.when(F.col("g") == k, in_ring(F.col("x"), F.col("y"), v)) for k, v in region.items()])
        elif isinstance(region[0], dict):
            held = in_mask(F.col("x"), F.col("y"), region)
        else:
            held = in_ring(F.col("x"), F.col("y"), region)
        refs = tries.filter(held).groupBy("g", "rep", "draw").agg(*[F.min_by(c, "try").alias(c) for c in xs])
    refs = written(refs.withColumn("emitter_idx", -((F.col("rep") * F.lit(m) + F.col("draw")).cast("long"))), "references")
    d = len(xs)
    u = knn_join(refs, g, 1, xs, ["g"]).join(refs.select("g", F.col("emitter_idx").alias("src"), "rep"), ["g", "src"]).groupBy("g", "rep").agg(F.sum(F.pow("d", F.lit(d))).alias("u"), F.count("*").alias("nu"))
    picks = g.join(reps.select("g", "rep"), "g").select("g", "rep", "emitter_idx", *xs, hash_uniform(key("pick", "emitter_idx")).alias("h"))
    # the m of least hash of each (group, repeat): a limit before and after the exchange
    from pyspark.sql import Window

    picks = written(picks.withColumn("r", F.row_number().over(Window.partitionBy("g", "rep").orderBy("h", "emitter_idx"))).filter(F.col("r") <= m).drop("r", "h"), "picks")
    own = knn_join(picks.dropDuplicates(["g", "emitter_idx"]), g, 1, xs, ["g"])
    w = picks.select("g", "rep", F.col("emitter_idx").alias("src")).join(own, ["g", "src"]).groupBy("g", "rep").agg(F.sum(F.pow("d", F.lit(d))).alias("w"))
    groups = box.select("g", F.explode(F.sequence(F.lit(1), F.lit(config.random_repeats))).alias("rep"))
    out = groups.join(u, ["g", "rep"], "left").join(w, ["g", "rep"], "left")
    return out.select("g", "rep", F.when(F.col("nu") == m, F.col("u") / F.nullif(F.col("u") + F.col("w"), F.lit(0.0))).alias("h"))


@measure_points.register
def _(config: HopkinsConfig, ps: PointSet) -> StatisticsInfo:
    began = time.time()
    groups = written(hopkins_ratios(ps, config).groupBy("g").agg(F.avg("h").alias("hopkins")), "hopkins")
    return StatisticsInfo(config.statistic_name, _value(groups, "hopkins", F.avg), groups, None, time.time() - began)
