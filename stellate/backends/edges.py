"""Edge classification: density gate, alpha-shape mask, labels by distance to the mask's rings.

Gates, core filter and labels are plans over all points. The shape itself is found by a kernel
that gets the distinct gated points of the field of view; its rings come to the driver, as
they are a boundary's vertices and not the cloud.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..api import classify_points
from ..configs import EdgeConfig, KdeValleyConfig, OuterPolygonConfig
from ..functions.geometry import unbiased_density
from ..kernels import rings as R
from ..operators.shared import written
from ..operators.tiles import kth_distances, many, near_sums, pa_schema, site_sums, sites, spread
from ..points import PointSet

OUTSIDE, MEMBRANE, INTERIOR = "outside", "membrane", "interior"
CODES = {OUTSIDE: 0, MEMBRANE: 1, INTERIOR: 2}
DIAGNOSTIC_K = 128


@dataclass(frozen=True)
class EdgeInfo:
    """What a classification found; points has class, inside_outer and dist_to_outer_um (NaN outside)."""

    config: EdgeConfig
    points: DataFrame
    fov: tuple[float, float, float, float]
    sides: dict[str, bool]
    loops: list[R.Ring]
    cells: list[dict]
    loop_diagnostics: list[dict] = field(default_factory=list)
    runtime_s: float = 0.0

    @property
    def outer_polygon(self) -> R.Ring:
        return self.cells[0]["outer"]

    def class_counts(self) -> dict[str, int]:
        found = {r["class"]: r["count"] for r in self.points.groupBy("class").count().collect()}
        return {c: found.get(c, 0) for c in CODES}

    def interior_fraction(self) -> float:
        n = self.class_counts()
        return n[INTERIOR] / max(sum(n.values()), 1)

    def in_cell(self) -> DataFrame:
        return self.points.select("emitter_idx", (F.col("class") != OUTSIDE).alias("in_cell"))

    def interior_mask(self) -> DataFrame:
        return self.points.select("emitter_idx", (F.col("class") == INTERIOR).alias("interior"))

    def __repr__(self) -> str:
        return f"EdgeInfo({self.config.method_name}, {len(self.cells)} cells, {len(self.loops)} loops)"


def class_codes(points: DataFrame) -> DataFrame:
    code = F.create_map(*[F.lit(v) for kv in CODES.items() for v in kv])
    return points.withColumn("class_code", F.element_at(code, F.col("class")))


def multi_k_gate(points: DataFrame, k_list: tuple[int, ...], threshold: float) -> DataFrame:
    """Rows (emitter_idx) whose (K - 1) / (pi d_K^2) reaches the threshold for every K (clamped to n - 1)."""
    n = points.count()
    ks = sorted({min(k, n - 1) for k in k_list if min(k, n - 1) >= 1})
    if not ks:
        return points.select("emitter_idx")
    p = written(points.select("emitter_idx", "x", "y"), "points")
    far = kth_distances(p, p, ks, ["x", "y"], True)
    rho = [unbiased_density(k, F.col(f"d{k}")) for k in ks]
    return members_of(p, far, (F.least(*rho) if len(rho) > 1 else rho[0]).alias("rho")).filter(F.col("rho") >= threshold).select("emitter_idx")


def kde_density(points: DataFrame, sigma: float, rmax_sigma: float = 3.0) -> DataFrame:
    """Rows (emitter_idx, rho): Gaussian kernel density of the other points within rmax_sigma * sigma."""
    p = points.select("emitter_idx", "x", "y")
    return spread(p, written(_site_density(p, sigma, rmax_sigma), "kde"), [], ["x", "y"], "rho")


def _site_density(points: DataFrame, sigma: float, rmax_sigma: float) -> DataFrame:
    """Rows (x, y, _own, site, n, rho): kernel density of places; points without coordinates are a place each and have none."""
    held = written(sites(points.select("emitter_idx", "x", "y"), ["x", "y"], []), "sites")
    s = site_sums(held.filter("_own is null").select("x", "y", "site", "n", F.lit(True).alias("asks")), rmax_sigma * sigma, ["x", "y"], ["kernel"], sigma)
    # the point itself isn't one of the others
    rho = F.greatest(F.col("kernel") - 1, F.lit(0.0)) / F.lit(2 * math.pi * sigma * sigma)
    found = s.select("x", "y", F.lit(None).cast("long").alias("_own"), "site", "n", rho.alias("rho"))
    return found.unionByName(held.filter("_own is not null").select("x", "y", "_own", "site", "n", F.lit(0.0).alias("rho")))


def members_of(points: DataFrame, sums: DataFrame, value: Column) -> DataFrame:
    """points with a value of their place, null where it has none."""
    s = sums.select(F.col("x").alias("_x"), F.col("y").alias("_y"), value)
    return points.join(s, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y")), "left").drop("_x", "_y")


def places(points: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (_<column>..., n): distinct values and how many points have them, dealt out for kernels."""
    return points.groupBy(*columns).agg(F.count("*").alias("n")).select(*[F.col(c).alias(f"_{c}") for c in columns], "n").repartition(many(points.sparkSession), *[f"_{c}" for c in columns])


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[pa.Table]:
    """Batches put together, so that kernels get many points at once."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def histogram(values: DataFrame, column: str, bins: int, weight: str | None = None) -> DataFrame:
    """Rows (bin from 1, n, lo, hi): equal widths from least to largest, the top edge in the last bin, empty bins too; a row counts as many as its weight."""
    ends = values.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    held = values.crossJoin(F.broadcast(ends))  # one row
    b = F.least(F.floor((F.col(column) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins) + 1, F.lit(bins))
    counts = held.groupBy(F.coalesce(b, F.lit(1)).cast("int").alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    every = ends.select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "lo", "hi")


def left_base(values: DataFrame, column: str, bins: int, floor_frac: float, smooth: int, weight: str | None = None) -> DataFrame:
    """One row (threshold): from the first peak of the smoothed histogram leftwards to the first bin under floor_frac of it; its centre. A constant is its own base."""
    h = histogram(values, column, bins, weight)
    sm = h.withColumn("hs", F.avg("n").over(Window.orderBy("bin").rowsBetween(-smooth, smooth)))  # as many rows as bins
    peak = sm.agg(F.max("hs").alias("top")).crossJoin(sm).filter("hs = top").agg(F.min("bin").alias("pk"), F.max("top").alias("top"))
    low = sm.crossJoin(peak).filter((F.col("bin") <= F.col("pk")) & (F.col("hs") < F.col("top") * floor_frac)).agg(F.max("bin").alias("at"))
    out = h.filter("bin = 1").crossJoin(low).select((F.col("lo") + (F.coalesce("at", F.lit(1)) - 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("threshold"))
    return out


def valley_gate(points: DataFrame, config: KdeValleyConfig) -> DataFrame:
    """Rows (emitter_idx, dense): whether the kernel density reaches the left base of its histogram's peak."""
    p = points.select("emitter_idx", "x", "y")
    return spread(p, _dense_sites(p, config), [], ["x", "y"], "dense")


def _dense_sites(points: DataFrame, config: KdeValleyConfig) -> DataFrame:
    """Rows (x, y, _own, site, n, dense) of places."""
    rho = written(_site_density(points, config.sigma_nm / 1000, config.rmax_sigma).withColumn("l", F.log10(F.col("rho") + 1)), "kde")
    at = left_base(rho, "l", config.valley_nbins, config.valley_floorfrac, config.valley_smooth, "n").first()[0]
    return rho.select("x", "y", "_own", "site", "n", (F.col("rho") >= F.lit(10.0**at - 1)).alias("dense"))


def footprint_gate(points: DataFrame, config: KdeValleyConfig, fov: tuple[float, float, float, float]) -> DataFrame:
    """Rows (emitter_idx) within the filled footprint of points above the density valley. The raster's kernel gets the bins that hold such points, and no points."""
    size = config.footprint_bin_um
    x0, y0, columns, rows = R.raster(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first(), fov, size)
    place = lambda c, lo, n: F.greatest(F.least(F.floor((F.col(c) - F.lit(float(lo))) / F.lit(float(size))), F.lit(n - 1)), F.lit(0)).cast("int")
    binned = points.select("emitter_idx", place("x", x0, columns).alias("bx"), place("y", y0, rows).alias("by"))
    dense = _dense_sites(points, config).filter("dense").select(place("x", x0, columns).alias("bx"), place("y", y0, rows).alias("by")).filter("bx is not null and by is not null").distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = np.nonzero(R.filled(pdf["bx"].to_numpy(), pdf["by"].to_numpy(), (columns, rows), config.footprint_closing_px))
        return pd.DataFrame({"bx": i.astype(np.int32), "by": j.astype(np.int32)})

    full = written(dense.groupBy(F.lit(0).alias("g")).applyInPandas(run, "bx int, by int"), "footprint")
    return binned.join(full, ["bx", "by"], "left_semi").select("emitter_idx")


def core_gate(points: DataFrame, radius: float, frac: float) -> DataFrame:
    """Points with at least frac of the median number of neighbours within the radius."""
    if frac <= 0 or points.count() < 3:
        return points
    counts = written(members_of(points.select("emitter_idx", "x", "y"), near_sums(points, points, radius, ["x", "y"], []), (F.col("m") - 1).alias("n")).select("emitter_idx", F.coalesce("n", F.lit(0)).alias("n")), "counts")
    kept = counts.crossJoin(F.broadcast(counts.agg(F.median("n").alias("m")))).filter(F.col("n") >= F.col("m") * frac)  # one row
    return points.join(kept.select("emitter_idx"), "emitter_idx", "left_semi")


def truncated_sides(points: DataFrame, fov: tuple[float, float, float, float], tol: float) -> dict[str, bool]:
    b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    return {"L": b[0] - fov[0] <= tol, "R": fov[1] - b[1] <= tol, "B": b[2] - fov[2] <= tol, "T": fov[3] - b[3] <= tol}


def labelled(points: DataFrame, cells: list[dict], membrane: float, fov, tol: float, sides: dict[str, bool]) -> DataFrame:
    """points with class, inside_outer and dist_to_outer_um; each task labels its own points, so none is moved."""
    from pyspark.sql import types as T

    s = R.segments([r for c in cells for r in (c["outer"], *c["holes"])])
    s = s[~R.on_cut(s, fov, tol, sides)] if len(s) else s
    points = points.drop("class", "inside_outer", "dist_to_outer_um")
    schema = T.StructType([*points.schema.fields, T.StructField("class", T.StringType()), T.StructField("inside_outer", T.BooleanType()), T.StructField("dist_to_outer_um", T.DoubleType())])
    arrow = pa_schema(schema)

    def run(batches):
        for t in chunks(batches):
            x, y = (t[c].to_numpy().astype(float) for c in ("x", "y"))
            held = R.in_region(x, y, cells)
            # NaN, not null, at the edge of the API
            d = np.full(len(x), np.nan)
            d[held] = R.segment_distance(x[held], y[held], s)[0]
            with np.errstate(invalid="ignore"):
                kind = np.where(~held, OUTSIDE, np.where(d < membrane, MEMBRANE, INTERIOR))
            columns = [*t.columns, pa.array(kind, pa.string()), pa.array(held), pa.array(d, pa.float64(), from_pandas=False)]
            yield from pa.Table.from_arrays(columns, schema=arrow).to_batches(max_chunksize=10_000)

    return points.mapInArrow(run, schema)


def loop_diagnostics(points: DataFrame, loops: list[R.Ring], cells: list[dict], fov, dense: float) -> list[dict]:
    """A row for each loop: size, area, points inside, shares of vertices in the field of view and in dense places, and what it seems to be."""
    spark = points.sparkSession
    n = points.count()
    k = min(DIAGNOSTIC_K, max(n, 1))
    rows = [(-(i * 1_000_000 + j) - 1, i, float(x), float(y)) for i, loop in enumerate(loops) for j, (x, y) in enumerate(loop)]
    verts = written(spark.createDataFrame(rows, "emitter_idx long, loop int, x double, y double"), "vertices")
    near = members_of(verts, kth_distances(verts, points, [k], ["x", "y"], False).filter(F.col(f"d{k}").isNotNull()), F.col(f"d{k}").alias("d")).filter("d is not null")
    rho = unbiased_density(k, F.col("d"))
    x0, x1, y0, y1 = fov
    here = (F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).cast("double")
    seen = {r["loop"]: r for r in near.groupBy("loop").agg(F.avg(here).alias("frac_in_fov"), F.avg((rho >= dense).cast("double")).alias("frac_dense"), F.median(rho).alias("median_rho")).collect()}

    def counts(batches):
        total = np.zeros(len(loops), np.int64)
        for t in chunks(batches):
            x, y = (t[c].to_numpy().astype(float) for c in ("x", "y"))
            total += [int(R.inside(x, y, loop).sum()) for loop in loops]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(loops), dtype=np.int32)), pa.array(total)], names=["loop", "n"])

    held = {r["loop"]: r["n"] for r in points.select("x", "y").mapInArrow(counts, "loop int, n long").groupBy("loop").agg(F.sum("n").alias("n")).collect()}
    used = {frozenset(r) for c in cells for r in (c["outer"], *c["holes"])}
    out = []
    for i, loop in enumerate(loops):
        s = seen.get(i)
        inner = frozenset(loop) in used
        kind = "outer" if inner else "fov_crossing" if s["frac_in_fov"] < 1 else "interior_dense" if s["frac_dense"] >= 0.8 else "interior_sparse"
        out.append({"loop_id": i + 1, "vertex_count": len(loop), "area_um2": abs(R.shoelace(loop)), "n_emitters_inside": held.get(i, 0), "frac_in_fov": s["frac_in_fov"], "frac_dense": s["frac_dense"], "median_rhoK": s["median_rho"], "used_in_outer": inner, "heuristic_type": kind})
    return out


def alpha_shape(points: DataFrame, config: EdgeConfig) -> list[R.Ring]:
    """Boundary loops of distinct points; the kernel gets the points, the driver their boundary."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf.sort_values(["x", "y"], kind="stable")[["x", "y"]].to_numpy(float)
        loops = R.alpha_loops(xy, config.alpha_nm / 1000, config.alpha_knn if config.alpha_adaptive else None, config.alpha_scale)
        return pd.DataFrame([(i, j, *v) for i, loop in enumerate(loops) for j, v in enumerate(loop)], columns=["loop", "vertex", "x", "y"])

    found = points.select("x", "y").distinct().groupBy(F.lit(0).alias("g")).applyInPandas(run, "loop int, vertex int, x double, y double").collect()
    loops: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["loop"], r["vertex"])):
        loops.setdefault(r["loop"], []).append((r["x"], r["y"]))
    return [loops[i] for i in sorted(loops)]


def _fail(config: EdgeConfig, said: str) -> None:
    raise RuntimeError(f"{config.method_name}: {said}")


def classified(ps: PointSet, config: EdgeConfig) -> tuple[PointSet, EdgeInfo]:
    began = time.time()
    fov = ps.fov
    if fov is None or not (fov[0] < fov[1] and fov[2] < fov[3]):
        raise ValueError("classification needs a field of view with xmin < xmax and ymin < ymax")
    p = ps.points
    if not p.limit(1).count():
        _fail(config, "no points to classify")
    gate = footprint_gate(p, config, fov) if isinstance(config, KdeValleyConfig) else multi_k_gate(p, config.k_list, config.rho_k_thresh)
    gated = written(p.join(gate, "emitter_idx", "left_semi").select("emitter_idx", "x", "y"), "gated")
    if not gated.limit(1).count():
        _fail(config, "the density gate left no points; the cloud is too sparse or parameters too strict")
    core = written(core_gate(gated, config.core_radius_nm / 1000, config.core_frac), "core")
    if core.limit(3).count() < 3:
        _fail(config, "too few points after the relative density gate")
    tol = config.fov_trunc_tol_nm / 1000
    sides = truncated_sides(core, fov, tol)
    loops = alpha_shape(core, config)
    if not loops:
        _fail(config, "no boundary loops")
    cells = R.build_mask(loops, config.keep_internal, config.min_cell_frac, config.min_hole_frac)
    if not cells:
        _fail(config, "no cell is large enough")
    out = written(labelled(p, cells, config.membrane_nm / 1000, fov, tol, sides), "classes")
    dense = config.rho_k_thresh if isinstance(config, OuterPolygonConfig) else 0.0
    info = EdgeInfo(config, out, fov, sides, loops, cells, loop_diagnostics(p, loops, cells, fov, dense), time.time() - began)
    return ps.with_points(out, edge_cells=cells, edge_outer_polygon=info.outer_polygon), info


@classify_points.register
def _(config: OuterPolygonConfig, ps: PointSet):
    return classified(ps, config)


@classify_points.register
def _(config: KdeValleyConfig, ps: PointSet):
    return classified(ps, config)


def edge_report(info: EdgeInfo) -> dict[str, Any]:
    """Class fractions and what they belong to."""
    n = info.class_counts()
    total = max(sum(n.values()), 1)
    return {"info": info, "n": sum(n.values())} | {f"frac_{c}": v / total for c, v in n.items()}


def concavity_metric(info: EdgeInfo, buffer_um: float = 2.0, asym_R_nm: float = 1000.0, asym_gate: float = 0.20, rho_lo: float = 200.0, intracellular_dense_threshold: float = 0.8) -> tuple[dict[str, Any], DataFrame]:
    """(counts, suspects): interior points of the dominant cell near its boundary, outside dense voids, whose neighbourhood leans one way at low density. K is clamped to n - 1."""
    p = info.points
    voids = [loop for loop, d in zip(info.loops, info.loop_diagnostics, strict=True) if d["loop_id"] != 1 and d["frac_in_fov"] == 1.0 and d["frac_dense"] >= intracellular_dense_threshold]
    outer, fov, radius = info.outer_polygon, info.fov, asym_R_nm / 1000
    segs = R.segments([outer])

    def near_edge(batches):
        for pdf in batches:
            x, y = pdf["_x"].to_numpy(float), pdf["_y"].to_numpy(float)
            ok = (pdf["_class"] == INTERIOR).to_numpy() & R.inside(x, y, outer) & (pdf["_dist_to_outer_um"].to_numpy(float) <= buffer_um)
            for v in voids:
                ok &= ~R.inside(x, y, v)
            s = segs[R.segment_distance(x[ok], y[ok], segs)[1]]
            cut = ~((s[:, [0, 2]] >= fov[0]) & (s[:, [0, 2]] <= fov[1]) & (s[:, [1, 3]] >= fov[2]) & (s[:, [1, 3]] <= fov[3])).all(1)
            yield pdf.loc[ok, [f"_{c}" for c in same]].assign(is_fov_edge=cut)

    same = ["x", "y", "class", "dist_to_outer_um"]
    found = places(p, same).mapInPandas(near_edge, "_x double, _y double, _class string, _dist_to_outer_um double, is_fov_edge boolean")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    eligible = written(p.join(found, on).select("emitter_idx", "x", "y", "is_fov_edge"), "eligible")
    # the point itself is one of its neighbourhood
    sums = near_sums(eligible, p, radius, ["x", "y"], ["d_x", "d_y"]).filter("m >= 4")
    asym = F.hypot(F.col("d_x") / F.col("m"), F.col("d_y") / F.col("m")) / radius
    lean = members_of(eligible.select("emitter_idx", "x", "y"), sums, asym.alias("asym")).filter(F.col("asym") >= asym_gate).select("emitter_idx", "asym")
    k = min(DIAGNOSTIC_K, p.count() - 1)
    some = written(eligible.join(lean, "emitter_idx"), "leaning")
    rho = members_of(some, kth_distances(some, p, [k], ["x", "y"], True), unbiased_density(k, F.col(f"d{k}")).alias("rho")).select("emitter_idx", "rho") if k >= 1 else some.select("emitter_idx", F.lit(0.0).alias("rho"))
    suspects = written(some.join(rho.filter(F.col("rho") <= rho_lo), "emitter_idx").select("emitter_idx", "x", "y", "is_fov_edge", "asym", "rho"), "suspects")
    edge = suspects.filter("is_fov_edge").count()
    n = suspects.count()
    report = {"buffer_um": buffer_um, "asym_R_nm": asym_R_nm, "asym_gate": asym_gate, "rho_lo": rho_lo, "n_interior": p.filter(F.col("class") == INTERIOR).count(), "n_eligible": eligible.count(), "n_suspect": n, "n_suspect_interior_fov": n - edge, "n_suspect_fov_edge": edge}
    return report, suspects
