"""Queries over what kernels and whole backends find, with SQL that finds the same another way.

The SQL goes by definitions: Delaunay triangles by empty circles, Voronoi cells by corners that
lie in all half planes, linkage by merging the nearest pair of clusters again and again,
growth by the least ancestor that reaches a point, mixtures by a recursive table of parameters.
"""

from __future__ import annotations

import math
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import api
from .. import configs as C
from ..backends import edges as E
from ..backends import labeling
from ..operators.shared import written
from ..points import embeddings_cloud, events_cloud
from ..sources import artifacts
from .registry import EM, EV, HOLE, SQUARE, _LABELS, _mask_labels, knn_sql, labelled, labels_sql, near_sql, query, ring_sql, rounded

# ---- triangulations and cells ------------------------------------------------

_TRI = f"""p AS (SELECT dataset, emitter_idx AS i, x, y FROM ({EM})),
t0 AS (SELECT a.dataset, a.i AS a, b.i AS b, c.i AS c, a.x AS ax, a.y AS ay, b.x - a.x AS ux, b.y - a.y AS uy, c.x - a.x AS vx, c.y - a.y AS vy FROM p a JOIN p b ON a.dataset = b.dataset AND a.i < b.i JOIN p c ON c.dataset = a.dataset AND b.i < c.i),
t1 AS (SELECT *, 2 * (ux * vy - uy * vx) AS d, ux * ux + uy * uy AS u2, vx * vx + vy * vy AS v2 FROM t0),
t2 AS (SELECT dataset, a, b, c, ax + (vy * u2 - uy * v2) / d AS ox, ay + (ux * v2 - vx * u2) / d AS oy, (pow(vy * u2 - uy * v2, 2) + pow(ux * v2 - vx * u2, 2)) / (d * d) AS r2 FROM t1 WHERE d <> 0),
tri AS (SELECT * FROM t2 WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.dataset = t2.dataset AND q.i NOT IN (t2.a, t2.b, t2.c) AND pow(q.x - ox, 2) + pow(q.y - oy, 2) < r2 * (1 - 1e-9))),
de AS (SELECT DISTINCT dataset, unnest([a, a, b]) AS src, unnest([b, c, c]) AS dst FROM tri)"""

_CELLS = f"""{_TRI},
hull AS (SELECT a.dataset, a.x, a.y, b.x AS bx, b.y AS byy FROM p a JOIN p b ON a.dataset = b.dataset AND a.i <> b.i WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.dataset = a.dataset AND (b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) < 0)),
half AS (SELECT a.dataset, a.i, b.x - a.x AS nx, b.y - a.y AS ny, (b.x - a.x) * (a.x + b.x) / 2 + (b.y - a.y) * (a.y + b.y) / 2 AS c FROM p a JOIN de e ON a.dataset = e.dataset AND a.i IN (e.src, e.dst) JOIN p b ON b.dataset = a.dataset AND b.i IN (e.src, e.dst) AND b.i <> a.i
  UNION ALL SELECT p.dataset, p.i, byy - h.y, h.x - bx, (byy - h.y) * h.x + (h.x - bx) * h.y FROM p JOIN hull h USING (dataset)),
hn AS (SELECT *, row_number() OVER (PARTITION BY i) AS k, sqrt(nx * nx + ny * ny) AS len FROM half),
corner AS (SELECT * FROM (SELECT g.dataset, g.i, g.k AS k1, h.k AS k2, (g.c * h.ny - h.c * g.ny) / (g.nx * h.ny - g.ny * h.nx) AS x, (g.nx * h.c - h.nx * g.c) / (g.nx * h.ny - g.ny * h.nx) AS y FROM hn g JOIN hn h ON g.i = h.i AND g.k < h.k WHERE abs(g.nx * h.ny - g.ny * h.nx) > 1e-14 * g.len * h.len) v
  WHERE NOT EXISTS (SELECT 1 FROM hn WHERE hn.i = v.i AND hn.k NOT IN (v.k1, v.k2) AND hn.nx * v.x + hn.ny * v.y > hn.c + 1e-12 * hn.len)),
turned AS (SELECT dataset, i, x, y, atan2(y - avg(y) OVER (PARTITION BY i), x - avg(x) OVER (PARTITION BY i)) AS w FROM corner),
linked AS (SELECT dataset, i, x, y, coalesce(lead(x) OVER o, first_value(x) OVER o) AS x2, coalesce(lead(y) OVER o, first_value(y) OVER o) AS y2 FROM turned WINDOW o AS (PARTITION BY i ORDER BY w, x, y)),
area AS (SELECT dataset, i AS emitter_idx, abs(sum(x * y2 - x2 * y)) / 2 AS area FROM linked GROUP BY 1, 2)"""


@query("delaunay_edges", f"WITH {_TRI} SELECT src, dst FROM de")
def _(spark, sf):
    """Edges of each dataset's triangulation."""
    from ..kernels.delaunay import edges_of, triangulate

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("emitter_idx", kind="stable")
        tri, _, place = triangulate(pdf[["x", "y"]].to_numpy(float))
        ids = np.empty(place.max() + 1, np.int64)
        ids[place[::-1]] = pdf["emitter_idx"].to_numpy()[::-1]
        e = ids[edges_of(tri)] if len(tri) else np.empty((0, 2), np.int64)
        return pd.DataFrame({"src": e.min(1) if len(e) else [], "dst": e.max(1) if len(e) else []}, dtype="int64")

    return written(embeddings_cloud(spark, sf).points.groupBy("dataset").applyInPandas(run, "src long, dst long"), "delaunay")


@query("voronoi_areas", f"WITH {_CELLS} SELECT dataset, emitter_idx, round(area, 9) AS area FROM area")
def _(spark, sf):
    a = labeling.voronoi_cells(embeddings_cloud(spark, sf).points, ["dataset"])
    return a.select(F.col("g").alias("dataset"), "emitter_idx", F.round("area", 9).alias("area"))


@query("voronoi_density", f"WITH {_CELLS} SELECT dataset AS g, round(median(1 / area), 4) AS median_density FROM area GROUP BY 1")
def _(spark, sf):
    _, info = api.cluster_statistics(embeddings_cloud(spark, sf), C.VoronoiDensityConfig())
    return rounded(info.groups, "median_density", digits=4)


@query("voronoi_density_events")
def _(spark, sf):
    """The same over a larger cloud, whose cells are too many for the SQL."""
    _, info = api.cluster_statistics(events_cloud(spark, sf), C.VoronoiDensityConfig())
    return rounded(info.groups, "median_density")


_DENSE = f"""SELECT * FROM (WITH {_CELLS}, dense AS (SELECT dataset, emitter_idx FROM area JOIN (SELECT dataset, sum(area) / count(*) AS m FROM area GROUP BY 1) USING (dataset) WHERE area < m / 1.2)
SELECT dataset, src, dst FROM (SELECT * FROM de UNION ALL SELECT dataset, dst, src FROM de) WHERE src IN (SELECT emitter_idx FROM dense) AND dst IN (SELECT emitter_idx FROM dense) UNION ALL SELECT dataset, emitter_idx, emitter_idx FROM dense)"""
query("voronoi_cluster", f"{labels_sql(EM, _DENSE, 1, 3)} SELECT * FROM out")(labelled(C.VoronoiConfig(density_factor=1.2, min_points=3), embeddings_cloud))
query("voronoi_cluster_events")(labelled(C.VoronoiConfig(density_factor=1.5)))


# ---- linkage -----------------------------------------------------------------

def linkage_sql(height: str, until: str, min_points: int = 5) -> str:
    """Labels of clusters that are merged, nearest pair first, as long as `until` holds of (n pairs, h)."""
    pairs = f"SELECT u.dataset, u.c AS a, v.c AS b, {height} AS h FROM r u JOIN r v ON u.dataset = v.dataset AND u.c < v.c GROUP BY u.dataset, u.c, v.c"
    return f"""
WITH RECURSIVE r(it, dataset, id, x, y, c) AS (SELECT 0, dataset, emitter_idx, x, y, emitter_idx FROM ({EM})
UNION ALL SELECT r.it + 1, r.dataset, r.id, r.x, r.y, CASE WHEN r.c = m.b THEN m.a ELSE r.c END FROM r JOIN (SELECT dataset, arg_min(a, h) AS a, arg_min(b, h) AS b, min(h) AS h, count(*) AS n FROM ({pairs}) GROUP BY dataset) m ON m.dataset = r.dataset WHERE {until}),
last AS (SELECT * FROM r WHERE it = (SELECT max(it) FROM r q WHERE q.dataset = r.dataset)),
kept AS (SELECT dataset, c, row_number() OVER (PARTITION BY dataset ORDER BY c) AS id FROM (SELECT dataset, c FROM last GROUP BY 1, 2 HAVING count(*) >= {min_points}))
SELECT last.dataset, last.id AS emitter_idx, coalesce(kept.id, 0)::INTEGER AS id FROM last LEFT JOIN kept USING (dataset, c)"""


_D = "sqrt((u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y))"
_NU, _NV = "count(DISTINCT u.id)", "count(DISTINCT v.id)"
_WARD = f"sqrt(2.0 * {_NU} * {_NV} / ({_NU} + {_NV})) * sqrt(pow(avg(u.x) - avg(v.x), 2) + pow(avg(u.y) - avg(v.y), 2))"
query("hierarchical_ward", linkage_sql(_WARD, "m.n > 10"))(labelled(C.HierarchicalConfig(n_clusters=5), embeddings_cloud))
query("hierarchical_complete", linkage_sql(f"max({_D})", "m.h <= 0.2"))(labelled(C.HierarchicalConfig(cut_threshold=200, linkage="complete"), embeddings_cloud))
query("hierarchical_average", linkage_sql(f"avg({_D})", "m.h <= 0.15"))(labelled(C.HierarchicalConfig(cut_threshold=150, linkage="average"), embeddings_cloud))


# ---- regimes -----------------------------------------------------------------

_POOLED = EM.replace("(label + 1)::INTEGER", "1::INTEGER")
_LOGS = f"SELECT src AS emitter_idx, ln(10::DOUBLE) - ln(pi()) - 2 * ln(d) AS x FROM ({knn_sql(_POOLED, 10)}) WHERE rank = 10 AND d > 0"
_NORMAL = lambda j: f"(ln(w{j}) - 0.5 * ln(2 * pi() * v{j}) - (x - m{j}) * (x - m{j}) / (2 * v{j}))"
_MIXTURE = f"""WITH RECURSIVE x AS ({_LOGS}), o AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM x),
em(it, m1, m2, v1, v2, w1, w2, t, gone) AS (
SELECT 0, (SELECT x FROM o WHERE k = floor(n / 3.0) + 1), (SELECT x FROM o WHERE k = floor(n * 2 / 3.0) + 1), (SELECT greatest(var_samp(x), 1e-10) FROM x), (SELECT greatest(var_samp(x), 1e-10) FROM x), 0.5::DOUBLE, 0.5::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
UNION ALL SELECT it + 1, s1 / n1, s2 / n2, greatest(q1 / n1 - (s1 / n1) * (s1 / n1), 1e-12), greatest(q2 / n2 - (s2 / n2) * (s2 / n2), 1e-12), n1 / n, n2 / n, now, abs(now - t) FROM (
  SELECT it, t, sum(r1) AS n1, sum(r2) AS n2, sum(r1 * x) AS s1, sum(r2 * x) AS s2, sum(r1 * x * x) AS q1, sum(r2 * x * x) AS q2, sum(l) AS now, count(*) AS n FROM (
    SELECT it, t, x, l, exp(l1 - l) AS r1, exp(l2 - l) AS r2 FROM (SELECT it, t, x, l1, l2, greatest(l1, l2) + ln(exp(l1 - greatest(l1, l2)) + exp(l2 - greatest(l1, l2))) AS l FROM (SELECT it, t, x, {_NORMAL(1)} AS l1, {_NORMAL(2)} AS l2 FROM em, x WHERE it < 100 AND coalesce(gone >= 1e-5, TRUE))))
  GROUP BY it, t)),
fit AS (SELECT * FROM em ORDER BY it DESC LIMIT 1)"""


@query("log_densities", f"SELECT emitter_idx, round(x, 6) AS x FROM ({_LOGS})")
def _(spark, sf):
    return rounded(labeling.log_densities(embeddings_cloud(spark, sf), density_k=10), "x")


@query("calibrate_gaussians", f"{_MIXTURE} SELECT regime::INTEGER AS regime, round(mean, 6) AS mean, round(var, 6) AS var, round(weight, 6) AS weight FROM (SELECT row_number() OVER (ORDER BY mean) AS regime, * FROM (SELECT m1 AS mean, v1 AS var, w1 AS weight FROM fit UNION ALL SELECT m2, v2, w2 FROM fit))")
def _(spark, sf):
    g = labeling.calibrate_regime_gaussians(embeddings_cloud(spark, sf), density_k=10)
    return spark.createDataFrame([(i + 1, *(round(g[c][i], 6) for c in ("means", "vars", "weights"))) for i in range(2)], "regime int, mean double, var double, weight double")


_ROOTS = """b AS (SELECT CASE WHEN m1 <= m2 THEN m1 ELSE m2 END AS a1, CASE WHEN m1 <= m2 THEN v1 ELSE v2 END AS b1, CASE WHEN m1 <= m2 THEN w1 ELSE w2 END AS c1, CASE WHEN m1 <= m2 THEN m2 ELSE m1 END AS a2, CASE WHEN m1 <= m2 THEN v2 ELSE v1 END AS b2, CASE WHEN m1 <= m2 THEN w2 ELSE w1 END AS c2 FROM fit),
k AS (SELECT *, 1 / (2 * b2) - 1 / (2 * b1) AS a, a1 / b1 - a2 / b2 AS b, a2 * a2 / (2 * b2) - a1 * a1 / (2 * b1) + ln(c1 / sqrt(b1)) - ln(c2 / sqrt(b2)) AS c FROM b),
z AS (SELECT *, b * b - 4 * a * c AS disc FROM k), q AS (SELECT *, CASE WHEN disc >= 0 THEN (-b + sqrt(disc)) / (2 * a) END AS r1, CASE WHEN disc >= 0 THEN (-b - sqrt(disc)) / (2 * a) END AS r2 FROM z)"""


@query("calibrate_thresholds", f"{_MIXTURE}, {_ROOTS} SELECT 1::INTEGER AS boundary, round(CASE WHEN r1 BETWEEN a1 AND a2 THEN r1 WHEN r2 BETWEEN a1 AND a2 THEN r2 ELSE (a1 + a2) / 2 END, 6) AS threshold FROM q")
def _(spark, sf):
    t = labeling.calibrate_regime_thresholds(embeddings_cloud(spark, sf), density_k=10)
    return spark.createDataFrame([(i + 1, round(x, 6)) for i, x in enumerate(t)], "boundary int, threshold double")


def regimes_sql(upper: str, min_points: int = 5) -> str:
    """Components of the neighbour graph among points of upper regimes, each point by its own cost alone."""
    near = f"""SELECT * FROM (WITH k AS ({knn_sql(EM, 10)}), f AS (SELECT src, ln(10::DOUBLE) - ln(pi()) - 2 * ln(d) AS x FROM k WHERE rank = 10 AND d > 0), u AS (SELECT src FROM f WHERE {upper}),
g AS (SELECT DISTINCT dataset, least(src, dst) AS a, greatest(src, dst) AS b FROM k WHERE rank <= 8 AND src IN (SELECT src FROM u) AND dst IN (SELECT src FROM u))
SELECT dataset, a AS src, b AS dst FROM g UNION ALL SELECT dataset, b, a FROM g UNION ALL SELECT DISTINCT dataset, src, src FROM k WHERE src IN (SELECT src FROM u))"""
    return f"{labels_sql(EM, near, 1, min_points)} SELECT * FROM out"


_REGIMES = {"means": [4.6, 5.8], "vars": [0.6, 0.3], "weights": [3.0, 2.0]}
_COST = lambda j: f"(0.5 * ln(2 * pi() * {_REGIMES['vars'][j]}) + (x - {_REGIMES['means'][j]}) * (x - {_REGIMES['means'][j]}) / (2 * {_REGIMES['vars'][j]}) - ln({_REGIMES['weights'][j]} / 5.0))"
_MRF = {"density_estimator": "knn", "graph_kind": "knn", "density_k": 10, "graph_k": 8, "smoothness_lambda": 0.0}
query("mrf_by_threshold", regimes_sql("x >= 5.6"))(labelled(C.MRFDensityConfig(regime_thresholds=(5.6,), **_MRF), embeddings_cloud))
query("mrf_by_gaussians", regimes_sql(f"{_COST(1)} < {_COST(0)}"))(labelled(C.MRFDensityConfig(regime_gaussians=_REGIMES, **_MRF), embeddings_cloud))

_GROWN = f"""WITH RECURSIVE s AS (SELECT dataset, emitter_idx, x > 0.12 AS seed FROM ({EM}) WHERE x > 0.0),
e AS (SELECT src, dst FROM ({knn_sql(EM, 4)}) WHERE src IN (SELECT emitter_idx FROM s) AND dst IN (SELECT emitter_idx FROM s)),
r(node, root) AS (SELECT emitter_idx, emitter_idx FROM s UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node WHERE r.root < e.dst),
m AS (SELECT node AS emitter_idx, min(root) AS root FROM r GROUP BY 1),
k AS (SELECT dataset, root, row_number() OVER (PARTITION BY dataset ORDER BY root) AS id FROM (SELECT s.dataset, m.root FROM m JOIN s USING (emitter_idx) GROUP BY 1, 2 HAVING count(*) >= 3 AND bool_or(seed)))
SELECT p.dataset, p.emitter_idx, coalesce(k.id, 0)::INTEGER AS id FROM ({EM}) p LEFT JOIN m USING (emitter_idx) LEFT JOIN k ON k.root = m.root"""
query("hysteresis", _GROWN)(labelled(C.PointHysteresisConfig(graph_k=4, min_points=3, per_dataset=True), embeddings_cloud, seed="x > 0.12", support="x > 0.0"))
query("hysteresis_events")(labelled(C.PointHysteresisConfig(graph_k=6, min_points=20, per_dataset=True), events_cloud, seed="y < 0.1", support="y < 0.5"))


# ---- edges: gates, masks and reports of a given boundary ---------------------

_VALLEY = C.KdeValleyConfig(sigma_nm=200, valley_nbins=40, valley_floorfrac=0.3)
_KDE = f"WITH kde AS (SELECT p.emitter_idx, coalesce(sum(exp(-(d * d) / 0.08)), 0) / (2 * pi() * 0.04) AS rho FROM ({EV}) p LEFT JOIN ({near_sql(EV, 0.6, keys=False)}) e ON e.src = p.emitter_idx GROUP BY 1), v AS (SELECT emitter_idx, rho, log10(rho + 1) AS v FROM kde), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v), c AS (SELECT least(floor((v - lo) / (hi - lo) * 40) + 1, 40)::INTEGER AS bin, count(*) AS n FROM v, m GROUP BY 1), h AS (SELECT bin::INTEGER AS bin, coalesce(n, 0) AS n, lo, hi FROM m, (SELECT unnest(range(1, 41)) AS bin) LEFT JOIN c USING (bin)), s AS (SELECT bin, lo, hi, avg(n) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS hs FROM h), k AS (SELECT min(bin) AS pk, (SELECT max(hs) FROM s) AS top FROM s WHERE hs = (SELECT max(hs) FROM s)), t AS (SELECT min(lo) + (coalesce(max(bin) FILTER (WHERE bin <= pk AND hs < 0.3 * top), 1) - 0.5) * (min(hi) - min(lo)) / 40 AS t FROM s, k)"


@query("valley_gate", f"{_KDE} SELECT emitter_idx, rho >= pow(10, t) - 1 AS dense FROM v, t")
def _(spark, sf):
    return E.valley_gate(events_cloud(spark, sf).points, _VALLEY)


_FOV = (0.0, 30.0, 0.0, 6.0)
_SIDES = dict.fromkeys("LRBT", False)
_BEYOND = [(28.0, 4.0), (33.0, 4.0), (33.0, 5.0), (28.0, 5.0)]
_LOOPS = [SQUARE, HOLE, _BEYOND]
_VERTS = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, r in enumerate(_LOOPS, 1) for x, y in r)
_LOOP_EDGES = ", ".join(f"({i}, {row[1:]}" for i, r in enumerate(_LOOPS, 1) for row in ring_sql(r).split(", (") for row in ["(" + row.lstrip("(")])
_DIAG = f"""WITH p AS ({EV}), v AS (SELECT row_number() OVER () AS k, * FROM (VALUES {_VERTS}) v(loop, x, y)),
n AS (SELECT v.k, v.loop, v.x, v.y, (v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y) AS d2, row_number() OVER (PARTITION BY v.k ORDER BY (v.x - p.x) * (v.x - p.x) + (v.y - p.y) * (v.y - p.y), p.emitter_idx) AS rank FROM v, p),
f AS (SELECT loop, avg((x BETWEEN 0 AND 30 AND y BETWEEN 0 AND 6)::INTEGER) AS frac_in_fov, avg((127 / (pi() * d2) >= 30)::INTEGER) AS frac_dense, median(127 / (pi() * d2)) AS rho, count(*) AS vertex_count FROM n WHERE rank = 128 GROUP BY 1),
e AS (SELECT * FROM (VALUES {_LOOP_EDGES}) e(loop, ax, ay, cx, cy)), a AS (SELECT loop, abs(sum(ax * cy - cx * ay)) / 2 AS area FROM e GROUP BY 1),
i AS (SELECT loop, count(*) AS inside FROM (SELECT loop, emitter_idx FROM p, e GROUP BY 1, 2 HAVING count(*) FILTER (WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / nullif(cy - ay, 0) + ax) % 2 = 1) GROUP BY 1),
g AS (SELECT loop::INTEGER AS loop_id, vertex_count::INTEGER AS vertex_count, area, coalesce(inside, 0) AS inside, frac_in_fov, frac_dense, rho, loop <> 3 AS used, CASE WHEN loop <> 3 THEN 'outer' WHEN frac_in_fov < 1 THEN 'fov_crossing' WHEN frac_dense >= 0.8 THEN 'interior_dense' ELSE 'interior_sparse' END AS kind FROM f JOIN a USING (loop) LEFT JOIN i USING (loop))"""


def _given(spark, sf) -> E.EdgeInfo:
    """A classification with a boundary that is given, not found."""
    ps = events_cloud(spark, sf)
    cells = [{"outer": SQUARE, "holes": [HOLE]}]
    d = E.loop_diagnostics(ps.points, _LOOPS, cells, _FOV, 30.0)
    return E.EdgeInfo(C.OuterPolygonConfig(alpha_nm=800, rho_k_thresh=30.0), written(_mask_labels(spark, sf), "classes"), _FOV, _SIDES, _LOOPS, cells, d)


@query("given_loop_diagnostics", f"{_DIAG} SELECT loop_id, vertex_count, round(area, 4) AS area_um2, inside::BIGINT AS n_emitters_inside, round(frac_in_fov, 4) AS frac_in_fov, round(frac_dense, 4) AS frac_dense, round(rho, 2) AS median_rhok, used AS used_in_outer, kind AS heuristic_type FROM g")
def _(spark, sf):
    digits = {"area_um2": 4, "frac_in_fov": 4, "frac_dense": 4, "median_rhoK": 2}
    rows = [tuple(round(v, digits[k]) if k in digits else v for k, v in d.items()) for d in _given(spark, sf).loop_diagnostics]
    return spark.createDataFrame(rows, "loop_id int, vertex_count int, area_um2 double, n_emitters_inside long, frac_in_fov double, frac_dense double, median_rhok double, used_in_outer boolean, heuristic_type string")


@query("edge_masks", f"{_LABELS} SELECT emitter_idx, class <> 'outside' AS in_cell, class = 'interior' AS interior FROM l")
def _(spark, sf):
    info = E.EdgeInfo(C.OuterPolygonConfig(), _mask_labels(spark, sf), _FOV, _SIDES, [SQUARE], [{"outer": SQUARE, "holes": []}])
    return info.in_cell().join(info.interior_mask(), "emitter_idx")


@query("edge_report", f"{_LABELS} SELECT count(*) AS n, round(avg((class = 'outside')::INTEGER), 6) AS frac_outside, round(avg((class = 'membrane')::INTEGER), 6) AS frac_membrane, round(avg((class = 'interior')::INTEGER), 6) AS frac_interior FROM l")
def _(spark, sf):
    r = E.edge_report(E.EdgeInfo(C.OuterPolygonConfig(), _mask_labels(spark, sf), _FOV, _SIDES, [SQUARE], [{"outer": SQUARE, "holes": []}]))
    return spark.createDataFrame([(r["n"], *(round(r[f"frac_{c}"], 6) for c in E.CODES))], "n long, frac_outside double, frac_membrane double, frac_interior double")


_CONCAVE = f"""{_LABELS}, w AS ({EV}), el AS (SELECT l.emitter_idx, w.x, w.y FROM l JOIN w USING (emitter_idx) JOIN d USING (emitter_idx) WHERE class = 'interior' AND d.d <= 0.5),
le AS (SELECT el.emitter_idx, count(*) + 1 AS m, sum(w.x - el.x) AS sx, sum(w.y - el.y) AS sy FROM el JOIN w ON w.emitter_idx <> el.emitter_idx AND pow(w.x - el.x, 2) + pow(w.y - el.y, 2) <= 1.0 GROUP BY 1),
nn AS (SELECT el.emitter_idx, pow(w.x - el.x, 2) + pow(w.y - el.y, 2) AS d2, row_number() OVER (PARTITION BY el.emitter_idx ORDER BY pow(w.x - el.x, 2) + pow(w.y - el.y, 2), w.emitter_idx) AS rank FROM el JOIN w ON w.emitter_idx <> el.emitter_idx),
su AS (SELECT le.emitter_idx FROM le JOIN nn USING (emitter_idx) WHERE m >= 4 AND sqrt(pow(sx / m, 2) + pow(sy / m, 2)) >= 0.2 AND rank = 128 AND 127 / (pi() * d2) <= 200)"""


@query("given_concavity", f"{_CONCAVE} SELECT (SELECT count(*) FROM l WHERE class = 'interior') AS n_interior, (SELECT count(*) FROM el) AS n_eligible, (SELECT count(*) FROM su) AS n_suspect")
def _(spark, sf):
    info = E.EdgeInfo(C.OuterPolygonConfig(), written(_mask_labels(spark, sf), "classes"), _FOV, _SIDES, [SQUARE], [{"outer": SQUARE, "holes": []}], [{"loop_id": 1, "frac_in_fov": 1.0, "frac_dense": 1.0}])
    r, _ = E.concavity_metric(info, buffer_um=0.5)
    return spark.createDataFrame([tuple(r[c] for c in ("n_interior", "n_eligible", "n_suspect"))], "n_interior long, n_eligible long, n_suspect long")


def _lines(spark, sf, name: str):
    """Lines of an artifact, read from the file that was written."""
    with tempfile.TemporaryDirectory(prefix="stellate-artifacts-") as root:
        artifacts.write_edge_artifacts(os.path.join(root, "c", "n"), _given(spark, sf), "c", "n")
        with open(os.path.join(root, "c", "n", name)) as f:
            rows = [(i, line.rstrip("\n")) for i, line in enumerate(f)]
    return spark.createDataFrame(rows, "line_no int, line string")


def _classified_lines(spark, sf):
    """Lines of classified.tsv as its writer gets them, in no file of the driver's."""
    p = events_cloud(spark, sf).points.select("emitter_idx", "x", "y")
    # points are numbered before they are labelled, so that they are labelled once
    info = E.EdgeInfo(C.OuterPolygonConfig(alpha_nm=800, rho_k_thresh=30.0), _mask_labels(spark, sf, artifacts.numbered(p, "emitter_idx")), _FOV, _SIDES, _LOOPS, [{"outer": SQUARE, "holes": [HOLE]}])
    head = artifacts.classified_head(p.count(), "c", "n")
    rest = artifacts.classified_lines(info).select((F.col("number") + len(head) - 1).cast("int").alias("line_no"), "line")
    return spark.createDataFrame(list(enumerate(head)), "line_no int, line string").unionByName(rest)


def _headed(head: list[str]) -> str:
    return ", ".join(f"({i}, '{h}')" for i, h in enumerate(head))


_T = "chr(9)"
_TSV = _headed(["# schema_version: 2", "# condition: c", "# cell: n"])
query("artifact_classified", f"{_LABELS} SELECT line_no::INTEGER AS line_no, line FROM (SELECT * FROM (VALUES {_TSV}) h(line_no, line) UNION ALL SELECT 3, '# n_emitters: ' || count(*) FROM l UNION ALL SELECT 4, '# coord_units: um' UNION ALL SELECT 5, array_to_string(['emitter_id', 'x_um', 'y_um', 'class', 'inside_outer', 'in_cell', 'dist_to_outer_um'], {_T}) UNION ALL SELECT 5 + row_number() OVER (ORDER BY emitter_idx), array_to_string([row_number() OVER (ORDER BY emitter_idx)::VARCHAR, round(x, 6)::VARCHAR, round(y, 6)::VARCHAR, class, (class <> 'outside')::INTEGER::VARCHAR, (class <> 'outside')::INTEGER::VARCHAR, CASE WHEN class = 'outside' THEN 'NaN' ELSE dist::VARCHAR END], {_T}) FROM l JOIN ({EV}) USING (emitter_idx))")(_classified_lines)
_RINGS = [f"{i}\t{j}\t{x}\t{y}" for i, r in enumerate(_LOOPS, 1) for j, (x, y) in enumerate(r, 1)]
query("artifact_loops", f"SELECT line_no::INTEGER AS line_no, line FROM (VALUES {_headed(['# schema_version: 2', '# alpha_nm: 800', '# loop_count: 3', chr(9).join(['loop_id', 'vertex_id', 'x_um', 'y_um']), *_RINGS])}) h(line_no, line)")(lambda spark, sf: _lines(spark, sf, "polygon_loops.tsv"))
query("artifact_diagnostics", f"{_DIAG} SELECT line_no::INTEGER AS line_no, line FROM (SELECT * FROM (VALUES {_headed(['# schema_version: 2', 'loop_id,vertex_count,area_um2,n_emitters_inside,frac_in_fov,frac_dense,median_rhoK,used_in_outer,heuristic_type'])}) h(line_no, line) UNION ALL SELECT loop_id + 1, array_to_string([loop_id::VARCHAR, vertex_count::VARCHAR, round(area, 4)::DOUBLE::VARCHAR, inside::VARCHAR, round(frac_in_fov, 4)::VARCHAR, round(frac_dense, 4)::VARCHAR, round(rho, 2)::VARCHAR, used::VARCHAR, kind], ',') FROM g)")(lambda spark, sf: _lines(spark, sf, "loop_diagnostics.csv"))


@query("artifact_json", f"SELECT * FROM (VALUES ('params', 'schema_version', '3'), ('params', 'fov_um', '[0.0, 30.0, 0.0, 6.0]'), ('params', 'ALPHA_NM', '800'), ('params', 'METHOD', '\"outer_polygon\"'), ('params', 'K_LIST', '[16, 128]'), ('params', 'truncated_sides', '{{\"B\": false, \"L\": false, \"R\": false, \"T\": false}}'), ('manifest', 'schema_version', '1'), ('manifest', 'condition', '\"c\"'), ('manifest', 'cell', '\"n\"')) v(file, key, value) UNION ALL SELECT 'params', 'n_emitters', count(*)::VARCHAR FROM ({EV})")
def _(spark, sf):
    import json

    with tempfile.TemporaryDirectory(prefix="stellate-artifacts-") as root:
        artifacts.write_edge_artifacts(os.path.join(root, "c", "n"), _given(spark, sf), "c", "n")
        got = {}
        for f in ("params", "manifest"):
            with open(os.path.join(root, "c", "n", f"{f}.json")) as h:
                got[f] = json.load(h)
    params = got["params"] | got["params"]["params"]
    rows = [("params", k, params[k]) for k in ("schema_version", "fov_um", "ALPHA_NM", "METHOD", "K_LIST", "truncated_sides", "n_emitters")] + [("manifest", k, got["manifest"][k]) for k in ("schema_version", "condition", "cell")]
    return spark.createDataFrame([(f, k, json.dumps(v, sort_keys=True)) for f, k, v in rows], "file string, key string, value string")


assert math.isclose(sum(_REGIMES["weights"]), 5.0)  # the SQL divides by it
