"""The engine's queries over the driver's tables and the SQL to hold them against.

Doubles are rounded on both sides. Queries without SQL are iterative or geometric kernels;
tests hold them against brute force or invariants.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api
from .. import configs as C
from ..backends import edges as E
from ..backends import labeling, statistics
from ..functions import geometry as G
from ..kernels import rings as R
from ..operators import labels as L
from ..operators.knn import knn_join, kth_distance, symmetric_graph
from ..operators.range_join import NeighborGraph, range_join
from ..operators.shared import written
from ..operators.tiles import spread
from ..points import CLOUD_SQL, PointSet, embeddings_cloud, events_cloud, orders_cloud

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
EV, EM, OR = (CLOUD_SQL[c] for c in ("events", "embeddings", "orders"))
SQUARE = [(5.0, 0.5), (25.0, 0.5), (25.0, 3.0), (5.0, 3.0)]
NOTCHED = [(2.0, 0.1), (28.0, 0.1), (28.0, 2.0), (15.0, 1.0), (2.0, 2.0)]
HOLE = [(10.0, 0.8), (12.0, 0.8), (12.0, 0.9), (10.0, 0.9)]
MASK = [{"outer": SQUARE, "holes": [HOLE]}]
GAUSSIANS = {"means": [3.0, 5.0], "vars": [0.5, 0.8], "weights": [0.6, 0.4]}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def near_sql(cloud: str, r: float, strict: bool = False, keys: bool = True, dims: int = 2) -> str:
    """Pairs (dataset, src, dst, d) of points within r."""
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in "xyz"[:dims])
    same = "a.dataset = b.dataset AND " if keys else ""
    return f"SELECT a.dataset, a.emitter_idx AS src, b.emitter_idx AS dst, sqrt({d2}) AS d FROM ({cloud}) a JOIN ({cloud}) b ON {same}a.emitter_idx <> b.emitter_idx AND abs(a.x - b.x) <= {r} AND {d2} {'<' if strict else '<='} {r}::DOUBLE * {r}::DOUBLE"


def knn_sql(cloud: str, k: int, dims: int = 2) -> str:
    d2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in "xyz"[:dims])
    return f"SELECT * FROM (SELECT a.dataset, a.emitter_idx AS src, b.emitter_idx AS dst, sqrt({d2}) AS d, row_number() OVER (PARTITION BY a.emitter_idx ORDER BY {d2}, b.emitter_idx)::INTEGER AS rank FROM ({cloud}) a JOIN ({cloud}) b ON a.dataset = b.dataset AND a.emitter_idx <> b.emitter_idx) WHERE rank <= {k}"


def labels_sql(cloud: str, near: str, min_neighbors: int, min_points: int, keys: bool = True) -> str:
    """CTEs p, e, ..., out(dataset, emitter_idx, id): density labels, compacted."""
    part = "PARTITION BY dataset" if keys else ""
    same = "USING (dataset, label)" if keys else "USING (label)"
    by = "dataset, label" if keys else "label"
    return f"""
WITH RECURSIVE p AS ({cloud}), e AS ({near}),
core AS (SELECT src AS emitter_idx FROM e GROUP BY src HAVING count(*) >= {min_neighbors}),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT emitter_idx FROM core) AND dst IN (SELECT emitter_idx FROM core)),
r(node, root) AS (SELECT emitter_idx, emitter_idx FROM core UNION SELECT ce.dst, r.root FROM r JOIN ce ON ce.src = r.node WHERE r.root < ce.dst),
roots AS (SELECT node, min(root) AS root FROM r GROUP BY node),
heads AS (SELECT p.dataset, root, row_number() OVER ({part} ORDER BY root) AS label FROM (SELECT DISTINCT root FROM roots) JOIN p ON p.emitter_idx = root),
core_label AS (SELECT node AS emitter_idx, label FROM roots JOIN heads USING (root)),
border AS (SELECT src AS emitter_idx, min(label) AS label FROM e JOIN core_label ON core_label.emitter_idx = dst GROUP BY src),
raw AS (SELECT p.dataset, p.emitter_idx, coalesce(c.label, b.label, 0) AS label FROM p LEFT JOIN core_label c USING (emitter_idx) LEFT JOIN border b USING (emitter_idx)),
kept AS (SELECT {by}, row_number() OVER ({part} ORDER BY label) AS id FROM (SELECT {by} FROM raw WHERE label > 0 GROUP BY {by} HAVING count(*) >= {min_points})),
out AS (SELECT raw.dataset, raw.emitter_idx, coalesce(kept.id, 0)::INTEGER AS id FROM raw LEFT JOIN kept {same})
"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def labelled(config: C.ClusterConfig, cloud=events_cloud, **masks):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ps, _ = api.cluster(cloud(spark, sf_dir), config, **masks)
        return ps.points.select("dataset", "emitter_idx", "id")

    return run


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of each event type and their sizes."""
    ps, _ = api.cluster(events_cloud(spark, sf_dir), C.DBSCANConfig(eps_nm=300))
    return L.cluster_sizes(ps.points, ["dataset"])


# ---- scans, projections, predicates ------------------------------------------

@query("scan_events_cloud", f"SELECT dataset, emitter_idx, round(x, 6) AS x, round(y, 6) AS y FROM ({EV})")
def _(spark, sf):
    return rounded(events_cloud(spark, sf).points.select("dataset", "emitter_idx", "x", "y"), "x", "y")


@query("scan_orders_cloud", f"SELECT dataset, emitter_idx, round(x, 9) AS x, round(y, 9) AS y FROM ({OR})")
def _(spark, sf):
    return rounded(orders_cloud(spark, sf).points.select("dataset", "emitter_idx", "x", "y"), "x", "y", digits=9)


@query("scan_embeddings_cloud_3d", f"SELECT dataset, emitter_idx, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM ({EM})")
def _(spark, sf):
    return rounded(embeddings_cloud(spark, sf).points.select("dataset", "emitter_idx", "x", "y", "z"), "x", "y", "z")


@query("sigma_eff", f"SELECT emitter_idx, round(sqrt(sigma * sigma), 9) AS s2, round(cbrt(sigma * sigma * sigma), 9) AS s3 FROM ({EM})")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points.withColumn("sigma_z", F.col("sigma_x"))
    return rounded(p.select("emitter_idx", G.sigma_eff().alias("s2"), G.sigma_eff(True).alias("s3")), "s2", "s3", digits=9)


@query("bbox_by_dataset", f"SELECT dataset, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, count(*) AS n FROM ({EV}) GROUP BY dataset")
def _(spark, sf):
    b = events_cloud(spark, sf).points.groupBy("dataset").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    return rounded(b, "x0", "x1", "y0", "y1")


@query("truncated_sides", f"SELECT min(x) - 0.0 <= 0.15 AS l, 30.0 - max(x) <= 0.15 AS r, min(y) - 0.0 <= 0.15 AS b, 6.0 - max(y) <= 0.15 AS t FROM ({EV})")
def _(spark, sf):
    s = E.truncated_sides(events_cloud(spark, sf).points, (0.0, 30.0, 0.0, 6.0), 0.15)
    return spark.createDataFrame([tuple(s[c] for c in "LRBT")], "l boolean, r boolean, b boolean, t boolean")


@query("duplicate_guard", f"SELECT dataset, round(x, 1) AS x, round(y, 1) AS y, count(*) AS n FROM ({EV}) GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    p = rounded(events_cloud(spark, sf).points, "x", "y", digits=1)
    return p.groupBy("dataset", "x", "y").agg(F.count("*").alias("n")).filter("n > 1")


@query("distinct_points", f"SELECT count(*) AS n FROM (SELECT DISTINCT round(x, 1), round(y, 1) FROM ({EV}))")
def _(spark, sf):
    return rounded(events_cloud(spark, sf).points, "x", "y", digits=1).select("x", "y").distinct().agg(F.count("*").alias("n"))


@query("threshold_regimes", f"SELECT emitter_idx, (1 + CASE WHEN y >= 0.3 THEN 1 ELSE 0 END + CASE WHEN y >= 1.0 THEN 1 ELSE 0 END)::INTEGER AS regime, CASE WHEN y < 0.3 THEN 0.0 ELSE 1e6 END AS cost1 FROM ({EV})")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    return p.select("emitter_idx", G.regime_of(F.col("y"), [0.3, 1.0]).cast("int").alias("regime"), G.threshold_costs(F.col("y"), [0.3, 1.0])[0].alias("cost1"))


@query("regime_costs", "SELECT emitter_idx, " + ", ".join(f"round({0.5 * math.log(2 * math.pi * v) - math.log(w)!r}::DOUBLE + (x - {m}) * (x - {m}) / {2 * v}, 6) AS u{i}" for i, (m, v, w) in enumerate(zip(GAUSSIANS['means'], GAUSSIANS['vars'], GAUSSIANS['weights'], strict=True))) + f" FROM ({EV})")
def _(spark, sf):
    p = events_cloud(spark, sf).points.select("emitter_idx", G.regime_costs(F.col("x"), GAUSSIANS).alias("u"))
    return rounded(p.select("emitter_idx", F.col("u")[0].alias("u0"), F.col("u")[1].alias("u1")), "u0", "u1")


@query("circumradius", f"SELECT dataset, emitter_idx, round(CASE WHEN abs(2 * ((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))) < 1e-30 THEN NULL ELSE sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) * sqrt(pow(x2 - x0, 2) + pow(y2 - y0, 2)) * sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / (2 * abs((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0))) END, 4) AS r FROM (SELECT dataset, emitter_idx, x AS x0, y AS y0, lead(x, 1) OVER w AS x1, lead(y, 1) OVER w AS y1, lead(x, 2) OVER w AS x2, lead(y, 2) OVER w AS y2 FROM ({EM}) WINDOW w AS (PARTITION BY dataset ORDER BY emitter_idx)) WHERE x2 IS NOT NULL")
def _(spark, sf):
    w = Window.partitionBy("dataset").orderBy("emitter_idx")
    t = embeddings_cloud(spark, sf).points.select("dataset", "emitter_idx", *[F.lead(c, i).over(w).alias(f"{c}{i}") for i in range(3) for c in "xy"])
    r = G.circumradius(*[F.col(f"{c}{i}") for i in range(3) for c in "xy"])
    return t.filter("x2 is not null").select("dataset", "emitter_idx", F.round(r, 4).alias("r"))


# ---- joins -------------------------------------------------------------------

@query("range_join", f"SELECT dataset, src, dst, round(d, 6) AS d FROM ({near_sql(EV, 0.1)})")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    return rounded(range_join(p, p, 0.1, ["x", "y"], ["dataset"]), "d")


@query("range_join_3d", f"SELECT dataset, src, dst, round(d, 6) AS d FROM ({near_sql(EM, 0.15, dims=3)})")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points
    return rounded(range_join(p, p, 0.15, ["x", "y", "z"], ["dataset"]), "d")


@query("hetero_range_join", f"SELECT e.dataset, src, dst, round(d, 6) AS d FROM ({near_sql(EV, 0.15)}) e JOIN ({EV}) a ON a.emitter_idx = src JOIN ({EV}) b ON b.emitter_idx = dst WHERE d < 1.5::DOUBLE * (a.sigma + b.sigma)")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    g = NeighborGraph(p, 0.15, ["x", "y"], ["dataset"])
    return rounded(g.active(p.select("emitter_idx", G.sigma_eff().alias("sigma")), 1.5), "d")


@query("knn_join", f"SELECT dataset, src, dst, round(d, 6) AS d, rank FROM ({knn_sql(EV, 5)})")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    return rounded(knn_join(p, p, 5, ["x", "y"], ["dataset"]), "d")


@query("knn_join_3d", f"SELECT dataset, src, dst, round(d, 6) AS d, rank FROM ({knn_sql(EM, 4, 3)})")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points
    return rounded(knn_join(p, p, 4, ["x", "y", "z"], ["dataset"]), "d")


@query("knn_graph_symmetric", f"SELECT DISTINCT dataset, least(src, dst) AS src, greatest(src, dst) AS dst FROM ({knn_sql(EM, 8)})")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points
    return symmetric_graph(knn_join(p, p, 8, ["x", "y"], ["dataset"]), ["dataset"])


@query("knn_density", f"SELECT src AS emitter_idx, round(10 / (pi() * d * d), 3) AS disk, round(9 / (pi() * d * d), 3) AS unbiased, round(ln(10 / (pi() * d * d)), 6) AS log_density FROM ({knn_sql(EM, 10)}) WHERE rank = 10")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points
    r = kth_distance(knn_join(p, p, 10, ["x", "y"], ["dataset"]), 10)
    return r.select("emitter_idx", F.round(G.disk_density(10, F.col("r")), 3).alias("disk"), F.round(G.unbiased_density(10, F.col("r")), 3).alias("unbiased"), F.round(F.ln(G.disk_density(10, F.col("r"))), 6).alias("log_density"))


@query("pairwise_distance", f"SELECT a.dataset, a.emitter_idx AS src, b.emitter_idx AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS d FROM ({EM}) a JOIN ({EM}) b ON a.dataset = b.dataset AND a.emitter_idx < b.emitter_idx")
def _(spark, sf):
    p = embeddings_cloud(spark, sf).points.select("dataset", "emitter_idx", "x", "y")
    q = p.select("dataset", F.col("emitter_idx").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    j = p.join(q, "dataset").filter("emitter_idx < dst")
    return j.select("dataset", F.col("emitter_idx").alias("src"), "dst", F.round(F.sqrt((F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))), 6).alias("d"))


# ---- gates, histograms, statistics -------------------------------------------

@query("relative_core_gate", f"WITH n AS (SELECT p.emitter_idx, count(e.src) AS n FROM ({EV}) p LEFT JOIN ({near_sql(EV, 0.1, keys=False)}) e ON e.src = p.emitter_idx GROUP BY 1) SELECT emitter_idx FROM n WHERE n >= 0.8 * (SELECT median(n) FROM n)")
def _(spark, sf):
    return E.core_gate(events_cloud(spark, sf).points, 0.1, 0.8).select("emitter_idx")


@query("multi_k_gate", f"WITH k AS (SELECT src, min((rank - 1) / (pi() * d * d)) AS rho FROM ({knn_sql(EM.replace('(label + 1)::INTEGER', '1'), 16)}) WHERE rank IN (4, 16) GROUP BY src) SELECT src AS emitter_idx FROM k WHERE rho >= 12")
def _(spark, sf):
    return E.multi_k_gate(embeddings_cloud(spark, sf).points, (4, 16), 12.0)


@query("kde_density", f"SELECT p.emitter_idx, round(coalesce(sum(exp(-(d * d) / 0.02)), 0) / (2 * pi() * 0.01), 4) AS rho FROM ({EV}) p LEFT JOIN ({near_sql(EV, 0.3, keys=False)}) e ON e.src = p.emitter_idx GROUP BY 1")
def _(spark, sf):
    return rounded(E.kde_density(events_cloud(spark, sf).points, 0.1), "rho", digits=4)


_HIST = f"WITH v AS (SELECT log10(y + 1) AS v FROM ({EV})), m AS (SELECT min(v) AS lo, max(v) AS hi FROM v), c AS (SELECT least(floor((v - lo) / (hi - lo) * 40) + 1, 40)::INTEGER AS bin, count(*) AS n FROM v, m GROUP BY 1), h AS (SELECT bin::INTEGER AS bin, coalesce(n, 0) AS n, lo, hi FROM m, (SELECT unnest(range(1, 41)) AS bin) LEFT JOIN c USING (bin))"


def _log_y(spark, sf):
    return events_cloud(spark, sf).points.select(F.log10(F.col("y") + 1).alias("v"))


@query("log_density_histogram", f"{_HIST} SELECT bin, n, round(lo, 6) AS lo, round(hi, 6) AS hi FROM h")
def _(spark, sf):
    return rounded(E.histogram(_log_y(spark, sf), "v", 40), "lo", "hi")


@query("left_base_threshold", f"{_HIST}, s AS (SELECT bin, lo, hi, avg(n) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS hs FROM h), k AS (SELECT min(bin) AS pk, (SELECT max(hs) FROM s) AS top FROM s WHERE hs = (SELECT max(hs) FROM s)) SELECT round(min(lo) + (coalesce(max(bin) FILTER (WHERE bin <= pk AND hs < 0.5 * top), 1) - 0.5) * (min(hi) - min(lo)) / 40, 6) AS threshold FROM s, k")
def _(spark, sf):
    return rounded(E.left_base(_log_y(spark, sf), "v", 40, 0.5, 4), "threshold")


@query("mad_lambda", f"WITH m AS (SELECT dataset, median(y) AS med FROM ({EV}) GROUP BY dataset) SELECT dataset, round(greatest(1e-6, median(abs(y - med))), 6) AS mad FROM ({EV}) JOIN m USING (dataset) GROUP BY dataset")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    m = p.groupBy("dataset").agg(F.median("y").alias("med"))
    return p.join(m, "dataset").groupBy("dataset").agg(F.round(F.greatest(F.lit(1e-6), F.median(F.abs(F.col("y") - F.col("med")))), 6).alias("mad"))


_CONTRAST = f"WITH k AS ({knn_sql(EM, 20)}), f AS (SELECT src, ln(5 / pi()) - 2 * ln(d) AS f FROM k WHERE rank = 5), b AS (SELECT k.src, median(f.f) AS base FROM k JOIN f ON f.src = k.dst GROUP BY 1), c AS (SELECT k.dataset, f.src AS emitter_idx, f.f - base AS contrast FROM f JOIN b USING (src) JOIN k ON k.src = f.src AND k.rank = 1)"


@query("local_contrast", f"{_CONTRAST} SELECT emitter_idx, round(contrast, 6) AS contrast FROM c")
def _(spark, sf):
    c = statistics.local_contrast(embeddings_cloud(spark, sf).points, ["dataset"], 5, 20, ["x", "y"])
    return rounded(c.filter("contrast is not null").select("emitter_idx", "contrast"), "contrast")


@query("median_local_contrast", f"{_CONTRAST} SELECT dataset AS g, round(median(contrast), 6) AS median_local_contrast FROM c GROUP BY 1")
def _(spark, sf):
    _, info = api.cluster_statistics(embeddings_cloud(spark, sf), C.LocalContrastFeature(density_k=5, background_k=20, per_dataset=True))
    return rounded(info.groups, "median_local_contrast")


def hopkins_sql(region: str | None, bbox: str | None) -> str:
    """Hash draws as in the statistics backend; region is a predicate on x, y."""
    u = lambda what, *more: "(('0x' || substr(md5(concat_ws('/', '7', '" + what + "', g, rep" + "".join(f", {m}" for m in more) + ")), 1, 8))::UBIGINT / 4294967296.0)"
    box = bbox or "min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy"
    draw = f"SELECT g, rep, draw, 0 AS t, lx + {u('x', 'draw')} * (hx - lx) AS x, ly + {u('y', 'draw')} * (hy - ly) AS y FROM d"
    if region:
        draw = f"SELECT g, rep, draw, min(t) AS t, min_by(x, t) AS x, min_by(y, t) AS y FROM (SELECT g, rep, draw, t, lx + {u('x', 'draw', 't')} * (hx - lx) AS x, ly + {u('y', 'draw', 't')} * (hy - ly) AS y FROM d, (SELECT unnest(range(1, 1001)) AS t)) WHERE {region} GROUP BY g, rep, draw"
    return f"""
WITH p AS (SELECT dataset AS g, emitter_idx, x, y FROM ({EV})), b AS (SELECT g, count(*) AS n, {box} FROM p GROUP BY g),
d AS (SELECT b.*, rep, draw FROM b, (SELECT unnest(range(1, 3)) AS rep), (SELECT unnest(range(1, 21)) AS draw)), r AS ({draw}),
u AS (SELECT g, rep, sum(m) AS u FROM (SELECT r.g, rep, draw, min((r.x - p.x) * (r.x - p.x) + (r.y - p.y) * (r.y - p.y)) AS m FROM r JOIN p ON p.g = r.g GROUP BY 1, 2, 3) GROUP BY 1, 2),
k AS (SELECT * FROM (SELECT g, rep, emitter_idx, x, y, row_number() OVER (PARTITION BY g, rep ORDER BY {u('pick', 'emitter_idx')}, emitter_idx) AS rn FROM p, (SELECT unnest(range(1, 3)) AS rep)) WHERE rn <= 20),
w AS (SELECT g, rep, sum(m) AS w FROM (SELECT k.g, rep, k.emitter_idx, min((k.x - p.x) * (k.x - p.x) + (k.y - p.y) * (k.y - p.y)) AS m FROM k JOIN p ON p.g = k.g AND p.emitter_idx <> k.emitter_idx GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT g, round(avg(u / (u + w)), 6) AS hopkins FROM u JOIN w USING (g, rep) GROUP BY g"""


def _hopkins(region):
    def run(spark, sf):
        _, info = api.cluster_statistics(events_cloud(spark, sf), C.HopkinsConfig(n_samples=20, random_repeats=2, seed=7, region=region))
        return rounded(info.groups, "hopkins")

    return run


_IN = "x >= 5.0 AND x < 25.0 AND y >= 0.5 AND y < 3.0"
_SQUARE_BOX = "5.0::DOUBLE AS lx, 25.0::DOUBLE AS hx, 0.5::DOUBLE AS ly, 3.0::DOUBLE AS hy"
query("hopkins", hopkins_sql(None, None))(_hopkins(None))
query("hopkins_polygon", hopkins_sql(_IN, _SQUARE_BOX))(_hopkins(SQUARE))
query("hopkins_region_dict", hopkins_sql(_IN, _SQUARE_BOX))(_hopkins({g: SQUARE for g in range(1, 6)}))


# ---- polygons ----------------------------------------------------------------

def ring_sql(ring) -> str:
    return ", ".join(f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)" for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True))


def inside_sql(ring, name: str) -> str:
    return f"{name} AS (SELECT emitter_idx, count(*) FILTER (WHERE (ay > y) <> (cy > y) AND x < (cx - ax) * (y - ay) / nullif(cy - ay, 0) + ax) % 2 = 1 AS held FROM p, (VALUES {ring_sql(ring)}) v(ax, ay, cx, cy) GROUP BY emitter_idx)"


@query("point_in_polygon", f"WITH p AS ({EV}), {inside_sql(NOTCHED, 'h')} SELECT emitter_idx FROM h WHERE held")
def _(spark, sf):
    return events_cloud(spark, sf).points.filter(G.in_ring(F.col("x"), F.col("y"), NOTCHED)).select("emitter_idx")


@query("in_region", f"WITH p AS ({EV}), {inside_sql(SQUARE, 'o')}, {inside_sql(HOLE, 'i')} SELECT o.emitter_idx FROM o JOIN i USING (emitter_idx) WHERE o.held AND NOT i.held")
def _(spark, sf):
    return events_cloud(spark, sf).points.filter(G.in_mask(F.col("x"), F.col("y"), MASK)).select("emitter_idx")


@query("ring_area", f"SELECT name, round(abs(sum(ax * cy - cx * ay)) / 2, 6) AS area FROM (SELECT 'square' AS name, * FROM (VALUES {ring_sql(SQUARE)}) v(ax, ay, cx, cy) UNION ALL SELECT 'notched', * FROM (VALUES {ring_sql(NOTCHED)}) v(ax, ay, cx, cy)) GROUP BY name")
def _(spark, sf):
    rows = [(n, i, x, y) for n, r in (("square", SQUARE), ("notched", NOTCHED)) for i, (x, y) in enumerate(r)]
    v = spark.createDataFrame(rows, "name string, i int, x double, y double")
    w, whole = Window.partitionBy("name").orderBy("i"), Window.partitionBy("name").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return v.select("name", (F.col("x") * nxt("y") - nxt("x") * F.col("y")).alias("t")).groupBy("name").agg(F.round(F.abs(F.sum("t")) / 2, 6).alias("area"))


@query("region_area", "SELECT round(50.0 - 0.2, 6)::DOUBLE AS area")
def _(spark, sf):
    return spark.createDataFrame([(round(R.region_area(MASK), 6),)], "area double")


_LABELS = f"""WITH p AS ({EV}), {inside_sql(SQUARE, 'o')}, s AS (SELECT * FROM (VALUES {ring_sql(SQUARE)}) v(ax, ay, cx, cy)),
t AS (SELECT emitter_idx, x, y, ax, ay, cx, cy, greatest(0.0, least(1.0, ((x - ax) * (cx - ax) + (y - ay) * (cy - ay)) / ((cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)))) AS f FROM p, s),
d AS (SELECT emitter_idx, min(sqrt(pow(x - (ax + f * (cx - ax)), 2) + pow(y - (ay + f * (cy - ay)), 2))) AS d FROM t GROUP BY 1),
l AS (SELECT emitter_idx, CASE WHEN NOT held THEN 'outside' WHEN d < 0.1 THEN 'membrane' ELSE 'interior' END AS class, CASE WHEN held THEN round(d, 6) END AS dist FROM o JOIN d USING (emitter_idx))"""


def _mask_labels(spark, sf, p=None):
    p = events_cloud(spark, sf).points if p is None else p
    return E.labelled(p, [{"outer": SQUARE, "holes": []}], 0.1, (0.0, 30.0, 0.0, 6.0), 0.15, dict.fromkeys("LRBT", False))


@query("mask_labels", f"{_LABELS} SELECT * FROM l")
def _(spark, sf):
    return _mask_labels(spark, sf).select("emitter_idx", "class", F.when(~F.isnan("dist_to_outer_um"), F.round("dist_to_outer_um", 6)).alias("dist"))


@query("class_fractions", f"{_LABELS} SELECT class, CASE class WHEN 'outside' THEN 0 WHEN 'membrane' THEN 1 ELSE 2 END::INTEGER AS class_code, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS frac FROM l GROUP BY class")
def _(spark, sf):
    c = E.class_codes(_mask_labels(spark, sf)).groupBy("class", "class_code").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("class", "class_code", "n", F.round(F.col("n") / F.col("total"), 6).alias("frac"))


@query("ring_distance", f"{_LABELS} SELECT emitter_idx, round(d, 6) AS d FROM d")
def _(spark, sf):
    return events_cloud(spark, sf).points.select("emitter_idx", F.round(G.ring_distance(F.col("x"), F.col("y"), [SQUARE]), 6).alias("d"))


@query("boundary_edges", "WITH t AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem WHERE l_orderkey <> l_partkey) SELECT least(a, b)::BIGINT AS a, greatest(a, b)::BIGINT AS b FROM t GROUP BY ALL HAVING count(*) = 1")
def _(spark, sf):
    t = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("p"), F.col("l_partkey").cast("long").alias("q")).filter("p <> q")
    return t.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).count().filter("count = 1").select("a", "b")


# ---- labelling ---------------------------------------------------------------

_DB = labels_sql(EV, near_sql(EV, 0.1), 4, 5)
query("dbscan", f"{_DB} SELECT * FROM out")(labelled(C.DBSCANConfig(eps_nm=100)))
query("dbscan_pooled", f"{labels_sql(EV, near_sql(EV, 0.04, keys=False), 4, 5, False)} SELECT * FROM out")(labelled(C.DBSCANConfig(eps_nm=40, per_dataset=False)))
query("dbscan_remove_unclustered", f"{_DB} SELECT * FROM out WHERE id <> 0")(labelled(C.DBSCANConfig(eps_nm=100, remove_unclustered=True)))
query("dbscan_3d", f"{labels_sql(EM, near_sql(EM, 0.15, dims=3), 2, 3)} SELECT * FROM out")(labelled(C.DBSCANConfig(eps_nm=150, min_points=3, use_3d=True), embeddings_cloud))
_PREC = f"SELECT e.dataset, src, dst FROM ({near_sql(EV, 0.2)}) e JOIN ({EV}) a ON a.emitter_idx = src JOIN ({EV}) b ON b.emitter_idx = dst WHERE d < 1.5::DOUBLE * (a.sigma + b.sigma)"
query("precision_dbscan", f"{labels_sql(EV, _PREC, 4, 5)} SELECT * FROM out")(labelled(C.PrecisionDBSCANConfig(nsigma=1.5)))
query("single_linkage_cut", f"{labels_sql(EM, 'SELECT * FROM (' + near_sql(EM, 0.06) + ') UNION ALL SELECT dataset, emitter_idx, emitter_idx, 0 FROM (' + EM + ')', 1, 3)} SELECT * FROM out")(labelled(C.HierarchicalConfig(cut_threshold=60, linkage="single", min_points=3), embeddings_cloud))


@query("cluster_sizes", f"{_DB} SELECT dataset, id, count(*) AS n FROM out WHERE id <> 0 GROUP BY ALL")
def _(spark, sf):
    ps, _ = api.cluster(events_cloud(spark, sf), C.DBSCANConfig(eps_nm=100))
    return ps.metadata["cluster_counts"].filter("id <> 0")


@query("cluster_info", f"{_DB} SELECT count(*) AS n_locs_in, count(*) FILTER (WHERE id <> 0) AS n_clustered, count(*) FILTER (WHERE id = 0) AS n_noise, count(DISTINCT (dataset, id)) FILTER (WHERE id <> 0) AS n_clusters FROM out")
def _(spark, sf):
    _, info = api.cluster(events_cloud(spark, sf), C.DBSCANConfig(eps_nm=100))
    return info.summary.select("n_locs_in", "n_clustered", "n_noise", "n_clusters")


@query("neighbor_count", f"SELECT src AS emitter_idx, count(*) AS n FROM ({near_sql(EV, 0.1)}) GROUP BY 1")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    return L.neighbor_counts(range_join(p, p, 0.1, ["x", "y"], ["dataset"]))


@query("connected_components", f"WITH RECURSIVE e AS ({near_sql(EV, 0.06)}), r(node, root) AS (SELECT DISTINCT src, src FROM e UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node WHERE r.root < e.dst) SELECT node, min(root) AS root FROM r GROUP BY node HAVING min(root) < node")
def _(spark, sf):
    p = events_cloud(spark, sf).points.select("dataset", "emitter_idx", "x", "y")
    r = L.range_roots(p, 0.06, ["x", "y"], ["dataset"], 0)
    return spread(p, r, [], ["x", "y"], "root").filter("root < emitter_idx").select(F.col("emitter_idx").alias("node"), "root")


@query("precision_labels_no_noise", f"WITH RECURSIVE p AS ({EV}), e AS ({_PREC}), r(node, root) AS (SELECT emitter_idx, emitter_idx FROM p UNION SELECT e.dst, r.root FROM r JOIN e ON e.src = r.node WHERE r.root < e.dst), m AS (SELECT node AS emitter_idx, min(root) AS root FROM r GROUP BY 1) SELECT dataset, emitter_idx, dense_rank() OVER (PARTITION BY dataset ORDER BY root)::INTEGER AS label FROM m JOIN p USING (emitter_idx)")
def _(spark, sf):
    p = events_cloud(spark, sf).points
    return labeling.precision_labels(NeighborGraph(p, 0.15, ["x", "y"], ["dataset"]), p.select("emitter_idx", G.sigma_eff().alias("sigma")), 1.5, min_points=0)


for _name, _config in {
    "hdbscan": C.HDBSCANConfig(knn_graph_k=10),
    "hdbscan_leaf": C.HDBSCANConfig(knn_graph_k=10, cluster_selection_method="leaf"),
    "hdbscan_3d": C.HDBSCANConfig(knn_graph_k=10, use_3d=True),
}.items():
    query(_name)(labelled(_config, embeddings_cloud))
query("mrf_density")(labelled(C.MRFDensityConfig()))
query("mrf_density_knn")(labelled(C.MRFDensityConfig(density_estimator="knn", graph_kind="knn", density_k=10)))


# ---- edges -------------------------------------------------------------------

EDGE = {
    "edge_outer_polygon": C.OuterPolygonConfig(alpha_nm=800, k_list=(8, 32), rho_k_thresh=5.0, core_radius_nm=800),
    "edge_kde_valley": C.KdeValleyConfig(alpha_nm=800, sigma_nm=200, core_radius_nm=800),
}


def _classified(spark, sf, name: str) -> tuple[PointSet, E.EdgeInfo]:
    return api.classify_emitters(events_cloud(spark, sf), EDGE[name])


for _name in EDGE:
    query(_name)(lambda spark, sf, name=_name: _classified(spark, sf, name)[1].points.select("emitter_idx", "class", "inside_outer", F.round("dist_to_outer_um", 6).alias("dist_to_outer_um")))


@query("loop_diagnostics")
def _(spark, sf):
    d = _classified(spark, sf, "edge_outer_polygon")[1].loop_diagnostics
    schema = "loop_id int, vertex_count int, area_um2 double, n_emitters_inside long, frac_in_fov double, frac_dense double, median_rhoK double, used_in_outer boolean, heuristic_type string"
    return spark.createDataFrame([tuple(x.values()) for x in d], schema)


@query("concavity_metric")
def _(spark, sf):
    report, _ = E.concavity_metric(_classified(spark, sf, "edge_outer_polygon")[1])
    return spark.createDataFrame([(k, float(v)) for k, v in report.items()], "name string, value double")

from . import kernel_queries  # noqa: E402, F401
