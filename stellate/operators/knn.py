"""Exact k-nearest-neighbour joins by growing grids.

Each round lays a grid over the queries that still lack an answer; a query takes candidates
from the 3^D cells around its own. If its k-th candidate is no farther than one cell, nothing
outside could be nearer and it's done; the others go on with wider cells. The first
width is set by each group's mean density between outer quantiles of each axis, so far points
don't widen it and most queries end in the first rounds. A query
also ends once its cells cover the group's whole extent. Ties go to the smaller index. Both
sides are written once as narrow tables, so a round reads neither their sources nor what made
them; tables of a round are deleted with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .range_join import squared_distance
from .shared import drop_written, written

#: Share of points beyond the quantiles on either side, and the number of open queries that take wide steps.
TAIL, FEW = 0.02, 1000


def knn_join(queries: DataFrame, points: DataFrame, k: int, axes: list[str], keys: list[str] | None = None) -> DataFrame:
    """Rows (keys..., src, dst, d, rank): the k nearest points of each query, itself (by index) excluded; all, if fewer."""
    if k < 1:
        raise ValueError(f"k must be >= 1; got {k}")
    keys, given = keys or [], points
    group = keys or ["_all"]
    narrow = lambda df: df.select(*keys, "emitter_idx", *axes, *([] if keys else [F.lit(0).alias("_all")]))
    points = written(narrow(points), "points")
    queries = points if queries is given else written(narrow(queries), "queries")
    stats = written(_widths(points, k, axes, group), "extent")
    todo, done, factor = queries, None, 1.0
    small = stats.limit(10_001).count() <= 10_000
    sized = F.broadcast(stats) if small else stats
    while True:
        w = F.col("_w") * factor
        cell = [F.floor(F.col(c) / w).cast("long") for c in axes]
        around = F.array(*[F.struct(*[(o + F.lit(d)).alias(f"c{i}") for i, (o, d) in enumerate(zip(cell, ds, strict=True))]) for ds in _offsets(len(axes))])
        q = todo.join(sized, group).select(*group, *[F.col(c).alias(f"a_{c}") for c in ("emitter_idx", *axes)], (w * w).alias("_w2"), (w >= F.col("_e")).alias("_whole"), F.explode(around).alias("cell"))
        p = points.join(sized, group).select(*group, *[F.col(c).alias(f"b_{c}") for c in ("emitter_idx", *axes)], F.struct(*[o.alias(f"c{i}") for i, o in enumerate(cell)]).alias("cell"))
        pairs = q.join(p, [*group, "cell"]).filter("a_emitter_idx <> b_emitter_idx").withColumn("_d2", squared_distance(axes))
        order = Window.partitionBy(*group, "a_emitter_idx").orderBy("_d2", "b_emitter_idx")
        best = pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.withColumn("_ok", F.col("_whole") | (F.max(F.when(F.col("rank") == k, F.col("_d2") <= F.col("_w2"))).over(Window.partitionBy(*group, "a_emitter_idx"))))
        found = written(best.filter("_ok").select(*keys, F.col("a_emitter_idx").alias("src"), F.col("b_emitter_idx").alias("dst"), F.sqrt("_d2").alias("d"), F.col("rank").cast("int")), "knn")
        done = found if done is None else done.unionByName(found)
        rest = todo.join(sized, group).filter(w < F.col("_e")).select(todo["*"]).join(found.select(*keys, F.col("src").alias("emitter_idx")).distinct(), [*keys, "emitter_idx"], "left_anti")
        rest = written(rest.select(todo.columns), "todo")
        if todo is not points and todo is not queries:
            drop_written(todo)
        left = rest.limit(FEW + 1).count()
        if not left:
            for df in {id(x): x for x in (rest, points, queries, stats)}.values():
                drop_written(df)
            return done
        # what is left after two rounds is far from most points; a few far queries take wide steps, as each round reads all points
        todo, factor = rest, factor * (2 if factor < 4 else 4 if left > FEW else 64)


def _widths(points: DataFrame, k: int, axes: list[str], group: list[str]) -> DataFrame:
    """Rows (group..., _e, _w): each group's whole extent and the width of its first cells."""
    whole = [F.max(c) - F.min(c) for c in axes]
    reach = F.greatest(*[F.max(F.abs(c)) for c in axes], F.lit(0.0))
    tails = [F.percentile_approx(c, [TAIL, 1 - TAIL], 1000) for c in axes]
    stats = points.groupBy(*group).agg(F.count("*").alias("_n"), F.greatest(*whole, F.lit(1e-12)).alias("_e"), reach.alias("_r"), *[w.alias(f"_s{i}") for i, w in enumerate(whole)], *[t.alias(f"_t{i}") for i, t in enumerate(tails)])
    # an axis whose middle is one value counts whole
    middle = [F.when(F.col(f"_t{i}")[1] > F.col(f"_t{i}")[0], F.col(f"_t{i}")[1] - F.col(f"_t{i}")[0]).otherwise(F.greatest(f"_s{i}", F.lit(1e-12))) for i in range(len(axes))]
    volume = middle[0]
    for m in middle[1:]:
        volume = volume * m
    # 3^D cells of this width hold about k + 1 points at that density
    width = F.pow(volume * (k + 1) / F.col("_n"), F.lit(1.0 / len(axes))) / 2
    # numbers of cells stay far within the digits of a double
    floor = F.greatest(F.greatest(*middle, F.lit(0.0)) / 1e6, F.col("_r") / 1e12)
    return stats.select(*group, "_e", F.least(F.greatest(width, floor), F.col("_e") * 1.01).alias("_w"))


def _offsets(d: int) -> list[list[int]]:
    out: list[list[int]] = [[]]
    for _ in range(d):
        out = [[*o, x] for o in out for x in (-1, 0, 1)]
    return out


def symmetric_graph(knn: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Undirected edges (keys..., src < dst): either end is among the other's nearest."""
    return knn.select(*(keys or []), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def kth_distance(knn: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys..., emitter_idx, r): distance to the k-th neighbour; points with fewer have no row."""
    return knn.filter(F.col("rank") == k).select(*(keys or []), F.col("src").alias("emitter_idx"), F.col("d").alias("r"))
