"""Neighbourhoods within a radius by tiles, so that a task finds pairs and hands on what it needs of them.

A tile is a square (or cube) of a few radii; it gets its own points and those within a radius of
it, so points are moved once or little more, and never a pair. Its side follows from the
number of points that share a tile. Points of one tile that are still too many ask in slices,
each against all of the tile. Points at the same place are one site with a count (`sites`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels import discs
from ..kernels.near import Near
from .shared import drop_written, few, written

#: Sides of tiles in radii; rows of a tile that the mean row shares, at most, unless tiles are the smallest; rows that ask in a slice; rows that a kernel gets at least, tiles allowing; places that take wide steps; places that ask of the points around them alone; slices of sums, in slices of pairs, as each slice gets all of its tile.
SIDES, SHARED, SLICE, BATCH, FEW, ASKING, HEAVY = (2, 4, 8, 16, 32), 4096, 4096, 32768, 1000, 10_000, 16


def finite(axes: list[str]) -> Column:
    """Whether all coordinates are numbers; others have no neighbours."""
    out = F.lit(True)
    for c in axes:
        out = out & F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) & ~F.isnan(c)
    return F.coalesce(out, F.lit(False))


def sites(points: DataFrame, axes: list[str], keys: list[str], apart: Column | None = None) -> DataFrame:
    """Rows (keys..., axes..., _own, site, n): places, their smallest index and number of points; rows without coordinates, or where `apart` holds, are a site each (_own: its index)."""
    lone = ~finite(axes) if apart is None else ~finite(axes) | F.coalesce(apart, F.lit(True))
    p = points.withColumn("_own", F.when(lone, F.col("emitter_idx")))
    return p.groupBy(*keys, *axes, *(c for c in points.columns if c not in (*keys, *axes, "emitter_idx")), "_own").agg(F.min("emitter_idx").alias("site"), F.count("*").alias("n"))


def members(points: DataFrame, found: DataFrame, same: list[str], axes: list[str], value: Column, apart: Column | None = None, how: str = "left") -> DataFrame:
    """points with what was found of their site (null, or with an inner join no row, where nothing was); `same`: columns that a site's points share."""
    lone = ~finite(axes) if apart is None else ~finite(axes) | F.coalesce(apart, F.lit(True))
    p = points.withColumn("_own", F.when(lone, F.col("emitter_idx")))
    s = found.select(*[F.col(c).alias(f"_s_{c}") for c in (*same, "_own")], value)
    on = None
    for c in (*same, "_own"):
        one = F.col(c).eqNullSafe(F.col(f"_s_{c}"))
        on = one if on is None else on & one
    return p.join(s, on, how).drop("_own", *[f"_s_{c}" for c in (*same, "_own")])


def spread(points: DataFrame, found: DataFrame, keep: list[str], axes: list[str], value: str, apart: Column | None = None) -> DataFrame:
    """Rows (keep..., emitter_idx, value) of all points; found has all their sites. A site of one point is that point: only others are looked up by place."""
    own = found.filter("n = 1").select(*keep, F.col("site").alias("emitter_idx"), value)
    shared = found.filter("n > 1")
    if not shared.limit(1).count():
        return own
    same = [c for c in points.columns if c != "emitter_idx"]
    return own.unionByName(members(points, few(shared), same, axes, F.col(value), apart, "inner").select(*keep, "emitter_idx", value))


def by_tiles(rows: DataFrame, radius: float, axes: list[str], keys: list[str], kernel: Callable[[dict, np.ndarray, Near], Iterator[dict]], schema, asks: str | None = None, ident: str = "site", times: int = 1, slices: int = 1) -> DataFrame:
    """What kernel(columns, ask, near) yields, tile by tile: columns in the order of `near`'s cells, ask the places of rows that ask here (each row once, if column `asks` holds or is not given).

    Rows without coordinates or with a null key neither ask nor answer. Tiles and slices may hold `times` as many rows as they do else, slices again `slices` as many.
    Column `_cut` is whether the tile is sliced.
    """
    spark = rows.sparkSession
    rows = rows.filter(finite(axes))
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    width, sliced = _plan(rows, radius, axes, keys, times, slices)
    own = [F.floor(F.col(c) / F.lit(width)).cast("long") for c in axes]
    reach = [F.lit(radius * (1 + 1e-9)) + F.abs(F.col(c)) * F.lit(1e-15) for c in axes]
    span = [F.sequence(F.floor((F.col(c) - r) / F.lit(width)).cast("long"), F.floor((F.col(c) + r) / F.lit(width)).cast("long")) for c, r in zip(axes, reach, strict=True)]
    ts = [f"_t{i}" for i in range(len(axes))]
    out = rows.select("*", *[o.alias(f"_o{i}") for i, o in enumerate(own)])
    for t, s in zip(ts, span, strict=True):
        out = out.withColumn(t, F.explode(s))
    here = F.lit(True) if asks is None else F.col(asks)
    for i, t in enumerate(ts):
        here = here & (F.col(f"_o{i}") == F.col(t))
    out = out.withColumn("_ask", here)
    if sliced is not None:
        out = out.join(sliced, [*keys, *ts], "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.coalesce("_slices", F.lit(1)) - 1)))
        out = out.withColumn("_ask", F.col("_ask") & (F.pmod(F.xxhash64(ident), F.coalesce("_slices", F.lit(1))) == F.col("_slice"))).withColumn("_cut", F.col("_slices").isNotNull()).drop("_slices")
    else:
        out = out.withColumn("_slice", F.lit(0)).withColumn("_cut", F.lit(False))
    out = out.drop(*[f"_o{i}" for i in range(len(axes))])
    group = [*keys, *ts, "_slice"]
    dealt = out.repartition(many(spark), *group).sortWithinPartitions(*group)
    return dealt.mapInArrow(_runner(axes, group, ts, width, radius, kernel, pa_schema(schema)), schema)


def many(spark: SparkSession) -> int:
    """Partitions of what is few bytes and much work, so that their number isn't left to the bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def near_sums(queries: DataFrame, points: DataFrame, radius: float, axes: list[str], terms: list[str], sigma: float | None = None) -> DataFrame:
    """Rows (axes..., site, n, m, terms...): for each place of queries that has any, the number of points in the radius, and sums over them; copies at the place itself count, and so does the point itself if it is one of them.

    Terms: `kernel` (exp(-d^2 / (2 sigma^2)); m is null then), or `d_x` and `d_y` (the neighbour's coordinate less the query's). n is the number of points at the place.
    """
    if queries is points:
        rows = sites(points.select("emitter_idx", *axes), axes, []).drop("_own").withColumn("asks", F.lit(True))
    else:
        a = queries.groupBy(*axes).agg(F.min("emitter_idx").alias("site")).select(*axes, "site", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks"))
        rows = a.unionByName(sites(points.select("emitter_idx", *axes), axes, []).drop("_own").withColumn("asks", F.lit(False)))
        # a place that asks and holds points is one row
        rows = rows.groupBy(*axes).agg(F.min("site").alias("site"), F.sum("n").alias("n"), F.max("asks").alias("asks"))
    return site_sums(written(rows, "sites"), radius, axes, terms, sigma)


def site_sums(rows: DataFrame, radius: float, axes: list[str], terms: list[str], sigma: float | None = None) -> DataFrame:
    """near_sums of places (axes..., site, n, asks)."""
    schema = T.StructType([*(T.StructField(c, T.DoubleType()) for c in axes), T.StructField("site", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()), *(T.StructField(t, T.DoubleType()) for t in terms)])
    smooth = terms == ["kernel"]
    # kernels of cells are exact for sides that are short in sigmas
    cells = len(axes) == 2 and (set(terms) <= {"d_x", "d_y"} or smooth and radius / discs.CELLS[0] <= discs.SMOOTH * sigma)

    def run(cols, ask, near):
        size, m, counts = len(near.x), np.zeros(len(near.x)), cols["n"].astype(float)
        sums = {t: np.zeros(size) for t in terms}
        for first, end, k in discs.dense_tiles(near) if cells else []:
            here = (ask >= first) & (ask < end)
            at, ask = ask[here], ask[~here]
            if not len(at):
                continue
            found = discs.disc_sums(near, first, end, k, at, counts, sigma if smooth else None)
            if smooth:
                sums["kernel"][at] = found[:, 0] if found.ndim > 1 else found
            else:
                m[at] = np.rint(found[:, 0])
                for t in terms:
                    sums[t][at] = found[:, 1 + axes.index(t[2:])]
        for i, j, d2 in near.pairs(ask):
            w = counts[j]
            # i comes in runs; sums over few places are cheap
            low, high = (int(i.min()), int(i.max()) + 1) if len(i) else (0, 0)
            m[low:high] += np.bincount(i - low, w, high - low)
            for t in terms:
                if t == "kernel":
                    v = np.exp(d2 * (-1 / (2 * sigma * sigma)))
                else:
                    axis = near.x[:, axes.index(t[2:])]
                    v = axis[j] - axis[i]
                sums[t][low:high] += np.bincount(i - low, w * v, high - low)
        ask = np.flatnonzero(cols["_ask"])
        yield {c: near.x[ask, k] for k, c in enumerate(axes)} | {"site": cols["site"][ask], "n": cols["n"][ask], "m": pa.nulls(len(ask), pa.int64()) if smooth else m[ask].astype(np.int64)} | {t: sums[t][ask] for t in terms}

    return by_tiles(rows, radius, axes, [], run, schema, "asks", slices=HEAVY)


def kth_distances(queries: DataFrame, points: DataFrame, ks: list[int], axes: list[str], itself: bool, keys: list[str] | None = None) -> DataFrame:
    """Rows (keys..., axes..., d<k> for each k): distance from each place of queries to its k-th nearest point (of the same keys), null if there are fewer; with `itself`, a query is one of points and not its own neighbour.

    Copies count, but are one site. A place that has fewer than the largest k in the radius asks again with a wider one.
    """
    most, keys = max(ks), keys or []
    of = [*keys, *axes]
    every = points.select("emitter_idx", *of).filter(finite(axes))
    todo = written(queries.groupBy(*of).agg(F.min("emitter_idx").alias("site")).filter(finite(axes)).select(*of, "site", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks")), "asking")
    # where few places ask, only points around them are put together and dealt, round by round
    some = todo.limit(ASKING + 1).count() <= ASKING
    held = None if some else written(sites(every, axes, keys).drop("_own").withColumn("asks", F.lit(False)), "held")
    lone = every.select(*of, F.lit(1).cast("long").alias("n"), F.lit(False).alias("asks"))
    both = (lone if some else held.select(*of, "n", "asks")).unionByName(todo.select(*of, "n", "asks"))
    ends = both.agg(*[F.max(c) - F.min(c) for c in axes], *[F.percentile_approx(F.when(F.col("asks"), F.col(c)), [0.02, 0.98], 1000) for c in axes], F.sum("n")).first()
    dims = len(axes)
    if ends[0] is None or not ends[2 * dims]:
        return todo.select(*of, *[F.lit(None).cast("double").alias(f"d{k}") for k in ks])
    whole = max(float(sum(ends[:dims])), 1e-12)
    middle = [(t[1] - t[0]) or e or 1e-12 for t, e in zip(ends[dims : 2 * dims], ends[:dims], strict=True)]
    radius = min(max(float((np.prod(middle) * most / ends[2 * dims]) ** (1 / dims)) * 0.8, whole * 1e-7), whole)
    schema = T.StructType([*points.select(*keys).schema.fields, *(T.StructField(c, T.DoubleType()) for c in axes), *(T.StructField(f"d{k}", T.DoubleType()) for k in ks), T.StructField("site", T.LongType())])

    def run(cols, ask, near):
        n = cols["n"]
        for at in range(0, len(ask), 512):
            q = ask[at : at + 512]
            i, j, d2 = (np.concatenate(v) for v in zip(*near.pairs(q), strict=True))
            w = n[j] - ((d2 == 0) & (n[j] > 0)) if itself else n[j]
            o = np.lexsort((d2, i))
            i, d2, total = i[o], d2[o], np.cumsum(w[o])
            first, last = np.searchsorted(i, q), np.searchsorted(i, q, side="right")
            before = np.where(first > 0, total[first - 1], 0)
            out = {c: picked(cols[c], q) for c in keys} | {c: near.x[q, k] for k, c in enumerate(axes)} | {"site": cols["site"][q]}
            for k in ks:
                place = np.searchsorted(total, before + k)
                ok = place < last
                out[f"d{k}"] = pa.array(np.sqrt(d2[np.minimum(place, len(d2) - 1)]), mask=~ok)
            yield out

    done = None
    while True:
        if some:
            held = written(sites(around(every, todo, radius, axes, keys), axes, keys).drop("_own").withColumn("asks", F.lit(False)), "held")
        got = written(by_tiles(held.unionByName(todo), radius, axes, keys, run, schema, "asks"), "kth")
        if some:
            drop_written(held)
        last = radius >= whole
        found = (got if last else got.filter(F.col(f"d{most}").isNotNull())).select(*of, *[f"d{k}" for k in ks])
        done = found if done is None else done.unionByName(found)
        rest = written(got.filter(F.col(f"d{most}").isNull()).select(*of, "site", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asks")), "asking")
        drop_written(todo)
        left = rest.limit(FEW + 1).count()
        if last or not left:
            drop_written(rest)
            if not some:
                drop_written(held)
            return done
        # few places that are left, far from most points, take wide steps, as each round reads all sites
        todo, radius = rest, min(radius * (2 if left > FEW else 8), whole)


def around(rows: DataFrame, asking: DataFrame, radius: float, axes: list[str], keys: list[str]) -> DataFrame:
    """Those of rows that lie in a cell, a radius wide, that a row of `asking` (few) reaches into."""
    cells = asking.select(*keys, *axes)
    for i, c in enumerate(axes):
        reach = F.lit(radius * (1 + 1e-9)) + F.abs(F.col(c)) * F.lit(1e-15)
        cells = cells.withColumn(f"_c{i}", F.explode(F.sequence(F.floor((F.col(c) - reach) / F.lit(radius)).cast("long"), F.floor((F.col(c) + reach) / F.lit(radius)).cast("long"))))
    cs = [f"_c{i}" for i in range(len(axes))]
    for c, axis in zip(cs, axes, strict=True):
        rows = rows.withColumn(c, F.floor(F.col(axis) / F.lit(radius)).cast("long"))
    return rows.join(F.broadcast(cells.select(*keys, *cs).distinct()), [*keys, *cs], "left_semi").drop(*cs)


def picked(column, at: np.ndarray):
    """Values of a kernel's column."""
    return column[at] if isinstance(column, np.ndarray) else column.take(pa.array(at))


def pa_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _plan(rows: DataFrame, radius: float, axes: list[str], keys: list[str], times: int, slices: int) -> tuple[float, DataFrame | None]:
    """Side of a tile, and rows (keys..., tile, _slices) of tiles with too many points."""
    ts = [f"_t{i}" for i in range(len(axes))]
    least = radius * SIDES[0]
    fine = rows.groupBy(*keys, *[F.floor(F.col(c) / F.lit(least)).cast("long").alias(t) for c, t in zip(axes, ts, strict=True)]).agg(F.count("*").alias("n"))
    side = F.explode(F.array(*[F.lit(s // SIDES[0]) for s in SIDES])).alias("m")
    coarse = fine.select("*", side).groupBy("m", *keys, *[F.floor(F.col(t) / F.col("m")).alias(t) for t in ts]).agg(F.sum("n").alias("n"))
    found = {r["m"]: r for r in coarse.groupBy("m").agg((F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).alias("s"), F.max("n").alias("most")).collect()}
    m = max([s // SIDES[0] for s in SIDES if s // SIDES[0] not in found or found[s // SIDES[0]]["s"] <= SHARED * times], default=1)
    if m not in found or found[m]["most"] <= 2 * SLICE * times * slices:
        return least * m, None
    width = least * m
    hot = written(rows.groupBy(*keys, *[F.floor(F.col(c) / F.lit(width)).cast("long").alias(t) for c, t in zip(axes, ts, strict=True)]).agg(F.count("*").alias("n")).filter(F.col("n") > 2 * SLICE * times * slices).select(*keys, *ts, F.ceil(F.col("n") / (SLICE * times * slices)).cast("int").alias("_slices")), "hot")
    some = hot.limit(10_001).count()
    return width, None if not some else F.broadcast(hot) if some <= 10_000 else hot


def _runner(axes, group, ts, width, radius, kernel, schema):
    def work(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x = np.column_stack([table[c].to_numpy() for c in axes]).astype(float)
        tile = np.searchsorted(starts, np.arange(table.num_rows), side="right")
        origin = np.column_stack([table[t].to_numpy() for t in ts]) * width
        near = Near(x, tile, origin, width, radius)
        # keys, of any type, and columns with nulls stay in Arrow
        cols = {c: table[c].take(pa.array(near.order)) if c in group or table[c].null_count else table[c].to_numpy()[near.order] for c in table.column_names}
        for out in kernel(cols, np.flatnonzero(cols["_ask"]), near):
            arrays = [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in (out[f.name] for f in schema)]
            arrays = [(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(f.type) for a, f in zip(arrays, schema, strict=True)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    def changes(t: pa.Table) -> np.ndarray:
        """Places, but 0, where another tile or slice begins."""
        other = np.zeros(t.num_rows - 1, bool)
        for c in group:
            v = t[c].combine_chunks()
            other |= pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(other) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows < BATCH:
                continue
            t = pa.Table.from_batches(held)
            at = changes(t)
            if len(at):
                yield from work(t.slice(0, at[-1]), at[:-1])
                held = t.slice(at[-1]).to_batches()
                rows = t.num_rows - int(at[-1])
        if held:
            t = pa.Table.from_batches(held)
            yield from work(t, changes(t))

    return run
