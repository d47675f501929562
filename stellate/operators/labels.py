"""Labels from neighbour edges: density cores, components, compaction and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.near import Close, joined
from .components import components
from .shared import FEW, drop_written, few, release, written
from .tiles import by_tiles, finite, picked, sites, spread

#: Tiles hold so many times the usual rows, as cores and components need few of the pairs of dense places.
TIMES = 32


def neighbor_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").count().select(F.col("src").alias("emitter_idx"), F.col("count").alias("n"))


def _apart(points: DataFrame) -> Column | None:
    """Points of no width aren't within their widths of their own copies."""
    return ~(F.col("sigma") > 0) if "sigma" in points.columns else None


def _linked(cols: dict, i: np.ndarray, j: np.ndarray, d2: np.ndarray, nsigma: float | None) -> np.ndarray:
    return (i != j) if nsigma is None else (i != j) & (np.sqrt(d2) < nsigma * (cols["sigma"][i] + cols["sigma"][j]))


def _counted(radius: float, nsigma: float | None, least: int):
    """A kernel: rows that ask, with column core."""

    def run(cols, ask, near):
        core = Close(near, np.arange(len(cols["n"])), cols.get("sigma"), nsigma).weights(cols["n"]) - 1 >= least
        # what is close enough for sure needs no look at its neighbours
        doubt, n = ask[~core[ask]], np.zeros(len(core))
        for i, j, d2 in near.pairs(doubt):
            ok = _linked(cols, i, j, d2, nsigma)
            i, j = i[ok], j[ok]
            low, high = (int(i.min()), int(i.max()) + 1) if len(i) else (0, 0)
            n[low:high] += np.bincount(i - low, cols["n"][j], high - low)
        core[doubt] = (n + cols["n"] - 1)[doubt] >= least
        core = core[ask]
        yield {c: picked(v, ask) for c, v in cols.items()} | {"core": core}

    return run


#: What a row of a forest is: a site with its tile's only root for it (null if there is none), a core's root that ties tiles, or one of several that a site touches.
OWN, TIE, TOUCH = 0, 1, 2


def _forest(nsigma: float | None, ride: tuple[str, ...] = ()):
    """A kernel: rows (ride..., a, b, kind): each core and the smallest of its component in the tile; so again (nothing rides) if other tiles have that core too; each other site and such of each component it touches; then sites that touch none."""

    def run(cols, ask, near):
        core, site = cols["core"].astype(bool), cols["site"]
        cores = np.flatnonzero(core)
        root = joined(np.arange(len(site)), *Close(near, cores, cols.get("sigma"), nsigma).links())
        # cores with none of another component in reach have nothing to join; others join from either side, so the largest component needn't ask
        doubt = cores[~near.settled(cores, root) & ~near.largest(cores, root)]
        touch = [np.empty((2, 0), np.int64)]
        for i, j, d2 in near.pairs(np.union1d(doubt, ask[~core[ask]])):
            ok = core[j] & _linked(cols, i, j, d2, nsigma)
            i, j = i[ok], j[ok]
            both = core[i]
            root = joined(root, i[both], j[both])
            touch.append(np.stack([i[~both], j[~both]]))
        least = np.full(len(site), np.iinfo(np.int64).max)
        np.minimum.at(least, root, site)
        least = least[root]
        t = np.concatenate(touch, axis=1)
        t = np.unique(np.stack([t[0], least[t[1]]]), axis=1) if t.shape[1] else t
        own = ask[core[ask]]
        here = np.zeros(len(site), bool)
        here[ask] = True
        tie = cores[~here[cores] | near.rim()[cores] | cols["_cut"][cores]]
        touches = np.bincount(t[0], minlength=len(site))
        at = np.r_[own, t[0]]
        rides = {c: pa.array(picked(cols[c], at)) for c in ride}
        rides = {c: pa.concat_arrays([v, pa.nulls(len(tie), v.type)]) for c, v in rides.items()}
        kinds = np.r_[np.full(len(own), OWN), np.where(touches[t[0]] > 1, TOUCH, OWN), np.full(len(tie), TIE)].astype(np.int32)
        yield rides | {"a": site[np.r_[at, tie]], "b": np.r_[least[own], t[1], least[tie]], "kind": kinds}
        none = ask[~core[ask] & (touches[ask] == 0)]
        yield {c: picked(cols[c], none) for c in ride} | {"a": site[none], "b": pa.nulls(len(none), pa.int64()), "kind": np.full(len(none), OWN, np.int32)}

    return run


def range_roots(points: DataFrame, radius: float, axes: list[str], keys: list[str], min_neighbors: int, nsigma: float | None = None) -> DataFrame:
    """Sites of points (keys..., axes..., sigma if nsigma, _own, site, n, root): root is the smallest core of the component, of the first one adjacent if the site is none itself, null if there is none.

    Points within the radius (and, with nsigma, within that many of both their sigmas) are neighbours; cores have min_neighbors or more.
    No pair leaves its task: cores are counted in tiles, which then hand on their sites with a forest of their cores. Only cores that several tiles have are joined between tiles.
    """
    spark, apart = points.sparkSession, _apart(points)
    s = written(sites(points, axes, keys, apart), "sites")
    release(spark)
    some = finite(axes)
    for c in [*keys, *(["sigma"] if nsigma is not None else [])]:
        some = some & F.col(c).isNotNull()
    near, rest = s.drop("_own").filter(some), written(s.filter(~some), "rest")
    if min_neighbors > 0:
        kind = T.StructType([*near.schema.fields, T.StructField("core", T.BooleanType())])
        cored = written(by_tiles(near, radius, axes, keys, _counted(radius, nsigma, min_neighbors), kind, times=TIMES), "cores")
        drop_written(s)
        release(spark)
    else:
        cored = near.withColumn("core", F.lit(True))
    ride = [f for f in near.schema.fields if f.name != "site"]
    ends = T.StructType([*(T.StructField(f.name, f.dataType) for f in ride), T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("kind", T.IntegerType())])
    links = written(by_tiles(cored, radius, axes, keys, _forest(nsigma, tuple(f.name for f in ride)), ends, times=TIMES), "links")
    drop_written(s if min_neighbors <= 0 else cored)
    release(spark)
    # what a core's tiles call its component is one: few rows, however many cores tie two tiles
    names = links.filter(F.col("kind") == TIE).groupBy("a").agg(F.collect_set("b").alias("bs")).filter(F.size("bs") > 1)
    r = components(names.select(F.array_min("bs").alias("u"), F.explode("bs").alias("v")), "u", "v", FEW)
    release(spark)
    small = r.limit(FEW + 1).count() <= FEW
    named = links.filter(F.col("kind") != TIE).join(F.broadcast(r) if small else r, F.col("b") == F.col("node"), "left").withColumn("root", F.coalesce("root", "b")).drop("node", "b")
    # a site that touches several components has a row for each
    whole = [F.first(f.name).alias(f.name) for f in ride]
    several = named.filter(F.col("kind") == TOUCH).groupBy("a").agg(*whole, F.min("root").alias("root"))
    out = named.filter(F.col("kind") == OWN).drop("kind").unionByName(several).withColumnRenamed("a", "site")
    out = out.withColumn("_own", F.lit(None).cast("long") if apart is None else F.when(F.coalesce(apart, F.lit(True)), F.col("site")))
    out = out.unionByName(rest.withColumn("root", (F.col("site") if min_neighbors <= 0 else F.lit(None)).cast("long"))).select(*s.columns, "root")
    if small:
        return out
    out = written(out, "rooted")
    for df in (links, r, rest):
        drop_written(df)
    release(spark)
    return out


def range_labelled(points: DataFrame, radius: float, axes: list[str], keys: list[str], min_neighbors: int, min_points: int = 0, nsigma: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (keys..., emitter_idx, label), as range_labels has them, and (keys..., id, n): how many points have each label, 0 included."""
    rooted = range_roots(points, radius, axes, keys, min_neighbors, nsigma)
    sizes = rooted.filter("root is not null").groupBy(*keys, "root").agg(F.sum("n").alias("size")).filter(F.col("size") >= min_points)
    order = Window.partitionBy(*keys).orderBy("root") if keys else Window.orderBy("root")
    named = few(written(sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("root").alias("_root"), F.row_number().over(order).alias("label")), "named"))
    on = F.col("root") == F.col("_root")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    found = rooted.join(named, on, "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("int"))
    counts = found.groupBy(*keys, F.col("label").alias("id")).agg(F.sum("n").alias("n"))
    return spread(points, found, keys, axes, "label", _apart(points)), counts


def range_labels(points: DataFrame, radius: float, axes: list[str], keys: list[str], min_neighbors: int, min_points: int = 0, nsigma: float | None = None) -> DataFrame:
    """Rows (keys..., emitter_idx, label): components numbered 1, 2, ... by smallest core in each group, if they have min_points points; a border point takes the lowest adjacent core's label; 0 is noise."""
    return range_labelled(points, radius, axes, keys, min_neighbors, min_points, nsigma)[0]


def compacted(labels: DataFrame, min_points: int, keys: list[str]) -> DataFrame:
    """Labels of fewer than min_points rows become 0; survivors are renumbered in order."""
    sizes = labels.filter("label > 0").groupBy(*keys, "label").count().filter(F.col("count") >= min_points)
    order = Window.partitionBy(*keys).orderBy("label") if keys else Window.orderBy("label")
    new = sizes.select(*keys, "label", F.row_number().over(order).cast("int").alias("new"))
    return labels.join(new, [*keys, "label"], "left").select(*keys, "emitter_idx", F.coalesce("new", F.lit(0)).alias("label"))


def applied(points: DataFrame, labels: DataFrame, remove_unclustered: bool = False) -> DataFrame:
    """points with column id from labels (0 where there is none)."""
    out = points.drop("id").join(labels.select("emitter_idx", F.col("label").alias("id")), "emitter_idx", "left").withColumn("id", F.coalesce("id", F.lit(0)).cast("int"))
    return out.filter("id <> 0") if remove_unclustered else out


def cluster_sizes(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.filter("id <> 0").groupBy(*keys, "id").agg(F.count("*").alias("n"))


def cluster_info(points: DataFrame, keys: list[str], algorithm: str, counts: DataFrame | None = None) -> DataFrame:
    """One row: counts, number of clusters and sizes in the order of (keys, id); `counts`, rows (keys..., id, n) where they are known, spare a pass over the points."""
    n, found = F.col("n"), F.col("id") != 0
    total = lambda v: F.coalesce(F.sum(v), F.lit(0))
    # one pass over the points: all else follows from the sizes
    s = points.groupBy(*keys, "id").agg(F.count("*").alias("n")) if counts is None else counts
    sizes = F.transform(F.array_sort(F.collect_list(F.when(found, F.struct(*keys, "id", "n")))), lambda r: r["n"])
    return s.agg(total(n).alias("n_locs_in"), total(F.when(found, n)).alias("n_clustered"), total(F.when(F.col("id") == 0, n)).alias("n_noise"), F.count_if(found).alias("n_clusters"), sizes.alias("cluster_sizes")).withColumn("algorithm", F.lit(algorithm))
