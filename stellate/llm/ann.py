"""Approximate largest inner products by low-dimensional stable projections and a kd-tree.

Vectors get one more coordinate that makes all candidates equally long, so the largest inner
product is the nearest Euclidean neighbour. Candidates and queries are projected by a Gaussian
(2-stable) matrix to PROJECTED dimensions: a projected squared distance over the true one is
chi-square distributed.

The upper levels of the kd-tree are fitted on at most SAMPLE projected vectors and deal every
vector into one of at most CELLS cells, whose boxes are taken over all rows; a cell of more than
`block` rows is split evenly into blocks by a drawn number. The lower levels are built in the
task that holds a block, once for all queries that come to it.

A query visits a block's leaves in order of projected distance to their boxes, verifies what
they hold by true inner products, and stops when a candidate nearer than its k-th so far would
lie within the projected distance visited with probability CERTAIN or more (chi-square test).
First each query visits the block of its own cell. Its k-th there is the bound for the second
round, in which the same test leaves out whole cells, and only what beats the bound comes back.
Candidates are dealt to tasks once a round and queries stream past them in batches, so a task
holds one block and one batch; nothing grows with the number of queries. Queries are a stated
set. On clustered vectors few cells pass the test; on directions close to uniform most do, and
then the work is queries x candidates.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part; vectors of each length are searched on their own; ties go to the smaller id; repeated ids
are rows of their own, equal vectors or not: each row of a repeated id has its own k results as
a query, and finds all rows but itself; with fewer candidates than k all are returned; an empty
table gives an empty result; other columns are ignored, clashing names or not.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import table, written

K, EVERY, PROJECTED, CERTAIN, LEAF, SEED = 20, 20, 8, 0.95, 64, 7
BLOCK, SAMPLE, CELLS, AT_ONCE = 8192, 65_536, 4096, 512


@cache
def chi_square_point(p: float, m: int) -> float:
    """x with P(chi-square of m degrees < x) = p, for even m, by bisection of the closed form."""
    from math import exp

    def below(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def reach_of(kth: np.ndarray, length: np.ndarray, top: float) -> np.ndarray:
    """The squared projected distance at which the test stops: vectors of unit length are 2 - 2 cos apart."""
    return chi_square_point(CERTAIN, PROJECTED) * np.maximum(2 - 2 * (kth / length) / top, 0.0)


class Tree:
    """A kd-tree over projected points: leaves as runs of an order, and their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        runs, todo = [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            if b - a <= leaf:
                runs.append((a, b))
                continue
            p = points[self.order[a:b]]
            axis, mid = int(np.argmax(p.max(0) - p.min(0))), (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(p[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.runs = sorted(runs)
        held = [points[self.order[a:b]] for a, b in self.runs]
        self.low, self.high = np.array([h.min(0) for h in held]), np.array([h.max(0) for h in held])


def matrix_of(d: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((d + 1, PROJECTED))


def lengths(x: np.ndarray) -> np.ndarray:
    """Norms, without overflow of squares."""
    most = np.maximum(np.abs(x).max(1), np.finfo(float).tiny)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def projected(x: np.ndarray, top: float) -> np.ndarray:
    """Of candidates in units of the longest, made equally long by one more coordinate."""
    x = x / top
    return np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]) @ matrix_of(x.shape[1])


def projected_queries(q: np.ndarray) -> np.ndarray:
    return (q / lengths(q)[:, None]) @ matrix_of(q.shape[1])[:-1]


def gaps(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(p), len(low)))
    for j in range(p.shape[1]):
        g = np.maximum(np.maximum(low[:, j] - p[:, j, None], p[:, j, None] - high[:, j]), 0)
        out += g * g
    return out


class Splits:
    """The upper levels: a point goes left where its axis is at most the cut."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.axis, self.cut, self.child, self.cells = [], [], [], 0
        self.root = self._build(sample, cells)

    def _build(self, p: np.ndarray, cells: int) -> int:
        if cells > 1 and len(p) > 1:
            axis = int(np.argmax(p.max(0) - p.min(0)))
            cut = float(np.partition(p[:, axis], (len(p) - 1) // 2)[(len(p) - 1) // 2])
            left = p[:, axis] <= cut
            if not left.all():
                at = len(self.axis)
                self.axis.append(axis)
                self.cut.append(cut)
                self.child.append(None)
                self.child[at] = (self._build(p[left], cells // 2), self._build(p[~left], cells - cells // 2))
                return at
        self.cells += 1
        return -self.cells  # a cell: its number + 1, negative

    def cell_of(self, p: np.ndarray) -> np.ndarray:
        at = np.full(len(p), self.root)
        if self.axis:
            axis, cut, child = np.array(self.axis), np.array(self.cut), np.array(self.child)
            while len(inner := np.flatnonzero(at >= 0)):
                n = at[inner]
                at[inner] = child[n, (p[inner, axis[n]] > cut[n]).astype(int)]
        return -at - 1


class Block:
    """Candidates of one block with the lower levels of the tree."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: float):
        p = projected(x, top)
        self.tree, self.top = Tree(p), top
        self.ids, self.x = ids[self.tree.order], np.ascontiguousarray(x[self.tree.order])

    def search(self, qids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, candidate ids, scores): up to k for each query, none under its floor; rows equal to the query in id and vector are left out."""
        t, n = self.tree, len(q)
        length = lengths(q)
        boxes = gaps(projected_queries(q), t.low, t.high)
        order = np.argsort(boxes, axis=1, kind="stable")
        near = np.take_along_axis(boxes, order, 1)
        best, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        slack = 1e-12 * self.top * length
        active, at, step = np.arange(n), 0, max(4, -(-2 * k // LEAF))
        while len(active) and at < len(t.runs):
            step = min(step, len(t.runs) - at)
            mine = order[active, at : at + step]
            score = np.full((len(active), step * LEAF), -np.inf)
            row = np.zeros(score.shape, np.int64)
            for leaf in np.unique(mine):
                a, slot = np.nonzero(mine == leaf)
                x, y = t.runs[leaf]
                s = q[active[a]] @ self.x[x:y].T
                own, c = np.nonzero(self.ids[x:y] == qids[active[a], None])
                if len(own):
                    same = (self.x[x + c] == q[active[a[own]]]).all(1)
                    s[own[same], c[same]] = -np.inf
                cols = slot[:, None] * LEAF + np.arange(y - x)
                score[a[:, None], cols] = s
                row[a[:, None], cols] = np.arange(x, y)
            self._merge(active, score, row, best, who, q, slack, k)
            at, step = at + step, step * 2
            if at < len(t.runs):
                kth = np.maximum(best[active, -1], floor[active])
                reach = reach_of(kth, length[active], self.top)
                active = active[~((kth > -np.inf) & (near[active, at] >= reach))]
        places, cols = np.nonzero((best > -np.inf) & (best >= floor[:, None]))
        return places, who[places, cols], best[places, cols]

    def _merge(self, active, score, row, best, who, q, slack, k):
        """The k best of what was held and what is new, by exact scores and then ids. Products of matrices round by position, so those close to the k-th are computed again one by one."""
        m = min(k + 8, score.shape[1])
        cols = np.argpartition(-score, m - 1, axis=1)[:, :m] if m < score.shape[1] else np.broadcast_to(np.arange(m), score.shape)
        some = np.take_along_axis(score, cols, 1)
        kth = -np.partition(-some, min(k, m) - 1, axis=1)[:, min(k, m) - 1]
        kth = np.where(np.isfinite(kth), kth - slack[active], -np.inf)
        crowded = np.flatnonzero(((score >= kth[:, None]) & (score > -np.inf)).sum(1) > m)
        plain = np.ones(len(active), bool)
        plain[crowded] = False
        rows, some, a = np.take_along_axis(row, cols, 1)[plain], some[plain], active[plain]
        self._keep(a, np.where(some > -np.inf, (self.x[rows] * q[a][:, None, :]).sum(-1), -np.inf), self.ids[rows], best, who, k)
        for i in crowded:  # more ties than places kept
            r, a = row[i, (score[i] >= kth[i]) & (score[i] > -np.inf)], active[i : i + 1]
            self._keep(a, (self.x[r] * q[a]).sum(-1)[None], self.ids[r][None], best, who, k)

    @staticmethod
    def _keep(active, exact, ids, best, who, k):
        s, i = np.concatenate([best[active], exact], 1), np.concatenate([who[active], np.where(exact > -np.inf, ids, np.iinfo(np.int64).max)], 1)
        o = np.lexsort((i, -s), axis=-1)[:, :k]
        best[active], who[active] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


def _arrays(b, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of one length each, of a batch's list column without nulls."""
    import pyarrow.compute as pc

    col = b.column(at)
    d = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(d):
        rows = np.flatnonzero(d == n)
        out.append((rows, col.take(rows).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)))
    return out


def _clean(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (tag, id, v, d, norm) of the vectors that take part; tag tells rows apart."""
    import pyarrow as pa
    import pyarrow.compute as pc

    kind = vectors.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    narrow = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(T.ArrayType(kind)).alias("v"), F.spark_partition_id().alias("part")).filter("id is not null and size(v) > 0")

    def run(batches):
        n = 0
        for b in batches:
            col = b.column(1)
            size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            starts = np.r_[0, np.cumsum(size)[:-1]].astype(np.int64)
            most = np.maximum.reduceat(np.abs(x), starts) if len(x) else np.empty(0)
            b = b.filter(pa.array(np.isfinite(most) & (most > 0)))
            norm = np.zeros(b.num_rows)
            for rows, x in _arrays(b, 1):
                norm[rows] = lengths(x)
            tag = (b.column(2).to_numpy(zero_copy_only=False).astype(np.int64) << 40) + n + np.arange(b.num_rows)
            n += b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(tag), b.column(0), b.column(1), pc.cast(pc.list_value_length(b.column(1)), pa.int32()), pa.array(norm)], names=["tag", "id", "v", "d", "norm"])

    return narrow.mapInArrow(run, T.StructType.fromDDL("tag long, id long").add("v", T.ArrayType(kind)).add("d", "integer").add("norm", "double"))


class Index:
    """For each length of vectors: the longest norm, the upper splits, and cells with their boxes and numbers of blocks."""

    def __init__(self, rows: DataFrame, is_query, block: int):
        counts = rows.groupBy("d").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max(is_query(F.col("id")).cast("int")).alias("asked")).filter("asked = 1").collect()
        self.top = {r["d"]: r["top"] for r in counts}  # a row for each length of vectors
        total = sum(r["n"] for r in counts)
        large = {r["d"]: min(-(-r["n"] // block), CELLS * r["n"] // total + 1) for r in counts if r["n"] > block}
        self.splits = {d: Splits(np.empty((0, PROJECTED)), 1) for d in self.top}
        if large:
            share = min(1.0, SAMPLE / total)
            some = rows.filter(F.col("d").isin(list(large)) & (F.pmod(F.xxhash64("tag"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).limit(2 * SAMPLE)
            got = self._told(some, lambda d, cell, p: [(d, x.tolist(), None, 1) for x in p], "d int, low array<double>, high array<double>, n long").collect()
            for d, cells in large.items():
                sample = np.array([r["low"] for r in got if r["d"] == d]).reshape(-1, PROJECTED)
                self.splits[d] = Splits(sample, cells)

        def boxed(d, cell, p):
            return [(d, int(c), p[cell == c].min(0).tolist(), p[cell == c].max(0).tolist(), int((cell == c).sum())) for c in np.unique(cell)]

        parts = self._told(rows, boxed, "d int, cell int, low array<double>, high array<double>, n long")
        found = parts.groupBy("d", "cell").agg(F.sum("n").alias("n"), *[f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]).collect()  # a row for each cell
        self.low, self.high, self.cells, self.blocks = {}, {}, {}, {}
        for d in self.top:
            mine = sorted((r for r in found if r["d"] == d), key=lambda r: r["cell"])
            self.cells[d] = np.array([r["cell"] for r in mine])
            self.blocks[d] = np.array([-(-r["n"] // block) for r in mine])
            self.low[d], self.high[d] = (np.array([[r[f"{c}{i}"] for i in range(PROJECTED)] for r in mine]) for c in ("low", "high"))

    def _told(self, rows: DataFrame, tell, schema: str) -> DataFrame:
        """What tell(d, cells, projections) says of each batch of candidates."""
        import pyarrow as pa

        top, splits = self.top, self.splits
        names = T.StructType.fromDDL(schema)

        def run(batches):
            from pyspark.sql.pandas.types import to_arrow_schema

            for b in batches:
                out = []
                for _, x in _arrays(b, 0):
                    if (d := x.shape[1]) in top:
                        p = projected(x, top[d])
                        out += tell(d, splits[d].cell_of(p), p)
                if out:
                    s = to_arrow_schema(names)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), s, strict=True)], schema=s)

        return rows.select("v").mapInArrow(run, names)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """Rows (d, place, asks, tag, id, v, floor): the block of each candidate."""
        top, splits, cells, blocks = self.top, self.splits, self.cells, self.blocks

        def deal(d, tag, x, _):
            cell = np.searchsorted(cells[d], splits[d].cell_of(projected(x, top[d])))
            return np.arange(len(x)), _first(blocks[d])[cell] + tag % blocks[d][cell]

        return self._dealt(rows.withColumn("floor", F.lit(0.0)), deal, False)

    def home(self, asks: DataFrame) -> DataFrame:
        """The same of queries: a block of the cell whose box is nearest."""
        low, high, blocks = self.low, self.high, self.blocks

        def deal(d, tag, x, _):
            return np.arange(len(x)), _home(d, tag, x, low, high, blocks)

        return self._dealt(asks.withColumn("floor", F.lit(float("-inf"))), deal, True)

    def others(self, asks: DataFrame) -> DataFrame:
        """The same of queries with a floor: all other blocks that may hold something over it."""
        top, low, high, blocks = self.top, self.low, self.high, self.blocks

        def deal(d, tag, x, floor):
            near = gaps(projected_queries(x), low[d], high[d]) < reach_of(floor, lengths(x), top[d])[:, None]
            near = np.repeat(near, blocks[d], axis=1)  # a column for each block
            near[np.arange(len(x)), _home(d, tag, x, low, high, blocks)] = False
            return np.nonzero(near)

        return self._dealt(asks, deal, True)

    def _dealt(self, rows: DataFrame, deal, asks: bool) -> DataFrame:
        import pyarrow as pa

        top = self.top
        names = T.StructType.fromDDL("d int, place long, asks boolean, tag long, id long").add(rows.schema["v"]).add("floor", "double")

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, AT_ONCE):
                    s = b.slice(at, AT_ONCE)
                    tag, floor = s.column(0).to_numpy(zero_copy_only=False), s.column(3).to_numpy(zero_copy_only=False)
                    for rows_, x in _arrays(s, 2):
                        if (d := x.shape[1]) not in top:
                            continue
                        i, place = deal(d, tag[rows_], x, floor[rows_])
                        for j in range(0, len(i), 4 * AT_ONCE):
                            o = s.take(pa.array(rows_[i[j : j + 4 * AT_ONCE]]))
                            n = o.num_rows
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, d, np.int32)), pa.array(place[j : j + n].astype(np.int64)), pa.array(np.full(n, asks)), *o.columns], names=names.names)

        return rows.select("tag", "id", "v", "floor").mapInArrow(run, names)


def _first(blocks: np.ndarray) -> np.ndarray:
    return np.cumsum(blocks) - blocks


def _home(d, tag, x, low, high, blocks) -> np.ndarray:
    cell = gaps(projected_queries(x), low[d], high[d]).argmin(1)
    return _first(blocks[d])[cell] + tag % blocks[d][cell]


def _searched(rows: DataFrame, index: Index, k: int) -> DataFrame:
    """Rows (tag, query_id, vec_id, score) from candidates and queries dealt to blocks."""
    import pyarrow as pa

    top = index.top
    many = sum(int(b.sum()) for b in index.blocks.values())
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), many)
    rows = rows.repartition(parts, "d", "place").sortWithinPartitions("d", "place", "asks")

    def run(batches):
        at, held, ready = None, [], None
        for b in batches:
            d, place, asks = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            edges = np.flatnonzero((np.diff(d) != 0) | (np.diff(place) != 0) | (asks[1:] != asks[:-1])) + 1
            for x, y in zip(np.r_[0, edges], np.r_[edges, len(d)], strict=True):
                if y == x:
                    continue
                if (d[x], place[x]) != at:
                    at, held, ready = (d[x], place[x]), [], None
                s = b.slice(x, y - x)
                ids, v = s.column(4).to_numpy(zero_copy_only=False), _arrays(s, 5)[0][1]
                if not asks[x]:
                    held.append((ids, v))
                    continue
                if not held and ready is None:
                    continue
                if ready is None:
                    ready = Block(np.concatenate([i for i, _ in held]), np.concatenate([c for _, c in held]), top[int(d[x])])
                    held = []
                tag, floor = s.column(3).to_numpy(zero_copy_only=False), s.column(6).to_numpy(zero_copy_only=False)
                for j in range(0, len(ids), AT_ONCE):
                    q, i, score = ready.search(ids[j : j + AT_ONCE], v[j : j + AT_ONCE], floor[j : j + AT_ONCE], k)
                    yield pa.RecordBatch.from_arrays([pa.array(tag[j + q]), pa.array(ids[j + q]), pa.array(i), pa.array(score)], names=["tag", "query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "tag long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = K, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's k largest inner products found; ids are whole numbers."""
    rows = written(_clean(vectors, key, vector), "vectors")
    index = Index(rows, is_query, block)
    # equal rows are searched once, and are each other's nearest besides
    asks = rows.filter(is_query(F.col("id"))).groupBy("id", "v").agg(F.min("tag").alias("tag"), F.count("*").alias("copies"))
    asks = written(asks, "queries")
    first = written(_searched(index.candidates(rows).unionByName(index.home(asks)), index, k), "first")
    floors = first.groupBy("tag").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("tag", "least")
    floored = asks.join(floors, "tag", "left").select("tag", "id", "v", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    more = _searched(index.candidates(rows).unionByName(index.others(floored)), index, k)
    square = F.aggregate(F.transform("v", lambda e: e.cast("double") * e.cast("double")), F.lit(0.0), lambda a, e: a + e)
    copies = asks.filter("copies > 1").select("tag", F.col("id").alias("query_id"), F.col("id").alias("vec_id"), square.alias("score"), F.explode(F.sequence(F.lit(1), F.least(F.col("copies") - 1, F.lit(k).cast("long")))).alias("_")).drop("_")
    order = Window.partitionBy("tag").orderBy(F.desc("score"), "vec_id")
    best = first.unionByName(more).unionByName(copies).withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    rest = best.join(asks.filter("copies > 1").select("tag", "copies"), "tag", "left")
    return rest.withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies").cast("int"), F.lit(1))))).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % EVERY == 0)


QUERIES = {"op4_ann": op4_ann}
