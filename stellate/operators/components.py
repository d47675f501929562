"""Connected components of an edge table, by alternating stars.

Each round turns every node's larger neighbours, then every node's smaller neighbours, to its
smallest neighbour. Rounds grow with the logarithm of the number of nodes. Smallest
neighbours come from partial aggregates and a join that adaptive execution can split, so a hub
isn't gathered in a task. Every round is written to the shared folder. Where asked, few edges are joined in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.near import joined
from .shared import drop_written, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    turned = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _at_once(e: DataFrame) -> DataFrame:
    """As components, for as many edges as one task may hold."""

    def run(batches):
        held = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
        if held:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, at = np.unique(np.r_[u, v], return_inverse=True)
            root = nodes[joined(np.arange(len(nodes)), at[: len(u)], at[len(u) :])]
            other = root != nodes
            yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(root[other])], names=["node", "root"])

    return e.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str, b: str, at_once: int = 0) -> DataFrame:
    """Rows (node, root): every node of an edge with two ends, but roots, and the smallest node of its component.

    Nodes without edges to others, and roots themselves, have no row. Up to `at_once` edges, of longs, are joined in one task.
    """
    # an edge given in both directions is one
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    if at_once and e.schema["u"].dataType == T.LongType() and e.limit(at_once + 1).count() <= at_once:
        out = written(_at_once(e), "stars")
        drop_written(e)
        return out
    said = None
    while True:
        new = written(_small_star(_large_star(e)), "stars")
        drop_written(e)
        # the same set of edges twice: every component is a star
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        e = new
        if now == said or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        said = now
