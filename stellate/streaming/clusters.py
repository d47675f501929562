"""Clustering of micro-batches: the original has no streams, so this is an extension.

Each batch is clustered on its own and appended with its number; labels are unique within
(batch, dataset). A batch that runs again after a failure replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from .. import api
from ..configs import ClusterConfig
from ..points import point_set


def cluster_stream(points: DataFrame, config: ClusterConfig, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes labelled points of every batch to path/batch=N."""

    def one(batch: DataFrame, n: int) -> None:
        out, _ = api.cluster(point_set(batch), config)
        out.points.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return points.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
