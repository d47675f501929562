"""Point sets: a DataFrame of localizations with what belongs to the whole cloud.

Columns: emitter_idx (order and key), dataset, x, y, z (µm; z null in 2D), sigma_x, sigma_y,
sigma_z, frame and id ride along where given. Missing numbers are null inside; NaN appears at
the edge of the API only.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPTIONAL = {"dataset": "int", "frame": "int", "z": "double", "sigma_x": "double", "sigma_y": "double", "sigma_z": "double", "id": "int"}
DEFAULTS = {"dataset": 1, "frame": 1, "id": 0}


@dataclass(frozen=True)
class PointSet:
    points: DataFrame
    fov: tuple[float, float, float, float] | None = None
    n_frames: int = 1
    metadata: dict[str, Any] = field(default_factory=dict)

    def with_points(self, points: DataFrame, **metadata: Any) -> PointSet:
        return replace(self, points=points, metadata={**self.metadata, **metadata})


def point_set(df: DataFrame, fov: tuple[float, float, float, float] | None = None, **metadata: Any) -> PointSet:
    """A point set from any table with emitter_idx, x and y; optional columns get defaults."""
    missing = {"emitter_idx", "x", "y"} - set(df.columns)
    if missing:
        raise ValueError(f"points need columns {sorted(missing)}")
    df = df.withColumns({"emitter_idx": F.col("emitter_idx").cast("long"), "x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    df = df.withColumns({c: (F.col(c) if c in df.columns else F.lit(DEFAULTS.get(c))).cast(t) for c, t in OPTIONAL.items()})
    return PointSet(df, fov, metadata=metadata)


def from_vectors(spark: SparkSession, x, y, z=None, dataset=None, sigma=None, fov=None) -> PointSet:
    """A point set from driver-side vectors; emitter_idx counts from 1."""
    n = len(x)
    if len(y) != n or (z is not None and len(z) != n):
        raise ValueError("coordinate vectors must have equal length")
    rows = [(i + 1, float(x[i]), float(y[i]), None if z is None else float(z[i]), 1 if dataset is None else int(dataset[i]), None if sigma is None else float(sigma[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "emitter_idx long, x double, y double, z double, dataset int, s double")
    return point_set(df.withColumns({c: F.col("s") for c in ("sigma_x", "sigma_y", "sigma_z")}).drop("s"), fov)


def axes(points: DataFrame, use_3d: bool) -> list[str]:
    """Coordinate columns; asking for 3D needs a z column with values."""
    if use_3d and ("z" not in points.columns or points.filter("z is null").limit(1).count()):
        raise RuntimeError("use_3d needs z coordinates on every point")
    return ["x", "y", "z"] if use_3d else ["x", "y"]


def ranked_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with the rank of a categorical column among its distinct values."""
    ranks = df.select(column).distinct().withColumn(name, F.row_number().over(Window.orderBy(column)).cast("int"))
    return df.join(F.broadcast(ranks) if ranks.limit(10_001).count() <= 10_000 else ranks, column)


def _sigmas(key: str) -> dict:
    s = (F.lit(0.01) * (1 + F.col(key) % 5)).cast("double")
    return {"sigma_x": s, "sigma_y": s}


def events_cloud(spark: SparkSession, sf_dir: str) -> PointSet:
    """events: days since 2024-01-01 against value/100, a dataset for each event type."""
    e = ranked_values(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "value", "event_type"), "event_type", "dataset")
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(86400000000.0)
    return point_set(e.select(F.col("event_id").alias("emitter_idx"), x.alias("x"), (F.col("value") / 100.0).alias("y"), "dataset").withColumns(_sigmas("emitter_idx")), fov=(0.0, 30.0, 0.0, 6.0))


def embeddings_cloud(spark: SparkSession, sf_dir: str) -> PointSet:
    """embeddings: first three components, a dataset for each label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda i: F.col("embedding")[i].cast("double")
    return point_set(e.select(F.col("vec_id").alias("emitter_idx"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("label") + 1).alias("dataset")).withColumns(_sigmas("emitter_idx")), fov=(-1.0, 1.0, -1.0, 1.0))


def orders_cloud(spark: SparkSession, sf_dir: str) -> PointSet:
    """orders: hundreds of days since 1970 against price in 100,000, a dataset for each priority."""
    o = ranked_values(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority"), "o_orderpriority", "dataset")
    day = F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86400000000.0)
    return point_set(o.select(F.col("o_orderkey").alias("emitter_idx"), (day / 100.0).alias("x"), (F.col("o_totalprice") / 100000.0).alias("y"), "dataset"), fov=(0.0, 120.0, 0.0, 6.0))


#: The clouds as SQL, for holding results against another engine.
CLOUD_SQL = {
    "events": """SELECT event_id::BIGINT AS emitter_idx, (epoch_us(ts) - 1704067200000000) / 86400000000.0::DOUBLE AS x, value / 100.0::DOUBLE AS y, dense_rank() OVER (ORDER BY event_type)::INTEGER AS dataset, 0.01::DOUBLE * (1 + event_id % 5) AS sigma FROM events""",
    "embeddings": """SELECT vec_id::BIGINT AS emitter_idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, (label + 1)::INTEGER AS dataset, 0.01::DOUBLE * (1 + vec_id % 5) AS sigma FROM embeddings""",
    "orders": """SELECT o_orderkey::BIGINT AS emitter_idx, (epoch_us(o_orderdate) / 86400000000.0::DOUBLE) / 100.0::DOUBLE AS x, o_totalprice / 100000.0::DOUBLE AS y, dense_rank() OVER (ORDER BY o_orderpriority)::INTEGER AS dataset FROM orders""",
}
