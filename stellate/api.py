"""The three verbs, dispatched on the type of configuration. New ones register with ``.register``."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import singledispatch
from typing import Any

from pyspark.sql import DataFrame

from .configs import ClusterConfig, EdgeConfig, StatisticsConfig
from .operators import labels as L
from .points import PointSet


@dataclass(frozen=True)
class ClusterInfo:
    """A run's summary, as a lazy one-row table and its algorithm."""

    summary: DataFrame
    algorithm: str
    elapsed_s: float

    def row(self) -> dict[str, Any]:
        return self.summary.first().asDict() | {"elapsed_s": self.elapsed_s}

    def __repr__(self) -> str:
        return f"ClusterInfo({self.algorithm}, {self.elapsed_s:.3f} s)"


@dataclass(frozen=True)
class StatisticsInfo:
    """A statistic: its value (NaN if none), by-group values and where asked per-point columns."""

    statistic_name: str
    value: float
    groups: DataFrame
    points: DataFrame | None = None
    elapsed_s: float = 0.0

    def __repr__(self) -> str:
        return f"StatisticsInfo({self.statistic_name}={self.value:.6g})"


@singledispatch
def label_points(config: Any, ps: PointSet, **masks: Any) -> tuple[DataFrame, dict[str, Any]]:
    """(labels: keys..., emitter_idx, label; metadata) for a configuration."""
    raise RuntimeError(f"cluster has no method for {type(config).__name__}")


@singledispatch
def measure_points(config: Any, ps: PointSet) -> StatisticsInfo:
    raise RuntimeError(f"cluster_statistics has no method for {type(config).__name__}")


@singledispatch
def classify_points(config: Any, ps: PointSet):
    raise RuntimeError(f"classify_emitters has no method for {type(config).__name__}")


def cluster(ps: PointSet, config: ClusterConfig, **masks: Any) -> tuple[PointSet, ClusterInfo]:
    """The points with new column id (0 is noise, 1.. within each group), and a summary of all points before removal."""
    from . import backends  # noqa: F401
    from .backends import labeling  # noqa: F401

    began = time.time()
    if isinstance(config, ClusterConfig):
        config.validate()
    labels, metadata = label_points(config, ps, **masks)
    all_points = L.applied(ps.points, labels)
    info = ClusterInfo(L.cluster_info(all_points, config.keys, config.algorithm, metadata.get("cluster_counts")), config.algorithm, time.time() - began)
    return ps.with_points(all_points.filter("id <> 0") if config.remove_unclustered else all_points, **metadata), info


def cluster_statistics(ps: PointSet, config: StatisticsConfig) -> tuple[PointSet, StatisticsInfo]:
    """The points unchanged, and the statistic."""
    from .backends import statistics  # noqa: F401

    if isinstance(config, StatisticsConfig):
        config.validate()
    return ps, measure_points(config, ps)


def classify_emitters(ps: PointSet, config: EdgeConfig):
    """The points with class, inside_outer and dist_to_outer_um, and what the classification found."""
    from .backends import edges  # noqa: F401

    if isinstance(config, EdgeConfig):
        config.validate()
    return classify_points(config, ps)
