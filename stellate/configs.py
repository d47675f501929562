"""Configurations of all verbs; lengths in nm become µm where they are used."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite
from typing import Any


def _need(ok: bool, said: str) -> None:
    if not ok:
        raise ValueError(said)


@dataclass(frozen=True, kw_only=True)
class ClusterConfig:
    min_points: int = 5
    use_3d: bool = False
    per_dataset: bool = True
    remove_unclustered: bool = False
    algorithm = ""

    def validate(self) -> None:
        _need(self.min_points >= 1, f"min_points must be >= 1; got {self.min_points}")

    @property
    def keys(self) -> list[str]:
        return ["dataset"] if self.per_dataset else []


@dataclass(frozen=True, kw_only=True)
class DBSCANConfig(ClusterConfig):
    eps_nm: float
    algorithm = "dbscan"

    def validate(self) -> None:
        super().validate()
        _need(self.eps_nm > 0, f"eps_nm must be > 0; got {self.eps_nm}")


@dataclass(frozen=True, kw_only=True)
class PrecisionDBSCANConfig(ClusterConfig):
    nsigma: float
    algorithm = "precision_dbscan"

    def validate(self) -> None:
        super().validate()
        _need(self.nsigma > 0, f"nsigma must be > 0; got {self.nsigma}")


@dataclass(frozen=True, kw_only=True)
class HDBSCANConfig(ClusterConfig):
    min_cluster_size: int | None = None
    knn_graph_k: int = 30
    cluster_selection_method: str = "eom"
    allow_single_cluster: bool = False
    halo_trim_frac: float = 0.10
    algorithm = "hdbscan"

    def validate(self) -> None:
        super().validate()
        _need((self.min_cluster_size or max(self.min_points, 2)) >= 2, "min_cluster_size must be >= 2")
        _need(self.knn_graph_k >= 1, "knn_graph_k must be >= 1")
        _need(self.cluster_selection_method in ("eom", "leaf"), "cluster_selection_method must be eom or leaf")
        _need(0 <= self.halo_trim_frac < 1, "halo_trim_frac must be in [0, 1)")


@dataclass(frozen=True, kw_only=True)
class HierarchicalConfig(ClusterConfig):
    cut_threshold: float | None = None
    n_clusters: int | None = None
    linkage: str = "ward"
    algorithm = "hierarchical"

    def validate(self) -> None:
        super().validate()
        _need((self.cut_threshold is None) != (self.n_clusters is None), "give exactly one of cut_threshold and n_clusters")
        _need(self.cut_threshold is None or self.cut_threshold > 0, "cut_threshold must be > 0")
        _need(self.n_clusters is None or self.n_clusters >= 1, "n_clusters must be >= 1")
        _need(self.linkage in ("single", "complete", "average", "ward"), f"unknown linkage {self.linkage}")


@dataclass(frozen=True, kw_only=True)
class VoronoiConfig(ClusterConfig):
    density_factor: float = 2.0
    algorithm = "voronoi"

    def validate(self) -> None:
        super().validate()
        _need(self.density_factor > 0, "density_factor must be > 0")
        if self.use_3d:
            raise ValueError("voronoi clustering is 2D only")


@dataclass(frozen=True, kw_only=True)
class MRFDensityConfig(ClusterConfig):
    n_regimes: int = 2
    regime_thresholds: tuple[float, ...] | None = None
    regime_gaussians: dict[str, list[float]] | None = None
    density_estimator: str = "voronoi"
    density_k: int = 20
    smoothness_lambda: float | None = None
    graph_kind: str = "delaunay"
    graph_k: int = 8
    inference: str = "icm"
    icm_iters: int = 50
    algorithm = "mrf_density"

    def validate(self) -> None:
        super().validate()
        _need(self.n_regimes >= 2, "n_regimes must be >= 2")
        _need(self.density_estimator in ("voronoi", "knn"), f"unknown density_estimator {self.density_estimator}")
        _need(self.graph_kind in ("delaunay", "knn"), f"unknown graph_kind {self.graph_kind}")
        _need(self.inference == "icm", f"unknown inference {self.inference}")
        _need(self.density_k >= 1 and self.graph_k >= 1 and self.icm_iters >= 1, "density_k, graph_k and icm_iters must be >= 1")
        _need(self.smoothness_lambda is None or self.smoothness_lambda >= 0, "smoothness_lambda must be >= 0")
        _need(self.regime_thresholds is None or self.regime_gaussians is None, "give thresholds or gaussians, not both")
        if self.regime_thresholds is not None:
            t = list(self.regime_thresholds)
            _need(len(t) == self.n_regimes - 1 and t == sorted(t), "regime_thresholds must be n_regimes - 1 ascending numbers")
        if self.regime_gaussians is not None:
            g = self.regime_gaussians
            _need(all(len(g[c]) == self.n_regimes for c in ("means", "vars", "weights")), "regime_gaussians need n_regimes entries each")
            _need(all(isfinite(v) for c in ("means", "vars", "weights") for v in g[c]), "regime_gaussians must be finite")
            _need(all(a < b for a, b in zip(g["means"], g["means"][1:], strict=False)), "means must ascend")
            _need(min(g["vars"]) > 0 and min(g["weights"]) > 0, "vars and weights must be > 0")
        if self.use_3d:
            raise ValueError("mrf_density clustering is 2D only")


@dataclass(frozen=True, kw_only=True)
class PointHysteresisConfig(ClusterConfig):
    graph_k: int = 12
    min_points: int = 100
    per_dataset: bool = False
    algorithm = "point_hysteresis"

    def validate(self) -> None:
        super().validate()
        _need(self.graph_k >= 1, "graph_k must be >= 1")


@dataclass(frozen=True, kw_only=True)
class StatisticsConfig:
    use_3d: bool = False
    per_dataset: bool = True
    statistic_name = ""

    def validate(self) -> None: ...

    @property
    def keys(self) -> list[str]:
        return ["dataset"] if self.per_dataset else []


@dataclass(frozen=True, kw_only=True)
class HopkinsConfig(StatisticsConfig):
    n_samples: int = 20
    random_repeats: int = 1
    seed: int | None = None
    region: Any = None
    statistic_name = "hopkins"

    def validate(self) -> None:
        _need(self.n_samples >= 1 and self.random_repeats >= 1, "n_samples and random_repeats must be >= 1")
        _need(not (self.use_3d and self.region is not None), "a region is 2D only")


@dataclass(frozen=True, kw_only=True)
class VoronoiDensityConfig(StatisticsConfig):
    statistic_name = "median_density"

    def validate(self) -> None:
        _need(not self.use_3d, "voronoi density is 2D only")


@dataclass(frozen=True, kw_only=True)
class LocalContrastFeature(StatisticsConfig):
    density_k: int = 200
    background_k: int = 2000
    per_dataset: bool = False
    statistic_name = "median_local_contrast"

    def validate(self) -> None:
        _need(self.density_k >= 1, "density_k must be >= 1")
        _need(self.background_k > self.density_k, "background_k must exceed density_k")


@dataclass(frozen=True, kw_only=True)
class EdgeConfig:
    alpha_nm: float = 300.0
    membrane_nm: float = 100.0
    fov_trunc_tol_nm: float = 150.0
    core_frac: float = 0.10
    core_radius_nm: float = 600.0
    alpha_adaptive: bool = True
    alpha_knn: int = 5
    alpha_scale: float = 2.0
    keep_internal: bool = False
    min_cell_frac: float = 1 / 3
    min_hole_frac: float = 0.0
    method_name = ""

    def validate(self) -> None:
        _need(self.alpha_nm > 0 and self.core_radius_nm > 0 and self.alpha_scale > 0, "alpha_nm, core_radius_nm and alpha_scale must be > 0")
        _need(self.membrane_nm >= 0 and self.fov_trunc_tol_nm >= 0, "membrane_nm and fov_trunc_tol_nm must be >= 0")
        _need(0 <= self.core_frac <= 1, "core_frac must be in [0, 1]")
        _need(self.alpha_knn >= 1, "alpha_knn must be >= 1")
        _need(0 <= self.min_cell_frac < 1 and 0 <= self.min_hole_frac < 1, "min_cell_frac and min_hole_frac must be in [0, 1)")

    def to_dict(self) -> dict[str, Any]:
        """Parameters under their upper-case names on disk."""
        shared = ("alpha_nm", "membrane_nm", "fov_trunc_tol_nm", "core_frac", "core_radius_nm", "alpha_adaptive", "alpha_knn", "alpha_scale", "keep_internal", "min_cell_frac", "min_hole_frac")
        return {"METHOD": self.method_name} | {c.upper(): getattr(self, c) for c in shared}


@dataclass(frozen=True, kw_only=True)
class OuterPolygonConfig(EdgeConfig):
    k_list: tuple[int, ...] = (16, 128)
    rho_k_thresh: float = 200.0
    method_name = "outer_polygon"

    def validate(self) -> None:
        super().validate()
        _need(len(self.k_list) > 0 and min(self.k_list) > 0, "k_list must hold numbers > 0")
        _need(self.rho_k_thresh >= 0, "rho_k_thresh must be >= 0")

    def to_dict(self) -> dict[str, Any]:
        return super().to_dict() | {"K_LIST": list(self.k_list), "RHO_K_THRESH": self.rho_k_thresh}


@dataclass(frozen=True, kw_only=True)
class KdeValleyConfig(EdgeConfig):
    alpha_nm: float = 600.0
    sigma_nm: float = 150.0
    rmax_sigma: float = 3.0
    valley_nbins: int = 140
    valley_floorfrac: float = 0.05
    valley_smooth: int = 4
    footprint_bin_um: float = 0.2
    footprint_closing_px: int = 3
    method_name = "kde_valley"

    def validate(self) -> None:
        super().validate()
        _need(self.sigma_nm > 0 and self.rmax_sigma > 0 and self.footprint_bin_um > 0, "sigma_nm, rmax_sigma and footprint_bin_um must be > 0")
        _need(self.valley_nbins > 1 and self.valley_smooth >= 0 and self.footprint_closing_px >= 0, "bad valley or footprint size")
        _need(0 <= self.valley_floorfrac <= 1, "valley_floorfrac must be in [0, 1]")

    def to_dict(self) -> dict[str, Any]:
        own = {"sigma_nm": "KDE_SIGMA_NM", "rmax_sigma": "KDE_RMAX_SIGMA", "valley_nbins": "KDE_VALLEY_NBINS", "valley_floorfrac": "KDE_VALLEY_FLOORFRAC", "valley_smooth": "KDE_VALLEY_SMOOTH", "footprint_bin_um": "FOOTPRINT_BIN_UM", "footprint_closing_px": "FOOTPRINT_CLOSING_PX"}
        return super().to_dict() | {v: getattr(self, k) for k, v in own.items()}
