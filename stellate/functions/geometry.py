"""Geometry as column expressions: polygons given as literal rings, densities, widths."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Ring = list[tuple[float, float]]


def _edges(ring: Ring) -> Column:
    pairs = list(zip(ring, [*ring[1:], ring[0]], strict=True))
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("ax", "ay", "bx", "by"), (*a, *b), strict=True)]) for a, b in pairs])


def in_ring(x: Column, y: Column, ring: Ring) -> Column:
    """Even-odd membership: the parity of edges that a ray to the right crosses."""
    crossed = lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(_edges(ring), crossed)) % 2 == 1


def in_mask(x: Column, y: Column, cells: list[dict]) -> Column:
    out = F.lit(False)
    for c in cells:
        here = in_ring(x, y, c["outer"])
        for h in c["holes"]:
            here = here & ~in_ring(x, y, h)
        out = out | here
    return out


def ring_distance(x: Column, y: Column, rings: list[Ring]) -> Column:
    """Distance to the nearest segment of any ring."""

    def one(e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        length = dx * dx + dy * dy
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / F.nullif(length, F.lit(0.0)))), F.lit(0.0))
        return F.hypot(x - (e["ax"] + t * dx), y - (e["ay"] + t * dy))

    return F.array_min(F.transform(F.concat(*[_edges(r) for r in rings]), one))


def sigma_eff(use_3d: bool = False) -> Column:
    """Geometric mean of the localization uncertainties."""
    return F.cbrt(F.col("sigma_x") * F.col("sigma_y") * F.col("sigma_z")) if use_3d else F.sqrt(F.col("sigma_x") * F.col("sigma_y"))


def disk_density(k: int, r: Column) -> Column:
    """k / (pi r^2); null at r = 0."""
    return F.lit(float(k)) / (F.lit(pi) * F.nullif(r * r, F.lit(0.0)))


def unbiased_density(k: int, r: Column) -> Column:
    """(k - 1) / (pi r^2); infinite at r = 0."""
    return F.when(r == 0, F.lit(float("inf"))).otherwise(F.lit(float(k - 1)) / (F.lit(pi) * F.nullif(r * r, F.lit(0.0))))


def regime_of(x: Column, thresholds: list[float]) -> Column:
    """1 + how many thresholds x reaches."""
    return sum((F.when(x >= t, 1).otherwise(0) for t in sorted(thresholds)), F.lit(1))


def regime_costs(x: Column, gaussians: dict) -> Column:
    """Negative log weighted density of each regime."""
    from math import log

    total = sum(gaussians["weights"])
    return F.array(*[F.lit(0.5 * log(2 * pi * v) - log(w / total)) + (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v) for m, v, w in zip(gaussians["means"], gaussians["vars"], gaussians["weights"], strict=True)])


def threshold_costs(x: Column, thresholds: list[float]) -> Column:
    """0 for the own regime, 1e6 for others."""
    own = regime_of(x, thresholds)
    return F.array(*[F.when(own == j + 1, 0.0).otherwise(1e6) for j in range(len(thresholds) + 1)])


def circumradius(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Of a triangle; infinite for points on a line."""
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (ux * vy - uy * vx)
    u2, v2 = ux * ux + uy * uy, vx * vx + vy * vy
    return F.when(F.abs(d) < 1e-30, float("inf")).otherwise(F.hypot((vy * u2 - uy * v2) / F.nullif(d, F.lit(0.0)), (ux * v2 - vx * u2) / F.nullif(d, F.lit(0.0))))


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1) from a string key, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
