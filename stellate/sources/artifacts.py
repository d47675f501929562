"""Files of a classification: points, loops, diagnostics, parameters and a manifest; and parameters from TOML."""

from __future__ import annotations

import json
import math
import os
import subprocess
import tomllib
from datetime import UTC, datetime
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..backends.edges import EdgeInfo, edge_report
from ..configs import EdgeConfig, KdeValleyConfig, OuterPolygonConfig
from ..operators.tiles import many, pa_schema

#: Fixed values of the file formats.
VERSIONS = {"classified.tsv": 2, "polygon_loops.tsv": 2, "loop_diagnostics.csv": 2, "params.json": 3, "manifest.json": 1}


def plain(v: Any) -> Any:
    """v with non-finite numbers as null, for JSON; unknown types raise."""
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if v is None or isinstance(v, (str, bool, int)):
        return v
    raise TypeError(f"{type(v).__name__} has no JSON form here")


def _json(path: str, v: Any) -> None:
    with open(path, "w") as f:
        f.write(json.dumps(plain(v), sort_keys=True, indent=2) + "\n")


def rounded(v: float, digits: int) -> float:
    """v scaled, rounded half away from zero and scaled back, as in SQL; round() goes by v's own decimals, which differ for what is a half after scaling."""
    scaled = v * 10.0**digits
    if not math.isfinite(scaled):
        return v
    whole = math.trunc(scaled)
    # the difference is exact
    return math.copysign((abs(whole) + (abs(scaled - whole) >= 0.5)) / 10.0**digits, v)


def _number(v: float, digits: int) -> str:
    return "NaN" if math.isnan(v) else str(rounded(v, digits))


def provenance(root: str) -> tuple[str, bool]:
    """Commit and whether the tree is clean; empty and true without git."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True)
    try:
        head, status = run("rev-parse", "HEAD"), run("status", "--porcelain")
    except OSError:
        return "", True
    return (head.stdout.strip() if not head.returncode else ""), not status.stdout.strip()


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def numbered(points: DataFrame, order: str) -> DataFrame:
    """points with `_row`, their place from 1 in ascending order; partitions are in order too. Rows are moved once: their places follow from counts of ranges."""
    parts = 2 * many(points.sparkSession)
    cuts = sorted(set(points.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    points = points.withColumn("_part", part)
    before, total = {}, 0
    for r in sorted(points.groupBy("_part").count().collect()):
        before[r[0]], total = total, total + r[1]
    schema = T.StructType([*points.drop("_part").schema.fields, T.StructField("_row", T.LongType())])
    arrow = pa_schema(schema)

    def run(batches):
        seen = dict(before)
        for b in batches:
            at = b["_part"].to_numpy()
            row = np.empty(len(at), np.int64)
            # parts stand together
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
            for i, j in zip(first, [*first[1:], len(at)], strict=True):
                k = int(at[i])
                row[i:j] = np.arange(seen[k] + 1, seen[k] + 1 + j - i)
                seen[k] += int(j - i)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in arrow.names[:-1]), pa.array(row)], schema=arrow)

    return points.repartitionByRange(parts, "_part").sortWithinPartitions("_part", F.asc_nulls_first(order)).mapInArrow(run, schema)


def classified_head(n: int, condition: str, cell: str) -> list[str]:
    names = ("emitter_id", "x_um", "y_um", "class", "inside_outer", "in_cell", "dist_to_outer_um")
    return [f"# schema_version: {VERSIONS['classified.tsv']}", f"# condition: {condition}", f"# cell: {cell}", f"# n_emitters: {n}", "# coord_units: um", "\t".join(names)]


def classified_lines(info: EdgeInfo) -> DataFrame:
    """Rows (number, line): lines of classified.tsv after its head, points numbered from 1, unless they have a `_row`; partitions are in order."""

    def run(batches):
        for b in batches:
            columns = (b[c].to_pylist() for c in ("_row", "x", "y", "class", "inside_outer", "dist_to_outer_um"))
            lines = [f"{i}\t{rounded(x, 6)}\t{rounded(y, 6)}\t{kind}\t{int(held)}\t{int(kind != 'outside')}\t{_number(d, 6)}" for i, x, y, kind, held, d in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b["_row"], pa.array(lines, pa.string())], names=["number", "line"])

    points, columns = info.points, ["x", "y", "class", "inside_outer", "dist_to_outer_um"]
    if "_row" not in points.columns:
        points = numbered(points.select("emitter_idx", *columns), "emitter_idx")
    return points.select("_row", *columns).mapInArrow(run, "number long, line string")


def write_edge_artifacts(leaf: str, info: EdgeInfo, condition: str, cell: str, input_meta: dict[str, Any] | None = None, repo_root: str = ".") -> None:
    """Write all files into `leaf`. Points are streamed to the one text file partition by partition."""
    os.makedirs(leaf, exist_ok=True)
    at = lambda name: os.path.join(leaf, name)
    with open(at("classified.tsv"), "w") as f:
        f.writelines(f"{line}\n" for line in classified_head(info.points.count(), condition, cell))
        f.writelines(f"{r[0]}\n" for r in classified_lines(info).select("line").toLocalIterator())
    with open(at("polygon_loops.tsv"), "w") as f:
        f.write(f"# schema_version: {VERSIONS['polygon_loops.tsv']}\n# alpha_nm: {round(info.config.alpha_nm)}\n# loop_count: {len(info.loops)}\nloop_id\tvertex_id\tx_um\ty_um\n")
        for i, loop in enumerate(info.loops, 1):
            f.writelines(f"{i}\t{j}\t{rounded(x, 6)}\t{rounded(y, 6)}\n" for j, (x, y) in enumerate(loop, 1))
    digits = {"area_um2": 4, "frac_in_fov": 4, "frac_dense": 4, "median_rhoK": 2}
    columns = ("loop_id", "vertex_count", "area_um2", "n_emitters_inside", "frac_in_fov", "frac_dense", "median_rhoK", "used_in_outer", "heuristic_type")
    with open(at("loop_diagnostics.csv"), "w") as f:
        f.write(f"# schema_version: {VERSIONS['loop_diagnostics.csv']}\n{','.join(columns)}\n")
        for d in info.loop_diagnostics:
            f.write(",".join(_number(d[c], digits[c]) if c in digits else str(d[c]).lower() if isinstance(d[c], bool) else str(d[c]) for c in columns) + "\n")
    sha, clean = provenance(repo_root)
    _json(at("params.json"), {"schema_version": VERSIONS["params.json"], "git_sha": sha, "git_status_clean": clean, "timestamp_utc": now(), "input": input_meta or {"smld_path": None, "smld_mtime_utc": None, "smld_size_bytes": None}, "n_emitters": info.points.count(), "fov_um": list(info.fov), "truncated_sides": info.sides, "params": info.config.to_dict(), "runtime_s": info.runtime_s})
    names = {"classified_tsv": "classified.tsv", "polygon_loops_tsv": "polygon_loops.tsv", "loop_diagnostics_csv": "loop_diagnostics.csv", "params_json": "params.json"}
    out_dir = os.path.dirname(os.path.dirname(leaf))
    _json(at("manifest.json"), {"schema_version": VERSIONS["manifest.json"], "condition": condition, "cell": cell, "out_dir": os.path.abspath(out_dir), "leaf_dir": os.path.abspath(leaf), "timestamp_utc": now(), "artifacts": {k: {"path": v, "schema_version": VERSIONS[v]} for k, v in names.items()}})


def write_edge_report(info: EdgeInfo, output_dir: str, condition: str, cell: str, metadata: dict[str, Any] | None = None) -> dict[str, Any]:
    """Artifacts under output_dir/condition/cell, with metadata that isn't about edges, and the report."""
    kept = {k: v for k, v in (metadata or {}).items() if not k.startswith("edge_")}
    write_edge_artifacts(os.path.join(output_dir, condition, cell), info, condition, cell, kept or None)
    return edge_report(info)


def config_from_toml(path: str) -> EdgeConfig:
    """`method` names the configuration; other keys are its parameters."""
    with open(path, "rb") as f:
        given = tomllib.load(f)
    kind = {"outer_polygon": OuterPolygonConfig, "kde_valley": KdeValleyConfig}[given.pop("method", "outer_polygon")]
    if "k_list" in given:
        given["k_list"] = tuple(given["k_list"])
    return kind(**given)
