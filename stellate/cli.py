"""python -m stellate.cli --points TABLE.parquet --condition C --cell N --out DIR --fov X0 X1 Y0 Y1 [--params P.toml]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import classify_emitters
from .configs import OuterPolygonConfig
from .points import point_set
from .sources.artifacts import config_from_toml, write_edge_report


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Classify the points of a table and write the artifacts.")
    for name in ("points", "condition", "cell", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--fov", nargs=4, type=float, required=True)
    p.add_argument("--params")
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    ps = point_set(spark.read.parquet(a.points), tuple(a.fov))
    _, info = classify_emitters(ps, config_from_toml(a.params) if a.params else OuterPolygonConfig())
    report = write_edge_report(info, a.out, a.condition, a.cell, {"smld_path": a.points})
    print({k: v for k, v in report.items() if k != "info"})


if __name__ == "__main__":
    main()
