"""Reading input tables, and running a function over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.shared import drop_written, shared_dir, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(batches, rows: int = 256):
    """Arrow batches of few rows, so that texts become Python objects a few at a time. Spark bounds its own batches in bytes."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def slices_of(batches, text: int, rows: int = 1024, size: int = 1 << 22):
    """Arrow batches of few rows and few bytes of text (column number `text`), but one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(b.column(text)).fill_null(0)), dtype=np.int64)
        a = 0
        while a < b.num_rows:
            z = int(np.searchsorted(ends, size + (int(ends[a - 1]) if a else 0), "right"))
            z = min(max(z, a + 1), a + rows)
            yield b.slice(a, z - a)
            a = z


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df doesn't have (in any case), one for each stem."""
    held = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, i = stem, 0
        while name.lower() in held:
            name, i = f"{stem}_{i}", i + 1
        held.add(name.lower())
        out.append(name)
    return out


def per_text(df: DataFrame, keep: list[str], schema: str, make, text: str = "text", together: bool = False) -> DataFrame:
    """One output row per input row: the columns of `keep` as they are, then what make()(text) returns.

    make is called once in each Python worker task; it returns the function from a text (null
    as "") to a tuple that fits `schema`, or with `together` from a list of texts to a list of tuples. Batches stay small, so memory is bounded by one.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    added = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(schema)
    narrow = df.select(*keep, text)
    out = T.StructType([*narrow.select(*keep).schema.fields, *added.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in added.fields]
        fn = make()
        for b in slices_of(batches, len(keep)) if together else batches_of(batches):
            texts = [t or "" for t in b.column(len(keep)).to_pylist()]
            rows = fn(texts) if together else [fn(t) for t in texts]
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[f.name for f in out.fields])

    return narrow.mapInArrow(run, out)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs: it does so when the plans that made them are collected on the driver, which is else left to chance."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
