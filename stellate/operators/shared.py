"""Tables written to the folder that all executors share, to cut lineage so that lost executors cost little."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that a join may broadcast, after a count.
FEW = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (only where unset, and all runs on one machine) a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="stellate-ckpt-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing lazy reads it any more."""
    path = getattr(df, "_written_path", None)
    if path:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of finished jobs, as it does when the plans that made them are collected on the driver."""
    told = getattr(getattr(spark.sparkContext._gateway, "_gateway_client", None), "finalizer_deque", None)
    # the driver's JVM hears of dropped plans from a thread that looks once a second, and frees what they held in a second collection
    for _ in range(2):
        gc.collect()
        for _ in range(30):
            if not told:
                break
            time.sleep(0.05)
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def few(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
