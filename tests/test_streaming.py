import numpy as np

from stellate import configs as C
from stellate.streaming.clusters import cluster_stream


def test_batches_are_clustered(spark, tmp_path):
    r = np.random.default_rng(5)
    for b in range(2):
        x = np.r_[r.normal((1 + b, 1), 0.01, (10, 2)), [[9, 9]]]
        spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(x)], "emitter_idx long, x double, y double").coalesce(1).write.parquet(str(tmp_path / "in" / str(b)))
    stream = spark.readStream.schema("emitter_idx long, x double, y double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = cluster_stream(stream, C.DBSCANConfig(eps_nm=200), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    assert q.awaitTermination(120) and q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["batch"], r["id"], r["count"]) for r in out.groupBy("batch", "id").count().collect()) == [(0, 0, 1), (0, 1, 10), (1, 0, 1), (1, 1, 10)]
