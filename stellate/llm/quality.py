"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics are of the text alone. Each class has a Gaussian whose covariance is shrunk towards
the pooled one and then towards a multiple of the identity; its Cholesky factor is computed
once. A document's log density difference (with the classes' log prior ratio) is half the
difference of squared Mahalanobis lengths less the difference of log determinants. A shift,
chosen on the training rows' histogram of differences for the best balanced accuracy, puts the
decision at score CUT; scores are a logistic of the shifted difference, monotone in it. The
histogram's bins are even in the inverse hyperbolic sine of the difference, so they cover any
difference, finer near zero.

All sums run over all training rows in the cluster; the driver gets moments and a histogram
of some thousands of bins at most, as their number grows with the logarithm of the differences.

Defined cases: null and empty texts have the statistics of an empty text and are scored; a
document with several labels counts once, with their majority (ties: 1); null labels and null
keys train nothing; equal texts have equal scores; with fewer than two classes of training
rows every score is the share of label 1 (0.5 without any), and ``accepted`` keeps all rows, as
nothing tells them apart; an empty table gives an empty result; other columns are ignored,
clashing names or not. ``accepted`` judges repeated rows alike and returns rows as they are.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches_of, per_text, table, written

FOLDS, CUT, TO_POOLED, TO_IDENTITY = 5, 0.3, 0.1, 0.02
#: Bins of the histogram for each unit of asinh(difference).
BINS = 200
NAMES = ("punct", "upper", "digit", "mark", "beyond", "repeat", "variety", "length", "spread", "words", "lines")
_UPPER, _DIGIT = slice(65, 91), slice(48, 58)
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
#: Marks that prose uses.
_PLAIN = [ord(c) for c in ".,;:'\"-?()"]


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text, in the order of NAMES."""
    data = text.encode()
    n = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(len(data), 1)
    words = text.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    share = lambda x, of: float(np.log((x + 0.5) / (of + 1.0)))
    marks, plain = int(n[_MARKS].sum()), int(n[_PLAIN].sum())
    return [
        share(marks, size), share(int(n[_UPPER].sum()), size), share(int(n[_DIGIT].sum()), size), share(marks - plain, size), share(int(n[128:].sum()), size),
        share(sum(map(eq, words, words[1:])), w), float(np.log((len(set(words)) + 1) / (w**0.8 + 1))), float(np.log1p(lengths.mean())), float(np.log1p(lengths.std())),
        float(np.log1p(w)), share(len(lines) - len(set(lines)), max(len(lines), 1)),
    ]


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    def make():
        return lambda t: (statistics(t),)

    return per_text(docs, [key], "x array<double>", make, text)


def fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % FOLDS


def fit(feats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> dict:
    """Class means, inverse Cholesky factors, log terms and shift from rows whose fold isn't 0."""
    marked = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    train = written(feats.filter(fold(key) != 0).join(marked, key).select("_y", "x"), "train")
    d = len(NAMES)
    sums = [F.count("*").alias("n"), *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)], *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]]
    rows = {r["_y"]: r for r in train.groupBy("_y").agg(*sums).collect()}  # a row for each class
    total = sum(r["n"] for r in rows.values())
    if len(rows) < 2:
        return {"share": next(iter(rows), 0.5)}
    mean, cov = {}, {}
    for y, r in rows.items():
        mean[y] = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        q = np.array([[r[f"q{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]) / r["n"]
        cov[y] = q - np.outer(mean[y], mean[y])
    pooled = sum(rows[y]["n"] * cov[y] for y in rows) / total
    model = {"mean": mean, "inverse": {}, "log": {}, "shift": 0.0}
    for y in rows:
        c = (1 - TO_POOLED) * cov[y] + TO_POOLED * pooled
        c = (1 - TO_IDENTITY) * c + (TO_IDENTITY * np.trace(pooled) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(c)
        model["inverse"][y] = np.linalg.inv(low)
        model["log"][y] = float(np.log(rows[y]["n"] / total) - np.log(np.diag(low)).sum())
    scaled = F.asinh("delta") * BINS
    bins = difference(train.select("_y", "x"), model, ["_y"]).select("_y", F.floor(scaled).alias("bin")).groupBy("_y", "bin").count().collect()
    low = min(r["bin"] for r in bins)
    held = np.zeros((2, max(r["bin"] for r in bins) - low + 1))
    for r in bins:
        held[r["_y"], r["bin"] - low] += r["count"]
    right = (held[1].sum() - np.r_[0, held[1].cumsum()]) / held[1].sum() + np.r_[0, held[0].cumsum()] / held[0].sum()
    best = np.flatnonzero(right == right.max())
    model["shift"] = float(np.sinh((low + (best[0] + best[-1]) / 2) / BINS))  # the middle of the best cuts
    return model


def _difference(x: np.ndarray, model: dict) -> np.ndarray:
    half = {y: ((x - model["mean"][y]) @ model["inverse"][y].T) for y in (0, 1)}
    return model["log"][1] - model["log"][0] - 0.5 * ((half[1] ** 2).sum(1) - (half[0] ** 2).sum(1))


def difference(feats: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Rows (keep..., delta): log density of class 1 less that of class 0."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            x = np.array(b.column(len(keep)).to_pylist(), np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(_difference(x, model))], names=[*keep, "delta"])

    narrow = feats.select(*keep, "x")
    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[: len(keep)], T.StructField("delta", T.DoubleType())]))


def score(feats: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """Rows (key, score)."""
    if "share" in model:
        return feats.select(key, F.lit(float(model["share"])).alias("score"))
    z = F.col("delta") - F.lit(model["shift"]) + F.lit(float(np.log(CUT / (1 - CUT))))
    return difference(feats, model, [key]).select(key, (1 / (1 + F.exp(-z))).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, score, predicted)."""
    feats = written(features(docs, key, text), "features")
    out = score(feats, fit(feats, labels, key), key)
    return out.select(key, F.coalesce(fold(key) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op9_quality": op9_quality}


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the classifier doesn't reject; texts aren't shuffled. Without rows of both labels nothing is rejected."""
    import pyarrow as pa

    model = fit(written(features(docs, key, text), "features"), labels, key)
    if "share" in model:
        return docs
    at = docs.columns.index(text)

    def run(batches):
        for b in batches_of(batches):
            x = np.array([statistics(t or "") for t in b.column(at).to_pylist()], np.float64).reshape(-1, len(NAMES))
            yield b.filter(pa.array(_difference(x, model) >= model["shift"]))

    return docs.mapInArrow(run, docs.schema)
