"""Document fingerprints by Order MinHash.

A text's words form k-mers of K_WORDS words; a run of more than LONGEST characters without
blanks gives one word for each of its places instead, the LONGEST characters from there. Equal
k-mers are numbered by occurrence, and each is hashed with its number. For each of SKETCHES
hash functions the TUPLE numbered k-mers of least hash are put in the order in which they stand
in the text, and the tuple is hashed. Reordering a text keeps its k-mers but changes tuples, so
likeness, the share of equal tuples, follows edit distance and not only common content.

``edited_neighbours`` compares each document with an edited text made of its first half and the
next document (descending key). Texts move once, in an exchange by ranges of (key, hash of the
text) that Spark samples, so no key or range of keys can fill a task. Each part streams its
documents in order; the last of a part meets the first of the next one that holds any in a
second step over two documents for each part.

Defined cases: null and empty texts have the fingerprint of no k-mers (zeros), alike to each
other; fewer than K_WORDS words form one k-mer; equal texts have equal fingerprints, as have
texts that differ in blanks alone; keys may be of any ordered type; equal keys are ordered by a
hash of the text; null keys come last; a lone document is its own next; an empty table gives an
empty result; other columns are ignored, clashing names or not. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches_of, table, written

K_WORDS, TUPLE, SKETCHES, LONGEST, SEED = 3, 2, 64, 16, 11


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo(dict):
    """A dictionary that fills itself through `make` and is emptied at `limit` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Sketcher:
    def __init__(self, k: int = K_WORDS, tuple_size: int = TUPLE, sketches: int = SKETCHES, seed: int = SEED):
        from xxhash import xxh64_intdigest

        self.k, self.l, self.m = k, tuple_size, sketches
        r = np.random.default_rng(seed)
        self.times = r.integers(0, 1 << 31, sketches, np.uint32) * np.uint32(2) + np.uint32(1)
        self.plus = r.integers(0, 1 << 32, sketches, np.uint32)
        self.steps = r.integers(0, 1 << 63, max(k, tuple_size), np.uint64) * np.uint64(2) + np.uint64(1)
        self.memo = Memo(lambda w: xxh64_intdigest(w.encode("utf-8", "surrogatepass"), seed), 300_000)

    def _hashes(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def _places(self, run: str) -> np.ndarray:
        """A hash for each place of a long run: of the LONGEST characters from there."""
        at = _mixed(np.frombuffer(run.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + self.steps[0])
        n = len(at) - LONGEST + 1
        out = np.zeros(n, np.uint64)
        for i in range(LONGEST):
            out = out * np.uint64(0x100000001B3) + at[i : i + n]
        return _mixed(out)

    def kmers(self, text: str) -> np.ndarray:
        """Occurrence-numbered k-mers, hashed, in the order of the text."""
        words = text.split()
        if not words:
            return np.empty(0, np.uint64)
        if max(map(len, words)) <= LONGEST:
            h = self._hashes(words)
        else:
            h = np.concatenate([x for long, ws in groupby(words, lambda w: len(w) > LONGEST) for x in (map(self._places, ws) if long else [self._hashes(list(ws))])])
        k = min(self.k, len(h))
        n = len(h) - k + 1
        g = np.zeros(n, np.uint64)
        for i in range(k):
            g = _mixed(g + h[i : i + n] * self.steps[i])
        order = np.argsort(g, kind="stable")
        s, at = g[order], np.arange(n)
        first = np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
        g[order] = _mixed(s + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return g

    def sketch(self, text: str) -> np.ndarray:
        """SKETCHES numbers of 16 bits."""
        g = self.kmers(text)
        out = np.zeros(self.m, np.uint64)
        if not len(g):
            return out.astype(np.uint16)
        low = (g >> np.uint64(32)).astype(np.uint32)
        wide = max(1, (1 << 16) // len(g))
        for a in range(0, self.m, wide):
            v = low * self.times[a : a + wide, None] + self.plus[a : a + wide, None]
            rows, found = np.arange(len(v)), []
            for _ in range(min(self.l, len(g))):
                i = v.argmin(1)
                found.append(i)
                v[rows, i] = np.iinfo(np.uint32).max
            t = np.zeros(len(v), np.uint64)
            for j, i in enumerate(np.sort(np.stack(found), axis=0)):
                t = _mixed(t + g[i] * self.steps[j])
            out[a : a + wide] = t
        return (out >> np.uint64(48)).astype(np.uint16)

    @staticmethod
    def shown(sketch: np.ndarray) -> str:
        return sketch.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint)."""
    from .tables import per_text

    def make():
        s = Sketcher()
        return lambda t: (s.shown(s.sketch(t)),)

    return per_text(docs, [key], "fingerprint string", make, text)


def _pair(s: Sketcher, text: str, own: np.ndarray, body: str, sk: np.ndarray) -> tuple:
    """What a row tells of a text and the next one, with sketches as bytes."""
    half = len(text) // 2
    edited = text[: len(text) - half] + body[:half]
    es = s.sketch(edited) if half else own
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), own.astype(">u2").tobytes(), es.astype(">u2").tobytes(), likeness(own, es), likeness(own, sk)


_FOUND = "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def edited_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("h"), body.alias("body"))
    order = [F.col("key").desc_nulls_last(), F.col("h").asc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "key", "body")
    kind = dealt.schema["key"].dataType
    found = T.StructType.fromDDL(_FOUND)
    out = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("key", kind), T.StructField("body", T.StringType()), *found.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        s = Sketcher()
        before = None  # (part, key, text, sketch) of a row whose next isn't here yet
        none = (None,) * len(found)
        for b in batches_of(batches):
            told = []
            for part, key_, body_ in zip(*(c.to_pylist() for c in b.columns), strict=True):
                sk = s.sketch(body_)
                if before is None:
                    told.append((part, "first", key_, body_, *none))
                else:
                    told.append((part, None, before[1], None, *_pair(s, before[2], before[3], body_, sk)))
                before = (part, key_, body_, sk)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), schema, strict=True)], schema=schema)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((before[0], "last", before[1], before[2], *none), schema, strict=True)], schema=schema)

    told = written(dealt.mapInArrow(run, out), "fingerprints")
    inner = told.filter("edge is null").select("key", *found.names)
    held = sorted(r["part"] for r in told.filter("edge = 'first'").select("part").collect())  # a number for each part
    turns = spark.createDataFrame([(p, held[(i + 1) % len(held)]) for i, p in enumerate(held)], "part int, after int")
    lasts = told.filter("edge = 'last'").select("part", "key", F.col("body").alias("own")).join(F.broadcast(turns), "part")
    firsts = told.filter("edge = 'first'").select(F.col("part").alias("after"), "body")

    def join_up(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(T.StructType([T.StructField("key", kind), *found.fields]))
        s = Sketcher()
        for b in batches_of(batches):
            told = [(key_, *_pair(s, own, s.sketch(own), body_, s.sketch(body_))) for key_, own, body_ in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), schema, strict=True)], schema=schema)

    outer = lasts.join(firsts, "after").select("key", "own", "body").mapInArrow(join_up, T.StructType([T.StructField("key", kind), *found.fields]))
    hexed = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return inner.unionByName(outer).withColumns(hexed).withColumnRenamed("key", key)


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


QUERIES = {"op8_order_minhash": op8_order_minhash}
