"""Near duplicates by SimHash fingerprints, found through Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of 23, 23 and 18 bits. The perfect binary Golay
code sends each 23-bit word to the one codeword within 3 bits; the codewords of a word and of
its one-bit changes are its fuzzy keys (one or six), and words within 2 bits of each other
share one, that of the word between them. If two fingerprints differ in 2 bits or fewer, then
for some segment i they agree in i and differ in at most one bit of segment i + 1 (cyclic):
errors (2,0,0), (0,2,0) and (0,0,2) leave i = 2, 3 and 1, and of (1,1,0), (0,1,1) and (1,0,1)
the error-free segment. So the joined keys (i, segment i, fuzzy key of segment i + 1) find
every link; candidates that meet in a key are verified.

Documents of equal fingerprint are one node from the start, so copies cost nothing further.
Within a key, small groups are compared and larger ones linked through the words between
members (each member and its 64 one-bit changes), so work is linear in the group; what leaves
a group is a star for each of its components, never its pairs. Keys are counted first, with
partial aggregates; the members of one that more than HOT share aren't dealt to a task, but go
to an exchange by the words between instead.

Defined cases: null and empty texts have fingerprint zero, linked like any other; equal texts
have equal fingerprints; a null key is never the smallest of a component unless alone (then
the component is null); an empty table gives an empty result; other columns are ignored,
clashing names or not. Texts are hashed whole.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .tables import fresh, per_text, table, written

SEED, WORDS, DISTANCE = 42, 3, 2
#: The shared segment sizes; the last is padded to a 23-bit word with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0xC75
SMALL, HOT = 24, 20_000


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    w = text.encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([h(joined, seed)], np.uint64)
    ends = list(accumulate(map(len, w), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)), np.uint64, len(w) - words + 1)


_BITS = np.array([[b >> i & 1 for i in range(8)] for b in range(256)], np.int64)


def fingerprint(text: str) -> int:
    """As a signed 64-bit integer."""
    h = shingle_hashes(text)
    if not len(h):
        return 0
    held = np.bincount((h.astype("<u8").view(np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.uint16) * np.uint16(256)).ravel(), minlength=2048).reshape(8, 256)
    ones = (held @ _BITS).ravel()  # bit 8 k + i is bit i of byte k
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def _golay_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of a word's bytes, and the error of each syndrome."""

    def syndrome(x: int) -> int:
        for b in range(22, 10, -1):
            if x >> b & 1:
                x ^= GOLAY << (b - 11)
        return x

    of_bit = [syndrome(1 << b) for b in range(23)]

    def xor(bits: list[int]) -> int:
        out = 0
        for b in bits:
            out ^= of_bit[b]
        return out

    by_byte = [np.array([xor([8 * k + i for i in range(8) if v >> i & 1 and 8 * k + i < 23]) for v in range(256)], np.int64) for k in range(3)]
    error = np.zeros(2048, np.int64)
    for a in range(23):
        error[of_bit[a]] = 1 << a
        for b in range(a):
            error[of_bit[a] ^ of_bit[b]] = 1 << a | 1 << b
            for c in range(b):
                error[of_bit[a] ^ of_bit[b] ^ of_bit[c]] = 1 << a | 1 << b | 1 << c
    return by_byte, error


_SYNDROME, _ERROR = _golay_tables()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword within 3 bits of each 23-bit word."""
    s = _SYNDROME[0][words & 255] ^ _SYNDROME[1][words >> 8 & 255] ^ _SYNDROME[2][words >> 16]
    return (words ^ _ERROR[s]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, place of the fingerprint): distinct keys of each fingerprint."""
    u = fps.astype(np.uint64)
    segs = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, rows = [], []
    for i, exact in enumerate(segs):
        j = (i + 1) % 3
        flips = np.array([0, *(1 << b for b in range(SEGMENTS[j][1]))], np.int64)
        code = np.sort(codeword_index(segs[j][:, None] ^ flips), axis=1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        row, col = np.nonzero(new)
        keys.append((np.int64(i) << 36) | (exact[row] << 12) | code[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


_FLIPS = np.array([0, *(1 << b for b in range(64))], np.uint64)


def _star(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, smallest member) of each component at DISTANCE or nearer among distinct fingerprints."""
    n = len(members)
    u = members.view(np.uint64)
    if n <= SMALL:
        a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= DISTANCE, 1))
    else:
        between = (u[:, None] ^ _FLIPS).ravel()
        who = np.repeat(np.arange(n), len(_FLIPS))
        order = np.argsort(between, kind="stable")
        same = between[order[1:]] == between[order[:-1]]
        a, b = who[order[:-1]][same], who[order[1:]][same]
    root = np.arange(n)
    while len(a):  # smallest place reachable, by halving jumps
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return members[at], members[root[at]]


def links(fps: DataFrame) -> DataFrame:
    """Rows (a, b): stars that join all fingerprints that link, from a table of distinct ones in column fp."""
    import pyarrow as pa

    def keyed(batches):
        for b in batches:
            f = b.column(0).to_numpy(zero_copy_only=False)
            k, row = fuzzy_keys(f)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f[row])], names=["key", "fp"])

    def found(batches):
        key, held, n = None, [], 0
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def done():
            if n > 1:
                out.append(_star(np.sort(np.concatenate(held))))

        def rows():
            for a, b in out:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            out.clear()

        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if not len(k):
                continue
            edges = np.flatnonzero(np.diff(k)) + 1
            starts, ends = np.r_[0, edges], np.r_[edges, len(k)]
            size = ends - starts
            for i in np.unique(np.r_[0, np.flatnonzero(size > 1), len(starts) - 1]):  # the first and last may go on
                s, e = starts[i], ends[i]
                if k[s] != key:
                    done()
                    key, held, n = k[s], [], 0
                n += e - s
                held.append(f[s:e])
            yield from rows()
        done()
        yield from rows()

    conf = fps.sparkSession.conf
    n = int(conf.get("spark.sql.shuffle.partitions", "200"))
    keys = fps.select("fp").mapInArrow(keyed, "key long, fp long")
    hot = written(keys.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "hot")
    any_hot = bool(hot.limit(1).count())
    cold = (keys.join(hot, "key", "left_anti") if any_hot else keys).select("key", "fp")
    met = written(cold.repartition(n, "key").sortWithinPartitions("key").mapInArrow(found, "a long, b long"), "links").distinct()
    if not any_hot:
        return met
    far = keys.join(hot, "key", "left_semi").select(F.col("fp").alias("a")).distinct()
    masks = F.array(*[F.lit(int(x)).cast("long") if x < 1 << 63 else F.lit(-(1 << 63)).cast("long") for x in _FLIPS.tolist()])
    between = far.select("a", F.explode(masks).alias("m")).select("a", F.col("a").bitwiseXOR(F.col("m")).alias("y"))
    balls = between.groupBy("y").agg(F.collect_list("a").alias("held"))  # 65 members at most
    stars = balls.filter(F.size("held") > 1).select(F.array_min("held").alias("b"), F.explode("held").alias("a")).filter("a <> b").select("a", "b")
    return met.unionByName(stars).distinct()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp)."""

    def make():
        return lambda t: (fingerprint(t),)

    return per_text(docs, [key], "fp long", make, text)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fp, component_id)."""
    prints = written(fingerprints(docs, key, text), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(key).alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes), "a", "b")
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(of.join(least, "root").select("fp", "component_id"), "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns: one of each component stays, that of the smallest key (nulls last).

    Rows are told by key and a hash of the text; of rows that agree in both, one stays.
    """
    from pyspark.sql import Window

    h, key_, h_, n = fresh(docs, "text_hash", "kept_key", "kept_hash", "copy")
    body = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("h"), body.alias("body"))

    def make():
        return lambda t: (fingerprint(t),)

    prints = written(per_text(named, ["key", "h"], "fp long", make, "body"), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "h")).alias("first")), "nodes")
    roots = components(links(nodes), "a", "b")
    of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("first", F.coalesce("root", "fp").alias("root"))
    kept = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key_), F.col("first.h").alias(h_))
    marked = docs.withColumn(h, F.xxhash64(body))
    found = marked.join(kept, (F.col(h) == F.col(h_)) & F.col(key).eqNullSafe(F.col(key_)), "left_semi")
    only = Window.partitionBy(h, key).orderBy(h)
    return found.withColumn(n, F.row_number().over(only)).filter(F.col(n) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = near_duplicates(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
