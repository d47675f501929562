"""Removal of repeated substrings: a depth-limited radix sort of all suffixes.

Every byte starts a suffix, sorted only through its first `threshold` bytes; the groups that
are equal at that depth are the repeated windows, and what they cover is removed. The sort
runs by most significant digit, over all documents at once, and a suffix leaves as soon as its
group holds nothing else. Digits are taken in an order that the window's own bytes fix, so that
equal windows have equal digits:

1. The first digit is the window's anchor: of its strings of up to KMER bytes the one of least
   hash (the leftmost of equals), with its place in the window. Neighbouring windows share an
   anchor, so a run of suffixes is one narrow row, about one for each 85 bytes. Runs whose
   anchor stands nowhere else leave here.
2. The second digit is the text of a whole run. Runs that hold the same text are equal groups
   for every one of their windows at once; copies meet here and go no further, counted by
   partial aggregates.
3. Runs that share an anchor but differ somewhere (one for each text) are dealt to tasks by
   anchor. Their suffixes start in groups of one anchor at one place, and are refined from the
   first byte on by passes over digits of eight bytes; a suffix alone in its group leaves after
   each pass, a group whose digits are all equal isn't sorted, and what is left at the
   threshold is equal byte by byte.

An anchor that more than HOT windows share isn't dealt to one task. Its runs are cut into pieces
of PIECE neighbouring places of the anchor, which are counted, with partial aggregates, by a
128-bit hash of the bytes that all windows of a piece hold: a piece alone leaves, and where all
that share those bytes are equal, they are equal groups. Windows of the other pieces, about one
piece for each run, are counted one by one by 128-bit hashes. Anchors and runs are compared by
64-bit hashes each, so runs are told apart by 128 bits.

Thresholds from 1 to MOST bytes; others raise ValueError. The time grows with the windows of
differing runs, up to threshold bytes read for each.

Defined cases: null and empty texts have no bytes; texts under the threshold lose nothing;
matches never cross documents, but may lie within one and may overlap; strings are judged on
the input, not on what is left; repeated rows (equal texts of the threshold or more) repeat
each other whole; a null key is a key like any other; an empty table gives an empty result;
other columns are ignored, clashing names or not.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import batches_of, drop_written, fresh, release, table, written

THRESHOLD, KMER, HOT, PIECE, MOST = 200, 32, 1_000_000, 16, 1 << 15
#: Windows sorted at a time, if groups are smaller.
AT_ONCE = 100_000
#: Bytes hashed at a time (or four thresholds), so that sums stay in a core's cache; a longer text is cut into overlapping segments.
SEGMENT = 1 << 16
_PLACE = np.uint64((1 << 21) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a segment from one running sum: sum of code(byte) * base^place, modulo 2^64."""

    BASE = 0x9E3779B97F4A7C55

    def __init__(self, most: int):
        self.most, inverse = most, pow(self.BASE, -1, 1 << 64)
        self.up, self.down = (np.cumprod(np.r_[np.uint64(1), np.full(most, b, np.uint64)]) for b in (np.uint64(self.BASE), np.uint64(inverse)))
        self.code = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.code[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start, end) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.down[start])

    def all(self, sums: np.ndarray, width: int) -> np.ndarray:
        n = len(sums) - width
        return _mixed((sums[width:] - sums[:n]) * self.down[:n])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)
    y = np.r_[x, pad].reshape(-1, width)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs(hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, threshold: int = THRESHOLD) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, for texts that lie at starts..ends in data: which text, first window, windows, anchor's place in the first, anchor and text hashes."""
    n = len(data)
    none = {k: np.empty(0, np.int64) for k in ("text", "first", "many", "anchor", "h", "f")}
    if n < threshold:
        return none
    sums = hasher.sums(data)
    kmer = min(KMER, (threshold + 1) // 2)
    at = hasher.all(sums, kmer)
    least = _sliding_least((at & ~_PLACE) | np.arange(len(at), dtype=np.uint64), threshold - kmer + 1)
    anchor = (least & _PLACE).astype(np.int64)
    step = np.zeros(n + 1, np.int64)  # windows that lie in one text
    whole = ends - starts >= threshold
    np.add.at(step, starts[whole], 1)
    np.add.at(step, ends[whole] - threshold + 1, -1)
    s = np.flatnonzero(np.cumsum(step)[: len(anchor)])
    if not len(s):
        return none
    a = anchor[s]
    new = np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)]
    text = np.searchsorted(starts, s, side="right") - 1
    new[1:] |= text[1:] != text[:-1]
    begin = np.flatnonzero(new)
    first, last, anchor = s[begin], s[np.r_[begin[1:], len(s)] - 1], a[begin]
    many, place = last - first + 1, anchor - first
    f = hasher.of(sums, first, last + threshold) + _mixed(many.astype(np.uint64) * np.uint64(1 << 20) + place.astype(np.uint64))
    t = text[begin]
    return {"text": t, "first": first - starts[t], "many": many, "anchor": place, "h": at[anchor].view(np.int64), "f": f.view(np.int64)}


def _segments(texts: list[bytes], threshold: int, segment: int):
    """(data, starts, ends, (text, offset) of each part): texts side by side, long ones in parts that share threshold - 1 bytes."""
    held, size = [], 0
    step = segment - threshold
    for i, t in enumerate(texts):
        if len(t) < threshold:
            continue
        for at in range(0, max(len(t) - threshold + 1, 1), step):
            part = t[at : at + step + threshold - 1]
            if size + len(part) > segment and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _laid(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, ends[:-1]], ends


def all_runs(texts: list[bytes], hasher: Hasher, threshold: int = THRESHOLD, segment: int = SEGMENT) -> dict[str, np.ndarray]:
    out = []
    for held in _segments(texts, threshold, segment):
        r = runs(hasher, *_laid([p for _, _, p in held]), threshold)
        r["first"] = r["first"] + np.array([at for _, at, _ in held], np.int64)[r["text"]]
        r["text"] = np.array([i for i, _, _ in held], np.int64)[r["text"]]
        out.append(r)
    return {k: np.concatenate([r[k] for r in out]) if out else np.empty(0, np.int64) for k in ("text", "first", "many", "anchor", "h", "f")}


def windows(parts: list[bytes], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all parts, part, place, start in the bytes) of every window of every part."""
    data, starts, ends = _laid(parts)
    many = ends - starts - threshold + 1
    which = np.repeat(np.arange(len(parts)), many)
    place = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(many)[:-1]], many)
    return data, which, place, starts[which] + place


def equal_at(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes that share their group and their first `depth` bytes with another one, sorted by passes from the most significant digit."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    digits = np.ndarray((len(data),), ">u8", padded, 0, (1,))  # eight bytes from each place on
    live = np.argsort(group, kind="stable")
    g = group[live]
    new = np.r_[True, g[1:] != g[:-1]] if len(g) else np.empty(0, bool)
    for at in range(-8, depth, 8):
        if at >= 0 and len(live):
            d = digits[start[live] + at].astype(np.uint64)
            if depth - at < 8:
                d >>= np.uint64(8 * (8 - depth + at))
            differ = np.flatnonzero((d[1:] != d[:-1]) & ~new[1:]) + 1
            if not len(differ):
                continue
            g = np.cumsum(new) - 1
            mixed = np.zeros(g[-1] + 1, bool)
            mixed[g[differ]] = True
            some = np.flatnonzero(mixed[g])
            order = some[np.lexsort((d[some], g[some]))]
            live[some], d[some] = live[order], d[order]
            new[1:] |= d[1:] != d[:-1]
        keep = ~(new & np.r_[new[1:], True])
        live, new = live[keep], new[keep]
    return live


def repeated(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (t, nb, spans): for each text (hash and bytes) with repeated windows, what they cover as [start, end) pairs, unmerged."""
    import pyarrow as pa

    if not 1 <= threshold <= MOST:
        raise ValueError(f"threshold must be 1 to {MOST} bytes; got {threshold}")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("string").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("body"), *_name(text)).filter(F.col("nb") >= threshold)

    def first_digits(batches):
        segment = max(SEGMENT, 4 * threshold)
        hasher = Hasher(segment + 2 * threshold)
        for b in batches_of(batches):
            r = all_runs([x.encode() for x in b.column(2).to_pylist()], hasher, threshold, segment)
            t, nb = (b.column(i).to_numpy(zero_copy_only=False)[r["text"]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(nb), *(pa.array(r[c].astype(np.int32)) for c in ("first", "many", "anchor")), pa.array(r["h"]), pa.array(r["f"])], names=["t", "nb", "first", "many", "anchor", "h", "f"])

    run_rows = written(rows.select("t", "nb", "body").mapInArrow(first_digits, "t long, nb long, first int, many int, anchor int, h long, f long"), "runs")
    shared = written(run_rows.groupBy("h").count().filter("count > 1").select("h"), "anchors")
    met = written(run_rows.join(shared, "h", "left_semi"), "met")
    drop_written(run_rows)
    drop_written(shared)
    release(spark)
    # one run for each (anchor, text of the run); least values of one row go together
    base = threshold + 1
    packed = (F.col("first").cast("long") * base + F.col("many")) * base + F.col("anchor")
    once = met.groupBy("h", "f").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.min_by("nb", "t").alias("nb"), F.min_by(packed, "t").alias("w"))
    once = written(once, "digits")
    several = once.groupBy("h").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.sum(F.expr(f"w div {base} % {base}")).alias("many")).filter("a <> b")
    several = written(several.select("h", (F.col("many") > HOT).alias("hot")), "several")
    equal = met.join(once.filter("n > 1").select("h", "f"), ["h", "f"], "left_semi")
    whole = written(equal.select("t", "nb", F.col("first").cast("long").alias("start"), (F.col("first") + F.col("many") - 1 + threshold).cast("long").alias("end")).distinct(), "whole")
    drop_written(met)
    names = rows.groupBy("t", "nb").agg(F.min("k").alias("k"))

    left = once.join(several, "h").groupBy("t", "nb").agg(F.collect_list(F.struct("h", "w", "hot")).alias("ws"))
    left = left.join(names, ["t", "nb"])
    # one text for each, and its differing runs
    held = rows.join(left.withColumnRenamed("k", "k2"), ["t", "nb"]).filter(F.col("k").eqNullSafe(F.col("k2"))).select("t", "nb", "ws", "body")

    def parts_of(batches):
        """(hot, h, t, nb, first, anchor, bytes) of every run."""
        for b in batches_of(batches):
            for t, nb, ws, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = body.encode()
                for x in ws:
                    w, anchor = divmod(x["w"], base)
                    first, many = divmod(w, base)
                    yield x["hot"], x["h"], t, nb, first, anchor, data[first : first + many - 1 + threshold]

    def contexts(batches):
        kinds = [pa.bool_(), *[pa.int64()] * 5, pa.binary()]
        for some in _by(parts_of(batches), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names=["hot", "h", "t", "nb", "first", "anchor", "part"])

    def last_digits(batches):
        def told(block):
            """Covered places of whole groups."""
            h, t, nb, first, anchor = (np.array(c, np.int64) for c in block[:5])
            data, which, place, start = windows(block[5], threshold)
            _, h = np.unique(h, return_inverse=True)
            s = np.sort(equal_at(data, start, h[which] * base + anchor[which] - place, threshold))
            if len(s):
                w, p = which[s], place[s]
                begin = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)])  # neighbouring windows as one
                last = np.r_[begin[1:], len(s)] - 1
                w = w[begin]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (t[w], nb[w], first[w] + p[begin], first[w] + p[last] + threshold)], names=["t", "nb", "start", "end"])

        block: list[list] = [[] for _ in range(6)]
        held, tried = 0, 0
        for b in batches_of(batches, 1000):
            for c, new in zip(block, b.columns, strict=True):
                c += new.to_pylist()
            held += int(np.sum([len(x) - threshold + 1 for x in block[5][-b.num_rows :]]))
            if held >= max(AT_ONCE, 2 * tried):
                hs = block[0]
                n = len(hs)
                while n and hs[n - 1] == hs[-1]:  # the last group may go on
                    n -= 1
                if n:
                    yield from told([c[:n] for c in block])
                    block = [c[n:] for c in block]
                    held = sum(len(x) - threshold + 1 for x in block[5])
                tried = held
        if block[0]:
            yield from told(block)

    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = held.mapInArrow(contexts, "hot boolean, h long, t long, nb long, first long, anchor long, part binary")
    any_hot = bool(several.filter("hot").limit(1).count())
    if any_hot:
        parts = written(parts, "parts")
    cold = (parts.filter("not hot") if any_hot else parts).drop("hot")
    found = written(cold.repartition(n, "h").sortWithinPartitions("h").mapInArrow(last_digits, "t long, nb long, start long, end long"), "spans")
    if any_hot:
        found = found.unionByName(_hot_spans(parts.filter("hot").drop("hot"), threshold))
    drop_written(once)
    release(spark)
    return whole.unionByName(found).distinct().groupBy("t", "nb").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _hot_spans(parts: DataFrame, threshold: int) -> DataFrame:
    """Rows (t, nb, start, end) that cover the repeated windows among runs of anchors too frequent for a task."""
    import pyarrow as pa

    def rows_of(batches, tell):
        from xxhash import xxh3_128_digest

        for some in _by((row for b in batches_of(batches) for r in zip(*(c.to_pylist() for c in b.columns), strict=True) for row in tell(*r)), 10_000):
            *numbers, hashed = zip(*some, strict=True)
            pair = np.frombuffer(b"".join(map(xxh3_128_digest, hashed)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in numbers), *(pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1))], names=["t", "nb", "first", "lo", "hi", "f", "x", "y"])

    def pieces(h, t, nb, first, anchor, part):
        from xxhash import xxh3_64_intdigest

        many = len(part) - threshold + 1
        for block in range((anchor - many + 1) // PIECE, anchor // PIECE + 1):
            a, b = block * PIECE, block * PIECE + PIECE - 1  # places of the anchor in windows
            lo, hi = max(anchor - b, 0), min(anchor - a, many - 1) + 1
            core = part[max(anchor - a, 0) : anchor + threshold - b]
            f = xxh3_64_intdigest(part[lo : hi - 1 + threshold], anchor - lo) - (1 << 63)
            yield t, nb, first, lo, hi, f, b"%d/%d/" % (h, block) + core

    def singly(h, t, nb, first, anchor, part, lo, hi):
        for i in range(lo, hi):
            yield t, nb, first, i, i + 1, 0, part[i : i + threshold]

    schema = "t long, nb long, first long, lo long, hi long, f long, x long, y long"
    cut = written(parts.mapInArrow(lambda b: rows_of(b, pieces), schema), "pieces")
    shared = written(cut.groupBy("x", "y").agg(F.count("*").alias("n"), (F.min("f") == F.max("f")).alias("same")).filter("n > 1").drop("n"), "cores")
    kept = written(cut.join(shared, ["x", "y"]), "kept")
    drop_written(cut)
    mixed = parts.join(kept.filter("not same").select("t", "nb", "first", "lo", "hi"), ["t", "nb", "first"]).select("h", "t", "nb", "first", "anchor", "part", "lo", "hi")
    lone = written(mixed.mapInArrow(lambda b: rows_of(b, singly), schema), "windows")
    both = lone.groupBy("x", "y").count().filter("count > 1").select("x", "y")
    found = kept.filter("same").select("t", "nb", "first", "lo", "hi").unionByName(lone.join(both, ["x", "y"], "left_semi").select("t", "nb", "first", "lo", "hi"))
    return found.select("t", "nb", (F.col("first") + F.col("lo")).alias("start"), (F.col("first") + F.col("hi") - 1 + threshold).alias("end"))


def _by(items, n: int):
    """Lists of up to n items."""
    items = iter(items)
    while some := list(islice(items, n)):
        yield some


def _name(text: str) -> list:
    """The columns that stand for a text: a hash and its bytes."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("t"), F.octet_length(body).cast("long").alias("nb")]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _with_spans(docs: DataFrame, threshold: int, key: str, text: str) -> tuple[DataFrame, str]:
    """docs with one more column, the spans to cut, and that column's name."""
    spans = repeated(docs, threshold, key, text)
    t, nb, cut = fresh(docs, "text_hash", "text_bytes", "cut_spans")
    named = docs.withColumns(dict(zip((t, nb), _name(text), strict=True)))
    s = spans.select(F.col("t").alias(t), F.col("nb").alias(nb), F.col("spans").alias(cut))
    return named.join(s, [t, nb], "left").select(*_all(docs), F.col(cut)), cut


def _all(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def remove(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_removed, n_spans, kept): kept is binary, as a cut may fall within a character."""
    import pyarrow as pa
    from pyspark.sql import types as T

    x, _ = _with_spans(docs.select(key, text), threshold, key, text)
    out = T.StructType([x.schema[0], *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary")])

    def run(batches):
        for b in batches_of(batches):
            rows = []
            for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                data, s = (t or "").encode(), merged([(x["start"], x["end"]) for x in s or []])
                rows.append((len(data), sum(e - a for a, e in s), len(s), without(data, s)))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=out.names)

    return x.mapInArrow(run, out)


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated substrings cut from `text`; characters that a cut splits go whole."""
    import pyarrow as pa

    columns, at = docs.columns, docs.columns.index(text)
    x, _ = _with_spans(docs, threshold, key, text)

    def run(batches):
        for b in batches_of(batches):
            texts = [t if t is None or not s else without(t.encode(), merged([(x["start"], x["end"]) for x in s])).decode("utf-8", "ignore") for t, s in zip(b.column(at).to_pylist(), b.column(len(columns)).to_pylist(), strict=True)]
            cols = list(b.columns[: len(columns)])
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    return x.mapInArrow(run, docs.schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = remove(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
