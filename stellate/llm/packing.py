"""Packing documents into sequences: shortest pack first over the histogram of lengths.

1. Each text is encoded once; documents are cut into pieces of at most `size` tokens, all
   full but the last, and a narrow row for each piece is written to the shared folder.
2. The histogram (at most `size` rows) comes to the driver. Lengths are placed longest first,
   each into the shortest packs that have room; packs of equal content are one pattern with
   a count, so the work depends on `size` alone and not on the number of documents.
3. Pieces of a length are ranked and joined to the pattern places of that length by rank.

Pieces of one length are ranked within hash buckets, whose number follows the count of that
length, so that no task gets a length whole. The table of places is broadcast: each bin of
the histogram splits at most one pattern and opens at most one, so it has at most 2 x size
patterns of at most sqrt(2 x size) different lengths, whatever the input.

Defined cases: null and empty texts hold only the closing token; a text of any length is
encoded whole; repeated rows are packed each; an empty table gives an empty result; ties of
rank are broken by key and start; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import WordEncoder, kept
from .tables import per_text, table, written

SIZE, END = 2048, 1
BUCKET_ROWS, MOST_BUCKETS = 50_000, 4096


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, start, length, ids_crc32, doc_tokens) for the pieces of every document."""
    close = end.to_bytes(4, "little")

    def make():
        enc = kept(WordEncoder, path)

        def some(texts: list[str]) -> list[tuple]:
            whole = [memoryview(ids + close) for ids in enc.encode_all(texts)]
            return [(len(ids) // 4, [zlib.crc32(ids[a : a + 4 * size]) for a in range(0, len(ids), 4 * size)]) for ids in whole]

        return some

    rows = per_text(docs, [key], "doc_tokens long, crcs array<long>", make, text, together=True)
    rows = rows.select(key, "doc_tokens", F.posexplode("crcs").alias("at", "ids_crc32"))
    start = F.col("at").cast("long") * size
    return rows.select(key, start.alias("start"), F.least(F.lit(size), F.col("doc_tokens") - start).cast("long").alias("length"), "ids_crc32", "doc_tokens")


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, longest first) and how many sequences have each."""
    room: dict[int, list[list]] = defaultdict(list)  # by free tokens: [lengths, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed = []
        while left:
            free = max((f for f, packs in room.items() if packs and f >= length), default=0)
            if not free:
                most = size // length
                each, rest = divmod(left, most)
                placed += [[(length,) * most, each]] * bool(each) + [[(length,) * rest, 1]] * bool(rest)
                break
            content, count = room[free].pop()
            used = min(left, count)
            if used < count:
                room[free].append([content, count - used])
            room[free - length].append([(*content, length), used])
            left -= used
        for content, count in placed:
            room[size - sum(content)].append([content, count])
    out = [(tuple(c), n) for f in sorted(room) for c, n in room[f]]
    return sorted(out, key=lambda x: (x[0], x[1]), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, ranks, first sequence, offset)."""
    rank, out, sequence = defaultdict(int), [], 0
    for content, count in patterns:
        offset = 0
        for length in content:
            out.append((length, rank[length], count, sequence, offset))
            rank[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    spark = docs.sparkSession
    cut = written(pieces(docs, path, size, end, key, text), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    spots = spark.createDataFrame(places(plan(histogram, size)), "length long, first long, n long, sequence long, offset long")
    buckets = {n: min(MOST_BUCKETS, -(-c // BUCKET_ROWS)) for n, c in histogram.items() if c > BUCKET_ROWS}
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv]), F.col("length").cast("int")), F.lit(1)) if buckets else F.lit(1)
    rows = cut.withColumn("bucket", F.pmod(F.xxhash64(F.col(key), "start"), many).cast("int"))
    counts = rows.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "bucket").orderBy(F.col(key).asc_nulls_first(), "start", "ids_crc32")
    ranked = rows.withColumn("at", F.row_number().over(order) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("at"))
    s = F.broadcast(spots.withColumnRenamed("length", "spot_length"))
    joined = ranked.join(s, (F.col("length") == F.col("spot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    return joined.select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op5_pack": op5_pack}
