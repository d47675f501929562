"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from the root to a leaf. At each inner node every child draws
``-ln(u) / weight`` with u hashed from (key, child name); the smallest draw wins, which
picks a child with probability proportional to its weight. A child's weight is the sum of
its leaves' weights, so a changed leaf weight changes draws on its own path only, and rows
move only into or out of subtrees whose weight changed.

Law: ``key``. The key and the tree decide alone. ``grown_tree`` adds a leaf as a region of
its own, so that rows move into it and nowhere else.

Defined cases: a null key draws as the empty key; null text has size 1 and CRC 0; repeated
rows share a shard and get distinct slots; an empty table gives an empty result; columns of
the input that aren't named in ``columns`` are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table

#: Slots are numbered by (bucket, key): so many hash buckets bound the offsets table and the rows of a sort.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Leaf:
    name: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Node:
    name: str
    children: tuple

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children)


def even_tree(shards: int = 8, racks: int = 2, per_rack: int = 2) -> Node:
    """Regions of `racks` racks of `per_rack` shards; the last ones may hold fewer."""
    leaves = [Leaf(f"s{i}", i) for i in range(shards)]
    rack = [Node(f"k{i // per_rack}", tuple(leaves[i : i + per_rack])) for i in range(0, shards, per_rack)]
    return Node("root", tuple(Node(f"g{i // racks}", tuple(rack[i : i + racks])) for i in range(0, len(rack), racks)))


def grown_tree(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard as a region of its own: every other node keeps its weight and its draws."""
    leaf = Leaf(f"s{shard}", shard, weight)
    return Node(tree.name, (*tree.children, Node(f"g+{shard}", (Node(f"k+{shard}", (leaf,)),))))


def uniform(key: Column, salt: str) -> Column:
    """A hash of key and salt in (0, 1), the same in any engine that has MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + salt))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def descend(key: Column, node: Node | Leaf) -> Column:
    """The shard that the tree gives a (string) key."""
    if isinstance(node, Leaf):
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [-F.ln(uniform(key, c.name)) / F.lit(float(c.weight)) for c in node.children if c.weight > 0]
    kept = [c for c in node.children if c.weight > 0]
    least = F.least(*draws)
    out = descend(key, kept[-1])
    for d, c in list(zip(draws, kept, strict=True))[-2::-1]:
        out = F.when(d == least, descend(key, c)).otherwise(out)
    return out


def shard(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, size, text_crc32, law, shard, slot, grown_shard).

    Slots: rows are numbered within (shard, bucket) after one shuffle of narrow rows; each
    bucket starts where the rows of the ones before it end. The offsets table has at most
    shards x SLOT_BUCKETS rows whatever the input, so it's broadcast.
    """
    grown = grown or tree
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(F.concat(k, F.lit("/slot"))), 1, 3), 16, 10).cast("int") % SLOT_BUCKETS
    rows = docs.select(F.col(key), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), descend(k, tree).alias("shard"), descend(k, grown).alias("grown_shard"), bucket.alias("bucket"))
    counts = docs.select(descend(k, tree).alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "bucket").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("at", F.row_number().over(order) - 1)
    return numbered.join(F.broadcast(starts), ["shard", "bucket"]).select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int"), (F.col("start") + F.col("at")).cast("long").alias("slot"), F.col("grown_shard").cast("int"))


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(8)
    return shard(table(spark, sf_dir, "documents"), tree, grown_tree(tree, 8))


def _draw_sql(name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5(k || '/{name}'), 1, 13))::UBIGINT::DOUBLE + 0.5) / {2**52}.0) / {weight}"


def _descend_sql(node: Node | Leaf) -> str:
    if isinstance(node, Leaf):
        return str(node.shard)
    if len(node.children) == 1:
        return _descend_sql(node.children[0])
    draws = [_draw_sql(c.name, float(c.weight)) for c in node.children]
    whens = " ".join(f"WHEN {d} = least({', '.join(draws)}) THEN {_descend_sql(c)}" for d, c in list(zip(draws, node.children, strict=True))[:-1])
    return f"(CASE {whens} ELSE {_descend_sql(node.children[-1])} END)"


def _oracle() -> str:
    """crc32 as a bitwise fold has no SQL function in DuckDB; a table of byte steps stands in for it."""
    tree = even_tree(8)
    return f"""
WITH RECURSIVE step(b, c, i) AS (
  SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM step WHERE i < 8),
steps AS (SELECT list(c ORDER BY b) AS t FROM step WHERE i = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS body FROM documents),
e AS (SELECT doc_id, k, strlen(body) + 1 AS size, hex(encode(body)) AS h FROM d),
s AS (SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT)),
    lambda a, x: xor(a >> 8, t[((xor(a, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  {_descend_sql(tree)} AS shard, {_descend_sql(grown_tree(tree, 8))} AS grown_shard,
  ('0x' || substr(md5(k || '/slot'), 1, 3))::INTEGER AS bucket
  FROM e, steps)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot,
  grown_shard::INTEGER AS grown_shard
FROM s"""


QUERIES = {"op10_shard": op10_shard}
ORACLE = {"op10_shard": _oracle()}
