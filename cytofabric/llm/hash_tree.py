"""Sharding by a hierarchical weighted hash tree: each row descends region, rack and shard by weighted hash draws."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, release, table

#: The query's tree: 24 shards in 2 regions of 3 racks of 4.
SHARDS, REGIONS, RACKS = 24, 2, 3
#: Bits of an MD5 digest that make a draw: as many as a double holds exactly, less one for the half that keeps a draw above 0.
DRAW_BITS = 52


class Shard(NamedTuple):
    """A leaf of the tree. The weights of its rack and its region are the sums of their shards'."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def even_tree(shards: int = SHARDS, regions: int = REGIONS, racks: int = RACKS) -> list[Shard]:
    """shards of weight 1, dealt evenly and in order to regions * racks racks."""
    place = lambda i: i * regions * racks // shards
    return [Shard(f"r{place(i) // racks}", f"k{place(i) % racks}", i) for i in range(shards)]


def grown(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, numbered next, in a region of its own: no other subtree's weight changes, so rows move into it alone.

    A shard added to a rack that is there already raises that rack's and its region's weight too. Rows then come from other regions into that
    region and descend there by the draws of its racks, so some of them end in older shards of it; no row moves between or within other regions.
    """
    names, new = {s.region for s in tree}, max((s.shard for s in tree), default=-1) + 1
    region = next(f"r{i}" for i in range(len(names) + 1) if f"r{i}" not in names)
    return [*tree, Shard(region, "k0", new, weight)]


def _children(tree: Sequence[Shard]) -> list[dict[str, dict[str, float]]]:
    """For each level, node -> its children's names with the sums of the weights below. Children without weight take no rows and are left out."""
    if len({s.shard for s in tree}) < len(tree) or not all(s.weight >= 0 and math.isfinite(s.weight) for s in tree) or not any(s.weight for s in tree):
        raise ValueError("a tree has shards with distinct numbers and finite weights, none below 0 and at least one above")
    levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for s in tree:
        path = ["", s.region, f"{s.region}/{s.rack}", f"{s.region}/{s.rack}/{s.shard}"]
        for level in range(3):
            if s.weight:
                below = levels[level].setdefault(path[level], {})
                below[path[level + 1]] = below.get(path[level + 1], 0.0) + s.weight
    return levels


def placed(rows: DataFrame, key: str, tree: Sequence[Shard], into: str) -> DataFrame:
    """rows with the shard of the key column (as string; null counts as empty) in column `into`. Plain expressions: no row moves.

    At each level every child of the chosen node draws -ln(u) / weight, u in (0, 1) from an MD5 digest of key and child's name; the least draw wins,
    which chooses children in proportion to weight. A draw depends on key, child and the child's weight only. So where weights
    change in one subtree, keys come into it or leave it, and keys that stay outside it keep their region, rack and shard.
    A row costs as many digests as the nodes on its way have children. The tree is part of the plan: meant for thousands of shards.
    """
    rows = rows.withColumns({"key_": F.coalesce(F.col(key).cast("string"), F.lit("")), "node_": F.lit("")})
    for nodes in _children(tree):
        most = max(map(len, nodes.values()))
        pairs = [(F.lit(n), F.array(*(F.struct(F.lit(c).alias("name"), F.lit(float(w)).alias("weight")) for c, w in below.items()))) for n, below in nodes.items()]
        rows = rows.withColumn("below_", F.element_at(F.create_map(*(x for p in pairs for x in p)), F.col("node_")))
        draws = []
        for i in range(most):
            child = F.get("below_", F.lit(i))
            bits = F.conv(F.substring(F.md5(F.concat(F.col("key_"), F.lit(":"), child["name"]).cast("binary")), 1, DRAW_BITS // 4), 16, 10).cast("double")
            draw = F.struct((-F.log((bits + 0.5) / 2.0**DRAW_BITS) / child["weight"]).alias("draw"), child["name"].alias("name"))
            draws.append(F.when(child.isNotNull(), draw))
        rows = rows.withColumn("node_", (F.least(*draws) if most > 1 else draws[0])["name"])
    return rows.withColumn(into, F.substring_index("node_", "/", -1).cast("int")).drop("key_", "node_", "below_")


def numbered(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """rows with a slot, gapless from 0 within each shard, by the columns of order; rows that repeat these in any order.

    Rows are sorted in ranges of (shard, order), so a shard of any size, and rows that repeat, spread over tasks. A row's slot follows from its place
    in its range and from the counts of the ranges before: one small row for each shard and range.
    """
    told = cut(rows.withColumn("told_", F.monotonically_increasing_id()))  # written, so that equal rows are told apart for good
    keys = [shard, *order, "told_"]
    ordered = cut(told.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id()))
    release(told)
    ranged = ordered.withColumn("range_", F.shiftright("at_", 33))
    counts = ranged.groupBy(shard, "range_").agg(F.min("at_").alias("low_"), F.count("*").alias("n_"))
    earlier = Window.partitionBy(shard).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(shard, "range_", (F.col("low_") - F.coalesce(F.sum("n_").over(earlier), F.lit(0))).alias("base_"))
    return ranged.join(base, [shard, "range_"]).withColumn(slot, F.col("at_") - F.col("base_")).drop("at_", "told_", "range_", "base_")


def shard_documents(docs: DataFrame, tree: Sequence[Shard] | None = None, then: Sequence[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, size, text_crc32, law ('key'), shard, slot, grown_shard.

    The id decides the shard (rows with equal ids, and those without, share one). size: the text's bytes in UTF-8 and 8; a null text has none and the
    checksum of the empty one. slot: by id (null first), checksum and size within the shard. grown_shard: the shard in the tree `then`, which
    is the tree grown by one shard unless given. An empty table gives no rows; other columns are neither read nor returned.
    """
    tree = tree or even_tree()
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col), (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"))
    rows = placed(placed(rows, id_col, tree, "shard"), id_col, then or grown(tree), "grown_shard")
    return numbered(rows, "shard", [id_col, "text_crc32", "size"])


def write_shards(docs: DataFrame, path: str, tree: Sequence[Shard] | None = None, id_col: str = "doc_id") -> str:
    """Write the rows of docs, all columns, in one folder for each shard that gets any; return the name of the partition column (`shard`, or the
    first of `shard_`, `shard__`, ... that docs does not have). A large shard is written by several tasks."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    rows = placed(docs.select(F.struct("*").alias("row_"), F.col(id_col).alias("id_")), "id_", tree or even_tree(), name)
    rows.select("row_.*", name).hint("rebalance", name).write.partitionBy(name).parquet(path)
    return name


def moves(docs: DataFrame, tree: Sequence[Shard], then: Sequence[Shard], id_col: str = "doc_id") -> DataFrame:
    """(id_col, source, target): what must be carried from shard to shard when the tree changes, one row for each row of docs that moves."""
    return placed(placed(docs.select(id_col), id_col, tree, "source"), id_col, then, "target").where("source <> target")


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


_DRAW = "-ln((CAST(('0x' || substr(md5(key || ':' || {0}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496) / {1}"
ORACLE = f"""
WITH bits AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS v FROM range(256) r(i))),
d AS MATERIALIZED (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, coalesce(text, '') AS text FROM documents),
leaf AS (SELECT i, 'r' || (i // 12) AS region, 'r' || (i // 12) || '/k' || (i // 4 % 3) AS rack FROM range(24) r(i)),
tree AS (SELECT 24 AS n, *, rack || '/' || i AS shard FROM leaf UNION ALL SELECT 25, *, rack || '/' || i FROM leaf UNION ALL SELECT 25, 24, 'r2', 'r2/k0', 'r2/k0/24'),
regions AS (SELECT n, region, count(*) AS w FROM tree GROUP BY ALL),
racks AS (SELECT n, region, rack, count(*) AS w FROM tree GROUP BY ALL),
keys AS (SELECT DISTINCT key FROM d),
one AS (SELECT n, key, arg_min(region, {_DRAW.format('region', 'w')}) AS region FROM keys, regions GROUP BY ALL),
two AS (SELECT n, key, arg_min(rack, {_DRAW.format('rack', 'w')}) AS rack FROM one JOIN racks USING (n, region) GROUP BY ALL),
three AS (SELECT n, key, arg_min(i, {_DRAW.format('shard', '1')}) AS shard FROM two JOIN tree USING (n, rack) GROUP BY ALL),
sized AS (SELECT doc_id, key, CAST(octet_length(encode(text)) + 8 AS BIGINT) AS size,
  xor(list_reduce(list_transform(regexp_extract_all(hex(text), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, bits)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(a.shard AS INT) AS shard, row_number() OVER (PARTITION BY a.shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(b.shard AS INT) AS grown_shard
FROM sized JOIN three a ON a.key = sized.key AND a.n = 24 JOIN three b ON b.key = sized.key AND b.n = 25
"""
