"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

Each shard draws -ln(u) / weight from a hash of the key and its own name. The draw of a rack is the
smallest draw below it and that of a region the smallest of its racks', so an inner draw is itself a
weighted draw with the subtree's whole weight; the key descends to the smallest draw at each level. If a
weight changes, keys move only into or out of the subtrees on its path; a new shard takes keys only into
itself.

Rows are placed by doc_id and the tree alone. Null texts have size 1 and the CRC of no bytes; a null
doc_id is a key like any other; rows with the same doc_id share a shard and get slots of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Rows that a task numbers at once, about.
NUMBERED_ROWS = 50_000


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Shard]:
    """Shards in order of their number fill racks, and racks fill regions; none moves when another comes."""
    return [Shard(i // (per_rack * racks), i // per_rack, i) for i in range(shards)]


def place(key: Column, shards: list[Shard]) -> Column:
    """struct<draw, region, rack, shard> that the key descends to."""
    regions: dict[int, dict[int, list[Column]]] = {}
    for s in shards:
        if s.weight > 0:
            unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"shard/{s.shard}")), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
            leaf = F.struct((-F.log(unit) / F.lit(s.weight)).alias("draw"), F.lit(s.region).alias("region"), F.lit(s.rack).alias("rack"), F.lit(s.shard).alias("shard"))
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(leaf)

    def least(x: list[Column]) -> Column:
        return F.array_min(F.array(*x))

    return least([least([least(leaves) for leaves in racks.values()]) for racks in regions.values()])


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard for every row."""
    text = F.coalesce("text", F.lit(""))
    at, grown = place(F.col("doc_id"), tree(shards)), place(F.col("doc_id"), tree(shards + 1))
    base = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), at.alias("at"), grown.shard.alias("grown_shard"))
    base = staged(base.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "at.region", "at.rack", "at.shard", "grown_shard"), "shards")
    buckets = max(1, -(-base.count() // (shards * NUMBERED_ROWS)))
    base = base.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    sizes = base.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = sizes.withColumn("before", F.sum("rows").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("rows")).select("shard", "bucket", "before")
    numbered = base.withColumn("row", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")))
    slot = (F.col("before") + F.col("row") - 1).cast("long").alias("slot")
    return numbered.join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", slot, "grown_shard")
