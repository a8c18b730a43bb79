"""Connected components of a link table, in rounds of shuffles; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged, unstage


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h


def starred(edges: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Rows (x, block, y, text, *rest) of staged edges (x, y, *rest), and of each block first one of x itself, without y.

    A text that many others are held against is sent once for about `size` of them. Neither side is broadcast at any size, for both grow with the corpus.
    """
    rest = edges.columns[2:]
    n = edges.groupBy("x").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    others = edges.join(n, "x").withColumn("block", F.pmod(F.xxhash64("y"), "blocks")).join(texts.withColumnRenamed("rid", "y").hint("merge"), "y").select("x", "block", "y", "text", *rest)
    own = n.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(texts.withColumnRenamed("rid", "x").hint("merge"), "x")
    own = own.select("x", "block", F.lit(None).cast("long").alias("y"), "text", *(F.lit(None).cast(edges.schema[k].dataType).alias(k) for k in rest))
    return others.unionByName(own).repartition("x", "block").sortWithinPartitions("x", "block", F.col("y").asc_nulls_first())


def block_pairs(rows: DataFrame, key: str, size: int, held: list[str]) -> DataFrame:
    """(key, left, right, same): all pairs of blocks of a key's rows (with rid), as arrays of structs of what is held."""
    n = rows.groupBy(key).agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    dealt = rows.join(n, key).withColumn("own", F.pmod(F.xxhash64("rid"), "blocks"))
    blocks = staged(dealt.groupBy(key, "blocks", "own").agg(F.collect_list(F.struct(*held)).alias("rows")), "blocks")
    left = blocks.select(key, F.col("own").alias("lo"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("hi"), F.col("rows").alias("left"))
    right = blocks.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("lo"), F.col("own").alias("hi"), F.col("rows").alias("right"))
    return left.join(right, [key, "lo", "hi"]).select(key, "left", "right", (F.col("lo") == F.col("hi")).alias("same"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of edges (a, b). Self-links are ignored.

    Large-star and small-star steps in turn: each keeps reachability, and they end in one star around
    the smallest node of each component. An empty table gives an empty one.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "links")
    state = _state(now)
    while state[0]:
        both = now.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(now.select(F.col("u").alias("x"), F.col("v").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = staged(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct(), "links")
        unstage(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
