"""Connected components of an edge table, without collecting edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import reliable_checkpoint


def dealt_blocks(rows: DataFrame, bucket: str, item: str, n: str, size: int) -> DataFrame:
    """``rows`` of buckets of ``n`` rows each, dealt into blocks of about ``size`` by a hash of ``item``: each row once for
    each pair ``i <= j`` of blocks that its ``block`` is in.  So a bucket is compared whole, but by many tasks, and no task
    holds more than two blocks of it."""
    count = F.ceil(F.col(n) / F.lit(size)).cast("int")
    dealt = rows.withColumns({"block": F.pmod(F.xxhash64(item), count).cast("int"), "__o": F.explode(F.sequence(F.lit(0), count - 1))})
    return dealt.withColumns({"i": F.least("block", "__o"), "j": F.greatest("block", "__o")}).drop("__o")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; ``component`` is the smallest node reachable.

    Alternates large-star and small-star steps: each links a node's neighbours to the smallest of them, so chains
    shrink geometrically and no step emits pairs of neighbours.  Rounds end when the edge set no longer changes.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    e = reliable_checkpoint(e)
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # small star: a node's smaller neighbours, and itself, go to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), "a", "b")
        e = (
            small.select(F.col("x").alias("a"), "b")
            .unionByName(small.where("a != x").select(F.col("x").alias("a"), F.col("a").alias("b")))
            .where("a < b")
            .distinct()
        )
        e = reliable_checkpoint(e)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.sum(F.col("a").cast("decimal(38,0)")).alias("s")).first()
        now = (row["n"], row["h"], row["s"])
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
