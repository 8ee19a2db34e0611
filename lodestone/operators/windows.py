"""Date windows that a source can answer whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.shared import settled


def bisect(days: DataFrame, cap: int, max_depth: int) -> DataFrame:
    """``lo, hi, depth, n``: the range of ``days(d, n)`` halved until no window holds more than ``cap`` or depth is out.

    ``days`` has one row for each day; each level is one join of its open windows with the days inside them.
    """
    days = settled(days)
    level = days.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.sum("n").cast("bigint").alias("n")).withColumn("depth", F.lit(0))
    done = []
    for depth in range(max_depth + 1):
        level = settled(level)
        is_open = (F.col("n") > cap) & (F.lit(depth) < max_depth) & (F.col("lo") < F.col("hi"))
        done.append(level.where(~is_open).select("lo", "hi", "depth", "n"))
        split = level.where(is_open)
        if split.isEmpty():
            break
        mid = F.date_add("lo", F.floor(F.datediff("hi", "lo") / 2).cast("int"))
        halves = split.select(F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(F.date_add(mid, 1).alias("lo"), F.col("hi").alias("hi")))).alias("w")).select("w.*")
        inside = halves.join(days, (F.col("d") >= F.col("lo")) & (F.col("d") <= F.col("hi")), "left")
        level = inside.groupBy("lo", "hi").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n")).withColumn("depth", F.lit(depth + 1))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
