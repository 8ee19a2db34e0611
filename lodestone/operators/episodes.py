"""Trajectories of agents under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats


#: Ends after which an episode might have gone on.
BROKEN_OFF = ("infra_error", "refused", "budget")


def at_cap(steps: DataFrame, cap: float) -> DataFrame:
    """What an episode had under a cap: the turns that start below it, and the last draft among them.

    Where steps know how their episode ended (``stop``), it is ``unobserved`` if it ran out below the cap and was broken off:
    what it would have had at the cap is not known.
    """
    w = Window.partitionBy("episode").orderBy("turn")
    begun = F.coalesce(F.lag("spent").over(w), F.lit(0.0)) < cap
    d = steps if "stop" in steps.columns else steps.withColumn("stop", F.lit("done"))
    d = d.withColumn("__b", begun).groupBy("episode").agg(
        F.max_by("draft", F.when(F.col("__b") & F.col("draft").isNotNull(), F.col("turn"))).alias("draft"),
        F.max(F.when(F.col("__b"), F.col("spent"))).alias("spent"),
        F.count_if("__b").alias("turns"),
        (F.bool_and("__b") & (F.max("spent") < cap) & F.coalesce(F.max("stop").isin(*BROKEN_OFF), F.lit(True))).alias("unobserved"),
    )
    return d.where("turns > 0")


def frontier_point(capped: DataFrame) -> DataFrame:
    """Episodes observed at a cap: how many were good, with an interval, and what they spent; and how many were not observed."""
    ok = F.count_if(F.col("draft") == "good")
    w = stats.wilson(F.col("ok"), F.col("n"))
    lost = capped.agg(F.count_if("unobserved").alias("unobserved"))
    d = capped.where("not unobserved").agg(F.count("*").alias("n"), ok.alias("ok"), F.round(F.avg("spent"), 6).alias("mean_spend"))
    return d.join(lost).select("n", "ok", "unobserved", "mean_spend", F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"))


def carried_draft(steps: DataFrame) -> DataFrame:
    """The latest draft at each turn."""
    w = Window.partitionBy("episode").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("current", F.last("draft", ignorenulls=True).over(w))
