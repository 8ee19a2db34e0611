"""Draws and the call ledger: claim-once join, long tables and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import stats

CLAIM = ("model", "target", "draw", "tokens")


def purchases(draws: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each draw with the ledger row that paid for it.

    Every claim on a key takes the latest row not yet taken, and cells claim in the order of their keys; so the r-th
    claim on a key meets its r-th row from the end, and no row is claimed twice.
    """
    claim = draws.withColumn("__r", F.row_number().over(Window.partitionBy(*CLAIM).orderBy("cell", "kind")))
    rows = ledger.select(*CLAIM, "row_id", "usd", F.row_number().over(Window.partitionBy(*CLAIM).orderBy(F.desc("row_id"))).alias("__r"))
    return claim.join(rows, [*CLAIM, "__r"], "left").drop("__r")


def unclaimed(ledger: DataFrame, claimed: DataFrame) -> DataFrame:
    return ledger.join(claimed.where("row_id is not null").select("row_id"), "row_id", "left_anti")


def unpivot(rows: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One row for each metric that has a value."""
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))
    return rows.select(*ids, F.explode(each).alias("m")).where("m.value is not null").select(*ids, "m.metric", "m.value")


def aggregate(draws: DataFrame) -> DataFrame:
    """Rate, interval, cost and silent share of each cell; no cost per success if a draw has no price or none succeeded."""
    scored = F.col("outcome").isin("ok", "raised", "silent")
    won = F.count_if(scored & (F.col("perfect") == 1))
    d = draws.groupBy("target", "model").agg(
        F.count_if(scored).alias("n"),
        won.alias("k"),
        F.count("*").alias("attempted"),
        F.sum("usd").alias("usd"),
        F.count_if(F.col("usd").isNull()).alias("unpriced"),
        F.count_if(scored & (F.col("perfect") == 0) & (F.col("outcome") == "silent")).alias("silent"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY seconds)").alias("p50"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds)").alias("p95"),
    )
    w = stats.wilson(F.col("k"), F.col("n"))
    per = F.when((F.col("k") > 0) & (F.col("unpriced") == 0) & (F.col("usd") > 0), F.col("usd") / F.col("k"))
    return d.select(
        "target", "model", "n", "k", "attempted", "unpriced", "p50", "p95",
        F.round(F.try_divide("k", "n"), 6).alias("rate"), F.round(w["lo"], 6).alias("lo"), F.round(w["hi"], 6).alias("hi"),
        F.round("usd", 6).alias("usd"), F.round(per, 6).alias("usd_per_success"), F.round(F.try_divide("silent", F.col("n") - F.col("k")), 6).alias("silent_share"),
    )


def variance_rows(draws: DataFrame, keys: list[str]) -> DataFrame:
    """The long table of draws that know their purchase (``bought_usd, bought_seconds, bought_ttft_s``, null if unknown): one
    row for each metric that a draw has.

    An excluded draw, one that was not attempted and one that the host lost say only that; the others say how they ended,
    what they used and, if their purchase is known, what it cost and took.  Tokens a second are over the time after the
    first token.
    """
    mode = F.col("mode")
    scored = ~F.col("excluded") & ~mode.isin("not_attempted", "infra_error")
    known = scored & F.col("bought_usd").isNotNull()
    busy = F.col("bought_seconds") - F.col("bought_ttft_s")
    one = lambda c: F.when(scored, c.cast("double"))
    metrics = {
        "attempted": F.when(scored, 1.0).otherwise(0.0),
        "excluded": F.when(F.col("excluded"), 1.0),
        "infra_error": F.when(~F.col("excluded") & (mode == "infra_error"), 1.0),
        "perfect": one(mode == "perfect"),
        "silent_failure": one(F.startswith(mode, F.lit("silent"))),
        "loud_failure": one(mode == "loud"),
        "usd": one(F.col("usd")),
        "output_tokens": one(F.col("tokens")),
        "source_bytes": one(F.col("bytes")),
        "truncated": one(F.col("truncated")),
        "redrawn": one(F.col("redrawn")),
        "reasoning_tokens": one(F.col("reasoning_tokens")),
        "purchase_unknown": F.when(scored & ~known, 1.0),
        "usd_purchase": F.when(known, F.col("bought_usd")),
        "seconds": F.when(known, F.col("bought_seconds").cast("double")),
        "ttft_s": F.when(known, F.col("bought_ttft_s").cast("double")),
        "tokens_per_s": F.when(known & (busy > 0), F.round(F.col("tokens") / busy, 1)),
    }
    each = F.array(*(F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in metrics.items()))
    return draws.select(*keys, "draw_id", F.explode(each).alias("m")).where("m.value is not null").select(*keys, "draw_id", "m.metric", "m.value")


def cell_summary(long: DataFrame, calls: DataFrame, keys: list[str], pooled: list[str]) -> DataFrame:
    """Each cell from the long table alone: rate and interval, shares, what its draws cost to buy and what this run paid, whether
    that was replayed, latencies by nearest rank, and the calls of ``pooled`` keys (``ok, usd``) with what the failed were billed.
    No cost for each success if none succeeded, nothing was paid or a purchase is unknown."""
    of = lambda m: F.when(F.col("metric") == m, F.col("value"))
    total = lambda m: F.coalesce(F.sum(of(m)), F.lit(0.0))
    at = lambda m, p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY CASE WHEN metric = '{m}' THEN value END)")
    d = long.groupBy(*keys).agg(
        total("attempted").cast("bigint").alias("attempted"), F.count(of("perfect")).alias("n"), total("perfect").cast("bigint").alias("k"),
        total("silent_failure").cast("bigint").alias("silent"), total("infra_error").cast("bigint").alias("infra"), total("excluded").cast("bigint").alias("excluded"),
        total("truncated").cast("bigint").alias("truncated"), total("redrawn").cast("bigint").alias("redrawn"), total("purchase_unknown").cast("bigint").alias("unpriced"),
        total("usd_purchase").alias("usd"), total("usd").alias("paid"), at("seconds", 0.5).alias("p50"), at("seconds", 0.95).alias("p95"), at("tokens_per_s", 0.5).alias("tokens_per_s"),
    )
    failed = F.when(F.col("ok") == 0, F.col("usd")).otherwise(0.0)
    c = calls.groupBy(*pooled).agg(F.count("*").alias("calls"), F.round(F.sum(failed), 6).alias("usd_failed"), F.round(1 - F.avg("ok"), 9).alias("error_rate"))
    w, s = stats.wilson(F.col("k"), F.col("n")), stats.wilson(F.col("silent"), F.col("n") - F.col("k"))
    per = F.when((F.col("k") > 0) & (F.col("usd") != 0) & (F.col("unpriced") == 0), F.round(F.col("usd") / F.col("k"), 6))
    fails = F.col("n") > F.col("k")
    d = d.select(
        *keys, "attempted", "n", "k", "silent", "infra", "excluded", "truncated", "redrawn", "unpriced", "p50", "p95", "tokens_per_s",
        F.round(F.try_divide("k", "n"), 9).alias("rate"), F.round(w["lo"], 4).alias("lo"), F.round(w["hi"], 4).alias("hi"),
        F.round("usd", 6).alias("usd"), F.round("paid", 6).alias("paid"), per.alias("usd_per_success"), ((F.col("usd") != 0) & (F.col("paid") < F.col("usd"))).alias("replayed"),
        F.round(F.try_divide("infra", F.col("n") + F.col("infra")), 9).alias("infra_rate"),
        F.when(fails, F.round(F.try_divide("silent", F.col("n") - F.col("k")), 4)).alias("silent_share"), F.when(fails, F.round(s["lo"], 4)).alias("silent_lo"),
    )
    return d.join(c, pooled, "left")
