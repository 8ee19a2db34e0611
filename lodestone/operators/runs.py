"""Whole runs, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import grids, stats
from lodestone.operators import quality, reconcile, records
from lodestone.sources import files


def rebuild(manifest: DataFrame, pages: DataFrame, codes: DataFrame, office: dict[str, str], jurisdiction: str, page_type: str, complete: Column) -> DataFrame:
    """Records from stored pages: replayed in order, parsed by position, the first row of each number kept, classified by
    the publisher's own codes."""
    stored = files.replay(manifest, pages, jurisdiction, page_type, complete).select("ordinal", "html")
    columns, headers = ("number", "address", "propuse", "issued", "contractor"), ("permitno", "addr", "propuse", "issue", "contractor")
    rows = grids.position_rows(stored, columns, headers)
    rows = records.first_by(rows, ["number"], ["ordinal", "address"])
    named = rows.select(F.col("number").alias("native_id"), F.col("propuse").alias("code"), "address", "issued", *(F.lit(v).alias(k) for k, v in office.items()))
    return records.build_by_code(named, codes)


def step_reconcile(built: DataFrame, months: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Errors by office and month, and for each source whether it may be quoted: a tripped source gives no figure, and one
    whose units are implied gives one that never enters the headline."""
    rates = quality.null_rates(built)
    tripped = quality.tripped(rates).select("source_id", F.size("tripped").alias("n_tripped"))
    qualified = quality.qualified(built).select("source_id", "qualified")
    state = tripped.join(qualified, "source_id", "left").select("source_id", F.when(F.col("n_tripped") > 0, "blocked").when(F.col("qualified").isNotNull(), "qualified").otherwise("headline").alias("state"))
    errors = reconcile.reconcile(reconcile.month_fold(built), months)
    return errors.join(state.where("state <> 'blocked'"), "source_id"), state


def export_rows(draws: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """The results file: a line for each cell with its rate, interval, spend and hosts, keys and rows in order."""
    d = draws.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("perfect").alias("k"), F.round(F.sum("usd"), 6).alias("usd"))
    w = stats.wilson(F.col("k"), F.col("n"))
    hosts = ledger.groupBy(*keys).agg(F.array_sort(F.collect_set("host")).alias("hosts"))
    return d.select(*keys, "n", "k", "usd", F.round(w["lo"], 4).alias("lo"), F.round(w["hi"], 4).alias("hi")).join(hosts, keys, "left")


def rescored(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """What changes when draws are scored again: every key of either side whose value differs, with both values."""
    a, b = before.select(key, F.col(value).alias("was")), after.select(key, F.col(value).alias("now"))
    return a.join(b, key, "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select(key, "was", "now", F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed").alias("change"))
