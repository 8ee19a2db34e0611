"""Candidate rows against reference rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text


def _side(rows: DataFrame, fields: list[str], prefix: str) -> DataFrame:
    """First row of each page and normalized id; rows without an id are dropped."""
    d = rows.select("page", text.norm_cell(F.col("id")).alias("id"), "ord", *(text.norm_cell(F.col(f)).alias(f"{prefix}_{f}") for f in fields)).where("id is not null")
    w = Window.partitionBy("page", "id").orderBy("ord")
    return d.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "ord").withColumn(f"{prefix}_has", F.lit(True))


def compare(reference: DataFrame, candidate: DataFrame, fields: list[str]) -> DataFrame:
    """Full outer comparison by page and id."""
    j = _side(reference, fields, "ref").join(_side(candidate, fields, "cand"), ["page", "id"], "full_outer")
    return j.withColumns({"in_ref": F.coalesce("ref_has", F.lit(False)), "in_cand": F.coalesce("cand_has", F.lit(False))})


def score(compared: DataFrame, limit: int = 40) -> DataFrame:
    """Recall and precision by page, null without a denominator; missed and spurious ids, at most ``limit`` are shown."""
    hit = F.count_if(F.col("in_ref") & F.col("in_cand"))
    d = compared.groupBy("page").agg(
        F.count_if("in_ref").alias("n_ref"), F.count_if("in_cand").alias("n_cand"), hit.alias("matched"),
        F.array_sort(F.collect_list(F.when(F.col("in_ref") & ~F.col("in_cand"), F.col("id")))).alias("missed"),
        F.array_sort(F.collect_list(F.when(~F.col("in_ref") & F.col("in_cand"), F.col("id")))).alias("spurious"),
    )
    shown = lambda c: F.slice(c, 1, limit)
    return d.select("page", "n_ref", "n_cand", "matched", F.round(F.try_divide("matched", "n_ref"), 6).alias("recall"), F.round(F.try_divide("matched", "n_cand"), 6).alias("precision"), shown("missed").alias("missed"), shown("spurious").alias("spurious"))


def field_agreement(compared: DataFrame, fields: list[str]) -> DataFrame:
    """Agreement by field over rows on both sides; both null is no comparison."""
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"ref_{f}").alias("a"), F.col(f"cand_{f}").alias("b")) for f in fields))
    d = compared.where("in_ref and in_cand").select(F.explode(each).alias("x")).select("x.*").where("a is not null or b is not null")
    agree = F.count_if(F.col("a").eqNullSafe(F.col("b")))
    return d.groupBy("field").agg(agree.alias("agree"), F.count("*").alias("compared"), F.round(agree / F.count("*"), 6).alias("rate"))


def perfect(scores: DataFrame) -> DataFrame:
    return scores.agg(F.min(F.coalesce("recall", F.lit(0.0))).alias("recall_min"), F.min(F.coalesce("precision", F.lit(0.0))).alias("precision_min")).withColumn("perfect", (F.col("recall_min") == 1) & (F.col("precision_min") == 1))
