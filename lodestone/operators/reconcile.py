"""Folded unit counts against a control total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import measures


def month_fold(records: DataFrame) -> DataFrame:
    """Units by column, permits and unclassified new buildings, by source and month of issue."""
    of = lambda c: F.sum(F.when(F.col("bps_column") == c, F.col("countable_units")).otherwise(0)).cast("bigint")
    lost = F.count_if((F.col("work_class") == "NEW") & (F.col("permit_kind") == "BUILDING") & F.col("bps_column").isNull())
    d = records.where("date_issued is not null").withColumn("yymm", text.yymm(F.col("date_issued")))
    return d.groupBy("source_id", "yymm").agg(F.count("*").alias("n"), of("u1").alias("a1"), of("u2").alias("a2"), of("u34").alias("a34"), of("u5p").alias("a5p"), of("low_bundle").alias("ab"), lost.alias("unclassified"))


def _error(a, r):
    return F.round(F.try_divide(100.0 * F.abs(a - r), r), 6)


def reconcile(fold: DataFrame, months: DataFrame) -> DataFrame:
    """Absolute error in percent by office and usable month; a control of zero gives none."""
    j = fold.join(months.where("usable = 'Y'"), ["source_id", "yymm"])
    col = F.col
    low, ref_low = col("a1") + col("a2") + col("a34") + col("ab"), col("u1") + col("u2") + col("u34")
    d = j.select("source_id", "yymm", (low + col("a5p")).alias("admin_total"), (ref_low + col("u5p")).cast("bigint").alias("ref_total"), low.alias("low"), ref_low.alias("ref_low"), "a5p", "u5p")
    return d.select("source_id", "yymm", "admin_total", "ref_total", _error(col("admin_total"), col("ref_total")).alias("err_total"), _error(col("low"), col("ref_low")).alias("err_low"), _error(col("a5p"), col("u5p")).alias("err_5p"))


def dropped_months(months: DataFrame) -> DataFrame:
    return months.where("usable <> 'Y'").groupBy("source_id").agg(F.count("*").alias("dropped"))


def median_error(errors: DataFrame) -> DataFrame:
    return measures.ranked(errors, "source_id", "err_low", {"median_low": measures.upper_half()})


def identity_check(claims: DataFrame, offices: DataFrame) -> DataFrame:
    """A key must resolve and the name agree."""
    j = claims.join(offices, F.col("key") == F.col("office_key"), "left")
    return j.withColumn("status", F.when(F.col("office_key").isNull(), "unresolved").when(text.norm_name(F.col("name")) == text.norm_name(F.col("office_name")), "ok").otherwise("name-differs"))


def week_windows(months: DataFrame) -> DataFrame:
    """Seven-day windows from the first of each month, clipped to it."""
    d = months.withColumn("lo", F.explode(F.sequence("month_start", F.last_day("month_start"), F.expr("interval 7 days"))))
    return d.withColumn("hi", F.least(F.date_add("lo", 6), F.last_day("month_start")))


def override(base: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Values of ``changes`` over those of ``base``; a change without a base row is an error."""
    c = changes.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
    j = base.join(c, F.col(key) == F.col("__k"), "full_outer")
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit("an override matches no row")).cast("string")).otherwise(F.coalesce("__v", column))
    return j.select(key, checked.alias(column))


def coverage_shares(rows: DataFrame, bucket: str, weight: str) -> DataFrame:
    """Percent by bucket, weighted and counted; totals are one row, not a window over the rows."""
    d = rows.groupBy(bucket).agg(F.count("*").alias("offices"), F.sum(weight).alias("w"))
    total = d.agg(F.sum("w").alias("tw"), F.sum("offices").alias("tn"))
    return d.crossJoin(F.broadcast(total)).select(bucket, "offices", F.round(F.try_divide(100.0 * F.col("w"), F.col("tw")), 6).alias("weighted"), F.round(100.0 * F.col("offices") / F.col("tn"), 6).alias("counted"))
