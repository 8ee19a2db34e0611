"""The drift alarm: aggregates over records, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vocab

FIELDS = ("permit_kind", "work_class", "structure_type", "unit_count", "date_issued")


def null_rates(records: DataFrame) -> DataFrame:
    """Share of null or UNKNOWN by field and source."""
    unknown = {f: F.col(f).isNull() | (F.col(f).cast("string") == "UNKNOWN") for f in FIELDS}
    return records.groupBy("source_id").agg(F.count("*").alias("n"), *(F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4).alias(f) for f, c in unknown.items()))


def tripped(rates: DataFrame) -> DataFrame:
    """Fields at or above their level; a source without records trips none."""
    return rates.withColumn("tripped", F.array_compact(F.array(*(F.when((F.col("n") > 0) & (F.col(f) >= level), f) for f, level in vocab.ALARM_LEVELS.items()))))


def units_by_column(records: DataFrame) -> DataFrame:
    live = records.where("bps_column is not null and countable_units <> 0")
    implied = F.when(F.col("unit_count_source") == "implied_by_structure_code", F.col("countable_units")).otherwise(0)
    return live.groupBy("bps_column").agg(F.sum("countable_units").cast("bigint").alias("units"), F.sum(implied).cast("bigint").alias("implied"))


def qualified(records: DataFrame) -> DataFrame:
    """Sources whose units rest on the class names: wholly or for the most part."""
    implied = F.when(F.col("unit_count_source") == "implied_by_structure_code", F.col("countable_units")).otherwise(0)
    d = records.groupBy("source_id").agg(F.sum("countable_units").cast("bigint").alias("total"), F.sum(implied).cast("bigint").alias("implied"), F.count_if(F.col("permit_kind") == "UNKNOWN").alias("unknown_kind"))
    live = F.col("total") > 0
    return d.withColumn("qualified", F.when(live & (F.col("implied") == F.col("total")), "all-implied").when(live & (F.col("implied") >= 0.5 * F.col("total")), "mostly-implied"))
