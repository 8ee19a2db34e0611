"""Streaming forms of the drift alarm and of the observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.quality import FIELDS


def null_rates(records: DataFrame) -> DataFrame:
    """Running null rates by source, for update mode; the same sums as in batch."""
    unknown = {f: F.col(f).isNull() | (F.col(f).cast("string") == "UNKNOWN") for f in FIELDS}
    return records.groupBy("source_id").agg(F.count("*").alias("n"), *(F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4).alias(f) for f, c in unknown.items()))


def daily_rates(records: DataFrame, time: str = "observed_at", late: str = "2 days") -> DataFrame:
    """Null rates by source and day of observation; days close once the watermark passes them, so state is bounded."""
    share = {f: F.avg(F.when(F.col(f).isNull() | (F.col(f).cast("string") == "UNKNOWN"), 1.0).otherwise(0.0)) for f in FIELDS}
    d = records.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("day"), "source_id")
    return d.agg(F.count("*").alias("n"), *(F.round(s, 4).alias(f) for f, s in share.items()))


def latest(log: DataFrame) -> DataFrame:
    """The last milestone of each entity by sequence number, for update mode."""
    return log.groupBy("entity").agg(F.max_by("milestone", "seq").alias("milestone"), F.max("seq").alias("seq"))
