"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null document id wherever ids are join keys.
NULL_ID = -(2**63)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests, a laptop) gets a folder of its own; on a cluster it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        where = f"file://{tempfile.mkdtemp(prefix='lodestone-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._lodestone_path = path
    return stored


def release(spark: SparkSession, *stored: DataFrame) -> None:
    """Delete tables that ``materialize`` stored and nothing reads any more, and let the driver collect its garbage, for
    only then does Spark remove the shuffle files of queries that are done."""
    for df in stored:
        drop_path(spark, df._lodestone_path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """An eager ``checkpoint()`` in the shared folder; for small tables that loops go over."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  ``lower`` does just that on pure ASCII and is much faster than ``translate``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def doc_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns ``k1``, ``k2`` that identify a row's document: its id (nulls included) and a hash of its text.

    Rows that repeat an id with another text stay apart; wholly repeated rows share a key and get the same result.
    """
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("\x00null"))).alias("k2"),
    ]


def process_cache(name: str, make: Callable[[], object]) -> object:
    """One object for each Python process.  Functions are shipped by value, so module globals would not outlive a task."""
    holder = sys.modules.setdefault("_lodestone_process_cache", types.ModuleType("_lodestone_process_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row: a generator keeps it from being copied into later lambdas, where
    it would be computed again for each element."""
    return df.select("*", F.explode(F.array(F.struct(value.alias("v")))).alias("__once")).select("*", F.col("__once.v").alias(name)).drop("__once")


#: Tables of fixed-width columns are broadcast up to this size, which is measured; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def small_side(df: DataFrame, label: str) -> tuple[DataFrame, bool]:
    """``df`` of fixed-width columns, stored; marked for a broadcast if its rows are measured to be few enough."""
    df = materialize(df, label)
    few = df.count() * (16 + 8 * len(df.columns)) <= BROADCAST_BYTES
    return (F.broadcast(df) if few else df), few


def docs_without_losers(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the documents ``doc_id, k1, k2`` that are not the first of their ``group``."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "k1", "k2")
    firsts = rows.groupBy("group").agg(F.min(place).alias("first"))
    losers, _ = small_side(rows.join(firsts, "group").where(place != F.col("first")).select("k1", "k2").distinct(), "losers")
    k = doc_key(docs)
    keyed = docs.select("*", k[0].alias("__k1"), k[1].alias("__k2"))
    return keyed.join(losers, (F.col("__k1") == F.col("k1")) & (F.col("__k2") == F.col("k2")), "left_anti").drop("__k1", "__k2")


def small_enough(df: DataFrame, column: str, limit_bytes: int) -> bool:
    """Whether the whole of ``column`` is at most ``limit_bytes``; measured, not estimated."""
    n = df.agg(F.sum(F.octet_length(F.col(column)) + F.lit(16)).alias("n")).first()["n"]
    return (n or 0) <= limit_bytes
