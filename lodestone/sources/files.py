"""Readers and writers of the files that the engine exchanges: strict, explicit schemas, defined order."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField(c, T.StringType()) for c in ("fetched_at", "url", "final_url", "http_status", "content_type", "bytes", "sha256", "jurisdiction", "vendor", "page_type", "verdict", "verdict_reason", "request_method", "robots_ok", "file", "fp")])
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_LEDGER = (
    "at string, call_class string, tag string, model string, provider string, draw int, ok boolean, usd double, seconds double, stop_reason string, input_tokens bigint, output_tokens bigint, "
    "cache_read_input_tokens bigint, cache_creation_input_tokens bigint, usd_reported double, error_type string, status_code int, ttft_s double, protocol string, max_tokens bigint, reasoning string, "
    "reasoning_level string, temperature double, top_p double, host string, reasoning_tokens bigint, response_id string"
)
#: Built without a session, so that this module can be imported before there is one.
LEDGER = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in _LEDGER.split(", "))])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows with ``line``, their place in the file from 0; blank lines are skipped, unknown fields are an error.

    The file is one row for the reader, as a split would lose the count of lines: for ledgers, not for bulk data.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where(F.trim("value") != "")
    known = F.array(*(F.lit(f.name) for f in schema.fields))
    extra = F.array_except(F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>")), known)
    broken = F.json_object_keys("value").isNull()
    checked = F.when(broken, F.raise_error(F.concat(F.lit("not a JSON object in line "), F.col("line").cast("string")))).when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(extra, ", ")))).otherwise(F.col("value"))
    return lines.select("line", F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The call ledger; rows of before some fields existed get their meaning then."""
    d = read_jsonl(spark, path, LEDGER)
    return d.withColumns({"ok": F.coalesce("ok", F.lit(True)), "draw": F.coalesce("draw", F.lit(0))})


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=MANIFEST, enforceSchema=False, mode="FAILFAST", multiLine=True)


def migrate(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add missing columns as empty text; columns that the schema lost are an error."""
    lost = [c for c in df.columns if c not in schema.names]
    if lost:
        raise ValueError(f"columns would be lost: {', '.join(lost)}")
    return df.select(*(F.col(f.name) if f.name in df.columns else F.lit("").cast(f.dataType).alias(f.name) for f in schema.fields))


def read_api_records(df: DataFrame, body: str = "body") -> DataFrame:
    """``record`` (JSON text) of each record in a response: a list, or the first list of the usual envelopes; an error
    envelope raises.  ``more`` tells that the server cut the response."""
    elements = "array<string>"
    paths = ("$.results", "$.features", "$.data", "$.dataset")
    found = F.when(F.ltrim(body).startswith("["), F.from_json(F.col(body), elements))
    found = F.coalesce(found, *(F.from_json(F.when(F.get_json_object(body, p).startswith("["), F.get_json_object(body, p)), elements) for p in paths))
    error = F.get_json_object(body, "$.error")
    checked = F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("the endpoint answered an error: "), error)).cast(elements)).otherwise(found)
    more = F.coalesce(F.get_json_object(body, "$.exceededTransferLimit") == "true", F.lit(False))
    return df.select("*", more.alias("more"), F.explode_outer(checked).alias("record")).withColumn("record", F.coalesce(F.get_json_object("record", "$.attributes"), "record"))


def read_cells(spark: SparkSession, path: str, cell: T.DataType) -> DataFrame:
    """``key, cell`` of a JSON document that maps keys to cells."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", T.MapType(T.StringType(), cell), {"mode": "FAILFAST"})).alias("key", "cell"))


def read_months(spark: SparkSession, path: str) -> DataFrame:
    """A control total by fixed positions; lines whose date is no number are dropped, junk counts are zero."""
    c = F.split("value", ",")
    n = lambda i: F.coalesce(F.trim(F.get(c, F.lit(i))).try_cast("bigint"), F.lit(0)).alias
    d = spark.read.text(path).where(F.trim(F.get(c, F.lit(0))).rlike(r"^\d+$"))
    text = lambda i, name: F.trim(F.get(c, F.lit(i))).alias(name)
    return d.select(text(0, "survey_date"), text(1, "state"), text(2, "bps_id"), text(15, "source"), text(16, "place_name"), n(18)("u1"), n(21)("u2"), n(24)("u34"), n(27)("u5p"))


def corpus(manifest: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct files of good index pages, in order."""
    good = (F.col("http_status") == "200") & (F.col("verdict") == "ok") & F.col("page_type").endswith("INDEX") & F.col("file").startswith(prefix)
    return manifest.where(good).select("file").distinct().orderBy("file")


def current_state(manifest: DataFrame, order: str) -> DataFrame:
    """The last row of each file."""
    w = Window.partitionBy("file").orderBy(F.desc(order))
    return manifest.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def write_records(df: DataFrame, violations: str, path: str) -> int:
    """Write the valid records as JSON lines with sorted keys; returns how many were rejected."""
    cols = sorted(c for c in df.columns if c != violations)
    ok = df.where(F.size(violations) == 0).select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))
    ok.write.mode("append").text(path)
    return df.where(F.size(violations) > 0).count()


def append_jsonl(rows: DataFrame, path: str, order: list[str]) -> None:
    """Append rows as JSON lines with sorted keys; nulls stay out, as readers give them their meaning.  Each call adds files
    of its own by Spark's commit, so writers do not wait for each other and none leaves half a line."""
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    lines.write.mode("append").text(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append captures to a manifest, every column as text and in the order of its schema, with a header a file."""
    migrate(rows, MANIFEST).write.mode("append").option("header", True).csv(path)


def replay(manifest: DataFrame, pages: DataFrame, jurisdiction: str, page_type: str, complete: Column) -> DataFrame:
    """Stored pages in the order they were fetched, with ``ordinal``: those of one source and type that were not rejected
    and that say themselves to be ``complete``."""
    chosen = (F.col("jurisdiction") == jurisdiction) & (F.col("page_type") == page_type) & (F.coalesce("verdict", F.lit("")) != "rejected")
    d = manifest.where(chosen).select("file", "fetched_at").join(pages, "file").where(complete)
    # a source's pages of one type are some thousands
    return d.withColumn("ordinal", F.row_number().over(Window.partitionBy(F.lit(jurisdiction)).orderBy("fetched_at", "file")))


def paged(spark: SparkSession, fetch: Callable[[int, int], list[str]], size: int, most: int = 12) -> DataFrame:
    """``page, record`` (JSON text) of a source that answers in pages: until a page is not full, or ``most`` pages."""
    rows: list[tuple[int, str]] = []
    for page in range(most):
        found = fetch(page * size, size)
        rows += [(page, r) for r in found]
        if len(found) < size:
            break
    return spark.createDataFrame(rows, "page int, record string")


def socrata_aggregate(sums: list[str], group: list[str], where: str = "") -> dict[str, str]:
    """Parameters of a request in which the server counts and sums by group."""
    select = [*group, "count(1) AS n", *(f"sum({c}) AS {c}" for c in sums)]
    return {"$select": ", ".join(select), "$group": ", ".join(group)} | ({"$where": where} if where else {})


def arcgis_aggregate(id_field: str, sums: list[str], group: list[str], where: str = "1=1") -> dict[str, str]:
    each = [("count", id_field, "n"), *(("sum", c, c) for c in sums)]
    statistics = [{"statisticType": t, "onStatisticField": f, "outStatisticFieldName": n} for t, f, n in each]
    return {"where": where, "outStatistics": json.dumps(statistics), "groupByFieldsForStatistics": ",".join(group), "f": "json"}


def merged(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows replaced or added by key; a null key is a key like any other."""
    own = changes.select(F.col(key).alias("__key"))
    return old.join(own, old[key].eqNullSafe(F.col("__key")), "left_anti").unionByName(changes)


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str) -> None:
    """Replace or add rows by key in a Parquet table; readers see the old or the new table, as folders are renamed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(conf)
    tag = uuid.uuid4().hex
    if not fs.exists(at(path)):  # a run that ended between the two renames left the old table aside
        aside = [s.getPath() for s in fs.globStatus(at(f"{path}-*-old")) or []]
        if aside:
            fs.rename(aside[0], at(path))
    old = merged(spark.read.parquet(path), changes, key) if fs.exists(at(path)) else changes
    old.write.parquet(f"{path}-{tag}")
    if fs.exists(at(path)):
        fs.rename(at(path), at(f"{path}-{tag}-old"))
    fs.rename(at(f"{path}-{tag}"), at(path))
    fs.delete(at(f"{path}-{tag}-old"), True)


def write_export(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report as JSON lines, keys and rows sorted, so a second run writes the same bytes."""
    df.orderBy(*order).select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sample_schema(record: dict) -> T.StructType:
    """All-text schema of an example record, for sources that publish none."""
    return T.StructType([T.StructField(k, T.StringType()) for k in json.loads(json.dumps(record))])
