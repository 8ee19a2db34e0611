"""Permit rows to canonical records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import classify, text, vocab


def once(df: DataFrame, columns: dict) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator keeps them from being copied into each later
    expression and filter, where they would be computed again and swell the generated code."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*(v.alias(c) for c, v in columns.items()))))
    return df.select("*", made.alias("__once")).select(*kept, *(F.col(f"__once.{c}").alias(c) for c in columns))


def identity_gate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with an identifier, and those without; a row without an office is an error."""
    office = F.when(F.col("source_id").isNull(), F.raise_error(F.lit("a row names no office"))).otherwise(F.col("source_id"))
    rows = rows.withColumn("source_id", office)
    blank = F.coalesce(F.trim("native_id"), F.lit("")) == ""
    return rows.where(~blank), rows.where(blank)


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order; a plain drop of duplicates would keep any."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def by_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Exact look-up of the trimmed upper-cased code; variants such as 329 and 329E never merge."""
    key = F.upper(F.trim("code"))
    return rows.join(codes, key == F.col("code_key"), "left").withColumn("rule", F.when(F.col("code_key").isNotNull(), F.concat(F.lit("code:"), "code_key")))


def milestones(rows: DataFrame, dates: dict[str, str] | None = None) -> DataFrame:
    """``milestones`` of the columns that ``dates`` names by milestone: those that can be read as a date, in the order of
    the vocabulary.  A name that is not in the vocabulary raises."""
    dates = {"issued": "issued"} if dates is None else dates
    if unknown := [m for m in dates if m not in vocab.MILESTONES]:
        raise ValueError(f"not a milestone: {', '.join(unknown)}")
    each = [F.struct(F.lit(m).alias("milestone"), text.norm_date(F.col(dates[m])).alias("reported_date"), F.col(dates[m]).alias("native_string")) for m in vocab.MILESTONES if m in dates]
    return rows.withColumn("milestones", F.filter(F.array(*each), lambda m: m["reported_date"].isNotNull()))


def reported(milestone: str):
    """The date of the first such milestone of a record."""
    return F.try_element_at(F.filter("milestones", lambda m: m["milestone"] == milestone), F.lit(1))["reported_date"]


def _countable(units, source):
    live = (F.col("permit_kind") == "BUILDING") & (F.col("work_class") == "NEW") & (source != "absent") & units.isNotNull()
    return F.when(live, units).otherwise(F.lit(0))


def build(rows: DataFrame) -> DataFrame:
    """Open-data rows: the units field, else the description, then refinement by the count."""
    ok, _ = identity_gate(rows)
    field, described = text.norm_int(F.col("units_raw")), classify.units_from_text(F.col("description"))["units"]
    d = once(ok, {"s": classify.structure(F.col("type_text")), "w": classify.work(F.col("work_text")), "kd": classify.kind(F.col("kind_text")), "fu": field, "tu": described, "date_issued": text.norm_date(F.col("issued"))})
    d = d.withColumns(
        {
            "permit_kind": F.col("kd.value"),
            "work_class": F.col("w.value"),
            "unit_count": F.coalesce("fu", F.col("tu").cast("bigint")),
            "unit_count_source": F.when(F.col("fu").isNotNull(), "field").when(F.col("tu").isNotNull(), "parsed_from_text").otherwise("absent"),
        }
    )
    d = d.withColumn("structure_type", classify.refine(F.col("s.value"), F.col("unit_count"), F.col("work_class"))["value"])
    d = d.withColumns(
        {
            "bps_column": classify.bps_column(F.col("structure_type")),
            "countable_units": _countable(F.col("unit_count"), F.col("unit_count_source")),
            "observation_key": F.concat_ws("|", "source_id", "native_id"),
        }
    )
    return d.drop("s", "w", "kd", "fu", "tu")


def _with_counts(d: DataFrame) -> DataFrame:
    """``bps_column`` and both countable counts of rows that are classified and counted."""
    d = d.withColumns({"bps_column": classify.bps_column(F.col("structure_type")), "countable_units": _countable(F.col("unit_count"), F.col("unit_count_source"))})
    return d.withColumn("countable_units_measured", F.when(F.col("unit_count_source") == "implied_by_structure_code", 0).otherwise(F.col("countable_units")))


def build_controlled(rows: DataFrame) -> DataFrame:
    """Rows whose type column is the only controlled one, so it alone is classified: units of the description, which may
    refine the class, else those that the class implies."""
    ok, _ = identity_gate(rows)
    kind_, work_, units = classify.kind(F.col("type_text")), classify.work(F.col("type_text")), classify.units_from_text(F.col("description"))
    d = once(ok, {"s": classify.structure(F.col("type_text")), "work_class": work_["value"], "permit_kind": kind_["value"], "tu": units["units"]})
    d = d.withColumn("structure_type", classify.refine(F.col("s.value"), F.col("tu"), F.col("work_class"))["value"])
    d = d.withColumn("iu", F.when(F.col("tu").isNull(), classify.imply_units(F.col("structure_type"), F.col("work_class"), F.col("s.rule"), F.lit(True))["units"]))
    source = F.when(F.col("tu").isNotNull(), "parsed_from_text").when(F.col("iu").isNotNull(), "implied_by_structure_code").otherwise("absent")
    return _with_counts(d.withColumns({"unit_count": F.coalesce("tu", "iu"), "unit_count_source": source})).drop("s", "tu", "iu")


def build_by_code(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose code the publisher's own legend explains.  An unknown code leaves the kind unknown and the units absent;
    a code that the legend excludes gives no units."""
    ok, _ = identity_gate(rows)
    d = by_code(ok, codes)
    units = F.when(F.col("exclude").isNull(), F.col("units"))
    d = d.withColumns(
        {
            "permit_kind": F.coalesce("kind", F.lit("UNKNOWN")),
            "work_class": F.coalesce("work", F.lit("UNKNOWN")),
            "structure_type": F.col("structure"),
            "unit_count": units,
            "unit_count_source": F.when(units.isNotNull(), "implied_by_structure_code").otherwise("absent"),
        }
    )
    return _with_counts(d)


#: The columns of a record, in order (fixed values).
RECORD = (
    "observation_key", "source_id", "state_fips", "bps_id", "native_id", "platform", "permit_kind", "work_class", "structure_type",
    "bps_column", "unit_count", "unit_count_source", "countable_units", "countable_units_measured", "valuation", "address",
    "description", "milestones", "date_applied", "date_issued", "observed_at", "native", "content_hash", "extractor_version", "schema_version",
)


def as_records(built: DataFrame, platform: str, version: str, dates: dict[str, str], native: tuple[str, ...], schema_version: str = "step1.1") -> DataFrame:
    """Built rows in the whole record schema; ``native`` names the columns that are kept as they came."""
    d = milestones(_with_counts(built), dates)
    kept = F.map_filter(F.create_map(*(x for c in native for x in (F.lit(c), F.col(c).cast("string")))), lambda _, v: v.isNotNull())
    missing = {c: F.lit(None).cast("string") for c in ("address", "observed_at", "content_hash") if c not in d.columns}
    d = d.withColumns(
        missing
        | {
            "observation_key": F.concat_ws("|", "source_id", "native_id"),
            "platform": F.lit(platform),
            "description": text.norm_text(F.col("description")),
            "valuation": F.col("valuation").cast("double"),
            "unit_count": F.col("unit_count").cast("int"),
            "countable_units": F.col("countable_units").cast("int"),
            "countable_units_measured": F.col("countable_units_measured").cast("int"),
            "date_applied": reported("applied"),
            "date_issued": reported("issued"),
            "native": F.when(F.size(kept) > 0, kept),
            "extractor_version": F.lit(version),
            "schema_version": F.lit(schema_version),
        }
    )
    return d.select(*RECORD)


def validate(records: DataFrame) -> DataFrame:
    """``violations`` of each record; empty if it may be written."""
    implied = F.col("unit_count_source") == "implied_by_structure_code"
    class_count = F.when(F.col("structure_type").isin("101", "102"), 1).when(F.col("structure_type") == "103", 2)
    checks = {
        "unknown-source": ~F.col("unit_count_source").isin(*vocab.UNIT_SOURCES),
        "absent-with-count": (F.col("unit_count_source") == "absent") & F.col("unit_count").isNotNull(),
        "stated-without-count": (F.col("unit_count_source") != "absent") & F.col("unit_count").isNull(),
        "unknown-class": ~F.col("structure_type").isin(*vocab.STRUCTURE_CLASSES),
        "negative-units": F.col("unit_count") < 0,
        "implied-differs": implied & F.coalesce(class_count != F.col("unit_count"), F.lit(True)),
    }
    return records.withColumn("violations", F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items()))))


def unmapped(rows: DataFrame, top: int) -> DataFrame:
    """Texts that no rule took, by axis: the ``top`` most frequent and the total."""
    axes = F.array(
        *(
            F.when(r["rule"].isNull() & (F.col(c) != ""), F.concat(F.lit(f"{axis}: "), F.substr(F.col(c), F.lit(1), F.lit(70))))
            for axis, c, r in (("structure", "type_text", classify.structure(F.col("type_text"))), ("work", "work_text", classify.work(F.col("work_text"))), ("kind", "kind_text", classify.kind(F.col("kind_text"))))
        )
    )
    counts = rows.select(F.explode(F.array_compact(axes)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy())).orderBy(F.desc("n"), "key").limit(top)


def coverage(rows: DataFrame) -> DataFrame:
    d = rows.select("source_id", classify.structure(F.col("type_text"))["value"].alias("s"), classify.work(F.col("work_text"))["value"].alias("w"), classify.kind(F.col("kind_text"))["value"].alias("kd"))
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    known = (F.col("w") == "NEW") & (F.col("kd") == "BUILDING") & F.col("s").isNotNull()
    return d.groupBy("source_id").agg(F.count("*").alias("n"), share(F.col("s").isNotNull()).alias("structure"), share(F.col("w") != "UNKNOWN").alias("work"), share(F.col("kd") != "UNKNOWN").alias("kind"), F.sum(known.cast("int")).alias("joint"))
