"""Normalization, classification, records, alarm and reconciliation over permit rows derived from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify, text, vocab
from lodestone.operators import quality, reconcile, records
from lodestone.plans.base import frame, register

ISO = "concat(CAST(year(o_orderdate) AS STRING), '-', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '-', lpad(CAST(day(o_orderdate) AS STRING), 2, '0'))"
MON = f"substr('{vocab.MONTHS}', CAST(month(o_orderdate) AS INT) * 3 - 2, 3)"
#: One permit row for each order: identifiers stay text, dates come in many shapes, types from published examples.
PERMITS = f"""
SELECT o_orderkey AS k, n_name AS source_id, lpad(CAST(n_nationkey AS STRING), 2, '0') AS state_fips, CAST(n_nationkey * 1000 AS STRING) AS bps_id,
  CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE CAST(o_orderkey AS STRING) END AS native_id,
  CASE o_orderkey % 11
    WHEN 0 THEN {ISO} WHEN 1 THEN concat(substr({ISO}, 6, 2), '/', substr({ISO}, 9, 2), '/', substr({ISO}, 1, 4))
    WHEN 2 THEN concat(CAST(month(o_orderdate) AS STRING), '/', CAST(day(o_orderdate) AS STRING), '/', substr({ISO}, 1, 4), ' 11:06:49 PM')
    WHEN 3 THEN replace({ISO}, '-', '/') WHEN 4 THEN concat(substr({ISO}, 9, 2), '-', {MON}, '-', substr({ISO}, 1, 4))
    WHEN 5 THEN concat(substr({ISO}, 6, 5), '-', substr({ISO}, 1, 4)) WHEN 6 THEN concat({ISO}, 'T00:00:00')
    WHEN 7 THEN concat({MON}, ' ', substr({ISO}, 9, 2), ', ', substr({ISO}, 1, 4)) WHEN 8 THEN concat('  ', {ISO}, '  ')
    WHEN 9 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE {ISO} END ELSE concat({ISO}, ' 14:30:00') END AS issued,
  {ISO} AS true_iso,
  CASE o_orderkey % 13
    WHEN 0 THEN 'R- 101 Single Family Houses' WHEN 1 THEN 'C- 105 Five or More Family Bldgs' WHEN 2 THEN 'R- 103 Two Family Bldgs'
    WHEN 3 THEN '1,2,3 Family - New Structure' WHEN 4 THEN 'Single Family/Duplex' WHEN 5 THEN 'C-1000' WHEN 6 THEN 'R- 435 Re-Roof'
    WHEN 7 THEN 'Townhouse' WHEN 8 THEN 'Apartment building' WHEN 9 THEN 'Triplex' WHEN 10 THEN 'Detached Dwelling' WHEN 11 THEN '' ELSE 'Duplex' END AS type_text,
  CASE o_custkey % 7 WHEN 0 THEN 'New Construction' WHEN 1 THEN 'Interior remodel' WHEN 2 THEN 'Addition' WHEN 3 THEN 'NEW SFR' WHEN 4 THEN 'Demolition' WHEN 5 THEN '1,2,3 Family - Other' ELSE 'New building' END AS work_text,
  CASE o_orderkey % 9 WHEN 0 THEN 'BP' WHEN 1 THEN 'EP' WHEN 2 THEN 'Building Permit' WHEN 3 THEN 'Residential bldg' WHEN 4 THEN 'Sign permit' WHEN 5 THEN '' WHEN 6 THEN ' bp ' WHEN 7 THEN 'HVAC' ELSE 'Building' END AS kind_text,
  CASE o_custkey % 8 WHEN 0 THEN '1,200' WHEN 1 THEN '' WHEN 2 THEN '2 units' WHEN 3 THEN 'none' WHEN 4 THEN '4' WHEN 5 THEN '0' WHEN 6 THEN '-3' ELSE '1' END AS units_raw,
  CASE o_orderkey % 5 WHEN 0 THEN 'Multifamily, Apt / Twnhome > 5 Unit Bldg' WHEN 1 THEN 'Duplex - 2 Unit Bldg' WHEN 2 THEN 'Apartment 24 Unit Building' WHEN 3 THEN 'Single Family Residence' ELSE '12 or more units' END AS description,
  CASE o_orderkey % 6 WHEN 0 THEN '329' WHEN 1 THEN '329e' WHEN 2 THEN ' 101 ' WHEN 3 THEN '329X' WHEN 4 THEN '' ELSE '105' END AS code,
  o_totalprice AS valuation
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
#: Months of a control total, one row for each office: counted apart from the permits.
OFFICE_MONTHS = """
SELECT n_name AS source_id, concat(substr(CAST(year(o_orderdate) AS STRING), 3, 2), lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) AS yymm,
  CASE WHEN (n_nationkey + month(o_orderdate)) % 9 = 0 THEN 'N' ELSE 'Y' END AS usable,
  sum(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END) AS u1, sum(CASE WHEN o_orderkey % 8 = 1 THEN 2 ELSE 0 END) AS u2,
  sum(CASE WHEN o_orderkey % 16 = 3 THEN 4 ELSE 0 END) AS u34, sum(CASE WHEN o_orderkey % 8 = 5 THEN 9 ELSE 0 END) AS u5p
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
GROUP BY n_name, n_nationkey, year(o_orderdate), month(o_orderdate)
"""
P = f"p AS ({PERMITS})"


def permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, PERMITS)


# ---- B: normalization
TRIMMED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SQUASH = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _dates(x: str) -> str:
    h1, h2 = rf"regexp_extract({TRIMMED.format(x)}, '^\S+')", f"substr({TRIMMED.format(x)}, 1, 19)"
    tries = []
    for h in (h1, h2):
        for w, f in ((10, "%Y-%m-%d"), (10, "%m/%d/%Y"), (10, "%Y/%m/%d"), (11, "%d-%b-%Y"), (10, "%m-%d-%Y"), (19, "%Y-%m-%dT%H:%M:%S"), (19, "%Y-%m-%d %H:%M:%S"), (12, "%b %d, %Y")):
            tries.append(f"try_strptime(substr({h}, 1, {w}), '{f}')")
        tries.append(f"try_strptime({h}, '%m/%d/%Y')")
    return f"strftime(coalesce({', '.join(tries)}), '%Y-%m-%d')"


INT = r"TRY_CAST(replace(regexp_extract({0}, '-?\d[\d,]*'), ',', '') AS BIGINT)"


@register("b01_norm_text", rf"WITH {P} SELECT k, nullif({SQUASH.format('concat(type_text, chr(10), chr(9), work_text)')}, '') AS v FROM p")
def norm_text(spark, sf_dir):
    return permits(spark, sf_dir).select("k", text.norm_text(F.concat("type_text", F.lit("\n\t"), "work_text")).alias("v"))


@register("b02_norm_int", f"WITH {P} SELECT k, {INT.format('units_raw')} AS v FROM p")
def norm_int(spark, sf_dir):
    return permits(spark, sf_dir).select("k", text.norm_int(F.col("units_raw")).alias("v"))


@register("b03_norm_date", f"WITH {P} SELECT k, CASE WHEN k % 11 = 9 AND k % 3 = 0 THEN NULL ELSE true_iso END AS v, CASE WHEN k % 11 = 9 AND k % 3 = 0 THEN NULL ELSE concat(substr(true_iso, 3, 2), substr(true_iso, 6, 2)) END AS yymm FROM p")
def norm_date(spark, sf_dir):
    """The oracle is the date that the rendered text came from."""
    v = text.norm_date(F.col("issued"))
    return permits(spark, sf_dir).select("k", v.alias("v")).withColumn("yymm", text.yymm(F.col("v")))


@register("b03_norm_date_formats", f"WITH {P} SELECT k, {_dates('issued')} AS v FROM p")
def norm_date_formats(spark, sf_dir):
    return permits(spark, sf_dir).select("k", text.norm_date(F.col("issued")).alias("v"))


@register("b04_content_hash", f"WITH {P} SELECT k, sha256(concat(source_id, '|', native_id)) AS v FROM p")
def content_hash(spark, sf_dir):
    return permits(spark, sf_dir).select("k", text.content_hash(F.concat_ws("|", "source_id", "native_id")).alias("v"))


@register("b07_fragment_text", rf"SELECT page_id, {SQUASH.format("""replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' ')""")} AS v FROM pages")
def fragment_text(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT page_id, html FROM pages").select("page_id", text.fragment_text(F.col("html")).alias("v"))


@register("b10_name_key", rf"WITH {P} SELECT DISTINCT source_id, lower({SQUASH.format('source_id')}) AS name_key, CASE WHEN length(CAST(CAST(state_fips AS INT) AS VARCHAR)) < 2 THEN lpad(CAST(CAST(state_fips AS INT) AS VARCHAR), 2, '0') ELSE CAST(CAST(state_fips AS INT) AS VARCHAR) END AS fips FROM p")
def name_key(spark, sf_dir):
    return permits(spark, sf_dir).select("source_id", text.norm_name(F.col("source_id")).alias("name_key"), text.zfill2(F.col("state_fips").cast("int").cast("string")).alias("fips")).distinct()


@register("b12_token_estimate", "SELECT conv_id, turn, CAST(floor(length(text) / 3.0) AS BIGINT) AS tokens FROM conversations")
def token_estimate(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT conv_id, turn, text FROM conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).alias("tokens"))


# ---- C: classification
def _kind_sql(default: str | None = None) -> tuple[str, str]:
    codes = "CASE upper(trim(kind_text)) " + " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in vocab.KIND_CODES.items()) + " END"
    value, rule = vocab.case_sql(vocab.KIND_RULES, "lower(kind_text)", "'UNKNOWN'")
    if default:
        return f"coalesce({codes}, '{default}')", f"CASE WHEN {codes} IS NOT NULL THEN 'code' ELSE 'source-declared' END"
    return f"coalesce({codes}, {value})", f"CASE WHEN {codes} IS NOT NULL THEN 'code' ELSE {rule} END"


_SV, _SR = vocab.case_sql(vocab.STRUCTURE_RULES, "lower(type_text)")
_CODE = "nullif(regexp_extract(type_text, '(^|[^0-9])(10[1-5])([^0-9]|$)', 2), '')"
STRUCTURE_V = f"CASE WHEN {_CODE} IS NOT NULL THEN {_CODE} WHEN regexp_matches(lower(type_text), '{vocab.BUNDLE}') THEN '1-4' ELSE {_SV} END"
STRUCTURE_R = f"CASE WHEN {_CODE} IS NOT NULL THEN 'bps-code' WHEN regexp_matches(lower(type_text), '{vocab.BUNDLE}') THEN 'kw:low-density-bundle' ELSE {_SR} END"
WORK_V, WORK_R = vocab.case_sql(vocab.WORK_RULES, "lower(work_text)", "'UNKNOWN'")
KIND_V, KIND_R = _kind_sql()
OPEN_ENDED = r"regexp_matches(lower(description), '>\s*\d+\s*unit|\d+\s*\+\s*unit|or more')"
TEXT_UNITS = rf"CASE WHEN {OPEN_ENDED} THEN NULL ELSE TRY_CAST(nullif(regexp_extract(lower(description), '(\d+)\s*unit', 1), '') AS INT) END"
#: Classified rows, as CTEs for the oracles.
CLASSED = f"""{P},
c AS (SELECT *, {STRUCTURE_V} AS sv, {STRUCTURE_R} AS sr, {WORK_V} AS wv, {WORK_R} AS wr, {KIND_V} AS kv, {KIND_R} AS kr,
  {INT.format('units_raw')} AS fu, {TEXT_UNITS} AS tu, CASE WHEN k % 11 = 9 AND k % 3 = 0 THEN NULL ELSE true_iso END AS iso FROM p)"""


@register("c01_structure", f"WITH {CLASSED} SELECT k, sv AS value, sr AS rule FROM c")
def structure(spark, sf_dir):
    return permits(spark, sf_dir).select("k", classify.structure(F.col("type_text")).alias("s")).select("k", "s.value", "s.rule")


@register("c02_work", f"WITH {CLASSED} SELECT k, wv AS value, wr AS rule FROM c")
def work(spark, sf_dir):
    return permits(spark, sf_dir).select("k", classify.work(F.col("work_text")).alias("s")).select("k", "s.value", "s.rule")


_KDV, _KDR = _kind_sql("BUILDING")


@register("c03_kind", f"WITH {CLASSED} SELECT k, kv AS value, kr AS rule, {_KDV} AS declared_value, {_KDR} AS declared_rule FROM c")
def kind(spark, sf_dir):
    d = permits(spark, sf_dir).select("k", classify.kind(F.col("kind_text")).alias("s"), classify.kind(F.col("kind_text"), default="BUILDING").alias("d"))
    return d.select("k", "s.value", "s.rule", F.col("d.value").alias("declared_value"), F.col("d.rule").alias("declared_rule"))


_lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
_COLUMNS = "(place, code_key, label, structure, work, kind, units, exclude)"
CODE_TABLE = f"t AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, (i, *c))) + ')' for i, c in enumerate(vocab.CODES))}) AS t{_COLUMNS})"


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(vocab.CODES), "code_key string, label string, structure string, work string, kind string, units int, exclude string")


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Permits with the codes of the legend in turn, in small letters and between spaces, and with codes it lacks."""
    places = spark.createDataFrame([(i, f" {c[0].lower()} ") for i, c in enumerate(vocab.CODES)], "place int, own string")
    d = permits(spark, sf_dir).join(F.broadcast(places), F.col("k") % 80 == F.col("place"), "left")
    return d.withColumn("code", F.coalesce("own", F.lit("329x"))).drop("own", "place")


@register("c04_by_code", f"WITH {P}, {CODE_TABLE} SELECT k, structure, work, label, CASE WHEN code_key IS NOT NULL THEN concat('code:', code_key) END AS rule FROM p LEFT JOIN t ON k % 80 = place")
def by_code(spark, sf_dir):
    return records.by_code(coded(spark, sf_dir), code_table(spark)).select("k", "structure", "work", "label", "rule")


REFINED_V = "CASE WHEN wv = 'NEW' AND u > 0 AND sv = '1-4' THEN CASE WHEN u = 1 THEN '101' WHEN u = 2 THEN '103' ELSE '104' END WHEN wv = 'NEW' AND u > 0 AND sv = '105' AND u <= 4 THEN CASE WHEN u >= 3 THEN '104' WHEN u = 2 THEN '103' ELSE '101' END ELSE sv END"
REFINED_R = "CASE WHEN wv = 'NEW' AND u > 0 AND sv = '1-4' THEN 'refine:bundle-by-units' WHEN wv = 'NEW' AND u > 0 AND sv = '105' AND u <= 4 THEN 'refine:multifamily-down' END"


@register("c05_refine", f"WITH {CLASSED}, r AS (SELECT *, fu AS u FROM c) SELECT k, {REFINED_V} AS value, {REFINED_R} AS rule FROM r")
def refine(spark, sf_dir):
    d = permits(spark, sf_dir).select("k", classify.structure(F.col("type_text"))["value"].alias("s"), classify.work(F.col("work_text"))["value"].alias("w"), text.norm_int(F.col("units_raw")).alias("u"))
    return d.select("k", classify.refine(F.col("s"), F.col("u"), F.col("w")).alias("r")).select("k", "r.value", "r.rule")


IMPLY_R = "CASE WHEN k % 4 = 0 THEN 'refused:uncontrolled-field' WHEN wv <> 'NEW' THEN 'refused:not-new' WHEN sr IS NULL OR sr NOT IN ('bps-code', 'kw:single-family', 'kw:attached', 'kw:two-family') THEN 'refused:rule-not-determinate' WHEN sv NOT IN ('101', '102', '103') THEN 'refused:class-not-determinate' ELSE concat('imply:', CASE WHEN sv = '103' THEN '2' ELSE '1' END, '-from-', sv) END"


@register("c06_imply_units", f"WITH {CLASSED}, r AS (SELECT *, {IMPLY_R} AS ir FROM c) SELECT k, CASE WHEN ir LIKE 'imply%' THEN CASE WHEN sv = '103' THEN 2 ELSE 1 END END AS units, ir AS rule FROM r")
def imply(spark, sf_dir):
    d = permits(spark, sf_dir).select("k", classify.structure(F.col("type_text")).alias("s"), classify.work(F.col("work_text"))["value"].alias("w"))
    return d.select("k", classify.imply_units(F.col("s.value"), F.col("w"), F.col("s.rule"), F.col("k") % 4 != 0).alias("r")).select("k", "r.units", "r.rule")


@register("c07_units_from_text", f"WITH {CLASSED} SELECT k, tu AS units, CASE WHEN {OPEN_ENDED} THEN 'refused:open-ended' WHEN tu IS NOT NULL THEN 'units:exact-from-text' END AS rule FROM c")
def units_from_text(spark, sf_dir):
    return permits(spark, sf_dir).select("k", classify.units_from_text(F.col("description")).alias("u")).select("k", "u.units", "u.rule")


@register("c08_unmapped", f"WITH {CLASSED}, m AS (SELECT concat('structure: ', substr(type_text, 1, 70)) AS key FROM c WHERE sv IS NULL AND type_text <> '' UNION ALL SELECT concat('work: ', substr(work_text, 1, 70)) FROM c WHERE wr IS NULL AND work_text <> '' UNION ALL SELECT concat('kind: ', substr(kind_text, 1, 70)) FROM c WHERE kr IS NULL AND kind_text <> '') SELECT key, count(*) AS n, sum(count(*)) OVER () AS total FROM m GROUP BY key ORDER BY n DESC, key LIMIT 40")
def unmapped(spark, sf_dir):
    return records.unmapped(permits(spark, sf_dir), top=40)


@register("c09_coverage", f"WITH {CLASSED} SELECT source_id, count(*) AS n, round(avg(CASE WHEN sv IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS structure, round(avg(CASE WHEN wv <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 6) AS work, round(avg(CASE WHEN kv <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 6) AS kind, sum(CASE WHEN wv = 'NEW' AND kv = 'BUILDING' AND sv IS NOT NULL THEN 1 ELSE 0 END) AS joint FROM c GROUP BY source_id")
def coverage(spark, sf_dir):
    return records.coverage(permits(spark, sf_dir))


@register("c10_prefix_list", f"WITH {CLASSED} SELECT sv AS structure_type, type_text, count(*) AS n FROM c WHERE sr = 'bps-code' AND NOT (type_text LIKE 'R-%' OR type_text LIKE 'Single%') GROUP BY sv, type_text")
def prefix_list(spark, sf_dir):
    d = permits(spark, sf_dir).select("type_text", classify.structure(F.col("type_text")).alias("s")).where("s.rule = 'bps-code'")
    missed = ~(F.startswith("type_text", F.lit("R-")) | F.startswith("type_text", F.lit("Single")))
    return d.where(missed).groupBy(F.col("s.value").alias("structure_type"), "type_text").agg(F.count("*").alias("n"))


# ---- D, E: records and alarm
#: The open-data build: text units if the field has none, then refinement.
RECORDS = f"""{CLASSED},
u AS (SELECT *, coalesce(fu, tu) AS u, CASE WHEN fu IS NOT NULL THEN 'field' WHEN tu IS NOT NULL THEN 'parsed_from_text' ELSE 'absent' END AS us FROM c WHERE trim(native_id) <> ''),
r AS (SELECT *, {REFINED_V} AS st FROM u),
rec AS (SELECT k, source_id, state_fips, bps_id, native_id, iso, kv AS permit_kind, wv AS work_class, st AS structure_type,
  CASE st WHEN '101' THEN 'u1' WHEN '102' THEN 'u1' WHEN '103' THEN 'u2' WHEN '104' THEN 'u34' WHEN '105' THEN 'u5p' WHEN '1-4' THEN 'low_bundle' END AS bps_column,
  u AS unit_count, us AS unit_count_source,
  CASE WHEN kv = 'BUILDING' AND wv = 'NEW' AND us <> 'absent' AND u IS NOT NULL THEN u ELSE 0 END AS countable_units FROM r)"""


@register("d07_build_records", f"WITH {RECORDS} SELECT concat(source_id, '|', native_id) AS observation_key, source_id, state_fips, bps_id, native_id, permit_kind, work_class, structure_type, bps_column, CAST(unit_count AS BIGINT) AS unit_count, unit_count_source, CAST(countable_units AS BIGINT) AS countable_units, iso AS date_issued FROM rec")
def build_records(spark, sf_dir):
    cols = ("observation_key", "source_id", "state_fips", "bps_id", "native_id", "permit_kind", "work_class", "structure_type", "bps_column", "unit_count", "unit_count_source", "countable_units", "date_issued")
    return records.build(permits(spark, sf_dir)).select(*cols)


@register("d01_identity_gate", f"WITH {P} SELECT source_id, sum(CASE WHEN trim(native_id) = '' THEN 1 ELSE 0 END) AS rejected, sum(CASE WHEN trim(native_id) <> '' THEN 1 ELSE 0 END) AS kept FROM p GROUP BY source_id")
def identity_gate(spark, sf_dir):
    ok, rejected = records.identity_gate(permits(spark, sf_dir))
    both = ok.select("source_id", F.lit(0).alias("r")).unionByName(rejected.select("source_id", F.lit(1).alias("r")))
    return both.groupBy("source_id").agg(F.sum("r").alias("rejected"), F.sum(1 - F.col("r")).alias("kept"))


@register("d02_milestones", f"WITH {P} SELECT k, 'issued' AS milestone, true_iso AS reported_date, issued AS native_string FROM p WHERE NOT (k % 11 = 9 AND k % 3 = 0)")
def milestones(spark, sf_dir):
    return records.milestones(permits(spark, sf_dir)).select("k", F.explode("milestones").alias("m")).select("k", "m.*")


_BROKEN = "CASE k % 8 WHEN 0 THEN 'guessed' WHEN 1 THEN 'absent' WHEN 2 THEN 'field' WHEN 3 THEN 'implied_by_structure_code' ELSE 'field' END"


@register("d06_validate", f"""WITH {RECORDS}, b AS (SELECT source_id, {_BROKEN} AS us, CASE WHEN k % 8 = 2 THEN NULL ELSE 3 - k % 6 END AS u, CASE WHEN k % 7 = 0 THEN '999' ELSE structure_type END AS st FROM rec),
v AS (SELECT source_id, unnest(list_filter([CASE WHEN us = 'guessed' THEN 'unknown-source' END, CASE WHEN us = 'absent' AND u IS NOT NULL THEN 'absent-with-count' END, CASE WHEN us <> 'absent' AND u IS NULL THEN 'stated-without-count' END, CASE WHEN st = '999' THEN 'unknown-class' END, CASE WHEN u < 0 THEN 'negative-units' END, CASE WHEN us LIKE 'implied%' AND coalesce(CASE st WHEN '101' THEN 1 WHEN '102' THEN 1 WHEN '103' THEN 2 END <> u, true) THEN 'implied-differs' END], lambda x: x IS NOT NULL)) AS violation FROM b)
SELECT source_id, violation, count(*) AS n FROM v GROUP BY source_id, violation""")
def validate(spark, sf_dir):
    """Records that are broken in each of the six ways."""
    d = records.build(permits(spark, sf_dir)).withColumns({"unit_count_source": F.expr(_BROKEN), "unit_count": F.expr("CASE WHEN k % 8 = 2 THEN NULL ELSE 3 - k % 6 END"), "structure_type": F.expr("CASE WHEN k % 7 = 0 THEN '999' ELSE structure_type END")})
    return records.validate(d).select("source_id", F.explode("violations").alias("violation")).groupBy("source_id", "violation").agg(F.count("*").alias("n"))


#: Types that say more, for the build that may read nothing else.
TYPED = "concat(type_text, CASE k % 4 WHEN 0 THEN ' New Building' WHEN 1 THEN ' new bldg' WHEN 2 THEN ' building addition' ELSE '' END)"
_TWV, _ = vocab.case_sql(vocab.WORK_RULES, "lower(tt)", "'UNKNOWN'")
_TKV, _ = vocab.case_sql(vocab.KIND_RULES, "lower(tt)", "'UNKNOWN'")
_TSV, _TSR = STRUCTURE_V.replace("type_text", "tt"), STRUCTURE_R.replace("type_text", "tt")
IMPLIED = f"""{P}, y AS (SELECT *, {TYPED} AS tt, {TEXT_UNITS} AS tu FROM p WHERE trim(native_id) <> ''),
z AS (SELECT *, {_TSV} AS sv, {_TSR} AS sr, {_TWV} AS wv, {_TKV} AS kv, tu AS u FROM y), q AS (SELECT *, {REFINED_V} AS st FROM z),
a AS (SELECT *, CASE WHEN tu IS NULL AND wv = 'NEW' AND sr IN ('bps-code', 'kw:single-family', 'kw:attached', 'kw:two-family') AND st IN ('101', '102', '103') THEN CASE WHEN st = '103' THEN 2 ELSE 1 END END AS iu FROM q)"""


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permits(spark, sf_dir).withColumn("type_text", F.expr(TYPED))


@register("d08_build_controlled", f"WITH {IMPLIED} SELECT k, kv AS permit_kind, wv AS work_class, st AS structure_type, coalesce(tu, iu) AS unit_count, CASE WHEN tu IS NOT NULL THEN 'parsed_from_text' WHEN iu IS NOT NULL THEN 'implied_by_structure_code' ELSE 'absent' END AS unit_count_source, CASE WHEN kv = 'BUILDING' AND wv = 'NEW' THEN coalesce(tu, iu, 0) ELSE 0 END AS countable_units, CASE WHEN kv = 'BUILDING' AND wv = 'NEW' THEN coalesce(tu, 0) ELSE 0 END AS countable_units_measured FROM a")
def build_controlled(spark, sf_dir):
    return records.build_controlled(typed(spark, sf_dir)).select("k", "permit_kind", "work_class", "structure_type", "unit_count", "unit_count_source", "countable_units", "countable_units_measured")


@register("d09_build_by_code", f"WITH {P}, {CODE_TABLE} SELECT k, structure AS structure_type, coalesce(work, 'UNKNOWN') AS work_class, coalesce(kind, 'UNKNOWN') AS permit_kind, CASE WHEN exclude IS NULL THEN units END AS unit_count, CASE WHEN exclude IS NULL AND units > 0 THEN 'implied_by_structure_code' ELSE 'absent' END AS unit_count_source, CASE WHEN kind = 'BUILDING' AND work = 'NEW' AND exclude IS NULL THEN coalesce(units, 0) ELSE 0 END AS countable_units, exclude FROM p LEFT JOIN t ON k % 80 = place WHERE trim(native_id) <> ''")
def build_by_code(spark, sf_dir):
    return records.build_by_code(coded(spark, sf_dir), code_table(spark)).select("k", "structure_type", "work_class", "permit_kind", "unit_count", "unit_count_source", "countable_units", "exclude")


@register("d12_whole_record", f"WITH {RECORDS} SELECT concat(source_id, '|', native_id) AS observation_key, 'socrata' AS platform, CAST(unit_count AS INT) AS unit_count, CAST(countable_units AS INT) AS countable_units, iso AS date_issued, iso AS date_applied, CASE WHEN iso IS NULL THEN 0 ELSE 2 END AS n_milestones, 2 AS n_native, 25 AS n_columns FROM rec")
def whole_record(spark, sf_dir):
    d = records.as_records(records.build(permits(spark, sf_dir)), "socrata", "v1", {"issued": "issued", "applied": "issued"}, ("type_text", "work_text"))
    return d.select("observation_key", "platform", "unit_count", "countable_units", "date_issued", "date_applied", F.size("milestones").alias("n_milestones"), F.size("native").alias("n_native"), F.lit(len(d.columns)).alias("n_columns"))


@register("d11_first_by_id", f"WITH {P}, d AS (SELECT source_id, type_text AS id, k, row_number() OVER (PARTITION BY source_id, type_text ORDER BY true_iso, k) AS r FROM p) SELECT source_id, id, k FROM d WHERE r = 1")
def first_by_id(spark, sf_dir):
    d = permits(spark, sf_dir).select("source_id", F.col("type_text").alias("id"), "k", "true_iso")
    return records.first_by(d, ["source_id", "id"], ["true_iso", "k"]).select("source_id", "id", "k")


_NULLS = "round(avg(CASE WHEN permit_kind IS NULL OR permit_kind = 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 4) AS permit_kind, round(avg(CASE WHEN work_class IS NULL OR work_class = 'UNKNOWN' THEN 1.0 ELSE 0.0 END), 4) AS work_class, round(avg(CASE WHEN structure_type IS NULL THEN 1.0 ELSE 0.0 END), 4) AS structure_type, round(avg(CASE WHEN unit_count IS NULL THEN 1.0 ELSE 0.0 END), 4) AS unit_count, round(avg(CASE WHEN iso IS NULL THEN 1.0 ELSE 0.0 END), 4) AS date_issued"


@register("e01_null_rates", f"WITH {RECORDS} SELECT source_id, count(*) AS n, {_NULLS} FROM rec GROUP BY source_id")
def null_rates(spark, sf_dir):
    return quality.null_rates(records.build(permits(spark, sf_dir)))


@register("e02_units_by_column", f"WITH {RECORDS} SELECT bps_column, CAST(sum(countable_units) AS BIGINT) AS units, CAST(sum(CASE WHEN unit_count_source = 'implied_by_structure_code' THEN countable_units ELSE 0 END) AS BIGINT) AS implied FROM rec WHERE bps_column IS NOT NULL AND countable_units <> 0 GROUP BY bps_column")
def units_by_column(spark, sf_dir):
    return quality.units_by_column(records.build(permits(spark, sf_dir)))


@register("e03_alarm", f"WITH {RECORDS}, m AS (SELECT CASE WHEN state_fips < '05' THEN 'a' ELSE 'b' END AS part, * FROM rec), x AS (SELECT source_id, {_NULLS} FROM (SELECT * REPLACE (CASE WHEN part = 'a' THEN NULL ELSE structure_type END AS structure_type) FROM m) GROUP BY source_id) SELECT source_id, concat_ws(',', CASE WHEN permit_kind >= 0.90 THEN 'permit_kind' END, CASE WHEN work_class >= 0.90 THEN 'work_class' END, CASE WHEN structure_type >= 0.99 THEN 'structure_type' END, CASE WHEN unit_count >= 0.95 THEN 'unit_count' END) AS tripped FROM x")
def alarm(spark, sf_dir):
    r = records.build(permits(spark, sf_dir)).withColumn("structure_type", F.when(F.col("state_fips") >= "05", F.col("structure_type")))
    return quality.tripped(quality.null_rates(r)).select("source_id", F.array_join("tripped", ",").alias("tripped"))


@register("e04_qualified", f"WITH {IMPLIED}, g AS (SELECT source_id, sum(CASE WHEN kv = 'BUILDING' AND wv = 'NEW' THEN coalesce(tu, iu, 0) ELSE 0 END) AS total, sum(CASE WHEN kv = 'BUILDING' AND wv = 'NEW' AND tu IS NULL THEN coalesce(iu, 0) ELSE 0 END) AS implied, count(*) FILTER (WHERE kv = 'UNKNOWN') AS unknown_kind FROM a GROUP BY source_id) SELECT source_id, CAST(total AS BIGINT) AS total, CAST(implied AS BIGINT) AS implied, unknown_kind, CASE WHEN implied = total AND total > 0 THEN 'all-implied' WHEN total > 0 AND implied >= 0.5 * total THEN 'mostly-implied' END AS qualified FROM g")
def qualified(spark, sf_dir):
    return quality.qualified(records.build_controlled(typed(spark, sf_dir)))


# ---- I: reconciliation
FOLD = f"""{RECORDS}, f AS (SELECT source_id, concat(substr(iso, 3, 2), substr(iso, 6, 2)) AS yymm, count(*) AS n,
  sum(CASE WHEN bps_column = 'u1' THEN countable_units ELSE 0 END) AS a1, sum(CASE WHEN bps_column = 'u2' THEN countable_units ELSE 0 END) AS a2,
  sum(CASE WHEN bps_column = 'u34' THEN countable_units ELSE 0 END) AS a34, sum(CASE WHEN bps_column = 'u5p' THEN countable_units ELSE 0 END) AS a5p,
  sum(CASE WHEN bps_column = 'low_bundle' THEN countable_units ELSE 0 END) AS ab,
  sum(CASE WHEN work_class = 'NEW' AND permit_kind = 'BUILDING' AND bps_column IS NULL THEN 1 ELSE 0 END) AS unclassified
  FROM rec WHERE iso IS NOT NULL GROUP BY source_id, concat(substr(iso, 3, 2), substr(iso, 6, 2)))"""


def _big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


@register("i01_month_fold", f"WITH {FOLD} SELECT source_id, yymm, n, {_big('a1', 'a2', 'a34', 'a5p', 'ab', 'unclassified')} FROM f")
def month_fold(spark, sf_dir):
    return reconcile.month_fold(records.build(permits(spark, sf_dir)))


RECONCILED = f"""{FOLD}, o AS ({OFFICE_MONTHS}), j AS (SELECT f.source_id, f.yymm, a1 + a2 + a34 + a5p + ab AS admin_total, u1 + u2 + u34 + u5p AS ref_total,
  a1 + a2 + a34 + ab AS admin_low, u1 + u2 + u34 AS ref_low, a5p AS admin_5p, u5p AS ref_5p FROM f JOIN o USING (source_id, yymm) WHERE usable = 'Y')"""


@register(
    "reconcile_office_month",
    f"""WITH {RECONCILED} SELECT source_id, yymm, CAST(admin_total AS BIGINT) AS admin_total, CAST(ref_total AS BIGINT) AS ref_total,
  round(100.0 * abs(admin_total - ref_total) / nullif(ref_total, 0), 6) AS err_total, round(100.0 * abs(admin_low - ref_low) / nullif(ref_low, 0), 6) AS err_low,
  round(100.0 * abs(admin_5p - ref_5p) / nullif(ref_5p, 0), 6) AS err_5p FROM j""",
)
def reconcile_office_month(spark, sf_dir):
    return reconcile.reconcile(reconcile.month_fold(records.build(permits(spark, sf_dir))), frame(spark, sf_dir, OFFICE_MONTHS))


@register("i02_dropped_months", f"WITH o AS ({OFFICE_MONTHS}) SELECT source_id, count(*) AS dropped FROM o WHERE usable <> 'Y' GROUP BY source_id")
def dropped_months(spark, sf_dir):
    return reconcile.dropped_months(frame(spark, sf_dir, OFFICE_MONTHS))


@register("i05_upper_median", f"""WITH {RECONCILED}, e AS (SELECT source_id, round(100.0 * abs(admin_low - ref_low) / nullif(ref_low, 0), 6) AS e FROM j), s AS (SELECT source_id, list_sort(list(e) FILTER (WHERE e IS NOT NULL)) AS xs FROM e GROUP BY source_id) SELECT source_id, xs[len(xs) // 2 + 1] AS median_low FROM s""")
def upper_median(spark, sf_dir):
    return reconcile.median_error(reconcile_office_month(spark, sf_dir))


@register("i04_gates", f"""WITH {RECONCILED}, b AS (SELECT source_id FROM rec GROUP BY source_id HAVING avg(CASE WHEN structure_type IS NULL OR state_fips < '06' THEN 1.0 ELSE 0.0 END) >= 0.99), e AS (SELECT source_id, round(100.0 * abs(admin_total - ref_total) / nullif(ref_total, 0), 6) AS e FROM j WHERE source_id NOT IN (SELECT source_id FROM b)) SELECT source_id, count(e) AS months, round(avg(e), 4) AS mean_error FROM e GROUP BY source_id""")
def gates(spark, sf_dir):
    """Sources that the alarm holds back, as their classes are missing, give no figure."""
    built = records.build(permits(spark, sf_dir))
    seen = built.withColumn("structure_type", F.when(F.col("state_fips") >= "06", F.col("structure_type")))
    blocked = quality.tripped(quality.null_rates(seen)).where(F.size("tripped") > 0).select("source_id")
    e = reconcile_office_month(spark, sf_dir).join(blocked, "source_id", "left_anti")
    return e.groupBy("source_id").agg(F.count("err_total").alias("months"), F.round(F.avg("err_total"), 4).alias("mean_error"))


@register("i06_alternate_measure", f"WITH {RECORDS}, l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) SELECT source_id, CAST(sum(countable_units) AS BIGINT) AS by_field, CAST(sum(coalesce(lines, 0)) AS BIGINT) AS by_lines FROM rec LEFT JOIN l ON l_orderkey = k WHERE work_class = 'NEW' AND permit_kind = 'BUILDING' GROUP BY source_id")
def alternate_measure(spark, sf_dir):
    rec = records.build(permits(spark, sf_dir)).where("work_class = 'NEW' and permit_kind = 'BUILDING'")
    lines = frame(spark, sf_dir, "SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey")
    j = rec.join(lines, rec.k == lines.l_orderkey, "left")
    return j.groupBy("source_id").agg(F.sum("countable_units").cast("bigint").alias("by_field"), F.sum(F.coalesce("lines", F.lit(0))).cast("bigint").alias("by_lines"))


@register("i07_prefix_split", f"WITH {CLASSED} SELECT source_id, CAST(sum(CASE WHEN type_text LIKE 'R-%' OR type_text LIKE '1,2,3%' THEN fu ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN type_text LIKE 'C-%' THEN fu ELSE 0 END) AS BIGINT) AS high FROM c GROUP BY source_id")
def prefix_split(spark, sf_dir):
    d = permits(spark, sf_dir).withColumn("u", text.norm_int(F.col("units_raw")))
    low = F.col("type_text").startswith("R-") | F.col("type_text").startswith("1,2,3")
    return d.groupBy("source_id").agg(F.sum(F.when(low, F.col("u")).otherwise(0)).cast("bigint").alias("low"), F.sum(F.when(F.col("type_text").startswith("C-"), F.col("u")).otherwise(0)).cast("bigint").alias("high"))


@register("i11_pool", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 1)")
def pool(spark, sf_dir):
    resolved = frame(spark, sf_dir, "SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 1")
    office = frame(spark, sf_dir, "SELECT n_nationkey, n_name FROM nation")
    return office.join(resolved, office.n_nationkey == resolved.c_nationkey, "left_anti")


@register("i12_identity_check", "SELECT c_custkey, CASE WHEN n_nationkey IS NULL THEN 'unresolved' WHEN lower(n_name) = lower(CASE WHEN c_custkey % 3 = 0 THEN 'elsewhere' ELSE n_name END) THEN 'ok' ELSE 'name-differs' END AS status FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 7 = 0 THEN 999 ELSE c_nationkey END")
def identity_check(spark, sf_dir):
    claims = frame(spark, sf_dir, "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 999 ELSE c_nationkey END AS key, CASE WHEN c_custkey % 3 = 0 THEN 'elsewhere' ELSE n_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
    office = frame(spark, sf_dir, "SELECT n_nationkey AS office_key, n_name AS office_name FROM nation")
    return reconcile.identity_check(claims, office).select("c_custkey", "status")


@register("i13_clean_offices", "SELECT c_nationkey, count(DISTINCT month(o_orderdate) + 12 * year(o_orderdate)) AS months FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey HAVING count(DISTINCT month(o_orderdate) + 12 * year(o_orderdate)) >= 24")
def clean_offices(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT c_nationkey, month(o_orderdate) + 12 * year(o_orderdate) AS m FROM orders JOIN customer ON o_custkey = c_custkey")
    return d.groupBy("c_nationkey").agg(F.count_distinct("m").alias("months")).where("months >= 24")


@register("i14_current_state", "SELECT user_id AS file, max_by(event_type, event_id) AS verdict FROM events GROUP BY user_id")
def current_state(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT user_id AS file, event_id, event_type FROM events")
    return d.groupBy("file").agg(F.max_by("event_type", "event_id").alias("verdict"))


@register("i15_reverify", "WITH c AS (SELECT user_id AS file, max_by(event_type, event_id) AS old FROM events GROUP BY user_id) SELECT file, old, CASE WHEN file % 3 = 0 THEN 'error' ELSE old END AS new FROM c WHERE file % 3 = 0 AND old <> 'error'")
def reverify(spark, sf_dir):
    """New rows for the files whose verdict changed, and no others."""
    return current_state(spark, sf_dir).withColumn("new", F.when(F.col("file") % 3 == 0, "error").otherwise(F.col("verdict"))).where("new <> verdict").select("file", F.col("verdict").alias("old"), "new")


@register("i17_week_windows", "SELECT m AS month_start, d AS lo, least(d + INTERVAL 6 DAY, m + INTERVAL 1 MONTH - INTERVAL 1 DAY)::DATE AS hi FROM (SELECT DISTINCT date_trunc('month', o_orderdate)::DATE AS m FROM orders) x, LATERAL (SELECT unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 7 DAY))::DATE AS d) y")
def week_windows(spark, sf_dir):
    months = frame(spark, sf_dir, "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders")
    return reconcile.week_windows(months)


@register("i19_unique_name_repair", "WITH u AS (SELECT c_mktsegment AS s, c_nationkey AS name, min(c_custkey) AS key, count(*) AS n FROM customer GROUP BY 1, 2) SELECT s, name, CASE WHEN n = 1 THEN key END AS key FROM u")
def unique_name_repair(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT c_mktsegment AS s, c_nationkey AS name, c_custkey AS key FROM customer")
    return d.groupBy("s", "name").agg(F.when(F.count("*") == 1, F.min("key")).alias("key"))


@register("i20_override_merge", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'tier2' END, c_mktsegment) AS bucket FROM customer")
def override_merge(spark, sf_dir):
    base = frame(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS bucket FROM customer")
    override = frame(spark, sf_dir, "SELECT c_custkey, 'tier2' AS bucket FROM customer WHERE c_custkey % 10 = 0")
    return reconcile.override(base, override, "c_custkey", "bucket")


@register("i08_coverage_weights", "SELECT c_mktsegment AS bucket, count(*) AS offices, round(100.0 * sum(c_acctbal) FILTER (WHERE c_acctbal > 0) / sum(sum(c_acctbal) FILTER (WHERE c_acctbal > 0)) OVER (), 6) AS weighted, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS counted FROM customer GROUP BY c_mktsegment")
def coverage_weights(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT c_mktsegment AS bucket, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END AS w FROM customer")
    return reconcile.coverage_shares(d, "bucket", "w")
