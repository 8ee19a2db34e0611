"""Whole runs, sinks and the remaining simulations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.settings import settings_sent
from lodestone.operators import records, runs, similarity, simulate
from lodestone.plans.base import frame, register
from lodestone.plans.measure import DRAWS, HI, LEDGER, LO, draws, ledger
from lodestone.plans.more import settled_pairs
from lodestone.plans.parsing import POSITION_PAGES
from lodestone.plans.permits import OFFICE_MONTHS, RECONCILED, code_table, permits
from lodestone.sources import files
from lodestone.sources.shared import shared_path


@register("a03_ledger_append", f"WITH l AS ({LEDGER}) SELECT row_id, model, tokens, ok = 1 AS ok FROM l")
def ledger_append(spark, sf_dir):
    """Two appends of half the calls each, read back; rows that say nothing of success count as one."""
    path, d = shared_path(spark, "ledger"), ledger(spark, sf_dir)
    line = d.select("row_id", "model", "tokens", F.when(F.col("ok") == 0, False).alias("ok"))
    for half in (0, 1):
        files.append_jsonl(line.where(F.col("row_id") % 2 == half), path, ["row_id"])
    found = spark.read.schema("row_id bigint, model string, tokens bigint, ok boolean").json(path)
    return found.withColumn("ok", F.coalesce("ok", F.lit(True)))


@register("a04_manifest_append", "SELECT CAST(page_id AS VARCHAR) AS file, url, 'T-INDEX' AS page_type, '' AS fp FROM pages")
def manifest_append(spark, sf_dir):
    path = shared_path(spark, "manifest")
    d = frame(spark, sf_dir, "SELECT CAST(page_id AS STRING) AS file, url, 'T-INDEX' AS page_type FROM pages")
    for half in (0, 1):
        files.append_manifest(d.where(F.pmod(F.col("file").cast("bigint"), F.lit(2)) == half), path)
    return files.read_manifest(spark, path).select("file", "url", "page_type", F.coalesce("fp", F.lit("")).alias("fp"))


@register("a10_paged_pull", "SELECT n_nationkey // 10 AS page, concat('r', CAST(n_nationkey AS VARCHAR)) AS record FROM nation")
def paged_pull(spark, sf_dir):
    """A source of 25 records in pages of ten: the third is not full and ends the pull."""
    n = frame(spark, sf_dir, "SELECT n_nationkey FROM nation").count()  # the nations, 25
    return files.paged(spark, lambda at, size: [f"r{i}" for i in range(at, min(n, at + size))], 10).select(F.col("page").cast("bigint").alias("page"), "record")


@register("a14_replay", "SELECT o_custkey AS page, row_number() OVER (ORDER BY o_custkey % 7, CAST(o_custkey AS VARCHAR)) AS ordinal FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 10 <> 0 AND o_custkey % 3 <> 0")
def replay(spark, sf_dir):
    manifest, pages = _stored(spark, sf_dir)
    return files.replay(manifest, pages, "a", "T-INDEX", _complete()).select(F.col("file").cast("bigint").alias("page"), F.col("ordinal").cast("bigint").alias("ordinal"))


def _stored(spark, sf_dir):
    pages = frame(spark, sf_dir, POSITION_PAGES).withColumn("file", F.col("page").cast("string")).select("file", "html")
    verdict = F.when(F.col("file").cast("bigint") % 3 == 0, "rejected").otherwise("ok")
    manifest = pages.select("file", F.lit("a").alias("jurisdiction"), F.lit("T-INDEX").alias("page_type"), verdict.alias("verdict"), (F.col("file").cast("bigint") % 7).cast("string").alias("fetched_at"))
    return manifest, pages


def _complete():
    return ~F.col("html").rlike(r"(?i)only the first \d+ records")


@register("m02_rebuild", "SELECT concat('a|', CAST(o_orderkey AS VARCHAR)) AS observation, 'UNKNOWN' AS permit_kind, 'absent' AS unit_count_source, concat(CAST(o_orderkey % 90 AS VARCHAR), ' Elm & Oak') AS address FROM orders WHERE o_custkey % 10 <> 0 AND o_custkey % 3 <> 0 AND o_orderkey % 19 <> 0")
def rebuild(spark, sf_dir):
    """Pages to records; the status letters are no codes of the legend, so all stay unknown."""
    manifest, pages = _stored(spark, sf_dir)
    d = runs.rebuild(manifest, pages, code_table(spark), {"source_id": "a"}, "a", "T-INDEX", _complete())
    return d.select(F.concat_ws("|", "source_id", "native_id").alias("observation"), "permit_kind", "unit_count_source", "address")


@register("m01_step_reconcile", f"""WITH {RECONCILED}, x AS (SELECT source_id, avg(CASE WHEN permit_kind = 'UNKNOWN' THEN 1.0 ELSE 0.0 END) >= 0.90 OR avg(CASE WHEN work_class = 'UNKNOWN' THEN 1.0 ELSE 0.0 END) >= 0.90 OR avg(CASE WHEN structure_type IS NULL THEN 1.0 ELSE 0.0 END) >= 0.99 OR avg(CASE WHEN unit_count IS NULL THEN 1.0 ELSE 0.0 END) >= 0.95 AS blocked FROM (SELECT * REPLACE (CASE WHEN state_fips < '05' THEN NULL ELSE structure_type END AS structure_type) FROM rec) GROUP BY source_id),
s AS (SELECT source_id, CASE WHEN blocked THEN 'blocked' ELSE 'headline' END AS state FROM x) SELECT source_id, state, count(*) AS months, round(avg(100.0 * abs(admin_total - ref_total) / nullif(ref_total, 0)), 4) AS mean_error FROM j JOIN s USING (source_id) WHERE state <> 'blocked' GROUP BY source_id, state""")
def step_reconcile(spark, sf_dir):
    """Offices of some states lose their classes, which the alarm must see: they give no figure."""
    built = records.build(permits(spark, sf_dir))
    lossy = built.withColumn("structure_type", F.when(F.col("state_fips") >= "05", F.col("structure_type")))
    errors, _ = runs.step_reconcile(lossy, frame(spark, sf_dir, OFFICE_MONTHS))
    return errors.groupBy("source_id", "state").agg(F.count("*").alias("months"), F.round(F.avg("err_total"), 4).alias("mean_error"))


@register("m04_export", f"WITH d AS ({DRAWS}), l AS ({LEDGER}), a AS (SELECT target, model, count(*) AS n, CAST(sum(perfect) AS BIGINT) AS k, round(sum(usd), 6) AS usd FROM d GROUP BY target, model), h AS (SELECT target, model, string_agg(DISTINCT host, ',' ORDER BY host) AS hosts FROM l GROUP BY target, model) SELECT target, model, n, k, usd, round({LO}, 4) AS lo, round({HI}, 4) AS hi, hosts FROM a LEFT JOIN h USING (target, model)")
def export(spark, sf_dir):
    """The results file, written in order and read back."""
    path, rows = shared_path(spark, "export"), runs.export_rows(draws(spark, sf_dir), ledger(spark, sf_dir), ["target", "model"])
    files.write_export(rows, path, ["target", "model"])
    found = spark.read.schema("target string, model string, n bigint, k bigint, usd double, lo double, hi double, hosts array<string>").json(path)
    return found.withColumn("hosts", F.array_join("hosts", ","))


@register("m05_rescored", f"WITH d AS ({DRAWS}) SELECT draw_id, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' ELSE 'changed' END AS change FROM (SELECT draw_id, CASE WHEN draw_id % 23 <> 0 THEN perfect END AS was, CASE WHEN draw_id % 29 <> 0 THEN CASE WHEN precision_min < 1 THEN 0 ELSE perfect END END AS now FROM d) WHERE was IS DISTINCT FROM now")
def rescored(spark, sf_dir):
    d = draws(spark, sf_dir)
    after = d.where("draw_id % 29 <> 0").withColumn("perfect", F.when(F.col("precision_min") < 1, 0).otherwise(F.col("perfect")))
    return runs.rescored(d.where("draw_id % 23 <> 0"), after, "draw_id", "perfect")


@register("c21_settings", "SELECT conv_id, turn, 100 + turn AS max_tokens, CASE turn % 4 WHEN 0 THEN 'adaptive' WHEN 1 THEN concat('budget=', CAST(turn * 10 AS VARCHAR)) WHEN 2 THEN 'effort=high' END AS reasoning, CASE WHEN turn % 4 = 2 THEN 'max' END AS reasoning_level, CASE WHEN turn % 4 < 2 THEN 1.0 END AS temperature FROM conversations")
def settings(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT conv_id, turn, concat('{\"max_tokens\":', CAST(100 + turn AS STRING), CASE turn % 4 WHEN 0 THEN ',\"thinking\":{\"type\":\"adaptive\"}' WHEN 1 THEN concat(',\"thinking\":{\"type\":\"enabled\",\"budget_tokens\":', CAST(turn * 10 AS STRING), '}') WHEN 2 THEN ',\"reasoning\":{\"effort\":\"high\"}' ELSE '' END, '}') AS body FROM conversations")
    return d.select("conv_id", "turn", settings_sent(F.col("body"), {"high": "max"}).alias("s")).select("conv_id", "turn", "s.max_tokens", "s.reasoning", "s.reasoning_level", "s.temperature")


@register("g04_guarded", "WITH p AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS h, concat('fp1:', substr(md5(CAST(page_id % 2 AS VARCHAR)), 1, 12)) AS m FROM pages), n AS (SELECT page_id AS a, lead(page_id) OVER w AS b, m, lead(m) OVER w AS o FROM p WINDOW w AS (PARTITION BY h ORDER BY page_id)) SELECT a, b, m = o AS same FROM n WHERE b IS NOT NULL")
def guarded(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT page_id, url FROM pages").select("page_id", F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("jurisdiction"), F.concat(F.lit("fp1:"), F.substr(F.md5((F.col("page_id") % 2).cast("string")), F.lit(1), F.lit(12))).alias("mark"))
    return similarity.comparable_pairs(d)


@register("k13_spearman_interval")
def spearman_interval(spark, sf_dir):
    """Over the models; seeded, tested for brackets."""
    d = draws(spark, sf_dir).groupBy("model").agg(F.avg("perfect").alias("rate"), F.avg("usd").alias("cost"))
    return simulate.spearman_interval(d, "rate", "cost")


@register("k18_random_orders")
def random_orders(spark, sf_dir):
    return simulate.best_of_k_orders(draws(spark, sf_dir).where("outcome <> 'infra_error'"), k=5)


@register("k19_false_discovery")
def false_discovery(spark, sf_dir):
    return simulate.false_discovery(settled_pairs(spark, sf_dir))
