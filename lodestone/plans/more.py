"""The remaining operators over tables rendered from the order, event and page tables; each oracle says in SQL what the
operator of the engine computes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import stats
from lodestone.operators import measures, records, rollup, simulate, windows
from lodestone.sources import files
from lodestone.plans.base import frame, register
from lodestone.plans.measure import CELLS, DRAWS, HI, LEDGER, LO, LOG, PRICES, cells, draws, ledger, wilson_sql
from lodestone.plans.permits import OFFICE_MONTHS, PERMITS, permits


D, L = f"WITH d AS ({DRAWS})", f"WITH l AS ({LEDGER})"
P, O = f"WITH p AS ({PERMITS})", f"WITH o AS ({LOG})"

# ---- A: the shapes of sources and sinks


@register("a08_json_records", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_records(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT event_id, props FROM events")
    return d.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@register("c12_api_record_count", "SELECT event_id % 50 AS page, count(*) AS n FROM events GROUP BY 1")
def api_records(spark, sf_dir):
    """Bodies with an envelope around the events of a page; the count is that of the first list."""
    d = frame(spark, sf_dir, "SELECT event_id % 50 AS page, props FROM events")
    body = d.groupBy("page").agg(F.concat(F.lit('{"more":1,"results":['), F.array_join(F.collect_list("props"), ","), F.lit("]}")).alias("body"))
    first = F.coalesce(*(F.get_json_object("body", p) for p in ("$.results", "$.features", "$.data", "$.dataset")))
    return body.select("page", F.json_array_length(first).cast("bigint").alias("n"))


# ---- B


@register("b05_path_hash", "SELECT c_nationkey, substr(sha1(string_agg(s, chr(10) ORDER BY s)), 1, 12) AS v FROM (SELECT DISTINCT c_nationkey, c_mktsegment AS s FROM customer) GROUP BY c_nationkey")
def path_hash(spark, sf_dir):
    from lodestone.functions.text import path_hash as hashed

    return frame(spark, sf_dir, "SELECT c_nationkey, c_mktsegment FROM customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("p")).select("c_nationkey", hashed(F.col("p")).alias("v"))


@register("b06_cell_seed")
def cell_seed(spark, sf_dir):
    """A seed that no other cell moves: CRC-32 of the key, as zlib has it; no such function in the oracle."""
    return frame(spark, sf_dir, "SELECT concat(lang, source) AS cell FROM documents").distinct().select("cell", F.crc32("cell").alias("seed"))


@register("b17_cell_spec", "SELECT doc_id, source AS target, concat(lang, '-', CAST(doc_id % 3 AS VARCHAR)) AS model, CASE WHEN doc_id % 2 = 0 THEN 'high' END AS effort, 10 + doc_id % 4 AS draws FROM documents")
def cell_spec(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT doc_id, concat(source, ':', lang, '-', CAST(doc_id % 3 AS STRING), CASE WHEN doc_id % 2 = 0 THEN '@high' ELSE '' END, ':', CAST(10 + doc_id % 4 AS STRING)) AS spec FROM documents")
    pattern = r"^([^:]+):(.+?)(?:@([^@:]+))?:(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract("spec", pattern, i), F.lit(""))
    checked = F.when(F.col("spec").rlike(pattern), part(1)).otherwise(F.raise_error(F.concat(F.lit("not a cell: "), "spec")))
    return d.select("doc_id", checked.alias("target"), part(2).alias("model"), part(3).alias("effort"), part(4).cast("bigint").alias("draws"))


# ---- C


@register("c22_routing", f"{L} SELECT DISTINCT host FROM l WHERE host NOT IN (SELECT concat('h', CAST(u AS VARCHAR)) FROM unnest([0, 4]) AS t(u))")
def routing(spark, sf_dir):
    """Hosts that take all wanted parameters."""
    d = ledger(spark, sf_dir).select("host").distinct()
    params = F.when(F.col("host").isin("h0", "h4"), F.array(F.lit("tools"))).otherwise(F.array(F.lit("tools"), F.lit("seed")))
    return d.where(F.size(F.array_except(F.array(F.lit("tools"), F.lit("seed")), params)) == 0)


@register("c25_schema_check", "SELECT n_name AS source, CASE WHEN n_nationkey % 4 = 0 THEN 'housing_units' ELSE '' END AS missing, n_nationkey % 4 = 0 AS critical FROM nation")
def schema_check(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT n_name AS source, n_nationkey FROM nation")
    live = F.when(F.col("n_nationkey") % 4 == 0, F.array(F.lit("permit_number"))).otherwise(F.array(F.lit("permit_number"), F.lit("housing_units")))
    missing = F.array_except(F.array(F.lit("permit_number"), F.lit("housing_units")), live)
    return d.select("source", F.array_join(missing, ",").alias("missing"), (F.size(missing) > 0).alias("critical"))


# ---- D, G, H
@register("d10_detail_units", f"{P} SELECT k, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 - k % 4 >= 0 THEN k % 5 - k % 4 END WHEN k % 3 = 1 THEN k % 5 END AS units FROM p")
def detail_units(spark, sf_dir):
    """Labels that end in units: an existing and a proposed count give their difference, never below zero; a lone
    proposed one is refused."""
    d = frame(spark, sf_dir, f"SELECT k FROM ({PERMITS})").withColumns({"a": F.col("k") % 5, "b": F.col("k") % 4})
    labels = F.when(F.col("k") % 3 == 0, F.create_map(F.lit("Proposed Units"), "a", F.lit("Existing Units"), "b")).when(F.col("k") % 3 == 1, F.create_map(F.lit("Number of Units"), "a", F.lit("HVAC Units"), "b")).otherwise(F.create_map(F.lit("Proposed Units"), "a"))
    units = F.map_filter(labels, lambda name, _: name.rlike("(?i)units?$") & ~name.rlike("(?i)hvac|air|cooling|heating"))
    of = lambda word: F.map_values(F.map_filter(units, lambda name, _: name.rlike(word)))
    new, old = of("(?i)proposed"), of("(?i)existing")
    plain = F.array_distinct(F.map_values(F.map_filter(units, lambda name, _: ~name.rlike("(?i)proposed|existing"))))
    delta = F.get(new, F.lit(0)) - F.get(old, F.lit(0))
    return d.select("k", F.when((F.size(new) == 1) & (F.size(old) == 1), F.when(delta >= 0, delta)).when((F.size(new) == 0) & (F.size(plain) == 1), F.get(plain, F.lit(0))).alias("units"))



# ---- I


@register("i16_bisection", """WITH RECURSIVE n AS (SELECT o_orderdate::DATE AS d, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT min(d) AS lo, max(d) AS hi, 0 AS depth, sum(n)::BIGINT AS n FROM n UNION ALL
  SELECT lo2, hi2, depth + 1, (SELECT coalesce(sum(n.n), 0)::BIGINT FROM n WHERE d BETWEEN lo2 AND hi2) FROM (SELECT depth, lo AS lo2, (lo + CAST((hi - lo) // 2 AS INT))::DATE AS hi2 FROM w WHERE n > 1000 AND depth < 6 AND lo < hi UNION ALL SELECT depth, (lo + CAST((hi - lo) // 2 AS INT) + 1)::DATE, hi FROM w WHERE n > 1000 AND depth < 6 AND lo < hi))
SELECT lo, hi, depth, n FROM w WHERE n <= 1000 OR depth = 6 OR lo = hi""")
def bisection(spark, sf_dir):
    return windows.bisect(frame(spark, sf_dir, "SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE)"), cap=1000, max_depth=6)


# ---- J


@register("j15_token_quantiles", f"{L}, s AS (SELECT model, list_sort(list(tokens)) AS xs FROM l GROUP BY model) SELECT model, list_aggregate(xs, 'median') AS p50, xs[CAST(floor(0.9 * (len(xs) - 1)) AS BIGINT) + 1] AS p90 FROM s")
def token_quantiles(spark, sf_dir):
    d = ledger(spark, sf_dir)
    return measures.ranked(d, "model", "tokens", {"p90": measures.floor_90()}).join(d.groupBy("model").agg(F.median("tokens").alias("p50")), "model")


@register("j19_failures", f"{L} SELECT model, host, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, string_agg(CAST(seconds AS VARCHAR), ',' ORDER BY row_id) AS seconds FROM l WHERE ok = 0 GROUP BY model, host")
def failures(spark, sf_dir):
    d = ledger(spark, sf_dir).where("ok = 0").groupBy("model", "host").agg(F.count("*").alias("n"), F.sum("tokens").cast("bigint").alias("tokens"), F.array_sort(F.collect_list(F.struct("row_id", "seconds"))).alias("s"))
    return d.select("model", "host", "n", "tokens", F.array_join(F.transform("s", lambda x: x["seconds"].cast("string")), ",").alias("seconds"))


# ---- K


@register("k07_expected_spend", f"WITH c AS ({CELLS}), t AS (SELECT cell, n, k, least(5, n) AS b FROM c WHERE n > 0) SELECT cell, round((SELECT sum(CASE WHEN n - k >= i THEN (SELECT coalesce(product((n - k - j) * 1e0 / (n - j)), 1e0) FROM unnest(range(0, i)) AS y(j)) ELSE 0e0 END) FROM unnest(range(0, b)) AS x(i)), 9) AS tries FROM t")
def expected_tries(spark, sf_dir):
    """Draws that best of five takes until the first success: the i-th is drawn if none of the i before was one."""
    c = frame(spark, sf_dir, CELLS).where("n > 0")
    none = lambda i: stats.ratio_product(F.col("n") - F.col("k"), F.col("n"), i)
    total = F.aggregate(F.sequence(F.lit(0), F.least(F.lit(5), F.col("n").cast("int")) - 1), F.lit(0.0), lambda s, i: s + none(i))
    return c.select("cell", F.round(total, 9).alias("tries"))


_CHOOSE = "(SELECT sum(CASE WHEN {m} >= p THEN (SELECT coalesce(product(greatest({m} - j, 0) * 1e0 / (n - 1 - j)), 1e0) FROM unnest(range(0, p)) AS y(j)) ELSE 0e0 END) FROM unnest(range(0, least(5, n))) AS x(p))"


@register("k07_best_of_k", f"""{D}, a AS (SELECT cell, count(*) AS n, count(*) FILTER (WHERE precision_min < 1) AS r, count(*) FILTER (WHERE precision_min = 1 AND perfect = 1) AS good, sum(CASE WHEN precision_min = 1 THEN usd ELSE 0 END) AS ua, sum(CASE WHEN precision_min < 1 THEN usd ELSE 0 END) AS ur FROM d WHERE usd IS NOT NULL GROUP BY cell)
SELECT cell, least(5, n) AS k, round(good * {_CHOOSE.format(m='r')} / n, 9) AS success, round((ua * {_CHOOSE.format(m='r')} + ur * coalesce({_CHOOSE.format(m='(r - 1)')}, 0)) / n, 6) AS usd FROM a""")
def best_of_k_exact(spark, sf_dir):
    d = draws(spark, sf_dir).where("usd is not null").withColumn("accepted", F.col("precision_min") == 1)
    return measures.best_of_k(d, "cell", 5)


@register("k20_reasoning_medians", f"{D}, s AS (SELECT outcome, list_sort(list(tokens)) AS xs FROM d GROUP BY outcome) SELECT outcome, xs[len(xs) // 2 + 1] AS tokens FROM s")
def reasoning_medians(spark, sf_dir):
    return measures.ranked(draws(spark, sf_dir), "outcome", "tokens", {"tokens": measures.upper_half()})


@register("k08_best_of_k")
def best_of_k(spark, sf_dir):
    """Bootstrap intervals; seeded by cell, so another cell moves none."""
    return simulate.best_of_k(draws(spark, sf_dir).where("outcome <> 'infra_error'"), k=5)


@register("k09_cost_simulation")
def cost_simulation(spark, sf_dir):
    """By target, condition (``cell`` stands for arm and protocol) and model."""
    return simulate.cost_per_success(draws(spark, sf_dir).where("outcome <> 'infra_error'"), ("target", "cell", "model"))


@register("k10_settled_pairs")
def settled_pairs(spark, sf_dir):
    return simulate.settled_pairs(draws(spark, sf_dir).where("outcome <> 'infra_error'"), ("target", "cell"))


# ---- L, N


@register("n09_revisions", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS base, sha256(concat(CAST(o_orderkey AS VARCHAR), '|', o_orderstatus)) AS key FROM orders")
def revisions(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT o_orderkey, o_orderstatus, concat(CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN '-R1' WHEN o_orderkey % 3 = 1 THEN '-REV2' ELSE '' END) AS id FROM orders")
    base = F.regexp_replace("id", r"(?i)-(R|REV)\d+$", "")
    return d.select("o_orderkey", base.alias("base"), F.sha2(F.concat_ws("|", base, "o_orderstatus"), 256).alias("key"))


def _host():
    return F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host")


def _templates(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT c_nationkey AS jurisdiction, c_mktsegment AS vendor, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE concat('fp1:', CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS STRING)) END AS mark FROM customer")


@register("a05_additive_migration", "SELECT c_custkey, c_name, '' AS fp FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name, c_mktsegment AS fp FROM customer WHERE c_custkey % 2 = 1")
def additive_migration(spark, sf_dir):
    old = frame(spark, sf_dir, "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
    new = frame(spark, sf_dir, "SELECT c_custkey, c_name, c_mktsegment AS fp FROM customer WHERE c_custkey % 2 = 1")
    return files.migrate(old, new.schema).unionByName(new)



@register("a07_merge", "SELECT c_custkey, coalesce(bucket, c_mktsegment) AS bucket FROM customer LEFT JOIN (SELECT c_custkey AS key, 'new' AS bucket FROM customer WHERE c_custkey % 9 = 0) b ON c_custkey = key")
def merge(spark, sf_dir):
    new = frame(spark, sf_dir, "SELECT c_custkey, 'new' AS bucket FROM customer WHERE c_custkey % 9 = 0")
    return files.merged(frame(spark, sf_dir, "SELECT c_custkey, c_mktsegment AS bucket FROM customer"), new, "c_custkey")



@register("a13_corpus", "SELECT DISTINCT user_id AS file FROM events WHERE event_type IN ('click', 'view') AND value > 10")
def corpus(spark, sf_dir):
    manifest = frame(spark, sf_dir, "SELECT user_id AS file, CASE WHEN event_type IN ('click', 'view') THEN '200' ELSE '404' END AS http_status, CASE WHEN value > 10 THEN 'ok' ELSE 'rejected' END AS verdict, 'T-INDEX' AS page_type FROM events")
    return files.corpus(manifest.withColumn("file", F.col("file").cast("string"))).select(F.col("file").cast("bigint").alias("file"))



@register("a15_long_table_counts", f"{D} SELECT target, model, count(*) AS n FROM d GROUP BY target, model")
def long_table_counts(spark, sf_dir):
    return measures.counts(draws(spark, sf_dir), "target", "model")



@register("a17_wide_outcomes", f"{D} SELECT cell, sum(CASE WHEN outcome = 'ok' THEN 1 ELSE 0 END) AS ok, sum(CASE WHEN outcome = 'raised' THEN 1 ELSE 0 END) AS raised, sum(CASE WHEN outcome = 'silent' THEN 1 ELSE 0 END) AS silent, sum(CASE WHEN outcome = 'infra_error' THEN 1 ELSE 0 END) AS infra FROM d GROUP BY cell")
def wide_outcomes(spark, sf_dir):
    return measures.wide_counts(draws(spark, sf_dir), "cell", "outcome", {"ok": "ok", "raised": "raised", "silent": "silent", "infra_error": "infra"})



@register("b14_short_names", f"{L}, p AS ({PRICES}) SELECT row_id, coalesce(concat('short-', price_model), model) AS short FROM l LEFT JOIN p ON model = price_model")
def short_names(spark, sf_dir):
    names = frame(spark, sf_dir, PRICES).select(F.col("price_model").alias("name"), F.concat(F.lit("short-"), "price_model").alias("short"))
    return measures.with_short_names(ledger(spark, sf_dir), names).select("row_id", "short")



@register("b16_cell_key", "SELECT doc_id, concat_ws('|', source, lang, CASE WHEN doc_id % 2 = 0 THEN 'hint' END) AS cell FROM documents")
def cell_key(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT doc_id, source, lang FROM documents")
    return d.select("doc_id", measures.cell_key(F.col("source"), F.col("lang"), None, F.when(F.col("doc_id") % 2 == 0, "hint")).alias("cell"))



@register("c14_near_miss", f"WITH d AS (SELECT *, CASE WHEN draw_id % 4 < 2 THEN 0.99e0 ELSE 0.97e0 END AS recall_mean FROM ({DRAWS})) SELECT draw_id FROM d WHERE NOT (recall_min = 1 AND precision_min = 1) AND recall_mean >= 0.98 AND precision_min = 1")
def near_miss(spark, sf_dir):
    d = draws(spark, sf_dir).withColumn("recall_mean", F.when(F.col("draw_id") % 4 < 2, 0.99).otherwise(0.97))
    return d.where(measures.near_miss(F.col("recall_mean"), F.col("recall_min"), F.col("precision_min"))).select("draw_id")



@register("c16_stream_end", f"{L} SELECT model, CASE WHEN stop_reason = 'max_tokens' THEN 'at-cap' WHEN stop_reason IS NULL AND tokens = 0 THEN 'silent' WHEN stop_reason IS NULL THEN 'cut' WHEN tokens >= 300 THEN 'full' ELSE 'ended' END AS wall, count(*) AS n FROM l GROUP BY 1, 2")
def stream_end(spark, sf_dir):
    return measures.counts(ledger(spark, sf_dir).withColumn("wall", measures.stream_end(F.col("stop_reason"), F.col("tokens"), 300)), "model", "wall")



@register("c19_field_hints", "SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 'date' WHEN lower(o_orderpriority) LIKE '%low%' OR lower(o_orderpriority) LIKE '%medium%' THEN 'unit' ELSE 'worktype' END AS field FROM orders")
def field_hints(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT o_orderkey, o_orderpriority FROM orders").select("o_orderkey", measures.field_hint(F.col("o_orderpriority")).alias("field"))



@register("c20_trust_filter", "SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'no body' WHEN page_id % 9 = 0 THEN 'rejected' WHEN length(html) < 1500 THEN 'too small' WHEN url LIKE '%#%' THEN 'fragment' WHEN page_id % 30 < 15 THEN 'too few paths' END AS reason FROM pages")
def trust_filter(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT page_id, url, html FROM pages").withColumn("verdict", F.when(F.col("page_id") % 9 == 0, "rejected").otherwise("ok"))
    return d.select("page_id", measures.drop_reason(F.col("html"), F.col("url"), F.col("verdict"), F.col("page_id") % 30, 1500, 15).alias("reason"))



@register("c26_failed_kinds", f"{L} SELECT host, CASE WHEN tokens = 0 THEN 'no usage' WHEN seconds > 80 THEN 'timeout' WHEN stop_reason IS NULL THEN 'host cut' ELSE 'api error' END AS kind, count(*) AS n FROM l WHERE ok = 0 GROUP BY 1, 2")
def failed_kinds(spark, sf_dir):
    return measures.counts(ledger(spark, sf_dir).where("ok = 0").withColumn("kind", measures.failed_kind(F.col("tokens"), F.col("seconds"), F.col("stop_reason"))), "host", "kind")



@register("g08_representative", "SELECT host, page_id FROM (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, page_id, row_number() OVER (PARTITION BY split_part(split_part(url, '://', 2), '/', 1) ORDER BY length(html) DESC, page_id) AS r FROM pages) WHERE r = 1")
def representative(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT page_id, url, html FROM pages").select("page_id", _host(), F.length("html").alias("size"))
    return measures.first_in_group(d, "host", F.desc("size"), F.col("page_id")).select("host", "page_id")



@register("g10_distribution", "WITH v AS (SELECT c_nationkey AS g, c_acctbal AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT g, min(x) AS low, max(CASE WHEN r = least(n, CAST(floor(0.25 * n) AS BIGINT) + 1) THEN x END) AS p25, max(CASE WHEN r = least(n, CAST(floor(0.5 * n) AS BIGINT) + 1) THEN x END) AS p50, max(CASE WHEN r = least(n, CAST(floor(0.95 * n) AS BIGINT) + 1) THEN x END) AS p95, max(x) AS high FROM v GROUP BY g")
def distribution(spark, sf_dir):
    return measures.quantiles(frame(spark, sf_dir, "SELECT c_nationkey AS g, c_acctbal AS x FROM customer"), "g", "x", {"p25": 0.25, "p50": 0.5, "p95": 0.95})



@register("g11_shared_templates", "SELECT concat('fp1:', CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR)) AS mark, count(DISTINCT c_nationkey) AS jurisdictions FROM customer WHERE c_custkey % 10 <> 0 GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def shared_templates(spark, sf_dir):
    return measures.shared_marks(_templates(spark, sf_dir))



@register("g12_vendor_crosstab", "WITH v AS (SELECT c_mktsegment AS vendor, count(DISTINCT c_nationkey) AS jurisdictions, count(DISTINCT CAST(floor(c_acctbal / 100) AS BIGINT)) AS templates FROM customer WHERE c_custkey % 10 <> 0 GROUP BY c_mktsegment) SELECT *, CASE WHEN templates = 1 THEN 'one template' WHEN templates < jurisdictions THEN 'some shared' ELSE 'no exact reuse' END AS verdict FROM v WHERE jurisdictions >= 2")
def vendor_crosstab(spark, sf_dir):
    return measures.vendor_crosstab(_templates(spark, sf_dir))



@register("h04_outcome", f"{L} SELECT row_id, CASE WHEN ok = 0 THEN 'infra_error' WHEN stop_reason IS NULL THEN 'no_code' WHEN stop_reason = 'max_tokens' THEN 'refused' WHEN seconds > 60 THEN 'raised' ELSE 'scored' END AS outcome FROM l")
def outcome(spark, sf_dir):
    steps = [F.col("ok") == 1, F.col("stop_reason").isNotNull(), F.coalesce(F.col("stop_reason") != "max_tokens", F.lit(True)), F.col("seconds") <= 60]
    return ledger(spark, sf_dir).select("row_id", measures.outcome(*steps).alias("outcome"))



@register("h06_reference_free", "WITH r AS (SELECT l_orderkey % 300 AS page, l_orderkey, l_linenumber FROM lineitem) SELECT page, count(*) = 20 AS rows, count(*) FILTER (WHERE l_orderkey % 41 = 0) = 0 AND count(DISTINCT CASE WHEN l_orderkey % 41 <> 0 THEN l_orderkey * 10 + least(l_linenumber, 5) END) = count(*) AS ids, count(*) FILTER (WHERE l_orderkey % 53 = 0) = 0 AS clean, count(*) FILTER (WHERE l_linenumber <> 4) >= 0.9 * count(*) AS dates FROM r GROUP BY page")
def reference_free(spark, sf_dir):
    rows = frame(spark, sf_dir, "SELECT l_orderkey % 300 AS page, CASE WHEN l_orderkey % 41 = 0 THEN ' ' ELSE concat(CAST(l_orderkey AS STRING), '-', CAST(least(l_linenumber, 5) AS STRING)) END AS id, CASE WHEN l_orderkey % 53 = 0 THEN concat('<b>', l_returnflag, '</b>') ELSE l_returnflag END AS mode, CASE WHEN l_linenumber = 4 THEN 'soon' ELSE concat(CAST(l_linenumber AS STRING), '/2/2024') END AS issued FROM lineitem")
    return measures.check_rows(rows, "page", "id", "issued", ["id", "mode", "issued"], 20)



@register("h07_expected_rows", "WITH r AS (SELECT o_custkey % 40 AS portal, o_custkey AS page, 4 + o_orderkey % 3 AS width FROM orders), c AS (SELECT portal, width, count(*) AS n FROM r GROUP BY portal, width), m AS (SELECT portal, arg_max(width, n * 100 - width) AS mode FROM c GROUP BY portal) SELECT portal, page, count(*) FILTER (WHERE width = mode) AS expected FROM r JOIN m USING (portal) GROUP BY portal, page")
def expected_rows(spark, sf_dir):
    return measures.expected_rows(frame(spark, sf_dir, "SELECT o_custkey % 40 AS portal, o_custkey AS page, 4 + o_orderkey % 3 AS width FROM orders"), "portal", "page", "width")



@register("h08_empty_columns", "SELECT l_suppkey, count(*) FILTER (WHERE l_tax > 0.02) = 0 AS tax_empty, count(*) FILTER (WHERE l_linenumber > 3) = 0 AS line_empty FROM lineitem GROUP BY l_suppkey")
def empty_columns(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT l_suppkey, CASE WHEN l_tax > 0.02 THEN l_tax END AS tax, CASE WHEN l_linenumber > 3 THEN 'x' ELSE '' END AS line FROM lineitem")
    return measures.empty_fields(d, "l_suppkey", ["tax", "line"])



@register("h10_field_audit", f"{D} SELECT target, sum(1 - perfect) AS disagreements, bool_and(perfect = 1) AS still_perfect FROM d GROUP BY target")
def field_audit(spark, sf_dir):
    return draws(spark, sf_dir).groupBy("target").agg(F.sum(1 - F.col("perfect")).alias("disagreements"), F.bool_and(F.col("perfect") == 1).alias("still_perfect"))



@register("e05_unknown_kinds", f"{P} SELECT source_id, sum(CASE WHEN trim(kind_text) = '' THEN 1 ELSE 0 END) AS unknown, sum(CASE WHEN trim(native_id) = '' THEN 1 ELSE 0 END) AS rejected FROM p GROUP BY source_id")
def unknown_kinds(spark, sf_dir):
    ok, rejected = records.identity_gate(permits(spark, sf_dir))
    n = measures.counts(rejected, "source_id").withColumnRenamed("n", "rejected")
    unknown = permits(spark, sf_dir).groupBy("source_id").agg(F.count_if(F.trim("kind_text") == "").alias("unknown"))
    return unknown.join(n, "source_id", "left").select("source_id", "unknown", F.coalesce("rejected", F.lit(0)).alias("rejected"))



@register("i09_decision_flags", f"WITH o AS ({OFFICE_MONTHS}) SELECT source_id, avg(CASE WHEN usable = 'Y' THEN 100e0 ELSE 0e0 END) >= 60 AS proceed, avg(CASE WHEN usable = 'Y' THEN 100e0 ELSE 0e0 END) < 30 AS stop FROM o GROUP BY source_id")
def decision_flags(spark, sf_dir):
    d = frame(spark, sf_dir, OFFICE_MONTHS).groupBy("source_id").agg(measures.share(F.col("usable") == "Y").alias("s"))
    return d.select("source_id", (100 * F.col("s") >= 60).alias("proceed"), (100 * F.col("s") < 30).alias("stop"))



@register("i10_strata", "SELECT c_custkey, CASE WHEN d = 1 THEN 'top' WHEN d IN (5, 6) THEN 'middle' ELSE 'rest' END AS stratum FROM (SELECT c_custkey, ntile(10) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS d FROM customer)")
def strata(spark, sf_dir):
    from pyspark.sql import Window

    d = frame(spark, sf_dir, "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
    tenth = F.ntile(10).over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return d.withColumn("d", tenth).select("c_custkey", F.when(F.col("d") == 1, "top").when(F.col("d").isin(5, 6), "middle").otherwise("rest").alias("stratum"))



@register("i18_economics", "SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, round(sum(length(html)) / 1024e0 / count(*), 6) AS kb_per_page, count(*) AS pages FROM pages GROUP BY split_part(split_part(url, '://', 2), '/', 1)")
def economics(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT page_id, url, html FROM pages").select(_host(), F.length("html").alias("size"))
    return d.groupBy("host").agg(F.round(F.sum("size") / 1024.0 / F.count("*"), 6).alias("kb_per_page"), F.count("*").alias("pages"))



@register("i21_rule_of_three", "SELECT c_nationkey, round(300e0 / count(*), 9) AS bound FROM customer GROUP BY c_nationkey")
def rule_of_three(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT c_nationkey FROM customer").groupBy("c_nationkey").agg(F.round(stats.rule_of_three(F.count("*")), 9).alias("bound"))



@register("j02_variance_calls", f"{L} SELECT count(*) AS n, round(sum(usd), 4) AS usd FROM l WHERE call_class = 'synthesis' AND ok = 1 AND row_id % 2 = 0")
def variance_calls(spark, sf_dir):
    return ledger(spark, sf_dir).where("call_class = 'synthesis' AND ok = 1 AND row_id % 2 = 0").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 4).alias("usd"))



@register("j05_drift_rows", f"{D} SELECT target, model, perfect AS survived, count(*) AS n FROM d WHERE outcome <> 'infra_error' AND cell <> 'c0' GROUP BY target, model, perfect")
def drift_rows(spark, sf_dir):
    return measures.counts(draws(spark, sf_dir).where("outcome <> 'infra_error' AND cell <> 'c0'").withColumnRenamed("perfect", "survived"), "target", "model", "survived")



@register("j06_ledger_rows", f"{L} SELECT metric, count(v) AS n, round(sum(v), 4) AS total FROM (SELECT 'usd' AS metric, usd AS v FROM l UNION ALL SELECT 'seconds', CAST(seconds AS DOUBLE) FROM l UNION ALL SELECT 'tokens', CAST(tokens AS DOUBLE) FROM l) x GROUP BY metric")
def ledger_rows(spark, sf_dir):
    d = rollup.unpivot(ledger(spark, sf_dir), ["row_id"], ["usd", "seconds", "tokens"])
    return d.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))



@register("j07_pick", f"{D} SELECT draw_id, usd AS value FROM d WHERE target = 't1' AND model = 'm2' AND usd IS NOT NULL")
def pick(spark, sf_dir):
    return measures.pick(rollup.unpivot(draws(spark, sf_dir), ["draw_id", "target", "model"], ["usd", "seconds"]), "usd", target="t1", model="m2").select("draw_id", "value")



@register("j09_field_verdict", f"{D} SELECT draw_id, CASE WHEN outcome IN ('infra_error', 'raised') THEN NULL WHEN perfect = 1 AND precision_min = 1 THEN 1 ELSE 0 END AS field_ok FROM d")
def field_verdict(spark, sf_dir):
    d = draws(spark, sf_dir)
    v = measures.field_verdict(F.col("outcome").isin("infra_error", "raised"), F.col("perfect") == 1, F.when(F.col("precision_min") == 1, 0).otherwise(1))
    return d.select("draw_id", v.alias("field_ok"))



@register("j10_exclusions", f"{D} SELECT cell, count(*) AS n FROM d WHERE NOT EXISTS (SELECT 1 FROM (SELECT 'c1' AS xc, 0 AS xd UNION ALL SELECT 'c2', 3) x WHERE xc = cell AND xd = draw) GROUP BY cell")
def exclusions(spark, sf_dir):
    excluded = spark.createDataFrame([("c1", 0), ("c2", 3)], "cell string, draw long")
    return measures.counts(measures.without_excluded(draws(spark, sf_dir), excluded), "cell")



@register("j14_price_ratio", f"{L}, p AS ({PRICES}) SELECT host, round(median(usd / per_token), 9) AS ratio FROM l JOIN p ON model = price_model GROUP BY host")
def price_ratio(spark, sf_dir):
    return measures.price_ratio(ledger(spark, sf_dir), frame(spark, sf_dir, PRICES), "host")



@register("j16_budget", f"""WITH RECURSIVE l AS ({LEDGER}), o AS (SELECT model, row_id, usd, usd * 1.5 AS worst, row_number() OVER (PARTITION BY model ORDER BY row_id) AS r FROM l WHERE ok = 1),
f AS (SELECT model, row_id, r, usd, usd * 1.5 <= 500 AS let, CASE WHEN worst <= 500 THEN usd ELSE 0e0 END AS spent FROM o WHERE r = 1 UNION ALL SELECT o.model, o.row_id, o.r, o.usd, f.spent + o.worst <= 500, CASE WHEN f.spent + o.worst <= 500 THEN f.spent + o.usd ELSE f.spent END FROM f JOIN o ON o.model = f.model AND o.r = f.r + 1)
SELECT model, row_id, round(spent, 4) AS spent FROM f WHERE let""")
def budget(spark, sf_dir):
    d = ledger(spark, sf_dir).where("ok = 1").withColumn("worst", F.col("usd") * 1.5)
    return measures.admitted(d, "model", 500.0).select("model", "row_id", F.round("spent", 4).alias("spent"))



@register("j20_anomalies", f"{L} SELECT row_id FROM l WHERE ok = 1 AND ((stop_reason IS NULL AND tokens < 300) OR (stop_reason = 'max_tokens' AND tokens < 300))")
def anomalies(spark, sf_dir):
    return ledger(spark, sf_dir).where(F.col("ok") == 1).where((F.col("tokens") < 300) & (F.col("stop_reason").isNull() | (F.col("stop_reason") == "max_tokens"))).select("row_id")



@register("j23_scenarios", f"{L}, s AS (SELECT 1 AS cut, 30 AS most UNION ALL SELECT 2, 60 UNION ALL SELECT 3, 90) SELECT cut, model, count(*) AS calls, round(sum(usd), 4) AS usd FROM s JOIN l ON seconds < most GROUP BY cut, model")
def scenarios(spark, sf_dir):
    return measures.projections(ledger(spark, sf_dir), {1: 30, 2: 60, 3: 90})



@register("k14_cost_per_success", f"{D}, a AS (SELECT model, count(*) AS n, sum(perfect) AS k, avg(usd) AS c FROM d GROUP BY model), w AS (SELECT model, n, k, c, {LO} AS lo, {HI} AS hi FROM a) SELECT a.model AS dear, b.model AS cheap, round((a.c * a.n / a.k) / (b.c * b.n / b.k), 6) AS ratio FROM w a JOIN w b ON a.c / a.hi > b.c / nullif(b.lo, 0)")
def cost_per_success(spark, sf_dir):
    return measures.reversals(measures.cost_intervals(draws(spark, sf_dir)))



@register("k17_stop_chance", f"WITH c AS ({CELLS}) SELECT cell, round(power(k * 1e0 / n, 10) + power(1 - k * 1e0 / n, 10), 9) AS p_stop, round(10 + 10 * (1 - power(k * 1e0 / n, 10) - power(1 - k * 1e0 / n, 10)), 9) AS draws FROM c WHERE n > 0")
def stop_chance(spark, sf_dir):
    return measures.stop_chance(cells(spark, sf_dir))



@register("k11_contrasts", f"{D}, a AS (SELECT model, sum(CASE WHEN target = 't1' THEN perfect ELSE 0 END) AS k1, sum(CASE WHEN target = 't1' THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN target = 't2' THEN perfect ELSE 0 END) AS k2, sum(CASE WHEN target = 't2' THEN 1 ELSE 0 END) AS n2 FROM d GROUP BY model), w AS (SELECT *, k1 * 1.0 / n1 AS p1, k2 * 1.0 / n2 AS p2, {wilson_sql('k1', 'n1')[0]} AS l1, {wilson_sql('k1', 'n1')[1]} AS h1, {wilson_sql('k2', 'n2')[0]} AS l2, {wilson_sql('k2', 'n2')[1]} AS h2 FROM a WHERE n1 > 0 AND n2 > 0) SELECT model, round(p1 - p2, 9) AS d, round(p1 - p2 - sqrt((p1 - l1) ** 2 + (h2 - p2) ** 2), 9) AS lo, round(p1 - p2 + sqrt((h1 - p1) ** 2 + (p2 - l2) ** 2), 9) AS hi FROM w")
def contrasts(spark, sf_dir):
    return measures.contrasts(draws(spark, sf_dir), "target", "t1", "t2")



@register("l05_submitted", "SELECT count(*) AS n FROM (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id) x WHERE last % 4 = 3")
def submitted(spark, sf_dir):
    last = frame(spark, sf_dir, "SELECT conv_id, turn FROM conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return last.agg(F.count_if(F.col("last") % 4 == 3).alias("n"))



@register("l04_budget_stops", "SELECT conv_id, min(turn) AS stop FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS spent FROM conversations) x WHERE spent > 1500 GROUP BY conv_id")
def budget_stops(spark, sf_dir):
    return measures.budget_stop(frame(spark, sf_dir, "SELECT conv_id, turn, text FROM conversations"), "conv_id", "turn", F.length("text"), 1500)



@register("n01_link_live", "SELECT n_nationkey AS office, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) AS live, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) AS worklist FROM nation")
def link_live(spark, sf_dir):
    offices = frame(spark, sf_dir, "SELECT n_nationkey AS office FROM nation")
    links = frame(spark, sf_dir, "SELECT c_nationkey AS office, c_acctbal > 0 AS live FROM customer")
    return measures.live_links(offices, links, frame(spark, sf_dir, "SELECT s_nationkey AS office FROM supplier"))



@register("n02_as_of", f"{O} SELECT entity, milestone, max(seq) AS seq FROM o WHERE observed_at < TIMESTAMP '2024-01-15 00:00:00' AND seq % 7 <> 0 GROUP BY entity, milestone")
def as_of(spark, sf_dir):
    return measures.as_of(frame(spark, sf_dir, LOG), ["entity", "milestone"], "seq", F.lit("2024-01-15 00:00:00").cast("timestamp"), F.col("seq") % 7 == 0)



@register("n03_pessimistic_tier", "SELECT c_nationkey, min(c_custkey % 4 * 0.25) AS worst, max(c_custkey % 4 * 0.25) AS best FROM customer GROUP BY c_nationkey")
def pessimistic_tier(spark, sf_dir):
    return measures.pessimistic(frame(spark, sf_dir, "SELECT c_nationkey, c_custkey % 4 * 0.25 AS sure FROM customer"), "c_nationkey", "sure")



@register("n04_precedence", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS r FROM customer) x WHERE r = 1")
def precedence(spark, sf_dir):
    return measures.first_in_group(frame(spark, sf_dir, "SELECT c_nationkey, c_custkey, c_mktsegment FROM customer"), "c_nationkey", F.col("c_mktsegment"), F.col("c_custkey")).select("c_nationkey", "c_custkey")



@register("n08_monotone", f"{O}, r AS (SELECT entity, seq, CASE milestone WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS rk FROM o) SELECT entity, count(*) AS alarms FROM (SELECT entity, rk < lag(rk) OVER (PARTITION BY entity ORDER BY seq) AS back FROM r) x WHERE back GROUP BY entity")
def monotone(spark, sf_dir):
    return measures.backward_steps(frame(spark, sf_dir, LOG), {"view": 1, "click": 2, "signup": 3})



@register("n11_mapped_share", f"{O} SELECT milestone, round(avg(CASE WHEN entity % 4 = 0 THEN 0e0 ELSE 1e0 END), 9) AS share FROM o GROUP BY milestone")
def mapped_share(spark, sf_dir):
    return frame(spark, sf_dir, LOG).groupBy("milestone").agg(F.round(measures.share(F.col("entity") % 4 != 0), 9).alias("share"))
