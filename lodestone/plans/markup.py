"""Page functions over ``pages`` and over grids rendered from permit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import markup, text
from lodestone.operators import similarity
from lodestone.plans.base import frame, register
from lodestone.sources.shared import settled

#: One result grid for each customer, two for some; rows come back as they went in.
GRIDS = """
SELECT o_custkey AS grid, concat('<table id="g', CAST(o_custkey AS STRING), '"><tr><th>Permit No</th><th>Status</th><th>Total</th></tr>', {agg}, '</table>') AS html
FROM orders GROUP BY o_custkey
"""
CELL = "concat('<tr class=\"Row\"><td><b>', CAST(o_orderkey AS STRING), '</b></td><td>', o_orderstatus, ' &amp; x</td><td>', CAST(o_orderkey % 1000 AS STRING), '</td>', CASE WHEN o_orderkey % 7 = 0 THEN '<td>extra</td>' ELSE '' END, '</tr>')"
SPARK_GRIDS = GRIDS.format(agg=f"listagg({CELL}, '') WITHIN GROUP (ORDER BY o_orderkey)")


def pages(spark, sf_dir):
    return frame(spark, sf_dir, "SELECT page_id, url, html FROM pages")


def rows(spark, sf_dir):
    return markup.grid_rows(frame(spark, sf_dir, SPARK_GRIDS))


@register("f01_grid_cells", "SELECT o_custkey AS grid, CAST(o_orderkey AS VARCHAR) AS id, concat(o_orderstatus, ' & x') AS status, CAST(o_orderkey % 1000 AS VARCHAR) AS total FROM orders")
def grid_cells(spark, sf_dir):
    """Parsing gives back the orders that the grids were rendered from."""
    d = rows(spark, sf_dir).where(F.get("cells", F.lit(0)) != "Permit No")
    return d.select("grid", *(F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(("id", "status", "total"))))


@register("f12_modal_width", "WITH w AS (SELECT o_custkey AS grid, CASE WHEN o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS width FROM orders UNION ALL SELECT DISTINCT o_custkey, 3 FROM orders), n AS (SELECT grid, width, count(*) AS n FROM w GROUP BY grid, width) SELECT grid, arg_max(width, n * 10 + width) AS width, max(n) AS n FROM n GROUP BY grid")
def modal_width(spark, sf_dir):
    return markup.modal_width(rows(spark, sf_dir), ["grid"])


@register("f08_level_one", r"SELECT page_id, length(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')) AS n FROM pages")
def level_one(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.length(markup.without_scripts(F.col("html"))).alias("n"))


@register("f18_page_sizes", r"WITH s AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, length(html) AS raw FROM pages) SELECT host, count(*) AS n, min(raw) AS low, max(raw) AS high, round(avg(raw), 6) AS mean, median(raw) AS median FROM s GROUP BY host")
def page_sizes(spark, sf_dir):
    d = pages(spark, sf_dir).select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.length("html").alias("raw"))
    return d.groupBy("host").agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"), F.round(F.avg("raw"), 6).alias("mean"), F.median("raw").alias("median"))


@register("f19_links", r"""WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>.*?</a>', 1) AS u, regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]*"[^>]*>(.*?)</a>', 1) AS l FROM pages),
e AS (SELECT page_id, i - 1 AS place, u[i] AS url, l[i] AS label FROM a, unnest(range(1, len(u) + 1)) AS x(i)),
f AS (SELECT page_id, url, min(place) AS place, arg_min(label, place) AS label FROM e WHERE NOT regexp_matches(url, '^(#|mailto:|tel:|javascript:)') GROUP BY page_id, url),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS n FROM f)
SELECT page_id, n, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(label, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '\s+', ' ', 'g')) AS label FROM r WHERE n < 25""")
def links(spark, sf_dir):
    return markup.links(pages(spark, sf_dir))


@register("f20_titles", r"SELECT page_id, substr(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&nbsp;', ' '), '\s+', ' ', 'g')), 1, 160) AS title FROM pages")
def titles(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", markup.title(F.col("html")).alias("title"))


@register("c24_vendor_signatures", "SELECT page_id, concat_ws(',', CASE WHEN contains(html, '<article>') THEN 'article' END, CASE WHEN contains(html, 'class=\"ad\"') THEN 'adserver' END, CASE WHEN contains(html, 'track(') THEN 'tracker' END) AS vendors FROM pages")
def vendor_signatures(spark, sf_dir):
    signs = {"article": "<article>", "adserver": 'class="ad"', "tracker": "track("}
    return pages(spark, sf_dir).select("page_id", F.array_join(F.array_compact(F.array(*(F.when(F.contains("html", F.lit(s)), v) for v, s in signs.items()))), ",").alias("vendors"))


@register("g01_fingerprints")
def fingerprints(spark, sf_dir):
    return markup.fingerprints(pages(spark, sf_dir)).select("page_id", F.size("paths").alias("n_paths"), "n_nodes", "mark")


@register("g05_similar_pairs")
def similar_pairs(spark, sf_dir):
    return similarity.pairs(markup.fingerprints(pages(spark, sf_dir)), 0.8)


@register("g06_clusters")
def clusters(spark, sf_dir):
    return similarity.clusters(markup.fingerprints(pages(spark, sf_dir)), 0.8)


@register("g07_cohort_curve")
def cohort_curve(spark, sf_dir):
    found = settled(markup.fingerprints(pages(spark, sf_dir)).select("page_id", "paths"))
    curve = [similarity.cohort(similarity.clusters(found, t)).withColumn("threshold", F.lit(t)) for t in (0.95, 0.9, 0.8)]
    return curve[0].unionByName(curve[1]).unionByName(curve[2])


_WORDS = r"(SELECT doc_id % 400 AS g, list_sort(list(DISTINCT lang || source)) AS p FROM documents GROUP BY 1)"


@register("g03_jaccard", f"WITH s AS {_WORDS} SELECT a.g AS a, b.g AS b, round(len(list_intersect(a.p, b.p)) * 1.0 / len(list_distinct(list_concat(a.p, b.p))), 9) AS j FROM s a JOIN s b ON b.g = a.g + 1")
def jaccard(spark, sf_dir):
    s = frame(spark, sf_dir, "SELECT doc_id % 400 AS g, array_sort(collect_set(concat(lang, source))) AS p FROM documents GROUP BY doc_id % 400")
    j = s.alias("a").join(s.alias("b"), F.col("b.g") == F.col("a.g") + 1)
    return j.select(F.col("a.g").alias("a"), F.col("b.g").alias("b"), F.round(markup.jaccard(F.col("a.p"), F.col("b.p")), 9).alias("j"))


@register("b15_mark_parse", r"SELECT page_id, 'fp' || (page_id % 3) AS version, CASE WHEN page_id % 3 = 1 THEN true ELSE false END AS comparable FROM pages")
def mark_parse(spark, sf_dir):
    d = pages(spark, sf_dir).select("page_id", F.concat(F.lit("fp"), (F.col("page_id") % 3).cast("string"), F.lit(":"), F.substr(F.sha1("url"), F.lit(1), F.lit(12))).alias("mark"))
    pattern = r"^([a-z0-9]+):([0-9a-f]{6,40})$"
    return d.select("page_id", F.regexp_extract("mark", pattern, 1).alias("version"), (F.regexp_extract("mark", pattern, 1) == markup.VERSION).alias("comparable"))


@register("g09_largest_gap", "WITH v AS (SELECT DISTINCT length(html) AS x, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages), g AS (SELECT host, x, lead(x) OVER (PARTITION BY host ORDER BY x) - x AS gap FROM v) SELECT host, max(gap) AS gap, arg_max(x, gap * 1000000000 - x) AS below FROM g WHERE gap IS NOT NULL GROUP BY host")
def largest_gap(spark, sf_dir):
    from pyspark.sql.window import Window

    d = pages(spark, sf_dir).select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"), F.length("html").alias("x")).distinct()
    g = d.withColumn("gap", F.lead("x").over(Window.partitionBy("host").orderBy("x")) - F.col("x")).where("gap is not null")
    return g.groupBy("host").agg(F.max("gap").alias("gap"), F.max_by("x", F.struct("gap", -F.col("x"))).alias("below"))
