"""Functions over index grids, detail pages and forms, rendered from the order tables so that parsing gives them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import markup, text
from lodestone.plans.base import frame, register

INDEX = "SELECT o_custkey AS page, o_orderkey AS k, concat('<tr class=\"Row\"><td><a href=\"javascript:PopPermit(''', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END, ''')\">x</a></td><td>', o_orderstatus, '</td><td> ', CAST(o_orderkey % 1000 AS STRING), ' &amp; co</td></tr>') AS html FROM orders"
DETAIL = "SELECT c_custkey, concat('<script>var a = \"<label>no</label>\";</script><label>Status</label><span>', c_mktsegment, '</span><label>Units</label><span> ', CAST(c_custkey % 9 AS STRING), ' </span><label>Status</label><span>late</span>', '<input type=\"hidden\" name=\"__VIEWSTATE\" value=\"', repeat('A', CAST(c_custkey % 50 AS INT)), '\"><input type=\"hidden\" name=\"__KEY\" value=\"k', CAST(c_custkey AS STRING), '\">', CASE WHEN c_custkey % 10 = 0 THEN 'Only the first 500 records are shown' ELSE '' END) AS html FROM customer"


def details(spark, sf_dir):
    return frame(spark, sf_dir, DETAIL)


@register("f03_index_rows", "SELECT o_custkey AS page, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, concat(CAST(o_orderkey % 1000 AS VARCHAR), ' & co') AS owner FROM orders WHERE o_orderkey % 19 <> 0")
def index_rows(spark, sf_dir):
    """Rows of a grid by position; rows without an identifier are dropped."""
    d = frame(spark, sf_dir, INDEX).withColumn("id", F.regexp_extract("html", r"PopPermit\('([^']*)'\)", 1)).where("id <> ''")
    cells = F.transform(F.regexp_extract_all("html", F.lit(markup.CELL), 1), text.fragment_text)
    return d.select("page", "id", F.get(cells, F.lit(1)).alias("status"), F.get(cells, F.lit(2)).alias("owner"))


@register("f05_detail_fields", "SELECT c_custkey, c_mktsegment AS status, CAST(c_custkey % 9 AS VARCHAR) AS units, 2 AS n_fields FROM customer")
def detail_fields(spark, sf_dir):
    """Labels and values outside scripts; the first of a label wins."""
    d = details(spark, sf_dir).withColumn("m", markup.without_scripts(F.col("html")))
    pairs = F.arrays_zip(F.regexp_extract_all("m", F.lit(r"(?is)<label>(.*?)</label>"), 1).alias("k"), F.transform(F.regexp_extract_all("m", F.lit(r"(?is)</label>\s*<span>(.*?)</span>"), 1), text.fragment_text).alias("v"))
    d = d.withColumn("pairs", pairs)
    names = F.transform("pairs", lambda p: p["k"])
    first = F.filter("pairs", lambda p, i: F.array_position(names, p["k"]) == i + 1)
    fields = F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"])))
    return d.select("c_custkey", fields.alias("f")).select("c_custkey", F.try_element_at("f", F.lit("Status")).alias("status"), F.try_element_at("f", F.lit("Units")).alias("units"), F.size("f").alias("n_fields"))


@register("f09_viewstate_bytes", "SELECT c_custkey, c_custkey % 50 AS n FROM customer")
def viewstate_bytes(spark, sf_dir):
    sizes = F.transform(F.regexp_extract_all("html", F.lit(r'(?is)name="__VIEWSTATE[^"]*"[^>]*value="([^"]*)"'), 1), F.length)
    return details(spark, sf_dir).select("c_custkey", F.aggregate(sizes, F.lit(0), lambda a, b: a + b).cast("bigint").alias("n"))


@register("c17_page_complete", "SELECT c_custkey, c_custkey % 10 <> 0 AS complete FROM customer")
def page_complete(spark, sf_dir):
    return details(spark, sf_dir).select("c_custkey", (~F.col("html").rlike(r"(?i)only the first \d+ records")).alias("complete"))


@register("f10_data_rows", "SELECT o_custkey AS page, count(*) AS rows, 0 AS wide FROM orders GROUP BY o_custkey")
def data_rows(spark, sf_dir):
    """Rows with three cells or more, and with four or more."""
    cells = F.regexp_count("html", F.lit(r"(?i)<t[dh][^>]*>"))
    return frame(spark, sf_dir, INDEX).groupBy("page").agg(F.count_if(cells >= 3).alias("rows"), F.count_if(cells >= 4).cast("int").alias("wide"))
