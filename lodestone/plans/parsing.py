"""Parsers, strip levels, excerpts and code checks over pages and replies rendered from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import grids, markup, mutate, pagecode, verdict
from lodestone.plans.base import frame, register

KEY = "CAST(o_orderkey AS STRING)"
_HEADS = "'<th>Date</th><th>Permit Number</th><th>Permit Type</th><th>Status</th><th></th>'"
_BAND = f"concat('<tr class=\"ACA_TabRow_', CASE WHEN o_orderkey % 2 = 0 THEN 'Even' ELSE 'Odd' END, '\"><td>01/02/2024</td><td><span id=\"x_lblPermitNumber1\">', CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE concat('B', {KEY}) END, '</span></td><td>', o_orderpriority, ' &amp; co</td><td>', o_orderstatus, '</td><td>', CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(10 + o_orderkey % 90 AS STRING), ' MAIN ST') ELSE 'n/a' END, '</td></tr>')"
ROLE_PAGES = f"SELECT o_custkey AS page, concat('<table id=\"g\"><tr>', {_HEADS}, '</tr>', listagg({_BAND}, '') WITHIN GROUP (ORDER BY o_orderkey), '</table>Showing 1-10 of 1,', lpad(CAST(o_custkey % 1000 AS STRING), 3, '0'), CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '' END) AS html FROM orders GROUP BY o_custkey"
_ROW = f"concat('<tr class=\"Row\"><td><a href=\"javascript:PopPermit(''', CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE {KEY} END, ''')\"></a></td><td> ', CAST(o_orderkey % 90 AS STRING), '  Elm &amp; Oak</td><td>', o_orderstatus, '</td><td>1/2/2024</td><td>co</td></tr>')"
POSITION_PAGES = f"SELECT o_custkey AS page, concat('<table id=\"g\"><tr><th>PermitNo</th><th>Address</th><th>PropUse</th><th>Issue Dt</th><th>Contractor</th></tr>', listagg({_ROW}, '') WITHIN GROUP (ORDER BY o_orderkey), '</table>', CASE WHEN o_custkey % 10 = 0 THEN 'Only the first 500 records are shown' ELSE '' END) AS html FROM orders GROUP BY o_custkey"


@register("f04_role_grid", "SELECT o_custkey AS page, concat('B', CAST(o_orderkey AS VARCHAR)) AS number, concat(o_orderpriority, ' & co') AS type, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(10 + o_orderkey % 90 AS VARCHAR), ' MAIN ST') END AS address, CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(10 + o_orderkey % 90 AS VARCHAR), ' MAIN ST') ELSE 'n/a' END AS col4, 1000 + o_custkey % 1000 AS total, o_custkey % 2 = 0 AS capped FROM orders WHERE o_orderkey % 17 <> 0")
def role_grid(spark, sf_dir):
    d = grids.role_rows(frame(spark, sf_dir, ROLE_PAGES))
    return d.select("page", *(F.try_element_at("row", F.lit(c)).alias(c) for c in ("number", "type", "status", "address", "col4")), "total", "capped")


@register("f03_position_grid", "SELECT o_custkey AS page, o_custkey % 10 = 0 AS truncated, CAST(o_orderkey AS VARCHAR) AS number, concat(CAST(o_orderkey % 90 AS VARCHAR), ' Elm & Oak') AS address, o_orderstatus AS propuse FROM orders WHERE o_orderkey % 19 <> 0")
def position_grid(spark, sf_dir):
    columns, headers = ("number", "address", "propuse", "issued", "contractor"), ("permitno", "addr", "propuse", "issue", "contractor")
    return grids.position_rows(frame(spark, sf_dir, POSITION_PAGES), columns, headers).select("page", "truncated", "number", "address", "propuse")


@register("f07_independent_parse", "SELECT o_custkey AS page, count(*) + 1 AS n_rows, count(DISTINCT concat(CAST(o_orderkey % 90 AS VARCHAR), ' Elm & Oak')) AS n_addresses FROM orders GROUP BY o_custkey")
def independent_parse(spark, sf_dir):
    """By a walk of the tree; a page for each customer, whose rows include that of the headers."""
    d = pagecode.over_texts(frame(spark, sf_dir, POSITION_PAGES), "html", lambda p: (len(r := pagecode.cells_of(p)), len({row[1][0] for row in r[1:]})), "n_rows long, n_addresses long")
    return d


@register("h11_row_by_row", "SELECT o_custkey AS page, count(*) AS compared, count(*) AS agree FROM orders WHERE o_orderkey % 19 <> 0 GROUP BY o_custkey")
def row_by_row(spark, sf_dir):
    """Two parsers of one page, row by row: the address by position and by the walk, for rows that both find."""
    pages = frame(spark, sf_dir, POSITION_PAGES)
    keep = lambda r: [c[1][0] for c in r[1:]]
    walked = pagecode.over_texts(pages, "html", lambda p: (keep(pagecode.cells_of(p)),), "walked array<string>")
    other = pagecode.over_texts(pages, "html", lambda p: ([row["address"] for row in grids.by_position(p.replace("PopPermit('')", "PopPermit('none')"), ("number", "address"), ())[0]], [row["number"] for row in grids.by_position(p.replace("PopPermit('')", "PopPermit('none')"), ("number", "address"), ())[0]]), "placed array<string>, ids array<string>")
    both = walked.join(other, "page").select("page", F.explode(F.arrays_zip("walked", "placed", "ids")).alias("x")).where("x.ids <> 'none'")
    return both.groupBy("page").agg(F.count("*").alias("compared"), F.count_if(F.col("x.walked").eqNullSafe(F.col("x.placed"))).alias("agree"))


# ---- C11: verdicts over pages of each kind
VERDICT_PAGES = """
SELECT o_orderkey AS page, CASE o_orderkey % 5 WHEN 0 THEN 'T-DETAIL' WHEN 1 THEN 'T-INDEX' WHEN 2 THEN 'T-SEARCH' WHEN 3 THEN 'API-DATA' ELSE 'T-OTHER' END AS page_type,
  CASE WHEN o_orderkey % 11 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN o_orderkey % 5 = 3 THEN CASE o_orderkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN concat('{"features":[{"a":', CAST(o_orderkey AS STRING), '},{"a":2}]}') WHEN 2 THEN '{"x":1}' ELSE 'not json' END
  ELSE concat(CASE WHEN o_orderkey % 13 = 0 THEN '<title>Just a moment</title>' ELSE '<title>ok</title>' END, '<script>var a = "access denied";</script>',
    CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'gdvPermitList' WHEN 1 THEN 'Record Status' ELSE '' END
         WHEN o_orderkey % 5 = 1 THEN CASE o_orderkey % 3 WHEN 0 THEN 'gdvPermitList <a href="CapDetail.aspx?x=1&capID1=2">' WHEN 1 THEN 'Showing 1-10' ELSE '<table id="own"><tr><td>1/2/2024</td><td>b</td><td>c</td></tr><tr><td>1</td><td>2</td><td>3</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>' END
         WHEN o_orderkey % 5 = 2 THEN CASE o_orderkey % 3 WHEN 0 THEN 'btnNewSearch' WHEN 1 THEN '<form><input name="a"><input type="text" name="b"><select name="c"></select><input type="submit" name="go"></form>' ELSE '<input name="a">' END ELSE '' END,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE repeat('lorem ipsum ', 200) END) END AS html
FROM orders
"""
_VERDICT_SQL = """
WITH p AS (SELECT o_orderkey AS page, o_orderkey AS k FROM orders)
SELECT page, CASE WHEN k % 11 = 0 THEN 'rejected'
  WHEN k % 5 = 3 THEN CASE k % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'ok' WHEN 2 THEN 'unknown' ELSE 'rejected' END
  WHEN k % 13 = 0 OR k % 7 = 0 THEN 'rejected'
  WHEN k % 5 = 0 THEN CASE k % 3 WHEN 0 THEN 'rejected' WHEN 1 THEN 'ok' ELSE 'unknown' END
  WHEN k % 5 = 1 THEN CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'unknown' ELSE 'ok' END
  WHEN k % 5 = 2 THEN CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' ELSE 'rejected' END ELSE 'unknown' END AS verdict,
 CASE WHEN k % 11 = 0 THEN 'http 500'
  WHEN k % 5 = 3 THEN CASE k % 4 WHEN 0 THEN 'endpoint returned 0 records' WHEN 1 THEN '2 records' WHEN 2 THEN 'JSON parsed but no recognised record array' ELSE 'response is not valid JSON' END
  WHEN k % 13 = 0 THEN 'interstitial or error page' WHEN k % 7 = 0 THEN 'body too small'
  WHEN k % 5 = 0 THEN CASE k % 3 WHEN 0 THEN 'this is a result list, not a record' WHEN 1 THEN 'record detail markers present' ELSE 'no detail markers matched' END
  WHEN k % 5 = 1 THEN CASE k % 3 WHEN 0 THEN 'result grid with record links' WHEN 1 THEN 'grid present but no record links' ELSE 'result grid' END
  WHEN k % 5 = 2 THEN CASE k % 3 WHEN 0 THEN 'search form present' WHEN 1 THEN 'search form present' ELSE 'no search form found' END ELSE 'unrecognised page type' END AS reason FROM p
"""


@register("c11_page_verdict", _VERDICT_SQL)
def page_verdict(spark, sf_dir):
    """Reasons without the figures that some of them carry."""
    d = frame(spark, sf_dir, VERDICT_PAGES).withColumn("v", verdict.page_verdict(F.col("page_type"), F.col("status"), F.col("html")))
    return d.select("page", "v.verdict", F.regexp_replace("v.reason", r" \(.*| own, .*", "").alias("reason"))


# ---- F: strip levels, excerpts, mutations
@register("f08_strip_levels", "SELECT c_custkey, concat('<div id=\"d', CAST(c_custkey AS VARCHAR), '\" class=\"k\"><b>', c_mktsegment, '</b></div>') AS lean, concat(' ', c_mktsegment, ' ') AS text, concat('<i value=\"', repeat('A', 120), '...[', CAST(c_custkey % 50 + 1 AS VARCHAR), ' chars elided]\"/>') AS blob FROM customer")
def strip_levels(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT c_custkey, concat('<script>x</script><!-- c --><div style=\"a:b\" id=\"d', CAST(c_custkey AS STRING), '\" class=\"k\" onclick=go()><b>', c_mktsegment, '</b></div>') AS html, concat('<i value=\"', repeat('A', CAST(121 + c_custkey % 50 AS INT)), '\"/>') AS blob FROM customer")
    d = pagecode.over_texts(d, "html", lambda p: (pagecode.strip_levels(p)[1], " ".join(["", *pagecode.strip_levels(p)[2].split(), ""])), "lean string, text string")
    return pagecode.over_texts(d.withColumnRenamed("blob", "own"), "own", lambda p: (pagecode.strip_levels(p)[1],), "blob string")


@register("f11_excerpt", "SELECT c_custkey, 1500 + 30 AS size, true AS has_rows FROM customer")
def excerpt(spark, sf_dir):
    """A page whose data rows stand behind layout rows: the excerpt shows them."""
    d = frame(spark, sf_dir, "SELECT c_custkey, concat(repeat('<tr><td>menu</td></tr>', 200), repeat('<p>filler</p>', CAST(100 + c_custkey % 100 AS INT)), repeat('<tr><td>a</td><td>b</td><td>c</td><td>d</td><td>e</td></tr>', 40), repeat('x', 3000)) AS html FROM customer")
    return pagecode.over_texts(d, "html", lambda p: (len(e := pagecode.excerpt(p, 1500)[0]) + 5, "<td>e</td>" in e), "size long, has_rows boolean")


@register("f13_mutations", f"SELECT m AS mutation, count(DISTINCT o_custkey) AS pages, 0 AS unchanged, sum(CASE WHEN m = 'header_case' AND o_orderkey % 17 = 1 THEN 1 ELSE 0 END) AS lost FROM orders, unnest({list(mutate.MUTATIONS)}) AS t(m) GROUP BY m")
def mutations(spark, sf_dir):
    """All eight over pages some of whose identifiers stand in a header, in small letters: only upper case loses these."""
    pages = frame(spark, sf_dir, MUTABLE)
    changed = mutate.mutations(pages)
    ids = frame(spark, sf_dir, "SELECT o_custkey AS page, concat('b', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS id FROM orders")
    same = changed.join(pages.withColumnRenamed("html", "before"), "page").groupBy("mutation").agg(F.count("*").alias("pages"), F.count_if(F.col("html") == F.col("before")).cast("int").alias("unchanged"))
    lost = mutate.lost_ids(changed, ids).groupBy("mutation").agg(F.sum("lost").cast("int").alias("lost"))
    return same.join(lost, "mutation")


MUTABLE = f"SELECT o_custkey AS page, concat('<table id=\"g\" class=\"a b\" border=\"1\"> <tr><th>Permit no</th><th>Status</th></tr>', listagg(concat('<tr><t', CASE WHEN o_orderkey % 17 = 1 THEN 'h' ELSE 'd' END, '>b', lpad({KEY}, 9, '0'), '</t', CASE WHEN o_orderkey % 17 = 1 THEN 'h' ELSE 'd' END, '><td>', o_orderstatus, '</td></tr>'), '') WITHIN GROUP (ORDER BY o_orderkey), '</table>') AS html FROM orders GROUP BY o_custkey"


@register("f14_faithful", "SELECT o_custkey AS page, count(*) AS n, count(*) FILTER (WHERE o_orderkey % 17 = 1) AS lost FROM orders GROUP BY o_custkey")
def faithful(spark, sf_dir):
    """Identifiers that upper case of the headers loses, found in the mutated page."""
    changed = mutate.mutations(frame(spark, sf_dir, MUTABLE)).where("mutation = 'header_case'")
    ids = frame(spark, sf_dir, "SELECT o_custkey AS page, concat('b', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS id FROM orders")
    return mutate.lost_ids(changed, ids).select("page", "n", "lost")


@register("m03_drift", f"WITH o AS (SELECT o_custkey AS page, m, sum(CASE WHEN m = 'header_case' AND o_orderkey % 17 = 1 THEN 1 ELSE 0 END) AS lost, max(CASE WHEN o_orderkey % 17 = 1 THEN 1 ELSE 0 END) AS headed FROM orders, unnest({list(mutate.MUTATIONS)}) AS t(m) GROUP BY o_custkey, m) SELECT m AS mutation, count(*) AS scored, sum(CASE WHEN headed = 0 AND m <> 'nested_table' THEN 1 ELSE 0 END) AS survived FROM o WHERE lost = 0 GROUP BY m")
def drift(spark, sf_dir):
    """A candidate extractor (the first cell of each row, by a pattern) on each page after each mutation that loses no
    identifier: it survives if it finds all identifiers and no other."""
    pages = frame(spark, sf_dir, MUTABLE)
    ids = frame(spark, sf_dir, "SELECT o_custkey AS page, concat('b', lpad(CAST(o_orderkey AS STRING), 9, '0')) AS id FROM orders")
    changed = mutate.mutations(pages)
    fair = mutate.lost_ids(changed, ids).where("lost = 0").select("page", "mutation")
    first = F.array_sort(F.regexp_extract_all("html", F.lit(r"(?s)<tr>\s*<td>([^<]*)</td>"), 1))
    found = changed.select("page", "mutation", first.alias("found")).join(fair, ["page", "mutation"])
    wanted = ids.groupBy("page").agg(F.array_sort(F.collect_set("id")).alias("wanted"))  # a page's own identifiers
    return found.join(wanted, "page").groupBy("mutation").agg(F.count("*").alias("scored"), F.sum((F.col("found") == F.col("wanted")).cast("int")).cast("bigint").alias("survived"))


REPLIES = "SELECT conv_id, turn, concat('draft\n```python\nx = 1\n', CASE WHEN turn % 2 = 0 THEN '```\n' ELSE '' END, 'then\n```python\nimport ', CASE WHEN turn % 3 = 0 THEN 'os' ELSE 're' END, '\ndef extract(h):\n    return ', CASE WHEN turn % 5 = 0 THEN 'eval(h)' ELSE '[]' END, '\n```\nuse: ```\nprint(1)\n```') AS reply FROM conversations"


@register("f15_answer_block", "SELECT conv_id, turn, concat('import ', CASE WHEN turn % 3 = 0 THEN 'os' ELSE 're' END, chr(10), 'def extract(h):', chr(10), '    return ', CASE WHEN turn % 5 = 0 THEN 'eval(h)' ELSE '[]' END, chr(10)) AS block FROM conversations")
def answer_block(spark, sf_dir):
    return pagecode.over_texts(frame(spark, sf_dir, REPLIES), "reply", lambda t: (pagecode.answer_block(t, "def extract"),), "block string")


@register("f16_code_audit", "SELECT conv_id, turn, concat_ws(';', CASE WHEN turn % 3 = 0 THEN 'imports os' END, CASE WHEN turn % 5 = 0 THEN 'uses eval()' END) AS problems, CASE WHEN turn % 3 = 0 THEN 'os' ELSE 're' END AS imports FROM conversations")
def code_audit(spark, sf_dir):
    def audited(t):
        wrong, imports = pagecode.audit(pagecode.answer_block(t, "def extract"))
        return ";".join(wrong), ",".join(imports)

    return pagecode.over_texts(frame(spark, sf_dir, REPLIES), "reply", audited, "problems string, imports string")


@register("f17_page_search", "SELECT page_id, CAST((length(html) - length(replace(lower(html), 'class', ''))) / 5 AS BIGINT) AS n, least(20, CAST((length(html) - length(replace(lower(html), 'class', ''))) / 5 AS BIGINT)) AS listed, strpos(lower(html), 'class') - 1 AS first FROM pages WHERE lower(html) LIKE '%class%'")
def page_search(spark, sf_dir):
    d = frame(spark, sf_dir, "SELECT page_id, html FROM pages")

    def found(p):
        n, hits = pagecode.search(p, "CLASS")
        return n, len(hits), int(hits[0].split(":")[0][3:]) if hits else -1

    return pagecode.over_texts(d, "html", found, "n long, listed long, first long").where("n > 0")


@register("f02_result_grids", "SELECT o_custkey AS page, 'g' AS \"table\", count(*) AS n_wide, count(*) AS n_dated FROM orders GROUP BY o_custkey HAVING count(*) >= 3")
def result_grids(spark, sf_dir):
    pages = frame(spark, sf_dir, POSITION_PAGES).withColumn("html", F.concat(F.regexp_replace("html", "(?i)<th[^>]*>.*?</th>", ""), F.lit("<table><tr><td>1/2/2024</td><td>b</td><td>c</td></tr></table>")))
    return markup.result_grids(markup.tables(pages), ["page", "table"])


@register("f06_form_fields", "SELECT c_custkey, concat('k', CAST(c_custkey AS VARCHAR)) AS key, 'first' AS twice, 2 AS n FROM customer")
def form_fields(spark, sf_dir):
    """Hidden fields of a form; the first value of a name wins."""
    d = frame(spark, sf_dir, "SELECT c_custkey, concat('<input type=\"hidden\" name=\"__TWICE\" value=\"first\"><input type=\"hidden\" name=\"__TWICE\" value=\"second\"><input type=\"hidden\" name=\"__KEY\" value=\"k', CAST(c_custkey AS STRING), '\">') AS html FROM customer")
    names, values = (F.regexp_extract_all("html", F.lit(r'(?is)<input[^>]*type="hidden"[^>]*name="(__[^"]*)"[^>]*value="([^"]*)"'), i) for i in (1, 2))
    return d.select("c_custkey", markup.first_of_names(names, values).alias("m")).select("c_custkey", F.try_element_at("m", F.lit("__KEY")).alias("key"), F.try_element_at("m", F.lit("__TWICE")).alias("twice"), F.size("m").alias("n"))
