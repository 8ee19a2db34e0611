"""Queries against their SQL at a small scale, sources, streams, and the layering."""

import ast
import math
import os
from pathlib import Path

import pytest

from lodestone import registry
from lodestone.plans.base import TABLES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def canonical(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float("%.9g" % v)
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_queries_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    wrong = []
    for name in ("reconcile_office_month", "d07_build_records", "e01_null_rates", "j01_purchases", "j08_aggregate", "k01_wilson", "k05_pass_at", "h01_score", "l01_at_cap", "f01_grid_cells", "f19_links", "i16_bisection"):
        got = registry.QUERIES[name](spark, SF)
        want = db.sql(registry.ORACLE_SQL[name])
        cols = sorted(got.columns)
        a = sorted(repr([canonical(r[c]) for c in cols]) for r in got.collect())
        b = sorted(repr([canonical(r[want.columns.index(c)]) for c in cols]) for r in want.fetchall())
        if sorted(want.columns) != cols or a != b:
            wrong.append(name)
    assert not wrong


def test_fragment_text_of_whole_pages(spark, tmp_path):
    import html
    import re

    page = "<html><head><title>T &amp; t</title></head>" + "<p class='x'>menu</p>\n" * 60 + "<article>the  &lt;end&gt;</article></html>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["b07_fragment_text"](spark, str(tmp_path)).collect()
    assert [r["v"] for r in got] == [" ".join(html.unescape(re.sub("<[^>]+>", " ", page)).split())] and got[0]["v"].endswith("the <end>")


def test_simulations_do_not_move_one_another(spark):
    from lodestone.operators import simulate

    rows = [(c, c, i % 3 > 0, 0.01 * (i % 4 + 1)) for c in "abc" for i in range(12)]
    d = spark.createDataFrame([(c, m, int(p), u) for c, m, p, u in rows], "cell string, model string, perfect int, usd double")
    every = {r["cell"]: tuple(r) for r in simulate.best_of_k(d, 5).collect()}
    one = {r["cell"]: tuple(r) for r in simulate.best_of_k(d.where("cell = 'b'"), 5).collect()}
    assert one["b"] == every["b"] and every["b"][3] <= every["b"][2] <= every["b"][4]
    cost = {(r["model"], r["prior"]): r for r in simulate.cost_per_success(d).collect()}
    assert cost["a", 0.5]["lo"] < 0.025 / (8 / 12) < cost["a", 0.5]["hi"]


def test_simulations_by_cell(spark):
    """Cells stay apart, an unpriced draw voids its cell, and prices under half a cent count."""
    from lodestone.operators import simulate

    def cell(target, model, usd, unpriced=False):
        return [(target, model, int(i % 3 > 0), None if unpriced and i == 0 else usd) for i in range(12)]

    rows = cell("t1", "a", 0.001) + cell("t1", "b", 0.004) + cell("t1", "c", 0.5, True) + cell("t2", "a", 0.002) + cell("t2", "b", 9.0, True)
    d = spark.createDataFrame(rows, "target string, model string, perfect int, usd double")
    cost = {(r["target"], r["model"]): r for r in simulate.cost_per_success(d, ("target", "model")).where("prior = 0.5").collect()}
    assert 0 < cost["t1", "a"]["lo"] < 0.001 / (8 / 12) < cost["t1", "a"]["hi"] and cost["t2", "a"]["median"] > cost["t1", "a"]["median"]
    assert cost["t1", "c"]["median"] is None and cost["t2", "b"]["median"] is None
    pairs = simulate.settled_pairs(d, ("target",)).collect()
    assert [(r["target"], r["cheaper"], r["dearer"], r["settled"]) for r in pairs] == [("t1", "a", "b", True)]
    assert simulate.SIMULATIONS == 20000


def test_sources(spark, tmp_path):
    from pyspark.sql import functions as F

    from lodestone.sources import files

    (tmp_path / "l.jsonl").write_text('{"model": "m", "usd": 1.5}\n\n{"model": "n", "ok": false, "draw": 3}\n')
    rows = files.read_ledger(spark, str(tmp_path / "l.jsonl")).orderBy("line").collect()
    assert [(r["line"], r["model"], r["ok"], r["draw"]) for r in rows] == [(0, "m", True, 0), (2, "n", False, 3)]
    (tmp_path / "bad.jsonl").write_text('{"model": "m", "colour": 1}\n')
    with pytest.raises(Exception, match="unknown fields: colour"):
        files.read_ledger(spark, str(tmp_path / "bad.jsonl")).collect()
    bodies = spark.createDataFrame([('[{"a":1},{"a":2}]',), ('{"features":[{"attributes":{"a":3}}],"exceededTransferLimit":true}',), ('{"results":[]}',)], "body string")
    got = files.read_api_records(bodies).collect()
    assert sorted((r["record"] or "", r["more"]) for r in got) == [("", False), ('{"a":1}', False), ('{"a":2}', False), ('{"a":3}', True)]
    with pytest.raises(ValueError, match="would be lost"):
        files.migrate(bodies.withColumn("old", F.lit("x")), bodies.schema)
    path = f"file://{tmp_path}/table"
    files.upsert(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    files.upsert(spark, path, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    (tmp_path / "m.txt").write_text(",".join(["Date", *["x"] * 27]) + "\n" + ",".join(["202601", "12", "34", *["-"] * 12, "1", "Town", "0", "5", "0", "0", "junk", "0", "0", "7", "0", "0", "9"]) + "\n")
    r = files.read_months(spark, str(tmp_path / "m.txt")).collect()
    assert [(x["state"], x["place_name"], x["u1"], x["u2"], x["u34"], x["u5p"]) for x in r] == [("12", "Town", 5, 0, 7, 9)]


def test_stream_equals_batch(spark, tmp_path):
    from lodestone.operators import quality
    from lodestone.streaming import alarm

    schema = "source_id string, permit_kind string, work_class string, structure_type string, unit_count int, date_issued string"
    d = spark.createDataFrame([("a" if i % 3 else "b", "BUILDING", "NEW" if i % 2 else "UNKNOWN", None if i % 5 == 0 else "101", i, None) for i in range(40)], schema)
    d.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = alarm.null_rates(stream).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, quality.null_rates(d).collect()))


def test_nothing_imports_the_optional_part():
    for path in (ROOT / "lodestone").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path
