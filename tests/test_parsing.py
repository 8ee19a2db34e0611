"""Parsers, page functions, folds, sinks and similarity on small cases and against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import grids, markup, mutate, pagecode, verdict
from lodestone.functions.settings import settings_sent
from lodestone.operators import measures, records, similarity, simulate
from lodestone.sources import files


def test_paths_of_a_page():
    paths, n = markup.tag_paths('<html><body><br><ul><li>a<li>b</ul><svg><g></g></svg><p/><script>"<b>"</script><div><img></div></body></html>')
    assert paths == ["html>body>br", "html>body>div>img", "html>body>p", "html>body>ul>li>li"] and n == 9
    deep, _ = markup.tag_paths("<div>" * 260)
    assert max(len(p.split(">")) for p in deep) == markup.MAX_DEPTH + 1
    assert markup.tag_paths("plain") == ([], 0) and markup.tag_paths("</p><")[0] == []


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_clusters_brute_force(spark):
    rng = random.Random(6)
    base = [f"p{i}" for i in range(12)]
    sets = []
    for _ in range(60):
        own = set(base[: rng.randint(6, 12)]) | {f"q{rng.randint(0, 30)}" for _ in range(rng.randint(0, 2))}
        sets.append(own if rng.random() < 0.8 else {f"z{rng.randint(0, 40)}" for _ in range(5)})
    sets.append(set())
    d = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "page_id long, paths array<string>")
    for least in (0.95, 0.8, 0.6):
        label = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if a and b and jaccard(a, b) >= least:
                        label[i] = label[j] = min(label[i], label[j])
        got = {r["page_id"]: r["component"] for r in similarity.clusters(d, least).collect()}
        assert got == dict(enumerate(label))
        sizes = sorted({c: label.count(c) for c in label}.values())
        r = similarity.cohort(similarity.clusters(d, least)).first()
        assert (r["clusters"], r["largest"], r["median"]) == (len(sizes), sizes[-1], sizes[len(sizes) // 2])


def test_marks_of_different_rules_raise(spark):
    rows = [(1, "a", "fp1:" + "0" * 12), (2, "a", "fp1:" + "0" * 12), (3, "a", "fp2:" + "0" * 12)]
    d = spark.createDataFrame(rows, "page_id long, jurisdiction string, mark string")
    assert [r["same"] for r in similarity.comparable_pairs(d.where("page_id < 3")).collect()] == [True]
    with pytest.raises(Exception, match="different rules"):
        similarity.comparable_pairs(d).collect()


def test_positional_grid_asserts_its_headers():
    page = '<th>PermitNo</th><th>Addr</th><tr class="Row"><td>PopPermit(\'7\')</td><td>x</td></tr>'
    assert grids.by_position(page, ("number", "address"), ("permitno", "addr")) == ([{"number": "7", "address": "x"}], False)
    with pytest.raises(ValueError, match="another order"):
        grids.by_position(page, ("number", "address"), ("addr", "permitno"))


def test_role_grid():
    page = (
        "<th>Date</th><th>Record Number</th><th>Expiration Date</th><th></th>"
        '<tr class="ACA_TabRow_Odd x"><td>1/2/2024</td><td><a href="/CapDetail.aspx?a=1&amp;b=2"><span id="lblPermitNumber1"> B1 </span></a></td><td>3/4/2025</td><td>12 MAIN ST</td></tr>'
        '<tr class="ACA_TabRow_Even"><td>1/2/2024</td><td></td><td></td><td></td></tr>Showing 1-10 of 1,234+'
    )
    rows, total, capped = grids.by_role(page)
    assert rows == [{"date": "1/2/2024", "number": "B1", "expires": "3/4/2025", "col3": "12 MAIN ST", "detail_href": "/CapDetail.aspx?a=1&b=2", "address": "12 MAIN ST"}]
    assert (total, capped) == (1234, True) and grids.by_role("") == ([], None, False)


def test_excerpt_shows_the_grid():
    layout = "<tr><td>1</td><td>2</td><td>3</td><td>4</td></tr>" * 7
    grid = ("<tr>" + "<td>" + "r" * 60 + "</td>" + "<td>x</td>" * 4 + "</tr>") * 10
    page = layout + "f" * 5000 + grid
    text, share, at = pagecode.excerpt(page, 1000)
    assert at == page.index(grid[:20]) and "rrr" in text and share == pytest.approx(1000 / len(page))
    assert pagecode.excerpt("short", 1000) == ("short", 1.0, 0)


def test_answer_blocks():
    reply = "draft\n```python\nx = 1\nthen\n```python\ndef extract(h):\n    pass\n```\nuse\n```\nprint(1)\n```"
    assert pagecode.fenced_blocks(reply) == ["x = 1\nthen\n", "def extract(h):\n    pass\n", "print(1)\n"]
    assert pagecode.answer_block(reply, "def extract") == "def extract(h):\n    pass\n"
    assert pagecode.answer_block("I will write it.", "def extract") == "" and pagecode.answer_block("no fence") == "no fence"
    assert pagecode.fenced_blocks("```py\nopen") == ["open"]


def test_audit():
    assert pagecode.audit("import re\ndef extract(h):\n    return []") == ([], ["re"])
    assert pagecode.audit("from os import path\nopen('x')") == (["defines no top-level extract()", "imports os", "uses open()"], ["os"])
    assert pagecode.audit("def")[0][0].startswith("does not parse")


def test_strip_levels_and_search():
    bare, lean, text = pagecode.strip_levels('<script>x</script><p style="a" ID=q>t <!-- c --> u</p><br class="k"/>')
    assert lean == '<p ID="q">t u</p><br class="k"/>' and text.split() == ["t", "u"] and "script" not in bare
    assert pagecode.search("aAa", "aa") == (1, ["at 0: ...aAa...", "at 1: ...aAa..."]) and pagecode.search("x", "") == (0, [])


def test_mutations(spark):
    page = '<table id="g" class="a b"><tr><th>Permit no</th></tr><tr><td name=\'n\'>b1</td></tr></table>'
    got = {r["mutation"]: r["html"] for r in mutate.mutations(spark.createDataFrame([(1, page)], "page long, html string")).collect()}
    assert list(got) and set(got) == set(mutate.MUTATIONS)
    assert got["id_suffix"] == page.replace('id="g"', 'id="ctl99_g"').replace("name='n'", "name='ctl99_n'")
    assert got["class_rename"] == page.replace('"a b"', '"a_x b_x"')
    assert got["attr_reorder"] == page.replace('id="g" class="a b"', 'class="a b" id="g"')
    assert got["nested_table"].count("innerLayout") == 1 and got["column_append"].count("<th>Extra</th>") == 1 and got["column_append"].count("<td>-</td>") == 1
    assert "PERMIT NO" in got["header_case"] and got["wrapper_div"].count("pnlWrap") == 1


def test_verdicts(spark):
    long = "x" * 3000
    rows = [("T-DETAIL", 200, "Record Status" + long), ("T-DETAIL", 404, long), ("API-DATA", 200, '{"resultRecordCount": 0}'), ("API-DATA", 200, "[1, 2]"), ("T-INDEX", 200, "short"), ("T-SEARCH", 200, "<title>Access denied</title>" + long)]
    d = spark.createDataFrame(rows, "t string, s int, h string").select(verdict.page_verdict(F.col("t"), F.col("s"), F.col("h")).alias("v"))
    assert [(r["v"]["verdict"], r["v"]["reason"].split(" (")[0]) for r in d.collect()] == [
        ("ok", "record detail markers present"),
        ("rejected", "http 404"),
        ("rejected", "endpoint returned 0 records"),
        ("ok", "2 records"),
        ("rejected", "body too small"),
        ("rejected", "interstitial or error page"),
    ]


def test_budget_refuses_without_spending(spark):
    rows = [("m", 1, 5.0, 4.0), ("m", 2, 9.0, 9.0), ("m", 3, 5.0, 5.0), ("m", 4, 1.5, 1.0)]
    d = spark.createDataFrame(rows, "model string, row_id long, worst double, usd double")
    assert [(r["row_id"], r["spent"]) for r in measures.admitted(d, "model", 10.0).orderBy("row_id").collect()] == [(1, 4.0), (3, 9.0)]


def test_ranks_gather_nothing(spark):
    xs = [random.Random(1).randint(0, 50) for _ in range(101)]
    d = spark.createDataFrame([("g", x) for x in xs] + [("g", None), ("h", 3)], "g string, x int")
    got = {r["g"]: (r["low"], r["half"]) for r in measures.ranked(d, "g", "x", {"low": measures.floor_90(), "half": measures.upper_half()}).collect()}
    assert got == {"g": (sorted(xs)[90], sorted(xs)[50]), "h": (3, 3)}


def test_milestones_are_closed(spark):
    d = spark.createDataFrame([("2026-01-02", "no date")], "a string, b string")
    got = records.milestones(d, {"issued": "b", "applied": "a"}).first()["milestones"]
    assert [(m["milestone"], m["reported_date"]) for m in got] == [("applied", "2026-01-02")]
    with pytest.raises(ValueError, match="not a milestone"):
        records.milestones(d, {"opened": "a"})


def test_settings(spark):
    bodies = ['{"max_tokens": 9, "thinking": {"type": "enabled", "budget_tokens": 5}}', '{"max_tokens": 9, "reasoning": {"effort": "high"}, "temperature": 0.2}', '{"max_tokens": 9, "reasoning_effort": "low"}', '{"max_tokens": 9}']
    got = [tuple(r["s"]) for r in spark.createDataFrame([(b,) for b in bodies], "b string").select(settings_sent(F.col("b"), {"high": "max"}).alias("s")).collect()]
    assert got == [(9, "budget=5", None, 1.0, None), (9, "effort=high", "max", 0.2, None), (9, "effort=low", None, None, None), (9, None, None, None, None)]


def test_simulations_bracket(spark):
    d = spark.createDataFrame([("a", int(i % 3 == 0), 0.1) for i in range(30)], "cell string, perfect int, usd double")
    r = simulate.best_of_k_orders(d, 3).first()
    exact = 1 - (20 * 19 * 18) / (30 * 29 * 28)
    assert r["chance"] == pytest.approx(exact, abs=0.04) and 1 <= r["tries"] <= 3
    points = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double")
    s = simulate.spearman_interval(points, "x", "y", 200).first()
    assert s["rho"] == pytest.approx(1) and s["lo"] <= 1
    pairs = spark.createDataFrame([(True, 0.98, 0.99), (False, 0.5, 0.5), (True, 1.0, 0.975)], "settled boolean, p_half double, p_one double")
    assert tuple(simulate.false_discovery(pairs).first()) == (2, pytest.approx(0.045))


def test_paging_ends_with_a_short_page(spark):
    asked = []

    def fetch(at, size):
        asked.append(at)
        return [str(i) for i in range(at, min(at + size, 7))]

    assert files.paged(spark, fetch, 3).count() == 7 and asked == [0, 3, 6]
    assert files.socrata_aggregate(["units"], ["kind"], "a > 1") == {"$select": "kind, count(1) AS n, sum(units) AS units", "$group": "kind", "$where": "a > 1"}
    assert '"statisticType": "count"' in files.arcgis_aggregate("OBJECTID", ["units"], ["kind"])["outStatistics"]


def test_upsert_mends_a_run_that_died(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.upsert(spark, path, spark.createDataFrame([(1, "a"), (None, "n")], "k long, v string"), "k")
    (tmp_path / "t").rename(tmp_path / "t-x-old")  # between the two renames
    files.upsert(spark, path, spark.createDataFrame([(2, "b"), (None, "m")], "k long, v string"), "k")
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "b"), (None, "m")}


def test_best_of_k_brute_force(spark):
    """Against every order of a few draws."""
    from itertools import permutations

    rows = [("c", True, 1, 0.5), ("c", True, 0, 0.2), ("c", False, 0, 0.9), ("c", False, 1, 0.1), ("c", None, 0, 0.4)]
    d = spark.createDataFrame(rows, "cell string, accepted boolean, perfect int, usd double")
    for k in (1, 3, 9):
        good = spent = n = 0
        for order in permutations(rows):
            n += 1
            for r in order[:k]:
                spent += r[3]
                if r[1]:
                    good += r[2]
                    break
        got = measures.best_of_k(d, "cell", k).first()
        assert (got["success"], got["usd"]) == (pytest.approx(good / n, abs=1e-8), pytest.approx(spent / n, abs=1e-5)) and got["k"] == min(k, 5)


def test_unobserved_episodes(spark):
    from lodestone.operators import episodes

    rows = [("a", 0, 0.1, None, "infra_error"), ("b", 0, 0.1, "good", "submitted"), ("c", 0, 0.4, "bad", None), ("c", 1, 0.9, "good", None), ("d", 0, 0.2, None, None)]
    d = spark.createDataFrame(rows, "episode string, turn int, spent double, draft string, stop string")
    got = {r["episode"]: (r["draft"], r["unobserved"]) for r in episodes.at_cap(d, 0.5).collect()}
    assert got == {"a": (None, True), "b": ("good", False), "c": ("good", False), "d": (None, True)}
    p = episodes.frontier_point(episodes.at_cap(d, 0.5)).first()
    assert (p["n"], p["ok"], p["unobserved"]) == (2, 2, 2)
