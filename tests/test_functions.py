"""Literal cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify, markup, stats, text
from lodestone.operators import episodes, quality, records, rollup


def values(spark, cases, column, kind="string"):
    d = spark.createDataFrame([(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)], f"i int, {kind}" if " " in kind else f"i int, x {kind}")
    return [r["v"] for r in d.select("i", column.alias("v")).orderBy("i").collect()]


def test_norm_date(spark):
    good = ["3/2/2026 11:06:49 PM", "2026-03-02", "03/02/2026", "3/2/2026", "2026/03/02", "02-Mar-2026", "03-02-2026", "2026-03-02T00:00:00", "2026-03-02 14:30:00", "Mar 02, 2026", "  2026-03-02  ", "1772409600000"]
    assert values(spark, good, text.norm_date(F.col("x"))) == ["2026-03-02"] * len(good)
    assert values(spark, ["1/9/2026 9:05:00 AM", "12/31/2025 11:59:59 PM"], text.norm_date(F.col("x"))) == ["2026-01-09", "2025-12-31"]
    bad = [None, "", "   ", "n/a", "N/A", "--", "pending", "0", "not issued", "TBD", "03/02", "Mar 2", "02-Mar"]
    assert values(spark, bad, text.norm_date(F.col("x"))) == [None] * len(bad)


def test_norm_int_and_text(spark):
    cases = ["12", "1,200", "0", "-3", "12 units", "approx 200 units", None, "", "none", "n/a", "many"]
    assert values(spark, cases, text.norm_int(F.col("x"))) == [12, 1200, 0, -3, 12, 200, None, None, None, None, None]
    assert values(spark, ["  NEW   SFR\n\tDETACHED ", "a\xa0b", None, ""], text.norm_text(F.col("x"))) == ["NEW SFR DETACHED", "a b", None, None]
    assert values(spark, ["1", "12", "123"], text.zfill2(F.col("x"))) == ["01", "12", "123"]
    assert values(spark, ["&amp;lt;"], text.unescape_entities(F.col("x"))) == ["<"]


def test_structure(spark):
    cases = ["R- 101 Single Family Houses", "C- 105 Five or More Family Bldgs", "R- 103 Two Family Bldgs", "1,2,3 Family - New Structure", "Single Family/Duplex", "One/Two Family", "C-1000", "R- 435 x", "R- 329 x", None, ""]
    got = values(spark, cases, classify.structure(F.col("x")))
    assert [r["value"] for r in got] == ["101", "105", "103", "1-4", "1-4", "1-4", None, None, None, None, None]
    assert [r["rule"] for r in got[:4]] == ["bps-code"] * 3 + ["kw:low-density-bundle"]


def test_work_and_kind(spark):
    assert values(spark, ["1,2,3 Family - Other"], classify.work(F.col("x")))[0] == ("OTHER", "kw:other")
    assert [r["value"] for r in values(spark, ["BP", "ep", " MP ", "PP", "", None], classify.kind(F.col("x"), default="BUILDING"))] == ["BUILDING", "ELECTRICAL", "MECHANICAL", "PLUMBING", "BUILDING", "BUILDING"]
    assert values(spark, ["fence", "unheard of"], classify.kind(F.col("x")))[1] == ("UNKNOWN", None)


def test_units_from_text(spark):
    got = values(spark, ["Multifamily, Apt / Twnhome > 5 Unit Bldg", "Single Family Residence", "Duplex - 2 Unit Bldg", "Apartment 24 Unit Building"], classify.units_from_text(F.col("x")))
    assert [tuple(r) for r in got] == [(None, "refused:open-ended"), (None, None), (2, "units:exact-from-text"), (24, "units:exact-from-text")]


def test_refine_and_imply(spark):
    cases = [("1-4", 1, "NEW"), ("1-4", 9, "NEW"), ("105", 3, "NEW"), ("105", 5, "NEW"), ("101", 9, "NEW"), ("1-4", 1, "OTHER"), ("1-4", 0, "NEW")]
    got = values(spark, cases, classify.refine(F.col("s"), F.col("u"), F.col("w")), "s string, u int, w string")
    assert [r["value"] for r in got] == ["101", "104", "104", "105", "101", "1-4", "1-4"]
    cases = [("101", "NEW", "bps-code", True), ("103", "NEW", "kw:two-family", True), ("105", "NEW", "bps-code", True), ("101", "NEW", "bps-code", False), ("101", "OTHER", "bps-code", True), ("101", "NEW", None, True)]
    got = values(spark, cases, classify.imply_units(F.col("s"), F.col("w"), F.col("r"), F.col("c")), "s string, w string, r string, c boolean")
    assert [r["units"] for r in got] == [1, 2, None, None, None, None]


def test_wilson_newcombe(spark):
    got = values(spark, [(0, 0), (2, 2), (2, 3)], stats.wilson(F.col("x"), F.col("n")), "x int, n int")
    for r, want in zip(got, [(0, 1), (0.342, 1), (0.208, 0.939)], strict=True):
        assert tuple(r) == pytest.approx(want, abs=0.005)
    got = values(spark, [(56, 70, 48, 80), (0, 10, 0, 10)], stats.newcombe(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "a int, b int, c int, d int")
    assert tuple(got[0]) == pytest.approx((0.2, 0.0524, 0.3339), abs=1e-3)
    assert got[1]["d"] == 0 and got[1]["lo"] == pytest.approx(-got[1]["hi"]) and got[1]["hi"] < 0.3


def test_alarm(spark):
    def one(n, **change):
        return [dict({"source_id": "s", "permit_kind": "BUILDING", "work_class": "NEW", "structure_type": "101", "unit_count": 1, "date_issued": "2026-01-01"}, **change)] * n

    schema = "source_id string, permit_kind string, work_class string, structure_type string, unit_count int, date_issued string"
    trip = lambda rows: [r["tripped"] for r in quality.tripped(quality.null_rates(spark.createDataFrame(rows, schema))).collect()]
    assert trip([]) == []
    assert trip(one(50)) == [[]]
    assert trip(one(50, work_class="UNKNOWN")) == [["work_class"]]
    assert trip(one(100, structure_type=None)) == [["structure_type"]]
    assert trip(one(99, unit_count=None) + one(1)) == [["unit_count"]]


def test_validate(spark):
    rows = [("101", 1, "implied_by_structure_code"), ("105", 5, "implied_by_structure_code"), ("103", 1, "implied_by_structure_code"), ("103", 2, "implied_by_structure_code"), ("101", 3, "absent"), ("101", 1, "guessed"), (None, None, "absent")]
    d = spark.createDataFrame(rows, "structure_type string, unit_count int, unit_count_source string")
    assert [len(r["violations"]) > 0 for r in records.validate(d).collect()] == [False, True, True, False, True, True, False]


def test_claims_are_made_once(spark):
    draws = spark.createDataFrame([("c", 0, "m", "t", 0, 900), ("d", 1, "m", "t", 0, 900), ("e", 2, "m", "t", 0, 900)], "cell string, kind int, model string, target string, draw int, tokens int")
    ledger = spark.createDataFrame([(10, "m", "t", 0, 900, 0.1), (11, "m", "t", 0, 900, 0.2)], "row_id int, model string, target string, draw int, tokens int, usd double")
    got = {r["cell"]: r["row_id"] for r in rollup.purchases(draws, ledger).collect()}
    assert got == {"c": 11, "d": 10, "e": None}


def test_episode_caps(spark):
    steps = spark.createDataFrame([("e", i, s, d) for i, (s, d) in enumerate([(0.01, None), (0.02, "bad"), (0.04, "good"), (0.05, "good")])], "episode string, turn int, spent double, draft string")
    for cap, want in ((0.005, (None, 0.01)), (0.015, ("bad", 0.02)), (0.02, ("bad", 0.02)), (0.03, ("good", 0.04)), (1.0, ("good", 0.05))):
        r = episodes.at_cap(steps, cap).first()
        assert (r["draft"], r["spent"]) == want


PAGE = '<html><body><div class="a" id="x"><ul><li>..</li><li>..</li></ul><p>text</p></div></body></html>'


def test_fingerprints(spark):
    same = [PAGE, PAGE.replace("text", "other").replace('class="a"', 'class="b"'), PAGE.replace("<p>", "<script>var x='<b>'</script><p>")]
    other = PAGE.replace("<p>text</p>", "<table><tr><td>1</td></tr></table>")
    bad = ["<", "<div", "</p></p>", "<![", "&#xffffffff;", "<a b='", "<div>" * 5000, "", "plain", '{"a": 1}']
    d = spark.createDataFrame([(i, "u", h) for i, h in enumerate([*same, other, *bad])], "page_id long, url string, html string")
    marks = [r["mark"] for r in markup.fingerprints(d).orderBy("page_id").collect()]
    assert len(set(marks[:3])) == 1 and marks[3] != marks[0] and marks[-3:] == ["", "", ""]
