"""Verdict on a captured page: whether it is what its type says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.markup import CELL, DATED, ROW, TABLE

#: What pages of each kind hold.
GRID = r"(?i)(gdvPermitList|divSearchResultList|Record results|Showing\s*\d+\s*-\s*\d+)"
RESULT_LIST = r"(?i)(gdvPermitList|divSearchResultList)"
DETAIL_LINK = r"(?i)CapDetail\.aspx\?[^\"'>]*capID1="
DETAIL = r"(?i)(PermitDetail|lblPermitNumber|Record\s*Details|CapDetailContent|Work Location|Record Status)"
SEARCH = r"(?i)(generalSearchForm|btnNewSearch|txtGSPermitNumber|SearchButton)"
BLOCKED = r"(?i)(just a moment|checking your browser|attention required|access denied|forbidden|are you a robot|verify you are human|page not found|\b404\b)"
HEAD, LEAST = 4000, 2000
NAMED = r"""(?is)<(?:input|select|button)\b[^>]*\bname\s*=\s*["'][^"']+["'][^>]*>"""


def _says(verdict: str, reason) -> Column:
    return F.struct(F.lit(verdict).alias("verdict"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def api_records(body: Column) -> Column:
    """Records of a JSON answer: the length of the list, or of the first list of an envelope, or the count that it states."""
    first = F.coalesce(*(F.get_json_object(body, f"$.{name}") for name in ("results", "features", "data", "dataset")))
    return F.coalesce(F.json_array_length(body), F.json_array_length(first), F.get_json_object(body, "$.resultRecordCount").try_cast("int"))


def page_verdict(page_type: Column, status: Column, html: Column) -> Column:
    """``verdict`` (ok, unknown, rejected) and ``reason``, judged without scripts and styles."""
    m = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    api = F.startswith(page_type, F.lit("API-"))
    named = F.regexp_extract_all(m, F.lit(NAMED), 0)
    submits = F.size(F.filter(named, lambda t: t.rlike(r"""(?i)^<button|type\s*=\s*["']?(submit|image)""")))
    texts = F.size(F.filter(named, lambda t: t.rlike("(?i)^<select") | (t.rlike("(?i)^<input") & (t.rlike(r"""(?i)type\s*=\s*["']?(text|date)\b""") | ~t.rlike(r"(?i)\btype\s*=")))))
    rows = lambda t: F.filter(F.transform(F.regexp_extract_all(t, F.lit(ROW), 1), lambda r: F.regexp_extract_all(r, F.lit(CELL), 1)), lambda c: F.size(c) >= 3)
    dated = lambda t: F.size(F.filter(rows(t), lambda c: F.exists(c, lambda x: x.rlike(DATED))))
    own = F.exists(F.regexp_extract_all(m, F.lit(TABLE), 2), lambda t: (F.size(rows(t)) >= 3) & (dated(t) >= 1))
    n = api_records(html)
    search = F.when(m.rlike(SEARCH), _says("ok", "search form present")).when((submits >= 1) & (texts >= 3), _says("ok", F.format_string("search form present (%d inputs, %d submits)", texts, submits))).otherwise(_says("rejected", "no search form found"))
    index = F.when(m.rlike(GRID) & m.rlike(DETAIL_LINK), _says("ok", "result grid with record links")).when(m.rlike(GRID), _says("unknown", "grid present but no record links")).when(own, _says("ok", "result grid")).otherwise(_says("rejected", "no rendered result list"))
    json_ = F.when(F.try_parse_json(html).isNull(), _says("rejected", "response is not valid JSON")).when(n.isNull(), _says("unknown", "JSON parsed but no recognised record array")).when(n == 0, _says("rejected", "endpoint returned 0 records")).otherwise(_says("ok", F.format_string("%d records", n)))
    detail = F.when(m.rlike(RESULT_LIST), _says("rejected", "this is a result list, not a record")).when(m.rlike(DETAIL), _says("ok", "record detail markers present")).otherwise(_says("unknown", "no detail markers matched"))
    return (
        F.when(status != 200, _says("rejected", F.concat(F.lit("http "), status.cast("string"))))
        .when(F.substr(m, F.lit(1), F.lit(HEAD)).rlike(BLOCKED), _says("rejected", "interstitial or error page"))
        .when(~api & (F.length(m) < LEAST), _says("rejected", F.format_string("body too small (%d bytes stripped)", F.length(m))))
        .when(page_type == "T-SEARCH", search)
        .when(page_type == "T-INDEX", index)
        .when(page_type.isin("API-CATALOG", "API-DATA"), json_)
        .when(page_type == "T-DETAIL", detail)
        .otherwise(_says("unknown", "unrecognised page type"))
    )
