"""Index grids: by position with asserted headers, and by the role that each header names."""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.pagecode import over_texts

#: Header texts, in the order they are tried, and the roles of their columns (fixed values).
ROLES = (
    ("permit/application number", "number"), ("permit number", "number"), ("record number", "number"), ("permit no", "number"),
    ("permit type", "type"), ("record type", "type"), ("type", "type"), ("project name", "project"), ("description", "description"),
    ("short notes", "notes"), ("agency", "agency"), ("status", "status"), ("expiration", "expires"), ("expires", "expires"),
    ("opened", "date"), ("issue", "date"), ("date", "date"), ("address", "address"), ("action", "action"),
)
_HEAD = re.compile(r"<th[^>]*>(.*?)</th>", re.IGNORECASE | re.DOTALL)
_CELL = re.compile(r"<td[^>]*>(.*?)</td>", re.IGNORECASE | re.DOTALL)
_BAND = re.compile(r'<tr class="ACA_TabRow_(?:Odd|Even)[^"]*">(.*?)</tr>', re.IGNORECASE | re.DOTALL)
_PLAIN = re.compile(r'<tr class="Row"[^>]*>(.*?)</tr>', re.IGNORECASE | re.DOTALL)
_NUMBER = re.compile(r"lblPermitNumber1?[^>]*>([^<]+)", re.IGNORECASE)
_POPUP = re.compile(r"PopPermit\('([^']*)'\)")
_HREF = re.compile(r'href="([^"]*CapDetail\.aspx\?[^"]*)"', re.IGNORECASE)
_SHOWING = re.compile(r"Showing\s*\d+\s*-\s*\d+\s*of\s*([\d,]+)(\+?)", re.IGNORECASE)
_PLACE = re.compile(r"\d{2,}\s+\w|,\s*[A-Z]{2}\b")
_CUT = re.compile(r"only the first [\d,]+ records", re.IGNORECASE)


def shown(markup: str) -> str:
    text = re.sub("<[^>]+>", " ", markup)
    for name, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        text = text.replace(name, char)
    return " ".join(text.split())


def role_of(header: str) -> str | None:
    low = header.lower()
    return next((role for words, role in ROLES if words in low), None)


def by_role(page: str) -> tuple[list[dict[str, str]], int | None, bool]:
    """Rows by role, the stated total and whether it is only a lower bound.  A column without a role, or with one that is
    taken, is kept under ``col`` and its number; a row without a number is left out; if no header is an address, the first
    such column that looks like one is."""
    roles, rows = [role_of(shown(h)) for h in _HEAD.findall(page)], []
    for band in _BAND.findall(page):
        row: dict[str, str] = {}
        for i, cell in enumerate(_CELL.findall(band)):
            value, role = shown(cell), roles[i] if i < len(roles) else None
            if role and role not in row:
                row[role] = value
            elif value:
                row.setdefault(f"col{i}", value)
        if number := _NUMBER.search(band):
            row["number"] = shown(number[1])
        if href := _HREF.search(band):
            row["detail_href"] = entities.unescape(href[1])
        if "address" not in row:
            row |= {"address": v for v in [next((v for k, v in row.items() if k.startswith("col") and _PLACE.search(v)), None)] if v}
        if row.get("number"):
            rows.append(row)
    stated = _SHOWING.search(page)
    return rows, int(stated[1].replace(",", "")) if stated else None, bool(stated and stated[2])


def by_position(page: str, columns: tuple[str, ...], headers: tuple[str, ...]) -> tuple[list[dict[str, str]], bool]:
    """Rows by position and whether the page says that it is cut.  Headers in another order raise, for a swapped column
    would be read as another field; the identifier is that of the row's link, and rows without one are left out."""
    got = [shown(h).lower() for h in _HEAD.findall(page)]
    if len(got) >= len(headers) and not all(want in have for want, have in zip(headers, got, strict=False)):
        raise ValueError(f"columns in another order: expected {headers}, got {got}")
    rows = []
    for frag in _PLAIN.findall(page):
        cells = [shown(c) for c in _CELL.findall(frag)]
        if len(cells) >= len(columns):
            row = dict(zip(columns, cells, strict=False))
            if link := _POPUP.search(frag):
                row[columns[0]] = shown(link[1])
            if row[columns[0]]:
                rows.append(row)
    return rows, bool(_CUT.search(page))


def role_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """``row`` (a map by role), ``total`` and ``capped`` for each row of a role grid, with the other columns."""
    found = over_texts(pages, html, by_role, "rows array<map<string,string>>, total long, capped boolean")
    return found.select(*(c for c in found.columns if c != "rows"), F.explode("rows").alias("row"))


def position_rows(pages: DataFrame, columns: tuple[str, ...], headers: tuple[str, ...], html: str = "html") -> DataFrame:
    found = over_texts(pages, html, lambda p: by_position(p, columns, headers), "rows array<map<string,string>>, truncated boolean")
    each = found.select(*(c for c in found.columns if c != "rows"), F.explode("rows").alias("row"))
    return each.select(*(c for c in each.columns if c != "row"), *(F.col("row")[c].alias(c) for c in columns))
