"""Scalar normalization as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of the slice, shape and way to ``yyyy-M-d`` of each date format (fixed values).  No text has two of the shapes, so
#: their order does not matter and each text is read once.
DATE_SHAPES = (
    (10, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    (10, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (10, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
    (11, r"^(\d{1,2})-([A-Za-z]{3})-(\d{4})$", "$3-$2-$1"),
    (10, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$1-$2"),
    (19, r"^(\d{4}-\d{1,2}-\d{1,2})[T ]([01]?\d|2[0-3]):[0-5]?\d:([0-5]?\d|6[01])$", "$1"),
    (12, r"^([A-Za-z]{3}) (\d{1,2}), (\d{4})$", "$3-$1-$2"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def norm_text(x: Column) -> Column:
    """Collapsed and trimmed; null and the empty text are null.  ``(?U)``: white space of all scripts."""
    return F.when(x != "", F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def norm_cell(x: Column) -> Column:
    """As ``norm_text``, and nothing left is null."""
    return F.nullif(norm_text(x), F.lit(""))


def norm_name(x: Column) -> Column:
    return F.lower(norm_text(x))


def norm_int(x: Column) -> Column:
    """The first integer in a text, commas removed."""
    found = F.regexp_extract(x, r"-?\d[\d,]*", 0)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("bigint")


def norm_date(x: Column) -> Column:
    """ISO date of a text in one of the formats, or of epoch milliseconds; a leading ISO date is kept unchecked."""
    t = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    heads = F.struct(F.regexp_extract(t, r"(?U)^\S+", 0).alias("a"), F.substr(t, F.lit(1), F.lit(19)).alias("b"))

    def day(head: Column) -> Column:
        ymd = None
        for width, shape, order in DATE_SHAPES:
            part = F.substr(head, F.lit(1), F.lit(width))
            value = F.regexp_replace(part, shape, order)
            ymd = F.when(part.rlike(shape), value) if ymd is None else ymd.when(part.rlike(shape), value)
        name = F.lower(F.regexp_extract(ymd, "-([A-Za-z]{3})-", 1))
        month = F.array_position(F.array(*map(F.lit, MONTHS)), name)
        ymd = F.when(name == "", ymd).when(month > 0, F.regexp_replace(ymd, "[A-Za-z]{3}", month.cast("string")))
        return F.when(~F.startswith(ymd, F.lit("0000")), ymd).try_cast("date")

    # inside a lambda the heads are cut once
    read = F.transform(F.array(heads), lambda h: F.coalesce(day(h["a"]), F.when(h["a"] != h["b"], day(h["b"]))))
    iso = F.date_format(F.get(read, F.lit(0)), "yyyy-MM-dd")
    lead = F.nullif(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    epoch = F.date_format(F.timestamp_millis(x.try_cast("bigint")), "yyyy-MM-dd")
    return F.when(x.rlike(r"^\d{12,}$"), epoch).when(x != "", F.coalesce(iso, lead))


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def path_hash(paths: Column) -> Column:
    """First 12 hex digits of the SHA-1 of the sorted distinct paths."""
    return F.substr(F.sha1(F.array_join(F.array_sort(F.array_distinct(paths)), "\n")), F.lit(1), F.lit(12))


def unescape_entities(x: Column) -> Column:
    """Six entities in a fixed order, ``&amp;`` first."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


def fragment_text(x: Column) -> Column:
    """Text of a markup fragment: tags to spaces, entities, collapsed."""
    return F.trim(F.regexp_replace(unescape_entities(F.regexp_replace(x, "<[^>]+>", " ")), r"(?U)\s+", " "))


def zfill2(x: Column) -> Column:
    return F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)


def token_estimate(x: Column) -> Column:
    return F.floor(F.length(x) / 3.0).cast("bigint")


def yymm(iso: Column) -> Column:
    return F.concat(F.substr(iso, F.lit(3), F.lit(2)), F.substr(iso, F.lit(6), F.lit(2)))
