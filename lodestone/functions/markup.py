"""Functions over page markup.  Patterns stay in the JVM; only what must walk the tree is an Arrow function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text

#: What makes up a structural fingerprint.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript svg math canvas".split())
MAX_DEPTH, VERSION, SEPARATOR = 200, "fp1", ">"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " "), r"(?s)<!--.*?-->", " ")


def title(html: Column) -> Column:
    """First title, tags removed, collapsed, at most 160 characters."""
    return F.substr(text.fragment_text(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(1), F.lit(160))


def links(pages: DataFrame, limit: int = 25) -> DataFrame:
    """``page_id, n, url, label``: the first ``limit`` distinct links of a page in order, as the feature is a short list."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=\"([^\"]*)\"[^>]*>.*?</a>"), 1).alias("url"),
        F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*href=\"[^\"]*\"[^>]*>(.*?)</a>"), 1).alias("label"),
    )
    d = pages.select("page_id", F.posexplode(found).alias("at", "l")).select("page_id", "at", "l.url", text.fragment_text(F.col("l.label")).alias("label"))
    d = d.where(~F.col("url").rlike(r"^(#|mailto:|tel:|javascript:)"))
    first = d.groupBy("page_id", "url").agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"))
    kept = first.groupBy("page_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "url", "label"))), 1, limit).alias("l"))
    return kept.select("page_id", F.posexplode("l").alias("n", "x")).select("page_id", "n", "x.url", "x.label")


TABLE = r"(?is)<table[^>]*\bid\s*=\s*[\"']?([^\"'\s>]+)[^>]*>(.*?)</table>"
DATED = r"\d{1,2}/\d{1,2}/\d{4}"


def tables(pages: DataFrame, html: str = "html") -> DataFrame:
    """``table, row, cells`` of every table that has an id, with the other columns; rows without cells are left out."""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(TABLE), 1).alias("id"), F.regexp_extract_all(F.col(html), F.lit(TABLE), 2).alias("body"))
    each = pages.select(*(c for c in pages.columns if c != html), F.explode(found).alias("t"))
    return grid_rows(each.select(*(c for c in each.columns if c != "t"), F.col("t.id").alias("table"), F.col("t.body").alias("body")), "body")


def result_grids(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_wide, n_dated`` of the tables of at least three rows of three cells of which one or more hold a date."""
    dated = F.exists("cells", lambda c: c.rlike(DATED))
    wide = rows.where(F.size("cells") >= 3).groupBy(*keys).agg(F.count("*").alias("n_wide"), F.count_if(dated).alias("n_dated"))
    return wide.where("n_wide >= 3 and n_dated >= 1")


def first_of_names(names: Column, values: Column) -> Column:
    """A map in which the first value of a name wins."""
    pairs = F.arrays_zip(names.alias("k"), values.alias("v"))
    return F.map_from_entries(F.filter(F.transform(pairs, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v"))), lambda p, i: F.array_position(names, p["k"]) == i + 1))


def grid_rows(grids: DataFrame, html: str = "html") -> DataFrame:
    """One row for each table row that has cells, with its cells' texts."""
    rows = grids.select(*(c for c in grids.columns if c != html), F.posexplode(F.regexp_extract_all(F.col(html), F.lit(ROW), 1)).alias("row", "inner"))
    cells = F.transform(F.regexp_extract_all("inner", F.lit(CELL), 1), text.fragment_text)
    return rows.withColumn("cells", cells).where(F.size("cells") > 0).drop("inner")


def modal_width(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest number of cells of each grid; the wider of a tie."""
    n = rows.groupBy(*keys, F.size("cells").alias("width")).agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(F.max_by("width", F.struct("n", "width")).alias("width"), F.max("n").alias("n"))


def tag_paths(page: str) -> tuple[list[str], int]:
    """Sorted distinct paths from the root to each leaf, and the number of elements.  Never raises."""
    from html.parser import HTMLParser

    paths: set[str] = set()
    count = 0

    class Walker(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.open: list[list] = []  # tag, whether it has a child
            self.skip = False

        def leaf(self, *more):
            paths.add(SEPARATOR.join([t for t, _ in self.open] + list(more)))

        def seen(self):
            nonlocal count
            count += 1
            if self.open:
                self.open[-1][1] = True

        def shut(self):
            if not self.open[-1][1]:
                self.leaf()
            self.open.pop()

        def handle_starttag(self, tag, attrs):
            if self.skip or tag in OPAQUE:
                self.skip = True
                return
            self.seen()
            if tag in VOID:
                self.leaf(tag)
                return
            self.open.append([tag, False])
            if len(self.open) > MAX_DEPTH:  # too deep to be structure: a leaf
                self.shut()

        def handle_startendtag(self, tag, attrs):
            if not self.skip and tag not in OPAQUE:
                self.seen()
                self.leaf(tag)

        def handle_endtag(self, tag):
            if self.skip:
                self.skip = tag not in OPAQUE
            elif tag not in VOID and any(t == tag for t, _ in self.open):
                last = None
                while last != tag:  # unclosed elements end with the one around them
                    last = self.open[-1][0]
                    self.shut()

        def finish(self):
            while self.open:
                self.shut()

    walker = Walker()
    try:
        walker.feed(page)
        walker.close()
    except Exception:  # a page that no parser takes has the paths found so far
        pass
    walker.finish()
    return sorted(paths), count


def fingerprints(pages: DataFrame) -> DataFrame:
    """``page_id, url, paths, n_nodes, mark``; a page without elements has the empty mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [tag_paths(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())], names=["page_id", "url", "paths", "n_nodes"])

    d = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, paths array<string>, n_nodes long")
    return d.withColumn("mark", F.when(F.col("n_nodes") > 0, F.concat(F.lit(f"{VERSION}:"), text.path_hash(F.col("paths")))).otherwise(F.lit("")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
