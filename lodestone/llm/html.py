"""Main text of web pages: markup where it speaks, a suffix array of the host where it does not.

A page is cut into blocks.  Where elements name their role, that decides: blocks inside ``<article>`` (else ``<main>``)
are main text, and menus, headers, footers, sidebars, forms, notices, adverts and comments are not.  Repetition must
not overrule it: copies of an article repeat whole, and a menu may well differ on each page.

Pages that have neither element leave blocks of unknown role.  Their token streams are put together by host; all
suffixes are sorted by their first ``MIN_RUN`` tokens over the cluster, and a run of equal neighbours from pages with
different content is boilerplate.  Covered tokens go, unique runs stay.  (A suffix array in full depth finds the same
cover: a longer repeat is a succession of repeats of the least length.)  Rows are dealt by range of suffix, page and
position, so a run that thousands of pages share is split over tasks; runs that cross a border are settled from a table
of at most two runs for each task.

Defined results: a null or empty page has the empty text; an unclosed element ends with its parent or the page; an
unfinished tag or comment at the end is markup; repeated rows, and different pages of the same unmarked content, do not
make each other boilerplate; a null url is a host of its own; a table without rows gives none; other columns are not
read.  Pages are processed whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, read_table

#: Tokens that a repeated run has at least.
MIN_RUN = 6
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|select|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not interrupt a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav header footer aside form button menu dialog head".split())
#: Words of a class, id or role that tell boilerplate.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo cookie cookies consent gdpr notice notices menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar complementary contentinfo footer comment comments respond disqus share sharing social related newsletter subscribe popup modal login search".split()
)
#: Elements that a hint never drops: they hold the page or the article.
KEPT = frozenset("html body main article".split())


#: Words beside a hint that say nothing of their own.
NEUTRAL = frozenset("list box block section area wrapper container item items bar panel widget form links buttons thread inner outer top bottom".split())


def _hints_of(value: str, inside: bool) -> list[str]:
    """Hints among names of a class, id or role.  Inside articles a name counts if it says nothing else (``comment-12``,
    ``ad-box``, but not ``related-work``); outside it counts if a part of it does, unless it begins by denying it."""
    found = []
    for name in value.split():
        parts = [p for p in re.split("[^a-z]+", name) if p]
        if all(p in HINTS or p in NEUTRAL for p in parts) if inside else not (parts and parts[0] in ("no", "has", "with", "without")):
            found += parts
    return found


def _role(name: str, attrs: str, inside: bool = False) -> str:
    """``drop``, ``article``, ``main`` or nothing; ``inside`` an article only whole names are hints."""
    if name in DROPPED:
        return "drop"
    role = ""
    if attrs:
        for key, value in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                return "drop"
            if key in ("class", "id", "role"):
                if name not in KEPT and not HINTS.isdisjoint(_hints_of(value, inside)):
                    return "drop"
                if key == "role" and value in ("main", "article"):
                    role = value
    return name if name in ("article", "main") else role


def blocks_of(page: str) -> list[tuple[str, str]]:
    """``(zone, text)`` of the blocks of a page in order; zones are ``article``, ``main`` and ``loose``; dropped blocks
    are left out.  White space inside a block is one space, character references are decoded."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and the zone inside them
    zone, held, at = "loose", [], 0

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text and zone != "drop":
                out.append((zone, text))

    for m in MARKUP.finditer(page):
        if m.start() > at and zone != "drop":
            held.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            flush()
        if m["end"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if zone != (back := stack[i][1]):
                        flush()
                    zone = back
                    del stack[i:]
                    break
            continue
        attrs = m["attrs"]
        if name in VOID or attrs.endswith("/"):
            continue
        if name not in INLINE:  # a block ends an open paragraph
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    zone = stack[i][1]
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        stack.append((name, zone))
        role = _role(name, attrs, zone in ("article", "main"))
        if role and zone != "drop" and not (zone == "article" and role == "main"):
            flush()
            zone = role
    if at < len(page) and zone != "drop":
        held.append(page[at:])
    flush()
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, main`` (null if the page marks no main text) and ``loose`` (tokens of unknown role, then)."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            main, loose = [], []
            for cell in batch.column(2):
                found = blocks_of(cell.as_py() or "")
                best = next((z for z in ("article", "main") if any(z == zone for zone, _ in found)), None)
                main.append(" ".join(t for z, t in found if z == best) if best else None)
                loose.append(None if best else [w for _, t in found for w in t.split(" ")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(main, pa.string()), pa.array(loose, pa.list_(pa.string()))], names=["page_id", "url", "main", "loose"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, main string, loose array<string>")


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit("\x00"))


def repeated_positions(streams: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``host, page, pos`` where a run of ``min_run`` tokens starts that also stands on another page of the host.

    ``streams`` has ``host``, ``page`` (a long; pages of equal content share it) and ``tokens``.
    """
    window = F.array_join(F.slice("tokens", F.col("pos") + 1, F.lit(min_run)), "\x1f")
    starts = F.when(F.size("tokens") >= min_run, F.sequence(F.lit(0), F.size("tokens") - min_run))
    suffixes = streams.select("host", "page", "tokens", F.explode(starts).alias("pos")).select("host", window.alias("suffix"), "page", "pos")
    order = ("host", "suffix", "page", "pos")
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of equal suffix: rows of the run's first page wait for another page, so the memory is bounded by a
        page.  ``sure`` rows are settled; rows of a task's first and last run are left open."""
        key, first, waiting, opening = None, None, [], True

        def rows(items, sure):
            return pa.RecordBatch.from_arrays(
                [pa.array([i[0] for i in items], pa.string()), pa.array([i[1] for i in items], pa.string()), pa.array([i[2] for i in items], pa.int64()), pa.array([i[3] for i in items], pa.int32()), pa.array([sure] * len(items), pa.bool_())],
                names=["host", "suffix", "page", "pos", "sure"],
            )

        for batch in batches:
            sure, unsure = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row[0], row[1]) != key:
                    if opening and key is not None:
                        unsure += waiting
                        opening = False
                    key, first, waiting = (row[0], row[1]), row[2], [row]
                elif opening:
                    waiting.append(row)
                    if len(waiting) > 4096:
                        unsure += waiting
                        waiting = []
                elif row[2] != first:
                    sure += [*waiting, row]
                    waiting = []
                else:
                    waiting.append(row)
            for items, state in ((sure, True), (unsure, False)):
                if items:
                    yield rows(items, state)
        if waiting:
            yield rows(waiting, False)
        elif key is not None and not opening:  # the last run is repeated; tell the next task so
            yield rows([(key[0], key[1], first, -1)], False)

    scanned = materialize(ordered.mapInArrow(run, "host string, suffix string, page long, pos int, sure boolean"), "suffix-runs")
    border = scanned.where("not sure").groupBy("host", "suffix").agg(F.min("page").alias("low"), F.max("page").alias("high"), F.min("pos").alias("least"))
    # at most two runs for each task, as the scan leaves no others open
    border = border.where("low < high or least < 0").select("host", "suffix")
    settled = scanned.where("not sure and pos >= 0").join(F.broadcast(border), ["host", "suffix"], "left_semi")
    return scanned.where("sure").unionByName(settled.select(*scanned.columns)).select("host", "page", "pos")


def extract(pages: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """``page_id, url, text`` of every page."""
    parsed = materialize(parse_pages(pages), "pages")
    marked = parsed.where("loose is null").select("page_id", "url", F.coalesce("main", F.lit("")).alias("text"))
    loose = parsed.where("loose is not null").select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64("loose").alias("page"), F.col("loose").alias("tokens"))
    if loose.isEmpty():
        return marked
    streams = loose.groupBy("host", "page").agg(F.first("tokens").alias("tokens"))
    covered = repeated_positions(streams, min_run).groupBy("host", "page").agg(F.array_sort(F.collect_set("pos")).alias("starts"))
    joined = loose.join(covered, ["host", "page"], "left")
    reach = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (min_run - 1)))))
    joined = joined.withColumn("gone", F.when(F.col("starts").isNotNull(), reach).otherwise(F.array().cast("array<int>")))
    left = F.array_except(F.transform("tokens", lambda t, i: i), F.col("gone"))
    text = F.array_join(F.transform(left, lambda i: F.get("tokens", i)), " ")
    return marked.unionByName(joined.select("page_id", "url", text.alias("text")))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op5_html": op5_html}
ORACLE_SQL: dict[str, str] = {}
