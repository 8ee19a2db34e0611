"""Benchmark decontamination by a distributed positional inverted index.  DataFrame functions only.

1. ``term_counts`` counts the benchmark's terms over all documents, added up in every task before the shuffle.
2. ``anchors`` takes, for every window of a test item, its two rarest terms by these counts, and ``build_postings``
   stores the documents and positions at which they stand.
3. ``candidates`` intersects the anchors' posting lists after subtracting each term's offset: a document and a
   diagonal (document position less item position) remain if both anchors of one window meet there.
4. ``phrase_hits`` compares the window's words at those diagonals: exact phrase matches.  ``proximity_matches`` asks
   instead that the two rarest terms of an item stand within a distance of one another.

Lists of terms that are no window's anchor are never needed, so they are counted and not stored.  Nothing is
joined to itself, so a passage that many documents share costs one candidate for each such document.

Defined results: a null or empty text has no words and no hit; a null item text or one without words gives no window;
an item of fewer words than a window is one window; items that share an id count once in ``n_items``; a null item id is
the id ``null`` as text; rows that repeat an id and a text get the same result; tables without rows give none or no
hit.  Other columns of the documents are kept; those that clash with an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import ascii_lower, computed_once, doc_key, materialize, read_table, small_enough

#: What stands between words, after lower-casing A-Z: ASCII other than digits and letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: A benchmark whose texts are larger than this is joined by shuffles instead of broadcasts.
BROADCAST_BYTES = 32 << 20


def words(text: Column) -> Column:
    """The words of a text.  Only before the first and behind the last separator may nothing stand."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


class Benchmark:
    """Items of a benchmark and how they may be joined."""

    def __init__(self, items: DataFrame, window: int = WINDOW):
        self.window = window
        own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("iw"))
        own = own.where(F.size("iw") > 0).distinct()
        self.items = materialize(own.withColumn("item", F.xxhash64("item_id", "iw")), "items")
        self.small = small_enough(self.items, "item_id", BROADCAST_BYTES) and small_enough(self.items.select(F.array_join("iw", " ").alias("t")), "t", BROADCAST_BYTES)

    def side(self, df: DataFrame) -> DataFrame:
        """``df``, which has at most a bounded multiple of the items' size, as the small side of a join."""
        return F.broadcast(df) if self.small else df

    def vocabulary(self) -> DataFrame:
        return self.items.select(F.explode("iw").alias("word")).select(F.xxhash64("word").alias("t")).distinct()


def term_counts(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``term, n``: how often each of the benchmark's terms (as a 64-bit hash) stands in the documents; stored."""
    found = docs.select(F.explode(words(F.col("text"))).alias("word")).select(F.xxhash64("word").alias("term"))
    return materialize(found.join(bench.side(bench.vocabulary()), F.col("term") == F.col("t")).groupBy("term").agg(F.count("*").alias("n")), "term-counts")


def build_postings(docs: DataFrame, bench: Benchmark, terms: DataFrame) -> DataFrame:
    """``k1, k2, pos, term`` of every occurrence of ``terms(term)``, a part of the benchmark's, stored as Parquet."""
    found = docs.select(*doc_key(docs), F.posexplode(words(F.col("text"))).alias("pos", "word")).select("k1", "k2", "pos", F.xxhash64("word").alias("term"))
    wanted = bench.side(terms.select(F.col("term").alias("t")).distinct())
    return materialize(found.join(wanted, F.col("term") == F.col("t")).drop("t"), "postings")


def anchors(bench: Benchmark, counts: DataFrame) -> DataFrame:
    """``item, term, offset, pairs``: the offsets of the two rarest terms of each window, and those pairs of the item."""
    placed = bench.items.select("item", F.size("iw").alias("len"), F.posexplode("iw").alias("offset", "word")).withColumn("term", F.xxhash64("word"))
    placed = placed.join(counts, "term", "left").select("item", "len", "offset", "term", F.coalesce("n", F.lit(0)).alias("n"))
    w = bench.window
    first = F.greatest(F.lit(0), F.col("offset") - (w - 1))
    last = F.least(F.col("offset"), F.greatest(F.lit(0), F.col("len") - w))
    inside = placed.withColumn("start", F.explode(F.sequence(first, last)))
    ranked = inside.groupBy("item", "start").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, 2).alias("low"))
    # a window one of whose terms no document holds has no occurrence
    ranked = ranked.where(F.col("low")[0]["n"] > 0)
    pair = F.struct(F.col("low")[0]["offset"].alias("a"), F.coalesce(F.try_element_at("low", F.lit(2))["offset"], F.col("low")[0]["offset"]).alias("b"))
    pairs = ranked.groupBy("item").agg(F.collect_set(pair).alias("pairs"))
    chosen = ranked.select("item", F.explode("low").alias("x")).select("item", F.col("x.term").alias("term"), F.col("x.offset").alias("offset")).distinct()
    return materialize(chosen.join(pairs, "item"), "anchors")


def candidates(bench: Benchmark, postings: DataFrame, chosen: DataFrame) -> DataFrame:
    """``k1, k2, item, diag`` where both anchors of a window stand at their offsets."""
    lists = bench.side(chosen.select("item", F.col("term").alias("t"), "offset"))
    met = postings.join(lists, F.col("term") == F.col("t")).select("k1", "k2", "item", (F.col("pos") - F.col("offset")).alias("diag"), "offset")
    met = met.groupBy("k1", "k2", "item", "diag").agg(F.collect_set("offset").alias("at"))
    pairs = chosen.select(F.col("item").alias("i"), "pairs").distinct()
    both = F.exists("pairs", lambda p: F.array_contains(F.col("at"), p["a"]) & F.array_contains(F.col("at"), p["b"]))
    return met.join(bench.side(pairs), F.col("item") == F.col("i")).where(both).select("k1", "k2", "item", "diag")


def phrase_hits(docs: DataFrame, bench: Benchmark, found: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (positions inside an occurrence of a window) and ``hit_items``."""
    w = bench.window
    items = bench.items.select(F.col("item").alias("i"), "item_id", "iw")
    # a document's diagonals of an item are no more than its words; the item's words come once for all of them
    diagonals = found.groupBy("k1", "k2", "item").agg(F.collect_set("diag").alias("diags"))
    listed = diagonals.join(bench.side(items), F.col("item") == F.col("i")).groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "iw", "diags")).alias("cand"))
    k = doc_key(docs)
    keyed = docs.drop("n_words", "hit_words", "hit_items").select(k[0].alias("d1"), k[1].alias("d2"), "*")
    joined = keyed.join(listed, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2")), "left").drop("k1", "k2", "d1", "d2")
    joined = computed_once(joined, "__w", words(F.col("text")))

    def starts(iw: Column, diag: Column) -> Column:
        size = F.least(F.lit(w), F.size(iw))
        low = F.greatest(F.lit(0), -diag)
        high = F.least(F.size(iw), F.size("__w") - diag) - size
        every = F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        return F.filter(every, lambda s: F.slice("__w", diag + s + 1, size) == F.slice(iw, s + 1, size))

    def of_item(c: Column) -> Column:
        size = F.least(F.lit(w), F.size(c["iw"]))
        return F.transform(c["diags"], lambda d: F.struct(c["item_id"].alias("item_id"), d.alias("diag"), size.alias("size"), starts(c["iw"], d).alias("starts")))

    checked = F.flatten(F.transform(F.coalesce("cand", F.array().cast(listed.schema["cand"].dataType)), of_item))
    checked = F.filter(checked, lambda c: F.size(c["starts"]) > 0)
    joined = computed_once(joined, "__c", checked)
    places = F.flatten(F.transform("__c", lambda c: F.flatten(F.transform(c["starts"], lambda s: F.sequence(c["diag"] + s, c["diag"] + s + c["size"] - 1)))))
    return joined.select(
        *(F.col(f"`{c}`") for c in joined.columns if c not in ("__w", "__c", "cand")),
        F.size("__w").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(places)).alias("hit_words"),
        F.array_sort(F.array_distinct(F.transform("__c", lambda c: c["item_id"]))).alias("hit_items"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with its exact phrase matches: ``n_words``, ``hit_words``, ``hit_items``."""
    bench = Benchmark(items, window)
    chosen = anchors(bench, term_counts(docs, bench))
    return phrase_hits(docs, bench, candidates(bench, build_postings(docs, bench, chosen), chosen))


def proximity_matches(docs: DataFrame, items: DataFrame, within: int = 8) -> DataFrame:
    """``k1, k2, item_id, n_near``: documents in which an item's two rarest terms stand within ``within`` words, in
    either order, and how many occurrences of the rarest do so.

    Positions are dealt into cells as long as the distance, so a term only meets those of its own and the next cells.
    """
    bench = Benchmark(items)
    counts = term_counts(docs, bench)
    placed = bench.items.select("item_id", F.explode(F.array_distinct("iw")).alias("word")).withColumn("term", F.xxhash64("word")).join(counts, "term")
    low = placed.groupBy("item_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "term"))), 1, 2).alias("low")).where(F.size("low") == 2)
    low = materialize(low.select("item_id", F.col("low")[0]["term"].alias("a"), F.col("low")[1]["term"].alias("b")), "rarest")
    postings = build_postings(docs, bench, low.select(F.explode(F.array("a", "b")).alias("term")))
    cell = F.floor(F.col("pos") / F.lit(within))
    left = postings.join(bench.side(low.select("item_id", "a")), F.col("term") == F.col("a")).select("k1", "k2", "item_id", F.col("pos").alias("p"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = postings.join(bench.side(low.select("item_id", "b")), F.col("term") == F.col("b")).select("k1", "k2", "item_id", F.col("pos").alias("q"), cell.alias("cell"))
    near = left.join(right, ["k1", "k2", "item_id", "cell"]).where(F.abs(F.col("p") - F.col("q")) <= within)
    return near.groupBy("k1", "k2", "item_id").agg(F.count_distinct("p").alias("n_near"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every benchmark item in every document."""
    found = decontaminate(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


QUERIES = {"op6_decontaminate": op6_decontaminate}
#: By n-gram windows instead of an index: the same result by another way.
ORACLE_SQL = {
    "op6_decontaminate": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS u(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS u(s) WHERE len(w) >= size),
hit AS (SELECT r, s, dw.size, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
places AS (SELECT DISTINCT r, p FROM hit, unnest(range(s, s + size)) AS u(p)),
n AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)
"""
}
