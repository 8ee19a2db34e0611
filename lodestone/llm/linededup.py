"""Near-duplicate lines by a segment-partition edit join.  DataFrame functions only.

Lines of at least ``min_chars`` code points take part.  Lengths are put into classes; a class has ``edits + 1`` disjoint
segments of one width, the first half of them placed from the line's beginning and the rest from its end.  Of two lines
within ``edits`` edits the shorter has a segment that stands in the other, moved by no more places than there are
segments between it and its end of the line (the multi-match-aware bound).  Each line is indexed and probed under
(segment number, class, substring) for its own class and those that a line shorter by up to ``edits`` may be in.  Pairs
are verified by a banded bit-parallel automaton: for each number of edits a mask of the ``2 * edits + 1`` diagonals that
are reachable, moved on by one character with shifts and ands.

Only whether an earlier line is near is asked, so all pairs are never made.  Each line of a bucket is compared with the
bucket's earliest line; what that settles asks no more.  The unsettled lines are then compared with those earlier ones of
their bucket whose length and letter counts two edits allow; the counts, modulo four and in Gray code, are bits of which
an edit changes two at most.  An edit takes away and adds at most two pairs of adjacent characters each, so buckets of
more than ``FEW`` rows are dealt again: the pairs of characters fall by hash into ``4 * edits + 1`` parts, one of which is
equal, as a multiset, for any two lines within ``edits`` edits.

A line is a duplicate if an equal line, or one within ``edits`` edits, stands earlier; the order is (doc_id, line
number).  Lines are equal if two independent 64-bit hashes agree (128 bits); equal lines are one row wherever they stand,
so a line that a third of all documents hold is joined once.  Keys, not texts, are shuffled: only lines of pairs to
verify are fetched.

Defined results: a null text has no lines and stays null; an empty text has one short line; shorter lines are never
duplicates; a null doc_id stands before all others; rows that repeat a doc_id share positions, so lines at one position
do not remove each other; an empty table gives none; other columns are kept and those that clash with
an output column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import computed_once, doc_key, materialize, read_table, release, small_side

EDITS, MIN_CHARS = 2, 24
#: Characters after which hopeless pairs are given up.
HEAD = 24
#: Buckets of up to so many rows are compared whole; larger ones are dealt again by parts of the letter counts.
FEW = 32
#: Characters that are counted, two bits each.
COUNTED = "aeiounrsthldcgbwmpvqzékfyjxäöü"


def takes_part(line: Column, min_chars: int, min_equal: int | None) -> Column:
    """Lines of ``min_chars``, and if ``min_equal`` is given those from there on that are not blank."""
    long_enough = F.char_length(line) >= min_chars
    return long_enough if min_equal is None else long_enough | ((F.char_length(line) >= min_equal) & line.rlike(r"[^\x20\x09-\x0D]"))


class Places:
    """Positions of lines as one ordered number: a long where ids and lengths of texts allow it, else a decimal."""

    def __init__(self, docs: DataFrame, text_col: str = "text"):
        row = docs.agg(F.min(F.col("doc_id").cast("long")).alias("lo"), F.max(F.col("doc_id").cast("long")).alias("hi"), F.max(F.octet_length(text_col)).alias("n")).first()
        self.low = row["lo"] if row["lo"] is not None else 0
        self.bits = (row["n"] or 0).bit_length() + 1  # a text has no more lines than bytes and one
        self.long = ((row["hi"] or 0) - self.low + 1).bit_length() + self.bits <= 62

    def of(self, no: Column) -> Column:
        if self.long:
            doc = F.coalesce(F.col("doc_id").cast("long") - F.lit(self.low) + 1, F.lit(0).cast("long"))
            return F.shiftleft(doc, self.bits) + no
        doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)") - F.lit(self.low).cast("decimal(20,0)") + 1, F.lit(0))
        return (doc.cast("decimal(21,0)") * F.lit(1 << self.bits).cast("decimal(12,0)") + no).cast("decimal(38,0)")


def lines_of(docs: DataFrame, places: Places, min_chars: int, min_equal: int | None = None, text_col: str = "text") -> DataFrame:
    """``k1, k2, no, at, h, h2, line`` of every line that takes part: its document, number, position and hashes."""
    found = docs.select(*doc_key(docs, text_col=text_col), "doc_id", F.posexplode(F.split(text_col, "\n")).alias("no", "line"))
    found = found.where(takes_part(F.col("line"), min_chars, min_equal))
    return found.select("k1", "k2", "no", places.of(F.col("no")).alias("at"), F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")


def _class_of(n: Column) -> Column:
    """The largest multiple up to ``n`` of a step that is an eighth to a quarter of it."""
    n = F.greatest(n, F.lit(1))
    step = F.call_function("shiftleft", F.lit(1), F.greatest(F.floor(F.log2(n)).cast("int") - 2, F.lit(0)))
    return n - n % step


def segments(line: Column, q: Column, edits: int) -> list[tuple[int, Column, Column]]:
    """Number, start (from 0) and width of the substrings of a line to look up in class ``q``."""
    width, n, out = F.floor(q / F.lit(edits + 1)).cast("int"), F.char_length(line), []
    for i in range(edits + 1):
        start = F.lit(i) * width if i <= edits - i else n - F.lit(edits - i + 1) * width
        most = min(i, edits - i)
        out += [(i, start + F.lit(move), width) for move in range(-most, most + 1)]
    return out


def keyed(lines: DataFrame, edits: int) -> DataFrame:
    """``key, at, h`` for each lookup of each line."""
    n = F.char_length("line")
    classes = F.array_distinct(F.array(*(_class_of(n - d) for d in range(edits + 1))))
    rows, keys = lines.select("at", "h", "line", F.explode(classes).alias("q")), []
    for i, start, width in segments(F.col("line"), F.col("q"), edits):
        ok = (start >= 0) & (start + width <= n)
        keys.append(F.when(ok, F.xxhash64(F.lit(i), "q", F.col("line").substr(start + 1, width))))
    return rows.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "at", "h")


def letter_counts(line: Column) -> Column:
    """Counts of ``COUNTED`` characters modulo four, in Gray code, as one long: an edit changes at most two counts by one
    and so at most two bits."""
    total = F.lit(0).cast("long")
    for i, c in enumerate(COUNTED):
        n = (F.char_length(line) - F.char_length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        total = total.bitwiseOR(F.shiftleft(n.bitwiseXOR(F.shiftright(n, 1)).bitwiseAND(F.lit(3).cast("long")), 2 * i))
    return total


def with_grams(lines: DataFrame, edits: int) -> DataFrame:
    """``at, h, grams, sketch``: for each of ``4 * edits + 1`` parts of all pairs of adjacent characters, a number that
    depends on nothing but which of them the line holds and how often; and the parities of their numbers at 64 places."""
    n, most = F.char_length("line"), 4 * edits + 1
    chars = computed_once(lines.select("at", "h", "line"), "c", F.split("line", ""))
    each = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.xxhash64(F.get("c", i - 1), F.get("c", i)))
    grams = computed_once(chars, "g", F.when(n > 1, each).otherwise(F.array().cast("array<long>")))  # a line stays one row
    part = lambda j: F.filter("g", lambda x: F.pmod(x, F.lit(most)) == j)
    total = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda s, x: s + F.shiftright(x, 31))  # noqa: E731  so many bits can be summed over any line
    place = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(x, 9), F.lit(64)).cast("int"))
    sums = [total(part(j)) for j in range(most)]
    return grams.select("at", "h", F.array(*sums).alias("grams"), F.aggregate("g", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(place(x))).alias("sketch"))


def _common(a: Column, b: Column, most: Column, part) -> Column:
    """The largest length up to ``most`` at which ``part(text, length)`` of both agree, by bisection (up to 2 ** 21)."""
    longer = lambda n, step: F.when((n + step <= most) & (part(a, n + step) == part(b, n + step)), n + step).otherwise(n)
    return F.aggregate(F.array(*(F.lit(1 << i) for i in range(20, -1, -1))), F.lit(0), longer)


def within_edits(pairs: DataFrame, edits: int, a: str = "line_a", b: str = "line_b") -> DataFrame:
    """The rows of ``pairs`` whose texts are at most ``edits`` edits apart, by a banded bit-parallel automaton.

    What both texts begin and end with is cut off first.  Bit ``j`` of mask ``e`` says that the read part of the first
    text and the part of the second up to diagonal ``j - edits`` are within ``e`` edits.  After ``HEAD`` characters
    texts without a set bit are given up.
    """
    k, band = edits, 2 * edits + 1
    full, columns = (1 << band) - 1, pairs.columns
    masks = [f"r{e}" for e in range(k + 1)]
    least = F.least(F.char_length(a), F.char_length(b))
    df = pairs.where(F.abs(F.char_length(a) - F.char_length(b)) <= k)
    df = computed_once(df, "__p", _common(F.col(a), F.col(b), least, lambda t, n: F.left(t, n)))
    df = computed_once(df, "__s", _common(F.col(a), F.col(b), least - F.col("__p"), lambda t, n: F.right(t, n)))
    core = lambda t: F.col(t).substr(F.col("__p") + 1, F.char_length(t) - F.col("__p") - F.col("__s"))
    df = df.withColumns({"__n": F.char_length(a) - F.col("__p") - F.col("__s"), "__m": F.char_length(b) - F.col("__p") - F.col("__s")})
    df = computed_once(computed_once(df, "__x", F.split(core(a), "")), "__y", F.split(core(b), ""))
    n, m = F.col("__n"), F.col("__m")

    def widened(rows: list[Column]) -> list[Column]:
        """Characters of the second text that are skipped cost one edit each and move up a diagonal."""
        out = [rows[0]]
        for e in range(1, k + 1):
            out.append(rows[e].bitwiseOR(F.shiftleft(out[e - 1], 1).bitwiseAND(F.lit(full))))
        return out

    def state(rows: list[Column]) -> Column:
        return F.struct(*(r.alias(c) for r, c in zip(rows, masks, strict=True)))

    def step(s: Column, i: Column) -> Column:
        equal = [F.when((i + (j - k) < m) & F.coalesce(F.get("__y", i + (j - k)) == F.get("__x", i), F.lit(False)), F.lit(1 << j)).otherwise(F.lit(0)) for j in range(band)]

        def moved(match: Column) -> Column:
            rows = [s["r0"].bitwiseAND(match)]
            for e in range(1, k + 1):
                below = s[f"r{e - 1}"]
                rows.append(s[f"r{e}"].bitwiseAND(match).bitwiseOR(below).bitwiseOR(F.shiftright(below, 1)))
            return state(widened(rows))

        return F.get(F.transform(F.array(reduce(lambda p, q: p + q, equal)), moved), F.lit(0))  # the comparisons are made once

    def steps(low: Column, high: Column) -> Column:
        return F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    # before the first character: the diagonals of the characters of the second text that are skipped
    begin = state(widened([F.lit(1 << k)] * (k + 1)))
    head = F.least(n, F.lit(HEAD))
    df = computed_once(df, "__h", F.aggregate(steps(F.lit(0), head), begin, step)).where(F.col(f"__h.r{k}") != 0)
    end = F.aggregate(steps(head, n), F.col("__h"), step, lambda s: s[f"r{k}"])
    return df.where(F.call_function("shiftright", end, m - n + F.lit(k)).bitwiseAND(F.lit(1)) == 1).select(*columns)


def near_pairs(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """``at, h`` of the lines of ``pairs(at, h, at1, h1)`` that are within ``edits`` edits of the other; stored."""
    a = texts.select("at", "h", F.col("line").alias("line_a"), F.col("counts").alias("counts_a"))
    b = texts.select(F.col("at").alias("at1"), F.col("h").alias("h1"), F.col("line").alias("line_b"), F.col("counts").alias("counts_b"))
    both = pairs.distinct().join(a, ["at", "h"]).join(b, ["at1", "h1"])
    both = both.where(F.bit_count(F.col("counts_a").bitwiseXOR(F.col("counts_b"))) <= 2 * edits)
    return materialize(within_edits(both, edits).select("at", "h").distinct(), "line-settled")


def heads_of(rows: DataFrame) -> DataFrame:
    """``key, n, at1, h1`` of every key under which two different lines stand: rows and earliest line."""
    found = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("n"), F.min("at").alias("at1"), F.min_by("h", "at").alias("h1"))
    return found.where("lo < hi").select("key", "n", "at1", "h1")


def earlier_ones(members: DataFrame, texts: DataFrame, edits: int, few: int) -> DataFrame:
    """``at, h, at1, h1``: the lines of ``members`` that ask, with those earlier ones of their bucket, but its earliest, whose
    length and letter counts ``edits`` edits allow."""
    whole = members.where(F.col("n") <= few).withColumns({"part": F.lit(-1), "bits": F.lit(0).cast("long"), "grams": F.array().cast("array<long>"), "sketch": F.lit(0).cast("long")})
    large = members.where(F.col("n") > few)
    ids, _ = small_side(large.select("at", "h").distinct(), "line-ids")
    grams = materialize(with_grams(texts.join(ids, ["at", "h"], "left_semi"), edits), "line-grams")
    large = large.join(grams, ["at", "h"])
    dealt = whole.unionByName(large.select("*", F.posexplode("grams").alias("part", "bits")))
    other = dealt.select("key", "part", "bits", *(F.col(c).alias(f"{c}0") for c in ("at", "h", "counts", "size", "grams", "sketch")))
    again = F.lit(False)  # pairs that an earlier part brings together
    for j in range(4 * edits + 1):
        again = again | ((F.col("part") > j) & (F.get("grams", F.lit(j)) == F.get("grams0", F.lit(j))))
    fit = (F.col("at0") < F.col("at")) & (F.col("h0") != F.col("h")) & (F.abs(F.col("size") - F.col("size0")) <= edits)
    fit = fit & (F.bit_count(F.col("counts").bitwiseXOR(F.col("counts0"))) <= 2 * edits)
    fit = fit & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch0"))) <= 4 * edits) & ~again
    met = dealt.where("asks").join(other, ["key", "part", "bits"]).where(fit & ~((F.col("at0") == F.col("at1")) & (F.col("h0") == F.col("h1"))))
    return met.select("at", "h", F.col("at0").alias("at1"), F.col("h0").alias("h1"))


def near_lines(lines: DataFrame, edits: int = EDITS, few: int = FEW) -> DataFrame:
    """``at, h`` of the lines of ``lines(at, h, line)``, each once, that have an earlier line within ``edits`` edits."""
    rows = materialize(keyed(lines, edits), "line-keys", "lz4")
    heads, _ = small_side(heads_of(rows), "line-heads")
    hits = materialize(rows.join(heads, "key"), "line-hits")
    release(lines.sparkSession, rows)
    ids, _ = small_side(hits.select("at", "h").distinct(), "line-ids")
    texts = lines.select("at", "h", "line").join(ids, ["at", "h"], "left_semi").dropDuplicates(["at", "h"])
    texts = materialize(texts.withColumns({"counts": letter_counts(F.col("line")), "size": F.char_length("line")}), "line-texts")
    first = near_pairs(hits.where("at1 < at").select("at", "h", "at1", "h1"), texts, edits)
    # what is not settled and not the earliest asks on
    done, _ = small_side(first, "line-done")
    members = hits.where("n > 2").join(done.withColumn("done", F.lit(True)), ["at", "h"], "left").join(texts.select("at", "h", "counts", "size"), ["at", "h"])
    members = materialize(members.withColumn("asks", F.col("done").isNull() & (F.col("at1") < F.col("at"))).drop("done"), "line-members")
    second = near_pairs(earlier_ones(members, texts, edits, few), texts, edits)
    release(lines.sparkSession, hits, texts, members)
    return first.unionByName(second).distinct()


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, text_col: str = "text", min_equal: int | None = None) -> DataFrame:
    """``docs`` with ``text`` rid of duplicate lines, and ``n_lines``, ``n_exact``, ``n_near``: the lines that take
    part, those removed for an equal earlier line, and those removed for a near one only.  With ``min_equal``, shorter
    lines of so many characters that are not blank take part too, and go for an equal line."""
    lines = lines_of(docs, Places(docs, text_col), min_chars, min_equal, text_col)
    counted = lines.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    repeated, few = small_side(counted.where("n > 1").select("h", "h2", "first"), "line-repeats")
    own = lines.join(repeated, ["h", "h2"], "left")
    firsts = own.where((F.col("first").isNull() | (F.col("first") == F.col("at"))) & (F.char_length("line") >= min_chars)).select("at", "h", "line")
    if not few:
        firsts = materialize(firsts, "lines")
    near, _ = small_side(near_lines(firsts, edits), "line-near-ids")
    gone = own.drop("line").join(near.withColumn("near", F.lit(True)), ["at", "h"], "left")
    gone = gone.select("k1", "k2", "no", F.coalesce(F.col("first") < F.col("at"), F.lit(False)).alias("exact"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = gone.where("exact or near").groupBy("k1", "k2").agg(
        F.collect_set("no").alias("__gone"),
        F.count_distinct(F.when(F.col("exact"), F.col("no"))).alias("__exact"),
        F.count_distinct(F.when(~F.col("exact"), F.col("no"))).alias("__near"),
    )
    k = doc_key(docs, text_col=text_col)
    with_key = docs.select(k[0].alias("__d1"), k[1].alias("__d2"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")))
    joined = with_key.join(gone, (F.col("__d1") == F.col("k1")) & (F.col("__d2") == F.col("k2")), "left")
    split = F.split(F.col(text_col), "\n")
    kept = F.filter(F.transform(split, lambda x, i: F.when(~F.array_contains(F.col("__gone"), i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n_lines = F.coalesce(F.size(F.filter(split, lambda x: takes_part(x, min_chars, min_equal))), F.lit(0))
    others = [F.col(f"`{c}`") if c != text_col else text.alias(text_col) for c in docs.columns if c not in ("n_lines", "n_exact", "n_near")]
    return joined.select(
        *others,
        F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(n_lines).cast("long").alias("n_lines"),
        F.coalesce("__exact", F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce("__near", F.lit(0)).cast("long").alias("n_near"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate lines of every document and a digest of what stays."""
    found = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op9_line_dedup": op9_line_dedup}
#: By comparing all pairs of lines of nearly equal length.
ORACLE_SQL = {
    "op9_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, -9223372036854775808) AS k, doc_id, text FROM documents),
raw AS (SELECT r, k, s[i] AS line, i AS no FROM (SELECT r, k, string_split(text, chr(10)) AS s FROM d), unnest(range(1, len(s) + 1)) AS u(i)),
l AS (SELECT r, k, no, line FROM raw WHERE length(line) >= 24),
f AS (SELECT line, length(line) AS n, min((k::HUGEINT) * 10000000000 + no - 1) AS first FROM l GROUP BY line),
pairs AS (
  SELECT a.line AS line, b.first AS first FROM f a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= 2),
near AS (SELECT line, min(first) AS first FROM pairs GROUP BY line),
gone AS (
  SELECT l.r, l.no, f.first < (l.k::HUGEINT) * 10000000000 + l.no - 1 AS exact
  FROM l JOIN f USING (line) LEFT JOIN near USING (line)
  WHERE f.first < (l.k::HUGEINT) * 10000000000 + l.no - 1 OR coalesce(near.first < (l.k::HUGEINT) * 10000000000 + l.no - 1, false)),
kept AS (
  SELECT raw.r, string_agg(raw.line, chr(10) ORDER BY raw.no) AS text
  FROM raw LEFT JOIN gone ON raw.r = gone.r AND raw.no = gone.no WHERE gone.r IS NULL GROUP BY raw.r),
c AS (SELECT r, count(*) FILTER (WHERE exact) AS e, count(*) FILTER (WHERE NOT exact) AS n FROM gone GROUP BY r),
nl AS (SELECT r, count(*) AS n_lines FROM l GROUP BY r)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(e, 0) AS BIGINT) AS n_exact,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_near, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN nl USING (r) LEFT JOIN c USING (r) LEFT JOIN kept USING (r)
"""
}
