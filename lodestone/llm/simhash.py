"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Fingerprints that differ in at most three bits differ in at
most one bit in one of the segments, so each segment is indexed under its 32 one-wildcard variants (the segment with
one bit blanked).  Fingerprints that share a variant are candidates; their exact distance decides.

Exact copies collapse to one fingerprint before the index.  Only variants that two fingerprints share are dealt out.  A
large bucket is cut into blocks of bounded size, whose pairs go to different tasks; each gives only the links of a
spanning forest of what is really linked in it, never all pairs, and no true connection is lost: every pair of blocks is
compared, and a forest keeps what is connected.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle; repeated rows and ids give repeated rows; empty tables give none; a null
id takes part and counts as smaller than no other id (components are named by the smallest non-null id).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import docs_without_losers, doc_key, materialize, read_table, small_side
from lodestone.llm.graph import connected_components, dealt_blocks

SEGMENTS, SEGMENT_BITS, MAX_BITS = 2, 32, 3
#: A bucket's fingerprints are compared in blocks of so many.
BLOCK = 2048


def shingle_hashes(text: str | None, width: int):
    """XXH64 (seed 42) of each shingle of ``width`` words, repeats included; a text of fewer words is one shingle, one
    without words has none."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z only, and white space is \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.array([digest(g, 42) for g in grams], np.uint64)


def fingerprint(h) -> int:
    """The 64-bit fingerprint of shingle hashes, unsigned: bits that are set in over half of them."""
    import numpy as np

    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, width: int = 3, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out_col: str = "fp") -> DataFrame:
    """``keep`` columns and the signed 64-bit fingerprint; one narrow pass."""
    fields = [f for f in docs.schema.fields if f.name in keep and f.name != out_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column(len(names)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(fp.view(np.int64))], names=[*names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` long"])
    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def variants(fp: Column) -> Column:
    """Array of exact keys: segment, blanked bit, and the segment without that bit, in 38 bits of a long."""
    keys = []
    for s in range(SEGMENTS):
        part = F.shiftrightunsigned(fp, s * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
        for i in range(SEGMENT_BITS):
            keep = ((1 << SEGMENT_BITS) - 1) ^ (1 << i)
            keys.append(part.bitwiseAND(F.lit(keep)) + F.lit((s * SEGMENT_BITS + i) << SEGMENT_BITS))
    return F.array(*keys)


def _forest(left, right, same: bool, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``max_bits`` between two blocks (within one, if ``same``)."""
    import numpy as np

    a, b = np.asarray(left, np.int64).view(np.uint64), np.asarray(right, np.int64).view(np.uint64)
    every = np.concatenate([a, b]) if not same else a
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    shift = 0 if same else len(a)
    for i in range(len(a)):
        near = np.flatnonzero(np.bitwise_count(b ^ a[i]) <= max_bits)
        for j in near.tolist():
            x, y = find(i), find(j + shift)
            if x != y:
                parent[y] = x
                links.append((i, j))
    return [(int(left[i]), int(right[j])) for i, j in links]


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``(a, b)`` links of distinct fingerprints ``fp``; they connect just what pairs within ``max_bits`` connect."""
    if max_bits > 2 * SEGMENTS - 1:
        raise ValueError("one blanked bit a segment finds at most 2 * SEGMENTS - 1 differing bits")
    # by a number and a key of its own, which no earlier partitioning stands for: these few rows become many
    spread = fingerprints.select("fp").repartition(int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = spread.select("fp", F.explode(variants(F.col("fp"))).alias("key"))
    shared, _ = small_side(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-variants")
    dealt = dealt_blocks(keyed.join(shared, "key"), "key", "fp", "n", BLOCK)
    side = lambda c: F.array_compact(F.collect_list(F.when(F.col("block") == F.col(c), F.col("fp"))))
    pairs = dealt.groupBy("key", "i", "j").agg(side("i").alias("x"), side("j").alias("y")).select("x", "y", (F.col("i") == F.col("j")).alias("same"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = []
            for x, y, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                found += _forest(x.values.to_numpy(), y.values.to_numpy(), same, max_bits)
            edges = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``fp``, ``component`` and ``component_id``, the smallest ``doc_id`` that links reach from the row."""
    printed = materialize(with_fingerprint(docs, width, keep=tuple({*keep, "doc_id"})), "fingerprints")
    firsts = printed.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comps = connected_components(links(firsts.select("fp"), max_bits))
    named = firsts.join(comps.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    label = named.join(smallest, "component").select(F.col("fp").alias("__fp"), "component", "component_id")
    return printed.join(label, F.col("fp") == F.col("__fp")).drop("__fp")


def hex64(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def keep_first_of_each(docs: DataFrame, width: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: the one of smallest id, rows without an id last, and of rows that
    repeat an id with another text one.  Wholly repeated rows stay together.
    """
    k = doc_key(docs)
    found = near_duplicates(docs.select("*", *k), width, max_bits, keep=("doc_id", "k1", "k2"))
    return docs_without_losers(docs, found.select("doc_id", "k1", "k2", F.col("component").alias("group")))


QUERIES = {"op7_simhash": op7_simhash}
ORACLE_SQL: dict[str, str] = {}
