"""Near-duplicate documents: SimHash candidates, completed and decided by exact Jaccard similarity of word shingles.

SimHash by deletion variants (``simhash.links``) brings together what differs in at most three of 64 bits.  Texts of a
similarity of 0.8 differ in ten bits and more, too many for segments that one wildcard covers, so an index of shingles
finds the rest.  A document is the set of its shingles of ``width`` words, as 64-bit hashes.  Under one order of all
shingles, two sets of similarity ``num / den`` or more share one of their first ``n - ceil(n * num / den) + 1`` shingles, so
these are indexed and no such pair is missed.  The order puts shingles that are frequent in a sample last; the sample moves
the cost, never the result.  Only shingles that two sets share are gathered.  Whatever brings a pair together, the sizes of
intersection and union decide, in whole numbers.

Equal sets collapse before the index.  SimHash links and, in each shingle's bucket, pairs with its first set come first.
Pairs that these have not connected are then compared in pairs of blocks, which go to different tasks, by a sketch: the
parities of how many shingles fall to each of ``SKETCH`` places.  Sketches differ in no more places than the sets do, so a
pair whose sketches differ in too many is not similar; only the others are fetched whole.  So a large group gives hardly
more pairs than links, and no true connection is lost.

Defined results: a text without words, null or empty, has one empty shingle; a text of fewer words than a shingle is one
shingle; white space and letter case (A-Z) do not count; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import simhash
from lodestone.llm.common import doc_key, docs_without_losers, materialize, release, small_side
from lodestone.llm.graph import connected_components, dealt_blocks

WIDTH, NUM, DEN = 5, 4, 5
#: Documents in the sample that orders shingles, and how many of them hold a frequent one.
SAMPLE, FREQUENT = 4000, 4
#: Bits of the sketch of a set, of the finer one of sets that are fetched, and the sets of a block.
SKETCH, FINE, BLOCK = 512, 4096, 1024


def shingle_set(hashes):
    """Sorted distinct hashes; a text without words has the hash of the empty text."""
    import numpy as np
    import xxhash

    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def sketch_of(s, bits: int = SKETCH) -> list[int]:
    """Parity of the number of shingles at each of ``bits`` places, 64 in a long."""
    import numpy as np

    return np.packbits(np.bincount((s >> np.uint64(9)).astype(np.int64) % bits, minlength=bits) & 1).view(np.int64).tolist()


def frequent(docs: DataFrame, width: int) -> list[int]:
    """Shingles that at least ``FREQUENT`` documents of the sample hold; bounded by the sample."""
    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.lit(int(SAMPLE / max(n, 1) * (1 << 20)))).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sets = [shingle_set(simhash.shingle_hashes(t, width)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["s"])

    return [r["s"] for r in some.mapInArrow(run, "s long").groupBy("s").count().where(F.col("count") >= FREQUENT).select("s").collect()]


def with_sets(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``doc_id, k1, k2`` with ``sid``, which names the set, its size ``n``, the fingerprint ``fp``, the ``sketch`` and the shingles
    ``head`` to index, in order."""
    last = frequent(docs, width)
    keyed = docs.select("doc_id", *doc_key(docs), "text")
    names = ["doc_id", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        common = np.sort(np.array(last, np.int64).view(np.uint64))
        for batch in batches:
            sids, sizes, heads, prints, sketches = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                hashes = simhash.shingle_hashes(text, width)
                prints.append(simhash.fingerprint(hashes))
                s = shingle_set(hashes)
                sketches.append(sketch_of(s))
                n = len(s)
                at = np.searchsorted(common, s)
                often = (common[np.minimum(at, len(common) - 1)] == s) if len(common) else np.zeros(n, bool)
                sids.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                sizes.append(n)
                heads.append(np.concatenate([s[~often], s[often]])[: n + (-n * num // den) + 1].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            values = pa.array(np.concatenate([*heads, np.zeros(0, np.int64)]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.array(sids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sketches, pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=[*names, "sid", "n", "fp", "sketch", "head"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, sid long, n int, fp long, sketch array<long>, head array<long>")


def _full_sets(ids: DataFrame, docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """``sid, n, sketch, s`` of the distinct ``sid`` of ``ids``, with the finer sketch, stored; only their texts are read."""
    ids, _ = small_side(ids, "shingle-ids")
    one, _ = small_side(sets.select("sid", "k1", "k2").join(ids, "sid").groupBy("sid").agg(F.min(F.struct("k1", "k2")).alias("k")).select("sid", "k.k1", "k.k2"), "shingle-ids")
    texts = docs.select(*doc_key(docs), "text").join(one, ["k1", "k2"]).select("sid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            found = [shingle_set(simhash.shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            fine = pa.array([sketch_of(h, FINE) for h in found], pa.list_(pa.int64()))
            found = [h.view(np.int64) for h in found]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            values = pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))
            sizes = pa.array([len(h) for h in found], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, fine, pa.ListArray.from_arrays(pa.array(offsets), values)], names=["sid", "n", "sketch", "s"])

    return materialize(texts.mapInArrow(run, "sid long, n int, sketch array<long>, s array<long>"), "shingle-sets")


def _sketches_fit(pairs: DataFrame, each: DataFrame, num: int, den: int, bits: int = SKETCH) -> DataFrame:
    """The pairs ``a, b`` whose sketches allow the similarity: sets differ in no more than so many shingles."""
    side = lambda c: each.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.get("ka", F.lit(i)).bitwiseXOR(F.get("kb", F.lit(i)))) for i in range(bits // 64)), F.lit(0))
    return both.where(apart * (num + den) <= (F.col("na") + F.col("nb")) * (den - num)).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, each: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs ``a, b`` of sets whose similarity is at least ``num / den``."""
    pairs = materialize(_sketches_fit(pairs, each, num, den), "shingle-pairs")
    full = _full_sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), docs, sets, width)
    # whole sets travel once for each pair, so pairs that just miss the similarity are ruled out before
    close = materialize(_sketches_fit(pairs, full.select("sid", "n", "sketch"), num, den, FINE), "shingle-close")
    side = lambda c: full.select(F.col("sid").alias(c), F.col("s").alias(f"s{c}"))
    both = close.join(side("a"), "a").join(side("b"), "b").withColumn("i", F.size(F.array_intersect("sa", "sb")))
    # i / (na + nb - i) >= num / den
    links = materialize(both.where(F.col("i") * (num + den) >= (F.size("sa") + F.size("sb")) * num).select("a", "b").distinct(), "shingle-links")
    release(docs.sparkSession, full, pairs, close)
    return links


def _unlike_pairs(rest: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the sets of a bucket whose components differ and whose sizes, places and sketches allow the similarity."""
    dealt = dealt_blocks(rest, "s", "sid", "c", BLOCK)
    member = F.struct("sid", "n", "at", "component", "sketch")
    side = lambda c: F.array_compact(F.collect_list(F.when(F.col("block") == F.col(c), member)))
    work = dealt.groupBy("s", "i", "j").agg(side("i").alias("x"), side("j").alias("y")).select("x", "y").where("size(x) > 0 and size(y) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def columns(members):
            v = members.values
            sketch = v.field("sketch").flatten().to_numpy().view(np.uint64).reshape(len(v), -1)
            return [v.field(f).to_numpy().astype(np.int64) for f in ("sid", "n", "at", "component")], sketch

        for batch in batches:
            found = set()
            for x, y in zip(batch.column(0), batch.column(1), strict=True):
                ((a, na, pa_, ca), sa), ((b, nb, pb, cb), sb) = columns(x), columns(y)
                for i in range(len(a)):
                    total = nb + na[i]
                    # what the sets can share from here on, against num / (num + den) of both sizes
                    most = 1 + np.minimum(na[i] - pa_[i] - 1, nb - pb - 1)
                    at = np.flatnonzero((cb != ca[i]) & (most * (num + den) >= total * num))
                    if len(at):
                        apart = np.bitwise_count(sb[at] ^ sa[i]).sum(1, dtype=np.int64)
                        for o in b[at[apart * (num + den) <= total[at] * (den - num)]].tolist():
                            found.add((min(int(a[i]), o), max(int(a[i]), o)))
            edges = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["a", "b"])

    return work.mapInArrow(run, "a long, b long")


def _fit(n1: str, at1: str, n2: str, at2: str, num: int, den: int):
    """Whether two sets can reach the similarity if a shingle at these places of their order is the first they share."""
    most = 1 + F.least(F.col(n1) - F.col(at1) - 1, F.col(n2) - F.col(at2) - 1)
    return most * (num + den) >= (F.col(n1) + F.col(n2)) * num


def similar_sets(docs: DataFrame, sets: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``node, component`` of the sets that links of similarity ``num / den`` or more connect with another."""
    key = F.struct("k1", "k2")
    repeated = sets.groupBy("sid").agg(F.min(key).alias("k"), F.count("*").alias("c")).where("c > 1").select("sid", F.col("k.k1").alias("r1"), F.col("k.k2").alias("r2"))
    repeated, _ = small_side(repeated, "shingle-repeats")
    each = sets.join(repeated, "sid", "left").where(F.col("r1").isNull() | ((F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2"))))
    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))

    printed = each.groupBy("fp").agg(F.min("sid").alias("first"), F.count("*").alias("c"))
    same = each.select("sid", "fp").join(printed.where("c > 1"), "fp").where("sid != first").select(*pair("sid", "first"))
    by_bits = simhash.links(printed.select("fp"))
    first = printed.select("fp", "first")
    by_bits = by_bits.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(*pair("x", "y"))

    posted = each.select("sid", F.posexplode("head").alias("at", "s"))
    # one shuffle of narrow rows; a shingle's rows are counted from a buffer that spills, never gathered
    shared = materialize(posted.withColumn("c", F.count("*").over(Window.partitionBy("s"))).where("c > 1"), "shingles-shared")
    about = materialize(each.select("sid", "n", "sketch"), "shingle-about")
    members = materialize(shared.join(about.select("sid", "n"), "sid"), "shingle-members")
    release(docs.sparkSession, shared)
    heads = members.groupBy("s").agg(F.min("sid").alias("h"), F.min_by("n", "sid").alias("hn"), F.min_by("at", "sid").alias("hat"))
    star = members.join(heads, "s").where((F.col("sid") != F.col("h")) & _fit("n", "at", "hn", "hat", num, den)).select(*pair("sid", "h"))
    links = _verified(same.unionByName(by_bits).unionByName(star), docs, sets, about, width, num, den)

    release(docs.sparkSession)
    comps = connected_components(links).select(F.col("node").alias("sid"), "component")
    named = members.where("c > 2").join(comps, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = materialize(named, "shingle-named")
    mixed = named.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("sid").alias("h")).where("low < high").select("s", "h")
    # the first of the bucket has met all others
    rest = named.join(mixed, "s").where("sid != h").join(about.select("sid", "sketch"), "sid")
    more = _verified(_unlike_pairs(rest, num, den), docs, sets, about, width, num, den)
    release(docs.sparkSession, members, named, about)
    return connected_components(links.unionByName(more))


def keep_first_similar(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs`` with one document of each group that similarities of ``num / den`` or more connect: the one of smallest
    id, rows without an id last, and of rows that repeat an id with another text one.  Wholly repeated rows stay together.
    """
    sets = materialize(with_sets(docs, width, num, den), "shingle-heads")
    comps = similar_sets(docs, sets, width, num, den)
    rows = sets.join(comps.select(F.col("node").alias("sid"), "component"), "sid", "left")
    return docs_without_losers(docs, rows.select("doc_id", "k1", "k2", F.coalesce("component", "sid").alias("group")))
