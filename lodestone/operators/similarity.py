"""Structural similarity of pages: pairs, clusters and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.markup import jaccard
from lodestone.sources.shared import settled


def pairs(sets: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` of the pairs at or above ``least``.

    Pages with one structure are one item.  Sets this similar share one of the first ``n - ceil(least * n) + 1`` of
    their members in a common order, rarest first, so only those meet; sizes must be within the same ratio.
    """
    items = sets.where(F.size("paths") > 0).groupBy("paths").agg(F.min("page_id").alias("page_id"))
    counts = items.select(F.explode("paths").alias("path")).groupBy("path").agg(F.count("*").alias("df"))
    ranked = items.select("page_id", F.size("paths").alias("n"), F.explode("paths").alias("path")).join(counts, "path")
    prefix = ranked.groupBy("page_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "path"))).alias("o"))
    prefix = prefix.select("page_id", "n", F.explode(F.slice("o", F.lit(1), (F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).cast("int"))).alias("x")).select("page_id", "n", F.col("x.path").alias("path"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.page_id") < F.col("b.page_id")) & (F.least("a.n", "b.n") >= least * F.greatest("a.n", "b.n")))
    near = near.select(F.col("a.page_id").alias("a"), F.col("b.page_id").alias("b")).distinct()
    side = lambda c: items.select(F.col("page_id").alias(c), F.col("paths").alias(f"p{c}"))
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", jaccard(F.col("pa"), F.col("pb")).alias("similarity")).where(F.col("similarity") >= least)


def comparable_pairs(marks: DataFrame) -> DataFrame:
    """``a, b, same``: pages of one jurisdiction, each next two; marks of different rules raise, for they cannot be compared."""
    version = lambda c: F.regexp_extract(c, r"^([a-z0-9]+):([0-9a-f]{6,40})$", 1)
    w = Window.partitionBy("jurisdiction").orderBy("page_id")
    d = marks.withColumns({"b": F.lead("page_id").over(w), "other": F.lead("mark").over(w)}).where("b is not null")
    differ = F.raise_error(F.concat(F.lit("marks of different rules: "), F.col("mark"), F.lit(", "), F.col("other"))).cast("boolean")
    return d.select(F.col("page_id").alias("a"), "b", F.when(version(F.col("mark")) != version(F.col("other")), differ).otherwise(F.col("mark") == F.col("other")).alias("same"))


def clusters(sets: DataFrame, least: float, rounds: int = 100) -> DataFrame:
    """``page_id, component`` by single linkage; each page takes the smallest page it reaches."""
    sets = settled(sets.select("page_id", "paths"))
    items = settled(sets.where(F.size("paths") > 0).groupBy("paths").agg(F.min("page_id").alias("item")))
    links = pairs(sets, least).select("a", "b")
    both = settled(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    label = items.select(F.col("item").alias("a"), F.col("item").alias("component"))
    for _ in range(rounds):
        heard = both.join(label.select(F.col("a").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        low = F.coalesce("m", "component")
        near = label.join(heard, "a", "left").select("a", F.least("component", low).alias("component"), (low < F.col("component")).alias("moved"))
        # a label's own label: chains halve each round instead of losing one link
        over = near.select(F.col("a").alias("component"), F.col("component").alias("further"))
        moved = settled(near.join(over, "component", "left").select("a", F.least("component", F.coalesce("further", "component")).alias("component"), "moved"))
        label = moved.select("a", "component")
        if moved.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"clusters did not settle in {rounds} rounds")
    member = sets.join(items, "paths", "left")
    return member.join(label.withColumnRenamed("a", "item"), "item", "left").select("page_id", F.coalesce("component", "page_id").alias("component"))


def cohort(clustered: DataFrame) -> DataFrame:
    """Number of clusters, their mean, median and largest size."""
    sizes = clustered.groupBy("component").agg(F.count("*").alias("size"))
    xs = F.array_sort(F.collect_list("size"))
    return sizes.agg(F.count("*").alias("clusters"), F.round(F.avg("size"), 6).alias("mean_size"), F.max("size").alias("largest"), xs.alias("xs")).select("clusters", "mean_size", "largest", F.get("xs", F.floor(F.size("xs") / 2).cast("int")).alias("median"))
