"""Toxicity by a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a whole text and their beginnings of four to seven characters, hashed to
``2 ** BITS`` buckets.  The score is a logistic function of a bias, a weight for each bucket and, for each pair of buckets, the
product of their factor vectors: so a pair such as an insult and a mention of a group can count for more, or less,
than the sum of both.

The machine is fitted here on at most ``MAX_POSITIVE`` and ``MAX_NEGATIVE`` labelled documents (those of smallest id
hash), never on held-out ones (``crc32(doc_id as text) mod 5 = 0``).  Buckets get parameters if their share differs clearly
between the two kinds, or if they are among the ``PAIRED`` most frequent and stand with another in one kind clearly more or
less often than both alone let expect; so a pair of terms that are neutral alone is learned.  The bias is shifted to the share of positive labels.

Defined results: a null or empty text has no terms and scores the bias alone; a null doc_id counts as the empty text in
the split, so it is held out; repeated rows repeat; no usable label of one kind gives the score 0; a table without rows
gives none; other columns are never read.  One narrow pass, no shuffle; the model is a few thousand numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import process_cache, read_table

BITS, FACTORS, PREFIXES = 20, 4, (4, 5, 6, 7)
#: Bounds of the labelled sample, documented above.
MAX_POSITIVE, MAX_NEGATIVE = 3000, 6000
#: A bucket needs so many sampled documents, and its shares to lie so many standard errors apart.
LEAST_DOCS, LEAST_Z = 6, 3.5
#: Buckets whose pairs are looked at, and how many standard errors a pair's log-odds lie from what its buckets add up to.
PAIRED, PAIR_Z = 1200, 6.0
EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\…«»“”„‘’¡¿"
CACHE_WORDS = 400_000


def buckets(word: str) -> tuple[int, ...]:
    """Hash buckets of a lower-cased word: the word and its beginnings."""
    import zlib

    word = word.strip(EDGES)
    if not word:
        return ()
    mask = (1 << BITS) - 1
    out = [zlib.crc32(word.encode("utf-8")) & mask]
    out += [zlib.crc32(b"^" + word[:n].encode("utf-8")) & mask for n in PREFIXES if len(word) > n]
    return tuple(out)


class Machine:
    """A fitted machine: bias, and for each kept bucket its weight and factors."""

    def __init__(self, bias: float, table: dict[int, tuple[float, ...]], tag: str = ""):
        self.bias, self.table, self.tag = bias, table, tag

    def score(self, text: str) -> float:
        cache, table = process_cache(f"fm:{self.tag}", dict), self.table
        held: set[int] = set()
        for word in set(text.lower().split()):
            found = cache.get(word)
            if found is None:
                found = tuple(b for b in buckets(word) if b in table)
                if len(word) <= 64:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = found
            if found:
                held.update(found)
        total, sums, squares = self.bias, [0.0] * FACTORS, 0.0
        for b in sorted(held):
            w, *v = table[b]
            total += w
            for f, x in enumerate(v):
                sums[f] += x
                squares += x * x
        total += 0.5 * (sum(s * s for s in sums) - squares)
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, total))))


def interacting(rows: list, y, docs_of) -> list[int]:
    """Frequent buckets that are part of a pair with a clear interaction; ``docs_of`` counts the documents of a bucket."""
    import numpy as np

    often = np.argsort(-docs_of, kind="stable")[:PAIRED]
    often = often[(docs_of[often] >= 4 * LEAST_DOCS) & (docs_of[often] < 0.9 * len(rows))]
    if len(often) < 2:
        return []
    place = np.full(len(docs_of), -1)
    place[often] = np.arange(len(often))
    held = np.zeros((len(rows), len(often)), np.float32)
    for i, r in enumerate(rows):
        at = place[np.asarray(r, np.int64)]
        held[i, at[at >= 0]] = 1
    logs, error = 0.0, 0.0
    for sign, kind in ((1, held[y == 1]), (-1, held[y == 0])):
        both, one, n = kind.T @ kind, kind.sum(0), len(kind)
        cells = (both, one[:, None] - both, one[None, :] - both, n - one[:, None] - one[None, :] + both)
        for part, c in zip((1, -1, -1, 1), cells, strict=True):
            logs = logs + sign * part * np.log(np.maximum(c, 0) + 0.5)
            error = error + 1 / (np.maximum(c, 0) + 0.5)
    z = np.abs(logs) / np.sqrt(error)
    np.fill_diagonal(z, 0)
    return often[z.max(1) >= PAIR_Z].tolist()


def fit(rows: list, labels, prior: float, rounds: int = 400, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> Machine:
    """Fit to arrays of distinct buckets and labels 0 or 1 by Adam on the whole sample."""
    import zlib

    import numpy as np

    y = np.asarray(labels, np.float64)
    n1, n0 = int(y.sum()), int((1 - y).sum())
    if not n1 or not n0:
        return Machine(-40.0, {})
    size = 1 << BITS
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    pos = np.bincount(flat[y[owner] == 1], minlength=size)
    neg = np.bincount(flat[y[owner] == 0], minlength=size)
    p1, p0 = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1)
    z = np.abs(p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0)
    kept = np.flatnonzero((pos + neg >= LEAST_DOCS) & (z >= LEAST_Z))
    kept = np.union1d(kept, np.array(interacting(rows, y, pos + neg), np.int64)).astype(np.int64)
    index = np.full(size, -1)
    index[kept] = np.arange(len(kept))
    column, inside = index[flat], index[flat] >= 0
    column, owner = column[inside], owner[inside]
    m, n = len(kept), len(rows)
    rng = np.random.default_rng(seed)
    theta = np.concatenate([[0.0], np.zeros(m), rng.normal(0, 0.02, m * FACTORS)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)

    def by_row(values):
        return np.bincount(owner, values, minlength=n)

    for step in range(1, rounds + 1):
        w, v = theta[1 : m + 1], theta[m + 1 :].reshape(m, FACTORS)
        sums = np.stack([by_row(v[column, f]) for f in range(FACTORS)], 1)
        squares = by_row((v**2).sum(1)[column])
        out = theta[0] + by_row(w[column]) + 0.5 * ((sums**2).sum(1) - squares)
        err = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y) * weight
        each = err[owner]
        gv = np.stack([np.bincount(column, each * (sums[owner, f] - v[column, f]), minlength=m) for f in range(FACTORS)], 1)
        grad = np.concatenate([[err.sum()], np.bincount(column, each, minlength=m) + l2 * w, (gv + l2 * v).ravel()])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    # both kinds weighed alike so far: shift to their shares
    bias = float(theta[0]) + math.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    table = {int(b): (float(theta[1 + i]), *map(float, theta[m + 1 + i * FACTORS : m + 1 + (i + 1) * FACTORS])) for i, b in enumerate(kept)}
    return Machine(bias, table, f"{zlib.crc32(theta.tobytes()):08x}")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE) -> Machine:
    """Fit on a bounded sample of labelled rows that are not held out."""
    own = labels.where(~held_out() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = own.agg(F.avg("toxic").alias("p")).first()["p"]
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = own.where("toxic = 1").orderBy(*order).limit(max_positive).unionByName(own.where("toxic = 0").orderBy(*order).limit(max_negative))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted({b for w in set((t or "").lower().split()) for b in buckets(w)}) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["toxic", "rows"])

    # bounded by the limits above, hence broadcast
    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))
    held = one.select(F.col("toxic").cast("int"), "text").mapInArrow(run, "toxic int, rows array<int>").toArrow()
    held = held.combine_chunks()
    rows = [r.values.to_numpy(zero_copy_only=False) for r in held.column("rows")]
    return fit(rows, held.column("toxic").to_pylist(), shares if shares is not None else 0.5)


def with_score(docs: DataFrame, machine: Machine, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out_col: str = "score") -> DataFrame:
    """``keep`` columns and the score of each whole text."""
    fields = [f for f in docs.schema.fields if f.name in keep and f.name != out_col]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [machine.score(cell.as_py() or "") for cell in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], names=[*names, out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` double"])
    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, train(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE_SQL: dict[str, str] = {}
