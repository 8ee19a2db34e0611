"""Token counts as delta-maintained rollups.

A batch of changes holds inserts, deletes and revised counts.  Each becomes a signed delta of documents and tokens; the
deltas of a batch are added up by source, language and tokenizer version and written once, under the batch's name.
Totals are the sums over all committed batches, so they never need the documents again.

A commit is idempotent: the sums are written to a folder of their own and then renamed to the batch's name, which
succeeds once.  A batch that is sent again, or by two drivers at once, or by tasks that run twice after an executor was
lost, counts once.  ``compact`` folds committed batches into one without forgetting their names.

Defined results: a null source, language or tokenizer is a group of its own; a null text has no tokens and is one
document; a change without a count counts zero; an unknown operation raises; an empty batch is committed and changes
nothing; other columns are not read.  A source that holds a third of all rows is added up in every task before the
shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bpe import library_encoder
from lodestone.llm.common import materialize, read_table, scratch_path

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def with_token_count(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """``keep`` columns and ``n_tokens`` of each whole text by the ``tokenizers`` library; one narrow pass."""
    fields = [f for f in docs.schema.fields if f.name in keep and f.name != "n_tokens"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        for batch in batches:
            counts = encoder.sizes(batch.column(len(names)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(counts, pa.int64())], names=[*names, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_tokens long"])
    return docs.select(*(F.col(f"`{n}`") for n in names), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes(op, source, lang, tokenizer, n_tokens, old_tokens)`` by group; ``op`` is one of
    ``insert``, ``delete`` and ``revise`` (of ``old_tokens`` into ``n_tokens``)."""
    new, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    known = F.coalesce(F.col("op").isin("insert", "delete", "revise"), F.lit(False))
    docs = F.when(~known, F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("op", F.lit("null")))).cast("long"))
    docs = docs.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
    signed = changes.select(*GROUP, docs.cast("long").alias("docs"), tokens.cast("long").alias("tokens"))
    return signed.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept in a folder that all machines share, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for sub in ("batches", "pending"):
            self._fs.mkdirs(self._at(f"{self.path}/{sub}"))

    def _listed(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/batches")) if s.isDirectory())

    def _folded(self, listed: list[str]) -> set[str]:
        """Folders that compacted batches replace."""
        held = [b for b in listed if b.startswith("compact=")]
        found = self.spark.read.text([f"{self.path}/batches/{b}/names" for b in held]).collect() if held else []  # one short row for each batch
        return {json.loads(r["value"]) for r in found}

    def batches(self) -> list[str]:
        """Folders that count: all but those that a compacted batch replaces."""
        listed = self._listed()
        folded = self._folded(listed)
        return [b for b in listed if b not in folded]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; false if it was committed before, in which case nothing is read or changed."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"not a name of a batch: {batch!r}")
        listed = self._listed()
        if f"batch={batch}" in listed or f"batch={batch}" in self._folded(listed):
            return False
        pending = f"{self.path}/pending/{scratch_path(self.spark, batch).rpartition('/')[2]}"
        deltas(changes).coalesce(1).write.parquet(f"{pending}/sums")
        return self._publish(pending, f"batch={batch}")

    def _publish(self, pending: str, name: str) -> bool:
        """Rename into place.  If the name exists the rename fails, or lands inside it, where no reader looks."""
        to = self._at(f"{self.path}/batches/{name}")
        if self._fs.exists(to):
            self._fs.delete(self._at(pending), True)
            return False
        done = self._fs.rename(self._at(pending), to)
        nested = self._at(f"{self.path}/batches/{name}/{pending.rpartition('/')[2]}")
        if not done or self._fs.exists(nested):
            self._fs.delete(nested if done else self._at(pending), True)
            return False
        return True

    def _sums(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}/sums" for b in names]
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups that came to nothing are left out."""
        summed = self._sums(self.batches()).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return summed.where("docs != 0 or tokens != 0")

    def compact(self) -> None:
        """Fold all batches into one; only one driver may do so at a time.

        The new batch is published with the list of the folders that it replaces; readers ignore those from then on, and
        they are deleted last.  So totals are the same before, between and after, wherever a driver dies.
        """
        names = self.batches()
        if len(names) < 2:
            return
        listed = self._listed()
        inner = sorted(self._folded(listed) | set(names))
        tag = scratch_path(self.spark, "compact").rpartition("-")[2]
        pending = f"{self.path}/pending/compact-{tag}"
        self._sums(names).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).coalesce(1).write.parquet(f"{pending}/sums")
        self.spark.createDataFrame([(json.dumps(n),) for n in inner], "value string").coalesce(1).write.text(f"{pending}/names")
        if self._publish(pending, f"compact={tag}"):
            for name in listed:
                self._fs.delete(self._at(f"{self.path}/batches/{name}"), True)


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` under two tokenizer versions after four batches, each sent twice: all documents are inserted
    under both with an estimate (a quarter of their characters); under ``byte_bpe_50k`` each is revised to the tokenizer's
    count; documents that repeat an earlier text are deleted under that version, with their counts, and then under
    ``estimate``, with theirs.  Documents without a text stay, with no tokens."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    none = F.lit(None).cast("long")
    change = lambda d, op, version, n, old=none: d.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), n.alias("n_tokens"), old.alias("old_tokens"))
    estimate = F.floor(F.coalesce(F.char_length("text"), F.lit(0)) / 4).cast("long")
    keyed = docs.withColumns({"estimate": estimate, "key": F.xxhash64(F.coalesce("text", F.lit("")))})
    counted = with_token_count(keyed, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source", "lang", "estimate", "key"))
    counted = materialize(counted, "token-counts")
    first = counted.where("n_tokens > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = counted.join(first, "key").where("doc_id > first")
    rollup = Rollup(spark, scratch_path(spark, "token-rollup"))
    n, e = F.col("n_tokens"), F.col("estimate")
    batches = {
        "1-insert": change(counted, "insert", "estimate", e).unionByName(change(counted, "insert", "byte_bpe_50k", e)),
        "2-revise": change(counted, "revise", "byte_bpe_50k", n, e),
        "3-repeats": change(again, "delete", "byte_bpe_50k", n),
        "4-estimates": change(again, "delete", "estimate", e),
    }
    for _ in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
    return rollup.totals().select("source", "lang", "tokenizer", F.col("docs").alias("n_docs"), F.col("tokens").alias("n_tokens"))


QUERIES = {"op4_token_rollup": op4_token_rollup}
ORACLE_SQL: dict[str, str] = {}
