"""A corpus pipeline: documents in, encoded documents out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``.  All but the last return the columns of ``documents``.

1. quality: documents that the quality rules reject go.
2. lines: lines that repeat an earlier line, whatever their length unless blank, or from 24 characters on differ from
   one by at most two edits, go; a document of which no word is left goes with them.
3. near_duplicates: one document of each group of near copies stays: those that an exact Jaccard similarity of 0.8 or
   more of their five-word shingles connects.  SimHash gives candidates; the rest, which it cannot reach, come from an index.
4. decontamination: documents with a word inside a benchmark window go.
5. encoding: ids, and a check that they decode to the text.

``n_chars`` follows the text.  An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, linededup, quality, shingles
from lodestone.llm.common import read_table, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.judge(docs.select(*COLUMNS), chain).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _table(linededup.dedup_lines(docs.select(*COLUMNS), min_equal=1).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_first_similar(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "text"))
    return coded.select("doc_id", "n_tokens", "ids", "ids_sha256", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("quality", quality_rules),
    ("lines", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]
#: Quality by a trained chain, near copies by hashed shingles and BPE are beyond SQL; tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    base = scratch_path(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
