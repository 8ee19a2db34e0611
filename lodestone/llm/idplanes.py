"""Token ids in binary blocks of shuffled planes.

Documents are dealt by ranges of doc_id, so shards follow one another in ascending order.  A shard is the ids of its
documents, one after another, cut into blocks of a fixed number of ids.  The ids of a block are transposed into bit or
byte planes, each compressed by zstandard on its own; planes without a set bit take no space.  A block begins with its
chunk index: magic, kind of planes, number of ids, checksum, and the length of each plane.

The container is Parquet, one row a block, so writing is committed as Spark commits files, on any file system, and a
lost executor or a task that runs twice leaves nothing behind.  Beside the block a row holds its shard, number, first
position, and the documents with their share of it.

Defined results: a null or empty text is one end id; a null doc_id comes first; rows of equal doc_id follow in the
order of a hash of their text, then the text; a table without rows gives no block; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.bpe import library_encoder
from lodestone.llm.common import read_table, scratch_path

MAGIC, BIT_PLANES, BYTE_PLANES = b"LSP1", 1, 8
BLOCK_IDS, LEVEL, END_ID = 1 << 16, 3, 2
HEAD = "<4sBII"
_BLOCKS = "shard int, block int, first long, n_ids int, payload binary, docs array<struct<doc_id: {kind}, ord: long, n: int>>"


def pack(ids, plane_bits: int = BYTE_PLANES, level: int = LEVEL) -> bytes:
    """A block of unsigned 32-bit ids as header, plane index and compressed planes."""
    import numpy as np
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    raw = ids.view(np.uint8).reshape(-1, 4)
    if plane_bits == BYTE_PLANES:
        planes = [np.ascontiguousarray(raw[:, i]) for i in range(4)]
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        planes = [np.packbits(bits[:, i], bitorder="little") for i in range(32)]
    zip_ = zstandard.ZstdCompressor(level=level)
    packed = [zip_.compress(p.tobytes()) if p.any() else b"" for p in planes]
    head = struct.pack(HEAD, MAGIC, plane_bits, len(ids), zlib.crc32(ids.tobytes()))
    return head + struct.pack(f"<{len(packed)}I", *map(len, packed)) + b"".join(packed)


def unpack(payload: bytes):
    """The ids of a block; a block whose checksum differs raises."""
    import numpy as np
    import zstandard

    magic, plane_bits, n, crc = struct.unpack_from(HEAD, payload)
    if magic != MAGIC:
        raise ValueError("not a block of planes")
    count = 32 // plane_bits
    sizes = struct.unpack_from(f"<{count}I", payload, struct.calcsize(HEAD))
    at, unzip, raw = struct.calcsize(HEAD) + 4 * count, zstandard.ZstdDecompressor(), np.zeros((n, 4), np.uint8)
    bits = np.zeros((n, 32), np.uint8) if plane_bits == BIT_PLANES else None
    for i, size in enumerate(sizes):
        if size:
            plane = np.frombuffer(unzip.decompress(payload[at : at + size]), np.uint8)
            if bits is None:
                raw[:, i] = plane
            else:
                bits[:, i] = np.unpackbits(plane, count=n, bitorder="little")
        at += size
    if bits is not None:
        raw = np.packbits(bits, axis=1, bitorder="little")
    ids = np.ascontiguousarray(raw).view("<u4").reshape(-1)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of a block differs")
    return ids


def crc32_combine(first: int, second: int, length: int) -> int:
    """The checksum of two byte strings in succession, from theirs and the second's length.

    A checksum is linear over GF(2): ``length`` zero bytes are appended to the first by repeated squaring of the
    operator that appends one zero bit.
    """

    def times(matrix, vector):
        total, i = 0, 0
        while vector:
            if vector & 1:
                total ^= matrix[i]
            vector >>= 1
            i += 1
        return total

    operator = [0xEDB88320, *(1 << i for i in range(31))]
    bits = 8 * length
    while bits:
        if bits & 1:
            first = times(operator, first)
        operator = [times(operator, x) for x in operator]
        bits >>= 1
    return first ^ second


def write_blocks(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = END_ID, block_ids: int = BLOCK_IDS, plane_bits: int = BYTE_PLANES) -> None:
    """Encode every whole text, append ``end_id`` and write the blocks to ``path`` in ascending doc_id order."""
    from pyspark import TaskContext

    kind = docs.schema["doc_id"].dataType.simpleString()
    field = pa.struct([("doc_id", pa.string() if kind == "string" else pa.int64()), ("ord", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = library_encoder(tokenizer_path)
        shard, block, first, order = TaskContext.get().partitionId(), 0, 0, 0
        held, held_n, owners = [], 0, []  # arrays of ids not yet written, and whose they are

        def emit(size: int) -> pa.RecordBatch:
            """The next block: of the held arrays only those that it takes are touched."""
            nonlocal held_n, block, first
            left, parts, mine = size, [], []
            used = 0
            while left:
                part = held[used][:left]
                doc, o = owners[used]
                parts.append(part)
                mine.append({"doc_id": doc, "ord": o, "n": len(part)})
                left -= len(part)
                if len(part) < len(held[used]):
                    held[used] = held[used][len(part) :]  # a view
                else:
                    used += 1
            del held[:used], owners[:used]
            now = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([len(now)], pa.int32()), pa.array([pack(now, plane_bits)], pa.binary()), pa.array([mine], pa.list_(field))],
                names=["shard", "block", "first", "n_ids", "payload", "docs"],
            )
            held_n, block, first = held_n - size, block + 1, first + size
            return out

        for batch in batches:
            texts, ids_of = batch.column(1), batch.column(0).to_pylist()
            for low, codes in encoder.column(texts):
                starts, ends = codes.starts.tolist(), (codes.starts + codes.sizes).tolist()
                for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    held.append(np.concatenate([codes.ids[a:b], [end_id]]).astype("<u4"))
                    held_n += b - a + 1
                    owners.append((ids_of[low + i], order))
                    order += 1
                    while held_n >= block_ids:
                        yield emit(block_ids)
        if held_n:
            yield emit(held_n)

    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = own.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    dealt.mapInArrow(run, _BLOCKS.format(kind=kind)).write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the blocks at ``path``."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    id_type = pa.string() if kind == "string" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for shard, first, payload, docs in zip(*(batch.column(i) for i in range(4)), strict=True):
                data = unpack(payload.as_py()).tobytes()
                at, start = 0, first.as_py()
                for d in docs.as_py():
                    row = (shard.as_py(), d["ord"], d["doc_id"], start + at, d["n"], zlib.crc32(data[4 * at : 4 * (at + d["n"])]))
                    at += d["n"]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            types = [pa.int32(), pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["shard", "ord", "doc_id", "at", "n", "crc"])

    pieces = blocks.select("shard", "first", "payload", "docs").mapInArrow(run, f"shard int, ord long, doc_id {kind}, at long, n long, crc long")
    # a document has as many pieces as blocks it spans
    docs = pieces.groupBy("shard", "ord").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("pieces"))

    @F.pandas_udf("long")
    def joined(crcs, sizes):
        out = []
        for c, n in zip(crcs, sizes, strict=True):
            total = int(c[0])
            for x, size in zip(c[1:], n[1:], strict=True):
                total = crc32_combine(total, int(x), 4 * int(size))
            out.append(total)
        import pandas as pd

        return pd.Series(out, dtype="int64")

    # one row for each shard: as many as the writer had tasks
    ends = blocks.groupBy("shard").agg(F.max(F.col("first") + F.col("n_ids")).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(F.col("shard").alias("s"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    placed = docs.join(F.broadcast(base), F.col("shard") == F.col("s"))
    crc = joined(F.transform("pieces", lambda p: p["crc"]), F.transform("pieces", lambda p: p["n"]))
    return placed.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text written as blocks and read back."""
    import public_tokenizers

    path = scratch_path(spark, "id-blocks")
    write_blocks(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_blocks(spark, path)


QUERIES = {"op3_token_ids": op3_token_ids}
ORACLE_SQL: dict[str, str] = {}
