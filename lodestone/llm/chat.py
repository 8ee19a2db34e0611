"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole by a template that marks turns; control strings inside roles and texts are escaped
reversibly, so no text can end its turn or start another.  The rendered text is encoded once with offsets, and the
spans of assistant texts are intersected with the sorted token spans by binary search: the mask is a list of token
ranges.  The mark before and after each role and text is an added token of the tokenizer, at which it cuts whatever stands
beside it; so a range covers its span to the character, which is checked, and the loss is read back from whole tokens.

Defined results: a null role, text or turn is the empty text or comes first; turns that share a number are ordered by
role and text and all kept; a null conv_id is a conversation of its own; an empty text has no tokens under the mask;
an empty table gives none; other columns are not read.  A conversation is the unit of rendering: its turns meet in one
task, as the one encoding of it demands, while conversations are spread over tasks.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import process_cache, read_table

#: The added token that stands before each role, between role and text, and after the last text.
MARK = "<|endoftext|>"
#: Strings that some chat template gives a meaning to; a backslash after the first character breaks them (fixed values).
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], mark: str = MARK) -> tuple[str, list[tuple[int, int]]]:
    """The rendered conversation and the spans of its assistant texts, in code points and ascending."""
    out, at, spans = [mark], len(mark), []
    for role, text in turns:
        head, body = f"{escape(role)}{mark}", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, mark]
        at += len(head) + len(body) + len(mark)
    return "".join(out), spans


def parse(formatted: str, mark: str = MARK) -> list[tuple[str, str]]:
    """The turns of a rendered conversation; no escaped text holds the mark."""
    parts = list(map(unescape, formatted.split(mark)[1:-1]))
    return list(zip(parts[::2], parts[1::2], strict=True))


def masked_tokens(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each span, the range of tokens that meet it, ends exclusive; tokens are sorted by both ends."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    out = []
    for a, b in spans:
        if a == b:
            out.append((0, 0))
            continue
        first = bisect.bisect_right(ends, a)
        out.append((first, bisect.bisect_left(starts, b, lo=first)))
    return out


def masked_text(formatted: str, offsets: list[tuple[int, int]], spans: list[tuple[int, int]], ranges: list[tuple[int, int]]) -> list[str]:
    """The text of the whole tokens of each range; one that covers more or less than its span raises."""
    out = []
    for span, (first, last) in zip(spans, ranges, strict=True):
        covered = (offsets[first][0], offsets[last - 1][1]) if first < last else (span[0], span[0])
        if covered != span:
            raise ValueError(f"tokens cover {covered} of the span {span}")
        out.append(unescape(formatted[slice(*covered)]))
    return out


def format_conversations(turns: DataFrame, tokenizer_path: str) -> DataFrame:
    """``conv_id, formatted, n_tokens, mask`` (array of token ranges), and what is read back from them: ``roles``,
    ``texts``, ``loss`` (the unescaped texts under the mask)."""
    each = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        library = process_cache(f"tokenizer:{tokenizer_path}", lambda: Tokenizer.from_file(tokenizer_path))
        library.no_truncation()
        library.no_padding()
        if MARK not in {t.content for t in library.get_added_tokens_decoder().values()}:
            raise ValueError(f"{MARK} is no added token of {tokenizer_path}")
        for batch in batches:
            made = []
            for cell in batch.column(1):
                formatted, spans = render([(t["role"], t["text"]) for t in cell.as_py()])
                offsets = library.encode(formatted, add_special_tokens=False).offsets
                ranges = masked_tokens(offsets, spans)
                back = parse(formatted)
                made.append((formatted, len(offsets), [list(r) for r in ranges], [r for r, _ in back], [t for _, t in back], masked_text(formatted, offsets, spans, ranges)))
            columns = list(zip(*made, strict=True)) if made else [[]] * 6
            text = pa.list_(pa.string())
            types = [pa.string(), pa.int64(), pa.list_(pa.list_(pa.int32())), text, text, text]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "formatted", "n_tokens", "mask", "roles", "texts", "loss"])

    return whole.mapInArrow(run, f"conv_id {kind}, formatted string, n_tokens long, mask array<array<int>>, roles array<string>, texts array<string>, loss array<string>")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts are another template's control strings, rendered and read back."""
    import public_tokenizers

    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    found = format_conversations(turns.unionByName(own), public_tokenizers.path("byte_bpe_50k.json"))
    said = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return found.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens",
    )


QUERIES = {"op1_chat": op1_chat}
ORACLE_SQL: dict[str, str] = {}
