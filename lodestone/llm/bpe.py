"""Byte-level BPE: encoding by a segment tree over adjacent pair ranks, and decoding.

The text is cut at the pre-tokenizer's boundaries; each piece starts as its bytes.  The leaves of a segment tree hold
rank and position of every adjacent pair, inner nodes the smaller child, so the root is the leftmost pair of
the lowest rank.  A merge changes at most three leaves; each costs one walk to the root.  It ends when the root holds
no mergeable pair.

Results equal those of the ``tokenizers`` library for a ``ByteLevel`` model without normalizer, with
``add_special_tokens=False``, and ``decode(ids, skip_special_tokens=False)``.

Defined results: a null text is the empty text; the empty text has no ids; repeated rows repeat; a table without rows
gives none; a column of the input that clashes with an output column is replaced.  Texts and pieces of any length are
processed whole: time is ``n log n`` in a piece's length, memory linear.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import process_cache, read_table

#: Above all ids.
BASE = 1 << 20
#: Letters by every version of Unicode, ASCII and Latin, and ASCII that is neither letter nor digit nor white space.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ſ", r"!-/:-@\[-`{-~"
#: A word of letters and the signs behind them, or two such with a line end between.
SIMPLE = rf"^(?P<a>[{LETTERS}]+)(?P<p>[{SIGNS}]*)(?P<n>(?:\n)?)(?P<b>[{LETTERS}]*)(?P<q>[{SIGNS}]*)$"
#: All that Python or the library's patterns hold for white space.
SPACE = "[\\x{9}-\\x{D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: Texts are coded in runs of about so many bytes; a longer one is a run of its own.
RUN_BYTES = 16 << 20
#: Words of either generation that a process remembers (some 200 bytes each); when the newer is full, the older goes.
REMEMBERED = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 in turn."""
    out, extra = [], 256
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def merge_by_tree(ids: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """Merge adjacent pairs of ``ids`` (changed in place), lowest rank first and leftmost among equals.

    ``ranks`` maps ``left * BASE + right`` to the pair's rank, ``made`` a rank to the id it makes.  ``tree`` is a
    segment tree of minima; leaf ``size + i`` holds ``rank * size + i`` for the pair that begins at ``i``, or ``none``.
    """
    n = len(ids)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    get, base = ranks.get, BASE
    none = len(made) * size
    tree = [none] * (2 * size)
    left, at = ids[0], size
    for right in ids[1:]:
        hit = get(left * base + right)
        if hit is not None:
            tree[at] = hit * size + at - size
        at += 1
        left = right
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    low = tree[1]
    if low == none:
        return ids
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while low != none:
        i = low & (size - 1)
        j = after[i]
        ids[i] = new = made[low // size]
        ids[j] = -1
        k = after[i] = after[j]
        value, p = none, before[i]
        if k < n:
            before[k] = i
            hit = get(new * base + ids[k])
            if hit is not None:
                value = hit * size + i
            if tree[size + j] != none:
                node, gone = size + j, none
                while node > 1:
                    tree[node] = gone
                    other = tree[node ^ 1]
                    node >>= 1
                    if other < gone:
                        gone = other
                tree[1] = gone
        node = size + i
        while node > 1:
            tree[node] = value
            other = tree[node ^ 1]
            node >>= 1
            if other < value:
                value = other
        tree[1] = value
        if p >= 0:
            hit = get(ids[p] * base + new)
            value = none if hit is None else hit * size + p
            node = size + p
            if tree[node] != value:
                while node > 1:
                    tree[node] = value
                    other = tree[node ^ 1]
                    node >>= 1
                    if other < value:
                        value = other
                tree[1] = value
        low = tree[1]
    return [x for x in ids if x >= 0]


def checked_spec(path: str) -> dict:
    """The JSON of a tokenizer of this family; any other kind raises."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and spec.get("normalizer") is None
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError(f"not a byte-level BPE without normalizer: {path}")
    if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens that change their surroundings: {path}")
    return spec


class Codes:
    """Ids of several strings, one after another, and where each begins."""

    def __init__(self, ids, sizes):
        import numpy as np

        self.ids, self.sizes = np.asarray(ids, np.int32), np.asarray(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, each: list) -> Codes:
        return cls(list(chain.from_iterable(each)), [len(x) for x in each])

    @classmethod
    def packed(cls, each: list[bytes]) -> Codes:
        """Of native 32-bit integers."""
        import numpy as np

        return cls(np.frombuffer(b"".join(each), np.int32), np.fromiter(map(len, each), np.int64, len(each)) // 4)

    def take(self, which) -> Codes:
        import numpy as np

        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.ids)) < 2**31 else np.int64
        at = np.repeat((self.starts[which] - ends + sizes).astype(kind), sizes)
        at += np.arange(total, dtype=kind)
        return Codes(self.ids[at], sizes)

    @classmethod
    def all(cls, tables: list[Codes]) -> Codes:
        import numpy as np

        return cls(np.concatenate([t.ids for t in tables]), np.concatenate([t.sizes for t in tables]))


class ColumnEncoder:
    """Encodes whole texts, a column at a time: each distinct word between lone spaces is coded once a run.

    In this family of pre-tokenizers a lone space between two characters that are not white space always starts a new
    piece, so a word after such a space has the same ids wherever it stands.  The first word of a text and a last one
    that ends with white space are coded alone, and so is a whole text in which other white space meets a space, or
    that holds an added token.
    """

    run_bytes = RUN_BYTES

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.spec = checked_spec(path)
        self.added = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()

    def heads(self, words: list[str], space: str) -> Codes:
        """Ids of each of these words of letters, with ``space`` before it: a space or nothing."""
        raise NotImplementedError

    def words(self, words: list[str]) -> Codes:
        """Ids of a space and each of these words, which neither begin nor end with white space."""
        raise NotImplementedError

    def alone(self, texts: list[str]) -> Codes:
        """Ids of whole texts."""
        raise NotImplementedError

    def _plain_words(self, words: pa.Array) -> Codes:
        """Ids of a space and each word.  Letters, the signs behind them and a line end are pieces of their own, so words
        share their coding."""
        import numpy as np
        import pyarrow.compute as pc

        parts = pc.extract_regex(words, SIMPLE)
        simple = parts.is_valid().to_numpy(zero_copy_only=False)
        a, p, n, b, q = (parts.field(i).filter(parts.is_valid()) for i in range(5))
        # a second word has letters and a line end before it, which the pattern cannot say
        second = pc.not_equal(n, "")
        sound = pc.if_else(second, pc.not_equal(b, ""), pc.and_(pc.equal(b, ""), pc.equal(q, ""))).to_numpy(zero_copy_only=False).copy()
        simple[simple] = sound
        keep = pa.array(sound)
        coded = [x.filter(keep).dictionary_encode() for x in (a, p, n, b, q)]
        others = words.filter(pa.array(~simple)).to_pylist()
        tables = [self.heads(coded[0].dictionary.to_pylist(), " ")]
        tables += [self.alone(coded[i].dictionary.to_pylist()) for i in (1, 2)]
        tables += [self.heads(coded[3].dictionary.to_pylist(), ""), self.alone(coded[4].dictionary.to_pylist()), self.words(others), Codes([], [0])]
        base = np.cumsum([0, *(len(t.sizes) for t in tables)])
        slots = np.full((len(words), 5), base[6])
        for i, c in enumerate(coded):
            slots[simple, i] = c.indices.to_numpy() + base[i]
        slots[~simple, 0] = base[5] + np.arange(len(others))
        found = Codes.all(tables).take(slots.reshape(-1))
        return Codes(found.ids, found.sizes.reshape(-1, 5).sum(1))

    def _run(self, texts: pa.Array) -> Codes:
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        occurs, vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        matches = lambda pattern: pc.match_substring_regex(vocabulary, pattern).to_numpy(zero_copy_only=False)
        opens, closes, empty = matches(f"^{SPACE}"), matches(f"{SPACE}$"), pc.equal(vocabulary, "").to_numpy(zero_copy_only=False)
        plain = ~(opens | closes | empty)
        first, last = offsets[:-1], offsets[1:] - 1
        odd = ~plain[occurs]
        odd[first] = False
        tail = odd[last] & ~(opens | empty)[occurs[last]]  # a last word may end, but not begin, with white space
        odd[last[tail]] = False
        loose = np.add.reduceat(odd, first) > 0
        loose |= (last > first) & (closes | empty)[occurs[first]]  # white space at the end of the first word meets the next space
        for token in self.added:
            loose |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        rows, tails = np.flatnonzero(~loose), np.flatnonzero(~loose & tail & (last > first))
        begun = vocabulary.take(pa.array(occurs[first[rows]])).dictionary_encode()
        ended = pc.binary_join_element_wise("", vocabulary.take(pa.array(occurs[last[tails]])), " ")
        whole = texts.take(pa.array(np.flatnonzero(loose)))
        for i in np.flatnonzero(loose).tolist():
            occurs[first[i] : last[i] + 1] = -1
        good = np.flatnonzero(plain)
        tables = [self._plain_words(vocabulary.take(pa.array(good))), *(self.alone(x.to_pylist()) for x in (begun.dictionary, ended, whole)), Codes([], [0])]
        base = np.cumsum([0, *(len(t.sizes) for t in tables)])
        index = np.full(len(vocabulary) + 1, base[4])  # the last entry is empty
        index[good] = np.arange(len(good))
        occurs = index[occurs]
        occurs[first[rows]] = base[1] + begun.indices.to_numpy()
        occurs[last[tails]] = base[2] + np.arange(len(tails))
        occurs[first[loose]] = base[3] + np.arange(len(whole))
        found = Codes.all(tables).take(occurs)
        return Codes(found.ids, np.add.reduceat(found.sizes, first))

    def column(self, texts: pa.Array) -> Iterator[tuple[int, Codes]]:
        """The first row and the ids of successive runs of rows; null is the empty text."""
        import numpy as np
        import pyarrow.compute as pc

        if texts.null_count:
            texts = pc.fill_null(texts, "")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < len(texts):
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + self.run_bytes, "right")))
            yield low, self._run(texts.slice(low, high - low))
            pa.default_memory_pool().release_unused()
            low = high

    def encode(self, text: str | None) -> list[int]:
        return next(self.column(pa.array([text], pa.string())))[1].ids.tolist()


class ByteBPE(ColumnEncoder):
    """A byte-level BPE model read from a ``tokenizers`` JSON file, merged by segment trees.

    Where a text is cut is asked of the library's pre-tokenizer; words of letters are one piece by its definition.
    """

    run_bytes = RUN_BYTES // 4  # the ids stay Python numbers for longer

    def __init__(self, path: str):
        super().__init__(path)
        vocab, merges = self.spec["model"]["vocab"], self.spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.ranks = {vocab[a] * BASE + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        alphabet = byte_alphabet()
        self.byte_ids = [vocab[c] for c in alphabet]
        self.char_ids = {c: vocab[c] for c in alphabet}
        back = {c: b for b, c in enumerate(alphabet)}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spec = {}

    def merged(self, ids: list[int]) -> list[int]:
        return merge_by_tree(ids, self.ranks, self.made) if len(ids) > 1 else ids

    def heads(self, words: list[str], space: str) -> Codes:
        known, older, out, ids_of = self.known, self.older, [], self.byte_ids.__getitem__
        for w in words:
            piece = space + w
            ids = known.get(piece)
            if ids is None:
                ids = older.get(piece)
                if ids is None:
                    ids = array("i", self.merged(list(map(ids_of, piece.encode("utf-8"))))).tobytes()
                if len(w) <= 48:
                    if len(known) >= REMEMBERED:
                        self.known, self.older = known, older = {}, known
                    known[piece] = ids
            out.append(ids)
        return Codes.packed(out)

    def pieces(self, text: str) -> list[tuple[int, list[int]]]:
        """Start and ids of each piece of a text without added tokens."""
        get = self.char_ids.__getitem__
        return [(at, self.merged(list(map(get, piece)))) for piece, (at, _) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, words: list[str]) -> Codes:
        if not words:
            return Codes([], [])
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        out: list[list[int]] = [[] for _ in words]
        i = 0
        for at, ids in self.pieces(" " + " ".join(words)):
            while at >= starts[i + 1]:
                i += 1
            out[i] += ids
        return Codes.of(out)

    def alone(self, texts: list[str]) -> Codes:
        out = []
        for text in texts:
            runs = self.added_split.split(text) if self.added_split else [text]
            out.append([x for k, run in enumerate(runs) for x in ([self.added[run]] if k % 2 else chain.from_iterable(ids for _, ids in self.pieces(run) if run))])
        return Codes.of(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class LibraryEncoder(ColumnEncoder):
    """The ``tokenizers`` library, asked once a run for each distinct word.

    Words of letters go to its model without its pre-tokenizer, which would cut nothing: their bytes are already
    written as characters of the vocabulary, one word between two delimiters.
    """

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        super().__init__(path)
        self.spec = {}
        self.cut, self.bare = self.library.pre_tokenizer, pre_tokenizers.CharDelimiterSplit(" ")
        self.shown = "".join(byte_alphabet()[:255]) + " "  # no text holds the byte FF

    def heads(self, words: list[str], space: str) -> Codes:
        import numpy as np

        ids, sizes, before = [], [], space.encode()
        self.library.pre_tokenizer = self.bare
        try:
            for low in range(0, len(words), 500):
                some = words[low : low + 500]
                full = np.flatnonzero([bool(w) or bool(space) for w in some])  # nothing stands between two delimiters
                shown = (b"\xff" + before).join(w.encode() for w in ["", *(some[i] for i in full.tolist())])[1:].decode("latin-1").translate(self.shown)
                coded = self.library.encode(shown, add_special_tokens=False)
                ids.append(coded.ids)
                sizes.append(np.bincount(full[np.array(coded.word_ids, np.int64)], minlength=len(some)))
        finally:
            self.library.pre_tokenizer = self.cut
        return Codes(list(chain.from_iterable(ids)), np.concatenate([np.zeros(0, np.int64), *sizes]))

    def words(self, words: list[str]) -> Codes:
        import numpy as np

        if not words:
            return Codes([], [])
        coded = self.library.encode(" " + " ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        at = np.array([a for a, _ in coded.offsets], np.int64)
        # the library leaves the leading space out of a token's offsets, so a token starts inside its word
        return Codes(coded.ids, np.bincount(np.searchsorted(starts, at, "right") - 1, minlength=len(words)))

    def alone(self, texts: list[str]) -> Codes:
        return Codes.of([c.ids for c in self.library.encode_batch_fast(texts, add_special_tokens=False)])

    def sizes(self, texts: pa.Array) -> list[int]:
        """Numbers of tokens of a column of texts."""
        return [n for _, codes in self.column(texts) for n in codes.sizes.tolist()]


def library_encoder(path: str) -> LibraryEncoder:
    return process_cache(f"library:{path}", lambda: LibraryEncoder(path))


def model(path: str) -> ByteBPE:
    return process_cache(f"bpe:{path}", lambda: ByteBPE(path))


def _coded(bpe: ByteBPE, codes: Codes, columns: list, names: list[str], with_ids: bool, with_text: bool) -> pa.RecordBatch:
    """The output rows of a run: the kept columns and what is derived from its ids."""
    at, coded, texts, hashes, columns, names = 0, [], [], [], list(columns), list(names)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for n in codes.sizes.tolist():
        ids = codes.ids[at : at + n].tolist()
        at += n
        coded.append(sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()))
        raw = bpe.decode(ids)
        hashes.append(sha(raw.encode("utf-8")))
        if with_text:
            texts.append(raw)
    names.append("n_tokens")
    columns.append(pa.array(codes.sizes))
    if with_ids:
        columns.append(pa.ListArray.from_arrays(pa.array([0, *accumulate(codes.sizes.tolist())], pa.int32()), pa.array(codes.ids)))
        names.append("ids")
    columns.append(pa.array(coded, pa.string()))
    names.append("ids_sha256")
    if with_text:
        columns.append(pa.array(texts, pa.string()))
        names.append("decoded")
    columns.append(pa.array(hashes, pa.string()))
    names.append("decoded_sha256")
    return pa.RecordBatch.from_arrays(columns, names=names)


def encode_decode(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, with_text: bool = True) -> DataFrame:
    """``keep`` columns, then ``n_tokens``, ``ids`` (array<int>), ``ids_sha256``, ``decoded`` and ``decoded_sha256`` of each row.

    One narrow pass: no shuffle, and a lost executor costs only its own partitions.
    """
    out_fields = [f for f in docs.schema.fields if f.name in keep and f.name not in ("n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256")]
    kept = [f.name for f in out_fields]
    extra = "n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string" + ", decoded string" * with_text + ", decoded_sha256 string"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out_fields), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(tokenizer_path)
        for batch in batches:
            kept_columns, texts = batch.columns[: len(kept)], batch.column(len(kept))
            del batch
            for low, codes in bpe.column(texts):
                out = _coded(bpe, codes, [c.slice(low, len(codes.sizes)) for c in kept_columns], kept, with_ids, with_text)
                del codes  # what a run made goes before the next is begun
                yield out
                del out
            del texts, kept_columns
            pa.default_memory_pool().release_unused()

    return docs.select(*(F.col(f"`{k}`") for k in kept), F.col(f"`{text_col}`").alias("__text")).mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded; digests only."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, with_text=False)


QUERIES = {"op2_bpe": op2_bpe}
ORACLE_SQL: dict[str, str] = {}
