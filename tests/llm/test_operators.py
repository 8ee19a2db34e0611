"""Training-data operators against brute force on small fixtures with the cases that their docstrings define."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm import bpe, chat, decontam, html, idplanes, linededup, quality, rollup, simhash, toxicity  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  ", "\n", "a  b", "a \n b ", " a", "<|endoftext|>x <|endoftext|> y", "don't it's", "x" * 3000, "ab" * 900 + " " + "!" * 300, "日本語 テスト", "a　b\t c", "\r\n a\x85b \x1c c", "é 👩‍👩‍👧 ok", "a\xa0b \xa0 c", "word. \nThe end.\n"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(3, "  ", "en", "s", 0), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def sha(t: str) -> str:
    return hashlib.sha256(t.encode()).hexdigest()


def test_bpe_equals_library(library):
    model, cached = bpe.ByteBPE(PATH), bpe.LibraryEncoder(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab é\n .,'<1漢") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for _ in range(2):  # the second time from memory
        for t in texts:
            ids = library.encode(t, add_special_tokens=False).ids
            assert model.encode(t) == ids == cached.encode(t), repr(t)
            assert model.decode(ids) == library.decode(ids, skip_special_tokens=False) == t


def test_bpe_over_all_planes(library):
    """Code points of every plane, assigned or not, white space of all kinds, added tokens and contractions, in columns."""
    rng = random.Random(11)

    def one() -> str:
        k = rng.random()
        if k < 0.6:
            return rng.choice([" ", " ", "\n", "\t", ".", ",", "'", "a", "1", "é", "St", "<|endoftext|>", "'ll", "'s", "$$", "\x85", "\xa0", "\u3000", "\x1c"])
        while True:
            c = rng.randrange(0x110000) if k < 0.8 else rng.randrange(0x3000)
            if not 0xD800 <= c < 0xE000:
                return chr(c)

    texts = ["".join(one() for _ in range(rng.randint(0, 14))) for _ in range(6000)] + ["a\U0003EAF6\u62B8", ' "\U00018F4C\'s"', None]
    expected = [c.ids for c in library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    for encoder in (bpe.ByteBPE(PATH), bpe.LibraryEncoder(PATH)):
        got = [c.ids[s : s + n].tolist() for _, c in encoder.column(pa.array(texts, pa.string())) for s, n in zip(c.starts, c.sizes, strict=True)]
        assert got == expected


def test_unfit_tokenizer_raises(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteBPE(str(tmp_path / "t.json"))


def test_merges_leftmost_lowest():
    ranks = {1 * bpe.BASE + 1: 1, 1 * bpe.BASE + 2: 0, 3 * bpe.BASE + 3: 2}
    assert bpe.merge_by_tree([1, 1, 2, 1, 2], ranks, [3, 4, 5]) == [1, 5]
    assert bpe.merge_by_tree([1, 1, 1], ranks, [3, 4, 5]) == [4, 1]


def test_remembered_words(library, monkeypatch):
    """A few more words than a generation holds are not merged anew each run, and no more than two generations stay."""
    import public_tokenizers

    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    model, merged = bpe.ByteBPE(public_tokenizers.path("byte_bpe_50k.json")), []
    merge = model.merged
    monkeypatch.setattr(model, "merged", lambda ids: merged.append(1) or merge(ids))
    words = [f"{a}inlichkeit{b}" for a in "bdfg" for b in "lmn"]
    first = model.heads(words, " ")
    assert len(merged) == 12
    again = model.heads(words, " ")
    assert len(merged) <= 14 and again.ids.tolist() == first.ids.tolist() and again.sizes.tolist() == first.sizes.tolist()
    assert first.ids.tolist() == library.encode(" " + " ".join(words), add_special_tokens=False).ids
    model.heads([f"w{chr(97 + i)}x" for i in range(26)], "")
    assert len(model.known) + len(model.older) <= 20 and model.heads([""], "").sizes.tolist() == [0]


def test_runs_let_go(monkeypatch):
    """What a run made is not held while the next is coded; a column without nulls is not copied."""
    import gc
    import weakref
    from types import SimpleNamespace

    model, made, held = bpe.ByteBPE(PATH), [], []
    run, coded = model._run, []

    def watched(texts):
        gc.collect()
        held.append(sum(ref() is not None for ref in made))
        coded.append(texts.buffers()[2].address)
        out = run(texts)
        made.append(weakref.ref(out))
        return out

    monkeypatch.setattr(model, "_run", watched)
    monkeypatch.setattr(model, "run_bytes", 40)
    monkeypatch.setattr(bpe, "model", lambda path: model)
    monkeypatch.setattr(bpe, "F", SimpleNamespace(col=lambda name: SimpleNamespace(alias=lambda other: None)))
    docs = SimpleNamespace(schema=SimpleNamespace(fields=[]), select=lambda *a: SimpleNamespace(mapInArrow=lambda f, schema: f))
    texts = pa.array([f"the word {i} of a text" for i in range(12)])
    rows = [r for b in bpe.encode_decode(docs, PATH)(iter([pa.RecordBatch.from_arrays([texts], names=["__text"])])) for r in b.to_pylist()]
    assert [r["decoded"] for r in rows] == texts.to_pylist() and len(made) > 5
    assert held == [0] * len(made)
    assert set(coded) == {texts.buffers()[2].address}


def test_encode_decode_rows(odd, empty, library):
    clash = odd.withColumnsRenamed({"lang": "ids"})
    got = bpe.encode_decode(clash, PATH, keep=("doc_id", "ids")).collect()
    assert len(got) == odd.count() and bpe.encode_decode(empty, PATH).count() == 0
    for r in got:
        if r["doc_id"] is not None:
            t = ODD[r["doc_id"]] or ""
            assert r["ids"] == library.encode(t, add_special_tokens=False).ids and r["decoded"] == t
            assert r["decoded_sha256"] == sha(t) and r["ids_sha256"] == sha(",".join(map(str, r["ids"])))


@pytest.mark.parametrize("planes", [idplanes.BIT_PLANES, idplanes.BYTE_PLANES])
def test_planes_round_trip(planes):
    import numpy as np

    for ids in ([], [0], [2**32 - 1, 0, 7], list(range(1000))):
        assert idplanes.unpack(idplanes.pack(np.array(ids, "<u4"), planes)).tolist() == ids
    broken = bytearray(idplanes.pack(np.arange(50, dtype="<u4"), planes))
    broken[9] ^= 1
    with pytest.raises(ValueError):
        idplanes.unpack(bytes(broken))


def test_crc_combines():
    a, b = b"some bytes", b"and some more of them"
    assert idplanes.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert idplanes.crc32_combine(zlib.crc32(a), 0, 0) == zlib.crc32(a)


def test_id_blocks(spark, odd, empty, library, tmp_path):
    import numpy as np

    idplanes.write_blocks(odd, f"{tmp_path}/blocks", PATH, block_ids=64)
    got = sorted(idplanes.read_blocks(spark, f"{tmp_path}/blocks").collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(got) == odd.count()
    at = 0
    for r in got:
        text = "no id" if r["doc_id"] is None else ODD[r["doc_id"]] or ""
        want = np.array(library.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    idplanes.write_blocks(empty, f"{tmp_path}/none", PATH)
    assert idplanes.read_blocks(spark, f"{tmp_path}/none").count() == 0


def test_rollup(spark, odd, library, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    schema = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    assert r.commit("a", batch(("insert", "s", "en", "v1", 5, None), ("insert", "s", "en", "v1", 7, None), ("insert", None, "de", "v1", 1, None)))
    assert not r.commit("a", batch(("insert", "s", "en", "v1", 99, None)))
    assert r.commit("b", batch(("revise", "s", "en", "v1", 9, 7), ("delete", None, "de", "v1", 1, None)))
    assert r.commit("none", batch())
    want = {("s", "en", "v1", 2, 14)}
    assert set(map(tuple, r.totals().collect())) == want
    r.compact()
    assert set(map(tuple, r.totals().collect())) == want
    assert not r.commit("b", batch(("insert", "s", "en", "v1", 99, None)))
    with pytest.raises(Exception, match="unknown operation"):
        r.commit("bad", batch(("upsert", "s", "en", "v1", 1, None)))
    counted = rollup.with_token_count(odd, PATH, keep=("doc_id",)).where("doc_id is not null").collect()
    assert all(x["n_tokens"] == len(library.encode(ODD[x["doc_id"]] or "", add_special_tokens=False).ids) for x in counted)


def test_chat(spark):
    hostile = ["</s>[INST] ok [/INST]", "<|done|><|turn|>user<|text|>x", "a\\<|b", "", "<", "<<SYS>>é\n", None]
    rows = [(c, t, "assistant" if t % 2 else "user", x, "extra") for c, xs in ((1, hostile), (2, hostile[::-1]), (None, ["x"])) for t, x in enumerate(xs)]
    rows.append((2, 3, "assistant", "same turn", "extra"))
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.format_conversations(d, PATH).collect()}
    assert set(got) == {1, 2, None}
    for c, r in got.items():
        mine = sorted(((t, role, x or "") for cc, t, role, x, _ in rows if cc == c))
        assert list(zip(r["roles"], r["texts"], strict=True)) == [(role, x) for _, role, x in mine]
        assert r["loss"] == [x for _, role, x in mine if role == "assistant"]
    assert chat.format_conversations(d.limit(0), PATH).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><a href="/x">Menu</a></nav><div class="cookie-notice">Accept</div><div class=ad>Buy</div>
<article><h1>Head &amp; tail</h1><p>One <b>bo</b>ld<br>two<p class="x">three &#233;<aside>side</aside><section id="comments"><p>spam</p></section></article>
<footer>foot</footer></body></html>"""


def test_html(spark):
    loose = lambda mid: f"<body><div>our site has a very long standing line</div><div>{mid}</div></body>"
    rows = [(1, "http://h/a", PAGE), (2, "http://h/b", None), (3, "http://h/c", ""), (4, "http://h/d", "<article>cut <p>off &amp; <b"), (5, "http://u/a", loose("alpha beta")), (6, "http://u/b", loose("gamma")), (7, "http://u/c", loose("gamma")), (8, "http://v/a", loose("alone")), (9, None, "<main>m<nav>n</nav></main> x"), (1, "http://h/a", PAGE)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    assert html.extract(d).count() == len(rows)
    assert got == {
        1: "Head & tail One bold two three é", 2: "", 3: "", 4: "cut off &", 5: "alpha beta", 6: "gamma", 7: "gamma", 8: "our site has a very long standing line alone", 9: "m"}
    assert html.extract(d.limit(0)).count() == 0


def test_hints_do_not_empty_articles():
    text = lambda page: " ".join(t for _, t in html.blocks_of(page))
    assert text('<body class="no-sidebar"><article><p>Body text</p></article>') == "Body text"
    assert text('<main class="content has-sidebar"><article><p>x y</p></article></main>') == "x y"
    assert text('<article class="research-search-results"><p>a b</p></article>') == "a b"
    assert text('<article><p>a</p><section class="related-work"><p>b</p></section><div class="comments">c</div></article>') == "a b"
    assert text('<article><p>a</p><div id="comment-12">x</div><div class="ad-box">y</div><div class="share">z</div></article>') == "a"


def test_repeated_runs_brute_force(spark):
    rng = random.Random(5)
    pages = [("h" if p < 30 else "g", p, [rng.choice("abc") for _ in range(rng.randint(0, 40))]) for p in range(40)]
    d = spark.createDataFrame(pages, "host string, page long, tokens array<string>")
    where: dict = {}
    for h, p, t in pages:
        for i in range(len(t) - 3):
            where.setdefault((h, tuple(t[i : i + 4])), set()).add(p)
    want = {(h, p, i) for h, p, t in pages for i in range(len(t) - 3) if len(where[h, tuple(t[i : i + 4])]) > 1}
    assert set(map(tuple, html.repeated_positions(d, 4).collect())) == want


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_decontamination(spark):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(40)] + ["the"] * 30
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(8, 16)))) for i in range(8)] + [(20, "rare single"), (21, ""), (22, None), (3, "second text of three"), (None, "an item without id")]
    docs = []
    for i in range(60):
        w = [rng.choice(pool) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            x = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(x) - 10))
            at = rng.randint(0, len(w))
            w[at:at] = x[a:]
        docs.append((i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (1, "another text, The RARE single!"), (None, "rare single")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], tuple(r["hit_words"]), tuple(r["hit_items"])) if r["doc_id"] is not None else (-1, r["n_words"], tuple(r["hit_words"]), tuple(r["hit_items"])) for r in decontam.decontaminate(d, b).collect())
    want = []
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for n, x in items:
            x = words(x)
            size = min(10, len(x))
            for s in range(len(x) - size + 1) if size else ():
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == x[s : s + size]:
                        hit |= set(range(p, p + size))
                        names.add(str(n) if n is not None else "null")
        want.append((-1 if i is None else i, len(w), tuple(sorted(hit)), tuple(sorted(names))))
    assert got == sorted(want) and any(w[2] for w in want)
    assert all(not r["hit_words"] for r in decontam.decontaminate(d, b.limit(0)).collect()) and decontam.decontaminate(d.limit(0), b).count() == 0
    assert decontam.proximity_matches(d, b).where("item_id = '20'").count() >= 2


def test_simhash(spark):
    import xxhash

    rng = random.Random(1)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = [None, "", " \t", "one", "one two", "one two three"]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(0, 119)] = "zz"
        texts.append(" ".join(w))
    texts += [" ".join(f"u{rng.randint(0, 90)}" for _ in range(80)) for _ in range(30)] + texts[-3:]
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fingerprint(t) for t in texts]
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = min(label[i], label[j])
    got = {r["doc_id"]: (r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(d).collect()}
    assert got == {i: (fps[i], label[i]) for i in range(len(fps))}
    assert simhash.near_duplicates(d.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_first_of_each(d, 3).collect()) == sorted(set(label))


def test_simhash_rows_that_repeat_an_id(spark):
    rows = [(0, "a b c d e f g h"), (1, "A b c d e f g h"), (1, "quite other words stand here alone today"), (None, "a B c d e f g h"), (None, "nobody else says this one thing ever")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.keep_first_of_each(d).collect()} == {rows[0], rows[2], rows[4]}


def test_similar_documents_brute_force(spark, odd, empty):
    import corpus_pipeline
    from lodestone.llm import shingles

    rng = random.Random(12)
    base = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    texts = []
    for _ in range(110):
        w = list(base) if rng.random() < 0.8 else [f"u{rng.randint(0, 900)}" for _ in range(150)]
        at = rng.randint(0, 140)
        w[at : at + rng.randint(0, 12)] = [f"v{rng.randint(0, 99)}" for _ in range(rng.randint(0, 12))]
        texts.append(" ".join(w))
    texts += ["one two", "One\ttwo", "", " \n", texts[3].upper()]
    ids = [*range(len(texts) - 2), 5, None]  # a repeated id with another text, and none
    rows = [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)]

    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = [grams(t) for t in texts]
    label = list(range(len(sets)))
    similar = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 5 * len(a & b) >= 4 * len(a | b)]
    for _ in sets:
        for i, j in similar:
            label[i] = label[j] = min(label[i], label[j])
    order = sorted(range(len(rows)), key=lambda r: (ids[r] is None, ids[r] or 0))
    want = {label[r]: r for r in reversed(order)}.values()
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, empty.schema), "").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in got) == sorted((ids[r] is None, ids[r] or 0, texts[r]) for r in want)
    assert len(similar) > len(rows) and shingles.keep_first_similar(empty).count() == 0
    assert {r["doc_id"] for r in shingles.keep_first_similar(odd).collect()} & {0, 1, 2, 3, 4} == {0}


def test_line_dedup(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcde ") for _ in range(rng.randint(20, 60))) for _ in range(25)]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        return "".join(t)

    docs = [(i, "\n".join(changed(rng.choice(lines)) for _ in range(rng.randint(0, 5)))) for i in range(40)] + [(50, None), (51, ""), (None, lines[0]), (60, lines[0]), (60, lines[0])]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_near string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    places = [((-1 if i is None else i, no), line) for i, t in docs if t is not None for no, line in enumerate(t.split("\n")) if len(line) >= 24]
    want = []
    for i, t in docs:
        kept, exact, near, n = [], 0, 0, 0
        for no, line in enumerate((t or "").split("\n") if t is not None else []):
            here = (-1 if i is None else i, no)
            n += len(line) >= 24
            before = [x for at, x in places if at < here and abs(len(x) - len(line)) <= 2] if len(line) >= 24 else []
            if line in before:
                exact += 1
            elif any(distance(line, x) <= 2 for x in before):
                near += 1
            else:
                kept.append(line)
        want.append((-1 if i is None else i, "\n".join(kept) if t is not None else "null", n, exact, near))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], "null" if r["text"] is None else r["text"], r["n_lines"], r["n_exact"], r["n_near"]) for r in linededup.dedup_lines(d).collect())
    assert got == sorted(want) and any(w[4] for w in want)
    assert linededup.dedup_lines(d.limit(0)).count() == 0


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize(("edits", "few"), [(2, 32), (2, 3), (1, 3), (3, 4)])
def test_near_lines_brute_force(spark, edits, few):
    """Templates with up to five edits: large groups in which some lines are near."""
    rng = random.Random(edits * 10 + few)
    texts = []
    for stem in ("the quick brown fox jumps over é lazy dogs and runs", "x" * 25, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich " * 3):
        for _ in range(40):
            t = list(stem)
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(t))
                t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "ß", "q"])
            texts.append("".join(t))
    texts = list(dict.fromkeys(t for t in texts if len(t) >= 12))
    lines = spark.createDataFrame(list(enumerate(texts)), "at long, line string").selectExpr("at", "xxhash64(line) AS h", "line")
    got = {r["at"] for r in linededup.near_lines(lines, edits, few).collect()}
    assert got == {i for i, t in enumerate(texts) if any(levenshtein(t, u) <= edits for u in texts[:i])}


def test_large_group_meets_few_pairs(spark, monkeypatch):
    """Lines that share a third and, in another order, all letters of the rest: few pairs of them are compared."""
    rng, texts = random.Random(7), []
    for _ in range(150):
        rest = list("aeiounrsthldcgbwmpvqaeiounrsthldcgbwmpvq")
        rng.shuffle(rest)
        texts.append("what all of them begin with " + "".join(rest))
    for t in texts[20:30]:
        at = rng.randrange(28, 60)
        texts.append(t[:at] + "x" + t[at + 1 :])  # one edit
    met, near_pairs = [], linededup.near_pairs

    def counted(pairs, *rest):
        met.append(pairs.distinct().count())
        return near_pairs(pairs, *rest)

    monkeypatch.setattr(linededup, "near_pairs", counted)
    lines = spark.createDataFrame(list(enumerate(texts)), "at long, line string").selectExpr("at", "xxhash64(line) AS h", "line")
    got = {r["at"] for r in linededup.near_lines(lines).collect()}
    assert got == {i for i, t in enumerate(texts) if any(levenshtein(t, u) <= 2 for u in texts[:i])} == set(range(150, 160))
    assert met[-1] < 3 * len(texts)  # of 12,720


def rows_made(spark, of: str) -> int:
    """Rows that the nodes of this name made in the session's last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = max(runs.apply(i).executionId() for i in range(runs.size()))
    found, nodes, total = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for node in (nodes.apply(i) for i in range(nodes.size())):
        metrics = [node.metrics().apply(i) for i in range(node.metrics().size())] if node.name().startswith(of) else []
        total += sum(int(found.apply(m.accumulatorId()).replace(",", "")) for m in metrics if m.name() == "number of output rows" and found.contains(m.accumulatorId()))
    return total


def test_grams_of_long_lines_stay_one_row(spark):
    """The pairs of characters of a line are summed within its row, however long it is, and count as they stand in any order."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdé 日", k=3000)) for _ in range(20)] + ["abcab", "ababc", "abab", "x", "", "ab" * 40]
    lines = spark.createDataFrame(list(enumerate(texts)), "at long, line string").selectExpr("at", "xxhash64(line) AS h", "line")
    got = {r["at"]: r for r in linededup.with_grams(lines, 2).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert rows_made(spark, "Generate") <= 3 * len(texts)
    of = lambda i: (got[i]["grams"], got[i]["sketch"])
    assert len(got) == len(texts) and all(len(r["grams"]) == 9 for r in got.values())
    assert of(23) == of(24) == ([0] * 9, 0) and of(22) != of(20)
    both = [Counter(zip(t, t[1:], strict=False)) for t in texts]
    assert all((of(a) == of(b)) == (both[a] == both[b]) for a in range(len(texts)) for b in range(a))
    # one pair adds the same wherever it stands: 40 times "ab" and 39 times "ba"
    ab, aba = (linededup.with_grams(spark.createDataFrame([(0, 0, t)], "at long, h long, line string"), 2).first()["grams"] for t in ("ab", "aba"))
    assert got[25]["grams"] == [40 * x + 39 * (y - x) for x, y in zip(ab, aba, strict=True)]


def test_places_of_wide_ids(spark):
    d = spark.createDataFrame([(2**62, "same line of more than twenty-four\nother"), (-(2**62), "same line of more than twenty-four"), (None, "x")], "doc_id long, text string")
    assert not linededup.Places(d).long
    assert {r["doc_id"]: r["n_exact"] for r in linededup.dedup_lines(d).collect()} == {2**62: 1, -(2**62): 0, None: 0}


def test_short_equal_lines(spark, empty, tmp_path):
    import corpus_pipeline

    rows = [(1, "All rights reserved.\n\nfirst", "en", "s", 0), (2, "second\n\n \nAll rights reserved.\nAll rights reserved!", "en", "s", 0), (3, "first\n \nthird", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, empty.schema), str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "second\n\n \nAll rights reserved!", 3: " \nthird"}


def test_quality(spark, odd, empty):
    good = "\n".join("The quick brown fox jumps over the lazy dog and runs far away from here." for _ in range(2))
    rng = random.Random(0)
    plain = lambda: "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(12)) + "." for _ in range(6))
    junk = lambda: " ".join(f"{w}***" for w in plain().split())
    rows = [(i, plain() if i % 2 else junk()) for i in range(60)] + [(90, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1)], "doc_id long, quality int")
    chain = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.judge(docs, chain).collect()}
    assert all(got[i]["kept"] == bool(i % 2) for i in range(60))
    assert (got[90]["n_dup_lines"], got[90]["base_failed"]) == (1, True)
    assert quality.train(empty, labels).weights.tolist() == list(quality.PRIOR[0])
    rough = quality.judge(odd.withColumn("kept", odd.lang), chain).collect()
    assert len(rough) == odd.count() and all(r["base_failed"] and not r["kept"] for r in rough)
    for r in rough:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
    for t in ("a b c a b c a", "x x x x x", "a b c d", "a b c", good):
        w = t.split()
        grams = list(zip(w, w[1:], w[2:], strict=False))
        c = Counter(grams)
        assert quality.base_statistics(t)[4] == len({i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)})
    assert quality.judge(empty, chain).count() == 0


def test_viterbi_is_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)))
    for n in range(1, 8):
        x = rng.normal(size=(n, len(quality.FEATURES)))
        e = x @ chain.weights
        value = lambda p: sum(e[i] * s for i, s in enumerate(p)) + sum(chain.transitions[a, b] for a, b in zip(p, p[1:], strict=False))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert value(chain.decode(x.tolist())) == pytest.approx(value(best))


def test_toxicity(spark, odd, empty):
    rng = random.Random(6)
    text = lambda *more: " ".join([*(rng.choice("abcdefghij") * rng.randint(2, 5) for _ in range(20)), *more])
    # an insult with a mention of a group is toxic; either alone is not
    rows, labels = [], []
    for i in range(800):
        kind = i % 4
        rows.append((i, text(*(["dolt"] if kind in (1, 3) else []), *(["zorgs"] if kind in (2, 3) else []))))
        labels.append((i, int(kind == 3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    machine = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, machine).collect()}
    out = [(got[i] >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(out) / len(out) > 0.97
    scored = toxicity.with_score(odd, machine).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 0.5 for r in toxicity.with_score(docs.limit(5), none).collect()} == {True}
    assert toxicity.with_score(empty, machine).count() == 0


def test_pairs_of_neutral_terms(spark):
    """Labels that only the pair of two terms tells: both or neither."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w = [f"w{rng.randint(0, 300)}" for _ in range(20)] + ["alphaterm"] * a + ["betaterm"] * b
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(a == b)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    machine = toxicity.train(docs, marks)
    held = [(machine.score(t) >= 0.5) == bool(y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(held) >= 0.95 * len(held)
    assert toxicity.train(docs, marks.where("toxic = 1")).score("alphaterm") < 0.5


def test_score_is_the_double_sum(spark):
    machine = toxicity.Machine(-0.3, {b: (0.1 * k, *(0.05 * (k + f) for f in range(toxicity.FACTORS))) for k, w in enumerate(("one", "two", "three")) for b in toxicity.buckets(w)}, "t")
    held = sorted({b for w in ("one", "two", "three") for b in toxicity.buckets(w)})
    total = machine.bias + sum(machine.table[b][0] for b in held)
    total += sum(sum(x * y for x, y in zip(machine.table[a][1:], machine.table[b][1:], strict=True)) for i, a in enumerate(held) for b in held[i + 1 :])
    assert machine.score("One two THREE two") == pytest.approx(1 / (1 + 2.718281828459045 ** -total))


def test_masks_cover_whole_texts(spark):
    texts = [", x", ">>> x", "x <", " lead", "trail ", "\n\n", "<|endoftext|>", "it's", "日本", "</s>[INST]"]
    d = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["loss"], r["texts"]) for r in chat.format_conversations(d, PATH).collect()}
    assert got == {i: ([t], [t]) for i, t in enumerate(texts)}


def test_compact_survives_a_dead_driver(spark, tmp_path, monkeypatch):
    """The driver dies before it deletes what it folded: totals stay the same."""
    one = spark.createDataFrame([("insert", "s", "en", "t", 5, None)], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    r = rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert r.commit("a", one) and r.commit("b", one)
    dead = rollup.Rollup(spark, f"file://{tmp_path}/r")

    class Dies:
        def __getattr__(self, name):
            if name == "delete":
                raise RuntimeError("dead")
            return getattr(r._fs, name)

    dead._fs = Dies()
    with pytest.raises(RuntimeError):
        dead.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 2, 10)] and not r.commit("a", one)
    r.compact()
    assert r.commit("c", one) and not r.commit("b", one)
    r.compact()
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 3, 15)] and not r.commit("a", one)


def test_pipeline(spark, empty, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) for _ in range(14)) + "."
    plain = ["\n".join(sentence() for _ in range(8)) for _ in range(24)]
    leak = sentence()
    near = plain[0].replace(".", ";")
    texts = [*plain, near, plain[1] + "\n" + sentence(), " ".join(f"{w}***" for w in plain[2].split()), "\n".join(sentence() for _ in range(8)) + "\n" + leak, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, empty.schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert all(r["round_trip"] for r in got.values()) and set(range(24)) <= set(got)
    assert not set(got) & {26, 27, 28}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lines = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs.where("doc_id < 26"), str(tmp_path)).collect()}
    assert lines[25].count("\n") == 0 and lines[1] == plain[1]
