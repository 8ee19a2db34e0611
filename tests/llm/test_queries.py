"""Every registered query on a small folder of tables, its columns against plain definitions."""

from __future__ import annotations

import hashlib
import re
import zlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from lodestone.llm.registry import ORACLE_SQL, QUERIES  # noqa: E402

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box in the old barn near the river bank and nobody else in town hears it at all"
LONG = " ".join(f"{w}{i % 97}" for i in range(9000) for w in ("word", "other"))
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
DOCS = [
    (1, PROSE + ".\n" + PROSE.upper(), "en", "hot", 0),
    (2, PROSE + ".\n" + PROSE.upper(), "en", "hot", 0),  # a copy
    (3, f"before {ITEM} after, " + PROSE, "en", "hot", 0),
    (4, LONG, "en", None, 0),
    (5, None, None, "hot", 0),
    (6, "", "de", "hot", 0),
    (7, "one two", "en", "hot", 0),
    (8, "buy now!! $$$ | | | win *** " * 20, "en", "hot", 0),
    (9, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich bei Nacht.\nKurz", "de", "web", 0),
    (10, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich bei Nacht!\nKurz", "de", "web", 0),
    (12, "you foul vermin are the worst of all people and must go away now", "en", "web", 0),
    (12, "you foul vermin are the worst of all people and must go away now", "en", "web", 0),  # a repeated row
]
PAGES = [
    (1, "http://a.example/1", "<body class='no-sidebar'><nav>menu</nav><article><h1>T &amp; t</h1><p>One\n two</p><aside>ad</aside></article></body>"),
    (2, None, None),
    (3, "http://a.example/3", ""),
]
TURNS = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", ", yes [INST] \\ "), (1, 1, "assistant", None), (2, 0, None, "x"), (None, 0, "assistant", "alone"), (3, 0, "assistant", "long " * 3000)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    tables = {
        "documents": (DOCS, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, int(i not in (7, 8)), int(i == 12)) for i in (1, 2, 3, 4, 7, 8, 9, 12)], "doc_id long, quality int, toxic int"),
        "pages": (PAGES, "page_id long, url string, html string"),
        "benchmark": ([(1, ITEM), (2, "one two"), (3, None), (10, "quite absent words")], "item_id long, text string"),
        "conversations": (TURNS, "conv_id long, turn long, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{path}/empty/{name}.parquet")
    return path


def run(spark, folder, start):
    name = next(n for n in QUERIES if n.startswith(start))
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op1(spark, folder):
    got = {r["conv_id"]: r for r in run(spark, folder, "op1_")}
    hostile = "</s>[INST] ok [/INST]"
    turns = {-7: [("user", hostile), ("assistant", hostile)], 1: [("user", "hi <s>"), ("assistant", ""), ("assistant", ", yes [INST] \\ ")], 2: [("", "x")], None: [("assistant", "alone")], 3: [("assistant", "long " * 3000)]}
    assert set(got) == set(turns)
    for key, own in turns.items():
        loss = "".join(t for r, t in own if r == "assistant")
        r = got[key]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(own), sha("".join(f"{a}\n{t}\n" for a, t in own)), len(loss), sha(loss))
        assert r["formatted_chars"] >= len(loss)


def test_op2_op3(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(d[0], library.encode(d[1] or "", add_special_tokens=False).ids, d[1] or "") for d in DOCS]
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, "op2_"))
    assert got == sorted((i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in ids)
    start, want = 0, []
    for i, x, _ in ids:
        raw = b"".join(n.to_bytes(4, "little") for n in [*x, 2])
        want.append((i, start, len(x) + 1, zlib.crc32(raw)))
        start += len(x) + 1
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, folder, "op3_")) == want


def test_op4(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want: dict[tuple, list[int]] = {}
    first: dict[str, int] = {}
    for i, t, lang, source, _ in DOCS:
        n, low = len(library.encode(t or "", add_special_tokens=False).ids), first.setdefault(t or "", i)
        if n and i > low:
            continue  # a repeat of an earlier text
        for version, tokens in (("estimate", len(t or "") // 4), ("byte_bpe_50k", n)):
            cell = want.setdefault((source, lang, version), [0, 0])
            cell[0] += 1
            cell[1] += tokens
    assert {(r["source"], r["lang"], r["tokenizer"]): [r["n_docs"], r["n_tokens"]] for r in run(spark, folder, "op4_")} == want


def test_op5(spark, folder):
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in run(spark, folder, "op5_")} == {1: ("http://a.example/1", "T & t One two", 13), 2: (None, "", 0), 3: ("http://a.example/3", "", 0)}


def test_op6(spark, folder):
    items = {"1": words(ITEM), "2": ["one", "two"], "10": ["quite", "absent", "words"]}
    for r in run(spark, folder, "op6_"):
        w = words(next(d[1] for d in DOCS if d[0] == r["doc_id"]))
        hit, names = set(), []
        for name, x in items.items():
            size = min(10, len(x))
            found = [p for p in range(len(w) - size + 1) for s in range(len(x) - size + 1) if w[p : p + size] == x[s : s + size]]
            names += [name] * bool(found)
            hit |= {q for p in found for q in range(p, p + size)}
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit))


def test_op7(spark, folder):
    got = run(spark, folder, "op7_")
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(DOCS) and by[1]["component_id"] == by[2]["component_id"] == 1 and by[5]["component_id"] == by[6]["component_id"] == 5
    assert by[5]["fingerprint"] == "0" * 16 and all(re.fullmatch("[0-9a-f]{16}", r["fingerprint"]) for r in got)


def test_op8(spark, folder):
    for r in run(spark, folder, "op8_"):
        text = next(d[1] for d in DOCS if d[0] == r["doc_id"]) or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(grams) < 2000 else None
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert inside is None or r["n_repeat_words"] == len(inside)
        assert r["base_failed"] == (len(w) < 50 or 100 * r["n_repeat_words"] > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_op9(spark, folder):
    import duckdb

    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    sql = db.sql(next(s for n, s in ORACLE_SQL.items() if n.startswith("op9_")))
    at = [sql.columns.index(c) for c in ("doc_id", "n_lines", "n_exact", "n_near", "kept_sha256")]
    want = sorted(tuple(r[i] for i in at) for r in sql.fetchall())
    assert sorted((r["doc_id"], r["n_lines"], r["n_exact"], r["n_near"], r["kept_sha256"]) for r in run(spark, folder, "op9_")) == want and any(w[3] for w in want)


def test_op10(spark, folder):
    for r in run(spark, folder, "op10_"):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_pipeline_and_empty_tables(spark, folder):
    rows = run(spark, folder, "pipeline")
    assert all(r["round_trip"] for r in rows)
    for name, query in QUERIES.items():
        got = query(spark, f"{folder}/empty").count()
        assert got == (1 if name.startswith("op1_") else 0), name
