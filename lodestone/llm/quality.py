"""Quality rules: base statistics, and line labelling by a linear-chain conditional random field.

Each line of a text is described by a few measurements; a two-state chain (boilerplate, content) scores lines and
their succession, and Viterbi decoding marks every line.  A document passes if its content lines hold at least
``min_content`` of the characters in its words.  The chain is trained here, on at most ``TRAIN_DOCS`` labelled
documents (those of smallest id hash, and of each at most ``TRAIN_LINES`` lines, for fitting alone): the lines of a document
of quality 0 count as boilerplate; those of one of quality 1 as content, but for the lines that the fixed prior chain marks
as boilerplate, so states change inside documents.  Without labelled documents of both kinds the prior chain decides.

Defined results: a null or empty text has no words and fails the base rules; lines without words are neither content
nor boilerplate; documents of repeated ids are judged one by one; a table without rows gives none; columns of the
input that clash with an output column are replaced.  Texts are processed whole; one narrow pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import read_table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Bound of the labelled sample that the chain is fitted on.
TRAIN_DOCS, TRAIN_LINES = 4000, 200
MIN_WORDS, REPEAT_PERCENT, MIN_CONTENT = 50, 50, 0.5
FEATURES = ("bias", "symbols", "pipes", "upper", "bangs", "few_kinds", "echo", "short", "letters", "digits", "long_words", "again")
#: Used without labels: content minus boilerplate for each feature, and the score of staying in a state.
PRIOR = ((2.0, -4.0, -3.0, -3.0, -3.0, -2.0, -4.0, -0.2, 1.0, -2.0, -0.5, -2.0), 1.0)


def base_statistics(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a whole text."""
    import numpy as np

    words = text.encode("utf-8").split()  # bytes: white space is \x20 \x09-\x0D
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeat = 0
    if n >= 4:
        kinds = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ids = np.fromiter(map(kinds.__getitem__, words), np.int64, n)
        k = len(kinds)
        _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
        _, which, count = np.unique(pair * k + ids[2:], return_inverse=True, return_counts=True)
        often = count[which] > 1
        inside = np.zeros(n, bool)
        for shift in range(3):
            inside[shift : n - 2 + shift] |= often
        repeat = int(inside.sum())
    return n, word_chars, n_symbols, dup, repeat


def line_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Measurements and word characters of each line that has a word."""
    rows, weights, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        chars = sum(map(len, words))
        symbols = sum(map(line.count, SYMBOLS))
        kinds = len(set(words))
        echo = sum(map(str.__eq__, words, words[1:])) if n > 1 else 0
        upper = sum(map(str.isupper, words))
        pipes = words.count("|")
        digits = sum(map(line.count, "0123456789"))
        rows.append([
            1.0,
            min(1.0, symbols / n),
            min(1.0, 2.0 * pipes / n),
            upper / n,
            min(1.0, line.count("!!") / n),
            1.0 - kinds / n if n >= 8 else 0.0,
            echo / n,
            1.0 if n < 4 else 0.0,
            1.0 - min(1.0, (digits + symbols) / chars),
            digits / chars,
            min(1.0, max(0.0, chars / n - 12.0) / 12.0),
            1.0 if line in seen else 0.0,
        ])
        weights.append(chars)
        seen.add(line)
    return rows, weights


class Chain:
    """A two-state linear chain: emission weights of content against boilerplate, and a transition matrix."""

    def __init__(self, weights, transitions):
        self.weights, self.transitions = weights, transitions

    @classmethod
    def prior(cls) -> Chain:
        import numpy as np

        stay = PRIOR[1]
        return cls(np.array(PRIOR[0]), np.array([[stay, 0.0], [0.0, stay]]))

    def decode(self, rows: list[list[float]]) -> list[int]:
        """Viterbi: the likeliest states, 1 for content."""
        import numpy as np

        if not rows:
            return []
        emit = (np.array(rows) @ self.weights).tolist()
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b, back = 0.0, emit[0], []
        for e in emit[1:]:
            stay0, from1, from0, stay1 = a + t00, b + t10, a + t01, b + t11
            back.append((0 if stay0 >= from1 else 1, 0 if from0 > stay1 else 1))
            a, b = max(stay0, from1), max(from0, stay1) + e
        state = 1 if b >= a else 0
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]


def line_labels(rows: list[list[float]], quality: int) -> list[int]:
    """Labels of the lines of a document of known quality."""
    return Chain.prior().decode(rows) if quality else [0] * len(rows)


def fit_chain(chains: list[tuple[list[list[float]], int]], rounds: int = 150, rate: float = 0.15, l2: float = 1e-3) -> Chain:
    """Maximum likelihood of the chains (lines, quality of their document) by Adam over forward-backward marginals."""
    import numpy as np

    chains = sorted((c for c in chains if c[0]), key=lambda c: -len(c[0]))
    if len({label for _, label in chains}) < 2:
        return Chain.prior()
    lengths = np.array([len(rows) for rows, _ in chains])
    y = np.array([label for _, label in chains])
    own = [line_labels(rows, label) for rows, label in chains]
    share = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()) / lengths  # kinds and documents count alike
    top, k = int(lengths[0]), len(FEATURES)
    active = [int((lengths > t).sum()) for t in range(top)]
    x = [np.array([chains[d][0][t] for d in range(active[t])]) for t in range(top)]
    at = [np.array([own[d][t] for d in range(active[t])]) for t in range(top)]
    theta, m, v = np.zeros(k + 4), np.zeros(k + 4), np.zeros(k + 4)
    for step in range(1, rounds + 1):
        w, tr = theta[:k], theta[k:].reshape(2, 2)
        emit = [np.stack([np.zeros(active[t]), x[t] @ w], 1) for t in range(top)]
        alpha = [emit[0]]
        for t in range(1, top):
            prev = alpha[t - 1][: active[t], :, None] + tr
            alpha.append(np.logaddexp(prev[:, 0], prev[:, 1]) + emit[t])
        z = np.zeros(len(chains))
        beta, grad_w, grad_t = None, np.zeros(k), np.zeros((2, 2))
        for t in range(top - 1, -1, -1):
            now = np.zeros((active[t], 2))
            more = active[t + 1] if t + 1 < top else 0
            if more:
                nxt = tr[None] + (emit[t + 1] + beta)[:, None, :]
                now[:more] = np.logaddexp(nxt[..., 0], nxt[..., 1])
            ends = slice(more, active[t])
            z[ends] = np.logaddexp(alpha[t][ends, 0], alpha[t][ends, 1])
            s = share[: active[t]]
            p = np.exp(alpha[t][:, 1] + now[:, 1] - z[: active[t]])
            grad_w += ((at[t] - p) * s) @ x[t]
            if more:
                joint = np.exp(alpha[t][:more, :, None] + nxt - z[:more, None, None])
                grad_t -= (joint * s[:more, None, None]).sum(0)
                np.add.at(grad_t, (at[t][:more], at[t + 1]), s[:more])
            beta = now
        grad = np.concatenate([grad_w, grad_t.ravel()]) / len(chains) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(theta[:k], theta[k:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> Chain:
    """Fit the chain on at most ``sample`` labelled documents."""
    chosen = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so broadcast below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [line_features(t or "")[0][:TRAIN_LINES] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.list_(pa.float64())))], names=["quality", "rows"])

    held = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text").mapInArrow(run, "quality int, rows array<array<double>>")
    return fit_chain([(r["rows"], r["quality"]) for r in held.toLocalIterator()])


OUTPUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, content_lines array<int>, kept boolean"


def judge(docs: DataFrame, chain: Chain, *, text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the base statistics, the share of content, the numbers (from 0) of content lines among lines with a
    word, and ``kept``."""
    made = [c.split()[0] for c in OUTPUT.split(", ")]
    fields = [f for f in docs.schema.fields if f.name not in made]
    at = [f.name for f in fields].index(text_col)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in made]
            for cell in batch.column(at):
                text = cell.as_py() or ""
                n, chars, symbols, dup, repeat = base_statistics(text)
                failed = n < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * n
                rows, weights = line_features(text)
                states = chain.decode(rows)
                total = sum(weights)
                share = sum(w for w, s in zip(weights, states, strict=True) if s) / total if total else 0.0
                row = (n, chars, symbols, dup, repeat, failed, share, [i for i, s in enumerate(states) if s], not failed and share >= min_content)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=[*names, *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), OUTPUT])
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    chain = train(docs, read_table(spark, sf_dir, "labels"))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept")
    return judge(docs.select("doc_id", "text"), chain).select(*columns)


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
