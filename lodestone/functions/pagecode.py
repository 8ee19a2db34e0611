"""Functions over page markup and over replies that hold code; those that need a scan by state run over Arrow batches."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes that stay, and the length from which a value is shortened (fixed values).
KEPT, LONGEST = ("id", "name", "href", "value", "type", "class"), 120
_SCRIPT = re.compile(r"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", re.IGNORECASE | re.DOTALL)
_TAG = re.compile(r"<[^>]+>")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"<\s*([-\w:]+)")
_PAIR = re.compile(r"""\s+([-\w:]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
_ROW = re.compile(r"<tr\b[^>]*>.*?</tr\s*>", re.IGNORECASE | re.DOTALL)
_CELL = re.compile(r"<t[dh]\b", re.IGNORECASE)


def _lean(tag: str, kept: tuple[str, ...]) -> str:
    name = _NAME.match(tag)
    if not name:
        return tag
    own = []
    for key, value in _PAIR.findall(tag):
        if key.lower() in kept:
            value = value.strip("\"'")
            over = len(value) - LONGEST
            own.append(f'{key}="{value[:LONGEST]}...[{over} chars elided]"' if over > 0 else f'{key}="{value}"')
    return f"<{' '.join([name[1], *own])}{'/' if tag.rstrip().endswith('/>') else ''}>"


def strip_levels(page: str, kept: tuple[str, ...] = KEPT) -> tuple[str, str, str]:
    """A page without scripts, styles and comments; then with few attributes; then its text only."""
    bare = _SCRIPT.sub("", page)
    lean = _SPACE.sub(" ", _TAG.sub(lambda m: _lean(m[0], kept), bare))
    return bare, lean, _SPACE.sub(" ", _TAG.sub(" ", lean))


def data_rows(page: str) -> list[tuple[int, int, int]]:
    """Begin, end and cells of the rows of four cells or more."""
    return [(m.start(), m.end(), n) for m in _ROW.finditer(page) if (n := len(_CELL.findall(m[0]))) >= 4]


def excerpt(page: str, budget: int, step: int = 1000, least: int = 3) -> tuple[str, float, int]:
    """A part of a page of about ``budget`` characters: its beginning, and the stretch that holds most data rows, the first
    of equals.  If that holds fewer than ``least`` rows of the commonest width, the stretch begins at the first of these.
    With it, the share of the page that the budget is, and where the stretch begins."""
    if len(page) <= budget:
        return page, 1.0, 0
    head = budget // 5
    span = budget - head
    rows = data_rows(page)
    inside = lambda some, at: sum(a >= at and b <= at + span for a, b, _ in some)
    starts = range(0, max(1, len(page) - span) + step, step)
    at = max(starts, key=lambda i: (inside(rows, i), -i))
    if rows:
        width = max(Counter(n for _, _, n in rows).items(), key=lambda x: (x[1], x[0]))[0]
        grid = [r for r in rows if r[2] == width]
        if inside(grid, at) < least:
            at = grid[0][0]
    return f"{page[:head]}\n...[document elided]...\n{page[at : at + span]}", budget / len(page), at


_FENCE = re.compile(r"```[ \t]*(python|py|json)?[ \t]*\r?\n", re.IGNORECASE)


def fenced_blocks(reply: str) -> list[str]:
    """The fenced parts of a reply.  A fence that names a language opens a block even where an end was due; the last block
    may lack its end."""
    blocks, opened, at = [], None, 0
    while (tick := reply.find("```", at)) >= 0:
        fence = _FENCE.match(reply, tick)
        if opened is not None:
            blocks.append(reply[opened:tick])
            opened, at = None, tick + 3
            if not (fence and fence[1]):
                continue
        if fence:
            opened = at = fence.end()
        else:
            at = tick + 1
    return blocks if opened is None else [*blocks, reply[opened:]]


def answer_block(reply: str, contract: str | None = None) -> str:
    """The last block that holds the contract, else the longest; a reply without the contract has no answer."""
    if contract and contract not in reply:
        return ""
    blocks = fenced_blocks(reply)
    fit = [b for b in blocks if contract and contract in b]
    return fit[-1] if fit else max(blocks, key=len) if blocks else reply


#: What code from a reply may not import or call (fixed values).
BANNED_MODULES = frozenset(
    "os sys subprocess socket urllib shutil pathlib importlib ctypes pickle requests http ftplib smtplib tempfile glob multiprocessing threading webbrowser sqlite3 marshal code pty signal resource".split()
)
BANNED_NAMES = frozenset("open exec eval compile __import__ input breakpoint".split())


def audit(source: str, needed: str = "extract") -> tuple[list[str], list[str]]:
    """What is wrong with a module, and what it imports; it is parsed and never run."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError) as e:
        return [f"does not parse: {e}"], []
    nodes = list(ast.walk(tree))
    imports = {a.name.split(".")[0] for n in nodes if isinstance(n, ast.Import) for a in n.names}
    imports |= {(n.module or "").split(".")[0] for n in nodes if isinstance(n, ast.ImportFrom) and not n.level}
    wrong = {f"uses {n.id}()" for n in nodes if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and n.id in BANNED_NAMES}
    wrong |= {f"imports {m}" for m in imports & BANNED_MODULES}
    if not any(isinstance(n, ast.FunctionDef) and n.name == needed for n in tree.body):
        wrong.add(f"defines no top-level {needed}()")
    return sorted(wrong), sorted(imports)


def search(page: str, needle: str, around: int = 100, most: int = 20) -> tuple[int, list[str]]:
    """How often a text stands in a page, whatever its case, and the first places with their surroundings (a short report)."""
    low, key, out, at = page.lower(), needle.lower(), [], -1
    if not key:
        return 0, []
    while len(out) < most and (at := low.find(key, at + 1)) >= 0:
        out.append(f"at {at}: ...{page[max(0, at - around) : at + len(needle) + around]}...")
    return low.count(key), out


def cells_of(page: str) -> list[list[tuple[str, str]]]:
    """Rows of a page by a walk of its tree, apart from any pattern: (shown, hidden) text of each cell.  A table inside a
    cell has rows of its own; hidden is what stands in elements that are not displayed."""
    from html.parser import HTMLParser

    rows: list[list[tuple[str, str]]] = []

    class Walker(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.rows: list[list] = []  # open rows, of (shown, hidden) lists
            self.cells: list[list] = []
            self.dark: list[str] = []

        def handle_starttag(self, tag, attrs):
            style = dict(attrs)
            if self.dark or tag in ("script", "style") or "hidden" in style or "display:none" in (style.get("style") or "").replace(" ", ""):
                if tag not in ("br", "img", "input", "hr"):
                    self.dark.append(tag)
                return
            if tag == "tr":
                self.rows.append([])
            elif tag in ("td", "th") and self.rows:
                self.cells.append([len(self.rows), [], []])

        def handle_endtag(self, tag):
            if self.dark:
                if tag in self.dark:
                    while self.dark.pop() != tag:
                        pass
                return
            if tag in ("td", "th") and self.cells:
                depth, shown, hidden = self.cells.pop()
                if self.rows:
                    self.rows[min(depth, len(self.rows)) - 1].append((" ".join("".join(shown).split()), " ".join("".join(hidden).split())))
            elif tag == "tr" and self.rows:
                row = self.rows.pop()
                if row:
                    rows.append(row)

        def handle_data(self, data):
            if self.cells:
                self.cells[-1][2 if self.dark else 1].append(data)

    walker = Walker()
    walker.feed(page)
    walker.close()
    return rows


def over_texts(df: DataFrame, column: str, f: Callable[[str], tuple], schema: str) -> DataFrame:
    """``df`` without ``column`` and with the columns of ``schema`` that ``f`` gives for its text; one narrow pass."""
    kept = [c for c in df.columns if c != column]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    made = df.sparkSession.createDataFrame([], schema).schema
    names = [m.name for m in made.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            rows = [f(t or "") for t in batch.column(len(kept)).to_pylist()]
            made_columns = [pa.array([r[i] for r in rows], to_arrow_type(m.dataType)) for i, m in enumerate(made.fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made_columns], names=[*kept, *names])

    return df.select(*kept, F.col(column)).mapInArrow(run, f"{kinds}, {schema}" if kinds else schema)
