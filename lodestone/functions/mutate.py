"""Changes that a page may undergo without its records changing, and what they lose."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INNER = '<table class="innerLayout"><tr><td></td></tr></table>'
_START_TAG = re.compile(r"""<([a-zA-Z][\w:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>""")
_ATTRIBUTE = re.compile(r"""[\w:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))?""")
_CLASS = re.compile(r"""\bclass\s*=\s*("[^"]*"|'[^']*')""")
_HEADER = re.compile(r"(<th\b[^>]*>)(.*?)(</th>)", re.IGNORECASE | re.DOTALL)


def _turned(page: str) -> str:
    """Attributes of every start tag in reverse."""

    def turn(m: re.Match) -> str:
        own = _ATTRIBUTE.findall(m[2])
        return f"<{m[1]} {' '.join(own[::-1])}>" if own else m[0]

    return _START_TAG.sub(turn, page)


def _renamed(page: str) -> str:
    return _CLASS.sub(lambda m: f"class={m[1][0]}{' '.join(f'{word}_x' for word in m[1][1:-1].split())}{m[1][0]}", page)


def _shouted(page: str) -> str:
    return _HEADER.sub(lambda m: m[1] + m[2].upper() + m[3], page)


def _id_suffix(h: Column) -> Column:
    return F.regexp_replace(h, r"""\b(id|name)\s*=\s*(["'])""", "$1=$2ctl99_")


def _wrapper(h: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(h, r"(?i)<table\b", '<div class="pnlWrap"><table'), r"(?i)</table\s*>", "</table></div>")


def _nested(h: Column) -> Column:
    """A table in the first cell of each row, on which a pattern up to the next end of a table closes too early."""
    return F.regexp_replace(h, r"(?is)(<tr\b[^>]*>(?:(?!</tr).)*?<td\b[^>]*>)", "$1" + INNER)


def _appended(h: Column) -> Column:
    h = F.regexp_replace(h, r"(?is)(<tr\b(?:(?!</tr).)*?<th\b(?:(?!</tr).)*)(</tr\s*>)", "$1<th>Extra</th>$2")
    return F.regexp_replace(h, r"(?is)(<tr\b(?:(?!</tr|<th\b).)*)(</tr\s*>)", "$1<td>-</td>$2")


#: By patterns in the JVM, and those that must see each tag, over Arrow batches.
PATTERNS = {"id_suffix": _id_suffix, "wrapper_div": _wrapper, "nested_table": _nested, "whitespace": lambda h: F.regexp_replace(h, r">\s*<", ">\n  <"), "column_append": _appended}
WALKS = {"class_rename": _renamed, "attr_reorder": _turned, "header_case": _shouted}
#: All, in the order of reports (fixed values).
MUTATIONS = ("id_suffix", "class_rename", "attr_reorder", "wrapper_div", "nested_table", "whitespace", "column_append", "header_case")


def mutations(pages: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """``key, mutation, html``: each page after each mutation."""
    kind = pages.schema[key].dataType.simpleString()
    own = pages.select(key, html)
    each = F.array(*(F.struct(F.lit(n).alias("mutation"), f(F.col(html)).alias("changed")) for n, f in PATTERNS.items()))
    made = own.select(key, F.explode(each).alias("x")).select(key, "x.mutation", F.col("x.changed").alias(html))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for name, walk in WALKS.items():
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(texts)), pa.array([None if t is None else walk(t) for t in texts], pa.string())], names=[key, "mutation", html])

    return made.unionByName(own.mapInArrow(run, f"`{key}` {kind}, mutation string, `{html}` string"))


def lost_ids(mutated: DataFrame, ids: DataFrame, key: str = "page", html: str = "html") -> DataFrame:
    """``key, mutation, n, lost``: identifiers (``key, id``) of each page and those that its mutation no longer holds.  A
    mutation that loses any is no fair test and is not scored."""
    j = mutated.join(ids, key)
    return j.groupBy(key, "mutation").agg(F.count("*").alias("n"), F.count_if(~F.contains(html, F.col("id"))).alias("lost"))
