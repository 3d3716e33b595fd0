"""Markdown texts as blocks: titles, headings, tables, bullets, quotes and
paragraphs, one row each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Marks of the blocks.
RULE_RE = re.compile(r"-{3,}|\*{3,}|_{3,}")
HEADING_RE = re.compile(r"(#{1,6})\s+(.*)")
TABLE_RULE_RE = re.compile(r"\|?[\s:|-]+\|?")
BULLET_RE = re.compile(r"[-*+]\s+(.*)")
QUOTE_RE = re.compile(r">\s?(.*)")
BREAK_RE = re.compile(r"#{1,6}\s|[-*+]\s|>|\||\d+[.)]\s")

Block = tuple[str, int, str, list[list[str]]]
CELLS = T.ArrayType(T.ArrayType(T.StringType()))


def _cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip("|").split("|")]


def parse(text: str, title: str | None = None) -> Iterator[Block]:
    """(kind, level, text, cells) of each block; ``title`` comes first unless
    the text opens with a heading of level 1 or 2.  Lines of a quote or
    paragraph are joined by a space; a numbered line begins a paragraph."""
    lines = [x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    opening = next(filter(None, lines), "")
    if title and not re.match(r"#{1,2}\s", opening):
        yield "title", 0, title, []
    todo = list(reversed(lines))
    while todo:
        line = todo.pop()
        if not line or RULE_RE.fullmatch(line):
            continue
        if m := HEADING_RE.fullmatch(line):
            yield "heading", len(m[1]), m[2], []
        elif line.startswith("|") and todo and TABLE_RULE_RE.fullmatch(todo[-1]):
            todo.pop()
            rows = [_cells(line)]
            while todo and todo[-1].startswith("|"):
                rows.append(_cells(todo.pop()))
            yield "table", 0, "", rows
        elif m := BULLET_RE.fullmatch(line):
            yield "bullet", 0, m[1], []
        elif m := QUOTE_RE.fullmatch(line):
            said = [m[1]]
            while todo and (m := QUOTE_RE.fullmatch(todo[-1])):
                said.append(m[1])
                todo.pop()
            yield "quote", 0, " ".join(said), []
        else:
            said = [line]
            while todo and todo[-1] and not BREAK_RE.match(todo[-1]):
                said.append(todo.pop())
            yield "paragraph", 0, " ".join(said), []


def markdown_blocks(texts: DataFrame, id_col: str = "doc_id", text: str = "text", title: str | None = None) -> DataFrame:
    """texts (id, text, title...) to (id, position, kind, level, text, cells).
    A null text has no blocks; ``title`` names a column of titles."""
    schema = T.StructType([texts.schema[id_col], T.StructField("position", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("cells", CELLS)])
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = b.column(title).to_pylist() if title else [None] * b.num_rows
            rows = [(i, p, *block) for i, (x, t) in enumerate(zip(b.column(text).to_pylist(), titles)) if x is not None for p, block in enumerate(parse(x, t))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names=schema.names)

    return texts.select(id_col, text, *[title] * bool(title)).mapInArrow(run, schema)
