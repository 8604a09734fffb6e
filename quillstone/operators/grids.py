"""Tables of HTML pages as dense grids and Markdown, nested tables and spans resolved.

A cell that spans fills every place it covers; a nested table is a table of its own and leaves
its text out of the cell around it.  Rows are as wide as the widest.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

# The limits that HTML sets to spans.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65_534

GRID = pa.schema([("page_id", pa.int64()), ("table_no", pa.int32()), ("inside", pa.int32()), ("n_rows", pa.int32()), ("n_cols", pa.int32()), ("cells", pa.list_(pa.list_(pa.string()))), ("markdown", pa.string())])


class Table:
    """One open table: rows of (text, rowspan, colspan, is a heading)."""

    def __init__(self, number: int, inside: int | None):
        self.number, self.inside = number, inside
        self.rows: list[list[tuple[str, int, int]]] = []
        self.cell: list | None = None

    def open_row(self) -> None:
        self.close_cell()
        self.rows.append([])

    def open_cell(self, rowspan: int, colspan: int) -> None:
        self.close_cell()
        if not self.rows:
            self.rows.append([])
        self.cell = [[], rowspan, colspan]

    def close_cell(self) -> None:
        if self.cell:
            text, rowspan, colspan = self.cell
            self.rows[-1].append((" ".join("".join(text).split()), rowspan, colspan))
            self.cell = None

    def grid(self) -> list[list[str]]:
        """Every place's text; a span of 0 rows reaches the end, and none goes beyond it."""
        self.close_cell()
        rows: list[dict[int, str]] = [{} for _ in self.rows]
        for r, cells in enumerate(self.rows):
            at = 0
            for text, rowspan, colspan in cells:
                while at in rows[r]:
                    at += 1
                for below in range(r, len(rows) if rowspan == 0 else min(len(rows), r + rowspan)):
                    for c in range(at, at + colspan):
                        rows[below].setdefault(c, text)
                at += colspan
        width = max((max(row) + 1 for row in rows if row), default=0)
        return [[row.get(c, "") for c in range(width)] for row in rows]


class TableReader(HTMLParser):
    """Closes what markup leaves open: a cell ends a cell, a row a row, a table all in it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[Table] = []
        self.found: list[Table] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "table":
            self.found.append(Table(len(self.found), self.open[-1].number if self.open else None))
            self.open.append(self.found[-1])
        elif tag in ("script", "style"):
            self.hidden += 1
        elif self.open and tag == "tr":
            self.open[-1].open_row()
        elif self.open and tag in ("td", "th"):
            own = dict(attrs)
            self.open[-1].open_cell(span(own.get("rowspan"), MAX_ROWSPAN, 0), span(own.get("colspan"), MAX_COLSPAN, 1))
        elif self.open and self.open[-1].cell and tag in ("br", "p", "div", "li"):
            self.open[-1].cell[0].append(" ")

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif self.open and tag == "table":
            self.open.pop().close_cell()
        elif self.open and tag in ("td", "th", "tr"):
            self.open[-1].close_cell()

    def handle_data(self, data) -> None:
        if self.open and self.open[-1].cell and not self.hidden:
            self.open[-1].cell[0].append(data)


def span(value: str | None, most: int, least: int) -> int:
    value = (value or "").strip()
    return min(most, max(least, int(value))) if value.isascii() and value.isdigit() else 1


def markdown(grid: list[list[str]]) -> str:
    """The first row as heading, pipes escaped."""
    if not grid or not grid[0]:
        return ""
    lines = ["| " + " | ".join(c.replace("\\", "\\\\").replace("|", "\\|") for c in row) + " |" for row in grid]
    return "\n".join([lines[0], "|" + " --- |" * len(grid[0]), *lines[1:]])


def page_tables(html: str | None) -> list[tuple[int, int | None, list[list[str]]]]:
    """(number, number of the table around it, grid) of a page's tables in order of their start."""
    reader = TableReader()
    reader.feed(html or "")
    reader.close()
    return [(t.number, t.inside, t.grid()) for t in reader.found]


def table_grids(pages: DataFrame) -> DataFrame:
    """page_id, table_no, inside, n_rows, n_cols, cells, markdown of pages (page_id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"page_id": page, "table_no": number, "inside": inside, "n_rows": len(grid), "n_cols": len(grid[0]) if grid else 0, "cells": grid, "markdown": markdown(grid)}
                for page, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for number, inside, grid in page_tables(html.as_py())
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=GRID)

    return pages.select("page_id", "html").mapInArrow(run, from_arrow_schema(GRID))
