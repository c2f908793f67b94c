"""Tables: OTSL markup to HTML, and merging of tables that run over a page break."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks of the markup. A cell with text, an empty one, one spanned from the left, from above, from both; end of row.
CELL, EMPTY, LEFT, UP, BOTH, ROW = "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"

_MARK = re.compile("|".join((CELL, EMPTY, LEFT, UP, BOTH, ROW)))


def otsl_rows(markup: str) -> list[list[tuple[str, str]]]:
    """Rows of (mark, text), filled up with empty cells to the same width; rows without marks are none."""
    marks = list(_MARK.finditer(markup))
    rows, row = [], []
    for mark, following in zip(marks, [*marks[1:], None], strict=False):
        if mark[0] == ROW:
            rows.append(row)
            row = []
        else:
            row.append((mark[0], markup[mark.end() : following.start() if following else len(markup)].strip()))
    rows = [r for r in [*rows, row] if r]
    width = max(map(len, rows), default=0)
    return [r + [(EMPTY, "")] * (width - len(r)) for r in rows]


def otsl_html(markup: str | None) -> str | None:
    """The HTML table of the markup; HTML stays as it is, markup without cells gives an empty string."""
    if markup is None or (markup.startswith("<table") and markup.endswith("</table>")):
        return markup
    rows = otsl_rows(markup)
    taken: set[tuple[int, int]] = set()
    body = []
    for i, row in enumerate(rows):
        cells = []
        for j, (mark, text) in enumerate(row):
            if (i, j) in taken:
                continue
            wide = _run((row[k][0] for k in range(j + 1, len(row))), (LEFT, BOTH)) + 1 if mark in (CELL, EMPTY) else 1
            high = _run((rows[k][j][0] for k in range(i + 1, len(rows))), (UP, BOTH)) + 1 if mark in (CELL, EMPTY) else 1
            taken.update((a, b) for a in range(i, i + high) for b in range(j, j + wide))
            spans = f' rowspan="{high}"' * (high > 1) + f' colspan="{wide}"' * (wide > 1)
            cells.append(f"<td{spans}>{html.escape(text) if mark == CELL else ''}</td>")
        body.append(f"<tr>{''.join(cells)}</tr>")
    return f"<table>{''.join(body)}</table>" if body else ""


def _run(marks, wanted: tuple[str, ...]) -> int:
    n = 0
    for mark in marks:
        if mark not in wanted:
            break
        n += 1
    return n


def otsl_to_html(markup: Column) -> Column:
    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(otsl_html)

    return convert(markup)


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[list]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            spans = dict(attrs)
            self.rows[-1].append(["", int(spans.get("colspan") or 1)])

    def handle_data(self, data: str) -> None:
        if self.rows and self.rows[-1]:
            self.rows[-1][-1][0] += data


def table_rows(table: str) -> list[list[tuple[str, int]]]:
    """Rows of (text, columns) of an HTML table."""
    parser = _Rows()
    parser.feed(table)
    return [[(text.strip(), span) for text, span in row] for row in parser.rows]


def merged_tables(first: str, second: str, first_width: float, second_width: float) -> str | None:
    """Both tables as one if they go on: widths within a tenth and as many columns; repeated header rows (up to five)
    of the second go. None if they are two tables."""
    if abs(first_width - second_width) > 0.1 * max(first_width, second_width):
        return None
    a, b = table_rows(first), table_rows(second)
    columns = lambda rows: max((sum(s for _, s in row) for row in rows), default=0)
    if not a or not b or columns(a) != columns(b):
        return None
    same = _run((x == y for x, y in zip(a[:5], b[:5], strict=False)), (True,))
    tail = re.findall(r"(?is)<tr\b.*?</tr>", second)[same:]
    return re.sub(r"(?is)</table>\s*$", "", first) + "".join(tail) + "</table>"
