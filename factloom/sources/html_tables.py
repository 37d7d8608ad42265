"""Tables of web pages laid out on grids, and the metrics that stand in them."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most columns and rows that one cell may span in HTML.
COLSPAN, ROWSPAN = 1000, 65534
#: Tags that only bound or style what is in them, and the pieces of a page that needs no more care: such tags, and text without references.
_PLAIN = "html head body main section article div p span b i em strong a ul ol li h1 h2 h3 h4 table caption thead tbody tfoot tr td th".split()
_PIECE = re.compile(rf"""<(/?)({'|'.join(sorted(_PLAIN, key=len, reverse=True))})((?:[ \n]+[a-z]+="[^"<>&\x00]*")*)>|([^<&\x00]+)""")
_ATTRIBUTE = re.compile(r'([a-z]+)="([^"]*)"')
_OF_TABLES = frozenset(("table", "caption", "tr", "td", "th"))


class _Tables(HTMLParser):
    """Collects tables in the order they begin: caption, and rows of (text, is a header, columns, rows). A table within a cell is one of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[dict] = []
        self._open: list[dict] = []
        self._silent = 0

    def _ends(self) -> None:
        top = self._open[-1]
        if top["cell"]:
            parts, *kind = top["cell"]
            top["rows"][-1].append((" ".join("".join(parts).split()), *kind))
        if top["words"] is not None:
            top["caption"] = " ".join("".join(top["words"]).split())
        top["cell"] = top["words"] = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self._silent += 1
        elif tag == "table":
            self.tables.append({"caption": "", "rows": [], "cell": None, "words": None})
            self._open.append(self.tables[-1])
        elif self._open and tag in ("caption", "tr", "td", "th"):
            self._ends()
            top = self._open[-1]
            if tag == "caption":
                top["words"] = []
            elif tag == "tr" or not top["rows"]:
                top["rows"].append([])
            if tag in ("td", "th"):
                given = dict(attrs) if attrs else {}
                top["cell"] = ([], tag == "th", _span(given.get("colspan"), COLSPAN) or 1, _span(given.get("rowspan"), ROWSPAN)) if given else ([], tag == "th", 1, 1)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self._silent = max(0, self._silent - 1)
        elif self._open and tag in ("caption", "tr", "td", "th", "table"):
            self._ends()
            if tag == "table":
                self._open.pop()

    def close(self):
        super().close()
        while self._open:
            self._ends()
            self._open.pop()

    def read(self, html: str) -> None:
        """feed() and close(). A page of nothing but plain pieces is cut by one pattern, which is several times as fast as the parser and sees the same."""
        pieces = _PIECE.findall(html)
        if sum(len(text) or len(end) + len(tag) + len(given) + 2 for end, tag, given, text in pieces) != len(html) or any(end and given for end, _, given, _ in pieces):
            self.feed(html)
        else:
            for end, tag, given, text in pieces:
                if text:
                    self.handle_data(text)
                elif tag in _OF_TABLES:
                    self.handle_endtag(tag) if end else self.handle_starttag(tag, _ATTRIBUTE.findall(given) if given else ())
        self.close()

    def handle_data(self, data):
        if self._open and not self._silent:
            top = self._open[-1]
            into = top["cell"][0] if top["cell"] else top["words"]
            if into is not None:
                into.append(data)


def _span(text: str | None, most: int) -> int:
    return min(int(text), most) if (text or "").strip().isdecimal() else 1


def _grid(rows: list[list[tuple]]) -> list[list[str]]:
    """The rows with every cell put into all the places that it spans; none reaches below the last row."""
    out, held = [], {}  # held: column to (rows left, text)
    for i, row in enumerate(rows):
        if not held and all(c[2] == c[3] == 1 for c in row):
            out.append([c[0] for c in row])
            continue
        line: dict[int, str] = {}
        for c in list(held):
            left, text = held.pop(c)
            line[c] = text
            if left > 1:
                held[c] = (left - 1, text)
        at = 0
        for text, _, columns, down in row:
            while at in line:
                at += 1
            down = len(rows) - i if down == 0 else down
            for c in range(at, at + columns):
                if c in line:
                    break
                line[c] = text
                if down > 1:
                    held[c] = (down - 1, text)
            at += columns
        out.append([line.get(c, "") for c in range(max(line, default=-1) + 1)])
    return out


@F.udtf(returnType="table_index int, caption string, row_count int, headers int, rows array<array<string>>")
class _of_page:
    def eval(self, html: str | None):
        page = _Tables()
        page.read(html or "")
        for number, t in enumerate(page.tables):
            heads = next((i for i, r in enumerate(t["rows"]) if not r or not all(c[1] for c in r)), len(t["rows"]))
            yield number, t["caption"], len(t["rows"]), heads, _grid(t["rows"])


def tables(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Each page's tables beside its other columns: table_index, caption, row_count, headers (leading rows of header cells only) and rows.

    Spans are laid out, so that every row has a cell for each place it covers.
    Pages without a table, null and empty ones give no row. Columns of pages by
    the names above are replaced.
    """
    kept = pages.drop("table_index", "caption", "row_count", "headers", "rows")
    return kept.lateralJoin(_of_page(F.col(html_col).outer()))


def metrics(found: DataFrame, *keep: str) -> DataFrame:
    """(keep, table_index, caption, row, column, name, period, value, unit) of tables(): one row for each cell with a number, beside the first column.

    A cell's name is its row's first cell, its period what stands above it in
    the header rows (the first row, where no row is one), each text once. The
    unit is a currency sign before the number, else a percent sign or a word
    behind it, else empty. Commas in numbers are dropped.
    """
    heads = F.greatest("headers", F.lit(1))
    rows = found.select(*keep, "table_index", "caption", F.slice("rows", F.lit(1), heads).alias("above"), heads.alias("heads"), F.posexplode("rows").alias("row", "cells")).where("row >= heads")
    cells = rows.select(*keep, "table_index", "caption", "row", "above", F.trim(F.get("cells", F.lit(0))).alias("name"), F.posexplode("cells").alias("column", "cell")).where("column > 0")
    over = F.array_distinct(F.filter(F.transform("above", lambda r: F.get(r, F.col("column"))), lambda x: x != ""))
    number = r"([$€£]?)\s*([-+]?[0-9][0-9,]*(?:\.[0-9]+)?)\s*(%|[A-Za-z]+)?"
    part = lambda i: F.regexp_extract("cell", number, i)
    out = cells.where(F.rlike("cell", F.lit(number))).withColumns({"sign": part(1), "digits": part(2), "behind": part(3)})
    unit = F.coalesce(F.nullif("sign", F.lit("")), F.col("behind"))
    value = F.regexp_replace("digits", "[,+]", "").try_cast("double")
    return out.select(*keep, "table_index", "caption", "row", "column", "name", F.array_join(over, " ").alias("period"), value.alias("value"), unit.alias("unit"))
