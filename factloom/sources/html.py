"""Web pages: sections, tables, links and clean text, parsed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADINGS, BLOCKS, SILENT = {"h1", "h2", "h3", "h4", "h5", "h6"}, {"p", "li", "pre", "td", "th"}, {"script", "style", "nav", "footer", "header"}
#: Elements that hold blocks: where one ends, what is open in it ends too.
PARENTS = set(
    "html body address article aside blockquote caption center dd details dialog div dl dt fieldset figcaption figure footer form header "
    "hgroup main menu nav ol search section summary table tbody tfoot thead tr ul".split()
)
#: Pages that are parsed at a time.
PAGES = 64
#: What the start of an element ends, where the end tag is missing, and the elements beyond which it doesn't reach.
LISTS, CELLS, ROWGROUPS = {"ul", "ol", "menu", "dl", "table", "td", "th"}, {"td", "th"}, {"tbody", "thead", "tfoot"}
ENDS = {"p": ({"p"}, PARENTS | {"li"} | CELLS), "li": ({"li"}, LISTS), "dd": ({"dd", "dt"}, LISTS), "dt": ({"dd", "dt"}, LISTS)}
ENDS |= dict.fromkeys(CELLS, (CELLS, {"tr", "table"})) | {"tr": (CELLS | {"tr"}, {"table"})} | dict.fromkeys(ROWGROUPS, (CELLS | {"tr"} | ROWGROUPS, {"table"}))
ENDS |= dict.fromkeys(HEADINGS, (HEADINGS, PARENTS | {"li"} | CELLS))
#: A table and its parts: no end tag of another kind reaches out of a cell.
TABLE = CELLS | ROWGROUPS | {"table", "tr"}


class _Page(HTMLParser):
    """Collects headings with the blocks below them, table rows and anchors.

    A block whose end tag is missing ends where HTML ends it: at the next one
    of its kind, with its parent, or with the page. A p's text is given off at
    each block, heading or parent that starts or ends in it; what follows there
    is a paragraph of its own.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[dict] = []
        self.tables: list[list[list[str]]] = []
        self.anchors: list[tuple[str, str]] = []
        self.words: list[str] = []
        self._open: list[tuple[str, list[str] | None, str]] = []  # tag, text of the innermost block, that block's tag
        self._href: tuple[str, list[str]] | None = None
        self._silent = 0
        self._of_table: list[int] = []  # numbers of the open tables

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self._silent += 1
        if tag in HEADINGS | BLOCKS | PARENTS:
            if tag in ENDS:
                self._end(*ENDS[tag], last=True)
            self._pause()
            text, block = self._open[-1][1:] if self._open else (None, "")
            self._open.append((tag, text, block) if tag in PARENTS else (tag, [], tag))
        if tag == "table":
            self._of_table.append(len(self.tables))
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag == "a":
            self._href = (dict(attrs).get("href") or "", [])

    def handle_endtag(self, tag):
        if tag in SILENT:
            self._silent = max(0, self._silent - 1)
        if tag == "a" and self._href:
            self.anchors.append((self._href[0], " ".join("".join(self._href[1]).split())))
            self._href = None
        elif tag in HEADINGS | BLOCKS | PARENTS:
            self._end({tag}, {"table"} if tag in TABLE else CELLS | {"table"})

    def close(self):
        super().close()
        self._leave(0)

    def _end(self, tags: set[str], within: set[str], last: bool = False) -> None:
        """End the innermost open element of `tags` (the outermost, if `last`) and all in it, unless one of `within` lies between."""
        at = None
        for i in reversed(range(len(self._open))):
            if self._open[i][0] in tags:
                at = i
                if not last:
                    break
            elif self._open[i][0] in within:
                break
        if at is not None:
            self._leave(at)

    def _leave(self, at: int) -> None:
        while len(self._open) > at:
            self._pause()
            tag, text, _ = self._open.pop()
            if tag == "table":
                rows = [" | ".join(r) for r in self.tables[self._of_table.pop()] if any(r)]
                if rows:
                    self._take("table", "Table:\n" + "\n".join(rows))
            elif tag not in PARENTS and tag != "p":
                self._take(tag, " ".join("".join(text).split()))

    def _pause(self) -> None:
        """Give off what the innermost block has, if it is a p."""
        if self._open and self._open[-1][2] == "p":
            text = self._open[-1][1]
            self._take("p", " ".join("".join(text).split()))
            text.clear()

    def _take(self, tag: str, text: str) -> None:
        if tag in HEADINGS:
            self.sections.append({"heading": text, "text": ""})
        elif tag in ("td", "th"):
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append(text)
        elif text:
            if not self.sections:
                self.sections.append({"heading": "", "text": ""})
            last = self.sections[-1]
            last["text"] = (last["text"] + "\n" + text).strip()

    def handle_data(self, data):
        if self._silent:
            return
        self.words.append(data)
        if self._open and self._open[-1][1] is not None:
            self._open[-1][1].append(data)
        if self._href:
            self._href[1].append(data)


def parsed(html: str | None) -> _Page:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page


def _mapped(df: DataFrame, name: str, kind: T.DataType, arrow: pa.DataType, of: Callable[[_Page], object], html_col: str) -> DataFrame:
    kept = df.drop(name)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, PAGES) for i in range(0, batch.num_rows, PAGES)):
                found = [of(parsed(h)) for h in part.column(html_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, arrow)], names=[*names, name])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(name, kind)]))


def sections(pages: DataFrame, html_col: str = "html", heading_chars: int | None = 200, text_chars: int | None = None) -> DataFrame:
    """Add `sections`: heading and text of each, cut for display where a number of characters is given."""
    cut = lambda p: [{"heading": s["heading"][:heading_chars], "text": s["text"][:text_chars]} for s in p.sections]
    kind = T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())]))
    return _mapped(pages, "sections", kind, pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string())])), cut, html_col)


def tables(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `tables`: the rows of each table, their cells joined by bars."""
    return _mapped(pages, "tables", T.ArrayType(T.ArrayType(T.StringType())), pa.list_(pa.list_(pa.string())), lambda p: [[" | ".join(r) for r in t] for t in p.tables], html_col)


def clean_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `clean_text`: what is to be read, with single blanks."""
    return _mapped(pages, "clean_text", T.StringType(), pa.string(), lambda p: " ".join("".join(p.words).split()), html_col)


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int | None = None) -> DataFrame:
    """(id, rank, link): the distinct links of each page that stay on its host, the first `most` if a number is given."""
    rows = _mapped(pages.select(id_col, url_col, html_col), "anchors", T.ArrayType(T.StringType()), pa.list_(pa.string()), lambda p: [h for h, _ in p.anchors if h], html_col)
    names = [id_col, url_col]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for url, hrefs in zip(batch.column(url_col).to_pylist(), batch.column("anchors").to_pylist(), strict=True):
                whole = [urljoin(url or "", h).split("#")[0] for h in hrefs]
                found.append(list(dict.fromkeys(w for w in whole if urlsplit(w).netloc == urlsplit(url or "").netloc)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.string()))], names=[*names, "links"])

    flat = rows.select(*names, "anchors").mapInArrow(join, T.StructType([*(rows.schema[n] for n in names), T.StructField("links", T.ArrayType(T.StringType()))]))
    return flat.select(id_col, F.posexplode(F.slice("links", 1, most) if most else "links").alias("rank", "link"))


def document_type(path: Column) -> Column:
    """Kind of a document by its path's ending, HTML where that tells nothing."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    return F.when(end.isin("pdf", "docx", "pptx", "md", "txt"), end).otherwise("html")


