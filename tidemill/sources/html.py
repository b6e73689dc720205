"""HTML by the standard library's parser: text, blocks, table grids and links."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

SKIPPED, VOID = {"script", "style", "nav"}, {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "header", "footer", "main", "blockquote", "pre", "dd", "dt", "dl", "body", "form"}
#: A start tag that ends an open one of these, up to the nearest of the fences.
IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"table", "td", "th", "div", "li"})}
MOST_TABLES, MOST_ROWS, MOST_COLS, MOST_CELLS, MOST_SPAN = 100, 1000, 200, 10_000, 200


def span(value: str | None) -> int:
    """A merge count: none is 1, else 1 to MOST_SPAN; ValueError beyond."""
    number = int(value or 1)
    if not 1 <= number <= MOST_SPAN:
        raise ValueError("merge count out of range")
    return number


class _Table:
    def __init__(self, outer: "_Table | None"):
        self.rows, self.nested, self.cell, self.inside = [], outer is not None, None, False


class Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.hidden = 0
        self.text: list[str] = []
        self.paragraphs: list[str] = []
        self.tables: list[_Table] = []
        self.open: list[_Table] = []
        self.links: list[dict] = []
        self.link: dict | None = None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in IMPLIED:
            ended, fences = IMPLIED[tag]
            while self.stack and self.stack[-1] in ended | {"b", "i", "span", "a"} and self.stack[-1] not in fences and any(t in ended for t in self._until(fences)):
                self._end(self.stack[-1])
        if tag in SKIPPED:
            self.hidden += 1
        if tag in BLOCKS or tag in ("br", "table", "tr"):
            self._flush()
        if tag == "table":
            table = _Table(self.open[-1] if self.open else None)
            for outer in self.open:
                outer.inside = True
            self.tables.append(table)
            self.open.append(table)
        elif tag == "tr" and self.open:
            self.open[-1].rows.append([])
        elif tag in ("td", "th") and self.open:
            table = self.open[-1]
            if not table.rows:
                table.rows.append([])
            table.cell = {"text": [], "header": tag == "th", "rowspan": span(attrs.get("rowspan")), "colspan": span(attrs.get("colspan"))}
            table.rows[-1].append(table.cell)
        elif tag == "a":
            self.link = {"href": attrs.get("href") or "", "onclick": attrs.get("onclick") or "", "title": attrs.get("title") or "", "label": []}
            self.links.append(self.link)
        if tag not in VOID:
            self.stack.append(tag)

    def _until(self, fences):
        for tag in reversed(self.stack):
            if tag in fences:
                return
            yield tag

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack:
                top = self.stack[-1]
                self._end(top)
                if top == tag:
                    break

    def _end(self, tag):
        self.stack.pop()
        if tag in SKIPPED:
            self.hidden -= 1
        elif tag == "a":
            if self.link and self.link["href"] and not self.hidden:
                self.handle_data(f" ({self.link['href']})", label=False)
            self.link = None
        elif tag in ("td", "th") and self.open:
            self.open[-1].cell = None
        elif tag == "table" and self.open:
            self._flush()
            self.open.pop()
        if tag in BLOCKS:
            self._flush()

    def handle_data(self, data, label=True):
        if self.hidden:
            return
        for table in self.open:
            if table.cell is not None:
                table.cell["text"].append(data)
        if self.link is not None and label:
            self.link["label"].append(data)
        self.text.append(data)

    def _flush(self):
        whole = " ".join("".join(self.text).split())
        if whole:
            self.paragraphs.append(whole)
        self.text = []
        for table in self.open:
            if table.cell is not None:
                table.cell["text"].append(" ")


def grid(rows: list[list[dict]]) -> list[dict]:
    """Cells with their row and column, each in the first free column of its row."""
    taken, cells = set(), []
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in taken:
                c += 1
            taken.update((r + i, c + j) for i in range(cell["rowspan"]) for j in range(cell["colspan"]))
            cells.append({"row": r, "col": c, "rowspan": cell["rowspan"], "colspan": cell["colspan"], "text": " ".join("".join(cell["text"]).split()), "header": cell["header"]})
            c += cell["colspan"]
    return cells


def parse(html: str) -> dict:
    """status, paragraphs, tables (rows, cols, nested, cells) and links of a page. Beyond a limit: parse_error, nothing cut."""
    reader = Reader()
    try:
        reader.feed(html)
        reader.close()
        while reader.stack:
            reader._end(reader.stack[-1])
        reader._flush()
        tables = []
        for table in reader.tables:
            cells = grid([r for r in table.rows if r])
            rows, cols = max((c["row"] + c["rowspan"] for c in cells), default=0), max((c["col"] + c["colspan"] for c in cells), default=0)
            if len(reader.tables) > MOST_TABLES or rows > MOST_ROWS or cols > MOST_COLS or len(cells) > MOST_CELLS:
                raise ValueError("table too large")
            tables.append({"rows": rows, "cols": cols, "nested": table.inside, "cells": cells})
    except ValueError as error:
        return {"status": "parse_error", "error": str(error), "paragraphs": [], "tables": [], "links": []}
    links = [{"href": x["href"], "onclick": x["onclick"], "label": " ".join(" ".join([*x["label"], x["title"]]).split())} for x in reader.links]
    return {"status": "extracted", "error": None, "paragraphs": reader.paragraphs, "tables": tables, "links": links}


_ACTION = re.compile(r"""(?:location(?:\.href)?\s*=|window\.open\()\s*['"]([^'"]+)""")


def target(link: dict, base: str) -> str | None:
    """Where a link leads, scripts that only set a location included."""
    href = link["href"]
    if not href or href.startswith(("#", "javascript:")):
        found = _ACTION.search(f"{link['onclick']} {href}")
        href = found[1] if found else ""
    return urljoin(base, href) if href else None
