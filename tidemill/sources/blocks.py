"""The reading order of a page: paragraphs and data tables, cells of layout tables taken apart."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tidemill.sources import html as web, tree
from tidemill.sources.files import CELL

PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "li", "pre"}
HIDDEN = {"script", "style", "nav"}


def _cleaned(html: str) -> tree.Node:
    """The page without hidden elements, the address of each link put after its text."""
    root = tree.parse(html)
    for node in [root, *root.walk()]:
        node.children = [c for c in node.children if isinstance(c, str) or c.tag not in HIDDEN]
        href = node.attrs.get("href", "") if node.tag == "a" else ""
        if href and not href.lower().startswith(("javascript:", "data:", "file:")) and href not in node.text():
            node.children.append(f" ({href})")
    return root


def _parts(node: tree.Node) -> list:
    """Paragraph texts and table elements below an element, in order, tables not entered."""
    out, stack = [], list(reversed(node.children))
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out += [" ".join(at.split())] if at.strip() else []
        elif at.tag == "table":
            out.append(at)
        elif at.tag in PARAGRAPHS and not at.select("table"):
            out += [t] if (t := at.text()) else []
        else:
            stack += reversed(at.children)
    return out


def _rows(table: tree.Node) -> list[list[dict]]:
    rows = [r for r in table.select("tr") if r.within("table") is table]
    kinds = lambda r: [c for c in r.children if isinstance(c, tree.Node) and c.tag in ("td", "th")]
    return [[{"text": [c.text()], "header": c.tag == "th", "rowspan": web.span(c.attrs.get("rowspan")), "colspan": web.span(c.attrs.get("colspan")), "node": c} for c in kinds(r)] for r in rows]


def ordered(html: str) -> list[dict]:
    """type, text and cells of each block in reading order.

    A table is taken apart, its cells by row and column, if it holds another one, has one row or one column, or more than a
    third of its cells are empty; any other is a block of its own whose text is that of its cells.
    """
    out, stack = [], [_cleaned(html)]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            out.append({"type": "paragraph", "text": at, "cells": None})
        elif at.tag != "table":
            stack += reversed(_parts(at))
        else:
            rows = _rows(at)
            cells = web.grid(rows)
            nodes = [c["node"] for r in rows for c in r]
            wide, high = max((c["col"] + c["colspan"] for c in cells), default=0), max((c["row"] + c["rowspan"] for c in cells), default=0)
            empty = sum(not c["text"].strip() for c in cells)
            if at.select("table") or wide == 1 or high == 1 or empty * 3 > len(cells):
                order = sorted(range(len(cells)), key=lambda i: (cells[i]["row"], cells[i]["col"]))
                stack += [nodes[i] for i in reversed(order)]
            else:
                out.append({"type": "table", "text": " ".join(c["text"] for c in cells), "cells": cells})
    return out


def flow(pages: DataFrame) -> DataFrame:
    """notice_id, file_id, place, type, text, table_id and cells of every block of `pages` (notice_id, file_id, html).

    A page whose tables are beyond the limits gives no blocks; null html is empty.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for notice, file, html in zip(frame["notice_id"], frame["file_id"], frame["html"]):
                try:
                    found = ordered(html or "")
                except ValueError:
                    continue
                rows += [(notice, file, i, b["type"], b["text"], f"{file}:{i}" if b["cells"] else None, b["cells"]) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=["notice_id", "file_id", "place", "type", "text", "table_id", "cells"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    shape = f"notice_id {kinds['notice_id']}, file_id {kinds['file_id']}, place int, type string, text string, table_id string, cells array<{CELL}>"
    return pages.select("notice_id", "file_id", "html").mapInPandas(run, shape)
