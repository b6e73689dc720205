"""Word-processor packages: zip archives of XML, within limits and without document type declarations."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

MOST_ENTRIES, MOST_BYTES, MOST_ENTRY, MOST_RATIO = 1000, 50 << 20, 20 << 20, 500


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _opened(data: bytes) -> zipfile.ZipFile:
    archive = zipfile.ZipFile(io.BytesIO(data))
    entries = archive.infolist()
    if len(entries) > MOST_ENTRIES or sum(e.file_size for e in entries) > MOST_BYTES or any(e.file_size > MOST_ENTRY or e.file_size > MOST_RATIO * max(1, e.compress_size) for e in entries):
        raise ValueError("archive too large")
    return archive


def _xml(raw: bytes):
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(raw)


def _number(node, name: str, default: int = 0) -> int:
    return int(next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), default))


def _result(paragraphs, tables):
    for t in tables:
        t["rows"] = max((c["row"] + c["rowspan"] for c in t["cells"]), default=0)
        t["cols"] = max((c["col"] + c["colspan"] for c in t["cells"]), default=0)
    return {"status": "extracted", "error": None, "paragraphs": [p for p in paragraphs if p], "tables": tables}


def section_package(data: bytes) -> dict:
    """Packages with Contents/section*.xml: cells tell their own address and span."""
    paragraphs, tables = [], []
    with _opened(data) as archive:
        names = sorted((n for n in archive.namelist() if re.fullmatch(r"Contents/section\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in names:
            root = _xml(archive.read(name))
            inner = {id(x) for t in root.iter() if _local(t) == "tbl" for x in t.iter()}
            paragraphs += ["".join(x.itertext()).strip() for x in root.iter() if _local(x) == "t" and id(x) not in inner]
            for tbl in (t for t in root.iter() if _local(t) == "tbl"):
                cells = []
                for tc in (c for c in tbl.iter() if _local(c) == "tc"):
                    part = {_local(x): x for x in tc}
                    address, merge = part.get("cellAddr"), part.get("cellSpan")
                    if address is None:
                        raise ValueError("cell without an address")
                    cells.append({
                        "row": _number(address, "rowAddr"), "col": _number(address, "colAddr"),
                        "rowspan": _number(merge, "rowSpan", 1) if merge is not None else 1, "colspan": _number(merge, "colSpan", 1) if merge is not None else 1,
                        "text": " ".join("".join(x.itertext()).strip() for x in tc.iter() if _local(x) == "t"), "header": False})
                tables.append({"nested": sum(_local(x) == "tbl" for x in tbl.iter()) > 1, "cells": cells})
    return _result(paragraphs, tables)


def document_package(data: bytes) -> dict:
    """Packages with word/document.xml: rows of cells with grid spans and vertical merges."""
    with _opened(data) as archive:
        root = _xml(archive.read("word/document.xml"))
    body = next(x for x in root.iter() if _local(x) == "body")
    text = lambda node: "".join(x.text or "" for x in node.iter() if _local(x) == "t")
    paragraphs = [text(x).strip() for x in body if _local(x) == "p"]
    tables = []
    for tbl in (t for t in root.iter() if _local(t) == "tbl"):
        cells, above = [], {}
        for r, row in enumerate(x for x in tbl if _local(x) == "tr"):
            c = 0
            for tc in (x for x in row if _local(x) == "tc"):
                props = {_local(x): x for p in tc if _local(p) == "tcPr" for x in p}
                width = _number(props["gridSpan"], "val", 1) if "gridSpan" in props else 1
                merge = props.get("vMerge")
                kind = next((v for k, v in merge.attrib.items() if k.endswith("val")), "continue") if merge is not None else None
                if kind == "continue" and c in above:
                    above[c]["rowspan"] += 1
                else:
                    cell = {"row": r, "col": c, "rowspan": 1, "colspan": width, "text": text(tc).strip(), "header": r == 0}
                    cells.append(cell)
                    above.pop(c, None)
                    if kind == "restart":
                        above[c] = cell
                c += width
        tables.append({"nested": any(_local(x) == "tbl" for x in tbl.iter() if x is not tbl), "cells": cells})
    return _result(paragraphs, tables)
