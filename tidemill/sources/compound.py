"""Compound files and the word-processor records in them, by their public format descriptions."""

from __future__ import annotations

import re
import struct
import zlib

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, MOST_INFLATED, MOST_LEVEL = 0xFFFFFFFA, 30 << 20, 16
#: Record tags (fixed values).
TEXT, CONTROL, LIST, TABLE = 67, 71, 72, 77
#: Characters below a blank that stand for themselves; the others take eight units of text.
SINGLE = {0, 10, 13, *range(24, 32)}


class Compound:
    """Streams of a compound file by their path."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        self.data = data
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("unusual sector size")
        self.size, self.mini_size = 1 << shift, 1 << mini_shift
        n_fat, first_dir, _, self.cutoff, first_mini, n_mini, first_more, n_more = struct.unpack_from("<IIIIIIII", data, 44)
        sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < END]
        seen = 0
        while first_more < END and seen <= n_more:
            part = struct.unpack(f"<{self.size // 4}I", self._sector(first_more))
            sectors += [s for s in part[:-1] if s < END]
            first_more, seen = part[-1], seen + 1
        self.fat = [x for s in sectors[:n_fat] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        raw = self._chain(first_mini, self.fat, self._sector) if n_mini else b""
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw))
        table = self._chain(first_dir, self.fat, self._sector)
        self.entries = [self._entry(table[i : i + 128]) for i in range(0, len(table), 128)]
        self.root = self.entries[0]
        self.mini = self._chain(self.root[5], self.fat, self._sector)[: self.root[6]] if self.root[6] else b""
        self.streams = {}
        self._walk(self.root[4], "", set())

    def _sector(self, n: int) -> bytes:
        out = self.data[(n + 1) * self.size : (n + 2) * self.size]
        if not out:
            raise ValueError("sector beyond the file")
        return out.ljust(self.size, b"\0")

    def _chain(self, first: int, table: list[int], read) -> bytes:
        out, seen = [], set()
        while first < END:
            if first in seen or first >= len(table):
                raise ValueError("broken chain")
            seen.add(first)
            out.append(read(first))
            first = table[first]
        return b"".join(out)

    @staticmethod
    def _entry(raw: bytes):
        (length,) = struct.unpack_from("<H", raw, 64)
        left, right, child = struct.unpack_from("<III", raw, 68)
        start, size = struct.unpack_from("<IQ", raw, 116)
        return raw[: max(0, length - 2)].decode("utf-16-le"), raw[66], left, right, child, start, size

    def _walk(self, n: int, path: str, seen: set) -> None:
        if n >= len(self.entries) or n in seen:
            return
        seen.add(n)
        entry = self.entries[n]
        self._walk(entry[2], path, seen)
        if entry[1] == 1:
            self._walk(entry[4], f"{path}{entry[0]}/", seen)
        elif entry[1] == 2:
            self.streams[path + entry[0]] = entry
        self._walk(entry[3], path, seen)

    def read(self, path: str) -> bytes:
        *_, start, size = self.streams[path]
        if size < self.cutoff:
            piece = lambda n: self.mini[n * self.mini_size : (n + 1) * self.mini_size]
            return self._chain(start, self.mini_fat, piece)[:size]
        return self._chain(start, self.fat, self._sector)[:size]


def records(data: bytes):
    """(tag, level, body) of each record: a 32-bit head of tag, level and size, and the size again if it is 4095."""
    at = 0
    while at + 4 <= len(data):
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        if at + size > len(data):
            raise ValueError("record beyond its section")
        yield head & 0x3FF, head >> 10 & 0x3FF, data[at : at + size]
        at += size


def plain(body: bytes) -> str:
    units, out, i = struct.unpack(f"<{len(body) // 2}H", body[: len(body) // 2 * 2]), [], 0
    while i < len(units):
        u = units[i]
        if u >= 32:
            out.append(u)
        elif u == 9:
            out.append(9)
        elif u in (10, 13):
            out.append(10)
        i += 1 if u >= 32 or u in SINGLE else 8
    return struct.pack(f"<{len(out)}H", *out).decode("utf-16-le", "replace").strip()


def section(data: bytes) -> tuple[list[str], list[dict]]:
    """Paragraphs outside tables, and tables with their cells, of one section."""
    paragraphs, tables, open_ = [], [], []
    for tag, level, body in records(data):
        if level > 4 * MOST_LEVEL:
            raise ValueError("nested too deeply")
        while open_ and level <= open_[-1]["level"] and tag in (TEXT, CONTROL, LIST) and not (tag == LIST and level == open_[-1]["level"] + 1):
            open_.pop()
        if tag == CONTROL and body[:4] == b" lbt":
            table = {"level": level, "cells": [], "nested": bool(open_)}
            for outer in open_:
                outer["nested"] = True
            tables.append(table)
            open_.append(table)
        elif tag == LIST and open_ and len(body) >= 16:
            col, row, colspan, rowspan = struct.unpack_from("<HHHH", body, 8)
            open_[-1]["cells"].append({"row": row, "col": col, "rowspan": max(1, rowspan), "colspan": max(1, colspan), "text": "", "header": row == 0})
        elif tag == TEXT:
            words = plain(body)
            if open_ and open_[-1]["cells"]:
                for table in open_:
                    if table["cells"]:
                        table["cells"][-1]["text"] = f"{table['cells'][-1]['text']} {words}".strip()
            elif words:
                paragraphs.append(words)
    return paragraphs, tables


def document(data: bytes) -> dict:
    """status, paragraphs and tables of a compound word-processor file; encrypted files need another parser."""
    file = Compound(data)
    head = file.read("FileHeader")
    (flags,) = struct.unpack_from("<I", head, 36)
    if flags & 2:
        return {"status": "needs_parser", "error": "encrypted", "paragraphs": [], "tables": []}
    paragraphs, tables = [], []
    names = sorted((n for n in file.streams if re.fullmatch(r"BodyText/Section\d+", n)), key=lambda n: int(re.search(r"\d+$", n)[0]))
    for name in names:
        raw = file.read(name)
        if flags & 1:
            opened = zlib.decompressobj(-15)
            raw = opened.decompress(raw, MOST_INFLATED)
            if opened.unconsumed_tail:
                raise ValueError("section too large")
        more, found = section(raw)
        paragraphs += more
        tables += found
    for t in tables:
        t.pop("level")
        t["rows"] = max((c["row"] + c["rowspan"] for c in t["cells"]), default=0)
        t["cols"] = max((c["col"] + c["colspan"] for c in t["cells"]), default=0)
    return {"status": "extracted", "error": None, "paragraphs": paragraphs, "tables": tables}
