"""A page as a tree of elements, with the few selectors that stored boards and posts are read by."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from tidemill.sources.html import VOID

#: An element that begins ends an open one of these kinds, unless one of the fences stands between.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
RAW = {"script", "style"}
_PART = re.compile(r"([\w*-]+)?((?:[#.][\w-]+|\[[\w-]+(?:=\"[^\"]*\")?\])*)$")
_MARK = re.compile(r"([#.])([\w-]+)|\[([\w-]+)(?:=\"([^\"]*)\")?\]")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """All elements below, in order; a stack, so that depth is no limit."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def text(self) -> str:
        """All text below but that of scripts and styles, runs of white space as one blank."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in RAW:
                stack += reversed(node.children)
        return " ".join(" ".join(parts).split())

    def within(self, *tags: str) -> "Node | None":
        """The nearest element around of the first kind that there is one of."""
        for tag in tags:
            node = self.parent
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None:
                return node
        return None

    def matches(self, part: str) -> bool:
        found = _PART.match(part)
        if not found or (found[1] and found[1] not in ("*", self.tag)):
            return False
        for mark, name, key, value in _MARK.findall(found[2]):
            if mark == "#" and self.attrs.get("id") != name or mark == "." and name not in (self.attrs.get("class") or "").split():
                return False
            if key and (key not in self.attrs or value and self.attrs[key] != value):
                return False
        return True

    def select(self, selector: str) -> list["Node"]:
        """Elements that meet one of the comma-separated selectors; blanks within one mean inside of."""
        chains = [s.split() for s in selector.split(",")]
        return [n for n in self.walk() if any(n._below(c) for c in chains)]

    def _below(self, chain: list[str]) -> bool:
        if not chain or not self.matches(chain[-1]):
            return False
        node, rest = self.parent, chain[:-1]
        while rest and node is not None:
            if node.matches(rest[-1]):
                rest = rest[:-1]
            node = node.parent
        return not rest

    def html(self, without: frozenset = frozenset()) -> str:
        """The element as HTML, elements of the kinds `without` left out."""
        from html import escape

        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif isinstance(node, tuple):
                out.append(f"</{node[0]}>")
            elif node.tag not in without:
                out.append(f"<{node.tag}" + "".join(f' {k}="{escape(v or "", quote=True)}"' for k, v in node.attrs.items()) + ">")
                if node.tag not in VOID:
                    stack.append((node.tag,))
                    stack += [escape(c, quote=False) if isinstance(c, str) else c for c in reversed(node.children)]
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            ended, fences = ENDS[tag]
            node, last = self.at, None
            while node is not None and node.tag not in fences:
                last = node if node.tag in ended else last
                node = node.parent
            if last is not None:
                self.at = last.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
