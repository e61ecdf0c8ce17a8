"""A small document tree on the standard library's HTML parser, for what regular expressions can't decide."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pages that are Python strings at a time.
AT_ONCE = 64
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass
class Node:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def find_all(self, name: str, css_class: str | None = None) -> list[Node]:
        return [n for n in self.walk() if n.name == name and (css_class is None or css_class in n.classes)]

    def find(self, name: str, css_class: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n.name == name and (css_class is None or css_class in n.classes)), None)

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def get(self, key: str) -> str:
        return self.attributes.get(key, "")

    def above(self, name: str) -> Node | None:
        """The nearest ancestor of that name."""
        node = self.parent
        while node is not None and node.name != name:
            node = node.parent
        return node

    def following(self) -> list[Node | str]:
        """What comes after it in its parent."""
        if self.parent is None:
            return []
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        return self.parent.children[at + 1 :]

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.name not in ("script", "style"):
                yield from child.strings()

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = [s.strip() for s in self.strings()] if strip else list(self.strings())
        return separator.join(p for p in parts if p or not strip)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("[document]")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:  # an end tag without a start is ignored
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup)
    builder.close()
    return builder.root


@contextmanager
def parsed(markup: str) -> Iterator[Node]:
    """The tree of a document that nothing needs afterwards. Elements and their parents hold each other, so else trees would
    stay in memory until Python's collector looks for such rings, which it does less and less often."""
    root = tree(markup)
    try:
        yield root
    finally:
        below = [root]
        while below:
            node = below.pop()
            below += [c for c in node.children if isinstance(c, Node)]
            node.parent, node.children = None, []


def text_function(separator: str = "\n") -> Callable:
    """html_text as a function of Spark. Python holds AT_ONCE pages at a time, not a whole batch."""

    def text(markup: str) -> str:
        with parsed(markup) as root:
            return root.text(separator)

    @F.arrow_udf(T.StringType())
    def joined(pages: pa.Array) -> pa.Array:
        pieces = (pages.slice(i, AT_ONCE).to_pylist() for i in range(0, len(pages), AT_ONCE))
        return pa.concat_arrays([pa.array([], pa.string()), *[pa.array([None if p is None else text(p) for p in piece], pa.string()) for piece in pieces]])

    return joined


def html_text(c: Column, separator: str = "\n") -> Column:
    """All text of a piece of HTML, its strings joined by the separator."""
    return text_function(separator)(c)


def html_rows(c: Column, extract: Callable[[Node], list[dict]], item: str) -> Column:
    """Array of the structs that extract() finds in each document; item is their schema."""

    def found(markup: str) -> list[dict]:
        with parsed(markup) as root:
            return extract(root)

    @F.pandas_udf(f"array<struct<{item}>>")
    def extracted(s: pd.Series) -> pd.Series:
        return s.map(found, na_action="ignore")

    return extracted(c)
