"""A small tree of marked-up pages, on the standard library's tokenizer."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

# Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "text", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, text: str = "", up: Node | None = None):
        self.tag, self.attrs, self.text, self.up, self.kids = tag, attrs or {}, text, up, []

    def walk(self) -> Iterator[Node]:
        """All nodes below in document order, without recursion."""
        stack = list(reversed(self.kids))
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))

    def find(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def all_text(self, sep: str = "") -> str:
        parts = [n.text for n in self.walk() if n.tag == "#text"]
        return sep.join(p.strip() for p in parts if p.strip()) if sep else "".join(parts)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.up is not None:
            self.up.kids = [k for k in self.up.kids if k is not self]


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def handle_starttag(self, tag, attrs):
        own: dict[str, str] = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        node = Node(tag, own, up=self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.up

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.up
        if n is not None and n.up is not None:  # an end tag that closes nothing is ignored
            self.at = n.up

    def handle_data(self, data):
        self.at.kids.append(Node("#text", text=data, up=self.at))


def parse(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def select(root: Node, selector: str) -> list[Node]:
    """Nodes for ``tag``, ``#id``, ``.class`` or ``.class.class``."""
    if selector.startswith("#"):
        return [n for n in root.walk() if n.attrs.get("id") == selector[1:]]
    if selector.startswith("."):
        want = set(selector[1:].split("."))
        return [n for n in root.walk() if want <= set(n.classes())]
    return root.find(selector)
