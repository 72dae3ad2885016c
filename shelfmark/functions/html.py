"""A small HTML tree on the standard library."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

# Elements that have no content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None = None
    children: list = field(default_factory=list)
    #: Elements among the children, and this one's place among its parent's.
    elements: list = field(default_factory=list)
    place: int = 0

    def walk(self):
        for child in self.children:
            if isinstance(child, Element):
                yield child
                yield from child.walk()

    def text(self) -> str:
        out = []
        for child in self.children:
            if isinstance(child, Element):
                out.append(child.text())
            elif child.strip():
                out.append(child.strip())
        return " ".join(x for x in out if x)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag, attrs):
        made = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        made.place = len(self.at.elements)
        self.at.children.append(made)
        self.at.elements.append(made)
        if tag not in VOID:
            self.at = made

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Element:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root
