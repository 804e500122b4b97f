"""A plain form of HTML extraction for tests: a tree of elements, walked page by page."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

from verbatix.functions.text import SPACE
from verbatix.sources.html import BLOCKS, CLOSED_BY, CONTAINERS, DROP_CLASSES, DROP_ROLES, DROP_TAGS, ENTITIES, LEAST_CONTENT, NOISE, VOID


def decode_entities(text: str) -> str:
    for pattern, to in ENTITIES:
        text = re.sub(pattern, to, text)
    text = re.sub("&#([0-9]+);", lambda m: _code_point(m[1], 10), text)
    return re.sub("(?i)&#x([0-9a-f]+);", lambda m: _code_point(m[1], 16), text)


def _code_point(digits: str, base: int) -> str:
    """U+FFFD for a surrogate and for what lies beyond Unicode."""
    digits = digits.lstrip("0") or "0"
    point = int(digits, base) if len(digits) <= 7 else 0x110000
    return chr(point) if point < 0xD800 or 0xE000 <= point <= 0x10FFFF else "\ufffd"


class Element:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Element | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            one = stack.pop()
            yield one
            stack += [c for c in reversed(one.children) if isinstance(c, Element)]

    def text(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            one = stack.pop()
            if isinstance(one, Element):
                stack += reversed(one.children)
            else:
                out.append(one)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def is_dropped(self) -> bool:
        return self.tag in DROP_TAGS or self.attributes.get("role") in DROP_ROLES or any(c in DROP_CLASSES for c in self.classes())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = self.at = Element("", {}, None)
        self.open: Counter[str] = Counter()  # elements between the root and here, by tag

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        if self.at.tag in CLOSED_BY and tag in CLOSED_BY[self.at.tag]:
            self.leave()
        one = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(one)
        if tag not in VOID:
            self.at = one
            self.open[tag] += 1

    def leave(self) -> str:
        tag = self.at.tag
        self.open[tag] -= 1
        self.at = self.at.parent
        return tag

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        if self.open[tag]:  # else it closes nothing
            while self.leave() != tag:
                pass

    def handle_data(self, data):
        self.at.children.append(data)

    def handle_entityref(self, name):
        self.at.children.append(f"&{name};")

    def handle_charref(self, name):
        self.at.children.append(f"&#{name};")


def _matcher(selector: str) -> Callable[[Element], bool]:
    if " " in selector:
        outer, inner = selector.split(" ")

        def below(e: Element) -> bool:
            parent = e.parent
            while e.tag == inner and parent is not None:
                if parent.tag == outer:
                    return True
                parent = parent.parent
            return False

        return below
    if selector[0] == ".":
        return lambda e: selector[1:] in e.classes()
    if selector[0] == "#":
        return lambda e: e.attributes.get("id") == selector[1:]
    if selector[0] == "[":
        name, value = selector[1:-1].split("=")
        return lambda e: e.attributes.get(name) == value
    return lambda e: e.tag == selector


_CONTAINERS = [_matcher(s) for s in CONTAINERS]
_NOISE = [re.compile(p) for p in NOISE]
_SPACES = re.compile(SPACE + "+")


def _tidy(text: str) -> str:
    return _SPACES.sub(" ", decode_entities(text)).strip(" ")


def html_to_text(html: str) -> tuple[str, str]:
    """(title, text) of one page."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    for one in [tree.root, *tree.root.elements()]:
        one.children = [c for c in one.children if not isinstance(c, Element) or not c.is_dropped()]
    everything = list(tree.root.elements())
    with_blocks = set()  # elements that have a block below
    for one in reversed(everything):
        if one.tag in BLOCKS or one in with_blocks:
            with_blocks.add(one.parent)
    first = lambda test: next(filter(test, everything), None)
    title = first(lambda e: e.tag == "title")
    found = [f for f in map(first, _CONTAINERS) if f is not None and len(f.text().strip()) > LEAST_CONTENT]
    content = (found + [first(lambda e: e.tag == "body"), tree.root])[0] or tree.root
    lines: list[str] = []
    stack = [c for c in reversed(content.children) if isinstance(c, Element)]
    while stack:
        one = stack.pop()
        if one.tag in BLOCKS and one not in with_blocks:
            text = _tidy(one.text())
            if text and not any(p.search(text) for p in _NOISE):
                lines += [text, ""] if one.tag[0] == "h" and len(one.tag) == 2 else [text]
        else:
            stack += [c for c in reversed(one.children) if isinstance(c, Element)]
    return _tidy(title.text()) if title else "", re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()
