"""Main content of HTML pages as Markdown: a small tree from the standard library's parser, pruned and scored."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.rx import WS

#: Elements that hold no main text.
NOISE = (
    "script", "style", "noscript", "svg", "canvas", "iframe", "form", "button", "input", "select", "textarea", "nav",
    "footer", "header", "aside",
)
#: Elements that become blocks, and those that may be the container.
BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li")
CONTAINERS = ("main", "article", "section", "div")
#: What speaks for main text, and for junk, in an element's attributes.
LEGAL = re.compile(r"(terms?|conditions?|agreement|policy|privacy|legal|content|article|main|document)")
JUNK = re.compile(
    r"(cookie|banner|popup|modal|subscribe|newsletter|advert|ads|breadcrumb|sidebar|menu|navigation|promo|social|share)"
)
#: Roles that are never main text.
NOISE_ROLES = ("navigation", "banner", "contentinfo")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
MIN_TEXT = 200
MIN_EXTRACTED = 400

_WS = re.compile(f"{WS}+")
_LEAD = re.compile(r"^[#\-\s]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """Elements below this one in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self) -> str:
        """Stripped strings below this element, joined by blanks, white space collapsed."""
        parts, stack = [], list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, Node):
                stack.extend(reversed(item.children))
            elif item.strip():
                parts.append(item.strip())
        return _WS.sub(" ", " ".join(parts)).strip()

    def hints(self) -> str:
        return " ".join(v for k in ("id", "class", "role", "aria-label") if (v := self.attrs.get(k))).lower()


class _Tree(HTMLParser):
    """Elements nest as they are opened; an end tag closes up to the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def _noise(node: Node) -> bool:
    if node.tag in NOISE or node.attrs.get("role") in NOISE_ROLES or node.attrs.get("aria-hidden") == "true":
        return True
    hints = node.hints()
    return bool(JUNK.search(hints)) and not LEGAL.search(hints)


def prune(root: Node) -> None:
    """Drop the subtrees of noise."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if not (isinstance(c, Node) and _noise(c))]
        stack.extend(c for c in node.children if isinstance(c, Node))


def score(node: Node) -> int:
    """How much an element looks like the container of the main text; -1 under MIN_TEXT characters."""
    text = len(node.text())
    if text < MIN_TEXT:
        return -1
    headings = blocks = links = 0
    for n in node.walk():
        headings += n.tag in BLOCKS[:6]
        blocks += n.tag in ("p", "li")
        if n.tag == "a":
            links += len(n.text())
    bonus = 1000 * (node.tag in ("main", "article")) + 1000 * (node.attrs.get("role") == "main") + 700 * bool(LEGAL.search(node.hints()))
    return text + 80 * min(headings, 20) + 25 * min(blocks, 80) + bonus - int(text * (links / text) * 1.5)


def _blocks(container: Node) -> list[str]:
    out: list[str] = []
    last = ""
    inside: set[int] = set()
    for n in container.walk():
        if id(n.parent) in inside or n.parent is not container and n.parent is not None and n.parent.tag in BLOCKS:
            inside.add(id(n))
            continue
        if n.tag not in BLOCKS or not (text := n.text()):
            continue
        block = "#" * int(n.tag[1]) + " " + text if n.tag[0] == "h" else "- " + text if n.tag == "li" else text
        plain = _LEAD.sub("", block).lower()
        if plain != last:
            out.append(block)
            last = plain
    return out or [t for t in [container.text()] if t]


def extract(html: str | None, url: str | None, day: str) -> dict:
    """title, markdown, char_count, word_count, status of a page: ok, empty, no_container or too_short. Counts are those
    of the container's text."""
    none = {"title": "", "markdown": "", "char_count": 0, "word_count": 0}
    if not html or not html.strip():
        return none | {"status": "empty"}
    tree = _Tree()
    tree.feed(html)
    tree.close()
    titles = [n for n in tree.root.walk() if n.tag == "title"][:1]
    title = ""
    if titles and len(titles[0].children) == 1 and isinstance(titles[0].children[0], str):
        title = _WS.sub(" ", titles[0].children[0]).strip()
    prune(tree.root)
    nodes = list(tree.root.walk())
    choice = [n for n in nodes if n.tag in CONTAINERS] + [n for n in nodes if n.tag == "body"][:1]
    best = max(choice, key=score, default=None)
    if best is None or score(best) < 0:
        return none | {"title": title, "status": "no_container"}
    text = best.text()
    blocks = _blocks(best)
    if title and blocks and _LEAD.sub("", blocks[0]).strip().lower() == title.lower():
        blocks = blocks[1:]
    parts = [f"# {title or 'Extracted user agreement'}", f"_Source: {url}_", f"_Retrieved: {day}_", *blocks]
    size = {"title": title, "char_count": len(text), "word_count": len(text.split())}
    if len(text) < MIN_EXTRACTED:
        return none | size | {"status": "too_short"}
    return size | {"markdown": "\n\n".join(parts).strip() + "\n", "status": "ok"}


def extract_pages(pages: DataFrame, day: str) -> DataFrame:
    """Adds the extraction's columns to pages (html, url); one Arrow pass, an error is a status and never fails the job."""

    @F.pandas_udf("title string, markdown string, char_count long, word_count long, status string")
    def run(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        columns = ["title", "markdown", "char_count", "word_count", "status"]
        return pd.DataFrame([extract(h, u, day) for h, u in zip(html, url)], columns=columns)

    return pages.withColumn("_page", run("html", "url")).select("*", "_page.*").drop("_page", "html")
