"""Article fields and links from raw HTML pages.

Fields are found by class selectors, inside a parsed page: nested noise blocks
go whole, attribute order and quoting do not matter.  Where a page has none of
the classes, the general elements stand in (heading, opening bold text, page
language, footer credit, menu links, paragraphs of the article).

A page is one row and is parsed once, in Arrow batches, with the standard
library's tokenizer; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as FV

FIELDS = ("title", "lead", "category", "date", "author", "provider", "tags", "body", "url")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NO_TEXT = frozenset(("script", "style", "template"))
_BLOCK = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr main nav ol p pre section table ul".split())


class _Node:
    __slots__ = ("tag", "attrs", "classes", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = frozenset((attrs.get("class") or "").split())
        self.children: list = []        # nodes and texts in page order


class _Page(HTMLParser):
    """A tolerant tree: a block ends an open paragraph, a stray end tag is ignored."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.feed(text)
        self.close()

    def _close(self, tags) -> None:
        node = self.at
        while node.parent is not None and node.tag not in tags:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            node = self.at
            while node.parent is not None and node.tag not in ("p", "article", "div", "section", "body", "td"):
                node = node.parent
            if node.tag == "p":
                self.at = node.parent
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        self._close((tag,))

    def handle_data(self, data):
        self.at.children.append(data)


def _walk(node: _Node) -> Iterator[_Node]:
    """Elements below ``node`` in page order, noise blocks left out; no recursion."""
    todo = [c for c in reversed(node.children) if isinstance(c, _Node)]
    while todo:
        n = todo.pop()
        if n.classes.isdisjoint(FV.NOISE_CLASSES):
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, _Node))


def _text(node: _Node, until: tuple[str, ...] = ()) -> str:
    """Visible text, white space collapsed; stops before an ``until`` element."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag in until:
            break
        elif c.tag not in _NO_TEXT and c.classes.isdisjoint(FV.NOISE_CLASSES):
            if c.tag in _BLOCK or c.tag in ("br", "li", "td", "th", "tr"):
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(c.children))
    return " ".join("".join(out).split())


def _by_class(node: _Node, name: str) -> list[_Node]:
    return [n for n in _walk(node) if name in n.classes]


def _by_tag(node: _Node, tag: str) -> list[_Node]:
    return [n for n in _walk(node) if n.tag == tag]


def _first_text(nodes: list[_Node]) -> str:
    return _text(nodes[0]) if nodes else ""


def _inside(outer: list[_Node], pick) -> list[_Node]:
    return [n for o in outer for n in pick(o)]


def article_record(html: str, url: str | None) -> dict[str, str]:
    """The nine kept keys of one page, absent -> ''; tags are pipe-joined."""
    root = _Page(html).root
    article = _by_tag(root, "article")[:1]
    titles = _by_class(root, "article-title") or _by_tag(root, "h1")
    leads = _by_class(root, "article-lead")
    if leads:
        lead = _text(leads[0])
    else:
        bold = _inside(article, lambda a: _by_tag(a, "b"))
        lead = _text(bold[0], until=("br", "p")) if bold else ""
    keyword = _inside(_by_class(root, "article-keyword"), lambda k: _by_class(k, "keyword-text"))
    page = _by_tag(root, "html")
    category = _text(keyword[0]) if keyword else (page[0].attrs.get("lang", "") if page else "")
    credit = _by_class(root, "provider")
    if credit:
        provider = re.sub(r"^,\s*", "", _text(credit[0]))
    else:
        footer = _first_text(_by_tag(root, "footer"))
        provider = re.sub(r"^©\s*|^,\s*", "", footer.split("·")[0].strip())
    topics = _by_class(root, "related-topics") or _by_tag(root, "nav")[:1]
    tags = [t for t in map(_text, _inside(topics, lambda n: _by_tag(n, "a"))) if t]
    bodies = _by_class(root, "article-body") or article
    body = [t for t in map(_text, _inside(bodies, lambda n: _by_tag(n, "p"))) if t]
    return {
        "title": _first_text(titles), "lead": lead, "category": category,
        "date": _first_text(_inside(_by_class(root, "article-date"), lambda n: _by_tag(n, "span"))),
        "author": _first_text(_by_class(root, "author-name-text")),
        "provider": provider, "tags": "|".join(tags), "body": "\n\n".join(body), "url": url or "",
    }


def article_links(html: str) -> list[str]:
    """Targets of the teasers that carry a date; on a page without teasers, of
    all links with a visible label.  Unique, in page order."""
    root = _Page(html).root
    teasers = _by_class(root, "teaser")
    if teasers:
        dated = [t for t in teasers if _first_text(_by_class(t, "teaser-published-date"))]
        links = [a for t in dated for a in _by_tag(t, "a")[:1]]
    else:
        links = [a for a in _by_tag(root, "a") if _text(a)]
    return list(dict.fromkeys(a.attrs["href"] for a in links if a.attrs.get("href")))


def page_fields(pages: DataFrame, html: str = "html", url: str = "url",
                key: str = "page_id") -> DataFrame:
    """A17 + B22/B23: the nine kept keys of each page's article; a NULL page
    has empty fields."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [article_record(h or "", u) for h, u in
                    zip(batch.column("_html").to_pylist(), batch.column("_url").to_pylist())]
            yield pa.record_batch([batch.column("_key"), *[pa.array([r[f] for r in rows], pa.string())
                                                            for f in FIELDS]], names=[key, *FIELDS])

    src = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"), F.col(url).alias("_url"))
    return src.mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{f} string" for f in FIELDS))


def page_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """One row per page and link target."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [article_links(h or "") for h in batch.column("_html").to_pylist()]
            yield pa.record_batch([batch.column("_key"), pa.array(links, pa.list_(pa.string()))],
                                  names=[key, "_links"])

    src = pages.select(F.col(key).alias("_key"), F.col(html).alias("_html"))
    found = src.mapInArrow(run, f"`{key}` {kind}, _links array<string>")
    return found.select(key, F.explode("_links").alias("href"))
