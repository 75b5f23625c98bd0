"""Main text of web pages by composite text density (operator 9).

A page is parsed into block nodes (inline formatting belongs to its block).
For every node with ``C`` characters, ``T`` tags, ``LC`` link characters and
``LT`` link tags below it, the composite density is

    C / T * log(C / LC * T / LT) / log(ln(C / (C - LC) * LC + LCb / Cb * C + e))

with ``b`` for the body and zero divisors read as one.  The node with the
largest sum of its children's densities heads the main text; the least density
on its path up to the body is the threshold.  From the body down, a node at or
above the threshold contributes the largest-sum subtree below it, and the
search goes on in what that subtree leaves.

Elements that hold no article text by their kind (menus, page headers,
footers, sidebars, scripts, styles) are left out of the tree first.  Forms, and
elements with a noise word in their class, id or role (adverts, notices,
comments, ...), are only marked: a compound that tells of a state (has-sidebar,
no-sidebar, comment-enabled) is no mark, and a marked element stays, for the
density to judge, if an article or main element in it is at least as long as
the longest one outside all marks, or if it holds most of the text outside
links.  The second holds neither beside an article or main element with text
of its own, nor for comments on a page with other text.  Inside an article
words like "related" or "social" count only as a whole class, and an element
so marked stays if it is running text (``SOFT_CHARS`` characters outside links,
and twice those inside).

Defined cases: a null or empty page, or one without text, gives an empty
text; truncated pages give the text up to the cut; repeated rows give repeated
results; an empty table gives an empty result; extra columns are ignored.
Parsing is a loop over tags, linear in the page, without recursion.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, read

STRICT_TAG = re.compile(r"""</?[a-zA-Z](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
LOOSE_TAG = re.compile(r"</?[a-zA-Z][^>]*>")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKS = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\shidden(?=[\s>/=])""", re.I)
MARK_WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp select".split())
#: Without an end tag these run to the page's end; of the others only the start tag goes.
TO_END = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
NO_TEXT = frozenset("nav footer aside menu dialog button head".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
#: Opening one of these ends an open one of the same family.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
            "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot div section article body".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent notice notices "
    "gdpr newsletter subscribe subscription share sharing social related comment comments disqus respond "
    "popup modal overlay login signup search pagination pager toolbar widget contentinfo".split())


#: In a compound, these tell of the page's state and not of what the element holds.
STATE_WORDS = frozenset("has have no not non with without enabled disabled open closed".split())
COMMENT_WORDS = frozenset("comment comments disqus respond".split())
#: Inside an article these name text as often as page parts: there they count
#: only as a whole class (with words that say no more than "box"), and the
#: element's own text decides.
SOFT_WORDS = frozenset("social share sharing related widget toolbar pagination pager popup modal overlay".split())
BOX_WORDS = frozenset("area bar block box button buttons container content inner item items links list panel section "
                      "text top bottom left right wrap wrapper".split())
SOFT_CHARS = 80


def is_noise(name: str, tag: str, in_article: bool) -> bool:
    """Whether an element holds no article text by its kind."""
    return name in NO_TEXT or (name == "header" and not in_article) or bool(HIDDEN.search(tag))


def noise_marks(name: str, tag: str, in_article: bool) -> set[str]:
    """The words by which an element may be noise; empty if there is none."""
    found = marks(tag, in_article) if "=" in tag and name not in ("body", "html", "main") else set()
    if name == "article":
        return found & {"comment"}
    noise = found & NOISE_WORDS
    if "header" in found and not in_article:
        noise.add("header")
    if name == "form":
        noise.add("form")
    return noise


def marks(tag: str, in_article: bool = False) -> set[str]:
    words: set[str] = set()
    for m in MARKS.finditer(tag):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            found = set(MARK_WORD.findall(token))
            if not STATE_WORDS.isdisjoint(found):
                continue
            if in_article and not found <= NOISE_WORDS | BOX_WORDS:
                found -= SOFT_WORDS
            words |= found
    return words


class Tree:
    """Block nodes in page order with their texts; node 0 is the body."""

    def __init__(self, page: str):
        self.parent, self.links, self.last = [-1], [0], [0]
        self.pieces: list[tuple[int, str, bool]] = []   # node, raw text, in a link
        self.marked: dict[int, set[str]] = {}           # node, its noise words
        self.articles: set[int] = set()                 # article and main elements without marks
        self._read(page)
        if self.marked:
            self._drop(self._noise())

    def _read(self, page: str) -> None:
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements: name, node
        skip: list[str] = []                          # open elements inside a left-out one
        unended: set[str] = set()                     # RAW names without an end tag from here on
        link, articles = 0, 0
        tag_at, pos, n = STRICT_TAG, 0, len(page)
        parent, links, pieces, marked = self.parent, self.links, self.pieces, self.marked

        def close(depth: int) -> None:
            nonlocal link, articles
            for name, _ in stack[depth:]:
                link -= name == "a"
                articles -= name in ("article", "main")
            del stack[depth:]

        while pos < n:
            lt = page.find("<", pos)
            if lt < 0:
                lt = n
            if lt > pos and not skip:
                pieces.append((stack[-1][1], page[pos:lt], link > 0))
            if lt == n:
                break
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                pos = n if end < 0 else end + 3
                continue
            if page[lt + 1:lt + 2] in ("!", "?"):
                end = page.find(">", lt)
                pos = n if end < 0 else end + 1
                continue
            m = tag_at.match(page, lt)
            if not m and tag_at is STRICT_TAG and page[lt + 1:lt + 2].isalpha():
                tag_at = LOOSE_TAG          # an open quote: from here on a tag ends at the next >
                m = tag_at.match(page, lt)
            if not m:
                nxt = page[lt + 1:lt + 2]
                if nxt.isalpha() or nxt == "/":
                    end = page.find(">", lt)
                    pos = n if end < 0 else end + 1   # cut inside a tag: not text
                else:
                    if not skip:
                        pieces.append((stack[-1][1], "<", link > 0))
                    pos = lt + 1
                continue
            tag, pos = m[0], m.end()
            name = NAME.match(tag)[1].lower()
            if tag[1] == "/":
                if skip:
                    if name in skip:
                        del skip[len(skip) - 1 - skip[::-1].index(name):]
                    elif name in ("body", "html", "article", "main", "section") and any(
                            s[0] == name for s in stack):
                        skip.clear()
                    else:
                        continue
                    if skip:
                        continue
                    if name in ("body", "html"):
                        continue
                    if not any(s[0] == name for s in stack[1:]):
                        continue
                    if name not in ("article", "main", "section"):
                        continue
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == name), 0)
                if depth:
                    close(depth)
                continue
            if name in RAW:
                if not tag.endswith("/>") and name not in unended:
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, pos)
                    if not end:
                        if name in TO_END:
                            break
                        unended.add(name)
                        continue
                    gt = page.find(">", end.end())
                    pos = n if gt < 0 else gt + 1
                continue
            if skip:
                if name in ("article", "main") and skip[0] in ("nav", "header", "footer", "aside", "head") \
                        and "comment" not in marks(tag):
                    skip.clear()            # an element left open before the article
                elif name == "body" and skip[0] == "head":
                    skip.clear()
                    continue
                else:
                    if name not in VOID:
                        skip.append(name)
                    continue
            if name in ("html", "body"):
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    pieces.append((stack[-1][1], "\n", False))
                continue
            if name in CLOSES_P:
                depth = next((i for i in range(len(stack) - 1, 0, -1)
                              if stack[i][0] == "p" or stack[i][0] in HOLDERS or stack[i][1] in marked), 0)
                if depth and stack[depth][0] == "p":
                    close(depth)
            if name in SIBLINGS:
                depth = next((i for i in range(len(stack) - 1, 0, -1)
                              if stack[i][0] in SIBLINGS[name] or stack[i][0] in HOLDERS
                              or stack[i][1] in marked), 0)
                if depth and stack[depth][0] in SIBLINGS[name]:
                    close(depth)
            if is_noise(name, tag, articles > 0):
                if not tag.endswith("/>"):
                    skip.append(name)
                continue
            node, noise = stack[-1][1], noise_marks(name, tag, articles > 0)
            if noise and tag.endswith("/>"):
                continue
            if noise or name not in INLINE:
                parent.append(node)
                links.append(0)
                node = len(parent) - 1
                articles += name in ("article", "main")
                if noise:
                    marked[node] = noise
                elif name in ("article", "main"):
                    self.articles.add(node)
            if name == "a":
                link += 1
                links[node] += 1
            stack.append((name, node))

    def _noise(self) -> set[int]:
        """The marked nodes that do not hold the article."""
        parent, n = self.parent, len(self.parent)
        whole, free, inner = [0] * n, [0] * n, [0] * n  # text outside links; also outside marks; longest article
        linked = [0] * n
        under, inside = [False] * n, [False] * n        # in a marked node; in an article or main element outside marks
        for i in range(1, n):
            under[i] = under[parent[i]] or i in self.marked
            inside[i] = inside[parent[i]] or (i in self.articles and not under[i])
        for node, text, in_link in self.pieces:
            if not in_link:
                size = len(" ".join(text.split()))
                whole[node] += size
                free[node] += 0 if under[node] else size
            else:
                linked[node] += len(" ".join(text.split()))
        for i in range(n - 1, 0, -1):
            p = parent[i]
            if i in self.articles:
                inner[i] = max(inner[i], whole[i])
            whole[p] += whole[i]
            linked[p] += linked[i]
            free[p] += free[i]
            inner[p] = max(inner[p], inner[i])
        rival = max((free[i] for i in self.articles if not under[i]), default=0)
        noise = set()
        for i, words in self.marked.items():
            most = 2 * whole[i] > whole[0] and (inside[i] or not rival) and not (
                free[0] and not COMMENT_WORDS.isdisjoint(words))
            # in an article, running text under a word that need not mean a page part
            prose = inside[i] and words <= SOFT_WORDS and whole[i] >= max(SOFT_CHARS, 2 * linked[i])
            if not (most or prose or inner[i] and inner[i] >= rival):
                noise.add(i)
        return noise

    def _drop(self, noise: set[int]) -> None:
        """Take the nodes and all below them out of the tree."""
        number, parent, links = [0], [-1], [self.links[0]]  # new number of each node, -1 if it goes
        for i in range(1, len(self.parent)):
            up = number[self.parent[i]]
            if up < 0 or i in noise:
                number.append(-1)
                continue
            number.append(len(parent))
            parent.append(up)
            links.append(self.links[i])
        self.parent, self.links = parent, links
        self.pieces = [(number[i], text, in_link) for i, text, in_link in self.pieces if number[i] >= 0]

    def blocks(self) -> list[tuple[int, str, int]]:
        """(node, text, link characters) of each run of text between block borders."""
        out, node, raw, linked = [], None, [], 0
        for at, text, in_link in [*self.pieces, (None, "", False)]:
            if at != node or text == "\n":
                if raw:
                    joined = " ".join(html.unescape("".join(raw)).split())
                    if joined:
                        out.append((node, joined, min(linked, len(joined))))
                node, raw, linked = at, [], 0
            raw.append(text)
            if in_link:
                linked += len(" ".join(html.unescape(text).split()))
        return out


def main_text(page: str) -> str:
    """The main text of one page."""
    tree = Tree(page)
    blocks = tree.blocks()
    if not blocks:
        return ""
    n, parent = len(tree.parent), tree.parent
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, list(tree.links)
    for node, text, linked in blocks:
        chars[node] += len(text)
        link_chars[node] += linked
    last = list(range(n))           # a subtree is the range node..last[node]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        link_chars[p] += link_chars[i]
        tags[p] += tags[i] + 1
        link_tags[p] += link_tags[i]
        last[p] = max(last[p], last[i])
    share = link_chars[0] / chars[0]

    def density(i: int) -> float:
        c, t, lc, lt = chars[i], tags[i] + link_tags[i] or 1, link_chars[i] or 1, link_tags[i] or 1
        if not c:
            return 0.0
        base = math.log(c / ((c - link_chars[i]) or 1) * lc + share * c + math.e)
        return c / t * math.log(max(c / lc * t / lt, 1e-9)) / math.log(base)

    dense = [density(i) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += dense[i]
    # a leaf's children are its own runs of text
    for i in range(n):
        if last[i] == i:
            total[i] = 0.0
    best = max(range(n), key=lambda i: (total[i], chars[i], -i))
    limit, i = dense[best], best
    while i > 0:
        i = parent[i]
        limit = min(limit, dense[i])
    # largest sum in each subtree, bottom up; the first in page order wins a tie
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if (total[top[i]], -top[i]) > (total[top[p]], -top[p]):
            top[p] = top[i]
    content = np.zeros(n, bool)
    todo = [0]
    while todo:
        i = todo.pop()
        if content[i]:
            continue
        if dense[i] >= limit:
            content[top[i]:last[top[i]] + 1] = True
        if not content[i]:
            children = [j for j in _children(i, parent, last)]
            todo.extend(children)
    return " ".join(text for node, text, _ in blocks if content[node])


def _children(i: int, parent: list[int], last: list[int]) -> Iterator[int]:
    j = i + 1
    while j <= last[i]:
        yield j
        j = last[j] + 1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text)`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("html").fill_null("")
            for lo in range(0, len(col), 256):
                texts = [main_text(p) for p in col.slice(lo, 256).to_pylist()]
                yield pa.record_batch([batch.column("id").slice(lo, 256), batch.column("url").slice(lo, 256),
                                       pa.array(texts, pa.string())], names=["id", "url", "text"])

    src = pick(pages, id=id_col, url=url_col, html=html_col).withColumn("id", F.col("id").cast("long"))
    return src.mapInArrow(run, "id long, url string, text string")


def op9_html_text(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages")).select(
        F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
