import html
import math
import random
import re

import pyarrow.parquet as pq
import pytest

from sentibar.llm import html_text as H

LONG = "The quick brown fox jumps over the lazy dog and keeps running through the wide green field. " * 4
ARTICLE = LONG.strip()

CASES = [
    (f"<article><h1>Title</h1><p>{LONG}</p></article>", "Title " + ARTICLE),
    (f"<nav><ul><li><a href=/x>Menu</a></ul></nav><article><p>{LONG}<p>{LONG}</article><footer>&copy; us</footer>",
     ARTICLE + " " + ARTICLE),
    (f"<nav><a href='/a'>open menu<article><p>{LONG}</p></article>", ARTICLE),
    (f"<div class='ad'>Buy now</div><div class=\"x cookie-notice\">We use cookies</div><div>{LONG}</div>", ARTICLE),
    (f"<article><p>{LONG}</p><div id='comments'><p>{LONG}</p></div><form><p>Sign up</p></form></article>", ARTICLE),
    (f"<article><p>a&amp;b &lt;c&gt; caf&eacute; &#8217;&#x2019; x</p><p>{LONG}</p></article>",
     "a&b <c> café ’’ x " + ARTICLE),
    (f"<article><p>one <b>two</b>th<i>ree</i>\n\n four</p><p>{LONG}</p></article>", "one twothree four " + ARTICLE),
    (f"<article><a title='x > y' href=\"/q\">t</a> end<p>{LONG}</p></article>", "t end " + ARTICLE),
    (f"<script>var t='</p><article>no</article>';</script><style>p{{}}</style><body><p>{LONG}</p></body>", ARTICLE),
    (f"<article><p>{LONG}</p><!-- <p>hidden</p> --><aside>side</aside></article>", ARTICLE),
    (f"<ARTICLE><P>{LONG}</P></ARTICLE><FOOTER>x</FOOTER>", ARTICLE),
    (f"<article><p>a < b and 3<4</p><p>{LONG}</p></article>", "a < b and 3<4 " + ARTICLE),
    (f"<article><p>{LONG}</p><p>cut he", ARTICLE + " cut he"),
    (f"<article><p>{LONG}</p><a href='/broken", ARTICLE),
    ("", ""), (None, ""), ("<nav>only menu</nav>", ""), ("plain words", "plain words"), ("<p></p>", ""),
    ("<div>" * 20000 + LONG, ARTICLE), ("<a \"" * 5000 + f"<p>{LONG}</p>", None),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_cases(i):
    page, want = CASES[i]
    got = H.main_text(page or "")
    if want is not None:
        assert got == want


def test_density_picks_the_article_among_plain_divs():
    menu = "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(30))
    page = f"<div><ul>{menu}</ul></div><div><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></div><div>tiny</div>"
    assert H.main_text(page) == " ".join([ARTICLE] * 3)


def test_registered_query_extracts_articles(spark):
    d = "/root/testdata/sf0.01"
    rows = {r["page_id"]: r for r in pq.read_table(f"{d}/pages.parquet").to_pylist()}
    got = H.op9_html_text(spark, d).collect()
    assert len(got) == len(rows)
    for r in got:
        body = re.search(r"<article>(.*)</article>", rows[r.page_id]["html"], re.S)[1]
        text = re.sub("<[^>]*>", "", re.sub(r"<(/?p|/?h1|br)>", "\n", body))
        assert r.text == " ".join(html.unescape(text).split())
        assert (r.url, r.n_chars) == (rows[r.page_id]["url"], len(r.text))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x</p>", "b"), (1, "u", "<p>x</p>", "b")],
                               "page_id long, url string, html string, text string")
    got = sorted((r.id or 0, r.url or "", r.text) for r in H.extract(df).collect())
    assert got == [(0, "u", "x"), (1, "", ""), (1, "u", "x")]
    assert H.extract(df.limit(0)).count() == 0


MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(9)) + "</ul>"
WRAPPED = [
    (f'<div class="content has-sidebar"><p>{LONG}</p></div>', ARTICLE),
    (f'<div id="page" class="no-sidebar"><p>{LONG}</p></div>', ARTICLE),
    (f'<section class="post comment-enabled"><p>{LONG}</p></section>', ARTICLE),
    (f'<article class="post comment-enabled"><p>{LONG}</p></article>', ARTICLE),
    (f"<form id='aspnetForm'><div>{MENU}</div><div><p>{LONG}</p><p>{LONG}</p></div></form>", f"{ARTICLE} {ARTICLE}"),
    (f'<div class="sidebar"><div class="widget"><p>{LONG}</p></div></div>', ARTICLE),
    (f"<div class='sidebar-layout'><article><p>{LONG}</p><div class='share'>Share it</div></article></div>", ARTICLE),
    (f"<main><h1>T</h1><div class='content sidebar-left'><p>{LONG}</p></div></main>", "T " + ARTICLE),
    (f"<article><p>{LONG}</p><div id='comments'><p>{LONG}</p><p>{LONG}</p></div></article>", ARTICLE),
    (f"<article><p>{LONG}</p></article><div class='related'><article>A short teaser</article></div>", ARTICLE),
    (f"<article>Hi</article><div class='ad'>{LONG}</div>", "Hi"),
    (f"<p>one <span class='ad'><div>x</div></span> two</p><p>{LONG}</p>", "one two " + ARTICLE),
]


WRAPPED += [
    (f'<article><p>{LONG}</p><section class="related-work"><p>Others did it.</p></section></article>', ARTICLE + " Others did it."),
    (f'<article><p>{LONG}</p><p class="social">{LONG}</p></article>', f"{ARTICLE} {ARTICLE}"),
    (f'<main><p class="share-holders">{LONG}</p><div class="share-box">Share it</div></main>', ARTICLE),
    (f'<article><p>{LONG}</p><div class="related"><a href=/1>{LONG}</a></div><p>{LONG}</p><p class="ad">Buy {LONG}</p></article>',
     f"{ARTICLE} {ARTICLE}"),
    (f'<article><p>{LONG}</p><div class="social-links"><a href=/f>F</a> <a href=/t>T</a></div></article>', ARTICLE),
]


@pytest.mark.parametrize("i", range(len(WRAPPED)))
def test_marked_wrappers_keep_the_article(i):
    page, want = WRAPPED[i]
    assert H.main_text(page) == want


@pytest.mark.parametrize("name", ["svg", "select", "noscript", "iframe", "template", "xmp"])
def test_element_left_open_does_not_end_the_page(name):
    assert H.main_text(f"<article><p>{LONG}</p><{name}><p>{LONG}</p></article>") == f"{ARTICLE} {ARTICLE}"
    assert H.main_text(f"<article><p>{LONG}</p><{name}>x</{name}><p>{LONG}</p></article>") == f"{ARTICLE} {ARTICLE}"


def test_math_is_text_of_its_paragraph():
    tail = "<p>" + LONG + "</p></article>"
    page = "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>"
    assert H.main_text(page + tail) == "so x=2 holds " + ARTICLE
    assert H.main_text("<article><p>so <math><mi>x</mi></p>" + tail) == "so x " + ARTICLE


def test_text_areas_run_to_the_end():
    for name in ("script", "style", "textarea", "title"):
        assert H.main_text(f"<article><p>{LONG}</p><{name}><p>{LONG}</p></article>") == ARTICLE


# ---- composite densities, threshold and largest sums, from a nested tree ----
def build(rng, depth=0):
    """(name, children); a child is text, ("a", text) or a block."""
    kids = []
    for _ in range(rng.randint(1, 4)):
        r = rng.random()
        if r < 0.35 and depth < 4:
            kids.append(build(rng, depth + 1))
        elif r < 0.5:
            kids.append(("a", "link " + "word " * rng.randint(0, 6)))
        else:
            kids.append("text " * rng.randint(1, 60))
    return (rng.choice(["div", "section", "p" if depth == 4 else "div", "table"]), kids)


def markup(node):
    if isinstance(node, str):
        return node
    if node[0] == "a":
        return f"<a href=/x>{node[1]}</a>"
    return f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def plain_main_text(body):
    def runs(kids):
        """The node's own text between its block children."""
        out = [[]]
        for k in kids:
            if isinstance(k, str) or k[0] == "a":
                out[-1].append(k)
            else:
                out += [k, []]
        return out

    def joined(run):
        return " ".join("".join(k if isinstance(k, str) else k[1] for k in run).split())

    def linked(run):
        return min(sum(len(" ".join(k[1].split())) for k in run if not isinstance(k, str)), len(joined(run)))

    def blocks(node):
        return [k for k in runs(node[1]) if isinstance(k, tuple)]

    def size(node):
        """Characters, link characters, tags and link tags below."""
        own = [r for r in runs(node[1]) if isinstance(r, list)]
        c, lc = sum(len(joined(r)) for r in own), sum(linked(r) for r in own)
        t, lt = 0, sum(1 for r in own for k in r if not isinstance(k, str))
        for k in blocks(node):
            a = size(k)
            c, lc, t, lt = c + a[0], lc + a[1], t + a[2] + 1, lt + a[3]
        return c, lc, t, lt

    whole = size(body)

    def density(node):
        c, lc, t, lt = size(node)
        if not c:
            return 0.0
        t = t + lt or 1
        base = math.log(c / ((c - lc) or 1) * (lc or 1) + whole[1] / whole[0] * c + math.e)
        return c / t * math.log(max(c / (lc or 1) * t / (lt or 1), 1e-9)) / math.log(base)

    def total(node):
        return sum(density(k) for k in blocks(node))

    order = []

    def walk(node, path):
        order.append((node, path))
        for k in blocks(node):
            walk(k, [*path, node])
    walk(body, [])
    if not whole[0]:
        return ""
    best = max(range(len(order)), key=lambda i: (total(order[i][0]), size(order[i][0])[0], -i))
    limit = min(density(x) for x in [order[best][0], *order[best][1]])
    kept = set()

    def below(node):
        return [node, *[x for k in blocks(node) for x in below(k)]]

    def take(node):
        if id(node) in kept:
            return
        if density(node) >= limit:
            top = max(below(node), key=total)        # the first in page order wins
            kept.update(id(x) for x in below(top))
        if id(node) not in kept:
            for k in blocks(node):
                take(k)
    take(body)
    out = []

    def read(node):
        for r in runs(node[1]):
            if isinstance(r, tuple):
                read(r)
            elif joined(r) and id(node) in kept:
                out.append(joined(r))
    read(body)
    return " ".join(out)


def test_equals_a_plain_version_on_random_pages():
    rng = random.Random(12)
    some = 0
    for _ in range(400):
        body = ("body", [build(rng) for _ in range(rng.randint(1, 4))])
        page = "".join(map(markup, body[1]))
        want = plain_main_text(body)
        assert H.main_text(page) == want, page
        some += want != " ".join(re.sub("<[^>]*>", " ", page).split())
    assert some > 50
