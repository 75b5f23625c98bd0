"""Page fields and links by class selector, on hand-written pages."""

from sentibar.operators import pages as PG

PAGE = """<html lang=en><head><title>no</title><script>var a = "<p>no</p>";</script></head><body>
<nav><a href=/home>Home</a></nav>
<div class='x article-keyword'><span class=keyword-text> Markets </span></div>
<h1 class="article-title big">Shares &amp; bonds<br>rise</h1>
<p class="article-lead">A <b>good</b> day</p>
<div class="article-date"><span>05 Jan 2024</span><span>updated</span></div>
<span class="author-name-text">Jo Doe</span><span class="provider">, Wire</span>
<div class="article-body"><p>One</p><div class="big ad"><div><p>buy</p></div><p>now</p></div><p>Two
 lines<p>Three</div>
<div class="related-topics"><a href="/t1">Oil</a><a href="/t2"> Gas </a><a href="/t3"></a></div>
<div class="teaser"><span class="teaser-published-date">today</span><a href='/a'>x</a><a href="/b">y</a></div>
<div class="teaser"><a href="/c">no date</a></div>
<div class="teaser"><i class="teaser-published-date">1 Jan</i><b><a title="x > y" href=/d>z</a></b></div>
</body></html>"""


def test_fields_by_class():
    assert PG.article_record(PAGE, "http://x/y") == {
        "title": "Shares & bonds rise", "lead": "A good day", "category": "Markets", "date": "05 Jan 2024",
        "author": "Jo Doe", "provider": "Wire", "tags": "Oil|Gas", "body": "One\n\nTwo lines\n\nThree",
        "url": "http://x/y"}


def test_dated_teasers_and_plain_links():
    assert PG.article_links(PAGE) == ["/a", "/d"]
    assert PG.article_links("<a href='/x'>1</a><a href=/y>2</a><a href=\"/z\">3</a><a href=/x>4</a><a href=/n></a>") == ["/x", "/y", "/z"]


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (4, "u", "<div>" * 5000 + "<h1>t")],
                               "page_id long, url string, html string")
    got = {r.page_id: r for r in PG.page_fields(df).collect()}
    assert got[1].title == "" and got[1].url == "" and got[4].title == "t" and len(got) == 4
    assert PG.page_links(df).count() == 0
