"""Text and links of broken and odd markup."""

import pytest
from pyspark.sql import functions as F

from verdantflow.functions import text
from verdantflow.operators import documents

NAVIGATION = ("script", "style", "head", "nav", "footer", "header")
PAGES = [
    ("<p>a</p><script>if (1 < 2) { x = '</p>' }", "a"),  # an unclosed script goes on to the end
    ("<p>a<!-- <script> --></p><p>b</p>", "a\nb"),
    ("<script>var s = '<!--';</script><p>a</p>", "a"),
    ("<nav><nav>x</nav>y</nav><p>a</p>", "a"),  # nested
    ("<div><nav><ul><li>x</div><p>a</p>", "a"),  # the holder ends what was left open in it
    ("</nav><p>a</p></footer>b", "a\nb"),  # ends without a beginning
    ("<header class='>'>x</header>a", "a"),
    ("<head><title>t</title><body>a<footer>z", "a"),  # the body ends an open head, a footer goes on to the end
    ("<HEAD>t</HEAD><p title=\"a > b\">q</p>", "q"),
    ("a &lt;b&gt; &amp;lt; &#65;&#x1F600;&#x110000;&euro;&nosuch; &copy 1", "a <b> &lt; A😀�€&nosuch; © 1"),
    ("1 < 2 and <b>3</b> <a href='x", "1 < 2 and 3"),
    ("<p title='open>a</p><p>b</p>", "a\nb"),
    ("", ""),
    (None, None),
]


def test_text_of_odd_markup(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, h string")
    got = {r.i: r.t for r in df.select("i", text.html_text(F.col("h"), NAVIGATION).alias("t")).collect()}
    for i, (html, want) in enumerate(PAGES):
        assert (got[i] and got[i].strip()) == want, html


def test_links_of_odd_markup(spark):
    html = "<!-- <a href='/no'>no</a> --><a href=/plain>Plain</a><a class=x href='/q?a=1&amp;b=2'>Q &amp; A<a href=\"/open\">Open <b>one</b><script>'<a href=/never>x</a>'</script><a hrefx='/bad'>b</a>"
    links = documents.site_links(spark.createDataFrame([(1, "http://s.com/", html)], "page_id long, url string, html string"))
    assert [(r.url, r.text) for r in links.orderBy("pos").collect()] == [("http://s.com/plain", "Plain"), ("http://s.com/q?a=1&b=2", "Q & A"), ("http://s.com/open", "Open one")]


@pytest.mark.parametrize(("path", "rank"), [("/about-us/", 0), ("/who_we_are", 2), ("/x?about", None)])
def test_words_of_a_path_are_parted_by_dashes(spark, path, rank):
    links = spark.createDataFrame([(1, 0, f"http://s.com{path}", "")], "page_id int, pos int, url string, text string")
    assert [r["rank"] for r in documents.about_page(links).collect()] == ([] if rank is None else [rank])
