"""Links of pages with a great many of them."""

from verdantflow.operators import documents


def test_links_beyond_the_fortieth_are_kept(spark):
    html = "".join(f"<a href='/p{k}'>Page {k}</a>" for k in range(200)) + "<a href='/about'>About us</a>"
    pages = spark.createDataFrame([(1, "http://site.com/", html)], "page_id long, url string, html string")
    links = documents.site_links(pages)
    assert links.count() == 201 and documents.site_links(pages, most=40).count() == 40
    assert documents.about_page(links).first().url == "http://site.com/about"
