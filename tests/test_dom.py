"""Selectors on element intervals, and candidates under the rules of their sources."""

import datetime

import pytest

from clipworks.functions import dom
from clipworks.operators import extract

PAGE = """<!DOCTYPE html><html><head><meta name="d" content="<b>"><script>if (a < b) { "<p class='x'>" }</script><title>T</title></head>
<body><!-- <h1>gone</h1> --><div id="main" class="wide news-list"><h1 class='big'>Head <b>line</b></h1><ul><li class=a>one<li class="b">two <i>deep</i></ul>
<p>first<p data-k="v1">second<br>line</div><p class="tail">third</p><img src="x>y"/><span id=s>end</body></html>"""


@pytest.mark.parametrize("selectors, inner", [
    (["h1"], "Head <b>line</b>"), (["div > h1 b"], "line"), (["body > h1"], None), (["#main .b"], "two <i>deep</i>"), (["li.b > i"], "deep"), (["ul > i"], None),
    ([".nothing", "p"], "first"), (["p[data-k]"], "second<br>line"), (["p[data-k=v2], [class$=ail]"], "third"), (["[class*='news']  p[data-k^=v]"], "second<br>line"), (["div p.tail"], None),
    (["body p.tail"], "third"), (["#s"], "end"), (["b, h1"], "Head <b>line</b>"), (["DIV#main.wide.news-list > UL > LI.a"], "one"), (["p.x"], None), (["h1 >"], "Head <b>line</b>"),
    (["p:first-child"], None), ([""], None), (["*"], None),
])
def test_selectors(selectors, inner):
    found = dom.first_match(dom.elements(PAGE), selectors)
    if selectors == ["*"]:
        assert found[4] == "html"
    else:
        assert (found and PAGE[found[2]:found[3]]) == inner


def test_elements_nest():
    page = dom.elements("<div>" * 3000 + "x" + "</div>" * 2999 + "</b>")
    assert len(page) == 3000 and all(a[0] < b[0] and b[1] <= a[1] for a, b in zip(page, page[1:]))
    assert dom.elements("") == [] and dom.elements("<<p") == [] and dom.first_match([], ["p"]) is None


def test_select_first_skips_pages_without_selectors(spark):
    rows = spark.createDataFrame([(1, PAGE, ["h1"]), (2, PAGE, []), (3, PAGE, None), (4, None, ["p"]), (5, PAGE, [None, " ", "i"])], "id int, html string, s array<string>")
    got = {r.id: r.x for r in rows.select("id", dom.select_first("html", "s").alias("x")).collect()}
    assert got == {1: "Head <b>line</b>", 2: None, 3: None, 4: None, 5: "deep"}


def test_candidates_under_source_rules(spark):
    text = "<p>Earth observation mission update for remote sensing programs.</p>"
    pages = spark.createDataFrame([
        (1, 1, "https://a.test/news/1.html", f"<h1>Earth observation mission update</h1><script type=\"application/ld+json\">{{\"datePublished\":\"April 3, 2024 09:15\"}}</script>{text}", None, None, None),
        (2, 1, "https://a.test/news/2.html", f"<h1>Remote sensing article without a date</h1>{text}", None, None, None),
        (3, 1, "https://a.test/news/3.html", f"<h1>Remote sensing article dated by its link</h1>{text}", "https://a.test/moved/3.html", None, "2024-05-06 07:08"),
        (4, 2, "https://b.test/news/4.html", f"<h2 class='t'>Chosen title of the page</h2><h1>Other title of the page</h1><i id='when'>2024-06-07 08:09</i><meta name='PubDate' content='2024-01-01'>{text}", None, None, None),
        (5, 2, "https://b.test/news/5.html", f"<i id='when'>2024-06-07 08:09</i>{text}", None, "Title from the link here", None),
        (6, 9, "https://c.test/news/6.html", f"<h1>Unknown source</h1><i>2024-06-07</i>{text}", None, None, None),
    ], "page_id long, source_id long, url string, html string, final_url string, link_text string, link_date string")
    sources = spark.createDataFrame([(1, "s1", "https://a.test/", "en", None, []), (2, "s2", "https://b.test/", "fr", [".t"], ["#when"])],
                                    "source_id long, source_code string, site_url string, language string, title_selectors array<string>, date_selectors array<string>")
    got = {r.page_id: r for r in extract.source_candidates(pages, sources, ["remote sensing"]).collect()}
    at = {i: r.published_at for i, r in got.items()}
    assert at == {1: datetime.datetime(2024, 4, 3, 9, 15), 3: datetime.datetime(2024, 5, 6, 7, 8), 4: datetime.datetime(2024, 6, 7, 8, 9), 5: datetime.datetime(2024, 6, 7, 8, 9)}
    assert [got[i].title for i in (4, 5)] == ["Chosen title of the page", "Title from the link here"] and got[4].language == "fr"
    assert got[3].url == "https://a.test/moved/3.html" and '"requestedUrl":"https://a.test/news/3.html"' in got[3].payload
