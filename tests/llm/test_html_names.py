"""Names of boilerplate as whole names, menus by their paths, and whole texts of the test pages against plain splitting."""

import re

import pytest

from flowlens.llm import html_extract

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string, html string, host string, menus string, template string"


def extract(spark, pages):
    return {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame([(*p, None, None, None) for p in pages], PAGES)).collect()}


LONG = "A long paragraph of the article about the matter at hand. " * 6
CASES = [
    ("<article><section id='alert-systems'><h2>Alert systems</h2><p>How alerts work</p></section><p class='ad-hoc'>ad hoc para</p></article>", "Alert systems\n\nHow alerts work\n\nad hoc para"),
    ("<article><p id='comment-policy'>Our policy</p></article>", "Our policy"),
    ("<article><p>x <button>b</button> y</p></article>", "x y"),
    ("<article><p>x <span class='share'>tell <b>all</b></span> y</p><p>z<svg><text>s</text></svg>w</p></article>", "x y\n\nzw"),
    ("<article><p>x <span class='share'>a <span>b</span> c</span> y <span>z</span></p><p>q <em class='promo'>r</p><p>s</p></article>", "x y z\n\nq\n\ns"),
    ("<article><p>a</p><div class='ad'>Buy now</div><p>b</p><div class='ad-slot left'>Buy</div><div class='adSlot_300'>Buy</div></article>", "a\n\nb"),
    ("<article><p>a</p><div class='widget'>" + LONG + "</div></article>", "a\n\n" + LONG.strip()),
    ("<article><p>a</p><div class='related'><p>b</p></div><ul class='share-links'>" + "<li><a href=x>Share this with all of your friends and more</a>" * 8 + "</li></ul></article>", "a\n\nb"),
    ("<article><p>a</p><div class='comments'><p>" + LONG + "</p></div><div id='comment-12'>" + LONG + "</div></article>", "a"),
    ("<body><div class='site-header'>h</div><div class='content'><p>a</p></div><div id='sidebar-left'>" + LONG + "</div><div class='cookie-banner'>c</div><p class='notice-period'>Two months</p></body>", "a\n\nTwo months"),
    ("<p>a <a href=x>link</a> b</p><p><a href=y>all of it</a></p>", "a link b\n\nall of it"),
]


def test_names(spark):
    got = extract(spark, [(i, f"http://h{i}.example/", html) for i, (html, _) in enumerate(CASES)])
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, i


def blocks(html):
    """The article of a test page, by plain splitting."""
    article = re.search(r"(?s)<article>(.*)</article>", html)[1]
    parts = (html_extract.clean(re.sub(r"<[^>]*>", "", part.replace("<br>", "\n"))) for part in re.split(r"</?(?:p|h1)>", article))
    return "\n\n".join(p for p in parts if p)


@pytest.fixture(scope="module")
def pages(spark):
    return [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]


def test_whole_texts(spark, pages):
    assert {r.page_id: r.text for r in html_extract.op6_html_extract(spark, SF).collect()} == {i: blocks(h) for i, _, h in pages}


def test_texts_without_declared_articles(spark, pages):
    plain = [(i, u, h.replace("<article>", "<div>").replace("</article>", "</div>")) for i, u, h in pages]
    assert extract(spark, plain) == {i: blocks(h) for i, _, h in pages}


def test_menus_without_tags_of_their_own(spark, pages):
    """Neither articles nor menus are declared: of hosts with pages enough the menus' paths are known by their links."""
    hosts: dict = {}
    for i, _, h in pages:
        hosts.setdefault(i % 20, []).append(i)
    strip = lambda h: h.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>")
    got = extract(spark, [(i, f"http://h{i % 20}.example/{i}", strip(h)) for i, _, h in pages])
    assert all(len(x) >= html_extract.MIN_PAGES for x in hosts.values())
    assert got == {i: blocks(h) for i, _, h in pages}
