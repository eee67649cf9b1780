"""The wrapper decides inside declared articles too."""

from flowlens.llm import html_extract

PAGES = "page_id long, url string, html string, host string, text string, key string"


def extract(spark, pages):
    return {r.page_id: r.text for r in html_extract.extracted(spark.createDataFrame([(*p, None, None, None) for p in pages], PAGES)).collect()}


def test_template_inside_articles(spark):
    body = "<body><nav>n</nav><article><div>Tell your friends</div><h1>Story {i}</h1><p>Text of {i}</p><p>Written by our staff</p></article></body>"
    pages = [(i, f"http://a.example/{i}", body.replace("{i}", str(i))) for i in range(8)]
    pages += [(100 + i, f"http://few.example/{i}", body.replace("{i}", str(i))) for i in range(3)]
    pages += [(200 + i, "http://copies.example/", body) for i in range(8)]
    got = extract(spark, pages)
    assert all(got[i] == f"Story {i}\n\nText of {i}" for i in range(8))
    assert got[100] == "Tell your friends\n\nStory 0\n\nText of 0\n\nWritten by our staff"  # too few pages to tell
    assert got[200] == "Tell your friends\n\nStory {i}\n\nText of {i}\n\nWritten by our staff"  # copies of one article


def test_articles_that_are_comments(spark):
    pages = [
        (1, "http://b", "<article><p>a</p><article class='comment'>no</article></article><article class='comment'><p>no</p></article>"),
        (2, "http://c", "<main class='has-sidebar'><p>x</p><article><p>a</p></article><article id='comment-3'>no</article></main>"),
        (3, "http://d", "<main class='has-sidebar'><p>a</p></main>"),
    ]
    assert extract(spark, pages) == {1: "a", 2: "a", 3: "a"}
