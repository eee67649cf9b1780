"""Levels of any length are aligned whole."""

import random

import pytest

from flowlens.llm import html_extract
from flowlens.llm.html_extract import Node, align

PAGES = "page_id long, url string, html string, host string, text string, key string"


def largest(x, y):
    """The plain definition of simple tree matching."""
    if x.tag != y.tag:
        return 0
    table = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, c in enumerate(x.children):
        for j, d in enumerate(y.children):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + largest(c, d))
    return 1 + table[-1][-1]


def grown(rng, depth=0):
    node = Node(rng.choice(["p", "div", "ul"]) if depth else "html")
    node.text = rng.choice(["a", "b", ""])
    if depth < 4:
        node.children = [grown(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 3, 5]))]
    return node


def inside(node, out):
    for k, c in enumerate(node.children):
        out[id(c)] = id(node), k
        inside(c, out)
    return out


@pytest.mark.parametrize("table", [1, 6, 1 << 19])
def test_largest_matching(monkeypatch, table):
    monkeypatch.setattr(html_extract, "TABLE", table)
    rng = random.Random(table)
    for _ in range(120):
        a, b = grown(rng), grown(rng)
        pairs = align(a, b)
        assert len(pairs) == largest(a, b)
        up_a, up_b = inside(a, {}), inside(b, {})
        other = {id(x): id(y) for x, y in pairs}
        assert len(set(other.values())) == len(pairs) and all(x.tag == y.tag for x, y in pairs)
        places = {}
        for x, y in pairs[1:]:
            (px, i), (py, j) = up_a[id(x)], up_b[id(y)]
            assert other[px] == py
            places.setdefault(px, []).append((i, j))
        for found in places.values():
            found.sort()
            assert [j for _, j in found] == sorted(j for _, j in found)


def test_deep_trees():
    a, b = html_extract.tree("<div>" * 3000 + "x"), html_extract.tree("<div>" * 2900 + "<p>y")
    assert len(align(a, b)) == 2901


def test_template_after_long_levels(spark):
    """Pages of 150 to 6,000 paragraphs: what closes them is matched whatever stands before it."""
    pages = []
    for i, n in enumerate((150, 250, 199, 201, 450, 6000, 150, 350)):
        body = "".join(f"<p>Line {k} of {i}</p>" for k in range(n))
        pages.append((i, f"http://long.example/{i}", f"<body><p>Site of the day</p>{body}<p>All rights kept</p><div>Write to us</div></body>", None, None, None))
    for r in html_extract.extracted(spark.createDataFrame(pages, PAGES)).collect():
        n = (150, 250, 199, 201, 450, 6000, 150, 350)[r.page_id]
        assert r.text == "\n\n".join(f"Line {k} of {r.page_id}" for k in range(n))
