"""Operator 6, HTML extraction by wrapper induction.

Pages are parsed to trees of block elements with their texts. Each host's reference page is the one with the least
hash of its url and html. Every page of the host is aligned with the reference by simple tree matching (the largest
set of pairs of nodes that keeps parents, order and tags). For each node of the reference, all pages of the host
count how often it is matched and how often with the same text: a node that is matched with the same text on at least
CONSTANT of at least MIN_PAGES pages is template; the other nodes are slots. Counts are summed before the shuffle, so
a host that has a third of all pages is no hot key, and the induced wrapper of a host is one row of its reference.

Menus vary from page to page, so the wrapper also tells them by what they are: a path of tags under which at least
LINKED of the text of the host's pages lies in links is template, on whatever node of a page it is met.

A page is extracted with its host's wrapper: nodes matched to template nodes go, slots stay as content, unless an
element says by its tag or role that it is boilerplate. If the page itself declares an element to be the article,
only that is looked at, and template nodes go inside it as well, as long as some other text of it is a slot: where all
of it is template, the pages are copies of one article, and it stays. Declared elements with a name of boilerplate (an
article that is a comment) count only where there are no others. Without any, the slots of the body are the article.

A class or id name counts as a whole: all its parts must be names of boilerplate or words of place and form (`ad-slot`, not
`ad-hoc`). Outside declared articles elements of such names go. Inside them only reader comments do, and those that are
short or mostly links. An element inside a line that goes doesn't end its block.

Within a block, character references are decoded and white space becomes single spaces; blocks are joined by two
line feeds. Defined results: a null html and one without content give an empty text; a null url, or one without a
host, belongs to the host ''. Unclosed and stray tags are mended as browsers do in the usual cases (open paragraphs
and list items end where the next begins). Repeated rows are extracted alike; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm._shared import read_table, sized, small_batches, written

#: Share of a host's pages, and the least number of them, on which an aligned node's text must be the same.
CONSTANT, MIN_PAGES = 0.8, 5
#: Share of a path's text that lies in links where the path is a menu's; and of an element's within an article.
LINKED = 0.8
#: Characters of an element within an article that its name alone can tell to be boilerplate.
SHORT = 200
#: Hosts whose wrappers are broadcast to the pages; more are joined by a shuffle, which splits hot hosts.
BROADCAST_HOSTS = 2_000
#: Cells of an alignment's table that are held at once (8 bytes each), and matchings of shapes that are remembered.
TABLE, KNOWN = 1 << 19, 200_000

# The elements of HTML by their parts in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary hgroup header footer nav aside form fieldset legend center dialog search menu hr".split())
GONE_TAGS = frozenset("head nav footer aside form script style noscript iframe template title textarea select option button input svg canvas object embed applet audio video dialog menu search noembed noframes xmp map".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate.
GONE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header masthead footer cookie cookies consent notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus respond replies reply discussion pagination pager toolbar widget skip copyright disclaimer".split())
#: Words that say where such an element is or what form it has, and not what it is about.
PLACE_NAMES = frozenset("a area bar bottom box block bottom btn button body button buttons card center code col column container content copy div element embed end fixed float frame global grid group head header holder home icon icons id image img inline inner item items label large layout left line link links list logo main media mini mobile module names outer page panel part post posts pre primary region right row secondary section side site size slot small sticky strip style sub tab tag text thread title top unit user view web wide wrap wrapper zone x s".split())
#: Names of what readers write.
READER_NAMES = frozenset("comment comments disqus respond replies reply discussion".split())
#: A start tag of the key ends an open element of the values, up to the nearest of the stops.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table article section main div body".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>\s+|[/=]|[^\s=>/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)?)?)*+)>?", re.S)
#: A quote counts only where a value begins, as in browsers: title=it's is a whole value.
_ATTRIBUTE = re.compile(r"""([^\s=>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: Of these, words that inside a declared article name its own parts as often: its head, its picture, what it relates to.
SOFT_NAMES = frozenset("header masthead banner related recommended".split())
_SPACE = re.compile(r"\s+")


class Node:
    """A block element, or one that goes with all it holds. parts: texts and child nodes in page order. size: characters of its
    and its children's text, linked: those in links."""

    __slots__ = ("children", "gone", "linked", "main", "named", "own_linked", "parts", "size", "soft", "tag", "text", "weak")

    def __init__(self, tag: str, gone: bool = False, main: bool = False, named: bool = False, soft: bool = False, weak: bool = False):
        self.tag, self.gone, self.main, self.named, self.soft, self.weak, self.parts = tag, gone, main, named, soft, weak, []
        self.children: list[Node] = []
        self.text = ""
        self.size = self.linked = self.own_linked = 0


def _names(value: str) -> set[str]:
    """The names of boilerplate that a class or id attribute's names consist of."""
    found: set[str] = set()
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        gone = words & GONE_NAMES
        if gone and words <= GONE_NAMES | PLACE_NAMES:
            found |= gone
    return found


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """(boilerplate, declared to be the article, declared so with a name of boilerplate, boilerplate only outside a
    declared article, boilerplate inside one too if it is short or links) by tag and attributes."""
    gone, main, named, soft, weak = tag in GONE_TAGS, tag in ("article", "main"), False, False, False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = _names(value)
            if tag in ("article", "main"):
                # a doubt is enough, as others are only preferred
                named |= not GONE_NAMES.isdisjoint(w.lower() for w in _WORD.findall(value))
            elif words and tag not in ("body", "html"):
                # within a line there is nothing long
                gone |= bool(words & READER_NAMES) or (tag not in BLOCKS and not words <= SOFT_NAMES)
                weak |= not words <= SOFT_NAMES
                soft = True
        elif name == "role":
            gone |= value.lower() in GONE_ROLES
            main |= value.lower() in ("main", "article")
        elif name == "hidden":
            gone = True
        elif name == "aria-hidden":
            gone |= value.lower() == "true"
        elif name == "style":
            gone |= "display:none" in value.replace(" ", "").lower()
    return gone, main and not gone, named and not gone, soft and not gone, weak and not gone


def tree(page: str) -> Node:
    """The page's blocks. Inline elements vanish into the text of their block."""
    root = Node("html")
    stack, at = [root], 0
    # how deep the open link is, 0: none; the open elements within a line that are nodes, and how often their tag is open in them
    link, lines, within = 0, 0, {}

    def words(text: str) -> None:
        if text:
            stack[-1].parts.append(text)
            if 0 < link <= len(stack):
                stack[-1].own_linked += len(text)

    def end(tags: tuple, stops: frozenset) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    while at < len(page):
        token = _TOKEN.search(page, at)
        if not token:
            words(page[at:])
            break
        words(page[at : token.start()])
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if tag == "a":
            link = 0 if token[1] else len(stack)
        if lines and tag not in BLOCKS and tag not in GONE_TAGS:
            lines = sum(x.tag not in BLOCKS and x.tag not in GONE_TAGS for x in stack[1:])
            at_line = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
            if at_line:
                key = id(stack[at_line])
                within[key] = within.get(key, 0) + (-1 if token[1] else 1)
                if within[key] < 0:
                    del stack[at_line:]
                    continue
        if token[1]:
            if tag in BLOCKS or tag in GONE_TAGS:
                if any(x.tag == tag for x in stack[1:]):
                    while stack[-1].tag != tag:
                        stack.pop()
                    stack.pop()
            continue
        if tag in VOID:
            words("\n" if tag in ("br", "hr", "wbr") and tag != "wbr" else "")
            continue
        gone, main, named, soft, weak = _marks(tag, token[3])
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in ("html", "body") and len(stack) == 1:
            continue
        if tag in BLOCKS or gone or main or soft:
            if tag in BLOCKS:
                end(("p",), frozenset(("article", "section", "main", "div", "td", "th", "li", "blockquote", "body", "button")))
            if tag in ENDS:
                end(ENDS[tag], STOPS - frozenset(ENDS[tag]))
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                end(("h1", "h2", "h3", "h4", "h5", "h6"), STOPS)
            node = Node(tag, gone, main, named, soft, weak)
            stack[-1].parts.append(node)
            stack[-1].children.append(node)
            if not token[3].rstrip().endswith("/") or tag in BLOCKS:
                stack.append(node)
                lines += tag not in BLOCKS and tag not in GONE_TAGS
    _settle(root)
    return root


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def _settle(root: Node) -> None:
    """Joins the runs of text between child nodes to blocks; text is all of a node's own."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        parts, run = [], []
        for part in [*node.parts, None]:
            if isinstance(part, str):
                run.append(part)
                continue
            if part is not None and part.gone and part.tag not in BLOCKS:
                # it goes, and the line goes on
                continue
            if run and (text := clean("".join(run))):
                parts.append(text)
            run = []
            if part is not None:
                parts.append(part)
        node.parts = parts
        node.text = "\n".join(p for p in parts if isinstance(p, str))
        todo += node.children
    for node in reversed(order):
        node.size, node.linked = len(node.text), node.own_linked
        for child in node.children:
            node.size += child.size
            node.linked += child.linked


class _Classes:
    """Numbers for the shapes (tags and their tree) and the wholes (with texts) of the nodes of two trees."""

    def __init__(self, *roots: Node):
        self.shape: dict[int, int] = {}
        self.whole: dict[int, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self._known: dict[tuple[int, int], int] = {}
        shapes: dict[tuple, int] = {}
        wholes: dict[tuple, int] = {}
        for root in roots:
            order, todo = [], [root]
            while todo:
                node = todo.pop()
                order.append(node)
                todo += node.children
            for node in reversed(order):
                kids = tuple([self.shape[id(c)] for c in node.children])
                shape = shapes.setdefault((node.tag, kids), len(shapes))
                if shape == len(self.sizes):
                    self.tags.append(node.tag)
                    self.kids.append(kids)
                    self.sizes.append(1 + sum(self.sizes[k] for k in kids))
                self.shape[id(node)] = shape
                self.whole[id(node)] = wholes.setdefault((node.tag, node.text, tuple([self.whole[id(c)] for c in node.children])), len(wholes))

    def _plain(self, s: int, t: int) -> int | None:
        """The size of the matching of two shapes if it is plain to see or known."""
        if s == t:
            return self.sizes[s]
        if self.tags[s] != self.tags[t]:
            return 0
        if not self.kids[s] or not self.kids[t]:
            return 1
        return self._known.get((s, t))

    def size(self, s: int, t: int) -> int:
        """How many pairs the largest matching of two shapes has."""
        found = self._plain(s, t)
        if found is not None:
            return found
        if len(self._known) > KNOWN:
            self._known.clear()
        todo = [(s, t)]
        while todo:
            x, y = todo[-1]
            if (x, y) in self._known:
                todo.pop()
                continue
            low, high = _stripped(self.kids[x], self.kids[y])
            to = len(self.kids[x]) - high
            xs, ys = self.kids[x][low:to], self.kids[y][low : len(self.kids[y]) - high]
            need = [(c, d) for c in set(xs) for d in set(ys) if self._plain(c, d) is None]
            if need:
                todo += need
                continue
            todo.pop()
            equal = sum(self.sizes[k] for k in self.kids[x][:low] + self.kids[x][to:])
            best = int(_last_row(_Weights(self, xs, ys), range(len(xs)), 0, len(ys))[-1]) if xs and ys else 0
            self._known[x, y] = 1 + equal + best
        return self._known[s, t]


def _stripped(xs, ys) -> tuple[int, int]:
    """How many items at the start and then at the end are equal. A largest matching pairs them: none gains by another."""
    low, most = 0, min(len(xs), len(ys))
    while low < most and xs[low] == ys[low]:
        low += 1
    high = 0
    while high < most - low and xs[-1 - high] == ys[-1 - high]:
        high += 1
    return low, high


class _Weights:
    """Rows of weights: what each pair of an item of a level and those of another adds to the matching."""

    def __init__(self, classes: _Classes, xs, ys, wholes_x=None, wholes_y=None):
        self.classes, self.xs = classes, xs
        self.shapes, self.place = np.unique(np.array(ys, np.int64), return_inverse=True)
        self.wholes_x, self.wholes_y = wholes_x, None if wholes_y is None else np.array(wholes_y, np.int64)
        self.rows: dict[int, np.ndarray] = {}

    def row(self, i: int) -> np.ndarray:
        s = self.xs[i]
        if s not in self.rows:
            # a bounded number of shapes is kept
            if len(self.rows) > 64:
                self.rows.clear()
            self.rows[s] = np.array([self.classes.size(s, int(t)) for t in self.shapes], np.int64)[self.place]
        if self.wholes_y is None:
            return self.rows[s]
        # among largest matchings the one with the most equal pairs
        return (self.rows[s] << 24) + ((self.rows[s] > 0) & (self.wholes_y == self.wholes_x[i]))


def _next_row(above: np.ndarray, weight: np.ndarray) -> np.ndarray:
    row = above.copy()
    np.maximum(row[1:], np.where(weight > 0, above[:-1] + weight, 0), out=row[1:])
    return np.maximum.accumulate(row)


def _last_row(weights: _Weights, rows, begin: int, end: int, back: bool = False) -> np.ndarray:
    """The best sums of the given rows with each number of the columns begin to end, counted from the end if back."""
    row = np.zeros(end - begin + 1, np.int64)
    for i in rows:
        weight = weights.row(i)[begin:end]
        row = _next_row(row, weight[::-1] if back else weight)
    return row


def _best_pairs(weights: _Weights, n: int, m: int) -> list[tuple[int, int]]:
    """A matching of the greatest sum that keeps the order, by halves (Hirschberg) until a part fits TABLE cells."""
    pairs, todo = [], [(0, n, 0, m)]
    while todo:
        top, bottom, begin, end = todo.pop()
        if top == bottom or begin == end:
            continue
        if bottom - top > 1 and (bottom - top) * (end - begin) > TABLE:
            half = (top + bottom) // 2
            both = _last_row(weights, range(top, half), begin, end) + _last_row(weights, range(bottom - 1, half - 1, -1), begin, end, True)[::-1]
            cut = begin + int(both.argmax())
            todo += [(top, half, begin, cut), (half, bottom, cut, end)]
            continue
        table = [np.zeros(end - begin + 1, np.int64)]
        for i in range(top, bottom):
            table.append(_next_row(table[-1], weights.row(i)[begin:end]))
        i, j = bottom - top, end - begin
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((top + i, begin + j))
    return pairs


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: the largest set of pairs that keeps tags, parents and order, roots paired.

    Levels are aligned whole whatever their length, in memory that grows with their length only.
    """
    if a.tag != b.tag:
        return [(a, b)]
    classes = _Classes(a, b)
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if not x.children or not y.children:
            continue
        wholes_x, wholes_y = ([classes.whole[id(c)] for c in node.children] for node in (x, y))
        low, high = _stripped(wholes_x, wholes_y)
        to_x, to_y = len(wholes_x) - high, len(wholes_y) - high
        todo += zip(x.children[:low], y.children[:low], strict=True)
        todo += zip(x.children[to_x:], y.children[to_y:], strict=True)
        xs, ys = x.children[low:to_x], y.children[low:to_y]
        if xs and ys:
            weights = _Weights(classes, [classes.shape[id(c)] for c in xs], [classes.shape[id(c)] for c in ys], wholes_x[low:to_x], wholes_y[low:to_y])
            todo += [(xs[i], ys[j]) for i, j in _best_pairs(weights, len(xs), len(ys))]
    return pairs


def _numbered(root: Node) -> dict[int, int]:
    """Node to its place in page order; the same page always gets the same numbers."""
    places, todo = {}, [root]
    while todo:
        node = todo.pop()
        places[id(node)] = len(places)
        todo += reversed(node.children)
    return places


def _declared(root: Node) -> list[Node]:
    """The outermost elements declared to be the article, outside boilerplate, in page order; those with a name of
    boilerplate only if there are no others."""
    found, doubted, todo = [], [], [(root, False)]
    while todo:
        node, within = todo.pop()
        if node.gone:
            continue
        if node.main and not node.named:
            found.append(node)
            continue
        if node.main and not within:
            doubted.append(node)
        todo += [(c, within or node.main) for c in reversed(node.children)]
    return found or doubted


def _paths(root: Node):
    """(node, hash of the tags from the root to it) of all nodes that aren't within boilerplate."""
    todo = [(root, zlib.crc32(root.tag.encode()))]
    while todo:
        node, path = todo.pop()
        if node.gone:
            continue
        yield node, path
        todo += [(c, zlib.crc32(c.tag.encode(), path)) for c in node.children]


def extract(root: Node, template: set[int], menus: set[int] = frozenset()) -> str:
    """template: ids of nodes whose own text is the host's, not the page's. menus: paths of menus, which go outside declared
    articles."""
    declared = _declared(root)
    blocks: list[str] = []
    plain = any(not x.named for x in declared)
    if menus and not declared:
        template = template | {id(x) for x, path in _paths(root) if path in menus}
    small = lambda x: x.size < SHORT or x.linked >= LINKED * x.size
    for top in declared or [root]:
        own: list[str] = []
        whole: list[str] = []
        todo: list = [(top, True)]
        while todo:
            x, slot = todo.pop()
            if isinstance(x, str):
                whole.append(x)
                if slot:
                    own.append(x)
            elif not (x.gone or (x.named and plain) or ((x.soft or x.tag == "header") and not declared) or (x.weak and x is not top and small(x))):
                todo += [(p, id(x) not in template) for p in reversed(x.parts)]
        # a declared article that is template throughout is a copy of the host's other articles
        blocks += own or (whole if declared else [])
    return "\n\n".join(blocks)


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, reference (html), template (places of its template nodes) and menus (paths) of hosts with MIN_PAGES pages or more.

    pages: host, html. Hosts with fewer pages have no wrapper: nothing on them is known to be constant.
    """
    small_batches(pages.sparkSession)
    least = F.min(F.struct(F.xxhash64("html").alias("h"), F.length("html").alias("n"))).alias("k")
    chosen = pages.groupBy("host").agg(F.count("*").alias("pages"), least).where(F.col("pages") >= MIN_PAGES)
    chosen = written(chosen.select(F.col("host").alias("h"), "pages", "k"), "chosen")
    hosts = chosen.count()
    picked = pages.join(sized(chosen, hosts, BROADCAST_HOSTS * 100), (F.col("host") == F.col("h")) & (F.xxhash64("html") == F.col("k.h")) & (F.length("html") == F.col("k.n")))
    picked = written(picked.groupBy("host", "pages").agg(F.min("html").alias("reference")), "references")
    joined = pages.join(sized(picked.withColumnRenamed("host", "h"), hosts, BROADCAST_HOSTS), F.col("host") == F.col("h")).select("host", "html", "reference")

    def count(batches):
        same: dict[str, tuple] = {}
        for batch in batches:
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page, reference in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "reference")], strict=True):
                if host not in same:
                    if len(same) > 100:
                        same.clear()
                    root = tree(reference)
                    same[host] = root, _numbered(root)
                root, places = same[host]
                own = tree(page)
                for x, y in align(root, own):
                    if x.text:
                        s = sums.setdefault((host, places[id(x)]), [0, 0, 0])
                        s[0] += 1
                        s[1] += x.text == y.text
                paths: dict[int, list[int]] = {}
                for x, path in _paths(own):
                    if x.text:
                        s = paths.setdefault(path, [0, 0, 1])
                        s[0] += len(x.text)
                        s[1] += x.own_linked
                for path, found in paths.items():
                    s = sums.setdefault((host, -1 - path), [0, 0, 0])
                    for k in range(3):
                        s[k] += found[k]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), *[pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(3)]], ["host", "place", "matched", "equal", "pages"])

    # places of the reference are 0 and more; a path is -1 - its hash, with characters and those in links, and its pages
    counts = written(joined.mapInArrow(count, "host string, place long, matched long, equal long, pages long").groupBy("host", "place").agg(*[F.sum(c).alias(c) for c in ("matched", "equal", "pages")]), "counts")
    constant = counts.where("place >= 0").drop("pages").join(picked.select("host", "pages"), "host").where(F.col("equal") >= CONSTANT * F.col("pages"))
    constant = constant.groupBy("host").agg(F.sort_array(F.collect_list("place")).alias("template"))  # nodes of one page
    bound = counts.where((F.col("place") < 0) & (F.col("pages") >= MIN_PAGES) & (F.col("equal") >= LINKED * F.col("matched")))
    menus = bound.groupBy("host").agg(F.sort_array(F.collect_list(-1 - F.col("place"))).alias("menus"))
    none = F.array().cast("array<long>")
    rows = picked.join(constant, "host", "left").join(menus, "host", "left").where("template is not null or menus is not null")
    return written(rows.select("host", "reference", F.coalesce("template", none).alias("template"), F.coalesce("menus", none).alias("menus")), "wrappers")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    found = wrappers(rows.select("host", "html"))
    rows = rows.join(sized(found.withColumnRenamed("host", "h"), found.count(), BROADCAST_HOSTS), F.col("host") == F.col("h"), "left")

    @F.arrow_udf("string")
    def main_text(html: pa.Array, host: pa.Array, reference: pa.Array, template: pa.Array, menus: pa.Array) -> pa.Array:
        out, known = [], {}
        for page, name, other, places, paths in zip(html.to_pylist(), host.to_pylist(), reference, template.to_pylist(), menus.to_pylist(), strict=True):
            root, gone = tree(page), set()
            if places:
                if name not in known:
                    reference_root = tree(other.as_py())
                    numbers = _numbered(reference_root)
                    known[name] = reference_root, {k for k, v in numbers.items() if v in set(places)}
                reference_root, constant = known[name]
                gone = {id(y) for x, y in align(reference_root, root) if id(x) in constant and x.text == y.text}
            out.append(extract(root, gone, set(paths or ())))
        return pa.array(out, pa.string())

    text = rows.select("page_id", "url", main_text("html", "host", "reference", "template", "menus").alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))
