import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import rows_of, sentence

from quernstone.llm import readability

PAGES = "page_id long, url string, html string"


def prose(seed, n=40):
    rng = random.Random(seed)
    return ", ".join(sentence(rng, 8) for _ in range(n // 8)).capitalize() + "."


def page(paragraphs):
    links = "".join(f'<li><a href="/{i}">Link number {i} of the menu, with commas, and words</a></li>' for i in range(30))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<!DOCTYPE html><html><head><title>A &amp; B</title><style>p {{}}</style><script>var x = '<p>no, no, no, never this one here</p>';</script></head><body><nav><ul>{links}</ul></nav><div class=wrap><div id=main>{body}</div><div class=sidebar><p>{prose(99)}</p></div></div><ul>{links}</ul><footer>Copyright, all rights reserved, by us, in this year</footer></body></html>"


def test_the_text_is_kept_and_the_rest_goes():
    texts = [prose(i) for i in range(5)]
    title, text, score, density, paragraphs = readability.extract(page(texts))
    assert title == "A & B" and text == "\n".join(texts) and score > 0 and density == 0 and paragraphs >= 5


def test_points_by_hand():
    a, b = "x" * 120 + ", y", "one, two, three, and some more text"
    nodes, _ = readability.parse(f"<body><div><section><p>{a}</p><p>{b}</p></section></div></body>")
    readability._measure(nodes)
    assert readability._score(nodes) == 2
    points = {n.tag: n.points for n in nodes}
    own = (1 + 1 + 1) + (1 + 3 + 0)
    assert points["section"] == own + 3 and points["div"] == own / 2 + 5
    assert points["body"] == pytest.approx((1 + 1 + 1) / 9 + (1 + 3) / 9)


def test_link_density_discounts():
    nodes, _ = readability.parse(f"<div><p>{'w' * 60}<a>{'l' * 40}</a></p></div>")
    readability._measure(nodes)
    readability._score(nodes)
    div = next(n for n in nodes if n.tag == "div")
    assert readability.density(div) == pytest.approx(0.4) and div.points == pytest.approx((1 + 0 + 1 + 5) * 0.6)


def test_good_siblings_are_kept():
    first, second = prose(1, 160), prose(2, 32)
    _, text, *_ = readability.extract(f"<body><div>{''.join(f'<p>{prose(i)}</p>' for i in range(20))}</div><p>{first}</p><p>Short, no end</p><p>{second}</p></body>")
    assert first in text and second in text and "Short" not in text


THREE = "".join(f"<p>{prose(i, 80)}</p>" for i in range(3))


@pytest.mark.parametrize("around", ["<form id=aspnetForm>{}</form>", '<div class="content share-enabled">{}</div>', "<div class='main no-sidebar'>{}</div>", "<aside>{}</aside>", '<div id="related">{}</div>'])
def test_rich_or_likely_nodes_stay(around):
    title, text, score, *_ = readability.extract(f"<html><body><nav><a href=x>{prose(50)}</a></nav>{around.format(THREE)}<div class=sidebar><p>{prose(9, 24)}</p></div></body></html>")
    assert text == "\n".join(prose(i, 80) for i in range(3)) and score > 0


def test_an_articles_own_header_stays():
    text = readability.extract(f"<body><header><h1>The site, and its name</h1></header><article><header><h1>The heading</h1></header>{THREE}</article></body>")[1]
    assert text.startswith("The heading\n") and "The site" not in text


def test_poor_suspects_go():
    text = readability.extract(f'<body><div>{THREE}<div class="related-content"><p>{prose(5, 16)}</p></div><form><p>{prose(6, 16)}</p></form></div></body>')[1]
    assert text == "\n".join(prose(i, 80) for i in range(3))


class Tree(HTMLParser):
    """A plain tree: [tag, attributes, children], text as strings; a block start closes an open paragraph."""

    def __init__(self, page):
        super().__init__()
        self.root = ["#", {}, []]
        self.stack, self.skip, self.title = [self.root], None, ""
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "iframe", "svg", "textarea", "select"):
            self.skip = self.skip or tag
            return
        if self.skip or tag in ("meta", "img", "link", "hr", "input"):
            return
        if tag == "br":
            self.stack[-1][2].append("\n")
            return
        names = [n[0] for n in self.stack]
        if tag in readability._CLOSES_P and "p" in names:
            del self.stack[len(names) - 1 - names[::-1].index("p") :]
        names = [n[0] for n in self.stack]
        wall = max((i for i, n in enumerate(names) if n in {"li": ("ul", "ol"), "td": ("table", "tr"), "tr": ("table",)}.get(tag, ())), default=0)
        if tag in ("li", "tr", "td") and tag in names[wall + 1 :]:
            del self.stack[wall + 1 + names[wall + 1 :].index(tag) :]
        node = [tag, dict(attrs), []]
        self.stack[-1][2].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        names = [n[0] for n in self.stack]
        if not self.skip and tag in names[1:]:
            del self.stack[len(names) - 1 - names[::-1].index(tag) :]

    def handle_data(self, data):
        if not self.skip:
            if self.stack[-1][0] == "title":
                self.title += data
            else:
                self.stack[-1][2].append(data)


def clean(text):
    return re.sub(r"[ \t\n\r\f\v\xa0]+", " ", text).strip()


def brute(page):
    """(title, score) and the best container's paragraphs, every node's figures found anew by recursion."""
    tree = Tree(page)
    everything, parent = [], {}

    def walk(node):
        everything.append(node)
        for c in node[2]:
            if isinstance(c, list):
                parent[id(c)] = node
                walk(c)

    walk(tree.root)
    out = set()

    def chars(node, links_only=False, inside=False):
        inside = inside or node[0] == "a"
        return 0 if id(node) in out else sum(chars(c, links_only, inside) if isinstance(c, list) else len(clean(c)) * (inside or not links_only) for c in node[2])

    def up(node):
        while id(node) in parent:
            node = parent[id(node)]
            yield node

    total = chars(tree.root) - chars(tree.root, True)
    rich = {id(n) for n in everything if chars(n) - chars(n, True) >= 0.4 * total > 0}
    for n in everything:
        words = f"{n[1].get('class') or ''} {n[1].get('id') or ''}".split()
        bad = [w for w in words if readability._UNLIKELY_WORD.search(w)] if n[0] not in ("html", "body") else []
        good = any(readability._LIKELY_WORD.search(w) for w in words if w not in bad)
        suspect = n[0] in readability._OUT or (bad and not good)
        safe = good or id(n) in rich or (n[0] == "header" and any(a[0] in ("article", "main") for a in up(n)))
        if n[0] == "head" or (suspect and not safe):
            out.add(id(n))
        n.append(25 * good)
    live = [n for n in everything if id(n) not in out and not any(id(a) in out for a in up(n))]

    def own(node):
        """The node's text with that of what is inline in it."""
        return [t for c in node[2] for t in ([clean(c)] if isinstance(c, str) else own(c) if c[0] not in readability._BLOCK and id(c) not in out else [])]

    points, gained = {id(n): 0.0 for n in live}, set()
    for n in live:
        texts = own(n)
        size = sum(map(len, texts))
        paragraph = n[0] in ("p", "pre", "td", "blockquote")
        if size >= 25 and (paragraph or n[0] in readability._CONTAINER or n is tree.root):
            gain = 1 + sum(t.count(",") for t in texts) + min(size // 100, 3)
            chain = list(up(n)) if paragraph else [n, *up(n)]
            for level, a in enumerate(chain[:5], 1):
                points[id(a)] += gain / (1 if level == 1 else 2 if level == 2 else 3 * level)
                gained.add(id(a))

    def score(n):
        return (points[id(n)] + readability._BASE.get(n[0], 0) + n[3]) * (1 - (chars(n, True) / chars(n) if chars(n) else 0))

    best = max((n for n in live if id(n) in gained), key=score, default=None)
    return clean(tree.title), score(best) if best else 0.0


def test_titles_and_scores_of_the_query_equal_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r["page_id"]: r["html"] for r in table.collect()}
    for r in readability.extract_pages(table).collect():
        title, score = brute(html[r["page_id"]])
        assert (r["title"], r["score"]) == (title, pytest.approx(score))


@pytest.mark.parametrize("html", ["", "   ", "plain text without a tag", "<p>unclosed <b>tags <i>everywhere", "</p></div></html>", "<" * 5000, "<p" * 3000, "<!-- never closed", "<script>never closed", "<div>" * 20_000 + "deep text, far down" + "</div>" * 20_000, "<table><tr><td>a<td>b<tr><td>c", "<p>1 < 2 and 3 > 2 &amp; &bogus; &#65;</p>", "<title>only a title"])
def test_broken_pages_do_not_fail(html):
    title, text, score, density, paragraphs = readability.extract(html)
    assert isinstance(text, str) and score >= 0 and 0 <= density <= 1 and paragraphs >= 0


def test_a_very_long_page():
    texts = [prose(i, 200) for i in range(800)]
    _, text, *_ = readability.extract(page(texts))
    assert text == "\n".join(texts)


def test_rows(spark, sf):
    rows = [(1, "u", page([prose(1), prose(2)])), (1, "u", page([prose(1), prose(2)])), (2, None, None), (None, "v", ""), (3, "w", "no tags")]
    docs = spark.createDataFrame(rows, PAGES)
    want = sorted(((i, u, *readability.extract(h)) for i, u, h in rows), key=repr)
    assert rows_of(readability.extract_pages(docs)) == want
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("found", "title", "text", "score")])
    assert rows_of(readability.extract_pages(clash)) == want
    assert readability.extract_pages(spark.createDataFrame([], PAGES)).count() == 0
    table = spark.read.parquet(f"{sf}/pages.parquet")
    out = readability.extract_pages(table)
    assert out.count() == table.count() and out.where("length(text) > 0").count() == table.count()
