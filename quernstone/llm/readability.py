"""Operator 9: main text of web pages by tree scoring.

Every paragraph (p, pre, td, blockquote, and containers with text of their own) of at least 25 characters gives points to its ancestors:
one, one for each comma, and one for each 100 characters up to three; all of them to the parent, half to the
grandparent, a third of the level's share further up to the fifth level. A container's points, with its
kind's own, are discounted by link density. The best container is kept with those siblings that score a fifth of it or are
good paragraphs themselves.

Navigation and the like, by tag or by a word of class or id, goes before scoring, but never what another word there names as content, what holds at least RICH of the page's text outside
links, or a header inside an article or main part.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import lean, small_batches

RESULT = "title string, text string, score double, link_density double, paragraphs int"
LEAST_CHARS, LEVELS, RICH = 25, 5, 0.4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>|<[!?][^>]*>", re.S | re.I)
_SPACES = re.compile(r"[ \t\n\r\f\v\xa0]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul title".split())
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "title"}
_ENDS = {"li": ("li", ("ul", "ol")), "td": ("td", ("table", "tr")), "th": ("th", ("table", "tr")), "tr": ("tr", ("table",)), "dt": ("dd", ("dl",)), "dd": ("dt", ("dl",))}
_OUT = frozenset(("nav", "footer", "header", "aside", "form", "head", "button", "menu"))
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNLIKELY_WORD = re.compile(r"\b(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|masthead|menu|nav\w*|pager|popup|promo\w*|related|share|sidebar|social|sponsor\w*|widget)\b", re.I)
_LIKELY_WORD = re.compile(r"\b(?:article|body|content|entry|main|post|story|text)\b", re.I)
_UNLIKELY = re.compile(r"""\b(?:class|id)\s*=\s*["']?[^"'>]*\b(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|masthead|menu|nav\w*|pager|popup|promo\w*|related|share|sidebar|social|sponsor\w*|widget)\b""", re.I)
_LIKELY = re.compile(r"""\b(?:class|id)\s*=\s*["']?[^"'>]*\b(?:article|body|content|entry|main|post|story|text)\b""", re.I)
_PARAGRAPH = frozenset(("p", "pre", "td", "blockquote"))
_CONTAINER = frozenset(("div", "section", "article", "main", "body", "td", "li", "dd", "center"))
_BASE = {"article": 5, "main": 5, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}


class Node:
    __slots__ = ("tag", "parent", "parts", "suspect", "out", "likely", "plain", "marks", "own", "chars", "linked", "commas", "points", "gained")

    def __init__(self, tag: str, parent: Node | None, suspect: bool, likely: bool):
        self.tag, self.parent, self.suspect, self.likely, self.out = tag, parent, suspect, likely, False
        self.plain = self.marks = 0
        self.parts: list[Node | str] = []
        self.own = self.chars = self.linked = self.commas = 0
        self.points, self.gained = 0.0, False


def _judge(attributes: str, suspect: bool) -> tuple[bool, bool]:
    """(suspect, likely) of a node that has an unlikely word in its class or id: it isn't suspect for that where another name there is likely."""
    words = [w for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split()]
    unlikely = [w for w in words if _UNLIKELY_WORD.search(w)]
    likely = any(_LIKELY_WORD.search(w) for w in words if w not in unlikely)
    return suspect or not likely, likely


def parse(page: str) -> tuple[list[Node], str]:
    """The nodes in document order, the root first, and the title. Unclosed and stray tags are mended as browsers mostly do."""
    root = Node("#", None, False, False)
    nodes, now, title, in_title = [root], root, [], False
    opened: dict[str, int] = {}

    def close(tag: str) -> None:
        nonlocal now
        while now is not root:
            done, now = now.tag, now.parent
            opened[done] -= 1
            if done == tag:
                return

    def within(tag: str, walls: tuple[str, ...]) -> bool:
        """Whether ``tag`` is open inside the nearest of ``walls``."""
        node = now
        while node is not root and node.tag not in walls:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    last_end, at = page.rfind(">") + 1, 0
    for m in _TOKEN.finditer(page, 0, last_end):
        if m.start() > at:
            text = page[at : m.start()]
            if in_title:
                title.append(text)
            else:
                now.parts.append(text)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "title":
            in_title = not m[2]
        elif m[2]:
            if opened.get(tag):
                close(tag)
        elif tag == "br":
            now.parts.append("\n")
        elif tag not in _VOID:
            if tag in _CLOSES_P and opened.get("p"):
                close("p")
            if (ends := _ENDS.get(tag)) and (opened.get(tag) or opened.get(ends[0])):
                for old in {tag, ends[0]}:
                    if opened.get(old) and within(old, ends[1]):
                        close(old)
            attributes = m[4]
            named = "=" in attributes
            likely = named and _LIKELY.search(attributes) is not None
            suspect = tag in _OUT
            if named and tag not in ("html", "body") and _UNLIKELY.search(attributes):
                suspect, likely = _judge(attributes, suspect)
            node = Node(tag, now, suspect, likely)
            now.parts.append(node)
            nodes.append(node)
            if not attributes.endswith("/"):
                now = node
                opened[tag] = opened.get(tag, 0) + 1
    if at < len(page):
        (title if in_title else now.parts).append(page[at:])
    return nodes, _clean("".join(title))


def _clean(text: str) -> str:
    if "&" in text:
        text = entities.unescape(text)
    return _SPACES.sub(" ", text).strip()


def _sum(nodes: list[Node]) -> None:
    """The characters, of links too, and commas that each node holds, without what is out."""
    for n in nodes:
        n.own, n.commas, n.chars, n.linked = n.plain, n.marks, 0, 0
    for n in reversed(nodes):  # children come after their parents
        if not n.out:
            n.chars += n.own
            if n.tag == "a":
                n.linked = n.chars
            if n.parent:
                n.parent.chars += n.chars
                n.parent.linked += n.linked
                if n.tag not in _BLOCK:  # what is inline belongs to the block around it, which counts its own text itself
                    n.parent.chars -= n.own
                    n.parent.own += n.own
                    n.parent.commas += n.commas


def _measure(nodes: list[Node]) -> None:
    """Count each node's text, and settle which nodes are out."""
    for n in nodes:
        for p in n.parts:
            if p.__class__ is str:
                t = _clean(p)
                n.plain += len(t)
                n.marks += t.count(",") + t.count("，") + t.count("、")
    _sum(nodes)
    least = RICH * (nodes[0].chars - nodes[0].linked)
    some = False
    for n in nodes:  # parents come before their children
        if n.parent and n.parent.out:
            n.out = True
        elif n.suspect and n.tag == "head":
            n.out = some = True
        elif n.suspect and not n.likely and not (n.chars - n.linked >= least > 0):
            up = n.parent if n.tag == "header" else None
            while up and up.tag not in ("article", "main"):
                up = up.parent
            n.out = up is None
            some |= n.out
    if some:
        _sum(nodes)


def density(n: Node) -> float:
    return min(1.0, n.linked / n.chars) if n.chars else 0.0


def _score(nodes: list[Node]) -> int:
    paragraphs = 0
    for n in nodes:
        if n.out or n.own < LEAST_CHARS or not (n.tag in _PARAGRAPH or n.tag in _CONTAINER or n.parent is None):
            continue
        paragraphs += 1
        points = 1 + n.commas + min(n.own // 100, 3)
        up = n.parent if n.tag in _PARAGRAPH and n.parent else n
        level = 1
        while up and level <= LEVELS:
            up.points += points if level == 1 else points / 2 if level == 2 else points / (3 * level)
            up.gained = True
            up, level = up.parent, level + 1
    for n in nodes:
        if n.gained:
            n.points = (n.points + _BASE.get(n.tag, 0) + 25 * n.likely) * (1 - density(n))
    return paragraphs


def _text(top: list[Node]) -> str:
    lines: list[str] = []
    held: list[str] = []

    def end() -> None:
        for line in "".join(held).split("\n"):
            if line := _clean(line):
                lines.append(line)
        held.clear()

    for first in top:
        stack: list[Node | str | None] = [first]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif x.__class__ is str:
                held.append("\n" if x == "\n" else _SPACES.sub(" ", x))
            elif not x.out:
                if x.tag in ("ul", "ol", "table", "div", "section") and x not in top and x.chars and density(x) > 0.5:
                    continue
                if x.tag in _BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(x.parts))
        end()
    return "\n".join(lines)


def extract(page: str | None) -> tuple[str | None, str | None, float | None, float | None, int | None]:
    """(title, text, score, link density, paragraphs) of a page; see extract_pages()."""
    if page is None:
        return None, None, None, None, None
    nodes, title = parse(page)
    _measure(nodes)
    paragraphs = _score(nodes)
    best = None
    for n in nodes:
        if n.gained and not n.out and (best is None or n.points > best.points):
            best = n
    if best is None or best.points <= 0:
        best = next((n for n in nodes if n.tag == "body"), nodes[0])
        return title, _text([best]), 0.0, density(best), paragraphs
    least = max(10.0, best.points * 0.2)
    top = []
    for s in best.parent.parts if best.parent else [best]:
        if s is best:
            top.append(s)
        elif s.__class__ is Node and not s.out:
            if s.gained and s.points >= least:
                top.append(s)
            elif s.tag == "p" and ((s.chars > 80 and density(s) < 0.25) or (0 < s.chars <= 80 and not s.linked and _text([s]).endswith((".", "!", "?")))):
                top.append(s)
    return title, _text(top), best.points, density(best), paragraphs


def main_text(page: Column) -> Column:
    """struct(title, text, score, link_density, paragraphs) of a column of pages."""

    @F.pandas_udf(RESULT)
    @lean
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["title", "text", "score", "link_density", "paragraphs"]
        for pages in parts:
            out = pd.DataFrame([extract(p) for p in pages], columns=names)
            out["paragraphs"] = out["paragraphs"].astype("Int32")
            yield out

    return run(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, score, link_density, paragraphs), one row for each row of ``pages``.

    A NULL html has NULLs; an empty page, or one without text, has '' and score 0. Where no container gains points, the whole body's text is kept, without what is out.
    Of containers with equal points the first in the page is the best. A page counts whole, however long or deep. NULL
    identifiers and repeated rows stay as they are; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", "url", main_text(F.col("html")).alias("found")).select("page_id", "url", "found.*")
