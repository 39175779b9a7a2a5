"""Main text of web pages from flat text blocks.

A page is read once into a flat list of text blocks in page order. A block is described by
its word count and link density, those of its neighbours on both sides, and by a few flags:
whether it stands inside an article, inside a page part such as a menu, in an element with a
telling class name, is a heading, ends like a sentence. A decision tree, trained on a small
table of labelled blocks, tells main text from the rest. The table is made by a rule (see
``labelled_pages``) in which no flag alone decides: there are articles with lists of links in
them, pages without an article, short paragraphs between long ones, and long page parts.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "canvas", "object", "select", "button", "title", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BREAKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARTS = {"nav", "footer", "aside", "form", "menu", "dialog"}
HINT = re.compile(  # not "no-comments", "has-sidebar" and the like, which tell of the whole page
    r"(?:^|\s|(?<!\bno)(?<!\bnon)(?<!\bhas)(?<!\bwith)(?<!\bwithout)[_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|modal|popup|overlay|"
    r"sidebar\w*|widget\w*|menu\w*|nav\w*|breadcrumbs?|masthead|topbar|site-header|page-header|footer\w*|copyright|comments?|commentlist|"
    r"discussion|disqus|repl(?:y|ies)|respond|related|recommend\w*|share|sharing|social|newsletter|subscri\w*|signup|login|search|"
    r"pagination|pager|toolbar|skip|hidden|teaser\w*|outbrain|taboola)(?=$|[\s_-]|\d)",
    re.I,
)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WHOLE = {"html", "body", "main", "article"}  # class names of these tell nothing of what is inside
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "article", "part", "hint", "heading", "sentence"]


@dataclass
class Block:
    text: str
    linked: int
    article: bool
    part: bool
    hint: bool
    heading: bool

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


@dataclass
class _Open:
    name: str
    article: bool
    part: bool
    hint: bool
    heading: bool


def blocks(page: str | None) -> list[Block]:
    """All text blocks in page order; comments, scripts, styles and the like give none.

    An end tag closes the nearest open element of its name; one without a start tag is
    passed over, and so is what a page cut short leaves of a tag. White space, of which a
    line break is one, becomes one space.
    """
    page = page or ""
    out: list[Block] = []
    stack = [_Open("", False, False, False, False)]
    opened: dict[str, list[int]] = {}  # where on the stack elements of a name are
    pieces: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def leave(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().name].pop()

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.article, top.part, top.hint, top.heading))
        pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if in_link:
            linked += len(text.split())

    while at < n:
        cut = page.find("<", at)
        if cut < 0:
            cut = n
        if cut > at:
            say(page[at:cut])
        if cut == n:
            break
        if page.startswith("<!--", cut):
            end = page.find("-->", cut + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), cut):
            end = page.find(">", cut)
            at = n if end < 0 else end + 1
            continue
        tag = TAG.match(page, cut) or ODD_TAG.match(page, cut)
        if tag is None:
            if re.match(r"</?[a-zA-Z]", page[cut : cut + 3]):
                break  # the page ends inside a tag
            say("<")
            at = cut + 1
            continue
        at = tag.end()
        ends, name, rest = tag.group(1), tag.group(2).lower(), tag.group(3)
        if name == "br":
            pieces.append(" ")
        elif name == "a":
            in_link = 0 if ends else 1
        elif name in RAW:
            if not ends and not rest.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = n if end is None else end.end()
            pieces.append(" ")
        elif name in BREAKS or (not ends and name not in VOID and rest and NAMED.search(rest)):
            if name in BREAKS:
                close()
            if name in ("hr",):
                continue
            if ends:
                if opened.get(name):
                    leave(opened[name][-1])
            else:
                if name in ("p", "li") and stack[-1].name == name:
                    leave(len(stack) - 1)
                top = stack[-1]
                says = rest and (
                    name not in WHOLE and any(HINT.search(m.strip("\"'")) for m in NAMED.findall(rest)) or UNSEEN.search(rest)
                )
                article = top.article or name in ("article", "main")
                part = top.part or name in PARTS or (name == "header" and not top.article) or name == "head"
                opened.setdefault(name, []).append(len(stack))
                stack.append(_Open(name, article, part, top.hint or bool(says), name in ("h1", "h2", "h3", "h4", "h5", "h6")))
        elif ends and stack[-1].name == name:
            leave(len(stack) - 1)
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block; outside the page there are no words."""
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked / b.words for b in found), 0], float)
    flags = np.array(
        [[b.article, b.part, b.hint, b.heading, b.text[-1] in ".!?:;…\"'”"] for b in found], float
    ).reshape(len(found), 5)
    around = np.stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]], axis=1)
    return np.concatenate([around, flags], axis=1)


_SAYING = (
    "the council met on monday to discuss plans for a new bridge across river and heard both sides before it "
    "agreed that work could begin next spring if money is found by then while people who live there asked for less noise"
).split()
#: Class names and tags that page parts of each sort are made with.
_CLASSES = ["ad", "cookie-notice", "sidebar", "comments", "related", "newsletter", "banner", "promo", "share", "popup"]
_PART_TAGS = ["nav", "aside", "footer", "form", "header"]


def _said(draw: random.Random, least: int, most: int, stop: bool = True) -> str:
    words = [draw.choice(_SAYING) for _ in range(draw.randint(least, most))]
    return " ".join(words).capitalize() + ("." if stop else "")


def _links(draw: random.Random, count: int, tag: str) -> str:
    items = (f"<a href=/{draw.randint(1, 99)}>{_said(draw, 1, 6, draw.random() < 0.3)}</a>" for _ in range(count))
    return "".join(f"<{tag}>{item}</{tag}>" for item in items)


def _paragraph(draw: random.Random, tag: str | None = None) -> str:
    tag = tag or draw.choice(["p", "p", "p", "p", "li", "blockquote", "pre"])
    text = _said(draw, *draw.choice([(1, 4), (8, 25), (8, 25), (25, 60), (60, 120)]), draw.random() < 0.8)
    linked = draw.random()
    if linked < 0.06:  # one link alone in a line of text
        text = f"<a href=/x>{text}</a>"
    elif linked < 0.35 and text.count(" ") > 2:  # up to half of it
        words = text.split()
        cut = draw.randint(1, len(words) // 2)
        text = f"<a href=/x>{' '.join(words[:cut])}</a> {' '.join(words[cut:])}"
    return f"<{tag}>{text}</{tag}>"


def _sized(draw: random.Random, tag: str, least: int, most: int) -> str:
    return f"<{tag}>{_said(draw, least, most)}</{tag}>"


def _aside(draw: random.Random) -> str:
    """Something of a page that isn't its text, and says so by tag or class."""
    inside = draw.choice([
        lambda: f"<p>{_said(draw, 1, 90)}</p>", lambda: _said(draw, 1, 60), lambda: f"<ul>{_links(draw, draw.randint(2, 7), 'li')}</ul>",
        lambda: f"<h3>{_said(draw, 1, 4, False)}</h3>" + _links(draw, 3, "p"),
    ])()
    if draw.random() < 0.5:
        return f"<div class={draw.choice(_CLASSES)}>{inside}</div>"
    tag = draw.choice(_PART_TAGS)
    return f"<{tag}>{inside}</{tag}>"


def labelled_pages(count: int = 300, seed: int = 3) -> list[list[tuple[int, str]]]:
    """Pages as lists of (main text or not, piece of page), drawn from ``seed``."""
    draw, pages = random.Random(seed), []
    for k in range(count):
        sort = ("article", "main", "div", "div", "bare")[k % 5]
        page: list[tuple[int, str]] = []
        if sort == "bare":  # a page of its text alone
            pages.append([(1, _paragraph(draw, "p")) for _ in range(draw.randint(1, 4))])
            continue
        if sort == "div":  # nothing but sizes and links tell
            page.append((0, f"<div>{_links(draw, draw.randint(3, 8), draw.choice(['li', 'span', 'p']))}</div>"))
            page += [(0, f"<div>{_said(draw, 1, 2, False)}</div>")] * draw.randint(0, 1) + [(1, f"<div><h1>{_said(draw, 3, 9, False)}</h1>")]
            page += [(1, _sized(draw, "p", 20, 80))]
            for _ in range(draw.randint(1, 6)):
                page.append((1, _sized(draw, "p", *draw.choice([(1, 3), (12, 40), (30, 90)]))))
                if draw.random() < 0.25:
                    page.append((0, f"<ul>{_links(draw, draw.randint(3, 6), 'li')}</ul>"))
                    page.append((1, _sized(draw, "p", 20, 60)))
            page += [(1, _sized(draw, "p", 15, 60)), (1, "</div>")]
            page += [(0, f"<div>{_links(draw, draw.randint(3, 6), 'p')}</div>"), (0, f"<div>{_said(draw, 1, 3, False)}</div>")]
            pages.append(page)
            continue
        page += [(0, _aside(draw)) for _ in range(draw.randint(1, 3))]
        page.append((1, f"<{sort}><h1>{_said(draw, 2, 10, False)}</h1>"))
        for _ in range(draw.randint(1, 7)):
            page.append((1, _paragraph(draw)))
            if draw.random() < 0.15:
                page.append((1, f"<h2>{_said(draw, 1, 5, False)}</h2>"))
            if draw.random() < 0.12:
                page.append((0, f"<ul>{_links(draw, draw.randint(3, 6), 'li')}</ul>"))
                page.append((1, _paragraph(draw, "p")))
            if draw.random() < 0.12:
                page.append((0, f"<div class={draw.choice(_CLASSES)}>{_said(draw, 3, 60)}</div>"))
        page.append((1, f"</{sort}>"))
        page += [(0, _aside(draw)) for _ in range(draw.randint(0, 3))]
        pages.append(page)
    return pages


@dataclass
class Tree:
    """A binary classification tree on numbers, split by Gini impurity; ties take the first split."""

    max_depth: int = 8
    least: int = 4
    nodes: list[tuple] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.nodes = []
        self._grow(x, y, self.max_depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        here = len(self.nodes)
        self.nodes.append((-1, 0.0, -1, -1, int(2 * y.sum() >= len(y))))
        best = (2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, -1, 0.0)
        for k in range(x.shape[1] if depth else 0):
            for cut in np.unique(x[:, k])[:-1]:
                left = x[:, k] <= cut
                if min(left.sum(), (~left).sum()) < self.least:
                    continue
                cost = sum(2 * p * (1 - p) * len(s) for s in (y[left], y[~left]) for p in [s.mean()])
                if cost < best[0] - 1e-9:
                    best = (cost, k, float(cut))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            one, two = self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)
            self.nodes[here] = (best[1], best[2], one, two, self.nodes[here][4])
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), int)
        feature, cut, one, two, label = (np.array(c) for c in zip(*self.nodes))
        for _ in range(self.max_depth):
            inner = feature[at] >= 0
            low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, one[at], two[at]), at)
        return label[at]


def trained(table: list[list[tuple[int, str]]] | None = None) -> Tree:
    """The tree for a labelled table: each piece adds blocks to its page, all with its label."""
    xs, ys = [], []
    for page in labelled_pages() if table is None else table:
        ends = [len(blocks("".join(piece for _, piece in page[:k]))) for k in range(len(page) + 1)]
        xs.append(features(blocks("".join(piece for _, piece in page))))
        ys += [label for (label, _), a, b in zip(page, ends, ends[1:]) for _ in range(b - a)]
    return Tree().fit(np.concatenate(xs), np.array(ys, float))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, main in zip(found, tree.predict(features(found))) if main)


def extract(pages: DataFrame, html_col: str = "html", text: str = "text", tree: Tree | None = None) -> DataFrame:
    """``pages`` without ``html_col``, with the main text of each page; "" if there is none.

    Null and empty pages have no text. Pages are read one by one, so repeated rows agree
    and an empty table stays empty. Other columns stay; one named like ``text`` is replaced.
    """
    tree = tree or trained()
    kept = [c for c in pages.columns if c not in (text, html_col)]
    schema = pages.select(*kept).schema.add(text, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p.as_py(), tree) for p in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string())], [*kept, text])

    return pages.select(F.col(html_col).cast("string").alias("_html"), *kept).mapInArrow(run, schema)
