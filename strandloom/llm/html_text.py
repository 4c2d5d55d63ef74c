"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat sequence of text blocks: block-level tags end a block, inline tags do not. Each block has its
word count and link density, those of its neighbours, the kind of its containers by tag and role, and one feature for the
words in their class names. A decision tree, grown on the blocks of the small labelled pages below, keeps or drops each block.

Defined cases: null html is empty and has an empty text; text before the first tag is a block; unclosed tags last until
their container ends, also buttons, pictures and media (``MUTED``), whose text is dropped; unclosed comments, scripts, styles,
frames, titles and text areas last until the end of the page; a ``<`` that starts no tag is text. Inside an article, list items
and table cells that are links stay, and so do formulas; a class or id drops a block only if all words of the name are those of
boilerplate. Rows that repeat are rows of their own; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|(?P<open><(?P<raw>script|style|noscript|iframe|title|textarea)\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][a-z0-9:-]*)(?P<attrs2>[^<>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# Tag classes of HTML.
CONTAINERS = frozenset(
    "html body div section nav header footer aside form article main ul ol dl table tbody thead tfoot tr figure details dialog fieldset".split()
)
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote hr address figcaption caption summary legend center head menu label option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inline elements whose text is not the page's. They end with their end tag, or with the element that they stand in.
MUTED = frozenset("svg template object canvas select button audio video map annotation annotation-xml".split())
FOREIGN = frozenset(["svg"])
#: Elements of svg that may hold HTML, and HTML tags that end svg anywhere else.
INTEGRATION = frozenset(["foreignobject", "desc"])
BREAKOUT = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre
    ruby s small span strong strike sub sup table tt u ul var""".split()
)
_UNQUOTED = re.compile(r"""=\s*[^\s"'>]+$""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav footer aside form fieldset dialog menu label option head legend".split())
ARTICLE_TAGS = frozenset(["article", "main"])
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())

# Words of class and id attributes.
BOILER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion promoted banner
    cookie cookies consent gdpr notice notices notification alert popup modal overlay nav navbar navigation menu menus breadcrumb
    breadcrumbs sidebar aside footer header masthead toolbar topbar share sharing social comment comments respond reply replies
    disqus discussion related recommended recommendations teaser newsletter subscribe subscription signup login register search widget
    pagination pager paging tags tagcloud byline copyright legal disclaimer skip toc""".split()
)
ARTICLE_WORDS = frozenset("article content post entry story text body main".split())
#: Words that say nothing beside one of the above: ``related-posts-list`` is boilerplate, ``related-work`` is not.
NEUTRAL_WORDS = frozenset(
    """a an and the of for by to in box list lists link links section block blocks wrapper wrap container area bar inner outer top bottom left
    right site page global primary secondary item items group panel unit slot row col column inline articles posts stories entries news""".split()
)
#: Layout words do not make an article boilerplate: ``<article class="post has-sidebar">``.
LAYOUT_WORDS = frozenset("sidebar header nav menu footer aside tags search banner".split())


@dataclass
class Block:
    text: str
    words: int
    density: float
    kind: bool  # containers are boilerplate by tag, role or being hidden
    named: int  # class names: 1 boilerplate, -1 article, 0 neither
    article: int
    heading: bool
    item: bool

    @property
    def boiler(self) -> bool:
        return self.kind or self.named > 0


def _nature(tag: str, attrs: str) -> tuple[bool, int, int]:
    """(kind, named, article) of an element as in Block; article is 3 for the tag itself, 2 for the main part of a page, else 0."""
    kind, named, article = tag in BOILER_TAGS, 0, {"article": 3, "main": 2}.get(tag, 0)
    if attrs:
        for m in _ATTR.finditer(attrs):
            name, given = m[1].lower(), m[2] or m[3] or m[4] or ""
            value = given.lower()
            if name in ("class", "id") and tag not in ("body", "html"):
                for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", given).lower().split():
                    found = {w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()}
                    found -= LAYOUT_WORDS if tag in ARTICLE_TAGS else set()
                    # A name with a word of its own (comment-on-method) is no class of boilerplate.
                    if found & BOILER_WORDS and found <= BOILER_WORDS | ARTICLE_WORDS | NEUTRAL_WORDS:
                        named = 1
                    elif not named and found & ARTICLE_WORDS and tag in CONTAINERS:
                        named = -1
            elif name == "role":
                kind |= value in BOILER_ROLES
                article = max(article, {"article": 3, "main": 2}.get(value, 0))
            elif name == "style":
                kind |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            elif name not in ("class", "id"):
                kind |= name == "hidden" or value == "true"
    return kind, named, 0 if kind or named > 0 else article


def _closes_itself(attrs: str) -> bool:
    return attrs.endswith("/") and not _UNQUOTED.search(attrs)


def _still_muted(muted: list[tuple[str, Counter]], tag: str, ends: bool, attrs: str, is_open) -> bool:
    """Take a tag inside muted elements; False if it ends them all and counts for the page."""
    inside = muted[-1][1]
    if tag in MUTED or (tag in INTEGRATION and any(t in FOREIGN for t, _ in muted)):
        if ends or tag in ("button", "select"):  # these two do not nest
            for i in range(len(muted) - 1, -1, -1):
                if muted[i][0] == tag:
                    del muted[i:]
                    break
        if not ends and not (tag in FOREIGN | INTEGRATION and _closes_itself(attrs)):
            muted.append((tag, Counter()))
        return True
    if not ends:
        if tag in ARTICLE_TAGS:
            muted.clear()
        elif muted[-1][0] in FOREIGN and tag in BREAKOUT:
            muted.pop()
            return bool(muted) and _still_muted(muted, tag, ends, attrs, is_open)
        else:
            inside[tag] += 1
    elif tag in BLOCKS or tag == "a":
        while muted and not muted[-1][1][tag]:
            if len(muted) == 1 and not is_open(tag):
                return True  # nothing on the page has this end
            muted.pop()
        if muted:
            muted[-1][1][tag] -= 1
    return bool(muted)


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # open containers: tag, and kind, named and article from here on
    own, heading, item = (False, 0), False, False  # of the block that is open
    parts: list[tuple[str, bool]] = []
    link = 0
    muted: list[tuple[str, Counter]] = []  # open muted elements, and the tags open in each

    def is_open(tag: str) -> bool:
        return tag not in CONTAINERS or any(t == tag for t, *_ in stack)

    def close() -> None:
        nonlocal parts
        if parts:
            text = " ".join(entities.unescape("".join(p for p, _ in parts)).split())
            if text:
                total = max(len(text.split(" ")), 1)
                linked = len(entities.unescape(" ".join(p for p, a in parts if a)).split())
                kind, named, article = stack[-1][1:] if stack else (False, 0, 0)
                out.append(Block(text, total, min(1.0, linked / total), kind or own[0], max(named, own[1]) if own[1] > 0 else named, article, heading, item))
            parts = []

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at and not muted:
            parts.append((page[at : m.start()], link > 0))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"] and muted and muted[-1][0] in FOREIGN and _closes_itself(m["open"][:-1]):
                at = m.end("open")
            if m["raw"] and not muted and m["raw"].lower() not in ("script", "style", "noscript"):
                parts.append((" ", False))
            continue
        ends = bool(m["end"] or m["end2"])
        attrs = m["attrs"] or m["attrs2"] or ""
        if muted and _still_muted(muted, tag, ends, attrs, is_open):
            continue
        if tag in MUTED:
            if not ends:
                parts += [(" ", False)] if tag != "template" else []
                if not (tag in FOREIGN and _closes_itself(attrs)):
                    muted.append((tag, Counter()))
            continue
        if tag == "a":
            link = max(0, link - 1) if ends else 1
        elif tag == "br":
            parts.append((" ", link > 0))
        elif tag in BLOCKS:
            close()
            link = 0
            own, heading, item = (False, 0), False, False
            if tag in CONTAINERS:
                if not ends:
                    kind, named, article = _nature(tag, attrs)
                    above = stack[-1][1:] if stack else (False, 0, 0)
                    if tag == "header":
                        kind |= above[2] < 3
                    if tag != "main":
                        kind |= above[0]
                        named = above[1] if above[1] > 0 or not named else named
                    stack.append((tag, kind, named, max(above[2], article)))
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            del stack[i:]
                            break
            elif not ends:
                own = _nature(tag, attrs)[:2]
                heading, item = tag in HEADINGS, tag in ("li", "dt", "dd", "td", "th")
    if at < len(page) and not muted:
        parts.append((page[at:], link > 0))
    close()
    return out


FEATURES = ("kind", "named", "inside", "outside", "heading", "item", "words", "density", "words before", "density before", "words after", "density after")
NEIGHBOURS = FEATURES[8:]

# The labelled table: small pages, where +n stands for n words of main text and -n for n other words.
LABELLED = (
    # Articles among menus, adverts, notices and footers.
    """<nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-12</div><article><h1>+8</h1><p>+60<p>+1<p>+45<p>+200</article><footer>-9</footer>""",
    """<header><a>-1</a> -6</header><nav><a>-1</a> <a>-1</a></nav><article><header><h1>+4</h1></header><p>+30 <a>+9</a> +3<p>+2<ul><li>+6<li>+20 <a>+4</a><li><a>+3</a></ul>
       <div class=share>-2</div><blockquote>+12</blockquote><form><label>-1</label></form></article><section id=comments><h3>-1</h3><article class=comment><p>-25</article></section>
       <aside><h4>-2</h4><p>-40</aside><footer>-3 <a>-2</a></footer>""",
    """<div>-9</div><article><h2>+5</h2><p>+1</article><div>-30</div><p>-12<h3>-4</h3><ul><li>-8<li><a>-2</a></ul><footer>-14</footer>""",
    """<div class=cookie-notice>-25</div><main><h1>+3</h1><p>+80<p><a>+12</a><p>+3<table><tr><td>+1<td>+2<tr><td>+9<td>+1</table><p>+300<p>+6</main><div class=newsletter>-18</div>""",
    """<article><p>+90<p>+3<h2>+1</h2><ul><li><a>+5</a><li><a>+1</a><li><a>+9</a></ul><p>+14<p class=byline>-4<p>+700<p>+4</article><p>-50<p>-22""",
    """<article><p>+2</article>""", """<article><h1><a>+5</a></h1><p><a>+2</a><p>+40<div class=promo>-60</div><p>+1</article><div>-3</div>""",
    """<p>-60<article><h1>+12</h1><p>+900<p>+1<ul><li>+30 <a>+12</a><li><a>+8</a> +1<li>+10</ul><p>+20 <a>+70</a></article><p>-45<div><a>-3</a> -1</div>""",
    """<article><p>+40<ul><li>+2<li><a>+2</a></ul><p>+5<ul><li><a>+3</a><li>+7<li><a>+2</a></ul><h3>+2</h3><ul><li><a>+2</a><li><a>+4</a></ul><p>+3<p>+1</article>""",
    """<article><p>+1<p>+2<p>+1</article>""", """<article><p>+3<ul><li>+1<li><a>+1</a><li>+3</ul></article>""", """<article><p>+4<p><a>+3</a></article>""", """<article><p>+60<p>+5 <a>+1</a></article>""",
    """<article><p>+10<p><a>+3</a><p>+5<p><a>+4</a><p>+12<p><a>+2</a><p>+1<ul><li><a>+3</a><li>+4 <a>+2</a></ul></article>""",
    # Boilerplate by its elements, with few links in it.
    """<nav>-40</nav><article><p>+20<p>+1</article><footer>-60</footer>""", """<article><p>+30<form><p>-20<p>-3</form><aside>-50</aside><p>+2<aside><p>-5</aside></article>""",
    """<article><p>+9<footer>-1</footer><p>+8<aside>-14</aside></article>""", """<form><p>-4<p>-6</form><article><h1>+2</h1><aside><h3>-2</h3><p>-30</aside><p>+70</article>""",
    """<p>+60<nav>-3</nav><p>+50<aside>-40</aside><p>+45<aside><p>-30<p>-50</aside><footer>-30</footer>""", """<header>-20</header><p>+40<p>+30<footer><p>-12<p>-25</footer>""",
    """<div class=ad>-30</div><p>+40<div class=ad>-45</div><p>+50<div class=promo><p>-20<p>-40</div>""",
    # No article element, but containers named so.
    """<div class=menu><a>-1</a></div><div class=content><h1>+6</h1><p>+50<p>+2<ul><li>+4<li>+1<li><a>-2</a><li><a>-3</a></ul><p>+18</div><div class=footer>-8</div>""",
    """<div id=post-body><p>+3<p>+1<h2>+2</h2><p>+9<div class=related><h3>-2</h3><ul><li><a>-7</a><li><a>-6</a></ul></div></div><div class=sidebar><p>-45<p>-20</div>""",
    # Nothing but flat blocks: long text with few links, and what stands next to it.
    """<div><a>-1</a> <a>-1</a></div><div><h2>+1</h2><p>+22<p>+22</div><div class=footer>-1</div>""",
    """<p><a>-2</a><p><a>-3</a><p>-4<p><a>-2</a><h1>+7</h1><p>+40<p>+3<p>+50<p>+25 <a>+3</a><p>+60<p>-5 <a>-1</a>""",
    """<ul><li><a>-1</a><li><a>-1</a></ul><p>+45<p>+2<p>+22<h3>+4</h3><p>+60<ul><li>+12<li>+10<li>+14</ul><p>+33<h3>-2</h3><ul><li><a>-3</a><li><a>-4</a><li>-15 <a>-20</a></ul>""",
    """<div>-2</div><div><a>-3</a> -3</div><div><a>-2</a></div><p>+40 <a>+12</a><p>+90<p>+4<p>+18<p>-6""",
    """<div>-6</div><div><a>-2</a></div><div>-4</div><div><a>-2</a> <a>-1</a></div><div>-20 <a>-60</a></div><p>+33<p>+19<div><a>-5</a></div><div>-8</div>""",
    """<h1>+5</h1><p>+25<p>+30<p>+1<p>+28<h2>+2</h2><p>+14<p>+40<p><a>-6</a><p>-2<p><a>-2</a>""",
    """<article><p>+12<ul><li>+6 <a>+12</a><li>+3 <a>+4</a><li>+5 <a>+13</a></ul><p>+2</article>""", """<h2>+4</h2><p>+30<p>+45<p>+25""", """<p>+50<p>+3<p>+33""",
    """<h1>+3</h1><p>+150""", """<p>+60<p>+12<p>+80<h2>-3</h2><p><a>-1</a> <a>-2</a><p>-9 <a>-8</a>""",
)


def labelled(page: str) -> tuple[str, list[int]]:
    """A labelled page as HTML, and the label of each of its blocks."""
    full = re.sub(r"([+-])(\d+)", lambda m: m[1] + " ".join(["w"] * int(m[2])), page)
    return full, [int(b.text.startswith("+")) for b in blocks(full)]


class Tree:
    """A binary decision tree grown by Gini impurity; of equal splits the first feature and lowest threshold win."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.value = int(y.mean() >= 0.5)
        self.feature = None
        if y.min() == y.max():
            return
        best = (len(y) * 2 * y.mean() * (1 - y.mean()), None, None)
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for t in (levels[1:] + levels[:-1]) / 2:
                low = x[:, f] <= t
                score = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                if score < best[0] - 1e-9:
                    best = (score, f, t)
        _, self.feature, self.threshold = best
        if self.feature is not None:
            low = x[:, self.feature] <= self.threshold
            self.low, self.high = Tree(x[low], y[low]), Tree(x[~low], y[~low])

    def predict(self, row: tuple) -> int:
        node = self
        while node.feature is not None:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.value


def features(found: list[Block]) -> list[tuple]:
    """One row of FEATURES for each block. Article means the surest kind of article that the page has."""
    has = max((b.article for b in found if not b.boiler), default=0)
    none = Block("", 0, 0.0, False, 0, 0, False, False)
    around = [none, *found, none]
    return [
        (b.kind, b.named, b.article == has > 0, b.article < has, b.heading, b.item, b.words, b.density, p.words, p.density, n.words, n.density)
        for p, b, n in zip(around, found, around[2:], strict=False)
    ]


def grown(without: tuple[str, ...] = ()) -> Tree:
    """The tree of the labelled pages; it does not see the features ``without``."""
    x, y = [], []
    for page in LABELLED:
        full, labels = labelled(page)
        x += features(blocks(full))
        y += labels
    table = np.array(x, float)
    table[:, [FEATURES.index(f) for f in without]] = 0
    return Tree(table, np.array(y, float))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, features(found), strict=True) if tree.predict(row))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (page_id, url, html)."""
    tree = grown()

    def one(page_id, url, page):
        text = main_text(page, tree)
        yield page_id, url, text, len(text)

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages, ["page_id", "url", "html"], one, f"page_id {kind}, url string, text string, n_chars bigint")
