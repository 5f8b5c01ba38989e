"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks. A classifier of single blocks, a logistic regression fitted here on
blocks of made pages, looks at the elements and names around a block, at its length, links and
sentences; its log-odds become the terminal capacities of a flow network. Neighbours in the page, and
blocks with the same parent, are joined by edges, the stronger the nearer they are in the tree, that a
labelling pays for when it parts them. The maximum flow gives the cheapest labelling of the page as a
whole. Log-odds are cut off at MOST, which the edges of a block can outweigh.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_columns

#: A tag from its start. Quotes open a value after "=" only; possessive, so no text is looked at twice.
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+))?+)*+)>"
)
_HINT = re.compile(r"(?:^|[\s\"'])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)

#: HTML and MathML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe object canvas textarea select audio video head title annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr math maction merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot "
    "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml".split()
)
#: An open p ends where one of these starts.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
#: An open element of the first kind ends where one of the second starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Class, id or role names of boilerplate, by itself or with more words ("site-footer"). Names that tell what an
#: element has, or what it is tagged with, say nothing of its text.
_BAD = (
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|side|footer|header|masthead|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|comments?|commentlist|disqus|replies|respond|reviews?|share|sharing|social|"
    r"related|recommend\w*|newsletter|subscribe|signup|login|search\w*|pag(?:er|ination)|widget|toolbar|tags?|copyright|legal|"
    r"disclaimer|complementary|navigation|contentinfo)"
)
BAD_NAME = re.compile(_BAD, re.I)
BAD_PART = re.compile(
    rf"(?!(?:has|have|with|without|no|not|is|in|tag|tags|category|cat|topic|format|type|single|page|post)[_\-])"
    rf"(?:[\w\-]*[_\-])?{_BAD}(?:[_\-][\w\-]*)?",
    re.I,
)
GOOD_NAMES = re.compile(r"(?:^|[\s_\-])(?:article\w*|content|entry|post|story|main|body|text)(?:$|[\s_\-])", re.I)
#: Elements whose names say nothing of single blocks.
WHOLE = frozenset("html body main article".split())
#: What an element says of the text in it. The kinds after FRAME do not count where the element holds most of the page's text.
FRAME, ASIDE, FORM, HEADER, NAMED, PART = 1, 2, 4, 8, 16, 32
KINDS = {
    "nav": FRAME, "footer": FRAME, "menu": FRAME, "dialog": FRAME, "aside": ASIDE, "form": FORM, "fieldset": FORM, "button": FORM,
    "header": HEADER,
}
FEATURES = (
    "frame", "aside", "form", "header", "named", "part", "good", "article", "article_elsewhere", "links", "length", "sentences",
    "short", "paragraph", "item", "heading",
)
#: Log-odds are cut off here; edges between neighbours with one parent (or inside each other's), with one grandparent, and
#: between all others, and from a block to the last one of its element's name with the same parent.
MOST, NEAR, COUSIN, FAR, SIBLING = 3.0, 1.0, 0.4, 0.1, 0.6
#: Capacities are whole numbers of this part of a log-odds.
UNIT = 1000
#: Made pages that the classifier is fitted on, and the weight of its penalty.
PAGES, PENALTY = 300, 1.0


class Block:
    """Text between block-level tags, and what is known of its place."""

    __slots__ = ("text", "own", "parent", "grand", "tag", "linked", "marked", "article", "good", "kinds")

    def __init__(self, text: str, linked: int, place: _Open) -> None:
        self.text, self.linked = text, linked
        self.own, self.parent, self.grand, self.tag = place.number, place.parent, place.grand, place.name
        self.marked, self.article, self.good, self.kinds = place.marked, place.article, place.good, 0


class _Open:
    """An open element. base: place in the stack of the nearest element that is not inline; marked: number of the nearest mark."""

    __slots__ = ("name", "number", "parent", "grand", "base", "link", "hidden", "article", "good", "marked")


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, comments, scripts and hidden elements are left out.

    Each tag takes time that does not depend on how deep it is nested. A tag that never ends takes the rest of
    the page with it, as in a browser.
    """
    out: list[Block] = []
    marks: list[tuple[int, int]] = [(-1, 0)]  # of marked elements: number of the mark around it, kinds
    root = _Open()
    root.name, root.number, root.parent, root.grand, root.base, root.marked = "", 0, -1, -1, 0, 0
    root.link = root.hidden = root.article = root.good = False
    stack, places = [root], {}  # open elements; their places in the stack by name
    parts: list[str] = []
    linked = number = 0
    at, size, place = 0, len(page), root

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "" if place.hidden else " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, place))
            parts, linked = [], 0

    def add(text: str) -> None:
        nonlocal place, linked
        top = stack[-1]
        if not text or top.hidden and not stack[top.base].hidden:
            return
        if not parts or (place.name in INLINE and not text.isspace()):
            place = stack[top.base]
        parts.append(text)
        if top.link:
            linked += len(text)

    def close(k: int) -> None:
        for e in stack[k:]:
            places[e.name].pop()
        del stack[k:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        follows = page[start + 1 : start + 4]
        if follows == "!--":
            add(page[at:start])
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else size
            continue
        if follows[:1] in ("!", "?") and follows or follows[:1] == "/" and not follows[1:2].isalpha():
            add(page[at:start])
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        if not follows.lstrip("/")[:1].isalpha() or not follows.lstrip("/")[:1].isascii():
            add(page[at : start + 1])
            at = start + 1
            continue
        add(page[at:start])
        found = _TAG.match(page, start)
        if not found:
            break
        at = found.end()
        name, attributes = found[2].lower(), found[3]
        inline = name in INLINE
        if not inline:
            flush()
        if found[1]:
            k = places[name][-1] if places.get(name) else 0
            if k and (not inline or k > stack[-1].base):
                close(k)
            continue
        if name in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?:[\s/][^>]*)?>", re.I).search(page, at)
                at = end.end() if end else size if name != "head" else at
            continue
        if name in VOID:
            continue
        base = stack[-1].base
        if name in ENDS_P and stack[base].name == "p":
            close(base)
        for closed, starts in ENDS.items():
            if name in starts and stack[-1].name == closed:
                close(len(stack) - 1)
        top, e = stack[-1], _Open()
        number += 1
        e.name, e.number, e.parent, e.grand = name, number, top.number, top.parent
        e.base = top.base if inline else len(stack)
        e.link, e.hidden, e.good, e.marked = top.link or name == "a", top.hidden, top.good, top.marked
        e.article = top.article or name in ("article", "main")
        kinds = 0 if name == "header" and top.article else KINDS.get(name, 0)
        if attributes:
            e.hidden = e.hidden or _HIDDEN.search(attributes) is not None
            for m in _HINT.finditer(attributes):
                names = (m[1] or m[2] or m[3] or "").split()
                if name not in WHOLE:
                    if any(BAD_NAME.fullmatch(x) for x in names):
                        kinds |= NAMED
                    elif any(BAD_PART.fullmatch(x) for x in names):
                        kinds |= PART
                e.good = e.good or any(GOOD_NAMES.search(x) for x in names)
        if kinds:
            marks.append((e.marked, kinds))
            e.marked = len(marks) - 1
        places.setdefault(name, []).append(len(stack))
        stack.append(e)
    flush()
    _judge(out, marks)
    return out


def _judge(blocks: list[Block], marks: list[tuple[int, int]]) -> None:
    """Sets the ``kinds`` of blocks: those of all marked elements around them that count.

    An element counts, but for FRAME, if it holds at most half of the text outside frames, or if an article lies outside it.
    """
    n = len(marks)
    frame = [0] * n
    for k in range(1, n):
        around, kinds = marks[k]
        frame[k] = frame[around] | kinds & FRAME
    held, articles = [0] * n, [0] * n
    for b in blocks:
        if not frame[b.marked]:
            held[b.marked] += len(b.text)
            articles[b.marked] += b.article
    for k in range(n - 1, 0, -1):
        held[marks[k][0]] += held[k]
        articles[marks[k][0]] += articles[k]
    valid = [0] * n
    for k in range(1, n):
        around, kinds = marks[k]
        counts = 2 * held[k] <= held[0] or articles[k] < articles[0]
        valid[k] = valid[around] | (kinds if counts else kinds & FRAME)
    for b in blocks:
        b.kinds = valid[b.marked]


def features(block: Block, articles: bool) -> list[float]:
    """One row of FEATURES, from the whole text of a block. articles: the page has blocks in an article element."""
    n = len(block.text)
    return [
        *(float(block.kinds & k > 0) for k in (FRAME, ASIDE, FORM, HEADER, NAMED, PART)),
        float(block.good), float(block.article), float(articles and not block.article), min(block.linked / n, 1.0), math.log(n) / 5,
        math.log1p(len(re.findall(r"[.!?…](?:\s|$)", block.text))), float(n < 25), float(block.tag in ("p", "blockquote", "pre")),
        float(block.tag in ("li", "td", "dd", "dt", "th")), float(block.tag in ("h1", "h2", "h3", "h4", "h5", "h6")),
    ]


def made_pages(n: int = PAGES, seed: int = 5) -> Iterator[tuple[str, set[str]]]:
    """Pages in many layouts with the texts of their content blocks: what the classifier is fitted on."""
    rng = random.Random(seed)
    pick = rng.choice
    word = lambda: "".join(pick("bcdfglmnprst") + pick("aeiou") for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(4, 18).capitalize() + pick([".", ".", ".", "!", "?"])
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    for _ in range(n):
        content: set[str] = set()

        def keep(text: str) -> str:
            content.add(text)  # noqa: B023
            return text

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.55:
                return f"<p>{keep(prose(1, 6))}</p>"
            if kind < 0.65:
                return f"<p>{keep(words(1, 3).capitalize() + '.')}</p>"
            if kind < 0.75:
                a, b, c = words(5, 12), words(1, 3), words(4, 9) + "."
                keep(f"{a} {b} {c}")
                return f'<p>{a} <a href="/{word()}">{b}</a> {c}</p>'
            if kind < 0.82:
                return f"<h{(k := rng.randint(2, 4))}>{keep(words(2, 6).capitalize())}</h{k}>"
            if kind < 0.9:
                return "<ul>" + "".join(f"<li>{keep(words(3, 12))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
            if kind < 0.94:
                return f"<blockquote>{keep(prose(1, 2))}</blockquote>"
            return f"<div>{keep(prose(1, 4))}</div>"

        def odd() -> str:
            """Boilerplate that also stands inside articles."""
            return pick([
                lambda: f'<div class="{pick(["ad", "advert", "sponsored", "promo", "share", "social", "related", "newsletter-box", "ad-slot", "author-widget"])}">{pick([words(2, 6), prose(1, 2), link() + " " + link()])}</div>',
                lambda: f"<aside>{prose(1, 3)}</aside>",
                lambda: f"<form><label>{words(1, 4)}</label><input><button>{word()}</button></form>",
                lambda: f'<div class="{pick(["tags", "breadcrumb", "pagination"])}">{link()} {link()}</div>',
            ])()

        title = f"<h1>{keep(words(3, 8).capitalize())}</h1>"
        parts = [paragraph() for _ in range(rng.randint(1, 12))]
        for _ in range(pick([0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), odd())
        comments = "".join(f"<{(t := pick(['p', 'li', 'div']))}>{prose(1, 3)}</{t}>" for _ in range(rng.randint(1, 6)))
        comments = f'<{(t := pick(["section", "div"]))} {pick(["class", "id"])}="{pick(["comments", "comment-list", "respond", "reviews"])}">{comments}</{t}>'
        inside = pick(["", "", comments])
        head = pick([title, f"<header>{title}</header>"])
        body = head + "".join(parts) + inside
        article = pick([
            lambda: f"<article>{body}</article>", lambda: f"<main>{body}</main>", lambda: f'<div id="content">{body}</div>',
            lambda: f'<div class="post entry-content">{body}</div>', lambda: f"<div><div>{title}{''.join(parts)}{inside}</div></div>",
            lambda: f"<article>{body}</article>",
        ])()
        links = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 9)))
        nav = pick([lambda: f"<nav><ul>{links}</ul></nav>", lambda: f'<div class="{pick(["menu", "navbar", "top-nav"])}"><ul>{links}</ul></div>', lambda: f"<ul>{links}</ul>"])()
        header = pick([lambda: "", lambda: f"<header><h2>{words(1, 4)}</h2><p>{words(3, 8)}</p></header>", lambda: f'<div id="header">{words(1, 4)}</div>'])()
        notice = pick([lambda: "", lambda: f'<div class="{pick(["cookie-notice", "notice", "banner", "consent"])}">{prose(1, 2)}</div>'])()
        side = pick([lambda: "", lambda: f'<{(t := pick(["aside", "div"]))} class="{pick(["sidebar", "side", "widget"])}"><h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p></{t}>'])()
        after = pick(["", comments]) if not inside else ""
        foot = pick([lambda: f"<footer>&copy; {word()} {prose(1, 2)}</footer>", lambda: f'<div class="{pick(["footer", "site-footer", "copyright"])}"><p>{prose(1, 2)}</p>{link()}</div>'])()
        yield f"<html><body>{header}{nav}{notice}{article}{side}{after}{foot}</body></html>", content


@lru_cache(maxsize=4)
def fitted(n: int = PAGES, seed: int = 5) -> tuple[float, ...]:
    """Weights of FEATURES and, last, of a constant: a logistic regression by Newton's method on ``n`` made pages."""
    rows, labels = [], []
    for page, content in made_pages(n, seed):
        blocks = blocks_of(page)
        articles = any(b.article for b in blocks)
        for b in blocks:
            rows.append([*features(b, articles), 1.0])
            labels.append(b.text in content)
    x, y = np.array(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(len(w)), x.T @ (y - p) - PENALTY * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(round(float(v), 6) for v in w)


def excesses(blocks: list[Block], weights: tuple[float, ...]) -> list[int]:
    """Per block what calling it boilerplate costs, less what calling it content costs."""
    articles = any(b.article for b in blocks)
    odds = [sum(a * w for a, w in zip(features(b, articles), weights)) + weights[-1] for b in blocks]
    return [round(UNIT * max(-MOST, min(MOST, x))) for x in odds]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(block, block, capacity): neighbours in the page, and blocks of one name in one parent with the last such."""
    out, last = [], {}
    for j, b in enumerate(blocks):
        if j:
            a = blocks[j - 1]
            if a.parent == b.parent or a.own in (b.own, b.parent) or a.parent == b.own:
                near = NEAR
            else:
                near = COUSIN if a.grand == b.grand or b.parent == a.grand or a.parent == b.grand else FAR
            out.append((j - 1, j, round(UNIT * near)))
        i = last.get((b.parent, b.tag))
        if i is not None:
            out.append((i, j, round(UNIT * SIBLING)))
        last[b.parent, b.tag] = j
    return out


def cut(excess: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each block is on the source's side of a minimum cut (the least one, if there are several).

    A block whose excess is above the capacities of all its edges lies on its side in every minimum cut:
    the flow fills these edges, so the neighbours' excess takes their place. That settles most blocks in
    one pass; the flow through the others is found by Dinic's algorithm.
    """
    n = len(excess)
    excess = list(excess)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        around[i][j] = around[i].get(j, 0) + c
        around[j][i] = around[j].get(i, 0) + c
    sums, side = [sum(x.values()) for x in around], [0] * n
    queue = list(range(n))
    while queue:
        i = queue.pop()
        if side[i] or abs(excess[i]) <= sums[i]:
            continue
        side[i] = 1 if excess[i] > 0 else -1
        for j, c in around[i].items():
            if not side[j]:
                excess[j] += side[i] * c
                sums[j] -= c
                queue.append(j)
    left = [i for i in range(n) if not side[i]]
    if left:
        reached = _flow({i: excess[i] for i in left}, {i: {j: c for j, c in around[i].items() if not side[j]} for i in left})
        for i in left:
            side[i] = 1 if i in reached else -1
    return [s > 0 for s in side]


def _flow(excess: dict[int, int], caps: dict[int, dict[int, int]]) -> set[int]:
    """What can still be reached from blocks with excess after a maximum flow to those that lack some."""
    while True:
        level = {i: 0 for i, e in excess.items() if e > 0}
        queue, found = list(level), False
        for i in queue:
            for j, c in caps[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
                    found = found or excess[j] < 0
        if not found:
            return set(level)
        ways = {i: list(caps[i]) for i in level}
        for start in [i for i in level if level[i] == 0]:
            path = [start]
            while path and excess[start] > 0:
                i = path[-1]
                if excess[i] < 0:
                    flow = min(excess[start], -excess[i], *(caps[a][b] for a, b in zip(path, path[1:])))
                    excess[start] -= flow
                    excess[i] += flow
                    keep = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        caps[a][b] -= flow
                        caps[b][a] += flow
                        if not caps[a][b]:
                            keep = min(keep, k + 1)
                    del path[keep:]
                    continue
                while ways[i]:
                    j = ways[i][-1]
                    if caps[i][j] > 0 and level.get(j, -1) == level[i] + 1:
                        path.append(j)
                        break
                    ways[i].pop()
                else:
                    path.pop()
                    if path:
                        ways[path[-1]].pop()


def main_text(page: str, weights: tuple[float, ...] | None = None) -> str:
    """The blocks labelled as content, in page order, joined by one space."""
    blocks = blocks_of(page)
    return " ".join(b.text for b, keep in zip(blocks, cut(excesses(blocks, weights or fitted()), edges_of(blocks))) if keep)


def extract_text(pages: DataFrame, n_pages: int = PAGES, seed: int = 5) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every row of ``pages``, from the whole of ``html``.

    A null or empty page has an empty text, as has one without content. Repeated rows each get a
    row, an empty table gives none, and further columns are ignored. ``n_pages`` bounds what the
    classifier is fitted on (on the driver; some 20 blocks a page).
    """
    weights = fitted(n_pages, seed)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(2)]
            yield {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    read = [F.col("page_id"), F.col("url"), F.coalesce("html", F.lit("")).alias("html")]
    return map_columns(pages, read, "page_id bigint, url string, text string, n_chars bigint", body)
