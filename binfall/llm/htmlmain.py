"""Main text of web pages: boosted trees over DOM nodes, and a decoding along the tree.

A page is read as a tree of elements. Every element gets features of its tag, its attributes' tokens, its place, depth and siblings,
and of the density of text, links and tags in its subtree; boosted trees turn them into the probability that the element belongs to
the article. Decoding gives every element one of three states, around (a container of the article), inside, or apart (cut
out of it), of greatest joint probability such that states only ever go on from around to inside to apart on the
way down. An element can so never be in the article when an ancestor has been cut out of it.

No page comes labelled, so the trees learn from pages that ``samples`` makes up: a bounded number, the same at every run. They have articles in
marked containers, in plain ones, in table cells and in none, and texts between elements.

Edge cases: null and empty pages, and pages without an article, give the empty text; broken markup is read as browsers do
where that matters (open paragraphs, list items and cells end, unknown end tags are dropped, elements deeper than ``DEPTH`` are siblings, and text
outside of every element, or after the end of the body, is the body's);
reading and decoding a very long page take time in proportion to it, in one task; rows are independent, so ties, repeated rows and null ids
need no rule; an empty table gives an empty table; extra columns pass through where asked for.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import boosting

# Fixed values of the HTML standard: elements by how they are read and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript textarea title xmp iframe noembed noframes svg math object select option datalist button input audio video canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li listing main menu nav ol p pre search section summary table caption tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open element, and the elements that guard it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK - {"body", "html", "head", "title", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "legend"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: The same without regard to quotes.
UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Tags of a page whose quotes may stay open up to its end, before quotes are no longer heeded: each is searched for to the end.
OPEN_QUOTES = 8
#: Characters of pages that are looked at together.
TOGETHER = 1 << 19
#: Elements nested deeper are children of the element at this depth, as in browsers.
DEPTH = 512
WORDS_OF_ATTRIBUTE = re.compile(r"[a-z]+")
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
LABEL = re.compile(r' data-y="([01])"')

# Words in class, id and role by what they speak for: our choice, of which the trees learn what each kind is worth.
TOKENS = {
    "content": "article content main post entry story text body page prose read reading single blog news",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "advert": "ad ads advert adverts advertisement adsense banner promo promoted sponsor sponsored sponsors",
    "comments": "comment comments commentlist disqus reply replies respond discussion reader reviews",
    "side": "sidebar aside side rail related recommended recommendations widget widgets trending popular more also",
    "edges": "header footer masthead topbar foot head copyright legal site branding logo",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay toast newsletter subscribe subscription signup paywall",
    "tools": "form search login share sharing social follow tools toolbar buttons meta tags byline author rating",
}
KINDS = list(TOKENS)
_KIND = {w: i for i, k in enumerate(KINDS) for w in TOKENS[k].split()}
GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "li dt dd", "a", "div", "section", "article", "main", "nav", "aside", "header", "footer", "form fieldset label input button select textarea", "table tbody thead tr td th", "ul ol dl menu", "b i em strong span u small sub sup code abbr mark time cite q", "figure figcaption img picture", "pre blockquote", "html body"]
_GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}


class Page:
    """The elements of a page in document order, and its texts: (element, raw text), with None between two blocks. Reading takes time in proportion to
    the page: open elements are also kept by tag, and what has no end up to the page's end is looked for a bounded number of times."""

    __slots__ = ("attributes", "depth", "parent", "pieces", "stack", "tag", "where")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attributes, self.pieces = [], [], [], [], []
        #: open elements, and their places in the stack: by tag, and under "" those of all blocks but paragraphs
        self.stack: list[int] = []
        self.where: dict[str, list[int]] = {"": []}
        self._read(source)

    def _now(self) -> int:
        return self.stack[-1] if self.stack else -1

    def _open(self, tag: str, attributes: str, stays: bool) -> None:
        self.tag.append(tag)
        depth = min(len(self.stack), DEPTH)
        self.parent.append(self.stack[depth - 1] if depth else -1)
        self.depth.append(depth)
        self.attributes.append(attributes)
        if stays:
            self.where.setdefault(tag, []).append(len(self.stack))
            if tag in BLOCK and tag != "p":
                self.where[""].append(len(self.stack))
            self.stack.append(len(self.tag) - 1)

    def _cut(self, place: int) -> None:
        """Close the open elements from a place of the stack on."""
        while len(self.stack) > place:
            tag = self.tag[self.stack.pop()]
            self.where[tag].pop()
            if tag in BLOCK and tag != "p":
                self.where[""].pop()

    def _last(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else -1

    def _read(self, source: str) -> None:
        at, pieces, last, quotes = 0, self.pieces, source.rfind(">"), OPEN_QUOTES
        # a tag needs its end; only a comment may go without
        while m := (TOKEN if quotes else UNQUOTED).search(source, at) if at <= last else None:
            if m.start() > at:
                pieces.append((self._now(), source[at : m.start()]))
            at = m.end()
            if end := m[1]:
                self._close(end.lower())
            elif tag := m[2] or (quotes and m[4]):
                attributes = m[3] if m[2] else m[5]
                quotes -= bool(quotes and not m[2])
                tag = tag.lower()
                if tag in CLOSES_P and self._last("p") > self._last(""):
                    self._end(self._last("p"))
                if tag in ENDS:
                    ended, guards = ENDS[tag]
                    place = max(map(self._last, ended))
                    if place > max(map(self._last, guards)):
                        self._end(place)
                if tag in BLOCK:
                    pieces.append(None)
                elif tag == "br":
                    pieces.append((self._now(), " "))
                self._open(tag, attributes, tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle", "use")))
                if tag in RAW:
                    close = re.compile(rf"</{tag}", re.I).search(source, at)
                    at = close.start() if close else len(source)
        # an open comment hides what follows
        if at < len(source) and (hidden := source.find("<!--", at)) != at:
            pieces.append((self._now(), source[at:hidden] if hidden >= 0 else source[at:]))

    def _close(self, tag: str) -> None:
        place = self._last(tag)
        # what follows the end of the body still belongs to it
        if place >= 0 and tag not in ("body", "html"):
            self._cut(place)
        if tag in BLOCK:
            self.pieces.append(None)

    def _end(self, place: int) -> None:
        self._cut(place)
        self.pieces.append(None)


@functools.lru_cache(maxsize=4096)
def _kinds(attributes: str) -> tuple[int, ...]:
    """How many tokens of each kind the class, id and role hold."""
    out = [0] * len(KINDS)
    for _, value in ATTRIBUTE.findall(attributes):
        for w in WORDS_OF_ATTRIBUTE.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()):
            if w in _KIND:
                out[_KIND[w]] += 1
    return tuple(out)


def read(source: str) -> Page:
    """A page with a body: where none begins, all of it is in one, so no text is outside of every element."""
    page = Page(source)
    return page if "body" in page.tag else Page("<body>" + source)


def features(pages: list[Page]) -> np.ndarray:
    """One row for every element of the pages, in order."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    parent = np.concatenate([np.where((q := np.array(p.parent, np.int64)) >= 0, q + at, -1) for p, at in zip(pages, first, strict=False)]) if n else np.zeros(0, np.int64)
    depth = np.array([d for p in pages for d in p.depth], np.int64)
    group = np.array([_GROUP.get(t, -1) for p in pages for t in p.tag], np.int64)
    link = np.array([t == "a" for p in pages for t in p.tag], bool)
    kinds = np.array([_kinds(a) for p in pages for a in p.attributes], float).reshape(n, len(KINDS))
    size, marks = np.zeros(n), np.zeros(n)
    for p, at in zip(pages, first, strict=False):
        unseen = [t in UNSEEN for t in p.tag]
        for piece in p.pieces:
            if piece and piece[0] >= 0 and not unseen[piece[0]]:
                size[at + piece[0]] += len(piece[1])
                marks[at + piece[0]] += piece[1].count(".") + piece[1].count(",")
    has = parent >= 0
    linked, above_bad, above_good = link.copy(), np.zeros(n), np.zeros(n)
    bad = (kinds[:, 1:].sum(1) > 0) | np.isin(group, [8, 9, 10, 11, 12])
    good = (kinds[:, 0] > 0) | np.isin(group, [6, 7])
    levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1]) if n else []
    for rows in levels[1:]:
        up = parent[rows]
        linked[rows] |= linked[up]
        above_bad[rows] = np.maximum(above_bad[up], bad[up])
        above_good[rows] = np.maximum(above_good[up], good[up])
    prose = size * ~linked * (1 - above_bad) * ~bad
    sums = np.stack([size, size * linked, marks, np.ones(n), group == 0, group == 2, group == 1, good, bad, prose], axis=1)
    for rows in reversed(levels[1:]):
        np.add.at(sums, parent[rows], sums[rows])
    children = np.bincount(parent[has], minlength=n) if n else np.zeros(0)
    order = np.arange(n) - first[page]
    key = np.where(has, parent, n + page)
    by = np.lexsort((np.arange(n), key))
    start = np.r_[True, key[by][1:] != key[by][:-1]] if n else np.zeros(0, bool)
    index = np.empty(n)
    index[by] = np.arange(n) - np.maximum.accumulate(np.where(start, np.arange(n), 0)) if n else 0
    _, inverse, siblings = np.unique(key, return_inverse=True, return_counts=True)
    _, alike_at, alike = np.unique(key * 64 + group + 1, return_inverse=True, return_counts=True)
    total = np.maximum(np.bincount(page, size, minlength=len(pages)), 1)[page]
    up = np.where(has, parent, np.arange(n))
    share, links = sums[:, 0] / total, sums[:, 1] / np.maximum(sums[:, 0], 1)
    # how the page's prose lies: below an element, in it and the elements right in it, and whether any element claims to be the content
    nearby = prose.copy()
    np.add.at(nearby, parent[has], prose[has])
    all_prose = np.maximum(np.bincount(page, prose, minlength=len(pages)), 1)[page]
    densest = np.zeros(len(pages))
    np.maximum.at(densest, page, nearby)
    claimed = (np.bincount(page, good, minlength=len(pages)) > 0).astype(float)[page]
    prosy, near = sums[:, 9] / all_prose, nearby / np.maximum(densest[page], 1)
    one_hot = (group[:, None] == np.arange(len(GROUPS))).astype(float)
    return np.column_stack(
        [one_hot, kinds, depth, index, siblings[inverse], alike[alike_at], children, order / np.maximum(np.diff(first)[page], 1)]
        + [np.log1p(sums[:, 0]), np.log1p(size), share, links, sums[:, 2] / np.maximum(sums[:, 0], 1), sums[:, 3] / np.maximum(sums[:, 0], 1), np.log1p(sums[:, 3])]
        + [sums[:, 4], sums[:, 5], sums[:, 6], sums[:, 7] - good, sums[:, 8] - bad, above_good, above_bad]
        + [prosy, prosy[up], near, near[up], prose / all_prose, claimed]
        + [share[up], links[up], one_hot[up][:, [0, 4, 6, 8, 9, 10, 11, 12, 14]], kinds[up]]
    )


def decode(page: Page, probability: np.ndarray) -> np.ndarray:
    """Which elements are inside the article: the best assignment of states around (0), inside (1), apart (2) that never go back."""
    n = len(page.tag)
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    own = np.stack([np.log(1 - p), np.log(p), np.log(1 - p)], axis=1).tolist()
    for i, t in enumerate(page.tag):
        if t in UNSEEN:
            own[i][1] = -1e9
    parent = page.parent
    for i in range(n - 1, -1, -1):
        if (q := parent[i]) >= 0:
            a, b, c = own[i]
            own[q][0] += max(a, b)
            own[q][1] += max(b, c)
            own[q][2] += c
    state = np.zeros(n, np.int64)
    for i in range(n):
        a, b, c = own[i]
        above = state[parent[i]] if parent[i] >= 0 else 0
        state[i] = 2 if above == 2 else (1 if b > c else 2) if above == 1 else (1 if b > a else 0)
    return state == 1


def text_of(page: Page, inside: np.ndarray) -> str:
    blocks, now = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if now and (block := " ".join(html.unescape("".join(now)).split())):
                blocks.append(block)
            now = []
        elif piece[0] >= 0 and inside[piece[0]]:
            now.append(piece[1])
    return "\n".join(blocks)


def extract(sources: list[str], forest: boosting.Forest) -> list[str]:
    pages = [read(s) for s in sources]
    x = features(pages)
    p = forest.probability(x) if len(x) else np.zeros(0)
    out, at = [], 0
    for page in pages:
        out.append(text_of(page, decode(page, p[at : at + len(page.tag)])))
        at += len(page.tag)
    return out


# --- pages to learn from ------------------------------------------------------------------------------------------------


class _Maker:
    """Made-up pages. Every element says in ``data-y`` whether it belongs to the article."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, text: str) -> str:
        return self.r.choice(text.split())

    def words(self, n: int) -> str:
        r = self.r
        out = ["".join(r.choice("aeiounrstlmdé") for _ in range(r.randrange(1, 11))) for _ in range(n)]
        return " ".join(w + r.choice([",", ".", "", "", "", "", "", "%%%", "&amp;"]) for w in out)

    def name(self, kind: str) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        word = self.pick(TOKENS[kind])
        other = self.pick("box wrap area block inner top left col row module x js u l c")
        value = r.choice([word, f"{word}-{other}", f"{other}-{word}", f"{word} {other}", f"{other}_{word}", f"{word}{r.randrange(9)}"])
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def neutral(self) -> str:
        return self.r.choice(["", "", f' class="{self.pick("box wrap container inner col row x u l c wrapper grid")}"'])

    def tag(self, y: int, name: str, inner: str, attributes: str = "") -> str:
        return f'<{name}{attributes} data-y="{y}">{inner}</{name}>'

    def links(self, n: int, listed: bool | None = None) -> str:
        r = self.r
        one = [self.tag(0, "a", self.words(r.randrange(1, 5)), ' href="/x"') for _ in range(n)]
        if listed if listed is not None else r.random() < 0.7:
            return self.tag(0, "ul", "".join(self.tag(0, "li", x) for x in one), self.neutral())
        return r.choice([" ", " | ", ""]).join(one)

    def aside(self) -> str:
        """Something that is not the article, for any place."""
        r = self.r
        kind = r.choice(["advert", "advert", "side", "notice", "tools", "navigation", "comments"])
        if kind == "advert":
            inner = r.choice([self.words(r.randrange(2, 25)), self.tag(0, "a", self.words(4), ' href="/a"'), self.tag(0, "p", self.words(r.randrange(3, 30)))])
            return self.tag(0, r.choice(["div", "div", "aside", "section", "p", "ins"]), inner, f' class="{self.pick(TOKENS["advert"])}"' if r.random() < 0.8 else self.name(kind))
        if kind == "side":
            inner = self.tag(0, r.choice(["h2", "h3", "p"]), self.words(2)) + self.links(r.randrange(2, 8)) + (self.tag(0, "p", self.words(r.randrange(4, 40))) if r.random() < 0.4 else "")
            return self.tag(0, r.choice(["aside", "aside", "div", "section"]), inner, self.name(kind))
        if kind == "notice":
            inner = self.tag(0, r.choice(["p", "span", "div"]), self.words(r.randrange(5, 45))) + (self.tag(0, "button", self.words(1)) if r.random() < 0.6 else self.links(1, False))
            return self.tag(0, r.choice(["div", "div", "section", "aside"]), inner, f' {r.choice(["class", "id"])}="{self.pick(TOKENS["notice"])}{self.pick("-bar -box -x x")}"' if r.random() < 0.8 else self.name(kind))
        if kind == "tools":
            inner = self.tag(0, "label", self.words(2)) + '<input type="text" data-y="0">' + self.tag(0, "button", self.words(1)) + (self.tag(0, "p", self.words(12)) if r.random() < 0.4 else "")
            return self.tag(0, "form", inner, self.name(kind)) if r.random() < 0.7 else self.tag(0, "div", self.links(r.randrange(2, 6)), self.name(kind))
        if kind == "navigation":
            return self.tag(0, r.choice(["nav", "nav", "div", "ul"]), self.links(r.randrange(2, 9), True), self.name(kind))
        return self.comments()

    def comments(self) -> str:
        r = self.r
        one = lambda: self.tag(0, r.choice(["div", "li", "article"]), self.tag(0, r.choice(["span", "b", "h4", "cite"]), self.words(2)) + self.tag(0, "p", self.words(r.randrange(3, 60))), self.name("comments"))
        inner = self.tag(0, r.choice(["h2", "h3"]), self.words(2)) + "".join(one() for _ in range(r.randrange(1, 7)))
        return self.tag(0, r.choice(["section", "div", "ol", "aside"]), inner, f' {r.choice(["class", "id"])}="{r.choice(["comments", "comment-list", "reader-comments", "comments-area", "disqus_thread", "responses replies", "discussion"])}"')

    def prose(self) -> str:
        """One block of the article."""
        r = self.r
        k = r.random()
        text = self.words(r.choice([1, 1, 2, r.randrange(3, 20), r.randrange(20, 150), r.randrange(20, 150)]))
        if k < 0.68:
            if r.random() < 0.3:
                text = r.choice([self.tag(1, r.choice(["b", "em", "span"]), text), text + " " + self.tag(1, "a", self.words(2), ' href="/y"') + " " + self.words(4), f'<b data-y="1">{text}<br data-y="1">'])
            return self.tag(1, "p", text) if r.random() < 0.9 else f'<p data-y="1">{text}'
        if k < 0.78:
            return self.tag(1, r.choice(["h2", "h3", "h4"]), self.words(r.randrange(1, 9)))
        if k < 0.86:
            return self.tag(1, r.choice(["ul", "ol"]), "".join(self.tag(1, "li", self.words(r.randrange(1, 25))) for _ in range(r.randrange(1, 7))))
        if k < 0.90:
            return self.tag(1, "blockquote", self.tag(1, "p", text))
        if k < 0.93:
            return self.tag(1, "table", "".join(self.tag(1, "tr", "".join(self.tag(1, "td", self.words(2)) for _ in range(3))) for _ in range(r.randrange(1, 6))))
        if k < 0.95:
            return self.tag(1, "figure", '<img data-y="1">' + self.tag(1, "figcaption", self.words(6)))
        if k < 0.97:
            return self.tag(1, "pre", text)
        return self.tag(1, r.choice(["div", "section"]), "".join(self.tag(1, "p", self.words(r.randrange(5, 60))) for _ in range(r.randrange(1, 4))), self.neutral())

    def loose(self) -> str:
        """Text right in its container, broken by br elements."""
        r = self.r
        parts = [r.choice([self.words(r.randrange(4, 90)), self.words(r.randrange(4, 40)) + " " + self.tag(1, r.choice(["b", "em", "a"]), self.words(2)) + " " + self.words(9)]) for _ in range(r.choice([1, 1, 2, 5, 9]))]
        return r.choice(['<br data-y="1">', '<br data-y="1"><br data-y="1">', '<p data-y="1">']).join(parts)

    def article(self, loose: bool = False) -> str:
        """The blocks of an article, most often in a container. ``loose``: text may lie between them, right in what they are put in."""
        r = self.r
        blocks = [self.loose() if loose and r.random() < 0.4 else self.prose() for _ in range(r.choice([1, 2, r.randrange(3, 12), r.randrange(10, 30)]))]
        if r.random() < 0.85:
            head = self.tag(1, r.choice(["h1", "h1", "h2"]), self.words(r.randrange(1, 10)))
            blocks.insert(0, self.tag(1, "header", head) if r.random() < 0.1 else head)
        for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
            blocks.insert(r.randrange(1, len(blocks) + 1), self.aside())
        inner = "".join(blocks)
        if r.random() < 0.25:
            inner = self.tag(1, "div", inner, r.choice([self.neutral(), self.name("content")]))
        k = r.random()
        if loose or k < 0.12:
            return inner
        if k < 0.4:
            return self.tag(1, "article", inner, r.choice(["", "", self.name("content")]))
        if k < 0.5:
            return self.tag(1, "main", inner, r.choice(["", self.name("content")]))
        if k < 0.62:
            return self.tag(1, r.choice(["div", "div", "section"]), self.loose() + inner if r.random() < 0.3 else inner, self.neutral())
        if k < 0.7:
            other = self.tag(0, "td", self.links(r.randrange(2, 7)), r.choice(["", ' width="20%"']))
            cells = [other, self.tag(1, "td", inner, r.choice(["", ' valign="top"']))]
            return self.tag(0, "table", self.tag(0, "tr", "".join(cells if r.random() < 0.7 else cells[::-1])), self.neutral())
        return self.tag(1, r.choice(["div", "div", "section"]), inner, f' {r.choice(["class", "id"])}="{r.choice(["content", "article", "post-content", "entry-content", "article-body", "main-content", "story", "post", "text", "main"])}"')

    def page(self) -> str:
        r = self.r
        parts = []
        if r.random() < 0.9:
            nav = self.tag(0, r.choice(["nav", "nav", "div"]), self.links(r.randrange(2, 9)), self.name("navigation") if r.random() < 0.6 else "")
            parts.append(self.tag(0, r.choice(["header", "div"]), r.choice(["", self.tag(0, "h1", self.words(3)), self.tag(0, "p", self.words(6))]) + nav, self.name("edges")) if r.random() < 0.45 else nav)
        parts += [self.aside() for _ in range(r.randrange(3))]
        loose = r.random() < 0.15
        body = self.loose() if loose and r.random() < 0.4 else self.article(loose) if r.random() < 0.96 else ""
        if loose and r.random() < 0.5:
            parts = []
            if r.random() < 0.5:
                return f'<body data-y="1">{body}' + r.choice(["</body></html>", ""])
        for _ in range(r.choice([0, 0, 1, 2])):
            body = r.choice([self.aside() + body, body + self.aside()]) if not loose or parts else body
        for _ in range(0 if loose else r.choice([0, 0, 1, 2])):
            body = self.tag(0, r.choice(["div", "div", "section", "main"]), body, r.choice([self.neutral(), self.neutral(), ' id="page"', ' class="site"', ' id="wrapper"']))
        parts.append(body)
        if r.random() < 0.3:
            parts.append(self.comments())
        parts += [self.aside() for _ in range(r.randrange(3))]
        if r.random() < 0.9:
            foot = r.choice([self.words(r.randrange(2, 30)), self.tag(0, "p", self.words(r.randrange(2, 40))), self.links(5) + self.tag(0, "p", self.words(8))])
            parts.append(self.tag(0, r.choice(["footer", "footer", "footer", "div"]), foot, self.name("edges") if r.random() < 0.5 else ""))
        head = f'<head data-y="0"><title data-y="0">{self.words(4)}</title><style data-y="0">p{{}}</style></head>'
        if not loose and r.random() < 0.06:
            return "".join(parts)
        return f'<!DOCTYPE html><html data-y="0">{head}<body data-y="{int(loose)}">{"".join(parts)}' + r.choice(["</body></html>", "</body></html>", ""])


def samples(count: int, seed: int) -> list[tuple[Page, np.ndarray]]:
    """Made-up pages with the label of every element."""
    out = []
    maker = _Maker(seed)
    for _ in range(count):
        page = read(maker.page())
        labels = np.array([float((m := LABEL.search(a)) is not None and m[1] == "1") for a in page.attributes])
        page.attributes = [LABEL.sub("", a) for a in page.attributes]
        out.append((page, labels))
    return out


@functools.cache
def forest(count: int = 1000, seed: int = 8) -> boosting.Forest:
    """Learn from ``count`` made-up pages."""
    pages = samples(count, seed)
    return boosting.fit(features([p for p, _ in pages]), np.concatenate([y for _, y in pages]), trees=70, depth=5)


def main_text(pages: DataFrame, *, column: str = "html", carry: tuple[str, ...] = ("page_id", "url"), trees: boosting.Forest | None = None) -> DataFrame:
    """The columns in ``carry``, text and n_chars, one row per row of ``pages``."""
    model = pages.sparkSession.sparkContext.broadcast(trees or forest())
    frame = pages.select(*carry, pages[column].alias("__html"))
    schema = T.StructType([*frame.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            some: list[str] = []
            for x in batch.column(len(carry)).to_pylist():
                some.append(x or "")
                # pages are looked at together up to a bounded size; a longer one is looked at alone
                if sum(map(len, some)) > TOGETHER or len(some) == 64:
                    texts += extract(some, model.value)
                    some = []
            texts += extract(some, model.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*carry, "text", "n_chars"])

    return frame.mapInArrow(run, schema)
