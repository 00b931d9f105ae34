"""HTML extraction: gradient-boosted trees over DOM-node features, decoded so that no node is kept under a dropped one.

A page is read into a tree of block elements; inline elements belong to the block around them, and are nodes of their own
inside it where their attributes say something. The trees score
for each node whether its subtree holds main text, from its tag, attribute tokens, text and link density of its
subtree, depth and siblings. The best labelling in which a kept node's ancestors are all kept is found by dynamic
programming; the kept nodes' own text is the result. The model is trained on pages made up here.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_small_batches, tidy_stream

# Fixed values of HTML: elements without content; with raw content, which is no markup and is never shown, or is (xmp);
# inline ones, those of formulas and drawings among them; and the transparent object.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe textarea title desc metadata noembed noframes xmp".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var nobr object "
        "math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics annotation annotation-xml "
        "svg circle defs ellipse g image line lineargradient marker mask path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use"
    ).split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
CLOSES_ITSELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Kinds of tags and of attribute tokens that the trees can ask for.
TAG_KINDS = ["article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside", "form fieldset button input dialog select option optgroup", "table tbody tr td th", "blockquote pre", "figure figcaption", "noscript", "body html", " ".join(sorted(INLINE))]
TOKEN_KINDS = [
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner affiliate",
    "sidebar side aside widget related recommended recommendations popular trending more",
    "footer foot copyright legal colophon",
    "header head masthead topbar top logo branding",
    "comment comments reply replies respond discussion disqus responses",
    "cookie cookies notice consent alert popup modal overlay newsletter subscribe signup paywall gdpr warning message",
    "share sharing social follow login search form contact buttons tools meta author byline tags",
    "content article post entry story main body text maincontent prose copy",
]
_TOKEN = {t: i for i, kind in enumerate(TOKEN_KINDS) for t in kind.split()}
_TAG = {t: i for i, kind in enumerate(TAG_KINDS) for t in kind.split()}
_MARKUP = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SENTENCE = re.compile(r"[.!?,;:]")


def _said(attributes: str) -> tuple[int, bool]:
    """The kinds of an element's attribute tokens, as bits, and whether it is hidden."""
    kinds, hidden = 0, False
    for a in _ATTRIBUTE.finditer(attributes) if attributes else ():
        value, key = (a[2] or a[3] or a[4] or "").lower(), a[1].lower()
        if key in ("class", "id", "role"):
            for w in _WORDS.findall(value):
                if w in _TOKEN:
                    kinds |= 1 << _TOKEN[w]
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            hidden = True
    return kinds, hidden


class Page:
    """Block nodes of one page in document order: parent (-1 at the root), tag and token kinds, text runs."""

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.hidden = [-1], ["body"], [0], [False]
        self.runs: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        self.inline = [0]
        stack: list[tuple[str, int]] = [("body", 0)]  # open elements and the block node each is in
        block, links, at, fresh = 0, 0, 0, True  # fresh: the next text starts a block
        while True:
            m = _MARKUP.search(source, at)
            piece = source[at : m.start() if m else len(source)]
            if piece:
                if fresh and not piece.isspace():
                    block, fresh = block + 1, False
                self.runs.append((stack[-1][1], block, html.unescape(piece) if "&" in piece else piece, links > 0))
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        for tag, _ in stack[k:]:
                            links -= tag == "a"
                            fresh = fresh or tag not in INLINE
                        del stack[k:]
                        break
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
                if name == "xmp":
                    block, fresh = block + 1, True
                    self.runs.append((stack[-1][1], block, source[at : end.start() if end else len(source)], links > 0))
                at = end.end() if end else len(source)
                continue
            if name in VOID:
                if name == "hr":
                    fresh = True
                else:
                    self.runs.append((stack[-1][1], block, " " if name in ("br", "wbr") else "", links > 0))
                    self.inline[stack[-1][1]] += 1
                continue
            if name in INLINE:
                self.inline[stack[-1][1]] += 1
                if not m[3].rstrip().endswith("/") or name == "a":
                    kinds, hidden = _said(m[3])
                    stack.append((name, self._node(stack[-1][1], name, kinds, hidden) if kinds or hidden else stack[-1][1]))
                    links += name == "a"
                continue
            if name in ("html", "head", "body"):
                continue
            fresh = True
            ends = ("p",) if name in CLOSES_P else (name,) if name in CLOSES_ITSELF else ()
            if name in ("dt", "dd"):
                ends = ("dt", "dd")
            elif name in ("td", "th"):
                ends = ("td", "th")
            if ends:
                scope = CLOSES_ITSELF.get(name, ("article", "section", "div", "td", "th", "button", "table"))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ends:
                        links -= sum(tag == "a" for tag, _ in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][0] in scope:
                        break
            node = self._node(stack[-1][1], name, *_said(m[3]))
            if not m[3].rstrip().endswith("/"):
                stack.append((name, node))

    def _node(self, parent: int, tag: str, kinds: int, hidden: bool) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(kinds)
        self.hidden.append(hidden)
        self.inline.append(0)
        return len(self.parent) - 1

    def main_text(self, keep: np.ndarray) -> str:
        """The kept nodes' blocks, white space made single, one a line."""
        blocks: dict[int, list[str]] = {}
        for node, block, s, _ in self.runs:
            if keep[node]:
                blocks.setdefault(block, []).append(s)
        lines = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(x for x in lines if x)


FEATURES = (
    [f"tag {k[:60]}" for k in TAG_KINDS] + [f"token {k.split()[0]}" for k in TOKEN_KINDS] + [f"above: tag {k[:60]}" for k in TAG_KINDS] + [f"above: token {k.split()[0]}" for k in TOKEN_KINDS]
    + "own length;subtree length;own links;subtree links;share of page;inline tags per char;tags per char;punctuation;words;depth;children;siblings;place among siblings;siblings' length;siblings' links;same-tag siblings;place in page;hidden;symbols".split(";")
)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node features of many pages at once; parents (over all nodes, -1 at roots) and where each page's nodes start."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.concatenate([np.array(p.parent) + np.where(np.array(p.parent) >= 0, s, 0) for p, s in zip(pages, first.tolist(), strict=True)])
    own = np.zeros((n, 6))  # chars, chars in links, punctuation, words, inline tags, symbols
    for p, s in zip(pages, first.tolist(), strict=True):
        for node, _, text, linked in p.runs:
            length = len(text)
            if length:
                row = own[s + node]
                row[0] += length
                row[1] += length * linked
                row[2] += len(_SENTENCE.findall(text))
                row[3] += text.count(" ") + 1
                row[5] += text.count("©") + text.count("|") + text.count("·")
        own[s : s + len(p.inline), 4] += p.inline
    depth = np.zeros(n, np.int64)
    tag = np.array([_TAG.get(t, -1) for p in pages for t in p.tag])
    tokens = np.array([k for p in pages for k in p.tokens])
    hidden = np.array([h for p in pages for h in p.hidden])
    tag_hot = (tag[:, None] == np.arange(len(TAG_KINDS))).astype(np.float32)
    token_hot = ((tokens[:, None] >> np.arange(len(TOKEN_KINDS))) & 1).astype(np.float32)
    for i in np.flatnonzero(parent >= 0).tolist():  # parents stand before children
        depth[i] = depth[parent[i]] + 1
    sub = np.concatenate([own, np.ones((n, 1))], 1)
    mine = np.concatenate([tag_hot, token_hot, hidden[:, None]], 1).astype(np.float32)
    above = np.zeros_like(mine)  # roots have nothing above them
    for d in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == d)
        above[at] = np.maximum(above[parent[at]], mine[parent[at]])
    for d in range(int(depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(depth == d)
        np.add.at(sub, parent[at], sub[at])
    children = np.bincount(parent[parent >= 0], minlength=n)
    up = np.maximum(parent, 0)
    siblings = np.where(parent >= 0, children[up], 1)
    order = np.lexsort((np.arange(n), up))
    seat = np.empty(n, np.int64)
    o = up[order]
    start = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
    seat[order] = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    beside = np.maximum(0, sub[up, 0] - sub[:, 0]), np.maximum(0, sub[up, 1] - sub[:, 1])
    pair = up * 64 + tag + 1
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    total = sub[first, 0][page]
    before = np.cumsum(own[:, 0]) - own[:, 0]
    before -= before[first][page]
    ratio = lambda a, b: a / np.maximum(1, b)
    rest = [
        np.log1p(own[:, 0]), np.log1p(sub[:, 0]), ratio(own[:, 1], own[:, 0]), ratio(sub[:, 1], sub[:, 0]), ratio(sub[:, 0], total), ratio(sub[:, 4], sub[:, 0]),
        ratio(sub[:, 6], sub[:, 0]), ratio(sub[:, 2], sub[:, 3]), np.log1p(sub[:, 3]), depth, children, siblings, ratio(seat, siblings - 1), np.log1p(beside[0]),
        ratio(beside[1], beside[0]), times[back], ratio(before, total), hidden | (above[:, -1] > 0), ratio(sub[:, 5], sub[:, 3]),
    ]
    return np.concatenate([tag_hot, token_hot, above[:, :-1], np.stack(rest, 1).astype(np.float32)], 1).astype(np.float32), parent, first


class BoostedTrees:
    """Logistic gradient boosting: trees of a fixed depth over quantile bins, split by second-order gain."""

    def __init__(self, trees: int = 60, depth: int = 5, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 4.0):
        self.trees, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int64)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f, width = np.full(len(y), self.base), self.bins + 1
        leaves = 1 << self.depth
        self.feature, self.cut, self.value = (np.zeros((self.trees, leaves), t) for t in (np.int32, np.float32, np.float64))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.ones(len(y), np.int64)  # heap order
            for d in range(self.depth):
                at = node - (1 << d)
                n = 1 << d
                best, where = np.zeros(n), np.full((n, 2), -1)
                for j in range(x.shape[1]):
                    if not len(self.edges[j]):
                        continue
                    key = at * width + b[:, j]
                    gs, hs = (np.bincount(key, weights=w, minlength=n * width).reshape(n, width).cumsum(1) for w in (g, h))
                    gl, hl = gs[:, : len(self.edges[j])], hs[:, : len(self.edges[j])]
                    gr, hr = gs[:, -1:] - gl, hs[:, -1:] - hl
                    gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.l2)
                    gain[(hl < self.least / 4) | (hr < self.least / 4)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(n), k]
                    better = top > best + 1e-9
                    best[better], where[better] = top[better], np.stack([np.full(n, j), k], 1)[better]
                for i in range(n):
                    j, k = where[i]
                    self.feature[t, n + i] = max(j, 0)
                    self.cut[t, n + i] = self.edges[j][k] if j >= 0 else np.inf  # no split: all go left
                right = x[np.arange(len(y)), self.feature[t, node]] > self.cut[t, node]
                node = 2 * node + right
            at = node - leaves
            gs, hs = (np.bincount(at, weights=w, minlength=leaves) for w in (g, h))
            self.value[t] = self.rate * gs / (hs + self.l2)
            f += self.value[t, at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for t in range(self.trees):
            node = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + (x[rows, self.feature[t, node]] > self.cut[t, node])
            f += self.value[t, node - (1 << self.depth)]
        return f


def decode(margin: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The likeliest labelling in which kept nodes have kept ancestors. Parents stand before their children."""
    keep, drop = -np.logaddexp(0, -margin), -np.logaddexp(0, margin)
    keep, drop, up = keep.tolist(), drop.tolist(), parent.tolist()
    own = [0.0] * len(up)
    for i in range(len(up) - 1, -1, -1):
        own[i] = keep[i] > drop[i]
        if up[i] >= 0:
            keep[up[i]] += max(keep[i], drop[i])
            drop[up[i]] += drop[i]
    out = np.zeros(len(up), bool)
    for i in range(len(up)):
        out[i] = own[i] and (up[i] < 0 or out[up[i]])
    return out


# ---------------------------------------------------------------- training pages


def made_up_page(rng: random.Random) -> str:
    """A page. Just the words of its main text start with q, so that truth can be told by the text."""
    word = lambda: "".join(rng.choice("aeioulnrstmdéü") for _ in range(rng.randint(1, 9)))

    def words(n: int, mark: str = "") -> str:
        out, since = [], 0
        for _ in range(n):
            since += 1
            stop = rng.random() < 0.12 and since > 2
            out.append(mark + word() + (rng.choice([".", ".", ",", "!"]) if stop else ""))
            since = 0 if stop else since
        return " ".join(out) + rng.choice([".", ".", "", "!"])

    def link(n: int = 1) -> str:
        return f'<a href="/{word()}">{words(n)[:-1] or "x"}</a>'

    def attrs(kind: int, chance: float = 0.8) -> str:
        if rng.random() > chance:
            return rng.choice(["", f' class="{word()}"', f' id="{word()}"'])
        token = rng.choice(TOKEN_KINDS[kind].split())
        name = rng.choice([token, f"{token}-{word()}", f"{word()} {token}", f"site-{token}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def mixed() -> str:
        """The article's own token among others, of other kinds or none."""
        own, other = rng.choice(TOKEN_KINDS[8].split()), rng.choice(TOKEN_KINDS[rng.choice([2, 2, 4, 7])].split())
        both = rng.choice([f"{other}-{own}", f"{other} {own}", f"{own} {word()} {other}", f"{other}-{own} {rng.choice(TOKEN_KINDS[8].split())}", f"{word()}-{own}"])
        return f' {rng.choice(["class", "id"])}="{both}"'

    def wrap(tag: str, a: str, inner: str) -> str:
        return f"<{tag}{a}>{inner}</{tag}>"

    def linklist(tag: str, a: str) -> str:
        items = "".join(f"<li>{link(rng.randint(1, 3))}</li>" for _ in range(rng.randint(2, 9)))
        return wrap(tag, a, wrap("ul", "", items) if rng.random() < 0.8 else " ".join(link() for _ in range(4)))

    def nav() -> str:
        return linklist(*rng.choice([("nav", ""), ("nav", attrs(0)), ("div", attrs(0, 1)), ("ul", attrs(0, 1))]))

    def header() -> str:
        inner = rng.choice([wrap("h1", "", link(2)), wrap("div", attrs(4, 1), words(3)), wrap("p", "", words(4)), link(2)]) + (nav() if rng.random() < 0.5 else "")
        return wrap(*rng.choice([("header", ""), ("div", attrs(4, 1)), ("header", attrs(4))]), inner)

    def footer() -> str:
        inner = rng.choice(["&copy; ", "© 2020 ", "Copyright ", ""]) + word() + ".example.com " + rng.choice(["&middot; ", "| ", ""]) + words(rng.randint(1, 20))
        inner = inner if rng.random() < 0.6 else wrap("p", "", inner) + (linklist("div", "") if rng.random() < 0.4 else "")
        return wrap(*rng.choice([("footer", ""), ("footer", attrs(3)), ("div", attrs(3, 1))]), inner)

    def text_blocks(n: int, size: tuple[int, int] = (4, 25)) -> str:
        return "".join(wrap("p", "", words(rng.randint(*size))) for _ in range(n))

    def advert() -> str:
        inner = rng.choice([words(rng.randint(2, 25)), link(4), wrap("p", "", words(rng.randint(3, 20))), wrap("span", "", words(6)) + link(2)])
        return wrap(rng.choice(["div", "div", "aside", "section"]), attrs(1, 1), inner)

    def sidebar() -> str:
        inner = wrap(rng.choice(["h2", "h3", "h4"]), "", words(2)) + rng.choice([linklist("div", ""), text_blocks(rng.randint(1, 3)), words(12)])
        return wrap(*rng.choice([("aside", ""), ("aside", attrs(2)), ("div", attrs(2, 1)), ("section", attrs(2, 1))]), inner)

    def notice() -> str:
        inner = rng.choice([words(rng.randint(5, 30)), text_blocks(1)]) + rng.choice(["", "<button>" + words(1) + "</button>", link()])
        return wrap(rng.choice(["div", "section", "dialog", "p"]), attrs(6, 1), inner)

    def form() -> str:
        inner = f"<label>{words(2)}</label><input name=q>" + rng.choice([f"<button>{words(1)}</button>", wrap("p", "", words(5)), f"<textarea>{words(3)}</textarea>"])
        return wrap("form", rng.choice(["", attrs(7), attrs(6)]), inner)

    def comments() -> str:
        one = lambda: wrap(rng.choice(["div", "li", "article"]), attrs(5, 0.7), rng.choice([wrap("b", "", words(1)), ""]) + text_blocks(rng.randint(1, 2), (3, 40)))
        return wrap(rng.choice(["section", "div", "ol", "ul"]), attrs(5, 1), rng.choice(["", wrap("h3", "", words(2))]) + "".join(one() for _ in range(rng.randint(1, 5))))

    def unseen() -> str:
        how = rng.choice([" hidden", ' style="display:none"', ' style="display: none;"', ' aria-hidden="true"'])
        return wrap(rng.choice(["div", "div", "p", "section"]), how + rng.choice(["", attrs(8), f' class="{word()}"']), rng.choice([words(rng.randint(2, 60)), text_blocks(rng.randint(1, 3))]))

    def scriptless() -> str:
        return wrap("noscript", "", rng.choice([words(rng.randint(3, 12)), wrap("p", "", words(8)), wrap("div", attrs(6), words(6))]))

    def chooser() -> str:
        return wrap("select", "", "".join(wrap("option", "", words(1)) for _ in range(rng.randint(2, 6))))

    def share() -> str:
        return wrap("div", attrs(7, 1), " ".join(link() for _ in range(rng.randint(2, 5))))

    q = lambda n: words(n, "q")

    def article_part() -> str:
        kind = rng.random()
        if kind < 0.05:
            linked = lambda n: f'<a href="/{word()}">{q(n)[:-1]}</a>'
            sources = wrap(rng.choice(["ul", "ol"]), "", "".join(wrap("li", "", linked(rng.randint(1, 9)) + rng.choice(["", "", f" {q(3)}"])) for _ in range(rng.randint(1, 6))))
            return rng.choice([wrap("p", "", linked(rng.randint(2, 14))), wrap(rng.choice(["h2", "h3"]), "", q(1)) + sources, sources])
        if kind < 0.10:
            aside = rng.choice([f' class="{rng.choice(TOKEN_KINDS[rng.choice([1, 1, 7])].split())}"', " hidden", ' style="display:none"', ' aria-hidden="true"'])
            spans = [f"<span{aside}>{words(rng.randint(1, 8))}</span>", f'<span class="{rng.choice(TOKEN_KINDS[8].split())}">{q(4)}</span>', f'<em id="{word()}">{q(3)}</em>', f'<a class="{rng.choice(["more", "top", "link"])}" href="#">{q(2)}</a>']
            return wrap(rng.choice(["p", "p", "li", "div"]), "", f"{q(rng.randint(3, 40))} {rng.choice(spans)} {q(rng.randint(1, 20))}")
        if kind < 0.68:
            s = q(rng.choice([rng.randint(1, 6), rng.randint(8, 60), rng.randint(40, 160)]))
            if rng.random() < 0.08:  # cells of a flattened table
                s = s.replace(" ", " q| ")
            return rng.choice([wrap("p", "", s), wrap("p", "", s), f"<p>{s}", wrap("p", "", f"<b>{s}<br>"), wrap("p", "", s.replace(" ", f' <a href="#">q{word()}</a> ', 1)), wrap("p", "", f"<em>{s}</em> {q(5)}")])
        if kind < 0.78:
            return wrap(rng.choice(["h2", "h3"]), "", q(rng.randint(1, 7)))
        if kind < 0.86:
            return wrap(rng.choice(["ul", "ol"]), "", "".join(wrap("li", "", q(rng.randint(2, 15))) for _ in range(rng.randint(2, 5))))
        if kind < 0.91:
            return wrap("blockquote", "", rng.choice([q(20), wrap("p", "", q(15))]))
        if kind < 0.94:
            return wrap("table", "", "".join(wrap("tr", "", wrap("td", "", q(2)) + wrap("td", "", q(3))) for _ in range(3)))
        if kind < 0.96:
            return wrap("section", "", wrap("h2", "", q(3)) + wrap("p", "", q(30)))
        if kind < 0.97:
            return rng.choice([wrap("div", "", q(rng.randint(4, 60))), wrap("pre", "", q(12))])
        return rng.choice([advert, share, sidebar, notice, form, unseen, unseen, chooser, scriptless])()

    body = "".join(article_part() for _ in range(rng.choice([1, 2, 4, 8, 14])))
    plain = rng.random() < 0.08  # nothing but paragraphs, closed or not
    if plain:
        body = "".join(f"<p>{q(rng.randint(6, 40))}{close}" for close in [rng.choice(["", "</p>"])] for _ in range(rng.randint(1, 6)))
    elif rng.random() < 0.8:
        body = wrap(rng.choice(["h1", "h1", "h2"]), "", q(rng.randint(2, 12))) + body
    if rng.random() < 0.15:
        body += comments()
    bare = rng.random() < (0.7 if plain else 0.3)  # an article without an element of its own
    if rng.random() < (0.25 if bare else 0.08):  # paragraphs are plain divs
        body = body.replace("<p>", "<div>").replace("</p>", "</div>")
    if bare and rng.random() < 0.4:  # with text outside of all elements
        body = rng.choice([q(rng.randint(4, 60)), q(20) + body, body + q(15), q(9) + body + q(12), "<br><br>".join(q(15) for _ in range(4))])
    holder = rng.choice([("article", ""), ("article", ""), ("article", attrs(8)), ("main", ""), ("div", attrs(8, 1)), ("div", attrs(8, 1)), ("section", attrs(8, 1)), ("div", mixed()), ("article", mixed())])
    core = body if bare else wrap(*holder, body)
    for _ in range(0 if bare else rng.randint(0, 2)):
        core = wrap(rng.choice(["div", "main", "section"]), rng.choice(["", attrs(8), attrs(8)]), core + (sidebar() if rng.random() < 0.2 else ""))
    alone = rng.random() < (0.5 if bare else 0.05)  # nothing but the article
    before = "" if alone else "".join(f() for f in (header, nav, notice, advert, share, form, unseen, scriptless, chooser) if rng.random() < (0.4 if f in (header, nav, notice, advert, share, form) else 0.1))
    after = "" if alone else "".join(f() for f in (sidebar, comments, advert, share, form, notice, unseen, footer) if rng.random() < (0.75 if f is footer else 0.3))
    if not alone and rng.random() < 0.15:
        before += sidebar()
    page = f"<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{}}</style></head><body>{before}{'<!-- x -->' if rng.random() < 0.3 else ''}{core}{after}</body></html>"
    return page


def training_set(pages: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of the nodes of made-up pages: a node is main if its subtree holds main text."""
    rng = random.Random(seed)
    made = [Page(made_up_page(rng)) for _ in range(pages)]
    x, parent, first = features(made)
    y = np.zeros(len(parent))
    for p, s in zip(made, first.tolist(), strict=True):
        for node, _, text, _ in p.runs:
            if any(w.startswith("q") for w in text.split()):
                y[s + node] = 1
    for i in range(len(parent) - 1, -1, -1):
        if parent[i] >= 0 and y[i]:
            y[parent[i]] = 1
    return x, y


@lru_cache(1)
def model(pages: int = 1500) -> BoostedTrees:
    """The trees, fitted on so many made-up pages; the same for every input."""
    return BoostedTrees().fit(*training_set(pages))


def extract(sources: list[str], trees: BoostedTrees) -> list[str]:
    """The main text of each page; empty if it has none."""
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, first = features(pages)
    margin = trees.margin(x)
    keep = decode(margin, parent)
    cuts = np.append(first, len(parent)).tolist()
    return [p.main_text(keep[a:b]) for p, a, b in zip(pages, cuts[:-1], cuts[1:], strict=True)]


def extract_pages(pages: DataFrame, trees: BoostedTrees | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points of the text) for every row, from the whole html.

    Null html counts as empty and gives an empty text; html without tags is one block under the root and judged
    like any other. Repeated rows give repeated results; ties between labellings drop the node. Extra columns are
    left behind. Narrow: no shuffle; the model, of fixed size, goes with the function.
    """
    trees = trees or model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                texts = extract([s or "" for s in part.column(2).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_small_batches(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")).mapInArrow(tidy_stream(run), "page_id long, url string, text string, n_chars long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page: null and empty html, repeats and ties as in extract_pages."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
