"""Main text of web pages by a tree-structured graphical model.

A page is a tree of block elements with its runs of text as leaves. Each node
has a binary state: whether its subtree holds main text. Potentials on nodes
come from tags, names and text shape, potentials on edges tie children to
parents. Messages are passed from the leaves to the root and back (sum-product,
exact on a tree), and a run of text is kept if its marginal is over one half.
The weights are fitted by maximum likelihood on labelled pages, whose gradient
needs the same marginals.

The labelled pages are composed by rule from the block kinds web pages have
(:func:`labelled_pages`); a caller may pass labelled pages of its own.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.registry import query, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that do not end a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
# Their content is no text of the page.
SILENT = frozenset("script style template noscript title svg math iframe object canvas audio video head textarea".split())
# A start of the key ends an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
# An open element of these kinds stays open whatever starts inside it.
SCOPE = frozenset("table ul ol dl select html body article section div main td th".split())
TAG_GROUPS = [
    "article", "main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "nav menu", "header",
    "footer", "aside", "form", "table tbody thead tr", "td th", "blockquote", "pre", "figure figcaption", "body html",
    "button select option label textarea fieldset legend input", "address", "dialog", "details summary",
]
NAME_GROUPS = [
    "nav navbar navigation menu breadcrumb breadcrumbs toc toolbar tabs pagination pager skip",
    "header masthead topbar logo branding hero top site",
    "footer copyright legal colophon bottom imprint",
    "sidebar aside widget related recommended popular trending recent side rail more also",
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription alert banner privacy message",
    "ad ads advert advertisement adverts sponsor sponsored promo promotion affiliate adsbox banner",
    "comment comments respond reply replies discussion disqus thread feedback reader",
    "share social sharing follow tools toolbar print tag tags meta byline author date",
    "article content post entry story body text main page prose document",
    "search login signup form contact signin register",
]
_TAG = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_NAME: dict[str, list[int]] = {}
for _i, _g in enumerate(NAME_GROUPS):
    for _t in _g.split():
        _NAME.setdefault(_t, []).append(_i)
_TOKEN = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FURNITURE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|log in|advert|sponsored", re.I)
N_TAGS, N_NAMES = len(TAG_GROUPS) + 1, len(NAME_GROUPS)
LENGTHS = (10, 25, 50, 100, 200, 400)
N_TEXT = len(LENGTHS) + 1 + 6
# A node's own features, and those of names and tags around it.
N_FEATURES = 1 + N_TAGS + N_NAMES + 2 + N_TEXT + N_TAGS
ELEMENT, TEXT = 0, 1


@dataclass
class Tree:
    """Nodes of one or many pages; parents come before their children."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    features: list[list[int]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def add(self, parent: int, kind: int, features: list[int], page: int, marked=False, text=None) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.features.append(features)
        self.text.append(text)
        self.marked.append(marked)
        self.page.append(page)
        return len(self.parent) - 1


class _Reader(HTMLParser):
    """Feeds one page into a tree. ``data-main`` marks main text in labelled pages."""

    def __init__(self, tree: Tree, page: int):
        super().__init__(convert_charrefs=True)
        self.tree, self.page = tree, page
        self.open: list[tuple[str, int, bool]] = [("body", tree.add(-1, ELEMENT, [0, 1 + _TAG["body"]], page), False)]
        # Where elements of a tag, and those of SCOPE, are open: no end tag has to walk the stack.
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = [0]
        self.pieces: list[str] = []
        self.link, self.linked, self.silent = 0, 0, []

    def push(self, tag: str, node: int, main: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SCOPE:
            self.scopes.append(len(self.open))
        self.open.append((tag, node, main))

    def close_from(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last_open(self, tag: str) -> int:
        """Place of the innermost open element of a tag, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def end_run(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            tag, node, main = self.open[-1]
            self.tree.add(node, TEXT, _text_features(text, self.linked, tag), self.page, main, text)
        self.pieces.clear()
        self.linked = 0

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag == "body" or (self.silent[-1] == "head" and tag not in SILENT and tag not in VOID):
                self.silent.clear()
            else:
                if tag in SILENT:
                    self.silent.append(tag)
                return
        if tag in SILENT:
            self.silent.append(tag)
            return
        if tag in INLINE:
            if tag == "br":
                self.pieces.append(" ")
            self.link += tag == "a"
            return
        self.end_run()
        if tag in VOID:
            return
        if self.open[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and (
            self.open[-1][0] == "p" or tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        ):
            self.close_from(len(self.open) - 1)
        if tag in CLOSES:
            # The innermost one, unless an element of SCOPE is open within it.
            at = max(map(self.last_open, CLOSES[tag]))
            inner = self.scopes[-1]
            if at and (at > inner or (at == inner and self.open[at][0] in CLOSES[tag])):
                self.close_from(at)
        if tag in ("html", "body"):
            return
        _, parent, main = self.open[-1]
        features, marked = [0, 1 + _TAG.get(tag, N_TAGS - 1)], main
        for name, value in attrs:
            if name == "data-main":
                marked = value == "1"
            elif name in ("class", "id", "role", "aria-label", "itemprop") and value:
                for token in set(_TOKEN.findall(value.lower())):
                    features.extend(1 + N_TAGS + g for g in _NAME.get(token, ()))
            elif name == "hidden" or (name == "style" and value and _UNSEEN.search(value)):
                features.append(1 + N_TAGS + N_NAMES)
        if tag not in ("p", "div", "section"):
            features.append(1 + N_TAGS + N_NAMES + 1)
        # What the parent is.
        around = 1 + N_TAGS + N_NAMES + 2 + N_TEXT
        features.append(around + _TAG.get(self.open[-1][0], N_TAGS - 1))
        self.push(tag, self.tree.add(parent, ELEMENT, sorted(set(features)), self.page, marked), marked)

    def handle_endtag(self, tag):
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            return
        if tag in INLINE:
            self.link = max(0, self.link - (tag == "a"))
            return
        self.end_run()
        at = self.last_open(tag)
        if at:
            self.close_from(at)
            self.link = 0

    def handle_data(self, data):
        # Text ends a head whose end tag is missing.
        if self.silent == ["head"] and data.strip():
            self.silent.clear()
        if not self.silent:
            self.pieces.append(data)
            if self.link:
                self.linked += len(data.strip())


def _text_features(text: str, linked: int, tag: str) -> list[int]:
    base = 1 + N_TAGS + N_NAMES + 2
    size = len(text)
    out = [0, base + sum(size >= n for n in LENGTHS)]
    flag = base + len(LENGTHS) + 1
    share = linked / size
    if share > 0.6:
        out.append(flag)
    elif share > 0.2:
        out.append(flag + 1)
    if text[-1] in ".!?\"”»…":
        out.append(flag + 2)
    if size < 300 and _FURNITURE.search(text):
        out.append(flag + 3)
    if text.count(" ") < 3:
        out.append(flag + 4)
    if size >= 25 and "," in text:
        out.append(flag + 5)
    out.append(base + N_TEXT + _TAG.get(tag, N_TAGS - 1))
    return out


# All that an element without any news about its content can have.
_PLAIN_TAGS = {1 + _TAG["div"], 1 + _TAG["section"], 1 + N_TAGS - 1}
_AROUND = 1 + N_TAGS + N_NAMES + 2 + N_TEXT
_PLAIN = _PLAIN_TAGS | {0, 1 + N_TAGS + N_NAMES + 1} | set(range(_AROUND, N_FEATURES))
_PLAIN_FORM = _PLAIN | {1 + _TAG["form"]}


def _without_wrappers(tree: Tree) -> Tree:
    """The tree without plain elements that hold a single node or are one.

    Their state is that of the node, or of the element around them, by
    definition, so nesting alone says nothing and must not move a marginal.
    A form around all that a page holds is one of them.
    """
    children = [0] * len(tree.parent)
    for parent in tree.parent:
        if parent >= 0:
            children[parent] += 1
    out, place = Tree(), []
    for node, parent in enumerate(tree.parent):
        above = place[parent] if parent >= 0 else -1
        lone = parent >= 0 and tree.kind[node] == ELEMENT and (children[node] == 1 or children[parent] == 1)
        whole = lone and children[parent] == 1 and out.parent[above] < 0
        plain = lone and (_PLAIN_FORM if whole else _PLAIN).issuperset(tree.features[node])
        place.append(
            above if plain else out.add(
                above, tree.kind[node], tree.features[node], tree.page[node], tree.marked[node], tree.text[node]
            )
        )
    return out


def parse(htmls: list[str | None]) -> Tree:
    """The trees of many pages; a null or empty page has a root only."""
    tree = Tree()
    for page, html in enumerate(htmls):
        reader = _Reader(tree, page)
        reader.feed(html or "")
        reader.close()
        reader.end_run()
    return _without_wrappers(tree)


@dataclass(frozen=True)
class Weights:
    node: np.ndarray  # per feature, for state 1 against state 0
    edge: np.ndarray  # kind of child × state of parent × state of child


class _Graph:
    """The arrays of a forest, with its levels from the roots down."""

    def __init__(self, tree: Tree):
        self.parent, self.kind = np.array(tree.parent, np.int64), np.array(tree.kind, np.int64)
        depth = np.array(tree.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        self.counts = np.array([len(f) for f in tree.features], np.int64)
        self.flat = np.array([i for f in tree.features for i in f], np.int64)
        self.owner = np.repeat(np.arange(len(depth)), self.counts)

    def unary(self, weights: Weights) -> np.ndarray:
        return np.bincount(self.owner, weights.node[self.flat], len(self.parent))

    def marginals(self, weights: Weights) -> tuple[np.ndarray, np.ndarray]:
        """``(probability of state 1, joint of parent and child states)`` of each node."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = self.unary(weights)
        edge = weights.edge[self.kind]
        to_parent = np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            sent = np.logaddexp(edge[level, :, 0] + up[level, :1], edge[level, :, 1] + up[level, 1:])
            to_parent[level] = sent
            np.add.at(up, self.parent[level], sent)
        belief, joint = up.copy(), np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = belief[self.parent[level]] - to_parent[level]
            both = above[:, :, None] + edge[level] + up[level][:, None, :]
            joint[level] = both
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        belief -= np.logaddexp(belief[:, :1], belief[:, 1:])
        inner = self.parent >= 0
        flat = joint.reshape(n, 4)
        top = flat.max(axis=1, keepdims=True)
        joint = np.where(inner[:, None], np.exp(flat - top), 0.0)
        joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
        return np.exp(belief[:, 1]), joint.reshape(n, 2, 2)


def true_states(tree: Tree) -> np.ndarray:
    """State 1 for marked text and every node that has some below it."""
    state = np.array([m and k == TEXT for m, k in zip(tree.marked, tree.kind)], np.int64)
    for node in range(len(state) - 1, -1, -1):
        if state[node] and tree.parent[node] >= 0:
            state[tree.parent[node]] = 1
    return state


def fit(htmls: list[str], steps: int = 120, ridge: float = 2e-4) -> Weights:
    """Maximum likelihood on labelled pages, by Adam."""
    tree = parse(htmls)
    graph, state = _Graph(tree), true_states(tree)
    n = max(len(state), 1)
    theta = np.zeros(N_FEATURES + 8)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.flatnonzero(graph.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (graph.kind[inner], state[graph.parent[inner]], state[inner]), 1.0)
    for step in range(1, steps + 1):
        weights = Weights(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        p, joint = graph.marginals(weights)
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, graph.kind[inner], joint[inner])
        gradient = np.concatenate(
            [np.bincount(graph.flat, (state - p)[graph.owner], N_FEATURES), (seen - expected).ravel()]
        ) / n - ridge * theta
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return Weights(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


def main_texts(htmls: list[str | None], weights: Weights) -> list[str]:
    """The main text of each page: kept runs in page order, two line ends between them."""
    tree = parse(htmls)
    p, _ = _Graph(tree).marginals(weights)
    kept: list[list[str]] = [[] for _ in htmls]
    for node in np.flatnonzero((p > 0.5) & (np.array(tree.kind) == TEXT)):
        kept[tree.page[node]].append(tree.text[node])
    return ["\n\n".join(runs) for runs in kept]


def labelled_pages(count: int = 720, seed: int = 7) -> list[str]:
    """Pages composed at random of article and furniture blocks; main text is marked."""
    r = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word() -> str:
        return "".join(r.choice(letters) for _ in range(r.randint(2, 9)))

    def words(low: int, high: int, comma: float = 0.1) -> str:
        out = [word() + ("," if r.random() < comma else "") for _ in range(r.randint(low, high))]
        return " ".join(out).strip(",")

    def sentences(low: int, high: int) -> str:
        return " ".join(words(1, 18).capitalize() + "." for _ in range(r.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 3, 0)}</a></li>' for _ in range(r.randint(low, high)))

    def named(tag: str, names: str, body: str, bare: float = 0.1) -> str:
        name = r.choice(names.split())
        at = "" if r.random() < bare else r.choice([f' class="{name}"', f' id="{name}"', f' class="{word()} {name}-{word()}"'])
        return f"<{tag}{at}>{body}</{tag}>"

    def wrapped(body: str, least: int = 0) -> str:
        """Inside some elements that say nothing, with and without neighbours."""
        for _ in range(max(least, r.choice([0, 0, 0, 1, 1, 2, 3, 4, 6]))):
            tag = r.choice(["div", "div", "div", "div", "section", "center", "td", f"x-{word()}", word() + "q"])
            at = r.choice(["", "", "", f' class="{word()}"', f' id="{word()}"'])
            body = f"<table><tr><td{at}>{body}</td></tr></table>" if tag == "td" else f"<{tag}{at}>{body}</{tag}>"
        return body

    def furniture() -> str:
        return wrapped(bare_furniture()) if r.random() < 0.3 else bare_furniture()

    def bare_furniture() -> str:
        kind = r.randrange(14)
        note = sentences(1, 3)
        if kind == 0:
            return r.choice([f"<nav><ul>{links(3, 8)}</ul></nav>", named("div", NAME_GROUPS[0], f"<ul>{links(3, 8)}</ul>", 0.3)])
        if kind == 1:
            title = f"<h1>{words(1, 4)}</h1>" if r.random() < 0.4 else f"<p>{words(2, 6)}</p>"
            return r.choice([f"<header>{title}</header>", named("div", "header masthead topbar logo", title)])
        if kind == 2:
            end = r.choice(["&copy; ", "Copyright ", ""]) + words(1, 3) + " &middot; " + note
            return r.choice([f"<footer>{end}</footer>", f"<footer><p>{end}</p></footer>", named("div", "footer copyright legal", end)])
        if kind == 3:
            side = f"<h3>{words(1, 4)}</h3>" + r.choice([f"<ul>{links(2, 6)}</ul>", f"<p>{note}</p>"])
            return r.choice([f"<aside>{side}</aside>", named("div", NAME_GROUPS[3], side)])
        if kind == 4:
            return named(r.choice(["div", "section", "dialog"]), "cookie consent notice gdpr popup newsletter subscribe alert", f"<p>{note}</p><button>{words(1, 2)}</button>" if r.random() < 0.6 else note, 0.0)
        if kind in (5, 6):
            return named(r.choice(["div", "div", "section", "aside"]), "ad ads advert advertisement sponsored promo", r.choice([note, f"<p>{note}</p>", words(3, 9), f'<a href="/{word()}">{note}</a>']), 0.0)
        if kind == 7:
            return f'<form action="/{word()}"><label>{words(1, 3)}</label><input name="q"><textarea>{words(0, 4)}</textarea><button>{words(1, 2)}</button><p>{note}</p></form>'
        if kind in (8, 9):
            one = [named("div", "comment reply", f"<p>{words(1, 2)}</p><p>{sentences(1, 4)}</p>") for _ in range(r.randint(1, 4))]
            one += [f"<li><p>{sentences(1, 3)}</p></li>"] if r.random() < 0.4 else []
            return named(r.choice(["div", "section", "ol"]), "comments comment respond discussion replies", f"<h2>{words(1, 3)}</h2>" * (r.random() < 0.5) + "".join(one), 0.0)
        if kind == 10:
            return named("div", "share social follow tags", f"<ul>{links(2, 5)}</ul>")
        if kind == 11:
            return f"<!-- {note} --><script>var t='<p>{word()}</p>';</script><style>p{{margin:0}}</style><noscript>{note}</noscript>"
        if kind == 12:
            unseen = r.choice([" hidden", ' style="display:none"', ' style="margin: 0; display: none;"'])
            return f"<{(t := r.choice(['div', 'p', 'section']))}{unseen}>{sentences(1, 5)}</{t}>"
        return named("div", "related recommended popular", f"<h4>{words(1, 3)}</h4><ul>{links(2, 6)}</ul>")

    def block() -> str:
        kind, m = r.random(), ' data-main="1"'
        if kind < 0.62:
            inner = sentences(1, 7)
            if r.random() < 0.2:
                inner = f"<b>{words(1, 4)}</b> {inner}"
            if r.random() < 0.15:
                inner += f' <a href="/{word()}">{words(1, 3)}</a> {words(2, 8)}.'
            if r.random() < 0.1:
                inner = "<b>" + inner + "<br>"
            return f"<p{m}>{inner}" + "</p>" * (r.random() < 0.85)
        if kind < 0.72:
            return f"<h{(h := r.randint(2, 4))}{m}>{words(1, 7)}</h{h}>"
        if kind < 0.8:
            return f"<ul{m}>" + "".join(f"<li>{words(2, 14)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.86:
            return f"<blockquote{m}><p>{sentences(1, 3)}</p></blockquote>"
        if kind < 0.9:
            return f"<table{m}>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 4)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        if kind < 0.93:
            return f"<pre{m}>{words(3, 12)}</pre>"
        if kind < 0.96:
            return f"<figure{m}><img src=x><figcaption>{words(3, 10)}</figcaption></figure>"
        return f"<p{m}>{words(1, 5)}</p>" if kind < 0.98 else f"<div{m}>{sentences(1, 4)}</div>"

    pages = []
    for _ in range(count):
        body = [block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12]))]
        shape = r.random()
        if shape < 0.12:
            # All blocks are divs, some of them deep.
            body = [wrapped(f'<div data-main="1">{sentences(1, 4) if r.random() < 0.7 else words(1, 8)}</div>') for _ in body]
        elif shape < 0.18:
            # One element whose lines end with br.
            body = ['<div data-main="1">' + "<br><br>".join(sentences(1, 4) for _ in body) + "</div>"]
        elif shape < 0.3:
            body = [wrapped(b) if r.random() < 0.5 else b for b in body]
        while len(body) > 1 and r.random() < 0.45:
            # Consecutive blocks share a plain element, at times several levels of them.
            at, size = r.randint(0, len(body) - 2), r.randint(2, len(body))
            body[at : at + size] = [wrapped("".join(body[at : at + size]), 1)]
        if r.random() < 0.35:
            body.insert(r.randint(0, len(body)), furniture())
        heading = f'<h1 data-main="1">{words(2, 9)}</h1>' * (r.random() < 0.8)
        inside = heading + (wrapped("".join(body)) if r.random() < 0.4 else "".join(body))
        if r.random() < 0.3:
            inside = wrapped(inside)
        wrap = r.random()
        if wrap < 0.35:
            inside = f"<article>{inside}</article>"
        elif wrap < 0.47:
            inside = f"<main>{inside}</main>"
        elif wrap < 0.72:
            inside = named("div", "article content post entry story main", inside, 0.25)
        if r.random() < 0.35:
            inside = wrapped(inside)
        if r.random() < 0.4:
            inside = named(r.choice(["div", "main", "section"]), "wrapper page container content", inside + furniture() * (r.random() < 0.3), 0.4)
        # A page may have nothing around its text.
        most = r.choice([0, 0, 4, 4, 4])
        before = [furniture() for _ in range(r.randint(0, most))]
        after = [furniture() for _ in range(r.randint(0, most))]
        head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{words(2, 6)}</title></head>" * (r.random() < 0.9)
        if r.random() < 0.04:
            # Nothing but furniture.
            inside = ""
        whole = "".join(before) + inside + "".join(after)
        if r.random() < 0.2:
            # Some sites put the whole page into one form.
            whole = f'<form method="post" action="/{word()}" id="{word()}Form">{whole}</form>'
        pages.append(f"{head}<body>{whole}</body></html>")
    return pages


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(labelled_pages())


def main_text(html: Column, weights: Weights | None = None) -> Column:
    """The main text of a page as one string; empty for null, empty and text-free pages.

    Depends on the page alone: repeated pages have equal texts, and other
    columns of the table are not read. Pages of any length are read whole; up
    to 128 trees are held at once. A marginal of exactly one half is left out.
    """
    fitted = weights or default_weights()

    @F.arrow_udf("string")
    def extracted(htmls: pa.Array) -> pa.Array:
        out: list[str] = []
        # Trees of so many pages are held at once.
        for at in range(0, len(htmls), 128):
            out.extend(main_texts(htmls.slice(at, 128).to_pylist(), fitted))
        return pa.array(out, pa.string())

    return extracted(html)


@query()
def op2_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    texts = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
