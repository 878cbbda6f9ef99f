"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

Each block node has features of its subtree (text, link and tag density), its attribute tokens, its
depth and its siblings. Boosted trees give the log odds that the node holds main text. Decoding
picks the labelling of largest total log odds in which a node is kept only if its parent is, so an
article cannot lie in a dropped sidebar, nor be kept while all that holds it is dropped.

The trees are trained here on generated pages with known answers (`lessons`), a fixed number of them.

Defined results: null or empty html gives empty text; a repeated page_id gives a row for each;
unclosed and stray tags are repaired as browsers do; other columns are ignored.
"""

import random
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

#: Generated pages and boosting rounds of the training run.
LESSONS = 500
TREES, DEPTH, RATE, BINS = 50, 4, 0.25, 24

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript svg math iframe object canvas textarea select option datalist audio video title".split())
IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp
small span strike strong sub sup time tt u var wbr input button nobr center""".split())
TAGS = """nav header footer aside form article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre
figure figcaption body html address details summary dialog menu fieldset""".split()
CLOSED_BY_BLOCK = frozenset("""address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3
h4 h5 h6 header hr main menu nav ol p pre section table ul""".split())
BAD = """nav navbar navigation menu header masthead topbar footer foot sidebar side aside ad ads advert advertisement adv banner promo
sponsor sponsored cookie consent notice alert gdpr comment comments reply replies disqus discussion share sharing social related recommended
widget login signin signup register newsletter subscribe breadcrumb breadcrumbs popup modal overlay copyright legal toolbar pagination pager
search form skip tags meta""".split()
GOOD = "article content main post entry body story text page-content maincontent prose document blog read".split()

_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    attrs: dict[str, str]
    inline: list[str] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    #: Text parts and child numbers in page order.
    flow: list = field(default_factory=list)
    links: int = 0
    inputs: int = 0


class Dom(HTMLParser):
    """The block nodes of a page; inline elements only leave their text and counts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, {})]
        self.open: list[tuple[str, int]] = [("html", 0)]
        self.hidden = self.linked = 0

    def updatepos(self, i, j):
        return j  # line numbers are not used

    @property
    def at(self) -> Node:
        return self.nodes[self.open[-1][1]]

    def _close(self, tags, stop=("table", "td", "th", "article", "section", "div", "body", "html", "ul", "ol", "dl")) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in tags:
                self._pop(i)
                return
            if self.open[i][0] in stop:
                return

    def _pop(self, i) -> None:
        for tag, _ in self.open[i:]:
            self.hidden -= tag in UNSEEN
            self.linked -= tag == "a"
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body") and any(t == tag for t, _ in self.open):
            return
        if tag == "body" or self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._close(("head",), ())
        if tag in CLOSED_BY_BLOCK:
            self._close(("p",))
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close({"li": ("li",), "tr": ("tr",), "option": ("option",)}.get(tag, ("dt", "dd") if tag[0] == "d" else ("td", "th")),
                        ("ul", "ol", "dl", "table", "select"))
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and not self.hidden:
                self.at.flow.append(" " if tag != "wbr" else "")
            if tag == "hr":
                self._break()
            self.at.inputs += tag == "input"
            return
        if tag == "a":
            self._close(("a",))
        here = self.open[-1][1]
        if tag not in INLINE and tag not in UNSEEN:
            here = self._add(tag, dict(attrs))
        else:
            self.at.inputs += tag in ("button", "select", "textarea", "label")
        self.hidden += tag in UNSEEN
        self.linked += tag == "a"
        self.open.append((tag, here))

    def _add(self, tag, attrs) -> int:
        up = self.open[-1][1]
        self.nodes.append(Node(tag, up, self.nodes[up].depth + 1, {k: v or "" for k, v in attrs.items()}))
        new = len(self.nodes) - 1
        self.nodes[up].children.append(new)
        self.nodes[up].flow.append(new)
        return new

    def _break(self):
        self.at.flow.append(None)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in INLINE | UNSEEN and self.open[-1][0] == tag:
            self._pop(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.at.flow.append(" ")
            return
        self._close((tag,), () if tag not in INLINE and tag != "p" else ("td", "th", "table", "article", "section", "body", "html"))

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip(" \t\n\f\r"):
            self._close(("head",), ())
        if not self.hidden and data:
            node = self.at
            node.flow.append(data)
            if self.linked:
                node.links += len(data.strip())


def parse(html: str) -> list[Node]:
    dom = Dom()
    dom.feed(html)
    dom.close()
    return dom.nodes


def blocks(node: Node):
    """The node's own text between its child blocks, white space folded."""
    run = []
    for x in [*node.flow, None]:
        if isinstance(x, str):
            run.append(x)
            continue
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            yield text
        run = []
        if x is not None:
            yield x


def tokens(attrs: dict[str, str]) -> set[str]:
    value = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label", "data-role"))
    words = _TOKEN.findall(_CAMEL.sub(" ", value).lower())
    return set(words) | {w[:-1] for w in words if w.endswith("s")}


_ROLE = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "search", "main": "main", "articlebody": "article"}
_BAD, _GOOD = frozenset(BAD), frozenset(GOOD)
_BAD_TAGS, _GOOD_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "dialog")), frozenset(("article", "main"))


#: Sums over a node that are also taken over its subtree, in this order.
_SUMS = "own link words punct tags paras inputs lists bad good".split()


def node_features(nodes: list[Node]) -> np.ndarray:
    n, up = len(nodes), [max(x.parent, 0) for x in nodes]
    each, above, kids, same = [], [[0, 0]], [], []
    for i, x in enumerate(nodes):
        texts = [s for s in x.flow if s.__class__ is str]
        text = _SPACE.sub(" ", "".join(texts)).strip() if texts else ""
        bad, good = x.tag in _BAD_TAGS, x.tag in _GOOD_TAGS
        if x.attrs:
            t = {_ROLE.get(w, w) for w in tokens(x.attrs)}
            bad, good = bad + len(t & _BAD), good + len(t & _GOOD)
        each.append([len(text), x.links, text.count(" ") + bool(text),
                     text.count(".") + text.count(",") + text.count("!") + text.count("?"),
                     1, x.tag == "p", x.inputs, x.tag == "li", int(bad), int(good)])
        if i:
            a, e = above[up[i]], each[up[i]]
            above.append([a[0] + e[8], a[1] + e[9]])
        kids.append(len(nodes[up[i]].children) if i else 1)
    for x in nodes:
        tags = [nodes[k].tag for k in x.children]
        x_same = {t: tags.count(t) for t in set(tags)}
        for k, t in zip(x.children, tags, strict=True):
            same.append((k, x_same[t]))
    whole = [list(e) for e in each]
    for i in range(n - 1, 0, -1):  # children come after their parents
        to, e = whole[up[i]], whole[i]
        for k in range(len(_SUMS)):
            to[k] += e[k]
    o, w, ab = (np.array(v, float) for v in (each, whole, above))
    s = {k: w[:, i] for i, k in enumerate(_SUMS)}
    own, bad, good, total = o[:, 0], o[:, 8], o[:, 9], w[0, 0]
    alike = np.ones(n)
    if same:
        alike[[k for k, _ in same]] = [c for _, c in same]
    rows = np.zeros((n, 28 + len(TAGS)))
    rows[:, :28] = np.stack([
        [x.depth for x in nodes], kids, alike, [len(x.children) for x in nodes], np.log1p(own), np.log1p(s["own"]),
        s["link"] / (s["own"] + 1), s["words"] / s["tags"], s["punct"] / (s["words"] + 1), s["own"] / (s["words"] + 1),
        np.log1p(s["paras"]), s["inputs"], np.log1p(s["lists"]), s["own"] / (s["own"][up] + 1), s["own"] / (total + 1),
        (np.cumsum(own) - own) / (total + 1), np.minimum(bad, 3), np.minimum(good, 3), np.minimum(ab[:, 0], 3), np.minimum(ab[:, 1], 3),
        s["bad"] / s["tags"], s["good"] / s["tags"], s["link"][up] / (s["own"][up] + 1), s["lists"] / s["tags"], s["paras"] / s["tags"],
        own / (s["own"] + 1), np.minimum(s["good"] - good, 3), np.full(n, np.log1p(total))], 1)
    for i, x in enumerate(nodes):
        t = _TAG.get(x.tag)
        if t is not None:
            rows[i, 28 + t] = 1
    return rows


_TAG = {t: i for i, t in enumerate(TAGS)}


# Boosted trees

class Boosted:
    """Logistic gradient boosting with histogram splits; complete trees of a fixed depth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at, feature, cut = np.zeros(len(y), np.int64), np.zeros(2 ** DEPTH - 1, np.int64), np.full(2 ** DEPTH - 1, BINS, np.int64)
            for d in range(DEPTH):
                width, first = 2 ** d, 2 ** d - 1
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    if not len(self.edges[j]):
                        continue
                    k = at * BINS + b[:, j]
                    gs = np.bincount(k, g, width * BINS).reshape(width, BINS).cumsum(1)
                    hs = np.bincount(k, h, width * BINS).reshape(width, BINS).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs ** 2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt ** 2 / (ht + 1)
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best = np.where(better, gain[np.arange(width), top], best)
                    feature[first:first + width][better], cut[first:first + width][better] = j, top[better]
                node = first + at
                at = 2 * at + (b[np.arange(len(y)), feature[node]] > cut[node])
            leaf = RATE * np.bincount(at, g, 2 ** DEPTH) / (np.bincount(at, h, 2 ** DEPTH) + 1)
            f += leaf[at]
            self.trees.append((feature, cut, leaf))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for d in range(DEPTH):
                node = 2 ** d - 1 + at
                at = 2 * at + (b[rows, feature[node]] > cut[node])
            f += leaf[at]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Kept nodes of the best labelling in which every kept node has a kept parent."""
    n = len(nodes)
    keep_, drop = odds.astype(float).copy(), -odds.astype(float)
    for i in range(n - 1, 0, -1):
        up = nodes[i].parent
        keep_[up] += max(keep_[i], drop[i])
        drop[up] += drop[i]
    out = np.zeros(n, bool)
    out[0] = keep_[0] > drop[0]
    for i in range(1, n):
        out[i] = out[nodes[i].parent] and keep_[i] > drop[i]
    return out


def render(nodes: list[Node], kept: np.ndarray) -> str:
    lines, stack = [], [iter(blocks(nodes[0]))] if kept[0] else []
    while stack:
        x = next(stack[-1], None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            lines.append(x)
        elif kept[x]:
            stack.append(iter(blocks(nodes[x])))
    return "\n".join(lines)


# Training pages

def lesson(r: random.Random) -> str:
    """A page whose main text is marked with the character \\x01."""
    word = lambda: "".join(r.choice("aeioubdfglmnrst") for _ in range(r.randint(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    sentence = lambda n: line(n).capitalize() + r.choice(".,!.?.")
    links = lambda n: "".join(f'<li><a href="/{word()}">{line(r.randint(1, 4))}</a></li>' for _ in range(n))
    named = lambda bad: f' {r.choice(("class", "id"))}="{r.choice(("", word() + "-", "site-"))}{bad}"'

    def boiler(kind):
        n = r.randint(2, 9)
        inner = {"links": lambda: f"<ul>{links(n)}</ul>", "text": lambda: line(r.randint(3, 30)),
                 "para": lambda: "".join(f"<p>{sentence(r.randint(3, 25))}</p>" for _ in range(r.randint(1, 4))),
                 "form": lambda: f'<label>{line(2)}</label><input type="text"><button>{word()}</button>'}
        nav = lambda: r.choice((f"<nav>{inner['links']()}</nav>", f"<div{named(r.choice(('menu', 'nav', 'navigation', 'breadcrumb')))}>{inner['links']()}</div>",
                                f"<div>{inner['links']()}</div>", f"<ul{named('menu')}>{links(n)}</ul>"))
        made = {
            "nav": nav,
            "header": lambda: r.choice((f"<header><h1>{line(3)}</h1>{nav() if r.random() < .5 else ''}</header>", f"<div{named('header')}><p>{line(4)}</p></div>", f'<div role="banner">{line(3)}</div>')),
            "footer": lambda: r.choice((f"<footer>&copy; {line(r.randint(2, 14))}</footer>", f"<div{named('footer')}><p>&copy; {line(6)}</p>{inner['links']()}</div>", f"<footer><p>{sentence(9)}</p>{inner['links']()}</footer>")),
            "side": lambda: r.choice((f"<aside><h3>{line(2)}</h3>{inner[r.choice(('links', 'para'))]()}</aside>", f"<div{named(r.choice(('sidebar', 'widget', 'related')))}><h3>{line(2)}</h3>{inner[r.choice(('links', 'para'))]()}</div>")),
            "ad": lambda: f"<{(t := r.choice(('div', 'div', 'section', 'p')))}{named(r.choice(('ad', 'ads', 'advert', 'promo', 'sponsored', 'banner')))}>{sentence(r.randint(3, 25))}</{t}>",
            "notice": lambda: f"<div{named(r.choice(('cookie-notice', 'notice', 'consent', 'alert', 'cookie-banner')))}><p>{sentence(r.randint(5, 25))}</p><button>{word()}</button></div>",
            "form": lambda: r.choice((f"<form action='/x'>{inner['form']()}<p>{line(5)}</p></form>", f"<div{named(r.choice(('newsletter', 'login', 'signup')))}><p>{sentence(8)}</p><form>{inner['form']()}</form></div>")),
            "comments": lambda: f"<{(t := r.choice(('section', 'div')))}{named('comments')}><h2>{line(1)}</h2>" + "".join(
                f"<{(u := r.choice(('div', 'article', 'li')))}{named('comment')}><p>{sentence(r.randint(4, 40))}</p></{u}>" for _ in range(r.randint(1, 6))) + f"</{t}>",
            "share": lambda: f"<div{named(r.choice(('share', 'social')))}>{inner['links']()}</div>",
            "script": lambda: r.choice((f"<script>var {word()} = '</p>';</script>", f"<style>.{word()}{{margin:0}}</style>", "<!-- x -->")),
        }
        return made[kind]()

    good = lambda n: "\x01" + sentence(n)
    if r.random() < .2:
        good = lambda n: "\x01" + line(n)
    part = []
    for _ in range(r.choice((0, 1, 1, 2, 3, 4, 6, 9, 14))):
        kind = r.choices(("p", "b", "ul", "quote", "h2", "pre", "table", "figure", "br"), (12, 1, 1, 1, 2, .5, .5, .5, 1))[0]
        n = r.choice((2, 8, 20, 45, 90))
        part.append({"p": lambda: f"<p>{good(n)}" + r.choice(("</p>", "</p>", "")), "b": lambda: f"<p><b>{good(n)}<br>", "br": lambda: f"<div>{good(n)}<br>{line(n)}</div>",
                     "ul": lambda: "<ul>" + "".join(f"<li>{good(r.randint(2, 15))}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                     "quote": lambda: f"<blockquote><p>{good(n)}</p></blockquote>", "h2": lambda: f"<h2>{good(4)}</h2>",
                     "pre": lambda: f"<pre>{good(n)}</pre>", "figure": lambda: f"<figure><img src='x'><figcaption>{good(6)}</figcaption></figure>",
                     "table": lambda: f"<table><tr><td>{good(3)}</td><td>{good(3)}</td></tr></table>"}[kind]())
        if r.random() < .12:
            part.append(boiler(r.choice(("ad", "share", "side", "form", "notice"))))
    title = f"<h1>\x01{line(r.randint(1, 9))}</h1>"
    head = title if r.random() < .85 else f"<header>{title}</header>" if r.random() < .5 else ""
    body = head + "".join(part)
    if r.random() < .25:
        body += boiler(r.choice(("comments", "share", "side")))
    wrap = r.choice(("article", "article", "article", "main", "section", "div-c", "div-c", "div", "main-article", "none"))
    body = {"div-c": lambda: f"<div{named(r.choice(('content', 'post', 'entry', 'story', 'article-body', 'main-content')))}>{body}</div>",
            "main-article": lambda: f"<main><article>{body}</article></main>", "none": lambda: body}.get(wrap, lambda: f"<{wrap}>{body}</{wrap}>")()
    top = "".join(boiler(k) for k in r.sample(("nav", "header", "ad", "notice", "script", "form"), r.randint(0, 4)))
    low = "".join(boiler(k) for k in r.sample(("footer", "comments", "ad", "side", "share", "form", "nav", "script"), r.randint(0, 5)))
    page = top + body + low
    if r.random() < .4:
        page = f"<div{named('wrapper')}>{page}</div>"
    return f"<!DOCTYPE html><html><head><title>{line(4)}</title><style>p{{}}</style></head><body>{page}</body></html>"


def lessons(count: int = LESSONS) -> Boosted:
    """Trees trained on generated pages; a node is positive if its subtree holds main text."""
    r, xs, ys = random.Random(5), [], []
    for _ in range(count):
        nodes = parse(lesson(r))
        y = np.array([float(any(isinstance(s, str) and "\x01" in s for s in x.flow)) for x in nodes])
        for x in nodes:
            x.flow = [s.replace("\x01", "") if isinstance(s, str) else s for s in x.flow]
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] = max(y[nodes[i].parent], y[i])
        xs.append(node_features(nodes))
        ys.append(y)
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def main_texts(htmls: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(h) if h else [] for h in htmls]
    full = [t for t in trees if t]
    odds = model.predict(np.concatenate([node_features(t) for t in full])) if full else np.zeros(0)
    out, at = [], 0
    for t in trees:
        out.append(render(t, decode(t, odds[at:at + len(t)])) if t else "")
        at += len(t)
    return out


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or lessons())

    def run(batches):
        for pdf in pieces_of(batches, lambda r: len(r.html or ""), 2 << 20, 512):
            text = main_texts(list(pdf["html"]), held.value)
            yield pd.DataFrame({"page_id": pdf["page_id"].astype("Int64"), "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInPandas(run, "page_id long, url string, text string, n_chars long")
