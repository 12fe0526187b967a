"""Main text of pages: a tree-structured graphical model over DOM nodes.

Each node of a page (elements and blocks of text) is content or not. A node's own features (its tag, the words of its
class and id, the length, links and punctuation of a block) give it a unary potential (log odds, linear in the
features); every parent and child share a 2 x 2 table of potentials, one for each kind of parent (KINDS). Messages go from the leaves up and from the root
down (sum-product, exact on a tree), which gives each block's marginal probability of being content; blocks above one
half are the main text. What a block is part of reaches it by these messages alone: no feature looks at its ancestors.

The weights are trained by gradient ascent on the exact likelihood of labelled pages. The labelled pages are made here
(`labelled_page`): layouts with menus, headers, footers, sidebars, notices, adverts, forms, related links and reader
comments around and inside articles, in several markups. A page's own words play no part, only markup, lengths and
link shares. Training takes seconds, once a driver process, from a fixed seed.

Defined results: null html counts as empty; a page without content has empty text; pages are processed whole; a
page's result depends on its html alone, so repeated rows tie; an empty table gives an empty table; other columns stay,
but for one with the output's name, which is replaced.
"""

from __future__ import annotations

import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from volatide.llm.common import add_columns
from volatide.llm.dom import Page

# Words in class, id, role or label that tell what a part is for.
LEXICON = {
    "advert": "ad ads advert advertisement adsense banner promo promoted sponsor sponsored sponsors dfp outbrain taboola",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip links toolbar share sharing social tags tag",
    "frame": "header masthead topbar footer foot bottom copyright legal colophon site logo",
    "side": "sidebar side aside rail widget widgets related recommended recommendations popular trending more teaser teasers",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter paywall signup hidden",
    "form": "form search login register input contact field",
    "comment": "comment comments commentlist discussion replies reply responses disqus respond",
    "content": "article content post entry story main body text maintext prose",
}
_TOPIC = {w: k for k, words in LEXICON.items() for w in words.split()}
TAGS = "article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav header footer aside form fieldset button table tr td th tbody blockquote pre figure figcaption body html head address details summary center hr".split()
_WORDS = re.compile(r"[a-z]+")
_BASE = len(TAGS) + 2
_CONTEXT = {k: _BASE + i for i, k in enumerate(LEXICON)}
_TEXT = _BASE + len(LEXICON)
_OWNER = _TEXT + 12
FEATURES = _OWNER + len(TAGS) + 2
# Words that begin a legal notice.
_LEGAL = re.compile(r"©|\(c\) |copyright|all rights reserved|alle rechte|tous droits|todos los derechos|impressum", re.IGNORECASE)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


# Kinds of parents with potentials of their own; 0 are all others.
KINDS = {"#page": 1, "html": 1, "body": 1, "article": 2, "main": 2, "header": 3, "footer": 3, "nav": 3, "aside": 3, "form": 3}
TABLES = 4


def kinds(page: Page) -> list[int]:
    """The kind of each node's parent."""
    return [KINDS.get(page.tag[up], 0) if up >= 0 else 0 for up in page.parent]


def features(page: Page) -> list[list[tuple[int, float]]]:
    """Sparse features of each node."""
    out: list[list[tuple[int, float]]] = []
    for i, tag in enumerate(page.tag):
        up = page.parent[i]
        if tag:
            row = [(_TAG_AT.get(tag, len(TAGS)), 1.0)]
            if page.marks[i]:
                row += [(_CONTEXT[k], 1.0) for k in {_TOPIC[w] for w in _WORDS.findall(page.marks[i]) if w in _TOPIC}]
        else:
            text = page.text[i]
            size, share = len(text), page.linked[i] / len(text)
            ended = text[-1] in ".!?…\"”»"
            row = [
                (_TEXT, 1.0), (_TEXT + 1, min(8.0, math.log1p(size)) / 8), (_TEXT + 2, share), (_TEXT + 3, float(share > 0.8)), (_TEXT + 4, float(ended)),
                (_TEXT + 5, float(size < 25)), (_TEXT + 6, float(size > 140)), (_TEXT + 7, float(_LEGAL.search(text, 0, 200) is not None)), (_TEXT + 8, float(size > 400)), (_TEXT + 9, float(not ended and size < 80)),
                (_OWNER + _TAG_AT.get(page.tag[up], len(TAGS)), 1.0),
            ]
        out.append(row)
    return out


def _soft(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high + math.log1p(math.exp(low - high))


def marginals(parent: list[int], unary: list[float], tables: list[list[float]], kind: list[int]) -> tuple[list[float], list[float]]:
    """Log odds of each node, and of each node's message to its parent. A table: 00, 01, 10, 11 (parent, child)."""
    n = len(parent)
    up = list(unary)
    message = [0.0] * n
    for i in range(n - 1, 0, -1):  # children follow their parents in page order
        u = up[i]
        t00, t01, t10, t11 = tables[kind[i]]
        message[i] = _soft(t10, t11 + u) - _soft(t00, t01 + u)
        up[parent[i]] += message[i]
    odds = up
    for i in range(1, n):
        d = odds[parent[i]] - message[i]
        t00, t01, t10, t11 = tables[kind[i]]
        odds[i] += _soft(t01, t11 + d) - _soft(t00, t10 + d)
    return odds, message


class Model:
    def __init__(self, weights: np.ndarray, tables: np.ndarray):
        self.weights, self.tables = weights.tolist(), tables.tolist()

    def blocks(self, source: str | None) -> list[tuple[str, float]]:
        """All blocks of text with their probability of being content, in page order."""
        page = Page(source or "")
        w = self.weights
        unary = [sum([w[k] * v for k, v in row]) for row in features(page)]
        odds, _ = marginals(page.parent, unary, self.tables, kinds(page))
        return [(page.text[i], 1 / (1 + math.exp(-max(-700.0, min(700.0, odds[i]))))) for i, tag in enumerate(page.tag) if not tag]

    def text(self, source: str | None, threshold: float = 0.5) -> str:
        return "\n\n".join(text for text, p in self.blocks(source) if p > threshold)


def labelled_page(rng: random.Random) -> str:
    """A page whose content blocks, and only these, hold the marker character ¤ (removed before training)."""

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("aeioulnrst", k=rng.randrange(1, 11))) for _ in range(rng.randrange(low, high)))

    def sentence(low: int = 3, high: int = 25) -> str:
        return words(low, high).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randrange(low, high)))

    def named(kind: str) -> str:
        names = [*LEXICON[kind].split()]
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="box {rng.choice(names)}-{words(1, 2)}"'])

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/{words(1, 2)}">{words(low, high)}</a>'

    def links(tag: str = "ul") -> str:
        return f"<{tag}>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 9))) + f"</{tag}>"

    def nested(inner: str) -> str:
        """The same, perhaps in a box or two without a name."""
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            inner = f"<{(t := rng.choice(['div', 'div', 'section']))}>{inner}</{t}>"
        return inner

    def menu() -> str:
        if rng.random() < 0.15:
            return f"<div{named('menu')}>{nested(rng.choice([words(1, 6), sentence(2, 8), '<p>' + words(1, 6) + '</p>']))}</div>"
        return rng.choice([lambda: f"<nav>{links()}</nav>", lambda: f"<div{named('menu')}>{links()}</div>", lambda: f"<nav{named('menu')}>" + " ".join(link() for _ in range(5)) + "</nav>"])()

    def advert() -> str:
        body = rng.choice([sentence(1, 12), f"<p>{prose(1, 3)}</p>", link(2, 9), f"<p>{words(1, 5)}</p><p>{sentence()}</p>"])
        return f"<{(t := rng.choice(['div', 'section', 'aside']))}{named('advert')}>{nested(body)}</{t}>"

    def notice() -> str:
        inner = nested(f"<p>{prose(1, 4)}</p>{rng.choice(['<button>ok</button>', link(), ''])}")
        return f"<div{named('notice')}>{inner}</div>"

    def form() -> str:
        if rng.random() < 0.3:
            inner = nested(f"<p>{sentence(1, 9)}</p>")
            return f"<div{named('form')}>{inner}</div>"
        return f"<form{rng.choice(['', named('form')])}><label>{words(1, 4)}</label><input name=q><p>{sentence()}</p><button>{words(1, 3)}</button></form>"

    def side() -> str:
        inner = rng.choice([links(), f"<h3>{words(1, 4)}</h3>{links()}", f"<h3>{words(1, 4)}</h3><p>{prose(1, 4)}</p>", f"<p>{prose()}</p>", f"<div><p>{prose()}</p></div>"])
        inner = nested(inner)
        return rng.choice([f"<aside>{inner}</aside>", f"<aside{named('side')}>{inner}</aside>", f"<div{named('side')}>{inner}</div>"])

    def comments() -> str:
        one = lambda: rng.choice([f"<p>{prose()}</p>", f"<li><p>{prose()}</p></li>", f"<div{named('comment')}><b>{words(1, 3)}</b> <p>{prose()}</p></div>", f"<article{named('comment')}><p>{prose()}</p></article>"])
        inner = rng.choice(["", f"<h2>{words(1, 3)}</h2>"]) + "".join(one() for _ in range(rng.randrange(1, 6)))
        return f"<{(t := rng.choice(['section', 'div', 'ol', 'ul']))}{named('comment')}>{nested(inner) if t in ('section', 'div') else inner}</{t}>"

    def head() -> str:
        inner = rng.choice(["", f"<h1>{words(1, 4)}</h1>", f"<p>{words(2, 9)}</p>", f"<div>{link()}</div>"]) + rng.choice(["", menu()])
        inner = nested(inner)
        return rng.choice([f"<header>{inner}</header>", f"<header{named('frame')}>{inner}</header>", f"<div{named('frame')}>{inner}</div>"])

    def legal() -> str:
        return rng.choice([f"Copyright {words(1, 6)}", f"&copy; 20{rng.randrange(10, 30)} {words(1, 6)}", f"(c) {words(1, 4)}. All rights reserved.", f"Copyright &copy; {words(1, 3)} {sentence()}", f"{words(1, 4)}. All rights reserved. {link()}"])

    def foot() -> str:
        if rng.random() < 0.25:  # nothing but its words tells what it is
            return f"<{(t := rng.choice(['div', 'div', 'center']))}>{legal()}</{t}>"
        inner = rng.choice([f"&copy; {words(1, 4)} &middot; {prose(1, 4)}", f"<p>{prose(1, 4)}</p>", links(), f"<p>&copy; {words(2, 8)}</p>{links()}", f"<div><p>{prose()}</p></div>"])
        inner = nested(inner)
        return rng.choice([f"<footer>{inner}</footer>", f"<footer{named('frame')}>{inner}</footer>", f"<div{named('frame')}>{inner}</div>"])

    def block() -> str:
        text = rng.choice([prose(), prose(), sentence(1, 6), words(1, 8)])
        if rng.random() < 0.06:  # articles say such things too
            return f"<p>¤{legal() if rng.random() < 0.5 else rng.choice(['All rights reserved.', 'Copyright'])}</p>"
        kind = rng.random()
        if kind < 0.6:
            return rng.choice([f"<p>¤{text}</p>", f"<p>¤{text} {link()} {sentence()}</p>", f"<p><b>¤{text}<br>", f"<p>¤<em>{text}</em></p>", f"<p>¤{link(1, 3)}</p>" if rng.random() < 0.1 else f"<p>¤{text}</p>"])
        if kind < 0.7:
            return f"<h{(n := rng.randrange(2, 5))}>¤{words(1, 9)}</h{n}>"
        if kind < 0.78:
            return f"<{(t := rng.choice(['ul', 'ol']))}>" + "".join(f"<li>¤{sentence(1, 15)}</li>" for _ in range(rng.randrange(1, 5))) + f"</{t}>"
        if kind < 0.84:
            return f"<blockquote><p>¤{text}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>¤{text}</blockquote>"
        if kind < 0.88:
            return f"<pre>¤{text}</pre>"
        if kind < 0.92:
            return "<table>" + "".join("<tr>" + "".join(f"<td>¤{words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(2)) + "</table>"
        if kind < 0.95:
            return f'<figure><img src="x"><figcaption>¤{sentence()}</figcaption></figure>'
        return f"<div>¤{text}</div>"

    def article() -> str:
        title = rng.choice([f"<h1>¤{words(2, 12)}</h1>", f"<header><h1>¤{words(2, 12)}</h1></header>", f"<h1{named('content')}>¤{words(2, 12)}</h1>"])
        inner = [block() for _ in range(rng.choice([1, 2, 3, 5, 8, 14]))]
        for extra in (advert, side, form, notice, comments, menu):
            if rng.random() < 0.13:
                inner.insert(rng.randrange(len(inner) + 1), extra())
        body = "".join(inner)
        if rng.random() < 0.4:
            body = f"<div{rng.choice(['', named('content')])}>{body}</div>"
        body = nested(title + body) if rng.random() < 0.3 else title + body
        title = ""
        return rng.choice([f"<article>{title}{body}</article>", f"<article>{title}{body}</article>", f"<main><article{named('content')}>{title}{body}</article></main>", f"<main>{title}{body}</main>", f"<div{named('content')}>{title}{body}</div>", f"<section{named('content')}>{title}{body}</section>"])

    before = [part() for part in (head, menu, advert, notice, form, side) if rng.random() < 0.45]
    after = [part() for part in (comments, side, advert, form, menu, notice) if rng.random() < 0.35] + ([foot()] if rng.random() < 0.85 else [])
    rng.shuffle(before)
    middle = [article()] if rng.random() < 0.95 else []
    body = "".join([*before, *middle, *after])
    if rng.random() < 0.3:
        body = f"<div{rng.choice(['', ' class=wrapper', ' id=page'])}>{body}</div>"
    return f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{body}</body></html>"


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Nodes of all pages by depth, from 1 on."""
    depth = np.zeros(len(parent), np.int64)
    for i in range(len(parent)):
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    return [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]


def _all_marginals(parent: np.ndarray, levels: list[np.ndarray], unary: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`marginals` of many pages at once, a depth at a time; tables: (4, nodes), those of the nodes' edges."""
    odds, message = unary.copy(), np.zeros(len(unary))
    for nodes in reversed(levels):
        u, table = odds[nodes], tables[:, nodes]
        message[nodes] = np.logaddexp(table[2], table[3] + u) - np.logaddexp(table[0], table[1] + u)
        np.add.at(odds, parent[nodes], message[nodes])
    for nodes in levels:
        d, table = odds[parent[nodes]] - message[nodes], tables[:, nodes]
        odds[nodes] += np.logaddexp(table[1], table[3] + d) - np.logaddexp(table[0], table[2] + d)
    return odds, message


def train(pages: int = 1000, rounds: int = 250, seed: int = 11, tree: bool = True) -> Model:
    """Gradient ascent (Adam) on the likelihood of labelled pages; without `tree` all pair potentials stay 0, to tell what they do."""
    rng = random.Random(seed)
    parents: list[int] = []
    rows: list[list[tuple[int, float]]] = []
    label: list[int] = []
    edge: list[int] = []
    starts: list[int] = []
    for _ in range(pages):
        page = Page(labelled_page(rng))
        own = [int("¤" in t) for t in page.text]
        page.text = [t.replace("¤", "").strip() or "x" for t in page.text]
        rows += features(page)
        edge += kinds(page)
        for i in range(len(own) - 1, 0, -1):
            own[page.parent[i]] |= own[i]
        starts.append(len(label))
        parents += [p + starts[-1] if p >= 0 else -1 for p in page.parent]
        label += own
    x = np.zeros((len(rows), FEATURES))
    for i, row in enumerate(rows):
        for k, v in row:
            x[i, k] += v
    y, parent = np.array(label, float), np.array(parents)
    levels = _levels(parent)
    child = np.flatnonzero(parent >= 0)
    above_of = parent[child]
    kind = np.array(edge)
    which = kind[child]
    seen = np.array([[((y[above_of] == a) & (y[child] == b) & (which == k)).sum() for a in (0, 1) for b in (0, 1)] for k in range(TABLES)], float)
    theta, first, second = (np.zeros(FEATURES + 4 * TABLES) for _ in range(3))
    for step in range(1, rounds + 1):
        tables = theta[FEATURES:].reshape(TABLES, 4)[kind].T
        odds, message = _all_marginals(parent, levels, x @ theta[:FEATURES], tables)
        table = tables[:, child]
        # Joint of each edge: the parent without this child's message, the child without the parent's.
        above = odds[above_of] - message[child]
        down = np.logaddexp(table[1], table[3] + above) - np.logaddexp(table[0], table[2] + above)
        below = odds[child] - down
        joint = np.stack([table[0], table[1] + below, table[2] + above, table[3] + above + below])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
        slope = np.concatenate([x.T @ (y - 1 / (1 + np.exp(-np.clip(odds, -500, 500)))), (seen - np.stack([joint[:, which == k].sum(1) for k in range(TABLES)])).ravel()]) / len(y) - 2e-5 * theta
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
        theta = theta + 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        if not tree:
            theta[FEATURES:] = 0
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(TABLES, 4))


@lru_cache(maxsize=1)
def trained() -> Model:
    return train()


def extract(df: DataFrame, html: str = "html", text: str = "text", model: Model | None = None) -> DataFrame:
    """Add `text`: the main text of each page."""
    used = model or trained()

    def make(batch):
        return [pa.array([used.text(h) for h in batch.column(html).to_pylist()], pa.string())]

    return add_columns(df, [T.StructField(text, T.StringType())], make, 256)
