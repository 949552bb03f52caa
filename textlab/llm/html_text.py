"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks (runs of text between block-level tags). Each block has features of its ancestors' tags and
of the words in their class, id and role attributes, of its own tag, and of its text (length, share of linked characters,
punctuation, position). A two-label chain over the blocks, trained here by stochastic gradient steps on the exact
log-likelihood (forward-backward) of a seeded generator of labelled pages, is decoded by Viterbi; blocks labelled as content
are the main text. Scripts, styles, the head, templates and comments of the markup never become blocks.

Defined results: null and empty pages give the empty text; so does a page without a content block; repeated rows are treated
alike; unclosed tags, attributes and comments are read to the page's end; long and deeply nested pages are read whole, in
linear time: blocks share what their open tags contribute.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, table

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul button label iframe object video audio canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title head".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol table dl div section article td th form nav aside main footer header body".split())
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>?")
HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HINT_WORD = re.compile(r"[a-z]+")
HINTS = frozenset("ad ads advert advertisement sponsor sponsored promo banner nav menu navigation breadcrumb breadcrumbs header masthead footer foot copyright sidebar side widget related recommended comment comments reply replies disqus respond cookie consent notice gdpr alert popup modal newsletter subscribe signup form login search share social tags meta byline content article post entry main story body text pager pagination skip contentinfo complementary banner".split())
ANCESTORS = frozenset("nav header footer aside article main form section ul ol table blockquote figure dialog button select label fieldset details menu h1 h2 h3 p div li td".split())


CLOSABLE = frozenset().union(*CLOSES.values())
MAIN_HINTS = frozenset(("content", "article", "post", "entry", "story"))


class Node:
    """An open tag: what its blocks need of it and its ancestors, shared with the parent where nothing is added. `near` has
    the places in the stack of the closest tags that a new tag may close."""

    __slots__ = ("inside", "name", "names", "near", "own")

    def __init__(self, name: str, hints: tuple[str, ...], parent: Node | None, place: int):
        self.name = name
        more = [f"in:{name}"] if name in ANCESTORS else []
        more += [f"hint:{h}" for h in hints]
        above = parent.names if parent else frozenset()
        self.names = above if above.issuperset(more) else above.union(more)
        self.own = name if name in BLOCK else parent.own if parent else "body"
        self.inside = name in ("article", "main") or not MAIN_HINTS.isdisjoint(hints) or bool(parent and parent.inside)
        near = parent.near if parent and name not in STOPS else {}
        self.near = {**near, name: place} if name in CLOSABLE else near


ROOT = Node("", (), None, -1)


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node, linked: int):
        self.text, self.node, self.linked = text, node, linked


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order, with white space collapsed and character references decoded."""
    out: list[Block] = []
    stack: list[Node] = []
    open_: Counter = Counter()
    unclosed: set[str] = set()
    held: list[str] = []
    linked = 0
    page = page or ""

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, stack[-1] if stack else ROOT, linked))
            held.clear()
        linked = 0

    def close_from(i: int) -> None:
        open_.subtract(n.name for n in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            run = page[at:lt]
            if "&" in run:
                run = entities.unescape(run)
            held.append(run)
            if any(n.name == "a" for n in stack[-4:]):
                linked += len(run)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if not m:
            held.append("<")
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name in BLOCK:
                flush()
            for i in range(len(stack) - 1, -1, -1) if open_[name] > 0 else ():
                if stack[i].name == name:
                    close_from(i)
                    break
                if name not in BLOCK and stack[i].name in BLOCK:
                    break
            continue
        if name in RAW:
            if not m[3].endswith("/") and name not in unclosed:
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                if not close:
                    unclosed.add(name)
                at = close.end() if close else end if name != "head" else at
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCK:
            flush()
            near = stack[-1].near if stack else {}
            place = max((near.get(t, -1) for t in CLOSES.get(name, {"p"}) | {"p"}), default=-1)
            if place >= 0:
                close_from(place)
        if name not in VOID and not m[3].endswith("/"):
            hints: tuple[str, ...] = ()
            if "=" in m[3]:
                hints = tuple(sorted({w for a in HINT.findall(m[3]) for w in HINT_WORD.findall("".join(a).lower()) if w in HINTS}))
            stack.append(Node(name, hints, stack[-1] if stack else None, len(stack)))
            open_[name] += 1
    flush()
    return out


def describe(found: list[Block]) -> list[list[str]]:
    """The names of the features of each block."""
    out, n = [], len(found)
    for k, b in enumerate(found):
        names = {"bias", *b.node.names}
        own = b.node.own
        size, words = len(b.text), b.text.count(" ") + 1
        names |= {f"own:{own}", f"size:{min(7, size.bit_length() - 2) if size > 3 else 0}", f"links:{min(4, 4 * b.linked // max(1, size))}", f"words:{min(5, words.bit_length())}"}
        names.add(f"ends:{'stop' if b.text[-1] in '.!?…' else 'other'}")
        if k == 0:
            names.add("first")
        if k == n - 1:
            names.add("last")
        if "©" in b.text or "(c)" in b.text.lower():
            names.add("copyright")
        if not b.node.inside:
            names.add("outside")
        out.append(sorted(names))
    return out


class ChainField:
    """Two labels (0 other, 1 content); weights by feature and label, by label pair, and by first label."""

    def __init__(self, weights: dict[str, np.ndarray], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    def states(self, described: list[list[str]]) -> np.ndarray:
        zero = np.zeros(2)
        return np.array([sum((self.weights.get(f, zero) for f in names), zero) for names in described])

    def viterbi(self, described: list[list[str]]) -> list[int]:
        if not described:
            return []
        s = self.states(described)
        s0, pairs = s.tolist(), self.pairs.tolist()
        a, b = s0[0][0] + self.first[0], s0[0][1] + self.first[1]
        back = []
        for x, y in s0[1:]:
            to0, to1 = (a + pairs[0][0], b + pairs[1][0]), (a + pairs[0][1], b + pairs[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0) + x, max(to1) + y
        path = [int(b > a)]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-3, seed: int = 3) -> ChainField:
        rng = np.random.default_rng(seed)
        field = cls({f: np.zeros(2) for names, _ in pages for block in names for f in block}, np.zeros((2, 2)), np.zeros(2))
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for k in rng.permutation(len(pages)):
                described, labels = pages[k]
                if not described:
                    continue
                s, n = field.states(described), len(described)
                fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
                fwd[0] = s[0] + field.first
                for i in range(1, n):
                    fwd[i] = s[i] + np.logaddexp(fwd[i - 1, 0] + field.pairs[0], fwd[i - 1, 1] + field.pairs[1])
                for i in range(n - 2, -1, -1):
                    nxt = s[i + 1] + bwd[i + 1]
                    bwd[i] = np.logaddexp(field.pairs[:, 0] + nxt[0], field.pairs[:, 1] + nxt[1])
                z = np.logaddexp(*fwd[-1])
                p = np.exp(fwd + bwd - z)
                y = np.eye(2)[labels]
                for i, names in enumerate(described):
                    g = step * (y[i] - p[i])
                    for f in names:
                        field.weights[f] += g - step * l2 * field.weights[f]
                field.first += step * (y[0] - p[0])
                for i in range(1, n):
                    both = np.exp(fwd[i - 1][:, None] + field.pairs + (s[i] + bwd[i])[None] - z)
                    field.pairs += step * (np.outer(y[i - 1], y[i]) - both) / 4
        return field


def labelled_pages(n: int, seed: int) -> list[tuple[str, list[str]]]:
    """Seeded pages with the blocks of their main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("an", "er", "tion", "ou", "de", "la", "st", "re", "li", "mo", "ka", "é", "ü") for _ in range(int(rng.integers(1, 4))))
    phrase = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b)))).capitalize()
    out = []
    for _ in range(n):
        main: list[str] = []
        alone, bare, brief = chance(0.1), chance(0.12), chance(0.15)

        def keep(text: str) -> str:
            main.append(text)
            return text

        def sentences(a: int, b: int) -> str:
            return " ".join(phrase(2, 14) + pick(".", ".", ".", "!", "?") for _ in range(int(rng.integers(a, b))))

        links = lambda k: "".join(f'<li><a href="/{word()}">{phrase(1, 3)}</a></li>' for _ in range(k))
        parts = ["<html><head><title>" + phrase(2, 6) + "</title><style>p{}</style></head><body>"]
        before = [
            f"<nav><ul>{links(int(rng.integers(2, 8)))}</ul></nav>", f'<div class="menu"><ul>{links(4)}</ul></div>', f"<header><h2>{phrase(1, 3)}</h2><p>{phrase(2, 6)}</p></header>", f'<header class="masthead"><a href="/">{phrase(1, 3)}</a><h1>{phrase(1, 3)}</h1></header>',
            f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo banner")}">{sentences(1, 4)}</div>', f'<div id="cookie-{pick("notice", "consent")}"><p>{sentences(1, 3)}</p><button>OK</button></div>', f'<form action="/s" class="search"><label>{phrase(1, 2)}</label><input name="q"><button>{word()}</button></form>', f'<div class="breadcrumbs"><a href="/">{word()}</a> &gt; <a href="/x">{word()}</a></div>', f'<aside><h3>{phrase(1, 3)}</h3><p>{sentences(1, 3)}</p></aside>', f"<div class='notice'>{sentences(1, 2)}</div>",
        ]
        after = [
            f'<div class="{pick("comments", "comment-list", "replies")}"><h3>{phrase(1, 2)}</h3>' + "".join(f'<div class="comment"><b>{word()}</b><p>{sentences(1, 4)}</p></div>' for _ in range(int(rng.integers(1, 4)))) + "</div>", f'<section id="comments"><h2>{phrase(1, 2)}</h2><ul>' + "".join(f"<li><p>{sentences(1, 4)}</p></li>" for _ in range(int(rng.integers(1, 5)))) + "</ul></section>",
            f'<aside class="sidebar"><h3>{phrase(1, 3)}</h3><ul>{links(4)}</ul><p>{sentences(1, 3)}</p></aside>', f'<div class="sidebar"><p>{sentences(1, 4)}</p></div>', f'<div class="related"><h3>{phrase(1, 3)}</h3><ul>{links(3)}</ul></div>', f'<form class="newsletter"><p>{sentences(1, 2)}</p><input><button>{word()}</button></form>', f'<div class="share"><a href="#">{word()}</a> <a href="#">{word()}</a></div>', f'<div class="ad">{sentences(1, 4)}</div>',
            f"<footer>&copy; {word()} &middot; {sentences(1, 2)}</footer>", f'<footer><p>{sentences(1, 3)}</p><ul>{links(3)}</ul></footer>', f'<div class="footer">&copy; 2020 {phrase(1, 4)}</div>',
        ]
        for k in rng.permutation(len(before))[: 0 if alone or bare else int(rng.integers(1, 5))]:
            parts.append(before[k])
        open_, close = pick(("<article>", "</article>"), ("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ("<main><article>", "</article></main>"), ('<div id="post">', "</div>"), ('<div class="story body">', "</div>"), ("<div>", "</div>"), ("", ""))
        parts.append(open_)
        if chance(0.4 if brief else 0.8):
            parts.append(f"<h1>{keep(phrase(2, 9) + pick('', '.'))}</h1>")
        for _ in range(int(rng.integers(1, 3 if brief else 9))):
            r = rng.random()
            if brief:
                parts.append(f"<p>{keep(phrase(2, 7) + pick('.', '.', '', '!'))}</p>")
            elif r < 0.62:
                parts.append(f"<p>{keep(sentences(1, 7))}</p>")
            elif r < 0.70:
                parts.append(f"<p><b>{keep(phrase(1, 12) + '.')}<br>")
            elif r < 0.76:
                parts.append(f"<h2>{keep(phrase(1, 6))}</h2>")
            elif r < 0.82:
                parts.append("<ul>" + "".join(f"<li>{keep(phrase(2, 9))}</li>" for _ in range(int(rng.integers(2, 5)))) + "</ul>")
            elif r < 0.86:
                parts.append(f"<blockquote>{keep(sentences(1, 3))}</blockquote>")
            elif r < 0.89:
                parts.append(f"<pre>{keep(phrase(3, 9))}</pre>")
            elif r < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{keep(phrase(1, 3))}</td><td>{keep(phrase(1, 3))}</td></tr>" for _ in range(2)) + "</table>")
            elif r < 0.96:
                parts.append(f'<div class="{pick("ad", "advert", "promo", "newsletter", "share", "related")}">{sentences(1, 3)}</div>')
            else:
                parts.append(f"<p>{keep(phrase(1, 3))}</p>")
        parts.append(close)
        for k in rng.permutation(len(after))[: 0 if alone or chance(0.12) else int(rng.integers(1, 5))]:
            parts.append(after[k])
        out.append(("".join(parts) + ("</body></html>" if chance(0.9) else ""), main))
    return out


def labels_of(found: list[Block], main: list[str]) -> list[int]:
    """1 for the blocks that are, in order, the main text."""
    labels, k = [], 0
    for b in found:
        hit = k < len(main) and b.text == " ".join(entities.unescape(main[k]).split())
        k += hit
        labels.append(int(hit))
    return labels


@functools.cache
def model(n: int = 500, seed: int = 2) -> ChainField:
    pages = []
    for page, main in labelled_pages(n, seed):
        found = blocks(page)
        pages.append((describe(found), labels_of(found, main)))
    return ChainField.train(pages)


def main_text(page: str | None, field: ChainField) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, y in zip(found, field.viterbi(describe(found)), strict=True) if y)


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", also: tuple[str, ...] = ("url",)) -> DataFrame:
    """The key, the columns `also`, text and n_chars of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(model())

    def make():
        field = shared.value

        def fn(batch):
            keys, raw = batch.column("key").to_pylist(), batch.column("html").to_pylist()
            kept = {c: batch.column(c).to_pylist() for c in also}
            for at in range(0, len(keys), 500):
                texts = [main_text(x, field) for x in raw[at : at + 500]]
                yield {key: keys[at : at + 500], "text": texts, "n_chars": [len(t) for t in texts]} | {c: v[at : at + 500] for c, v in kept.items()}

        return fn

    fields = [(key, pages.schema[key])] + [(c, pages.schema[c]) for c in also]
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in fields) + ", text string, n_chars long"
    return arrow_map(pages.select(pages[key].alias("key"), pages[html].alias("html"), *also), make, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
