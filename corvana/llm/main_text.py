"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element and every run of text is a node with a binary variable: part
of the article or not. A node's own potential is a linear function of its features
(tag, words of class, id and role, length and share of linked text of the node and of all
below it, tags above, hidden or not); words that training has hardly met count for nothing;
potentials between parent and child depend on the kind of child. Messages go from
the leaves to the root and back (sum-product), which gives the exact marginal of
every node; runs of text whose marginal is above one half are the article.

The parameters maximise the likelihood of labelled pages, whose gradient is the
difference of observed and expected features under those marginals. The labelled
pages are written by layouts(), from a seed: layouts of many styles with the labels
of their elements, since no table has such labels.

Defined cases: null and empty html, and html without text, give an empty text.
Fragments without html and body, plain text too, may be an article alone. Broken and
cut markup is read as far as it goes, in time in proportion to its size. Repeated rows give repeated
results; other columns are not carried.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from corvana.llm.common import lean
from corvana.llm.dom import Node, parse

EDGES = ("element", "text")
#: A page with one of these has a frame; without, it may be an article alone.
FRAME = ("html", "body")
TRAINING_PAGES, EPOCHS, RATE, L2, SEED = 1300, 14, 0.15, 2e-3, 11

STOPS = ".!?:;…»”\"。"
RIGHTS = ("copyright", "all rights", "alle rechte", "tous droits", "todos los derechos")
#: Words of names that fewer training nodes have than this count for nothing.
KNOWN_NODES = 25

_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _shares(nodes: list[Node]) -> tuple[list[int], list[int], list[int]]:
    """Letters, linked letters and runs that end a sentence in and below each node."""
    size, linked, stops = ([0] * len(nodes) for _ in range(3))
    for k in range(len(nodes) - 1, -1, -1):
        node = nodes[k]
        if node.tag == "#text":
            size[k], linked[k], stops[k] = len(node.text), node.linked, int(node.text[-1] in STOPS)
        if k:
            size[node.parent] += size[k]
            linked[node.parent] += linked[k]
            stops[node.parent] += stops[k]
    return size, linked, stops


def _is_hidden(node: Node) -> bool:
    style = node.names.get("style", "").replace(" ", "").lower()
    return "hidden" in node.names or "display:none" in style or "visibility:hidden" in style


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of the active features of each node."""
    out: list[list[str]] = []
    frame = "page" if any(n.tag in FRAME for n in nodes) else "fragment"
    size, linked, stops = _shares(nodes)
    unseen = [False] * len(nodes)
    for k, node in enumerate(nodes):
        unseen[k] = (k > 0 and unseen[node.parent]) or _is_hidden(node)
        share = math.ceil(4 * linked[k] / size[k]) if size[k] else 5
        if node.tag == "#text":
            parent = nodes[node.parent]
            above = nodes[max(0, parent.parent)]
            start = node.text[:40].lower()
            found = [
                "text",
                f"in:{parent.tag}",
                f"over:{above.tag if parent.parent >= 0 else ''}",
                f"{frame}:{parent.tag}",
                f"size:{min(9, size[k].bit_length() - 1)}",
                f"linked:{share}",
                "stop" if node.text[-1] in STOPS else "no-stop",
                f"alone:{parent.children == 1}",
                "sign" if "©" in start or start.startswith(RIGHTS) else "plain",
                f"beside:{min(3, stops[parent.parent] if parent.parent >= 0 else 0)}",
            ]
        else:
            found = [f"tag:{node.tag}", f"links:{share}", f"links:{share}:{node.tag}", f"stops:{min(4, stops[k].bit_length())}", f"part:{min(4, 5 * size[k] // max(1, size[0]))}:{frame}"]
            if node.parent >= 0:
                found += [f"under:{nodes[node.parent].tag}", f"under:{nodes[node.parent].tag}>{node.tag}"]
            else:
                found.append(frame)
            for name in ("class", "id", "role", "aria-label", "itemprop"):
                value = node.names.get(name)
                if value:
                    found += [f"name:{w.lower()}" for w in _WORD.findall(value)]
        if unseen[k]:
            found.append("hidden-text" if node.tag == "#text" else "hidden")
        out.append(list(dict.fromkeys(found)))
    return out


class Model:
    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        #: For each kind of child: log potentials [parent][child].
        self.pairs = {e: [[0.5, -0.5], [-0.5, 0.5]] for e in EDGES}

    def marginals(self, nodes: list[Node], feats: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """Log odds of each node's marginal, its belief from below, and the message to its parent."""
        weigh = self.weights.get
        below = [sum(weigh(f, 0.0) for f in fs) for fs in feats]
        table = {e: tuple(math.exp(x) for row in p for x in row) for e, p in self.pairs.items()}
        up = [0.0] * len(nodes)
        exp, log = math.exp, math.log
        for k in range(len(nodes) - 1, 0, -1):
            node = nodes[k]
            p00, p01, p10, p11 = table["text" if node.tag == "#text" else "element"]
            odds = exp(min(40.0, max(-40.0, below[k])))
            up[k] = log((p10 + p11 * odds) / (p00 + p01 * odds))
            below[node.parent] += up[k]
        odds_of = below[:]
        for k in range(1, len(nodes)):
            node = nodes[k]
            p00, p01, p10, p11 = table["text" if node.tag == "#text" else "element"]
            odds = exp(min(40.0, max(-40.0, odds_of[node.parent] - up[k])))
            odds_of[k] = below[k] + log((p01 + p11 * odds) / (p00 + p10 * odds))
        return odds_of, below, up

    def learn(self, nodes: list[Node], feats: list[list[str]], rate: float) -> None:
        """One step up the gradient of the log-likelihood of a labelled page."""
        odds, below, up = self.marginals(nodes, feats)
        sure = [1 / (1 + math.exp(-min(40.0, max(-40.0, x)))) for x in odds]
        expected = {e: [[0.0, 0.0], [0.0, 0.0]] for e in EDGES}
        for k in range(1, len(nodes)):
            kind = "text" if nodes[k].tag == "#text" else "element"
            p, cavity = self.pairs[kind], odds[nodes[k].parent] - up[k]
            joint = [[math.exp(p[a][b] + min(20.0, max(-20.0, cavity)) * a + min(20.0, max(-20.0, below[k])) * b) for b in (0, 1)] for a in (0, 1)]
            total = sum(map(sum, joint))
            a, b = nodes[nodes[k].parent].label, nodes[k].label
            for x in (0, 1):
                for y in (0, 1):
                    expected[kind][x][y] += (x == a and y == b) - joint[x][y] / total
        for node, fs, s in zip(nodes, feats, sure, strict=True):
            step = rate * (node.label - s)
            if abs(step) > 1e-4:
                for f in fs:
                    self.weights[f] += step - rate * L2 * self.weights[f]
        for kind, grid in expected.items():
            for x in (0, 1):
                for y in (0, 1):
                    self.pairs[kind][x][y] = min(3.0, max(-3.0, self.pairs[kind][x][y] + 0.2 * rate * grid[x][y] / math.sqrt(len(nodes))))


def _label(nodes: list[Node]) -> None:
    """Labels from data-y, which goes from the names; a node without one takes its parent's, and the root of a page with no label 0 takes 1."""
    marks = [n.names.pop("data-y", None) for n in nodes]
    for k, node in enumerate(nodes):
        node.label = int(marks[k]) if marks[k] in ("0", "1") else nodes[node.parent].label if k else int("0" not in marks)


#: Class words of layout, which say nothing of what a box holds.
_UTILITY = "container row col-md-8 col-lg-4 col-12 flex grid px-4 py-2 mx-auto grow w-full mt-3 mb-6 d-flex gap-2 block inner outer wrap left-0 max-w-xl rounded shadow text-lg bg-white justify-center items-center clearfix span6 u-full box l-stack".split()
_SYLLABLES = "ta re mi on an der ver schi la que ion ment ci os ar th ing ed un ei pa ro sel".split()


def _layout(rng: random.Random) -> str:
    """A page of one of many styles, with data-y on its elements."""

    def words(low: int, high: int) -> list[str]:
        return ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]

    def sentence(low: int = 4, high: int = 18) -> str:
        return " ".join(words(low, high)).capitalize() + rng.choice("....!?")

    def prose(low: int = 1, high: int = 6) -> str:
        return " ".join(sentence() for _ in range(rng.randint(low, high)))

    def tag(name: str, inside: str, classes: str = "", y: int | None = None, key: str = "class") -> str:
        label = "" if y is None else f' data-y="{y}"'
        return f"<{name}{f' {key}="{classes}"' if classes else ''}{label}>{inside}</{name}>"

    def link(low: int = 1, high: int = 3) -> str:
        return f'<a href="/{rng.randint(0, 999)}">{" ".join(words(low, high))}</a>'

    def links(name: str, low: int = 3, high: int = 9) -> str:
        return tag("ul", "".join(tag("li", link()) for _ in range(rng.randint(low, high))), name)

    def named(names: list[str]) -> str:
        """A class list: names that tell, utility words that any box may have, words that nobody has met, or nothing."""
        told = [rng.choice(names)] if rng.random() < 0.55 else []
        told += rng.sample(_UTILITY, rng.randint(1, 4)) if rng.random() < 0.45 else []
        told += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) + rng.choice(("", "__", "-")) + str(rng.randint(0, 99))] if rng.random() < 0.3 else []
        rng.shuffle(told)
        return " ".join(told).strip()

    def box(names: list[str], inside: str, tags: tuple[str, ...] = ("div",), y: int = 0) -> str:
        # Without a tag or a name that tells, a box of prose is nobody's to tell from the article.
        return tag(rng.choice(tags), inside, named(names) if rng.random() < 0.5 else rng.choice(names), y, rng.choice(("class", "class", "id")))

    def wrapped(inside: str, low: int, high: int) -> str:
        for _ in range(rng.randint(low, high)):
            inside = tag(rng.choice(("div", "div", "div", "section")), inside, " ".join(rng.sample(_UTILITY, rng.randint(1, 3))) if rng.random() < 0.6 else rng.choice(("", "wrapper", "container", "page", "site", "row", "inner")))
        return inside

    side = {
        "menu": lambda: box(["nav", "navbar", "menu", "main-menu", "navigation", "top-nav", "breadcrumb", "breadcrumbs", "pagination", "toc", "tabs", ""], links(rng.choice(("", "menu", "nav-list", "links"))) if rng.random() < 0.7 else " ".join(link() for _ in range(rng.randint(2, 7))), ("nav", "nav", "div", "ul")),
        "header": lambda: box(["header", "site-header", "masthead", "top", "page-header", "branding", "logo", ""], rng.choice(("", tag("h1", " ".join(words(1, 4))))) + tag(rng.choice(("div", "p")), sentence(2, 8) if rng.random() < 0.6 else link()), ("header", "header", "div")) if rng.random() < 0.8 else tag("header", tag("p", prose(1, 2)), "", 0),
        "footer": lambda: box(["footer", "site-footer", "bottom", "legal", "copyright", "colophon", "imprint", ""], rng.choice(("&copy; 2024 ", "&copy; ", "Copyright ", "© ")) + "example.org &middot; " + (sentence(2, 9) if rng.random() < 0.6 else link()) + (tag("p", prose(1, 2)) if rng.random() < 0.4 else ""), ("footer", "footer", "div")),
        "sidebar": lambda: box(["sidebar", "side", "aside", "widget", "right-column", "rail", "related", "recommended", "popular", "trending", "more-stories", "tags", "archive", ""], tag(rng.choice(("h2", "h3", "h4", "div")), " ".join(words(1, 3))) + (links("") if rng.random() < 0.6 else tag("p", prose(1, 3))), ("aside", "aside", "div", "section")),
        "notice": lambda: box(["cookie", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "banner", "popup", "modal", "overlay", "newsletter", "subscribe", "paywall", "disclaimer", "announcement", "toast"], tag("p", prose(1, 3)) + (tag("button", " ".join(words(1, 2))) if rng.random() < 0.6 else ""), ("div", "div", "section", "aside", "dialog")),
        "advert": lambda: box(["ad", "ads", "advert", "advertisement", "adbox", "sponsored", "sponsor", "promo", "promotion", "banner-ad", "ad-slot", "commercial", "partner", "outbrain", "taboola"], prose(1, 3) if rng.random() < 0.6 else tag("p", prose(1, 2)) + link(), ("div", "div", "aside", "section", "ins")),
        "form": lambda: tag("form", tag("label", " ".join(words(1, 3))) + '<input name="q">' + (tag("p", prose(1, 2)) if rng.random() < 0.5 else "") + tag("button", " ".join(words(1, 2))), rng.choice(("", "search", "login", "signup", "contact", "subscribe")), 0),
        "comments": lambda: box(["comments", "comment-list", "responses", "discussion", "disqus", "replies", "reader-comments", "respond", "feedback"], tag(rng.choice(("h2", "h3")), " ".join(words(1, 3))) + "".join(tag(rng.choice(("div", "li", "article")), tag("p", prose(1, 4)), rng.choice(("comment", "reply", "comment-body", "message"))) for _ in range(rng.randint(1, 4))), ("section", "div", "div", "ol")),
        "cells": lambda: tag(rng.choice(("div", "td")), tag("table", "".join(tag("tr", "".join(tag("td", link()) for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(1, 5)))), named(["menu", "nav", "links"]), 0),
        "rights": lambda: tag(rng.choice(("div", "p", "span", "small")), rng.choice(("Copyright", "&copy;", "Copyright &copy;", "All rights reserved.")) + f" {rng.randint(1998, 2026)} " + " ".join(words(1, 4)), "", 0),
        "unseen": lambda: rng.choice(('<p hidden data-y="0">', '<div style="display: none" data-y="0">', '<div style="display:none" data-y="0">', '<section hidden data-y="0">', '<p style="visibility: hidden" data-y="0">')) + prose(1, 4),
        "share": lambda: box(["share", "social", "sharing", "follow", "share-buttons", "author-bio", "byline", "meta", "post-meta", "print", "tools", "skip", "screen-reader", "caption-credit"], rng.choice((" ".join(link() for _ in range(rng.randint(1, 4))), " ".join(words(1, 3)) + " " + link(), " ".join(words(1, 4)), sentence(2, 7)))),
    }

    ends = {"<p": "</p>", "<d": "</div>", "<s": "</section>"}
    unseen = side["unseen"]
    side["unseen"] = lambda: (x := unseen()) + ends[x[:2]]

    def some(kinds: list[str], most: int) -> str:
        return "".join(side[k]() for k in rng.sample(kinds, rng.randint(0, min(most, len(kinds)))))

    def paragraph() -> str:
        r = rng.random()
        if r < 0.62:
            text = prose(1, 7) if rng.random() < 0.75 else " ".join(words(1, rng.choice((4, 12, 80, 300))))
            if rng.random() < 0.25:
                text = text.replace(" ", f" {link()} ", 1)
            return tag("p", text)
        if r < 0.72:
            return f"<p><b>{prose(1, 2)}<br><p>{prose(1, 5)}</p>"
        if r < 0.78:
            return tag(rng.choice(("h2", "h3", "h4")), " ".join(words(1, 8)).capitalize())
        if r < 0.84:
            return tag(rng.choice(("ul", "ol")), "".join(tag("li", sentence(2, 12) if rng.random() < 0.7 else " ".join(words(1, 4))) for _ in range(rng.randint(2, 6))))
        if r < 0.88:
            return tag("blockquote", tag("p", prose(1, 3)))
        if r < 0.92:
            return tag("div", prose(1, 5))
        if r < 0.95:
            return tag("pre", " ".join(words(3, 20)))
        if r < 0.975:
            return tag("table", "".join(tag("tr", tag("td", " ".join(words(1, 3))) * 2) for _ in range(rng.randint(1, 4))))
        return tag("figure", '<img src="x">' + tag("figcaption", sentence()))

    parts = [paragraph() for _ in range(rng.randint(1, 12))]
    for _ in range(rng.randint(0, 3) if rng.random() < 0.6 else 0):
        parts.insert(rng.randint(0, len(parts)), side[rng.choice(("advert", "advert", "notice", "share", "sidebar", "form", "form", "menu", "comments", "unseen", "unseen", "unseen", "unseen"))]())
    inside = (tag("h1", " ".join(words(2, 10)).capitalize()) if rng.random() < 0.8 else "") + (tag("p", prose(1, 2)) if rng.random() < 0.3 else "") + "".join(parts)
    good = ["article", "content", "main", "main-content", "post", "entry", "entry-content", "story", "story-body", "article-body", "body", "text", "page-content", "post-content", "prose", ""]
    if rng.random() < 0.16:  # a fragment that is an article alone, in all its parts
        bare = "".join(re.sub(r"<(?:form|aside|nav|ins|dialog)\b.*", "", x) for x in parts if "data-y" not in x)
        kind = rng.random()
        if kind < 0.2 or not bare:
            return rng.choice(("", "\n")) + rng.choice((prose(1, 9), " ".join(words(1, 60)), f"{prose(1, 3)}<br><br>{prose(1, 4)}"))
        if rng.random() < 0.5:
            bare = tag(rng.choice(("h1", "h2", "h3")), " ".join(words(1, 8)).capitalize()) + bare
        return bare if kind < 0.45 else tag(rng.choice(("div", "div", "section", "article", "main")), bare, rng.choice(("", "", "", "text", "content")))
    title = tag("h1", " ".join(words(2, 10)).capitalize())
    if rng.random() < 0.15:  # an article's own header: its headline belongs to it
        inside = tag("header", title + rng.choice(("", side["share"](), tag("p", sentence(4, 14)))), rng.choice(("", "", "entry-header", "post-header")), 1) + "".join(parts)
    elif rng.random() < 0.15:  # headline and text in boxes of their own
        inside = tag("div", title + rng.choice(("", side["share"]())), named(["title", "headline", "lead", "intro"]), 1) + tag("div", "".join(parts), named(good), 1)
    if rng.random() < 0.1:
        inside += tag("footer", side["share"]() if rng.random() < 0.5 else sentence(2, 7), rng.choice(("", "entry-footer", "post-footer")), 0)
    style = rng.random()
    if style < 0.45:
        inside = tag("article", inside, rng.choice(good) if rng.random() < 0.4 else "", 1)
        if rng.random() < 0.4:
            inside = tag("main", inside + some(["comments", "share", "sidebar"], 1), "", 1)
    elif style < 0.65:
        inside = tag("main", inside, rng.choice(good) if rng.random() < 0.4 else "", 1)
    elif style < 0.72:
        inside = tag("section", inside, rng.choice(good[:-1]), 1)
    elif style < 0.85:
        inside = re.sub(r"<(p|h1|h2|h3|h4|ul|ol|blockquote|pre|table|figure)>", r'<\1 data-y="1">', inside)
    else:
        inside = tag("div", tag("div", inside, named(good)) if rng.random() < 0.4 else inside, named(good) if rng.random() < 0.7 else rng.choice(good), 1, rng.choice(("class", "id")))
    near = side["sidebar"]() if rng.random() < 0.3 else ""
    inside = wrapped(wrapped(inside, 0, 2) + near, 0, 3) if rng.random() < 0.5 else inside + near
    body = some(["header", "menu", "notice", "advert", "form", "menu", "cells", "unseen"], 4) + inside + some(["sidebar", "comments", "form", "advert", "share", "notice", "unseen"], 4) + some(["footer", "notice", "rights"], 2)
    if rng.random() < 0.4:
        body = wrapped(body, 1, 2)
    if rng.random() < 0.08:
        return f'<div data-y="0">{body}</div>' if rng.random() < 0.5 else inside
    page = f'<!DOCTYPE html><html><head><title>{sentence()}</title><script>var a="</p>";</script></head><body data-y="0">{body}</body></html>'
    return page if rng.random() < 0.9 else page[: int(len(page) * rng.uniform(0.6, 1.0))]


def layouts(n: int = TRAINING_PAGES, seed: int = SEED) -> list[str]:
    """Labelled pages: html whose elements carry data-y."""
    rng = random.Random(seed)
    return [_layout(rng) for _ in range(n)]


@lru_cache(maxsize=4)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Model:
    """The model of layouts(pages, seed), fitted once for a driver."""
    return train(layouts(pages, seed))


def train(pages: list[str] | None = None) -> Model:
    model, data, met = Model(), [], Counter()
    for page in pages or layouts():
        nodes = parse(page)
        _label(nodes)
        data.append((nodes, features(nodes)))
        met.update(f for fs in data[-1][1] for f in fs if f.startswith("name:"))
    data = [(nodes, [[f for f in fs if not f.startswith("name:") or met[f] >= KNOWN_NODES] for fs in feats]) for nodes, feats in data]
    for epoch in range(EPOCHS):
        for nodes, feats in data:
            model.learn(nodes, feats, RATE / (1 + epoch / 3))
    model.weights = {k: v for k, v in model.weights.items() if abs(v) > 1e-3}
    return model


def extract(model: Model, html: str | None) -> list[tuple[str, float]]:
    """The blocks of the article in page order, with their marginals."""
    nodes = parse(html)
    odds, _, _ = model.marginals(nodes, features(nodes))
    return [(n.text, 1 / (1 + math.exp(-min(40.0, max(-40.0, x))))) for n, x in zip(nodes, odds, strict=True) if n.tag == "#text" and x > 0]


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n\n".join(t for t, _ in extract(model, h)) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(lean(run), f"page_id {kind}, url string, text string, n_chars long")
