"""Main text of web pages: gradient-boosted trees score the nodes of the DOM, a tree decoding picks them.

1. A page is parsed leniently: unknown and unclosed tags, stray end tags and pages that break off are usual. It is
   read once, forwards, so that hostile markup takes time in proportion to its length too.
2. Each element has features: tag class and those around it, learned weights of its hashed attribute tokens, depth, place among its siblings, and the length,
   link density, paragraph count and punctuation of its subtree, absolute and relative to its parent.
3. Boosted trees, trained here with a fixed seed on ``PAGES`` generated pages of many layouts whose parts are
   known, give each element the chance to be main text.
4. Decoding maximises the labels' likelihood over the whole tree under one rule: below an element that is
   main text all is main text, below one that is not, nothing is; only a mixed element leaves it to its children.
5. Text is joined by block. Scripts, styles, comments and the like never count as text.

Edge cases: null, empty and textless pages give an empty text; markup that breaks off is dropped from the
last "<" that opens a tag; only void elements close themselves; repeated rows give repeated rows; null ids and urls are kept; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm._text import blocks

BLOCK_BYTES = 2 << 20
#: Documented bound of the training sample.
PAGES, SEED = 1600, 7
TREES, DEPTH, RATE, BINS, HASHES = 80, 4, 0.25, 16, 4096
#: Attributes whose words are looked at.
NAMED = frozenset(("class", "id", "role", "itemprop", "aria-label"))

#: Elements by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template iframe head title select option textarea button".split())
#: Within these a slash closes an element, and nothing parts blocks.
FOREIGN = ("svg", "math")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: These stand within lines too, and hold or replace something there.
PHRASE = INLINE | frozenset("audio canvas img map math noscript object picture source svg track video wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What may stand in a head; anything else ends it.
HEAD = frozenset("base link meta noscript script style template title".split())
SCOPES = frozenset("ul ol dl table body html article section div main".split())
TAGS = ("a", "article", "aside", "blockquote", "div", "footer", "form", "header", "h", "li", "main", "nav", "p", "pre", "section", "table", "ul", "b")
#: Elements that say something of all that is in them.
ROOMS = ("article", "aside", "footer", "form", "header", "main", "nav")

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9:-]*")
_STOP = re.compile(r"[>\"']")
_UNQUOTED = re.compile(r"=\s*[^\s\"'>=]+/\Z")
_VALUE = re.compile(r"=\s*\Z")
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "iframe")}


class _Scanner:
    """Reads a page once, forwards: tags and the text between them."""

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self.gone: set[str] = set()  # quotes that don't occur any more

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, tag, rest): ("text", "", the text), ("open", tag, attributes), ("close", tag, "")."""
        source, text = self.source, 0
        look = 0
        while (low := source.find("<", look)) >= 0:
            mark = source[low + 1 : low + 2]
            found = _NAME.match(source, low + 1 + (mark == "/"))
            if mark in ("!", "?"):
                comment = source.startswith("<!--", low)
                end = source.find("-->" if comment else ">", low + (4 if comment else 2))
                self.at = len(source) if end < 0 else end + (3 if comment else 1)
                token = None
            elif found and mark == "/":
                end = source.find(">", found.end())
                self.at = len(source) if end < 0 else end + 1
                token = ("close", found.group().lower(), "")
            elif found:
                end = self._end(found.end())
                self.at = len(source) if end < 0 else end + 1
                token = ("open", found.group().lower(), source[found.end() : end]) if end >= 0 else None
            elif mark:
                look = low + 1  # a bare "<" is text
                continue
            else:
                self.at, token = len(source), None
            if low > text:
                yield "text", "", source[text:low]
            if token:
                yield token  # whoever reads may skip
            look = text = self.at
        if text < len(source):
            yield "text", "", source[text:]

    def skip(self, to: int) -> None:
        self.at = to

    def _end(self, at: int) -> int:
        """The ">" that ends the tag, -1 if none does; a quote counts after "=" and if it is closed."""
        while found := _STOP.search(self.source, at):
            quote, at = found.group(), found.end()
            if quote == ">":
                return found.start()
            if quote not in self.gone and _VALUE.search(self.source, max(0, found.start() - 8), found.start()):
                closing = self.source.find(quote, at)
                if closing < 0:
                    self.gone.add(quote)
                else:
                    at = closing + 1
        return -1


class Page:
    """Elements in page order: tag, parent, attributes; and pieces of text with their element."""

    def __init__(self, source: str):
        self.tags, self.parents, self.attributes = ["#"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        stack, block, silent = [0], 0, 0
        where: dict[str, list[int]] = {}  # for each tag the places of its open elements in the stack
        scopes = [0]

        def cut(i: int) -> None:
            """Ends the open elements from the i-th on."""
            nonlocal silent
            while len(stack) > i:
                tag = self.tags[stack.pop()]
                where[tag].pop()
                silent -= tag in SILENT
                if tag in SCOPES:
                    scopes.pop()

        scanner = _Scanner(source)
        for kind, tag, rest in scanner:
            if kind == "text":
                if self.tags[stack[-1]] == "head" and not rest.isspace():
                    cut(len(stack) - 1)
                if not silent:
                    self.pieces.append((stack[-1], block, rest))
            elif kind == "close":
                foreign = any(where.get(t) for t in FOREIGN)
                if where.get(tag):
                    cut(where[tag][-1])
                block += tag not in PHRASE and not foreign
            else:
                if self.tags[stack[-1]] == "head" and tag not in HEAD:
                    cut(len(stack) - 1)
                elif tag == "body" and where.get("head"):
                    cut(where["head"][-1])
                if tag == "br":
                    if not silent:
                        self.pieces.append((stack[-1], block, " "))
                    continue
                if tag in CLOSES_P or tag in SAME:
                    last = max((where[t][-1] for t in SAME.get(tag, ("p",)) if where.get(t)), default=0)
                    if last > scopes[-1]:
                        cut(last)
                foreign = any(where.get(t) for t in FOREIGN)
                block += tag not in PHRASE and not foreign
                if tag in VOID or ((foreign or tag in FOREIGN) and rest.endswith("/") and not _UNQUOTED.search(rest)):
                    continue
                where.setdefault(tag, []).append(len(stack))
                if tag in SCOPES:
                    scopes.append(len(stack))
                stack.append(len(self.tags))
                self.tags.append(tag)
                self.parents.append(stack[-2])
                self.attributes.append(rest)
                silent += tag in SILENT
                if tag in _RAW:
                    end = _RAW[tag].search(source, scanner.at)
                    scanner.skip(end.start() if end else len(source))

    def text(self, chosen: list[bool]) -> str:
        out: dict[int, list[str]] = {}
        for node, block, piece in self.pieces:
            if chosen[node]:
                out.setdefault(block, []).append(piece)
        found = (" ".join(html.unescape("".join(x)).split()) for x in out.values())
        return "\n\n".join(x for x in found if x)


def tokens(attributes: str) -> list[int]:
    """The words of class, id, role, itemprop and aria-label values, hashed; camel case and signs part words."""
    if "=" not in attributes:
        return []
    found = ["".join(v) for name, *v in _ATTRIBUTE.findall(attributes) if name.lower() in NAMED]
    words = (w for x in found for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))
    return [zlib.crc32(w.encode()) % HASHES for w in words if w]


def token_weights(pages: list[Page], labels: list[list[int]]) -> np.ndarray:
    """For each hashed attribute word how much more often it stands on main text than on the rest: smoothed log odds."""
    yes, no = np.zeros(HASHES), np.zeros(HASHES)
    for page, label in zip(pages, labels, strict=True):
        for a, y in zip(page.attributes, label, strict=True):
            if y >= 0:
                np.add.at(yes if y else no, tokens(a), 1)
    seen = yes + no > 0
    odds = np.log((yes + 0.5) / (yes.sum() + 1)) - np.log((no + 0.5) / (no.sum() + 1))
    return np.where(seen, odds, 0.0)


def features(page: Page, weights: np.ndarray) -> np.ndarray:
    """A row of numbers for each element; weights: of attribute words."""
    n = len(page.tags)
    length, links, stops, own = ([0.0] * n for _ in range(4))
    paragraphs, elements, children, depth = [0.0] * n, [1.0] * n, [0] * n, [0] * n
    begins = [0.0] * n
    ran = 0.0
    started = [False] * n
    for node, _, piece in page.pieces:
        k = float(len(piece.strip()))
        own[node] += k
        length[node] += k
        stops[node] += piece.count(".") + piece.count(",")
        x = node
        while x >= 0 and not started[x]:
            started[x], begins[x] = True, ran
            x = page.parents[x]
        ran += k
    place = [0] * n
    for i in range(1, n):
        p = page.parents[i]
        place[i], depth[i] = children[p], depth[p] + 1
        children[p] += 1
    for i in range(n - 1, 0, -1):
        p, tag = page.parents[i], page.tags[i]
        if tag == "a":
            links[i] = length[i]
        paragraphs[i] += tag == "p"
        for x in (length, links, stops, paragraphs, elements):
            x[p] += x[i]
    out = np.zeros((n, 20 + 2 * len(TAGS) + 4 + len(ROOMS)), np.float32)
    at = {t: k for k, t in enumerate(TAGS)}
    words: list[tuple[float, float]] = []  # the least and the greatest weight of the element's own words
    for i in range(n):
        own_words = weights[tokens(page.attributes[i])]
        words.append((min(0.0, own_words.min()), max(0.0, own_words.max())) if len(own_words) else (0.0, 0.0))
        p = max(page.parents[i], 0)
        total = max(length[0], 1.0)
        size = length[i]
        out[i, :20] = (
            depth[i], place[i], children[p], place[i] / max(children[p], 1), math.log1p(size), links[i] / max(size, 1.0), paragraphs[i], stops[i] / max(size, 1.0) * 100, elements[i],
            size / elements[i], size / total, size / max(length[p], 1.0), own[i] / max(size, 1.0), begins[i] / total, children[i], paragraphs[p], links[p] / max(length[p], 1.0), math.log1p(length[p]), math.log1p(length[0]), paragraphs[i] / max(paragraphs[0], 1.0),
        )
        for base, x in ((20, i), (20 + len(TAGS), p)):
            tag = page.tags[x]
            k = at.get("h" if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() else tag)
            if k is not None:
                out[i, base + k] = 1.0
    last = 20 + 2 * len(TAGS)
    above: list[tuple[float, float]] = []  # the same over the element and all that it stands in
    for i in range(n):
        p = page.parents[i]
        near = above[p] if p >= 0 else (0.0, 0.0)
        above.append((min(near[0], words[i][0]), max(near[1], words[i][1])))
        out[i, last : last + 4] = (*words[i], *near)
        if i:
            out[i, last + 4 :] = out[p, last + 4 :]
        if page.tags[i] in ROOMS:
            out[i, last + 4 + ROOMS.index(page.tags[i])] = 1.0
    return out


def boosted(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees by Newton steps on the logistic loss, over quantile bins: arrays of feature, threshold and leaf value."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    start = math.log(y.mean() / (1 - y.mean()))
    score, inner, width = np.full(len(y), start), (1 << DEPTH) - 1, x.shape[1]
    cells = binned + np.arange(width) * BINS  # each feature's bins one after another
    open_bins = np.arange(BINS - 1) < np.array([len(e) for e in edges])[:, None]
    feature, threshold, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf, np.float32), np.zeros((TREES, 1 << DEPTH))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for depth in range(DEPTH):
            first = (1 << depth) - 1
            for leaf in range(first, 2 * first + 1):
                inside = np.flatnonzero(node == leaf)
                best = (1e-6, 0, np.inf, BINS)
                if len(inside) > 20:
                    at = cells[inside].ravel()
                    gs, hs = (np.cumsum(np.bincount(at, np.repeat(w[inside], width), width * BINS).reshape(width, BINS), 1)[:, :-1] for w in (g, h))
                    all_g, all_h = g[inside].sum(), h[inside].sum()
                    gain = np.where(open_bins, gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1), -np.inf)
                    f, k = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, k] > best[0]:
                        best = (gain[f, k], int(f), edges[f][k], int(k))
                feature[t, leaf], threshold[t, leaf] = best[1], best[2]
                node[inside] = 2 * leaf + 1 + (binned[inside, best[1]] > best[3])
        for leaf in range(1 << DEPTH):
            inside = node == inner + leaf
            value[t, leaf] = RATE * g[inside].sum() / (h[inside].sum() + 1)
        score += value[t, node - inner]
    return {"start": start, "feature": feature, "threshold": threshold, "value": value}


def chances(model: dict, x: np.ndarray) -> np.ndarray:
    score, rows, inner = np.full(len(x), model["start"]), np.arange(len(x)), (1 << DEPTH) - 1
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        score += value[node - inner]
    return 1 / (1 + np.exp(-score))


def decoded(page: Page, p: np.ndarray) -> list[bool]:
    """Whether each element's own text is main text; see the module's head for the rule."""
    n = len(page.tags)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    filled = [False] * n
    for node, _, piece in page.pieces:
        filled[node] = filled[node] or not piece.isspace()
    for i in range(n - 1, 0, -1):
        filled[page.parents[i]] = filled[page.parents[i]] or filled[i]
    yes, no = (np.where(filled, np.log(x), 0.0) for x in (p, 1 - p))
    inside, outside, open_ = yes.tolist(), no.tolist(), [math.log(0.5) if f else 0.0 for f in filled]
    inside[0] = -math.inf  # the page itself is mixed or empty
    for i in range(n - 1, 0, -1):
        up = page.parents[i]
        if page.tags[i] in ("html", "body"):
            inside[i] = -math.inf
        inside[up] += inside[i]
        outside[up] += outside[i]
        open_[up] += max(inside[i], outside[i], open_[i])
    state = [""] * n
    for i in range(n):
        above = state[page.parents[i]] if i else "open"
        if above != "open":
            state[i] = above
        else:
            state[i] = max((inside[i], 2, "in"), (outside[i], 1, "out"), (open_[i], 0, "open"))[2]
    return [s == "in" or s == "open" and i > 0 and page.tags[i] not in ("html", "body") and bool(p[i] >= 0.5) for i, s in enumerate(state)]


def generated(rng: random.Random) -> str:
    """A page whose parts are marked data-y="1" (main text) or "0"."""
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "le", "de", "es", "in", "ti", "a", "o")) for _ in range(rng.randint(1, 4)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    prose = lambda: " ".join(line(3, 25) for _ in range(rng.randint(1, 6)))
    pick = rng.choice
    items = lambda k: "".join(f'<li><a href="/{word()}">{word()}{pick(("", "", ",", "."))}</a></li>' for _ in range(k))
    noise = ("box", "col", "container", "inner", "js", "left", "module", "row", "section", "top", "wrap", "wrapper")

    def called(words: tuple[str, ...]) -> str:
        """A name in one of the ways that sites write them."""
        w = pick(words)
        if rng.random() < 0.5:
            other = pick(noise)
            w = pick((f"{w}-{other}", f"{other} {w}", f"{other}_{w}", f"{w}{other.capitalize()}", f"{w}-{rng.randint(1, 9)}"))
        return w

    name = lambda tags, words: (lambda t, w: f"<{t}{pick((' class', ' id', ' role'))}=\"{w}\" data-y=\"0\">|</{t}>")(pick(tags), called(words))

    def waste() -> str:
        kind = rng.randint(0, 9)
        if kind == 0:
            return f"<nav data-y=\"0\"><ul>{items(rng.randint(2, 9))}</ul></nav>"
        if kind == 1:
            return f"<footer data-y=\"0\">{pick(('&copy; ' + word() + ' &middot; ', ''))}{line(2, 14)}</footer>"
        if kind == 2:
            return f"<aside data-y=\"0\">{pick((f'<p>{prose()}</p>', f'<ul>{items(4)}</ul>', line(3, 9)))}</aside>"
        if kind == 3:
            return name(("div", "section", "p"), ("ad", "ads", "advert", "advertisement", "banner", "promo", "promoted", "sponsor", "sponsored")).replace("|", pick((line(1, 20), f"<p>{prose()}</p>", f"<a href='/x'>{line(2, 8)}</a>")))
        if kind == 4:
            return name(("div", "section"), ("cookie", "cookies", "notice", "consent", "legal", "popup", "modal", "newsletter", "signup", "subscribe", "login")).replace("|", pick((line(3, 20), f"<p>{line(4, 30)}</p><button>ok</button>")))
        if kind == 5:
            return f"<form action='/s' data-y=\"0\"><label>{line(1, 4)}</label><input name=q><p>{line(2, 9)}</p></form>"
        if kind == 6:
            return name(("div", "section", "ol"), ("comments", "comment", "reply", "replies", "respond", "disqus", "discussion")).replace("|", "".join(f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>' for _ in range(rng.randint(1, 6))))
        if kind == 7:
            return name(("div", "ul", "section"), ("menu", "nav", "navbar", "navigation", "sidebar", "breadcrumb", "breadcrumbs", "related", "share", "sharing", "social", "tags", "toolbar", "widget", "pager", "pagination")).replace("|", pick((f"<ul>{items(5)}</ul>", f"<h3>{line(1, 4)}</h3><ul>{items(3)}</ul>", f"<p>{line(3, 12)}</p>", line(2, 9))))
        if kind == 8:
            return name(("div", "section"), ("foot", "footer", "copyright", "contentinfo", "header", "masthead")).replace("|", pick((f"<p>{line(2, 12)}</p>", line(2, 9), f"<ul>{items(3)}</ul><p>{line(2, 6)}</p>")))
        return f"<header data-y=\"0\">{pick((line(1, 4), f'<h2>{word()}</h2><ul>{items(3)}</ul>', f'<p>{line(2, 9)}</p>'))}</header>"

    def block() -> str:
        kind = rng.randint(0, 11)
        if kind == 0:
            return f"<h2>{line(1, 7)}</h2>"
        if kind == 1:
            return f"<ul>{''.join(f'<li>{line(2, 14)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
        if kind == 2:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind == 3:
            return f"<p><b>{prose()}<br>"
        if kind == 4:
            return f"<p>{line(2, 9)} <a href='/{word()}'>{line(1, 4)}</a> {prose()}</p>"
        if kind == 5:
            return pick((f"<pre>{line(3, 20)}</pre>", f"<figure><figcaption>{line(3, 9)}</figcaption></figure>", f"<table><tr><td>{word()}</td><td>{line(1, 5)}</td></tr></table>", f"<p>{line(1, 2)}"))
        return f"<p>{pick((prose, lambda: line(1, 30)))()}</p>"

    body = [f"<h1>{line(2, 9)}</h1>" if rng.random() < 0.8 else ""] + [block() for _ in range(rng.randint(1, 12))]
    bare = rng.random() < 0.1  # no element of its own: the article's blocks stand beside the rest
    if bare:
        body = [re.sub(r"<(\w+)", r'<\1 data-y="1"', x, count=1) for x in body]
    inner = "".join(x if not x or rng.random() > 0.06 else f"{x}{waste()}" for x in body)
    main = called(("article", "articleBody", "body", "content", "entry", "main", "post", "prose", "story", "text"))
    opened, closed = pick((("<article>", "</article>"), ("<article>", "</article>"), (f'<article class="{main}">', "</article>"), ("<main>", "</main>"), (f'<div class="{main}">', "</div>"), (f'<div id="{main}">', "</div>"), (f'<section class="{main}">', "</section>"), ("<div>", "</div>"), (f'<div itemprop="{main}">', "</div>"), (f'<main><article class="{main}">', "</article></main>")))
    before, after = ("".join(waste() for _ in range(rng.randint(0, 4))) for _ in range(2))
    held = inner if bare else f"{opened.replace('>', ' data-y=\"1\">', 1)}{inner}{closed}"
    if bare or rng.random() < 0.3:
        after = f"{pick(('<hr>', ''))}<p data-y=\"0\">{' | '.join(f'<a href=/{word()}>{word()}</a>' for _ in range(rng.randint(1, 4)))}</p>{after}" if rng.random() < 0.3 else after
    body_class = pick(("", "", f' class="{pick(("home", "page", "single", "blog", "post-template", "article-page"))} {pick(noise)}"'))
    outer = pick((("", ""), ("", ""), ('<div id="page">', "</div>"), ('<div class="wrapper">', "</div>"), ('<div class="container"><div class="row">', "</div></div>"), ("<div><div>", "</div></div>")))
    page = f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><style>p{{}}</style></head><body{body_class}>{outer[0]}{before}{held}{after}{outer[1]}</body></html>"
    return page if rng.random() < 0.8 else page[: rng.randint(len(page) // 2, len(page))]


def _labels(page: Page) -> tuple[list[int], list[bool]]:
    """1 (main text), 0 or -1 (unmarked) for each element of a marked page, and whether it holds both kinds."""
    label, mixed = [-1] * len(page.tags), [False] * len(page.tags)
    for i in range(1, len(page.tags)):
        mark = re.search(r'data-y="([01])"', page.attributes[i])
        up = page.parents[i]
        label[i] = int(mark[1]) if mark else label[up]
        x = up
        while mark and x > 0 and label[x] >= 0 and label[x] != label[i]:
            mixed[x], x = True, page.parents[x]
    return label, mixed


@functools.lru_cache(maxsize=1)
def trained(pages: int = PAGES, seed: int = SEED) -> dict:
    """The model, from generated pages: attribute words' weights from one half, the trees from the other, whose
    elements are all main text or all not.
    """
    rng, xs, ys = random.Random(seed), [], []
    first = [Page(generated(rng)) for _ in range(pages // 2)]
    weights = token_weights(first, [_labels(page)[0] for page in first])
    for _ in range(pages - pages // 2):
        page = Page(generated(rng))
        label, mixed = _labels(page)
        use = [i for i in range(1, len(page.tags)) if label[i] >= 0 and not mixed[i]]
        xs.append(features(page, weights)[use])
        ys += [label[i] for i in use]
    return boosted(np.concatenate(xs), np.array(ys, float)) | {"weights": weights}


def main_text(sources: list[str | None], model: dict) -> list[str]:
    pages = [Page(x or "") for x in sources]
    rows = [features(p, model["weights"]) for p in pages]
    p = chances(model, np.concatenate(rows)) if rows else np.empty(0)
    ends = np.cumsum([len(x) for x in rows])
    return [page.text(decoded(page, p[b - len(x) : b])) for page, x, b in zip(pages, rows, ends, strict=True)]


def extracted(pages: DataFrame, model: dict | None = None) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "html", BLOCK_BYTES):
            found = main_text(block.column("html").to_pylist(), sent.value)
            yield pa.record_batch([block.column("page_id").cast(pa.int64()), block.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, text string, n_chars long")
