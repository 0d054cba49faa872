"""HTML extraction: a minimum cut separates content from boilerplate.

A page is read into blocks of text. A logistic classifier gives each block two costs, those of calling it boilerplate and
of calling it content; they are the capacities to the source and from it to the sink. Smoothness edges join a block with
its neighbour, the stronger the nearer both are in the DOM, and with the last block of the same parent; edges across the
bounds of a named region are weaker. The source side of the minimum cut is the main text.

A block's features are the parts that the elements around it name (by element, class, id or role), those that only its
own paragraph names, which say little of a region and weigh less, and its shape: length, links, sentence, tag. Weights of
names are a prior. Those of shape are learned on at most SAMPLE pages (smallest hash of page_id) of together at most
SAMPLE_BYTES bytes, from blocks inside elements that HTML gives a meaning (nav, footer, aside, form and the like against
article and main): no class, id or role labels an example, and names are masked while shape is learned.

Defined results: null or empty html gives an empty text; very long and very deep pages are read whole, in time and memory
linear in their length; markup that is cut off or badly nested is read as far as it goes; a head without end tags ends at
its first other content; of a skipped element without an end tag only the tag is skipped, but raw text (script, style,
iframe, textarea) reaches to the body or the page's end, as in HTML; a block that costs the same either way is boilerplate;
rows that repeat a page_id, or have none, get one row each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import common

SAMPLE, SAMPLE_BYTES = 300, 16 << 20
#: Strength of the edges between neighbours, halved by each step between them in the DOM, and between blocks of one parent; what is left of it
#: where one of both is in a named region that the other isn't in.
ADJACENT, SIBLING, ACROSS = 6.0, 0.25, 0.25

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# HTML's elements by their kind, and words that name a part of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("script style template svg math iframe object canvas noscript select textarea datalist title video audio map".split())
#: Those that hold raw text: without an end tag they reach to the end of the page.
RAW = frozenset("script style iframe textarea".split())
#: Where a title or raw text of the head ends at the latest, and the options of a list without an end tag.
BODY = re.compile(r"</head\b|<body\b", re.I)
OPTIONS = re.compile(r"(?:\s*+<(?:option|optgroup)\b[^>]*>[^<]*+(?:</(?:option|optgroup)\s*>)*+)*+", re.I)
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table div article section main aside nav header footer form body html blockquote td th figure".split())
PARTS = {
    "article": "article story post entry",
    "main": "main content body text prose",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager toc skip tabs toolbar",
    "header": "header masthead topbar banner hero branding",
    "footer": "footer contentinfo colophon copyright legal imprint",
    "aside": "aside sidebar sidebars side rail widget widgets complementary related recommended recommendations trending popular more",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion adsense",
    "notice": "notice notices cookie cookies consent gdpr alert alerts popup modal dialog overlay toast paywall newsletter subscribe subscription signup banner",
    "form": "form search login signin register button input",
    "comment": "comment comments commentary reply replies respond discussion disqus feedback",
    "share": "share sharing social follow like likes byline author tags meta",
    "hidden": "hidden",
}
ELEMENTS = {"article": "article", "main": "main", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "fieldset": "form", "dialog": "notice", "details": "share"}
FLAG = {name: 1 << i for i, name in enumerate(PARTS)}
NAMED = {}
for _part, _words in PARTS.items():
    for _word in _words.split():
        NAMED[_word] = NAMED.get(_word, 0) | FLAG[_part]
GOOD = FLAG["article"] | FLAG["main"]
BAD = (1 << len(PARTS)) - 1 & ~GOOD
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements of text rather than of regions. A name on one of them is a weaker sign, but for what such a name is seldom used for else.
PARAGRAPHS = frozenset("p blockquote pre dt dd figcaption".split()) | HEADINGS | INLINE
WEAKER = {"ad": 0.8, "notice": 0.8, "form": 0.8, "share": 0.6, "hidden": 1.0}
#: Prior weights: of the parts, then of shape. Fitting moves those of shape.
PRIOR = {"article": 4.0, "main": 4.0, "nav": -5.0, "header": -4.0, "footer": -6.0, "aside": -6.0, "ad": -7.0, "notice": -7.0, "form": -6.0, "comment": -9.0, "share": -5.0, "hidden": -7.0}
SHAPE = {"bias": 0.0, "length": 0.5, "links": -4.0, "sentence": 0.5, "p": 1.0, "heading": 1.0, "li": -0.3}
N = len(PARTS)
FEATURES = (*PRIOR, *("own " + part for part in PRIOR), *SHAPE)


def own_flags(tag: str, attributes: str) -> int:
    flags = FLAG.get(ELEMENTS.get(tag, ""), 0)
    if attributes:
        for name, value in ATTR.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                flags |= FLAG["hidden"]
            elif name in ("class", "id", "role"):
                for word in WORD.findall(value):
                    flags |= NAMED.get(word.lower(), 0)
    if tag in ("body", "html"):  # names of the whole page tell no part of it
        return 0
    return flags & ~GOOD if flags & BAD and tag not in ("article", "main") else flags


class Block:
    """text; characters of it in links; parts that regions around it name, and that its paragraph names; what the elements around it mean; tag; place in the DOM."""

    __slots__ = ("text", "linked", "flags", "own", "meaning", "tag", "node")

    def __init__(self, text, linked, flags, own, meaning, tag, node):
        self.text, self.linked, self.flags, self.own, self.meaning, self.tag, self.node = text, linked, flags, own, meaning, tag, node


class Dom:
    """Parent and depth of each element that is not inline."""

    def __init__(self):
        self.parent, self.depth = [0], [0]

    def add(self, parent: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1

    def steps(self, a: int, b: int, most: int = 16) -> int:
        """Edges between two elements, or most."""
        n = 0
        while a != b and n < most:
            if self.depth[a] >= self.depth[b]:
                a = self.parent[a]
            else:
                b = self.parent[b]
            n += 1
        return n


def blocks(page: str, dom: Dom | None = None) -> list[Block]:
    dom = dom or Dom()
    out: list[Block] = []
    # tag, flags of regions and of paragraphs here and above, meaning, within a link, nearest element that is not inline and its tag
    stack = [("", 0, 0, 0, False, 0, "")]
    opened: dict[str, int] = {}  # how many of a tag are on the stack
    buffer: list[str] = []
    linked = place = 0
    end = len(page)
    unclosed: set[str] = set()  # skipped elements without an end tag in the rest of the page

    def flush():
        nonlocal buffer, linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top[1], top[2], top[3], top[6], top[5]))
            buffer, linked = [], 0

    def add(raw: str):
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        buffer.append(text)
        if stack[-1][4]:
            linked += len(text)

    def pop(at: int):
        for s in stack[at:]:
            opened[s[0]] -= 1
        del stack[at:]

    while place < end:
        m = TAG.search(page, place)
        if m is None:
            add(page[place:])
            break
        if m.start() > place:
            add(page[place : m.start()])
        place = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:  # an end tag
            if opened.get(tag):
                at = next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag)
                if tag not in INLINE or stack[at][1:4] != stack[at - 1][1:4]:
                    flush()
                pop(at)
            continue
        if tag == "head":  # its end tag is optional: what it may hold is skipped by itself, anything else is of the body
            flush()
            continue
        if tag in SKIPPED:
            inline = tag in ("svg", "math", "select")
            if not inline:
                flush()
            if not m[3].rstrip().endswith("/"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>" + (r"|</head\b|<body\b" if tag == "title" else ""), re.I).search(page, place)
                if close is not None:
                    place = close.end() if close[0].endswith(">") else close.start()
                    continue
                unclosed.add(tag)
                if tag == "title":
                    at = page.find("<", place)
                    place = end if at < 0 else at
                elif tag in RAW:
                    body = BODY.search(page, place)
                    place = end if body is None else body.start()
                elif tag in ("select", "datalist"):
                    place = OPTIONS.match(page, place).end()
            continue
        if tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag not in INLINE:
                flush()
            continue
        flags = own_flags(tag, m[3])
        if tag not in INLINE or flags & BAD:
            flush()
        if tag not in INLINE:
            closes = CLOSED_BY.get(tag, frozenset()) | ({"p"} if tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option") else frozenset())
            if any(opened.get(c) for c in closes):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        pop(k)
                        break
                    if stack[k][0] in SCOPE:
                        break
        top, text = stack[-1], tag in PARAGRAPHS
        near = (top[5], top[6]) if tag in INLINE else (dom.add(top[5]), tag)
        meaning = top[3] | FLAG.get(ELEMENTS.get(tag, ""), 0)
        around = top[1] & ~GOOD if flags & BAD and not text else top[1]  # a named part of an article isn't the article's text
        stack.append((tag, around | (0 if text else flags), top[2] | (flags if text else 0), meaning, top[4] or tag == "a", *near))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(FEATURES)))
    for row, b in zip(x, found, strict=True):
        for i in range(N) if b.flags or b.own else ():
            row[i], row[N + i] = b.flags >> i & 1, (b.own & ~b.flags) >> i & 1
        n = len(b.text)
        row[2 * N :] = (1, min(np.log1p(n), 6) - 3, min(1, b.linked / n), b.text[-1] in ".!?…:\"'”", b.tag == "p", b.tag in HEADINGS, b.tag == "li")
    return x


def prior() -> np.ndarray:
    return np.array([*PRIOR.values(), *(w * WEAKER.get(part, 0.3) for part, w in PRIOR.items()), *SHAPE.values()])


def fit(pages: list[str], turns: int = 200, rate: float = 0.3, hold: float = 0.02) -> np.ndarray:
    """Weights by gradient descent on shape from the prior, which holds them by a penalty."""
    w = prior()
    known = [b for p in pages for b in blocks(p) if b.meaning]
    if not known:
        return w
    x, y = features(known)[:, 2 * N :], np.array([not b.meaning & BAD for b in known], float)
    start, hold = w[2 * N :].copy(), hold + 5 / len(known)  # few examples move little
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w[2 * N :], -30, 30)))
        w[2 * N :] -= rate * (x.T @ (p - y) / len(y) + hold * (w[2 * N :] - start))
    return w


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks stay with the source. scores: cost of calling it boilerplate less that of calling it content."""
    n = len(scores)
    if n == 0 or min(scores) > 0 or max(scores) <= 0:
        return [s > 0 for s in scores]
    source, sink = n, n + 1
    to, room, links = [], [], [[] for _ in range(n + 2)]

    def edge(a, b, there, back):
        links[a].append(len(to))
        to.append(b)
        room.append(there)
        links[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        edge(source, i, s, 0.0) if s > 0 else edge(i, sink, -s, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in links[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        at = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:  # one blocking flow, by depth first
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[a] < len(links[a]):
                e = links[a][at[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                at[a] += 1
            if at[a] < len(links[a]):
                path.append(links[a][at[a]])
                a = to[path[-1]]
            elif path:
                level[a] = -1
                a = to[path.pop() ^ 1]
            else:
                break


def labelled(page: str, weights: np.ndarray) -> tuple[list[Block], list[float], list[bool]]:
    """The page's blocks, their scores, and which of them the cut calls content."""
    dom = Dom()
    found = blocks(page, dom)
    scores = (features(found) @ weights).tolist()
    edges, last = [], {}
    joined = lambda a, b, strength: edges.append((a, b, strength if found[a].flags == found[b].flags else ACROSS * strength))
    for i, b in enumerate(found):
        if i:
            joined(i - 1, i, ADJACENT / 2.0 ** dom.steps(found[i - 1].node, b.node))
        parent = dom.parent[b.node]
        if last.get(parent, i) < i - 1:
            joined(last[parent], i, SIBLING)
        last[parent] = i
    return found, scores, cut(scores, edges)


def main_text(page: str, weights: np.ndarray) -> str:
    found, _, content = labelled(page, weights)
    return " ".join(b.text for b, stays in zip(found, content, strict=True) if stays)


def extract(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text, n_chars."""
    common.small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    chosen = common.written(common.smallest(own.where("html is not null"), sample, "page_id", "html"), "pages-sample")
    chosen = common.within(chosen, F.octet_length("html"), SAMPLE_BYTES, "page_id", "html").orderBy("page_id", "html").select("html").collect()
    weights = fit([r.html for r in chosen])
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, weights) for p in common.words_of(b.column(2))]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference may name half a pair
            yield common.batch(schema, b.column(0).to_pylist(), b.column(1).to_pylist(), texts, [len(t) for t in texts])

    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
