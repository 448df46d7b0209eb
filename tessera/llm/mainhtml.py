"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded down the tree.

A tolerant parser makes the node tree. Each element gets features of its subtree (text and link
density, tags inside), of its place (depth, position among siblings, sibling totals) and of its
tag, class, id and role tokens. Boosted trees give each element the log-odds of being main text.
Decoding is hierarchical: going down from the root, an element's decision is its own log-odds added
to its parent's, discounted; and what is certainly not main text ends the descent, so no descendant
of a rejected element can come back, and no element is kept under a rejected one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import bounded, free_name, slices, texts_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")

# Fixed values of the HTML standard: elements without content, with raw text, and of inline level; what an open element's end tag may be left out before.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe textarea title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements that an unclosed inner element cannot close from within.
SCOPE = frozenset("html body article section main div nav header footer aside ul ol table td th form blockquote".split())
TAGS = "html head body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form button select option a span b strong i em code img br title meta link script style template noscript iframe input label address details summary".split()
TAG_NUMBER = {t: float(i + 1) for i, t in enumerate(TAGS)}
# Stems that templates use in class, id and role for what surrounds an article, and for the article.
AWAY = "nav menu breadcrumb header masthead banner footer foot bottom sidebar side aside widget ad ads advert advertisement adsense sponsor sponsored promo promotion notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup login form search share sharing social related recommended more comment comments reply replies disqus respond discussion pager pagination tags meta copyright legal skip toolbar tool".split()
TOWARDS = "article content main post entry body text story blog page prose markdown".split()
_AWAY, _TOWARDS = frozenset(AWAY), frozenset(TOWARDS)
_KINDS = {w: k for k, ws in enumerate(("nav menu breadcrumb skip pager pagination", "header masthead banner", "footer foot bottom copyright legal", "sidebar side aside widget related recommended more", "ad ads advert advertisement adsense sponsor sponsored promo promotion", "notice cookie consent gdpr alert popup modal overlay newsletter subscribe signup", "form login search", "comment comments reply replies disqus respond discussion", "share sharing social")) for w in ws.split()}


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "tokens", "parts", "chars", "link_chars", "words", "stops", "inner", "links", "blocks", "place", "at")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...] = ()):
        self.tag, self.parent, self.tokens = tag, parent, tokens
        self.children: list[Node] = []
        self.place = len(parent.children) if parent else 0
        self.depth = parent.depth + 1 if parent else 0
        #: Texts and child nodes in page order.
        self.parts: list[str | Node] = []
        self.chars = self.link_chars = self.words = self.stops = self.inner = self.links = self.blocks = self.at = 0


def parse(page: str) -> Node:
    """The node tree of a page, however broken: what is open at the end is closed there, stray end tags are skipped."""
    root = here = Node("#root", None)
    at, n = 0, len(page)
    closers: dict[str, re.Pattern] = {}
    while at < n:
        m = _TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            here.parts.append(page[at:start])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                here.parts.append(entities.escape(m[0][9:].removesuffix("]]>"), False))
            continue
        if m[1] or m[4]:
            node = here
            while node.parent and node.tag != name:
                if node.tag in SCOPE and name not in SCOPE:
                    break
                node = node.parent
            if node.parent and node.tag == name:
                here = node.parent
            continue
        node = here
        while node.parent and node.tag in INLINE and name not in INLINE and name not in VOID and name not in RAW:
            node = node.parent
        if node.tag in CLOSES and name in CLOSES[node.tag]:
            while node.tag in CLOSES and name in CLOSES[node.tag]:
                node = node.parent
            here = node
        attrs = m[3] or m[6] or ""
        tokens: tuple[str, ...] = ()
        if attrs and ("class" in attrs or "id" in attrs or "role" in attrs or "hidden" in attrs or "itemprop" in attrs):
            got = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
            tokens = tuple(_WORDS.findall(" ".join(got.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower())) + (("hidden",) if "hidden" in got else ())
        child = Node(name, here, tokens)
        here.children.append(child)
        here.parts.append(child)
        if name in RAW:
            end = closers.get(name) or closers.setdefault(name, re.compile(rf"</{name}\s*>", re.I))
            stop = end.search(page, at)
            # an unclosed one of a page that was cut holds the rest of the page
            at = stop.end() if stop else n
        elif name not in VOID:
            here = child
    return root


def elements(root: Node) -> list[Node]:
    """All elements in page order, with the sums of their subtrees filled in."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.at = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    for node in reversed(out):
        own = "".join(p for p in node.parts if isinstance(p, str))
        words = own.split()
        node.chars += sum(map(len, words))
        node.words += len(words)
        node.stops += own.count(".") + own.count(",")
        if node.tag == "a":
            node.links += 1
            node.link_chars = node.chars
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.words += node.words
            up.stops += node.stops
            up.links += node.links
            up.inner += node.inner + 1
            up.blocks += node.blocks + (node.tag in ("p", "br"))
    return out


FEATURES = 27
_SUMS = ("depth", "chars", "link_chars", "words", "stops", "inner", "links", "blocks", "place", "at")
_TAGGED: dict[tuple[str, tuple[str, ...]], tuple[float, ...]] = {}


def _tagged(node: Node) -> tuple[float, ...]:
    """Of the tag and its tokens: number, tokens that speak against and for main text, kind of the first, hidden, inline."""
    key = (node.tag, node.tokens)
    got = _TAGGED.get(key)
    if got is None:
        kinds = [_KINDS[t] for t in node.tokens if t in _KINDS]
        got = (TAG_NUMBER.get(node.tag, 0.0), sum(t in _AWAY for t in node.tokens), sum(t in _TOWARDS for t in node.tokens), kinds[0] + 1 if kinds else 0, "hidden" in node.tokens, node.tag in INLINE)
        if len(_TAGGED) > 20_000:
            _TAGGED.clear()
        _TAGGED[key] = got
    return got


def features(pages: list[list[Node]]) -> np.ndarray:
    """One row for each element of the pages, page after page."""
    sizes = np.array([len(nodes) for nodes in pages], np.int64)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    every = [node for nodes in pages for node in nodes]
    v = dict(zip(_SUMS, np.array([[getattr(n, k) for n in every] for k in _SUMS], np.float64), strict=True))
    tag, away, towards, kind, hidden, inline = np.array([_tagged(n) for n in every], np.float64).reshape(-1, 6).T
    up = first + np.array([n.parent.at if n.parent else n.at for n in every], np.int64)
    own = np.arange(len(every))
    children = np.bincount(up[up != own], minlength=len(every))
    siblings = np.where(up == own, 1, children[up])
    most = np.ones(len(every))
    np.maximum.at(most, up, v["chars"])
    order = np.lexsort((v["place"], np.where(up == own, -1, up)))
    before, after, same = np.zeros(len(every)), np.zeros(len(every)), np.ones(len(every))
    for step in (1, 2, 3):
        left, right = order[:-step], order[step:]
        together = (up[left] == up[right]) & (up[left] != left) & (up[right] != right)
        if step == 1:
            before[right] = np.where(together, v["chars"][left], 0)
            after[left] = np.where(together, v["chars"][right], 0)
        alike = together & (tag[left] == tag[right])
        same[left] += alike
        same[right] += alike
    total = np.maximum(1, v["chars"][first])
    low = lambda k: np.maximum(1, v[k])
    return np.stack(
        [
            tag, v["depth"], np.log1p(v["chars"]), v["chars"] / total, v["link_chars"] / low("chars"),
            v["words"] / (1 + v["inner"]), np.log1p(v["inner"]), v["stops"] / low("words"), np.log1p(v["links"]), np.log1p(v["blocks"]),
            children, siblings, v["at"] / np.repeat(sizes, sizes), away, towards,
            kind, hidden, tag[up], away[up], v["chars"] / np.maximum(1, v["chars"][up]),
            v["place"] / siblings, inline, v["chars"] > 0, v["chars"] / most[up], np.log1p(before), np.log1p(after), same,
        ],
        1,
    ).astype(np.float32)


@dataclass
class Trees:
    """Boosted regression trees as arrays: (feature, threshold, left, right, value) for each node; a leaf's feature is -1."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                if (f < 0).all():
                    break
                go = x[rows, np.maximum(f, 0)] <= threshold[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            z += value[at]
        return z


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 64, least: int = 12, l2: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss, with histogram splits."""
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(1) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    z, trees = np.full(len(y), base), []
    for _ in range(rounds if len(y) else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, -rate * gs / (hs + l2)])
            if level == depth or len(rows) < 2 * least:
                return at
            best = (1e-6, -1, 0)
            for j, e in enumerate(edges):
                b = binned[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=len(e) + 1))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] < 0:
                return at
            _, j, k = best
            low = binned[rows, j] <= k
            nodes[at][:2] = [j, float(edges[j][k])]
            nodes[at][2] = grow(rows[low], level + 1)
            nodes[at][3] = grow(rows[~low], level + 1)
            return at

        grow(np.arange(len(y)), 0)
        t = np.array(nodes)
        tree = (t[:, 0].astype(np.int64), t[:, 1], t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), t[:, 4])
        trees.append(tree)
        z += Trees([tree], 0.0).log_odds(x)
    return Trees(trees, base)


# Fixed values of the HTML standard: elements without text to read. What else surrounds an article the trees tell, since any other element may also hold it.
NEVER = RAW | frozenset("head button select input canvas svg object embed audio video".split())
#: Elements that in training pages are no part of the article, wherever they stand.
AROUND = NEVER | frozenset("nav header footer aside form menu dialog".split())


def decode(nodes: list[Node], log_odds: np.ndarray, inherit: float = 0.7) -> list[bool]:
    """Which elements' own texts are main text, decided from the root down.

    An element above the article is open: neither kept nor rejected. One with positive odds that
    holds most of the page's likely text opens a kept subtree; within it an element leaves only when
    its odds outweigh what it inherits, and a rejected element's descendants are all rejected.
    """
    keep = [False] * len(nodes)
    held = np.full(len(nodes), -np.inf)
    dead = [False] * len(nodes)
    for node in nodes:
        up = node.parent
        if up is None or dead[up.at]:
            dead[node.at] = up is not None
            continue
        inside = keep[up.at]
        if node.tag in NEVER:
            dead[node.at] = True
            continue
        own = float(log_odds[node.at])
        if inside:
            held[node.at] = own + inherit * max(0.0, min(6.0, held[up.at]))
            if node.tag in INLINE or held[node.at] > 0:
                keep[node.at] = True
                held[node.at] = max(held[node.at], 0.5)
            else:
                dead[node.at] = True
        elif own > 0 and node.tag not in INLINE:
            keep[node.at], held[node.at] = True, own
    return keep


def blocks(nodes: list[Node], keep: list[bool]) -> list[str]:
    """Kept texts in page order, one for each run that no block boundary divides; references decoded, white space single."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = "".join(run)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append(text)
            run.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        node, k = stack.pop()
        block = node.tag not in INLINE
        if k == 0 and block:
            flush()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if isinstance(part, str):
                if keep[node.at]:
                    run.append(part)
            else:
                stack.append((node, k))
                stack.append((part, 0))
                break
        else:
            if block:
                flush()
    flush()
    return out


def extract(page: str, trees: Trees) -> list[str]:
    """Blocks of a page's main text."""
    if not page.strip():
        return []
    nodes = elements(parse(page))
    return blocks(nodes, decode(nodes, trees.log_odds(features([nodes]))))


def _labels(nodes: list[Node]) -> np.ndarray:
    """1 for elements in an article or main element, out of what such an element holds besides its text."""
    y = np.zeros(len(nodes), np.int8)
    for node in nodes:
        up = node.parent
        if up is None or node.tag in AROUND or any(t in _AWAY for t in node.tokens):
            continue
        y[node.at] = y[up.at] or node.tag in ("article", "main")
    return y


#: Templates that training pages are also shown in: what opens and closes the article, and what surrounds it. {0} is boilerplate of the page.
VARIANTS = (
    ('<article class="post">', "</article>", "", '<section class="comments"><h3>Comments</h3><div class="comment"><p>{0}</p></div><div class="comment"><p>{0}</p></div></section>'),
    ('<div class="content" id="main">', "</div>", '<header class="site-header"><a href="/">{0}</a></header><div class="cookie notice"><p>{0}</p></div>', '<aside class="sidebar"><h4>{0}</h4><ul><li><a href="#">{0}</a></li></ul></aside>'),
    ('<main><div class="entry">', "</div></main>", '<div role="navigation"><ul class="menu"><li><a href="#">{0}</a></li></ul></div>', '<div id="comments"><ol><li class="comment"><p>{0}</p></li></ol></div><div class="site-footer"><p>{0}</p></div>'),
    ('<div class="article-body">', "</div>", '<div class="banner advert">{0}</div>', '<form class="newsletter"><label>{0}</label><input name="q"></form><div class="related"><ul><li><a href="#">{0}</a></li><li><a href="#">{0}</a></li></ul></div>'),
    ('<article class="x">', "</article>", '<div class="zone"><p>{0}</p></div>', '<div id="lower"><p>{0}</p></div><div><p>{0}</p></div>'),
    ('<section class="story">', "</section>", '<div class="alert">{0}</div><div class="breadcrumb"><a href="#">{0}</a></div>', '<div class="promo sponsored"><p>{0}</p></div><div class="share social"><a href="#">{0}</a></div>'),
)

#: What those templates put inside the article before and after its text, and around the whole page, in turn.
INNER = (
    ("", ""),
    ('<header><p>{0}</p></header>', '<footer><p>{0}</p></footer>'),
    ("", '<div class="share"><a href="#">{0}</a></div><div class="comments"><p>{0}</p><p>{0}</p></div>'),
    ('<div class="meta">{0}</div>', '<aside><p>{0}</p></aside>'),
    ('<div class="ad"><p>{0}</p></div>', '<form action="/"><p>{0}</p><input name="q"></form>'),
    ("", '<nav><ul><li><a href="#">{0}</a></li></ul></nav>'),
    ("", ""),
)
WRAPPERS = (("", ""), ('<form id="page">', "</form>"), ('<div class="wrap search">', "</div>"), ('<div class="wrap">', "</div>"), ('<div class="page sidebar notice"><div class="inner more">', "</div></div>"), ("<div>", "</div>"), ("", ""), ('<div id="widget" class="modal form">', "</div>"))


def training_rows(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of pages that mark their article, as they are and in each of ``VARIANTS`` in turn."""
    xs, ys = [np.zeros((0, FEATURES), np.float32)], [np.zeros(0, np.int8)]
    for k, page in enumerate(pages):
        m = re.search(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", page, re.S | re.I)
        shown = [(page, None)]
        if m:
            opens, closes, before, after = VARIANTS[k % len(VARIANTS)]
            words = re.sub(r"<[^>]*>", " ", m[2]).split()
            some = " ".join(words[-(3 + k % 40) :])
            mark = opens.replace(">", " data-main>", 1)
            first, last = INNER[k % len(INNER)]
            # the article's own text in other elements too: other headings, and more of them, lists and quotes
            inner = re.sub(r"<(/?)h1\b", rf"<\1{('h1', 'h2', 'h3')[k % 3]}", m[2])
            inner = inner.replace("</p>", ("</p>", "</p><h2>{0}</h2>", "</p><h3>{0}</h3><ul><li>{0}</li><li>{0}</li></ul>", "</p><blockquote><p>{0}</p></blockquote><div>{0}</div>")[k % 4], 1)
            whole = page[: m.start()] + before + mark + first + inner + last + closes + after + page[m.end() :]
            wrap, unwrap = WRAPPERS[k % len(WRAPPERS)]
            whole = re.sub(r"(<body[^>]*>)", lambda b: b[1] + wrap, whole, count=1) if re.search(r"<body[^>]*>", whole) else wrap + whole
            whole = whole.replace("</body>", unwrap + "</body>", 1)
            shown.append((whole.replace("{0}", some), opens))
        for text, opens in shown:
            nodes = elements(parse(text))
            y = _labels(nodes)
            if opens:
                tag = re.match(r"<(\w+)", opens)[1]
                tokens = tuple(_WORDS.findall(" ".join(re.findall(r'"([^"]*)"', opens.split(">")[0] + ">"))))
                for node in nodes:
                    up = node.parent
                    away = node.tag in AROUND or any(t in _AWAY for t in node.tokens)
                    y[node.at] = up is not None and not away and (bool(y[up.at]) or node.tag == tag and node.tokens[: len(tokens)] == tokens)
            xs.append(features([nodes]))
            ys.append(y)
    return np.concatenate(xs), np.concatenate(ys)


def fit(pages: DataFrame, html: str = "html", id_col: str = "page_id", sample: int = 300) -> Trees:
    """Train on ``sample`` pages, those whose ids hash lowest: the markup's own article elements are the labels.

    Each is shown as it is and in one of a few other templates. A page over 200,000 characters is
    left out of the sample, which bounds what reaches the driver. Without a page the trees are empty
    and nothing is main text.
    """
    rows = (
        pages.where(F.col(html).isNotNull() & (F.length(html) <= 200_000) & F.col(html).rlike("(?i)<(article|main)\\b"))
        .select(F.xxhash64(id_col).alias("h"), F.col(html).alias("page"))
        .orderBy("h", "page")
        .limit(sample)
        .toArrow()
    )
    x, y = training_rows(rows["page"].to_pylist())
    return fit_trees(x, y.astype(np.float64))


def extract_main(df: DataFrame, trees: Trees, html: str = "html", output: str = "main_text", spans: str | None = None) -> DataFrame:
    """Add ``output``: the main text of each whole page, blocks joined by one space; ``spans`` names a column for the list of blocks.

    Null and empty pages give an empty text, broken markup is closed where the page ends. A map
    without a shuffle; other columns pass through, and those named as outputs are replaced.
    """
    outputs = [output] + ([spans] if spans else [])
    kept = [c for c in df.columns if c.lower() not in {o.lower() for o in outputs}]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    fields = [T.StructField(output, T.StringType(), False)] + ([T.StructField(spans, T.ArrayType(T.StringType()), False)] if spans else [])
    sent = df.sparkSession.sparkContext.broadcast(trees)
    hidden = free_name(source, "__html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                pages = [elements(parse(t)) for t in texts_of(batch, hidden)]
                odds = sent.value.log_odds(features(pages)) if pages else []
                found, at = [], 0
                for nodes in pages:
                    found.append(blocks(nodes, decode(nodes, odds[at : at + len(nodes)])))
                    at += len(nodes)
                columns = [pa.array([" ".join(b) for b in found], pa.string())] + ([pa.array(found, pa.list_(pa.string()))] if spans else [])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *outputs])

    return bounded(source).withColumn(hidden, F.col(f"`{html}`")).mapInArrow(run, T.StructType([*source.schema.fields, *fields]))
