"""Main text of web pages: boosted trees over DOM-node features, decoded from the root down.

A page becomes a tree of block elements (and of inline ones whose attributes name boilerplate). The trees judge each
node by its tag, hashed attribute words, subtree density, depth and siblings. Decoding picks the best consistent choice: a node
is kept only if its parent is, so no kept text lies in a dropped ancestor, and a container is kept if what is best kept
inside it outweighs its own verdict.

Training pages are pages of the table with one <article>. Each also gives variants, its article's blocks and its other
text set into other layouts (other containers, sidebars, notices, forms, comments inside or beside the article), whose
labels are known because they are made here.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.runtime import beside, ship, text_of

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+>
  |<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>|[^>]*+(?:>|\Z))""", re.S | re.X)
ATTRIBUTES = re.compile(r"""\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:[\s=>/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORD = re.compile(r"[a-z]+")
MADE = ' data-made="1"'  # marks boxes in training pages

# Element names of HTML by their role
RAW = frozenset("script style noscript template iframe object svg math canvas select option textarea button head title xmp datalist dialog audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": ("li", frozenset(("ul", "ol", "menu"))), "dt": ("dt dd", frozenset(("dl",))), "dd": ("dt dd", frozenset(("dl",))),
               "tr": ("tr td th", frozenset(("table",))), "td": ("td th", frozenset(("tr", "table"))), "th": ("td th", frozenset(("tr", "table")))}
GROUPS = {name: i for i, names in enumerate((
    "article main", "div section center td", "p blockquote pre", "h1 h2 h3 h4 h5 h6", "li dt dd", "ul ol dl menu", "nav", "header", "footer", "aside",
    "form fieldset", "table tr tbody", "figure figcaption", "html body", "address details summary")) for name in names.split()}
OTHER = 15
BAD_TAGS = frozenset("nav footer aside form fieldset menu".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text prose richtext page hentry".split())
BAD_WORDS = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner banners nav navbar navigation menu menus topbar "
                       "breadcrumb breadcrumbs sidebar side aside rail footer foot header masthead comment comments commentlist reply replies respond discussion disqus "
                       "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form search searchbox share sharing social "
                       "related recommended recommendations widget widgets toc copyright legal disclaimer pagination pager tags taglist meta").split())


TOKENS = 32  # buckets of hashed attribute words


class Node(NamedTuple):
    tag: str
    parent: int
    good: bool
    bad: bool
    tokens: int = 0  # buckets of its attribute words, as bits
    made: bool = False  # set in by `layouts`


class Open:
    """The open elements, innermost last, with the places of each name, so that no search walks over them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("html", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = [0]

    def node(self) -> int:
        return self.stack[-1][1]

    def push(self, name: str, node: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((name, node))

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> None:
        """Closes the element at the place and all inside it; each element is closed once."""
        while len(self.stack) > place:
            name, _ = self.stack.pop()
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()

    def close(self, name: str) -> None:
        """The closing tag of a name: one that matches nothing is ignored, an inline one does not reach over a block."""
        place = self.last((name,))
        if place > (self.blocks[-1] if name in INLINE else 0):
            self.cut(place)

    def end(self, names, stops) -> None:
        """Closes the innermost open element of the given names, unless one of `stops` encloses the place first."""
        place = self.last(names)
        if place > self.last(stops):
            self.cut(place)


class Page:
    """Nodes in document order (a parent comes before its children) and pieces of text with the node that holds them.

    Reading takes time in proportion to the page, however deep, unclosed or unmatched its elements are.
    """

    def __init__(self, source: str):
        self.nodes: list[Node] = [Node("html", -1, False, False)]
        self.pieces: list[tuple[int, str, bool]] = []  # node, text, whether a block begins before it
        self.links: list[int] = [0]
        self.unclosed: set[str] = set()  # names without a closing tag ahead
        self._read(source)

    def _read(self, source: str) -> None:
        held = Open()
        at, fresh, in_link, end = 0, True, 0, len(source)
        while at < end:
            m = TAG.search(source, at)
            begin = m.start() if m else end
            if begin > at:
                text = html.unescape(source[at:begin])
                if text:
                    node = held.node()
                    self.pieces.append((node, text, fresh))
                    fresh = False
                    if in_link:
                        self.links[node] += len(text)
            if not m:
                return
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.pieces.append((held.node(), m[0][9:].removesuffix("]]>"), fresh))
                continue
            name, closing, rest = m[2].lower(), bool(m[1]), m[3]
            if closing:
                if name in VOID or name in RAW:
                    fresh |= name == "br"
                    continue
                if name == "a":
                    in_link = max(0, in_link - 1)
                held.close(name)
                fresh |= name not in INLINE
                continue
            if name in VOID:
                if name == "br":
                    self.pieces.append((held.node(), " ", False))
                else:
                    fresh |= name == "hr"
                continue
            if name in RAW:
                if not rest.endswith("/>"):
                    at = self._after(source, at, name)
                fresh |= name not in ("svg", "math", "button", "select")
                continue
            if name in INLINE:
                if rest.endswith("/>"):
                    continue
                if name == "a":
                    in_link += 1
                good, bad, *more = self._words(rest)
                held.push(name, self._add(name, held.node(), good, bad, *more) if bad else held.node())
                continue
            fresh = True
            if name == "html":
                continue
            if name in ENDS_P:
                held.end(("p",), ("td", "th", "table", "button", "div", "section", "article", "li"))
            if name in SELF_ENDING:
                ends, stops = SELF_ENDING[name]
                held.end(ends.split(), stops)
            in_link = 0 if name not in ("div", "p", "section", "h1", "h2", "h3", "h4", "li") else in_link
            held.push(name, self._add(name, held.node(), *self._words(rest)))

    def _add(self, tag: str, parent: int, good: bool, bad: bool, tokens: int, made: bool) -> int:
        self.nodes.append(Node(tag, parent, good, bad, tokens, made))
        self.links.append(0)
        return len(self.nodes) - 1

    def _after(self, source: str, at: int, name: str) -> int:
        m = None if name in self.unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
        if m:
            return m.end()
        self.unclosed.add(name)
        return len(source) if name in ("script", "style", "textarea", "title", "xmp") else at

    @staticmethod
    def _words(rest: str) -> tuple[bool, bool, int, bool]:
        if "=" not in rest and "hidden" not in rest:
            return False, False, 0, False
        found = {w for m in ATTRIBUTES.finditer(rest) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower())}
        tokens = 0
        for w in found:
            tokens |= 1 << zlib.crc32(w.encode()) % TOKENS
        return bool(found & GOOD_WORDS), bool(found & BAD_WORDS) or bool(HIDDEN.search(rest)), tokens, MADE in rest


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a row per node of all pages, parent of each node or -1, own text length)."""
    sizes = np.array([len(p.nodes) for p in pages])
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    parent, group, good, bad, bad_tag = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n)
    tokens = np.zeros(n, np.int64)
    text, link, marks, words, order = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for p, b in zip(pages, base, strict=True):
        for i, node in enumerate(p.nodes):
            parent[b + i] = node.parent + b if i else -1
            group[b + i] = GROUPS.get(node.tag, OTHER)
            good[b + i], bad[b + i], bad_tag[b + i] = node.good, node.bad, node.tag in BAD_TAGS
            link[b + i], tokens[b + i] = p.links[i], node.tokens
        for node, piece, _ in p.pieces:
            text[b + node] += len(piece) - piece.count(" ")
            words[b + node] += piece.count(" ")
            marks[b + node] += piece.count(".") + piece.count(",")
        order[b:b + len(p.nodes)] = np.arange(len(p.nodes)) / max(1, len(p.nodes) - 1)
    page = np.repeat(np.arange(len(pages)), sizes)
    depth = np.zeros(n, np.int64)
    levels = _levels(parent, depth)
    main = (group == 0).astype(float)
    over_good, over_bad, over_tag, over_main, over_item = (np.zeros(n) for _ in range(5))
    for at in levels[1:]:
        up = parent[at]
        over_good[at] = over_good[up] + good[up]
        over_bad[at] = over_bad[up] + bad[up]
        over_tag[at] = over_tag[up] + bad_tag[up]
        over_main[at] = over_main[up] + main[up]
        over_item[at] = over_item[up] + (group[up] == 5)
    all_text, all_link, all_marks, all_words, tags, kids, paragraphs = text.copy(), link.copy(), marks.copy(), words.copy(), np.ones(n), np.zeros(n), (group == 2).astype(float)
    for at in reversed(levels[1:]):
        for total in (all_text, all_link, all_marks, all_words, tags, paragraphs):
            np.add.at(total, parent[at], total[at])
        np.add.at(kids, parent[at], 1)
    inner = np.flatnonzero(parent >= 0)
    siblings, place, alike = np.ones(n), np.zeros(n), np.ones(n)
    siblings[inner] = kids[parent[inner]]
    if len(inner):
        rank = np.argsort(parent[inner], kind="stable")
        sorted_parent = parent[inner][rank]
        place[inner[rank]] = np.arange(len(inner)) - np.searchsorted(sorted_parent, sorted_parent)
        key = parent[inner] * 16 + group[inner]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        alike[inner] = count[back]
    above = np.where(parent >= 0, parent, 0)
    whole = all_text[np.cumsum(sizes) - sizes][page] if n else all_text
    one = lambda x: np.log1p(x)
    ratio = lambda a, b: a / np.maximum(b, 1)
    out = np.stack([
        *[(group == g).astype(float) for g in range(16)], good, bad, np.minimum(over_good, 2), np.minimum(over_bad, 2), np.minimum(over_tag, 2),
        np.minimum(over_main, 2), np.minimum(over_item, 2), np.minimum(depth, 12), np.minimum(kids, 50), np.minimum(siblings, 50), ratio(place, siblings),
        ratio(alike, siblings), one(text), one(all_text), ratio(link, text), np.minimum(ratio(all_link, all_text), 2), ratio(all_marks, all_text), ratio(all_words, all_text),
        one(ratio(all_text, tags)), ratio(all_text, whole), order, one(paragraphs), ratio(all_text, all_text[above]) if n else all_text, group[above] if n else all_text,
        *[(tokens >> k & 1).astype(float) for k in range(TOKENS)],
    ], axis=1)
    return out, parent, text


def _levels(parent: np.ndarray, depth: np.ndarray) -> list[np.ndarray]:
    """The nodes by depth, which is filled in; a parent comes before its children."""
    found: list[int] = []
    for up in parent.tolist():
        found.append(found[up] + 1 if up >= 0 else 0)
    depth[:] = found
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)


class Trees(NamedTuple):
    """Nodes of all trees in one table; a leaf points to itself."""

    roots: np.ndarray
    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            while True:
                to = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
            out += weight * self.value[at]
        return out


def trees_of(description: str) -> Trees:
    """Reads the text form of a fitted ensemble of regression trees."""
    table: list[list[float]] = []
    roots, weights = [], []
    lines = [line.strip() for line in description.splitlines()]

    def node(i: int) -> tuple[int, int]:
        at = len(table)
        if lines[i].startswith("Predict:"):
            table.append([0, 0.0, at, at, float(lines[i].split(":")[1])])
            return at, i + 1
        m = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i])
        table.append([int(m[1]), float(m[2]), 0, 0, 0.0])
        left, i = node(i + 1)
        right, i = node(i + 1)
        table[at][2:4] = [left, right]
        return at, i

    for i, line in enumerate(lines):
        if m := re.match(r"Tree \d+ \(weight (\S+)\):", line):
            weights.append(float(m[1]))
            roots.append(node(i + 1)[0])
    t = np.array(table)
    return Trees(np.array(roots), np.array(weights), t[:, 0].astype(int), t[:, 1], t[:, 2].astype(int), t[:, 3].astype(int), t[:, 4])


def by_names(x: np.ndarray) -> np.ndarray:
    """Margins where no page could be learned from: below 0 inside or at an element that its name marks as boilerplate."""
    marked = (x[:, 17] > 0) | (x[:, 19] > 0) | (x[:, 20] > 0) | x[:, [6, 8, 9, 10]].any(axis=1)
    return np.where(marked, -1.0, 1.0)


def decoded(parent: np.ndarray, margin: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Which nodes to keep: the choice of largest total margin in which every kept node's parent is kept.

    A node weighs by its own text, one without text a little. Roots are always kept.
    """
    gain = margin * (np.minimum(text, 1000) + 0.1)
    levels = _levels(parent, np.zeros(len(parent), np.int64))
    for at in reversed(levels[1:]):
        np.add.at(gain, parent[at], np.maximum(gain[at], 0))
    keep = np.zeros(len(parent), dtype=bool)
    keep[levels[0]] = True
    for at in levels[1:]:
        keep[at] = keep[parent[at]] & (gain[at] > 0)
    return keep


def extracted(sources: list[str], trees: Trees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, text = features(pages)
    keep = decoded(parent, trees.margin(x) if trees else by_names(x), text)
    out, base = [], 0
    for p in pages:
        own = keep[base:base + len(p.nodes)]
        base += len(p.nodes)
        kept, cut = [], False
        for node, piece, fresh in p.pieces:
            cut |= fresh
            if own[node]:
                kept.append(" " + piece if cut else piece)
                cut = False
        out.append(" ".join("".join(kept).split()))
    return out


ARTICLE = re.compile(r"<article[^>]*>(.*?)(?:</article\s*>|\Z)", re.I | re.S)
CONTAINERS = ("<article>", "<main>", '<div class="content">', '<div class="article-body">', '<div id="main-content">', '<section class="post">', '<div class="entry-content">', '<div class="story">', "<div>")
BOXES = (("<nav>", "nav"), ('<div class="nav">', "div"), ('<ul class="menu">', "ul"), ("<header>", "header"), ('<div class="header">', "div"), ("<footer>", "footer"), ('<div id="footer">', "div"),
         ("<aside>", "aside"), ('<div class="sidebar">', "div"), ('<div class="ad">', "div"), ('<div class="advert">', "div"), ('<section class="sponsored">', "section"),
         ('<div class="cookie-notice">', "div"), ('<div id="consent">', "div"), ('<div class="notice">', "div"), ("<form>", "form"), ('<form class="newsletter">', "form"), ('<div class="comments">', "div"),
         ('<section id="comments">', "section"), ('<div class="related">', "div"), ('<div class="share">', "div"), ('<ol class="commentlist">', "ol"))
INNER = ("ad", "comments", "related", "share", "newsletter", "aside", "sponsored", "commentlist", "advert")


def layouts(source: str, seed: int, variants: int = 4) -> list[tuple[Page, np.ndarray]]:
    """The page itself and variants of it, with the label of each node: 1 main text, 0 other text, -1 neither (holds both)."""
    m = ARTICLE.search(source)
    outside = source[:m.start()] + "<x-main>" + source[m.end():]
    out = [_labelled(source, "article")]
    lines = [t for t in re.split(r"<[^>]*>", re.sub(r"(?is)<(script|style|head)\b.*?</\1>", " ", outside)) if t.strip()] or ["More"]
    inner = re.sub(r"(?i)</?x-main>", " ", m[1])
    draw = random.Random(seed)
    for _ in range(variants):
        def box(names=None):
            opening, tag = draw.choice([b for b in BOXES if not names or any(n in b[0] for n in names)])
            opening = opening[:-1] + MADE + ">"
            item = draw.choice(("<p>{}</p>", "<li><a href='#'>{}</a></li>", "<div>{}</div>", "<a href='#'>{}</a> ", "{} <br>", "<p><a href='#'>{}</a> {}</p>"))
            return opening + "".join(item.replace("{}", draw.choice(lines)) for _ in range(draw.randint(1, 6))) + f"</{tag}>"

        blocks = re.split(r"(?i)(?=<p\b|<h[1-6]\b)", inner)
        for _ in range(draw.randint(0, 2)):
            blocks.insert(draw.randint(0, len(blocks)), box(INNER))
        if draw.random() < 0.3:
            blocks[0] = "<header>" + blocks[0] + "</header>"
        container = draw.choice(CONTAINERS)
        tag = re.match(r"<(\w+)", container)[1]
        body = container.replace(f"<{tag}", f'<{tag} data-main="1"', 1) + "".join(blocks) + f"</{tag}>"
        before, after = [box() for _ in range(draw.randint(0, 4))], [box() for _ in range(draw.randint(0, 4))]
        page = "".join(before) + body + "".join(after)
        if draw.random() < 0.5:
            page = f'<div class="{draw.choice(("wrapper", "page", "container", "layout"))}">{page}</div>'
        out.append(_labelled("<html><body>" + page + "</body></html>", None))
    return out


def _labelled(source: str, tag: str | None) -> tuple[Page, np.ndarray]:
    """Labels of the nodes of a page whose main container is `tag`, or the element marked data-main.

    They follow from where a node lies: inside the container 1, outside it or inside a box that was set in 0.
    """
    marked = source if tag is None else re.sub(rf"(?i)<{tag}\b", f'<{tag} data-main="1"', source, count=1)
    page = Page(re.sub(r'(<\w+) data-main="1"([^>]*)>', r"\1\2><x-in></x-in>", marked, count=1))
    label, main = np.zeros(len(page.nodes), np.int64), None
    for i, node in enumerate(page.nodes):
        if node.tag == "x-in":
            main = node.parent
    for i, node in enumerate(page.nodes):
        up = node.parent
        if i == main:
            label[i] = 1
        elif up < 0 or node.made:
            label[i] = 0
        elif label[up] == 1 and (node.bad or node.tag in BAD_TAGS):
            label[i] = -1  # a box of the page's own inside its article: not known, so not learned from
        else:
            label[i] = label[up]
    at = main
    while at is not None and page.nodes[at].parent >= 0:
        at = page.nodes[at].parent
        label[at] = -1
    for i, node in enumerate(page.nodes):
        if node.tag == "x-in":
            label[i] = -1
    return page, label


def _training(batches):
    for batch in batches:
        found = []
        for key, source in zip(batch.column(0), batch.column(1), strict=True):
            found += layouts(source.as_py(), int(key.as_py()[:8], 16))
        if not found:
            continue
        x, _, text = features([p for p, _ in found])
        label = np.concatenate([y for _, y in found])
        use = label >= 0
        lists = pa.ListArray.from_arrays(pa.array(np.arange(use.sum() + 1) * x.shape[1], pa.int32()), pa.array(x[use].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(label[use].astype(float)), lists, pa.array(np.minimum(text[use], 200) + 5.0)], ["label", "x", "weight"])


def fit(pages: DataFrame, bound: int = 200, trees: int = 12, depth: int = 5) -> Trees | None:
    """Learns from at most `bound` pages that hold one <article>, those of the smallest md5 of the id; None without any."""
    ship(pages.sparkSession)
    key = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary"))
    some = pages.select(key.alias("key"), text_of("html").alias("html")).filter(F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 1)
    sample = some.orderBy("key", F.md5(F.col("html").cast("binary"))).limit(bound).repartition(4, "key")
    rows = sample.mapInArrow(_training, "label double, x array<double>, weight double").withColumn("features", array_to_vector("x")).drop("x").cache()
    try:
        n, mean = rows.agg(F.count("*"), F.avg("label")).first()
        if not n or mean in (0.0, 1.0):
            return None
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.4, weightCol="weight", seed=5).fit(rows)
        return trees_of(model.toDebugString)
    finally:
        rows.unpersist()


def main_texts(pages: DataFrame, bound: int = 200) -> DataFrame:
    """Per row: page_id, url, text (empty if there is none), n_chars.

    A null or empty page has the empty text. Other columns are not read; repeated rows give equal rows.
    """
    model = fit(pages, bound)
    shared = pages.sparkSession.sparkContext.broadcast(tuple(model) if model else None)

    def start():
        trees = Trees(*shared.value) if shared.value else None

        def work(column):
            out, held, size = [], [], 0
            for source in column:
                held.append(source.as_py() or "")
                size += len(held[-1])
                if size > 1 << 21:
                    out += extracted(held, trees)
                    held, size = [], 0
            return [pa.array(out + extracted(held, trees), pa.string())]

        return work

    out = beside(pages.select("page_id", "url", "html"), [("text", "string")], start, ("html",))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
