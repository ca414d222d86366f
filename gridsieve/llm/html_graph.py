"""Main text of pages by a tree-structured graphical model over their elements.

Every block element is a node that is content or not.  A node has a potential from its own
features, an edge to its parent one from both labels.  Sum-product messages from the leaves
to the root and back give each node's marginal; the text of nodes that are likelier content
than not is the page's main text.  The weights are trained on labelled pages by the gradient
of their likelihood, which the same messages provide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.html_pages import labelled_pages

# Fixed values of HTML: elements without an end tag, elements whose text is never shown, and
# elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(
    "script style noscript template svg math iframe object head title canvas audio video".split()
)
# A head without an end tag ends where an element starts that it may not hold, or text.
IN_HEAD = frozenset(
    "base basefont bgsound head html link meta noframes noscript script style template title".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var".split()
)
# An open element of the second group ends where one of the first starts.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section "
    "table ul".split()
)
ENDS_OWN_KIND = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table body html".split())
# What may hold text that no other element holds; the page itself has no name.
BARE = frozenset(("", "html", "body"))

KINDS = (
    "article main section div p h1 heading li list nav header footer aside form table quote body other"
).split()
_KIND = {
    **{k: k for k in "article main section div p h1 li nav header footer aside body".split()},
    **{h: "heading" for h in "h2 h3 h4 h5 h6".split()},
    **{h: "list" for h in "ul ol dl menu".split()},
    **{h: "form" for h in "form button input select textarea label fieldset legend option dialog".split()},
    **{h: "table" for h in "table tbody thead tr td th".split()},
    **{h: "quote" for h in "blockquote pre figure figcaption".split()},
}
FURNITURE = re.compile(
    r"(^|[-_ ])(nav|navigation|navbar|menu|side-?bar|footer|header|masthead|comments?|commentlist"
    r"|respond|repl(y|ies)|discussion|cookies?|consent|notice|alert|banner|ads?|advert\w*|sponsor\w*"
    r"|promo\w*|share|sharing|social|related|recommend\w*|form|login|sign-?up|subscribe"
    r"|newsletter|breadcrumbs?|pagination|pager|widget|popup|modal|toolbar|contentinfo"
    r"|complementary|search|toc|meta)($|[-_ \d])",
    re.I,
)
CONTENT = re.compile(
    r"(^|[-_ ])(article|content|main|post|entry|story|body|text|page)($|[-_ \d])", re.I
)
# Elements that their own attributes hide; what stands in them is opened under a marked name.
UNSEEN = "!"
NOT_SHOWN = re.compile(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)\s*(!|;|$)", re.I)
SHARES = (0.2, 0.5, 0.8)  # of a node's text in links
LENGTHS = (1, 20, 80, 300)  # characters of a node's text
N_FEATURES = len(KINDS) + 2 + len(SHARES) + len(LENGTHS) + 2


@dataclass
class Page:
    """Elements in page order: parents come before their children."""

    parent: list[int] = field(default_factory=lambda: [-1])
    kind: list[str] = field(default_factory=lambda: ["other"])
    names: list[str] = field(default_factory=lambda: [""])
    label: list[int] = field(default_factory=lambda: [0])
    chars: list[int] = field(default_factory=lambda: [0])
    linked: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str]] = field(default_factory=list)  # (node, text) between block edges


def _is_unseen(attrs) -> bool:
    return any(
        key == "hidden" or (key == "style" and value and NOT_SHOWN.search(value))
        for key, value in attrs
    )


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = [("", 0)]
        self.opened: Counter[str] = Counter()  # names of the open elements
        self.hidden = 0  # open elements whose text is not shown
        self.links = 0
        self.held: list[str] = []

    def _edge(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            self.held.clear()
            if text:
                self.page.runs.append((self.open[-1][1], text))

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag in ("br", "hr"):
                self.held.append(" ")
            return
        if self.hidden:
            self._show_before(tag)
        if tag in HIDDEN or (tag in INLINE and self.opened[UNSEEN + tag]):
            self._open_hidden(tag if tag in HIDDEN else UNSEEN + tag)
            return
        unseen = _is_unseen(attrs)
        if tag in INLINE:
            if unseen:
                self._open_hidden(UNSEEN + tag)
            elif tag == "a":
                self.links = 1
            return
        self._edge()
        self.links = 0
        if tag in ENDS_P:
            self._close({"p"}, tag)
        if tag in ENDS_OWN_KIND:
            self._close(ENDS_OWN_KIND[tag], tag)
        names, label = "", None
        for key, value in attrs:
            if key in ("class", "id", "role") and value:
                names += " " + value
            elif key == "data-content":
                label = int(value == "1")
        self._open_shown(tag, names, label)
        if unseen:
            self._open_hidden(UNSEEN)

    def _open_shown(self, tag: str, names: str = "", label: int | None = None) -> None:
        page, above = self.page, self.open[-1][1]
        self.open.append((tag, len(page.parent)))
        self.opened[tag] += 1
        page.parent.append(above)
        page.kind.append(_KIND.get(tag, "other"))
        page.names.append(names)
        page.label.append(page.label[above] if label is None else label)
        page.chars.append(0)
        page.linked.append(0)

    def _open_hidden(self, name: str) -> None:
        self.hidden += 1
        self.open.append((name, self.open[-1][1]))
        self.opened[name] += 1

    def _show_before(self, tag: str) -> None:
        """End an open head or drawing that cannot hold the starting element."""
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._leave(len(self.open) - 1)
        if not (self.opened["svg"] or self.opened["math"] or self.opened["head"]):
            return
        for k in range(len(self.open) - 1, 0, -1):
            name = self.open[k][0]
            if name == "foreignobject":
                return
            if (name in ("svg", "math") and tag in ENDS_P) or (name == "head" and tag == "body"):
                self._leave(k)
                return

    def _leave(self, k: int) -> None:
        """End the open elements from the k-th on."""
        for tag, _ in self.open[k:]:
            self.hidden -= tag in HIDDEN or tag.startswith(UNSEEN)
            self.opened[tag] -= 1
        del self.open[k:]

    def _close(self, tags, starting) -> None:
        """End an open element of ``tags`` that is not beyond a list, table or the body."""
        if not any(self.opened[tag] for tag in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k][0]
            if tag in tags:
                self._leave(k)
                return
            if tag in HIDDEN or tag in SCOPE or (tag in ENDS_P and starting not in ENDS_OWN_KIND):
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in HIDDEN or tag in INLINE:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE and self.opened[UNSEEN + tag]:
            tag = UNSEEN + tag
        if tag in INLINE:
            if tag == "a":
                self.links = 0
        elif tag not in VOID:
            if tag not in HIDDEN and not tag.startswith(UNSEEN):
                self._edge()
            if not self.opened[tag]:
                return
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == tag:
                    self._leave(k)
                    break

    def parse_html_declaration(self, i):
        """Marked sections that the parser does not know end at the next '>', as in browsers."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            return self.rawdata.find(">", i + 3) + 1 or -1

    def handle_data(self, data):
        if self.open[-1][0] == "head" and data.strip():
            self._leave(len(self.open) - 1)
        if self.hidden:
            return
        if self.open[-1][0] in BARE and data.strip():
            self._open_shown("p")  # text right in the body is a paragraph without its tag
        self.held.append(data)
        n = len(data) - data.count(" ") - data.count("\n")
        node = self.open[-1][1]
        self.page.chars[node] += n
        self.page.linked[node] += n * self.links


def read_page(html: str | None) -> Page:
    """Elements, features' raw material and text runs of a page; tolerant of bad markup."""
    reader = _Reader()
    reader.feed(html or "")
    if reader.rawdata.startswith("<!--"):
        reader.rawdata = ""  # a comment without an end hides the rest, as in browsers
    reader.close()
    reader._edge()
    return reader.page


def node_features(page: Page) -> np.ndarray:
    n = len(page.parent)
    chars = np.array(page.chars, dtype=np.float64)
    linked = np.array(page.linked, dtype=np.float64)
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    out[np.arange(n), [KINDS.index(k) for k in page.kind]] = 1
    at = len(KINDS)
    for i, names in enumerate(page.names):
        if names:
            out[i, at] = FURNITURE.search(names) is not None
            out[i, at + 1] = not out[i, at] and CONTENT.search(names) is not None
    at += 2
    share = linked / np.maximum(chars, 1)
    for k, least in enumerate(SHARES):
        out[:, at + k] = share >= least
    at += len(SHARES)
    for k, least in enumerate(LENGTHS):
        out[:, at + k] = chars >= least
    out[0, -2] = 1
    out[:, -1] = 1
    return out


def under_body(features: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """1 for nodes right below a body or the page itself, where content may begin, else 0."""
    open_ = np.maximum(features[parent, KINDS.index("body")], features[parent, -2])
    return np.where(parent >= 0, open_, 0).astype(np.int64)


@dataclass
class TreeModel:
    weights: np.ndarray  # of a node's features, for content against other
    edges: np.ndarray  # [parent is the body, parent's label, child's label]

    def marginals(self, features: np.ndarray, parent: np.ndarray):
        """(content marginal of every node, edge marginals) of a forest of trees."""
        n = len(parent)
        depth = np.zeros(n, dtype=np.int64)
        for i in range(n):
            if parent[i] >= 0:
                depth[i] = depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]
        edges = self.edges[under_body(features, parent)]
        own = np.zeros((n, 2))
        own[:, 1] = features @ self.weights
        up = np.zeros((n, 2))  # from a node to its parent, by the parent's label
        inside = own.copy()
        for nodes in levels[:0:-1]:
            up[nodes] = np.logaddexp(
                inside[nodes, 0][:, None] + edges[nodes, :, 0],
                inside[nodes, 1][:, None] + edges[nodes, :, 1],
            )
            np.add.at(inside, parent[nodes], up[nodes])
        down = np.zeros((n, 2))  # from the parent, by the node's label
        rest = np.zeros((n, 2))
        for nodes in levels[1:]:
            above = parent[nodes]
            rest[nodes] = inside[above] + down[above] - up[nodes]
            down[nodes] = np.logaddexp(
                rest[nodes, 0][:, None] + edges[nodes, 0], rest[nodes, 1][:, None] + edges[nodes, 1]
            )
        both = inside + down
        content = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60)))
        pair = rest[:, :, None] + edges + inside[:, None, :]
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True))
        return content, pair / pair.sum(axis=(1, 2), keepdims=True)


def _forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(p.parent) for p in pages]
    first = np.cumsum([0, *sizes[:-1]])
    parent = np.concatenate(
        [np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first)]
    )
    return np.concatenate([node_features(p) for p in pages]), parent


def train(html: list[str], rounds: int = 500, rate: float = 3.0, shrink: float = 1e-5) -> TreeModel:
    """Maximum likelihood of labelled pages by gradient steps with momentum."""
    pages = [read_page(h) for h in html]
    features, parent = _forest(pages)
    y = np.concatenate([np.array(p.label) for p in pages])
    has = np.flatnonzero(parent >= 0)
    where = under_body(features, parent)[has]
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (where, y[parent[has]], y[has]), 1)
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((2, 2, 2)))
    moved_w, moved_e = np.zeros(N_FEATURES), np.zeros((2, 2, 2))
    for _ in range(rounds):
        content, pair = model.marginals(features, parent)
        step_w = features.T @ (y - content) / len(y) - shrink * model.weights
        wanted = np.zeros((2, 2, 2))
        np.add.at(wanted, where, pair[has])
        step_e = (seen - wanted) / len(y) - shrink * model.edges
        moved_w, moved_e = 0.9 * moved_w + rate * step_w, 0.9 * moved_e + rate * step_e
        model.weights += moved_w
        model.edges += moved_e
    return model


def main_texts(model: TreeModel, html: list[str | None]) -> list[str]:
    """The main text of every page; blocks in page order, joined by one space."""
    pages = [read_page(h) for h in html]
    if not pages:
        return []
    features, parent = _forest(pages)
    content, _ = model.marginals(features, parent)
    out, first = [], 0
    for p in pages:
        likely = content[first : first + len(p.parent)] > 0.5
        out.append(" ".join(text for node, text in p.runs if likely[node]))
        first += len(p.parent)
    return out


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page, from the whole html.

    A null html counts as empty; a page without content has an empty text.  Text of elements
    that their own attributes hide is not shown.  Repeated rows are read each, other columns
    are not used, and an empty table gives no rows.  The model is a few hundred numbers; pages are not
    shuffled.
    """
    model = model or train(labelled_pages())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, texts = batch.column(2).to_pylist(), []
            for at in range(0, len(html), 128):
                texts += main_texts(model, html[at : at + 128])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
