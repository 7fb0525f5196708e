"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with a hidden label, content or not. Potentials: how likely a label is under the parent's
label for this kind of element (parent-child), and how likely the node's features are under the label (its tag, the words
of its class, id and role, the length of its text, the share of it in links). Sum-product messages pass from the leaves to
the root and back, and the marginal of a node decides on the text it holds directly.

Potentials are smoothed counts from labelled pages: the built-in ones below, made by rule, and pages of the table at hand
whose own markup labels them (an ``article`` or ``main`` element), at most about ``TRAIN_PAGES`` of them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm.common import pick, slices

TRAIN_PAGES = 2000

# Fixed values of the HTML standard: elements that have no end tag, that begin a block of their own, and whose start ends
# an open element of the given kinds (up to the nearest of the named containers).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("td th table button caption html".split())  # a paragraph isn't closed beyond these
# Elements that never hold article text, wherever they stand.
NEVER = frozenset("head title script style noscript template svg math iframe object canvas audio video map button select "
                  "textarea datalist form nav footer aside dialog menu search".split())


# The state of the root, whose children begin the tree: it's neither label.
ROOT = 2


@dataclass
class Node:
    tag: str
    words: tuple[str, ...]
    parent: int
    label: int | None  # given by a labelled page
    dropped: bool  # in an element that never holds article text
    in_article: bool
    length: int = 0  # characters of text, and of them in links
    linked: int = 0


def name_words(value: str) -> list[str]:
    """The lower-case words of a class, id or role: split at signs, digits and inner capitals."""
    return [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", value)]


class Page(HTMLParser):
    """Elements as nodes (parents first), and blocks of text in page order as lists of (node, text).

    Inline elements are nodes only if they are named or hidden; others belong to the node around them. The places of open
    elements are kept by tag, so finding the one that a tag ends costs a search among those tags' places, however deep the
    page is nested. Only pages that were made for training may state labels (``marks``).
    """

    def __init__(self, html: str, marks: bool = True):
        super().__init__(convert_charrefs=True)
        self.marks = marks
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.block_places: list[int] = []
        self.nodes = [Node("html", (), -1, None, False, False)]
        self.blocks: list[list[tuple[int, str]]] = []
        self.open: list[tuple[str, int]] = []  # tag, and its node or the one around it
        self.run: list[tuple[int, str]] = []
        self.links = 0
        self.feed(html)
        self.close()
        self.flush()

    def here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        if self.run:
            self.blocks.append(self.run)
            self.run = []

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.open))
        if tag in BLOCK:
            self.block_places.append(len(self.open))
        self.links += tag == "a"
        self.open.append((tag, node))

    def pop_to(self, size: int) -> None:
        block = False
        while len(self.open) > size:
            tag, _ = self.open.pop()
            self.places[tag].pop()
            self.links -= tag == "a"
            if tag in BLOCK:
                self.block_places.pop()
                block = True
        if block:
            self.flush()

    def close_open(self, tags: set[str], until: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` that is within the nearest of ``until``."""
        limit = max((p[-1] for t in until if (p := self.places.get(t))), default=-1)
        within = [p[k] for t in tags if (p := self.places.get(t)) and (k := bisect_right(p, limit)) < len(p)]
        if within:
            self.pop_to(min(within))

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body"):
            return  # their nodes would say nothing: the root stands for both
        if tag in VOID:
            if tag == "br" and self.run:
                self.run.append((self.here(), " "))
            elif tag == "hr":
                self.close_open({"p"}, SCOPES)
                self.flush()
            return
        block = tag in BLOCK
        if block:
            self.close_open({"p"}, SCOPES)
            self.flush()
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        given = {k: v or "" for k, v in attrs}
        words = tuple(sorted({w for name in ("class", "id", "role") for w in name_words(given.get(name, ""))}))
        at = self.here()
        around = self.nodes[at]
        hidden = "hidden" in given or given.get("aria-hidden") == "true" or re.search(
            r"display\s*:\s*none", given.get("style", ""), re.I)
        # A header within an article holds its headings; any other header is the page's.
        dropped = around.dropped or tag in NEVER or bool(hidden) or (tag == "header" and not around.in_article)
        if block or words or dropped != around.dropped:
            label = {"1": 1, "0": 0}.get(given.get("data-label", "")) if self.marks else None
            self.nodes.append(Node(tag, words, at, label, dropped, around.in_article or tag in ("article", "main")))
            at = len(self.nodes) - 1
        self.push(tag, at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at a start tag's end means nothing in HTML

    def handle_endtag(self, tag):
        own = self.places.get(tag)
        # The end of an inline element doesn't reach over a block.
        if own and (tag in BLOCK or not self.block_places or self.block_places[-1] < own[-1]):
            self.pop_to(own[-1])

    def handle_data(self, data):
        at = self.here()
        if at == 0:  # text outside all elements is a node of its own for each run
            if not data.strip() and not self.run:
                return
            if not self.run:
                self.nodes.append(Node("#text", (), 0, None, False, False))
            at = self.run[-1][0] if self.run else len(self.nodes) - 1
        node = self.nodes[at]
        if not node.dropped:
            self.run.append((at, data))
            n = len(data.strip())
            node.length += n
            node.linked += n if self.links else 0


def features(node: Node, length: int, linked: int) -> list[str]:
    """What a node shows: its tag, its words, and the length and link share of the text in its whole subtree."""
    size = next((k for k, most in enumerate((0, 20, 80, 240, 1000)) if length <= most), 5)
    share = "none" if not length else "low" if linked < 0.2 * length else "mid" if linked < 0.6 * length else "high"
    return [f"tag={node.tag}", f"text={size}", f"links={share}", *(f"word={w}" for w in node.words)]


def all_features(page: Page) -> list[list[str]]:
    length, linked = [n.length for n in page.nodes], [n.linked for n in page.nodes]
    for k in range(len(page.nodes) - 1, 0, -1):  # children come after their parents
        length[page.nodes[k].parent] += length[k]
        linked[page.nodes[k].parent] += linked[k]
    return [features(n, a, b) for n, a, b in zip(page.nodes, length, linked)]


def labels_of(page: Page) -> list[int] | None:
    """Labels that a page's own markup states: ``data-label`` marks (inherited), or one article or main element."""
    if any(n.label is not None for n in page.nodes):
        out: list[int] = []
        for n in page.nodes:
            # Text outside all elements is content in such a page.
            out.append(n.label if n.label is not None else int(n.tag == "#text") or out[n.parent] if n.parent >= 0 else 0)
        return out
    if not any(n.in_article for n in page.nodes):
        return None
    return [int(n.in_article and not n.dropped) for n in page.nodes]


def count_page(page: Page, total: Counter) -> None:
    """Add a labelled page's counts: (kind, what, state, label). Dropped nodes are certain and teach nothing."""
    labels = labels_of(page)
    if labels is None:
        return
    for node, own, label in zip(page.nodes, all_features(page), labels):
        if node.parent < 0 or node.dropped:
            continue
        above = labels[node.parent] if node.parent else ROOT
        total["step", node.tag, above, label] += 1
        total["step", "*", above, label] += 1
        for f in own:
            total["shows", f, -1, label] += 1
        total["shows", "*", -1, label] += 1


# Words of class, id and role names that the labelled pages below use for either label.
CONTENT_WORDS = "article body content entry main post story text".split()
NOISE_WORDS = ("ad ads advert advertisement alert author-bio banner bar breadcrumb breadcrumbs byline cart cloud comment comments "
               "consent contact cookie copyright disclaimer discussion disqus foot footer form gdpr head header language links "
               "login masthead menu meta modal nav navbar navigation newsletter notice overlay pager pagination paywall "
               "popular popup privacy promo promoted promotion rail recommended related replies reply search share sharing "
               "side sidebar signup skip social sponsor sponsored subscribe tags teaser toc toolbar topbar trending widget").split()


def labelled_pages() -> Iterator[str]:
    """Built-in pages with ``data-label`` marks, by rule: every content name with every noise name, in a few layouts."""
    sentence = "A sentence of plain words stands here to fill the line, as in any text. "
    for content in CONTENT_WORDS:
        for k, noise in enumerate(NOISE_WORDS):
            links = "<ul>" + "<li><a href=/x>Short link</a></li>" * (3 + k % 4) + "</ul>"
            words = f"<p>{sentence * (1 + k % 3)}</p>"
            inner = links if k % 2 else words
            paragraphs = "".join(f"<p>{sentence * (1 + (k + j) % 5)}</p>" for j in range(3 + k % 3)) + "<p>Short.</p>"
            listed = f"<ul><li>{sentence}</li><li>Point</li></ul>" if k % 3 == 0 else ""
            table = "<table><tr><td>Cell</td><td>12</td></tr></table>" if k % 5 == 0 else ""
            body = f"<h1>Title</h1>{paragraphs}<h2>Part</h2>{listed}<blockquote>{words}</blockquote>{table}<pre>code = 1</pre>"
            head = f"<h{2 + k % 3}>Heading</h{2 + k % 3}>" if k % 4 < 3 else ""
            for tag in ("div", "section"):
                around = f"<{tag} data-label=0 class={noise}>{head}{inner}</{tag}>"
                yield f"{around}<{tag} data-label=1 class={content}>{body}{around}{paragraphs}</{tag}>{around}"
                yield f"<div data-label=0 class=wrapper>{around}<{tag} data-label=1 id={content}>{body}</{tag}></div>{around}"
            bare = re.sub(r"<(h1|h2|p|ul|blockquote|table|pre)>", r"<\1 data-label=1>", body)
            yield f"{around}{bare}{around}{sentence * 2}<div data-label=0 class={noise}>{links}</div>"


class Model:
    """Smoothed log potentials from counts, and marginals by sum-product on a page's tree."""

    def __init__(self, counts: Counter):
        self.counts = counts
        self.steps: dict[str, list[list[float]]] = {}
        self.shown: dict[str, list[float]] = {}

    def step(self, node: Node) -> list[list[float]]:
        """log P(label | parent's label) of an element of this kind, backed off to all kinds."""
        own = self._step(node.tag)
        return own if node.parent else [own[ROOT], own[ROOT]]

    def _step(self, tag: str) -> list[list[float]]:
        got = self.steps.get(tag)
        if got is None:
            c = self.counts
            got = []
            for above in (0, 1, ROOT):
                all_ = [c["step", "*", above, y] + 1 for y in (0, 1)]
                own = [c["step", tag, above, y] + 4 * all_[y] / sum(all_) for y in (0, 1)]
                got.append([log(x / sum(own)) for x in own])
            self.steps[tag] = got
        return got

    def shows(self, feature: str) -> list[float]:
        """log P(feature | label), 0 for both if it was never seen."""
        got = self.shown.get(feature)
        if got is None:
            c = self.counts
            n = [c["shows", feature, -1, y] for y in (0, 1)]
            got = [log((n[y] + 0.5) / (c["shows", "*", -1, y] + 1)) if sum(n) else 0.0 for y in (0, 1)]
            self.shown[feature] = got
        return got

    def marginals(self, page: Page) -> list[float]:
        """P(content) of every node given all nodes' features."""
        nodes, n = page.nodes, len(page.nodes)
        local = [[sum(v) for v in zip(*map(self.shows, own))] for own in all_features(page)]
        for k, node in enumerate(nodes):
            if node.dropped or node.parent < 0:
                local[k] = [0.0, -1e9]  # the page itself, and what never holds article text
        up = [[0.0, 0.0] for _ in range(n)]  # each node's message to its parent
        inside = [list(v) for v in local]
        for k in range(n - 1, 0, -1):
            step = self.step(nodes[k])
            up[k] = [_sum2(step[y][0] + inside[k][0], step[y][1] + inside[k][1]) for y in (0, 1)]
            above = inside[nodes[k].parent]
            above[0] += up[k][0]
            above[1] += up[k][1]
        down = [[0.0, 0.0] for _ in range(n)]  # the message from the rest of the tree
        out = [0.0] * n
        for k in range(1, n):
            p = nodes[k].parent
            rest = [down[p][y] + inside[p][y] - up[k][y] for y in (0, 1)]
            step = self.step(nodes[k])
            down[k] = [_sum2(rest[0] + step[0][y], rest[1] + step[1][y]) for y in (0, 1)]
            a, b = (down[k][y] + inside[k][y] for y in (0, 1))
            out[k] = 1 / (1 + exp(min(700.0, max(-700.0, a - b))))
        return out

    def extract(self, html: str) -> str:
        """The page's content blocks: white space inside a block as one space, blocks parted by an empty line."""
        page = Page(html)
        keep = [m > 0.5 for m in self.marginals(page)]
        blocks = (" ".join("".join([text for node, text in run if keep[node]]).split()) for run in page.blocks)
        return "\n\n".join([b for b in blocks if b])


def _sum2(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    high, low = (a, b) if a > b else (b, a)
    return high + (log(1 + exp(low - high)) if low - high > -40 else 0.0)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Model:
    """Counts of the built-in pages and of about ``most`` pages of ``page_id, html``, picked by a hash of the id.

    A page teaches only where its own markup labels it. The driver gets the sample's counts, not its pages.
    """
    counts: Counter = Counter()
    for html in labelled_pages():
        count_page(Page(html), counts)
    total = max(1, pages.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for part in slices(batches, "html"):
            for html in part["html"].to_pylist():
                count_page(Page(html or "", marks=False), found)
        rows = list(found.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0][0] for r in rows], pa.string()), pa.array([r[0][1] for r in rows], pa.string()),
             pa.array([r[0][2] for r in rows], pa.int32()), pa.array([r[0][3] for r in rows], pa.int32()),
             pa.array([r[1] for r in rows], pa.int64())], names=["kind", "what", "state", "label", "n"])

    share = min(1_000_000, 1_000_000 * most // total + 1)
    sample = pages.filter(F.expr("pmod(xxhash64(page_id), 1000000L)") < share).dropDuplicates(["page_id"]).select("html")
    summed = sample.mapInArrow(run, "kind string, what string, state int, label int, n long").groupBy(
        "kind", "what", "state", "label").agg(F.sum("n").alias("n"))
    for r in summed.collect():
        counts[r["kind"], r["what"], r["state"], r["label"]] += r["n"]
    return Model(counts)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null html counts as empty and gives empty text; null ids and urls stay; repeated rows are extracted each; an empty
    table gives an empty result; other columns are ignored.
    """
    source = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("html", F.col("html").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(train(source).counts)
    names = ["page_id", "url", "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value)
        for part in slices(batches, "html"):
            texts = [model.extract(t) if t else "" for t in part["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=names)

    kinds = {c: source.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
