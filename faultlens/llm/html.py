"""Main text of web pages by tag-path ratios.

A page becomes blocks, each with the path of tags from the root to it. Text length, punctuation and
link text are aggregated per path, smoothed along the page, fused into one score and thresholded:
the paths that pass select the nodes in which the article lies, and the smallest element that holds
(nearly) all of their text gives the result, without the parts that its markup sets aside.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose text is never the article's. A form is another, unless it holds the article or most of the text.
ASIDE = frozenset("aside button canvas datalist dialog footer head header iframe label menu nav noembed noframes noscript object script search select style svg template textarea title".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
#: Words in a class or id that name such parts.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle alert banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus donate footer "
    "gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification offcanvas overlay pager pagination paywall popup privacy promo promoted promotion recommend recommended "
    "recommendations related replies reply respond search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: A start tag that ends an open element of these names.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
STOPS = frozenset("ul ol dl table body html article section main div select".split())
CAMEL = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、؟।]")


class Element:
    __slots__ = ("tag", "parent", "depth", "hidden", "form", "hint", "main", "path", "paths")

    def __init__(self, tag: str, parent: Element | None, attributes: str) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        # a path is numbered by its parent's number and its last tag: its length costs nothing
        self.paths = parent.paths if parent else {}
        self.path = self.paths.setdefault((parent.path if parent else None, tag), len(self.paths))
        self.hidden, self.form, self.hint, self.main = tag in ASIDE, tag == "form", None, tag in ("article", "main", "h1")
        if attributes and attributes.strip(" /"):
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            style = found.get("style", "").replace(" ", "").lower()
            if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or found.get("role", "").lower() in ROLES:
                self.hidden = True
            if found.get("role") == "main" or found.get("itemprop") == "articleBody":
                self.main = True
            words = {w.lower() for w in CAMEL.findall(found.get("class", "") + " " + found.get("id", ""))}
            if tag not in ("html", "body") and (hit := words & HINTS):
                self.hint = "comment" if hit & COMMENTS else "part"


class Block:
    __slots__ = ("node", "text", "links")

    def __init__(self, node: Element, text: str, links: int) -> None:
        self.node, self.text, self.links = node, text, links


def blocks_of(page: str) -> list[Block]:
    """Blocks of text in page order; white space is one space, references are decoded."""
    root = Element("", None, "")
    node, parts, links, found = root, [], 0, []
    at, link_depth = 0, 0
    opened: dict[str, int] = {}
    size = len(page)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                owner = node
                while owner.parent and owner.tag not in BLOCKS and not owner.hidden:
                    owner = owner.parent
                found.append(Block(owner, text, min(links, len(text))))
            parts, links = [], 0

    def say(raw: str) -> None:
        nonlocal links
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link_depth:
            links += len(text.strip())

    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if page.startswith("<![CDATA[", m.start()):
                say(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        tag = tag.lower()
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if closing:
            if tag == "br":
                parts.append(" ")
                continue
            if not opened.get(tag):  # no such element is open
                if tag in BLOCKS:
                    flush()
                continue
            other = node
            while other.tag != tag:
                other = other.parent
            crossed = node
            breaks = False
            while crossed is not other.parent:
                breaks |= crossed.tag in BLOCKS or crossed.hidden
                crossed = crossed.parent
            if breaks:
                flush()
            while node is not other.parent:
                link_depth -= node.tag == "a"
                opened[node.tag] -= 1
                node = node.parent
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag in ("br", "wbr"):
                parts.append(" " if tag == "br" else "")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in BLOCKS:
            flush()
            up = node
            if tag in ENDS:
                while up.parent and up.tag not in STOPS - ENDS[tag]:
                    if up.tag in ENDS[tag]:
                        last = up
                        up = up.parent
                        while node is not last.parent:
                            link_depth -= node.tag == "a"
                            opened[node.tag] -= 1
                            node = node.parent
                        continue
                    up = up.parent
            else:
                while up.parent and up.tag not in BLOCKS:
                    up = up.parent
                if up.tag == "p":  # a block ends an open paragraph, and the inline elements in it
                    while node is not up.parent:
                        link_depth -= node.tag == "a"
                        opened[node.tag] -= 1
                        node = node.parent
        child = Element(tag, node, attributes)
        if child.hidden and tag not in BLOCKS:
            flush()
        if attributes.endswith("/") and tag in ("svg", "path", "use", "g", "rect", "circle", "math"):
            continue
        node = child
        link_depth += tag == "a"
        opened[tag] = opened.get(tag, 0) + 1
        if child.main and not child.hint and not child.hidden:
            # what holds the article or its heading is no side part, whatever its class says
            up = child.parent
            while up:
                if up.hint == "part":
                    up.hint = None
                if tag != "h1":
                    up.form = False
                up = up.parent
    flush()
    return found


def _marked(node: Element | None, memo: dict[int, bool], mark: Callable[[Element], bool]) -> bool:
    """Whether the node or an element it lies in has the mark."""
    chain = []
    while node and id(node) not in memo:
        chain.append(node)
        node = node.parent
    state = memo[id(node)] if node else False
    for n in reversed(chain):
        state = state or mark(n)
        memo[id(n)] = state
    return state


def _hidden(node: Element, memo: dict[int, bool]) -> bool:
    return _marked(node, memo, lambda n: n.hidden)


def _set_aside(node: Element, memo: dict[int, bool]) -> bool:
    return _marked(node, memo, lambda n: n.hidden or n.form or n.hint is not None)


def _free_forms(blocks: list[Block]) -> None:
    """A form with most of the text is the page's frame."""
    within: dict[int, list] = {}
    for b in blocks:
        node = b.node
        while node:
            if node.form:
                within.setdefault(id(node), [node, 0])[1] += len(b.text)
            node = node.parent
    total = sum(len(b.text) for b in blocks)
    for node, size in within.values():
        if 2 * size > total:
            node.form = False


def _free_hints(blocks: list[Block]) -> None:
    """An element that its class names as an aside, but outside of which the page has no sentence, is the article's wrapper."""
    while True:
        memo: dict[int, bool] = {}
        if any(len(b.text) >= 20 and PUNCTUATION.search(b.text) for b in blocks if not _set_aside(b.node, memo)):
            return
        within: dict[int, list] = {}
        for b in blocks:
            top, node = None, b.node
            while node:
                if node.hint:
                    top = node
                node = node.parent
            if top:
                within.setdefault(id(top), [top, 0])[1] += len(b.text)
        if not within:
            return
        max(within.values(), key=lambda x: x[1])[0].hint = None


def _common(nodes: list[Element]) -> Element:
    """The deepest element that holds all of them."""
    top = nodes[0]
    for node in nodes[1:]:
        while top is not node:
            if top.depth >= node.depth:
                top = top.parent
            else:
                node = node.parent
    return top


def path_scores(blocks: list[Block], spread: int = 2) -> dict[str, float]:
    """Per tag path: text per node times punctuation per node, each smoothed along the page, on a scale without units."""
    length: dict[str, float] = {}
    marks: dict[str, float] = {}
    count: dict[str, int] = {}
    links: dict[str, float] = {}
    for b in blocks:
        p = b.node.path
        length[p] = length.get(p, 0) + len(b.text)
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(b.text))
        links[p] = links.get(p, 0) + b.links
        count[p] = count.get(p, 0) + 1
    paths = [b.node.path for b in blocks]
    weights = [1.0 / (1 + abs(k)) for k in range(-spread, spread + 1)]

    def smooth(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            total = weight = 0.0
            for k, w in zip(range(i - spread, i + spread + 1), weights, strict=True):
                if 0 <= k < len(values):
                    total += w * values[k]
                    weight += w
            out.append(total / weight)
        return out

    ratio = smooth([length[p] / count[p] for p in paths])
    mark = smooth([marks[p] / count[p] for p in paths])
    score: dict[str, float] = {}
    for p, r, m in zip(paths, ratio, mark, strict=True):
        score[p] = score.get(p, 0.0) + r * (1 + m)
    return {p: s / count[p] * (1 - links[p] / length[p]) for p, s in score.items()}


def extract(page: str | None) -> str:
    """The article's blocks, joined by line feeds; empty if there is none."""
    if not page:
        return ""
    memo: dict[int, bool] = {}
    blocks = [b for b in blocks_of(page) if not _hidden(b.node, memo)]
    _free_forms(blocks)
    _free_hints(blocks)
    memo = {}
    blocks = [b for b in blocks if not _set_aside(b.node, memo)]
    if not blocks:
        return ""
    scores = path_scores(blocks)
    mean = sum(scores.values()) / len(scores)
    chosen = [b for b in blocks if scores[b.node.path] >= 0.5 * mean]
    # the deepest element that holds nearly all of the chosen text; an element marked as the article wins
    held: dict[int, list] = {}
    total = 0
    for b in chosen:
        total += len(b.text)
        node = b.node
        while node:
            held.setdefault(id(node), [node, 0])[1] += len(b.text)
            node = node.parent
    if not total:
        return ""
    marked = [(n, size) for n, size in held.values() if n.main and n.tag != "h1"]
    root = max(marked, key=lambda x: (x[1], x[0].depth), default=(None, 0))
    # articles side by side are parts of one text
    ids = {id(n) for n, _ in marked}
    apart = []
    for n, size in marked:
        up = n.parent
        while up and id(up) not in ids:
            up = up.parent
        if up is None:
            apart.append((n, size))
    if len(apart) > 1:
        root = _common([n for n, _ in apart]), sum(size for _, size in apart)
    if root[0] is None or root[1] < 0.25 * total:
        root = max(((n, s) for n, s in held.values() if s >= 0.9 * total), key=lambda x: x[0].depth)
    top = root[0]
    out = []
    for b in blocks:
        node = b.node
        while node and node is not top:
            node = node.parent
        if node is None:
            continue
        if scores[b.node.path] < 0.1 * mean and b.links > 0.6 * len(b.text):
            continue  # lists of links
        out.append(b.text)
    return "\n".join(out)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    pages: page_id, url, html. A null or empty html, or one without an article, gives an empty text;
    markup may be cut off or badly nested; rows that repeat are pages of their own; no rows give no
    rows; other columns are ignored. Needs no shuffle.
    """
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, "page_id long, url string, text string, n_chars long")
