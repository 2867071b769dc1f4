"""Main text of web pages by tag-path ratios.

Every text block of a page has the path of tags from the root to it. Per path the page's text length and punctuation are summed and
divided by its number of blocks; both ratios are smoothed over neighbouring paths in page order and fused by their product. Paths over
a share of the best fused value are content. The article is the heaviest article element, or the main element where that holds content
beside it; without either, the smallest container that leaves no text on high-ratio paths and no heading outside. All its
blocks are the result, short ones included. Menus, page headers and footers, sidebars, notices, adverts
and reader comments are told by element or by words of class, id and role, wherever they stand. A label or a form is only believed
where it holds neither an article nor a main element nor most of the page's text on high-ratio paths.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_TOKEN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>|<!--.*?(?:-->|\Z)|<[!?][^>]*>""", re.S)
_LABEL = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea select title".split())
ASIDE = frozenset("nav footer aside button dialog menu".split())
MAIN = frozenset("article main".split())
CONTAINERS = frozenset("html body main article section div td table tbody tr center form".split())
BLOCKS = CONTAINERS | ASIDE | frozenset("header h1 h2 h3 h4 h5 h6 p ul ol li dl dt dd blockquote pre figure figcaption hr thead tfoot th caption address details summary fieldset".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOILERPLATE = frozenset(
    "ad ads adv advert advertisement adverts sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer "
    "comment comments disqus reply replies respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended masthead topbar toolbar pagination pager skip copyright legal complementary contentinfo search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = frozenset(".,;:!?…。，،؟")
CONTENT_SHARE = 0.1
PART = 0.5  # several articles side by side are parts of one where they hold at least so much of the heaviest one's text
HOLDS = 0.6  # of a page's high-ratio text: a label on an element that holds so much is not believed
HOLDS_ALL = 0.95  # of a page whose article or main element says where its text is: long comments may hold most of it


class _Node:
    """An element. ``path`` is the number of its tag path, which many elements share."""

    __slots__ = ("tag", "path", "aside", "doubtful", "parent", "weight", "children", "in_main")

    def __init__(self, tag, path, aside, doubtful, parent):
        self.tag, self.path, self.aside, self.doubtful, self.parent, self.weight, self.children = tag, path, aside, doubtful, parent, 0.0, []
        self.in_main = parent is not None and (parent.in_main or parent.tag in MAIN)


def _is_aside(tag: str, attributes: str, parent: _Node) -> bool:
    if tag in ASIDE:
        return True
    if tag == "header":  # a page's header; an article's own one holds its title
        return not (parent.in_main or parent.tag in MAIN)
    return bool(attributes and _HIDDEN.search(attributes))


def _is_doubtful(tag: str, attributes: str) -> bool:
    """Whether an element is an aside by its label, or a form: both may also stand around the article."""
    if tag == "form":
        return True
    if not attributes or tag in MAIN or tag in ("html", "body"):
        return False
    words = {w.lower() for m in _LABEL.finditer(attributes) for w in _WORD.findall(m.group(1) or m.group(2) or m.group(3) or "")}
    return not words.isdisjoint(BOILERPLATE)


def blocks(page: str) -> tuple[_Node, list[tuple[_Node, str]]]:
    """The page's root and its text blocks in order, each with the element it stands in."""
    root = node = _Node("", 0, False, False, None)
    out, text = [], []
    numbers: dict[tuple[int, str], int] = {}  # tag paths by their parent path and last tag
    standing: Counter[str] = Counter()  # open elements by tag
    unclosed: set[str] = set()  # tags without a closing one ahead

    def flush():
        if text:
            block = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if block:
                out.append((node, block))
            text.clear()

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            continue
        if tag == "br":
            text.append(" ")
        if tag in RAW and not closing:
            if not attributes.endswith("/"):
                end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if end is None:
                    unclosed.add(tag)
                at = end.end() if end else (len(page) if tag in ("script", "style") else at)
            continue
        if tag not in BLOCKS:
            continue
        flush()
        if closing:
            if standing[tag]:
                while node.tag != tag:
                    standing[node.tag] -= 1
                    node = node.parent
                standing[tag] -= 1
                node = node.parent
            continue
        if tag in VOID:
            continue
        while node.tag == "p" or node.tag in CLOSES.get(tag, ()):
            standing[node.tag] -= 1
            node = node.parent
        path = numbers.setdefault((node.path, tag), len(numbers) + 1)
        child = _Node(tag, path, node.aside or _is_aside(tag, attributes, node), _is_doubtful(tag, attributes), node)
        node.children.append(child)
        standing[tag] += 1
        node = child
    flush()
    return root, out


def _weigh(root: _Node, found: list[tuple[_Node, str]]) -> float:
    """Length of the text on high-ratio paths; every element's weight is what it holds of that."""
    paths: dict[int, list[float]] = {}
    for node, text in found:
        own = paths.setdefault(node.path, [0, 0, 0])
        own[0] += len(text)
        own[1] += sum(text.count(c) for c in PUNCTUATION)
        own[2] += 1
    raw = [(a / n, (p + 0.1) / n) for a, p, n in paths.values()]

    def smooth(i, k):
        near = [raw[j][k] for j in (i - 1, i + 1) if 0 <= j < len(raw)]
        return 0.8 * raw[i][k] + 0.2 * sum(near) / len(near) if near else raw[i][k]

    fused = {path: smooth(i, 0) * smooth(i, 1) for i, path in enumerate(paths)}
    least = CONTENT_SHARE * max(fused.values())
    elements = list(_elements(root))
    for node in elements:
        node.weight = 0.0
    for node, text in found:
        if fused[node.path] >= least:
            node.weight += len(text)
    for node in reversed(elements):
        if node.parent is not None:
            node.parent.weight += node.weight
    return root.weight


def _elements(root: _Node) -> Iterator[_Node]:
    """All elements, parents before their children."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += reversed(node.children)


def _settle(root: _Node, found: list[tuple[_Node, str]]) -> None:
    """Makes doubtful elements asides, with all they hold, but for those around the article: they hold a main element with text, the
    heaviest article, or a large share of the page's high-ratio text."""
    total = _weigh(root, found)
    marked = [n for n in _elements(root) if n.tag in MAIN and n.weight >= max(1, CONTENT_SHARE * total)]
    around = set()
    articles = [n for n in marked if n.tag == "article"]
    for node in [n for n in marked if n.tag == "main"] + ([max(articles, key=lambda n: n.weight)] if articles else []):
        while node is not None and node not in around:
            around.add(node)
            node = node.parent
    share = HOLDS_ALL if marked else HOLDS
    for node in _elements(root):
        if node.parent is not None and node.parent.aside or node.doubtful and node not in around and node.weight < share * total:
            node.aside = True


def _parts(root: _Node, found: list[tuple[_Node, str]]) -> list[_Node]:
    """The elements whose blocks are the main text."""
    _weigh(root, found)
    marked = [n for n in _elements(root) if n.tag in MAIN and n.weight and not n.aside]
    if marked:
        outer = [n for n in marked if not n.in_main]
        best = max(outer, key=lambda n: n.weight)
        if best.tag == "main":
            inner = max((n for n in marked if n.tag == "article" and n.in_main), key=lambda n: n.weight, default=best)
            return [inner if inner.weight == best.weight else best]
        return [n for n in outer if n.weight >= PART * best.weight]
    headed: Counter[_Node] = Counter(n for n, _ in found if n.tag in HEADINGS)
    for node in reversed(list(_elements(root))):
        if node.parent is not None:
            headed[node.parent] += headed[node]
    node = root
    while True:
        inner = max((c for c in node.children if c.tag in CONTAINERS), key=lambda c: c.weight, default=None)
        if inner is None or inner.weight < node.weight or headed[inner] < headed[node]:
            return [node]
        node = inner


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; empty if the page has none."""
    root, found = blocks(page or "")
    found = [(n, t) for n, t in found if not n.aside]
    if found and any(n.doubtful for n in _elements(root)):
        _settle(root, found)
        found = [(n, t) for n, t in found if not n.aside]
    if not found:
        return ""
    inside = {n for part in _parts(root, found) for n in _elements(part)}
    return "\n\n".join(text for node, text in found if node in inside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; one pass, no shuffle.

    Null, empty and markup-only pages have an empty text. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
