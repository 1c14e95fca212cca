"""Main text of web pages by tag-path ratios.

A page is scanned once into text blocks, each with its tag path from the root to the
block element that holds the text (names and classes). Per path, text length, punctuation, linked
text and number of blocks are aggregated. A path's ratios are its text, its
punctuation marks, and its unlinked share, over its blocks. The first two are smoothed over
neighbouring blocks in page order, and all are fused by product. What markup says of itself
(nav, footer, aside, form; a class, id or role that is wholly a name such as `ad` or
`comments`) is one more factor, `DOUBT`, which takes a path below the lower threshold: reader
comments and notices are prose whose ratios are those of an article.

Two thresholds come from the page's own scores. Blocks above the upper one are content
nodes, and the deepest element that holds nearly all of their weight is the content's root;
text under an article or main element weighs more. Inside the root a block goes only if
its score is below the lower threshold and its path is doubtful: named as something else, or
mostly links. All else in the root is text, short blocks, tables and lists too. An h1
right before the root is its title.

Every step is linear in the page: open paragraphs, items, scopes and paths are carried
from element to element and never searched for.

Defined results: null or empty html, and pages without content (all links, or all doubtful), give ""; hidden elements, scripts,
styles and the like hold no text; markup may be unclosed, misnested or cut off
anywhere; an attribute's quote that never closes ends at the next >; character
references are decoded; white space inside a block becomes one space and empty blocks are left
out; equal pages get equal texts; an empty table gives an empty table; extra columns are kept if
named in `keep`, and a result column replaces a kept column of the same name.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm.common import arrow_map

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Never text.
DROPPED = frozenset("head button select option object audio video canvas".split()) | RAW
#: An open <p> ends where one of these begins.
ENDS_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option optgroup legend".split())
SCOPES = frozenset("table ul ol dl select html body article section main div td th".split())
#: Open items by group, and the elements inside which none of the group is open yet.
ITEM = {"li": "li", "dt": "d", "dd": "d", "td": "cell", "th": "cell", "tr": "row", "thead": "rows", "tbody": "rows", "tfoot": "rows", "option": "option"}
#: What an item closes: the first of these groups that is open.
CLOSES = {"li": ("li",), "d": ("d",), "cell": ("cell",), "row": ("row", "cell"), "rows": ("rows", "row", "cell"), "option": ("option",)}
FRESH = {"ul": ("li",), "ol": ("li",), "menu": ("li",), "dl": ("d",), "table": ("cell", "row", "rows"), "select": ("option",)}

# What elements, and whole classes, ids or roles, say of themselves.
DOUBTED = frozenset("nav footer aside form menu dialog".split())
DOUBTED_NAMES = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored promo cookie-notice cookie-banner gdpr popup modal nav navbar breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comments comment comment-list commentlist comments-area disqus newsletter signup login pagination pager complementary contentinfo navigation notice".split())
#: Factors of doubtful markup, and of text under an article or main element in the root's choice.
DOUBT, ARTICLE = 0.04, 2.0
LOWER, UPPER, MOST = 0.1, 0.5, 0.9
LINKED = 0.5
KERNEL = (0.1, 0.2, 0.4, 0.2, 0.1)

_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
_SPACE = re.compile(r"\s+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，！？¿¡]")


class Element:
    __slots__ = ("name", "parent", "path", "out", "article", "doubt", "linked", "p", "items", "scope", "open", "depth")

    def __init__(self, name: str, parent: Element | None, path: int):
        self.name, self.parent, self.path = name, parent, path
        self.out = self.article = self.doubt = self.linked = False
        self.p: Element | None = None  # the open paragraph
        self.items: dict[str, Element] = {}  # the open item of each group
        self.scope: Element = self  # the nearest element that end tags of inline elements don't cross
        self.open: Counter = Counter()  # of a scope: inline elements open in it
        self.depth = 0


@dataclass
class Block:
    element: Element
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _marks(attrs: str) -> tuple[list[str], bool, bool]:
    """Classes; whether a class, id or role names something other than text; whether it is hidden."""
    classes: list[str] = []
    doubt = hidden = False
    for m in _ATTR.finditer(attrs):
        value = next((v for v in m.groups()[1:] if v is not None), "")
        name = m[1].lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(_HIDES.search(value))
        elif name in ("class", "id", "role"):
            words = value.lower().split()
            doubt |= any(w in DOUBTED_NAMES for w in words)
            if name == "class":
                classes = words
    return classes, doubt, hidden


def _tag_end(page: str, pos: int, gone: set[str]) -> int:
    """Where the tag whose name ends at pos ends: at the first > outside quotes. Quotes that never close don't count;
    gone remembers which of them occur no more."""
    while True:
        gt = page.find(">", pos)
        if gt < 0:
            return len(page)
        quotes = [q for q in (page.find('"', pos, gt), page.find("'", pos, gt)) if q >= 0]
        if not quotes:
            return gt
        at = min(quotes)
        if page[at] in gone or page[at - 1] not in "= \t\n\r\f":  # only a value begins with a quote
            pos = at + 1
            continue
        close = page.find(page[at], at + 1)
        if close < 0:
            gone.add(page[at])
        pos = close + 1 if close >= 0 else at + 1


def scan(page: str) -> list[Block]:
    """Text blocks in page order."""
    paths: dict[tuple[int, str], int] = {}
    top = Element("", None, 0)
    at, blocks = top, []
    current: Block | None = None
    opened: Counter = Counter()
    gone: set[str] = set()
    ends: dict[str, re.Pattern] = {}

    def close(e: Element) -> None:
        """Leave e and all in it."""
        nonlocal at
        while True:
            opened[at.name] -= 1
            at.scope.open[at.name] -= 1
            last, at = at, at.parent
            if last is e:
                return

    def add(raw: str) -> None:
        nonlocal current
        if at.out:
            if not raw.isspace():
                current = None
            return
        if current is None:
            if not raw or raw.isspace():
                return
            current = Block(at)
            blocks.append(current)
        text = html_module.unescape(raw) if "&" in raw else raw
        current.parts.append(text)
        if at.linked:
            current.linked += len("".join(text.split()))

    pos, size = 0, len(page)
    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            pos = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            add(html_module.escape(page[lt + 9 : size if end < 0 else end], quote=False))
            pos = size if end < 0 else end + 3
            continue
        m = _NAME.match(page, lt + 1)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                pos = size if end < 0 else end + 1
            else:  # a bare <
                add("<")
                pos = lt + 1
            continue
        name = m[2].lower()
        gt = _tag_end(page, m.end(), gone)
        attrs, pos = page[m.end() : gt], gt + 1
        if m[1]:  # an end tag
            if name == "br":
                add(" ")
                continue
            if name in BLOCK:
                current = None
                known = opened[name] > 0
            else:
                known = at.scope.open[name] > 0
            if known:
                e = at
                while e.name != name:
                    e = e.parent
                close(e)
            continue
        if name in ("br", "wbr"):
            add(" " if name == "br" else "")
            continue
        if name in BLOCK:
            current = None
        if name in VOID:
            continue
        if name in RAW:  # its content is not markup
            if attrs.endswith("/") and name in ("svg", "math", "iframe"):
                continue
            if name not in ends:
                ends[name] = re.compile(f"</{name}(?=[\\s/>])", re.I)
            end = ends[name].search(page, pos)
            gt = page.find(">", end.start()) if end else -1
            pos = size if gt < 0 else gt + 1
            continue
        if name in ENDS_P and at.p is not None:  # an open p ends here, with what it holds
            close(at.p)
        group = ITEM.get(name)
        if group:
            for g in CLOSES[group]:
                if g in at.items:
                    close(at.items[g])
                    break
        classes, doubt, hidden = _marks(attrs) if attrs and not attrs.isspace() else ([], False, False)
        step = name + "".join("." + c for c in classes)
        e = Element(name, at, paths.setdefault((at.path, step), len(paths) + 1))
        e.depth = at.depth + 1
        e.out = at.out or name in DROPPED or hidden
        e.article = at.article or name in ("article", "main")
        # a header inside the article holds its title; one outside is the site's
        e.doubt = at.doubt or doubt and name not in ("html", "body", "article", "main") or name in DOUBTED or name == "header" and not at.article
        e.linked = at.linked or name == "a"
        e.scope = e if name in SCOPES else at.scope
        e.p = e if name == "p" else None if name in SCOPES else at.p
        e.items = at.items
        if group or name in FRESH:
            e.items = {g: x for g, x in at.items.items() if g not in FRESH.get(name, ())}
            if group:
                e.items[group] = e
        opened[name] += 1
        e.scope.open[name] += 1
        at = e
    for b in blocks:
        b.text = _SPACE.sub(" ", "".join(b.parts)).strip()
        # text belongs to the block element around it
        while b.element.name not in BLOCK and b.element.parent is not None and not b.element.parent.out:
            b.element = b.element.parent
    return [b for b in blocks if b.text]


def smoothed(x: np.ndarray) -> np.ndarray:
    return np.convolve(np.pad(x, len(KERNEL) // 2, mode="edge"), KERNEL, mode="valid")


def path_scores(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Each block's fused, smoothed tag-path ratio without its markup's doubt, and its path's linked share."""
    path = np.unique([b.element.path for b in blocks], return_inverse=True)[1]
    number = np.bincount(path)
    length = np.bincount(path, [len(b.text) for b in blocks])
    marks = np.bincount(path, [len(_PUNCT.findall(b.text)) for b in blocks])
    linked = np.minimum(1.0, np.bincount(path, [b.linked for b in blocks]) / np.bincount(path, [len(b.text) - b.text.count(" ") for b in blocks]))[path]
    return smoothed((length / number)[path]) * smoothed((1 + marks / number)[path]) * (1 - linked), linked


def content_root(blocks: list[Block], scores: np.ndarray, upper: float) -> Element:
    """The deepest element that holds nearly all of the content nodes' weight."""
    held: dict[int, float] = {}
    element: dict[int, Element] = {}
    for b, s in zip(blocks, scores.tolist(), strict=True):
        if s >= upper:
            held[id(b.element)] = held.get(id(b.element), 0.0) + len(b.text) * (ARTICLE if b.element.article else 1.0)
            element[id(b.element)] = b.element
    total = sum(held.values())
    # children before parents, each once
    levels: dict[int, list[Element]] = {}
    for e in element.values():
        levels.setdefault(e.depth, []).append(e)
    best: Element | None = None
    for depth in range(max(levels), -1, -1):
        for e in levels.get(depth, []):
            if held[id(e)] >= MOST * total and e.name != "p" and (e.name in BLOCK or e.parent is None):
                best = e
                break
            if e.parent is not None:
                if id(e.parent) not in held:
                    levels.setdefault(depth - 1, []).append(e.parent)
                held[id(e.parent)] = held.get(id(e.parent), 0.0) + held[id(e)]
        if best is not None:
            break
    # the root of an article's text is the article, its heading and short parts included
    e = best
    while e.article and e.name not in ("article", "main"):
        e = e.parent
    return e


def main_text(page: str | None) -> str:
    blocks = scan(page) if page else []
    if not blocks:
        return ""
    plain, linked = path_scores(blocks)
    doubt = np.array([b.element.doubt for b in blocks])
    scores = np.where(doubt, DOUBT * plain, plain)
    if doubt.all():
        return ""
    lower = LOWER * max(float(plain[~doubt].max()), UPPER * float(plain.max()))
    good = scores >= lower
    if not plain.any():  # nothing but links
        return ""
    best = float(scores.max())
    upper = min(best, max(lower, min(float(scores.std()), UPPER * best)))
    root = content_root(blocks, scores, upper)
    seen = {id(root): True, id(None): False}

    def inside(e: Element) -> bool:
        trail = []
        while id(e) not in seen and e is not None:
            trail.append(id(e))
            e = e.parent
        found = e is not None and seen[id(e)]
        seen.update(dict.fromkeys(trail, found))
        return found

    within = [inside(b.element) for b in blocks]
    kept = [w and (g or not d and k < LINKED) for w, g, d, k in zip(within, good.tolist(), doubt.tolist(), linked.tolist(), strict=True)]
    first = kept.index(True) if True in kept else 0
    if first and not within[first - 1] and blocks[first - 1].element.name == "h1" and not doubt[first - 1]:
        kept[first - 1] = True
    return "\n\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Add each page's main text."""

    def make():
        def work(part: pa.RecordBatch) -> list:
            return [[main_text(h) for h in part.column(part.schema.get_field_index(html_col)).to_pylist()]]

        return work

    return arrow_map(pages, html_col, pages.columns if keep is None else keep, T.StructType([T.StructField(text_col, T.StringType())]), make, 4_000_000)
