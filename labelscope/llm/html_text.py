"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one per block. A line's weight is the length of its text
that is no link. The weights are summed over a sliding window of lines; where the sums
surge from nothing a region begins, where they dive to nothing it ends, and a region
whose highest sum reaches ``SURGE`` is text.

Tags and class names only shift the weights: a block of the page's frame (menu, footer,
sidebar, form) or one named as an advert, a notice, comments and the like weighs nothing,
and a frame block leaves ``WINDOW`` empty lines; in an article or main part a line weighs
``SURGE`` more, and outside it only ``OUTSIDE`` of its length. What a block holds goes
before its name: where nothing surges, the block whose loss hides most of the text is
weighed as if it had no name, and then the page as if it had no main part. Lines that are
links alone weigh ``SURGE`` in an article, as a paragraph or between lines of text of a
main part, so that an article loses none.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm.common import bound_batches, released, table

WINDOW, SURGE, OUTSIDE = 3, 80, 0.05
#: A block without which nothing surges is text if it holds at least this share of the text in question.
HOLDS = 2 / 3

#: Elements by their part in a page.
HIDDEN = ("head", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "button", "select", "textarea")
CHROME = ("nav", "footer", "aside", "form", "menu", "dialog")
MAIN = ("article", "main")
BLOCKS = (
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "aside",
)
IMPLIED = ("p", "li", "dt", "dd", "td", "th", "tr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Words of a class or id that mark a block that is not article text.
MARKS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb "
    "breadcrumbs sidebar widget widgets footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe "
    "subscription signup comment comments commentlist disqus respond replies reply social share sharing sharebar related recommended recommendations "
    "trending pagination pager login search toolbar skip copyright legal disclaimer alert paywall".split()
)
#: Words that say that a block is the article's own: a name of theirs takes back other names' marks.
OWN = frozenset(("article", "post", "entry", "story", "content"))
#: Marks of what stands beside a text, however short the text is.
BESIDE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo newsletter signup cookie cookies consent gdpr "
    "comment comments commentlist disqus respond replies reply related recommended recommendations trending".split()
)
#: Words before a mark, and behind it in its name, that take it back.
TAKEN_BACK = frozenset(("no", "not", "non", "has", "have", "with", "without", "hide", "is"))
TAKEN_BACK_AFTER = frozenset(("free", "open", "closed", "off", "disabled"))
#: Elements whose lines are a main part's own where they are links alone.
PARAGRAPHS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "dd", "figcaption", "pre", "td"))
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"))

_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*)(/?)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>""")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Line:
    """A block's text, the characters of it that are in links, the number of the main part that holds it (0 for none),
    the marked blocks around it, and whether it is text of a main part though links alone.

    Numbers of blocks that are named as beside the text are negative.
    """

    text: str
    linked: int
    part: int
    marks: tuple[int, ...]
    own: bool = False


class _Open:
    """A marked block that is still open: its name, how deep in elements of that name, and its number."""

    def __init__(self, name: str, number: int):
        self.name, self.number, self.depth = name, number, 1


def lines(html: str) -> list[Line]:
    """The page's lines; empty ones stand for the edges of frame blocks."""
    html = _GONE.sub(" ", html)
    out: list[Line] = []
    parts: list[str] = []
    linked, link = 0, False
    main, seen_main, hidden, depth = 0, False, "", 0
    element, articles, part = "", 0, 0  # the block that text stands in, open articles, the latest main part
    roles: list[tuple[str, int]] = []  # elements with role=main: name and depth
    marks: list[_Open] = []
    gap = [Line("", 0, 0, ())] * WINDOW
    numbers = itertools.count(1)

    def close() -> None:
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            inside = part if main or roles else 0
            out.append(Line(text, min(linked, len(text)), inside, tuple(m.number for m in marks), bool(articles) or element in PARAGRAPHS))
        parts, linked = [], 0

    at = 0
    for tag in _TAG.finditer(html):
        end, name = tag[1] or tag[5], (tag[2] or tag[6]).lower()
        attributes = tag[3] if tag[2] else tag[7]
        text = html[at : tag.start()]
        at = tag.end()
        if hidden:
            if name == hidden:
                depth += -1 if end else 0 if tag[4] else 1
                hidden = hidden if depth else ""
                continue
            if not (name in MAIN and not end and not seen_main):
                continue
            hidden = ""  # what was left open ends where the article begins
        elif text:
            parts.append(text)
            linked += len(text) if link else 0
        if not end and name in HIDDEN:
            close()
            hidden, depth = name, 1
            continue
        if name == "a":
            link = not end
        if name in VOID and name not in BLOCKS:
            continue
        if name in BLOCKS:
            close()
            if name not in VOID:
                element = "" if end else name
            # a paragraph ends where the next block begins or its parent ends
            while marks and marks[-1].name in IMPLIED and name != "br" and not (end and name == marks[-1].name):
                marks.pop()
            if name in MAIN and not end and not seen_main:
                marks.clear()  # a block is no frame that holds the article, or was left open before it
            for k, mark in enumerate(marks):
                if mark.name == name:
                    mark.depth += -1 if end else 0 if tag[4] else 1
                    if not mark.depth:
                        del marks[k:]
                        break
            named = () if end or name in VOID or tag[4] else _named(name, attributes, bool(main or roles), seen_main)
            if named:
                if (name in CHROME or name == "header") and not (main or roles):
                    out += gap
                marks.append(_Open(name, next(numbers) * (-1 if BESIDE.intersection(named) else 1)))
        if name in MAIN:
            seen_main = True
            part += not (end or main or roles)
            if main <= 1:
                out += [*gap, Line("", 0, part, ())]
            main = max(0, main + (-1 if end else 1))
            if name == "article":
                articles = max(0, articles + (-1 if end else 1))
        elif not end and "main" in _roles(attributes):
            part += not (main or roles)
            roles.append((name, 1))
        elif roles and name == roles[-1][0]:
            roles[-1] = (name, roles[-1][1] + (-1 if end else 1))
            if roles[-1][1] == 0:
                roles.pop()
    if not hidden:
        parts.append(re.sub(r"<[a-zA-Z/][^<>]*\Z", "", html[at:]))
    close()
    return out


def _roles(attributes: str) -> set[str]:
    return {w for k, a, b, c in _NAMED.findall(attributes or "") if k.lower() == "role" for w in (a or b or c).lower().split()}


def _named(name: str, attributes: str, inside: bool, seen_main: bool) -> set[str]:
    """The words by which a block is part of the frame or stands beside the text; none for other blocks.

    A name of an own word and no mark takes back the marks of the attribute's other names, but
    for those that stand beside a text; a mark in one name with an own word stands.
    """
    if name in CHROME or (name == "header" and not inside):
        return {name}
    found: set[str] = set()
    if not attributes or name in ("body", "html") or (name in MAIN and not seen_main):
        return found
    for key, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        if key.lower() == "role":
            found |= ROLES.intersection(_WORDS.findall(value.lower()))
            continue
        names = [_said(_WORDS.findall(_HUMP.sub("-", n).lower())) for n in value.split()]
        own = any(n & OWN and not n & MARKS for n in names)
        for said in names:
            found |= said & (BESIDE if own and not said & OWN else MARKS)
        said = set().union(*names)
        if "header" in said and not inside and not said & OWN:
            found.add("header")
    return found


def _said(words: list[str]) -> set[str]:
    """A name's words but for those taken back."""
    around = zip(["", *words], words, [*words[1:], ""], strict=False)
    return {w for before, w, after in around if before not in TAKEN_BACK and not (w in MARKS and after in TAKEN_BACK_AFTER)}


def weights(page: list[Line], lifted: frozenset[int] = frozenset(), main: bool = True) -> np.ndarray:
    """The lines' weights; names of ``lifted`` blocks, and without ``main`` those of main parts, do not count."""
    main = main and any(line.part for line in page)
    out = np.zeros(len(page))
    ends: dict[int, tuple[int, int]] = {}  # first and last line of text of a main part
    for i, line in enumerate(page):
        own = len(line.text) - line.linked
        if own > 0 and lifted.issuperset(line.marks):
            out[i] = (own + SURGE if line.part else own * OUTSIDE) if main else own
            if line.part:
                ends[line.part] = (ends.get(line.part, (i, i))[0], i)
    if main:
        for i, line in enumerate(page):
            if line.text and not out[i] and line.part in ends and lifted.issuperset(line.marks):
                first, last = ends[line.part]
                out[i] = SURGE if line.own or first < i < last else 0
    return out


def regions(lengths: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, end, highest window sum) of the stretches between surge and dive points."""
    if not len(lengths):
        return []
    window = np.ones(WINDOW)
    sums = np.convolve(lengths, window)[: len(lengths)]  # over the line and those before it
    ahead = np.convolve(lengths[::-1], window)[: len(lengths)][::-1]  # and those after it
    up = (ahead > 0) & (sums > 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], up.astype(np.int8), [0]])))
    return [(int(a), int(b), float(ahead[a:b].max())) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _lifted(page: list[Line]) -> frozenset[int]:
    """Blocks whose names do not count, since they hold the text: none while anything surges without them.

    Only blocks inside the main part are asked where there is one, and none that is
    named as beside the text where the main part has text of its own.
    """
    scope = [line for line in page if line.part] or page
    lifted: frozenset[int] = frozenset()
    while True:
        own = scope is not page and any(len(line.text) > line.linked and lifted.issuperset(line.marks) for line in scope)
        if max((r[2] for r in regions(weights(scope, lifted, False))), default=0) >= SURGE:
            return lifted
        held: dict[int, int] = {}
        for line in scope:
            for number in line.marks:
                if number not in lifted and not (own and number < 0):
                    held[number] = held.get(number, 0) + len(line.text) - line.linked
        total = sum(len(line.text) - line.linked for line in scope)
        most = max(held, key=lambda n: (held[n], -abs(n)), default=None)
        if most is None or held[most] < max(SURGE, HOLDS * total):
            return lifted
        lifted |= {most}


def main_text(html: str | None) -> str:
    """The article's blocks in page order, one a line; empty for null or a page without text."""
    if not html:
        return ""
    page = lines(html)
    lifted = _lifted(page)
    for main in (True, False):
        weighed = weights(page, lifted, main)
        found = regions(weighed)
        surging = [r for r in found if r[2] >= SURGE]
        if surging or not main:
            break
    if found and not surging:
        surging = [max(found, key=lambda r: (float(weighed[r[0] : r[1]].sum()), -r[0]))]
    return "\n".join(page[i].text for a, b, _ in surging for i in range(a, b) if page[i].text and lifted.issuperset(page[i].marks))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    A null or empty html, or one without article text, gives an empty text and 0. Null
    ids and urls, repeated rows and their order do not matter; other columns are not
    read; an empty table gives no rows.
    """
    bound_batches(pages.sparkSession, 1000)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(released(extract), "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``pages``."""
    return extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
