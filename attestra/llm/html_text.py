"""Operator 3: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element; each has the length of its text, how
much of it is link text, and the element that holds it.  Elements that are never the page's
text (scripts, styles, forms, navigation, footers, asides, and what is named as an advert,
notice or comment list) leave empty lines.

Lengths without link text are summed over sliding windows of lines.  A passage surges at the
first line from which a window sum reaches ``SURGE`` of the page's largest, and dives where a
sum falls under ``DIVE`` of it.  Elements that hold a line between a surge and its dive are the
page's text: every line of theirs from the first to the last passage is kept, short or long, but for bars of links.
Where a page has ``article`` or ``main`` elements, the distribution is over their lines, and all
of them belong to one passage: nothing that an author marked as the article is left out.

Defined results: a null or empty page, or one without text, gives an empty text; equal rows
are kept; an empty table gives an empty result; pages cut off anywhere are read as far as
they go, and the time for a page grows with its length whatever is in it; other columns are
ignored whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, workers

WINDOW = 3
#: Shares of a page's largest window sum: from where a passage begins, and under which it ends.
SURGE, DIVE = 0.3, 0.1
#: A line of which more than this share is link text is a bar of links.
LINKS = 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"=\s*[\"']|>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_SKIPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
_CLOSES_ITSELF = {"p", "li", "tr", "td", "th", "dt", "dd", "option"}
#: Blocks that belong to the element around them rather than being one that holds lines.
_PARTS = _CLOSES_ITSELF | {"h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "figcaption", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "header"}
_SCOPES = ("article", "main")
#: Whole class, id or role names of elements that hold no text of the page; ``social-science`` or ``no-sidebar`` is none of them.
_NOT_TEXT = {
    "ad", "ads", "advert", "advertisement", "adsense", "sponsored", "promo", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comments", "comment-list", "disqus_thread",
    "cookie", "cookies", "cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "share", "share-buttons", "sharing", "related-posts", "complementary", "contentinfo", "search",
}


@dataclass
class Line:
    text: str = ""
    linked: int = 0  # characters of link text
    holder: int = 0  # the element that holds the line
    scopes: tuple[bool, ...] = (False, False)  # whether it is inside each of _SCOPES

    @property
    def weight(self) -> int:
        return max(0, len(self.text) - self.linked)


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Where the tag ends whose name ends at ``at``: the place after its ``>``, quoted values skipped; -1 if the page ends first."""
    while at <= last[">"]:
        found = _STOP.search(page, at)
        if found is None:
            return -1
        if found[0] == ">":
            return found.end()
        quote = found[0][-1]
        if found.end() > last[quote]:  # a quote without its fellow is a character like others
            at = found.end()
        else:
            at = page.index(quote, found.end()) + 1
    return -1


def lines_of(page: str) -> tuple[list[Line], str | None]:
    """The page as lines, empty ones where text is left out; and which of ``article`` and ``main`` it opens first."""
    lines: list[Line] = []
    parts: list[str] = []
    linked, scope, elements = 0, None, 0
    open_tags: list[tuple[str, bool, int]] = []  # tag, whether it hides what it holds, its number
    depth: Counter[str] = Counter()  # by tag: how many are open
    blocks = [0]  # numbers of the open block elements
    hidden, at = 0, 0
    last = {c: page.rfind(c) for c in ">\"'"}

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                lines.append(Line(text, min(linked, len(text)), blocks[-1], tuple(depth[s] > 0 for s in _SCOPES)))
            linked = 0

    def close(n: int) -> None:
        """Close the open elements from position n on."""
        nonlocal hidden
        before = hidden
        while len(open_tags) > n:
            tag, hides, _ = open_tags.pop()
            depth[tag] -= 1
            hidden -= hides
            if tag not in _INLINE and tag not in _PARTS:
                blocks.pop()
        if before and not hidden:
            lines.extend([Line()] * WINDOW)

    def show(text: str) -> None:
        nonlocal linked
        if not hidden:
            parts.append(text)
            if depth["a"]:
                linked += len(" ".join(text.split()))

    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            show(page[at:])
            break
        if begin > at:
            show(page[at:begin])
        after = page[begin + 1 : begin + 2]
        if after in ("!", "?"):
            comment = page.startswith("<!--", begin)
            end = page.find("-->" if comment else ">", begin + (4 if comment else 2))
            at = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if name is None:  # no tag at all
            if not closing:
                show("<")
            at = begin + 1 + closing
            continue
        at = _tag_end(page, name.end(), last)
        if at < 0:  # cut off inside a tag
            break
        tag = name[0].lower()
        if tag not in _INLINE:
            end_line()
        if closing:
            if depth[tag]:
                k = len(open_tags) - 1
                while open_tags[k][0] != tag:
                    k -= 1
                close(k)
            continue
        attributes = page[name.end() : at - 1]
        alone = attributes.rstrip().endswith("/")
        if tag in _RAW and not alone:
            over = _RAW_END[tag].search(page, at)
            at = over.end() if over else len(page)
            continue
        if tag in _VOID or alone:
            continue
        if tag in _CLOSES_ITSELF and open_tags and open_tags[-1][0] == tag:
            close(len(open_tags) - 1)
        in_scope = any(depth[s] for s in _SCOPES)
        hides = tag in _SKIPPED or (tag == "header" and not in_scope)
        if not hides and attributes and tag not in ("html", "body", *_SCOPES):
            hides = any(word in _NOT_TEXT for a, b, c in _ATTRIBUTE.findall(attributes) for word in (a or b or c).lower().split())
        if tag in _SCOPES and not hidden:
            scope = scope or tag
        elements += 1
        open_tags.append((tag, hides, elements))
        depth[tag] += 1
        if tag not in _INLINE and tag not in _PARTS:
            blocks.append(elements)
        if hides and not hidden:
            end_line()
            lines.extend([Line()] * WINDOW)
        hidden += hides
    end_line()
    return lines, scope


def passages(weights: list[int], window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[tuple[int, int]]:
    """(first, last) of the lines between each surge and its dive.

    The sum at a line is over the window that begins there.  A passage begins at the first line
    with a weight of a window that reaches ``surge`` of the largest sum; it ends before the
    first line whose sum is under ``dive`` of it.
    """
    total, sums = sum(weights[:window]), []
    for k, w in enumerate(weights):
        sums.append(total)
        total += (weights[k + window] if k + window < len(weights) else 0) - w
    most = max(sums, default=0)
    found, begun = [], None
    for k, s in enumerate(sums):
        if begun is None and most and weights[k] and s >= surge * most:
            begun = k
        elif begun is not None and s < dive * most:
            found.append((begun, k - 1))
            begun = None
    if begun is not None:
        found.append((begun, len(weights) - 1))
    return found


def main_lines(lines: list[Line], scope: str | None, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> list[Line]:
    """The lines of the page's text."""
    if scope is not None:
        mine = [x for x in lines if x.scopes[_SCOPES.index(scope)] and x.text]
        if mine:  # one passage, whatever stands between its lines
            return mine
    found = passages([x.weight for x in lines], window, surge, dive)
    if not found:
        return []
    holders = {lines[k].holder for a, b in found for k in range(a, b + 1) if lines[k].weight}
    chosen = [k for k, x in enumerate(lines) if x.text and x.holder in holders and x.linked <= LINKS * len(x.text)]
    return [lines[k] for k in chosen]


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> str:
    lines, scope = lines_of(page or "")
    return " ".join(x.text for x in main_lines(lines, scope, window, surge, dive))


def extract(pages: DataFrame, *, window: int = WINDOW, surge: float = SURGE, dive: float = DIVE) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    storage.prepare_python(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers.begin("html_text")
        for batch in batches:
            texts = [main_text(x, window, surge, dive) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
