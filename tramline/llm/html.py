"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines: every block element starts one. Lines of menus,
headers, footers, sidebars, notices, adverts, forms, reader comments and of
anything hidden count as blank, by element, role, class or id. Text lengths (without link
texts) are summed over `WINDOW` lines from each line on, where a line inside an `article`
or `main` element weighs `ARTICLE` times. Text surges where such a sum reaches `SURGE`
(on pages of little text half of the page's largest sum, without such an element `SENTENCE` at least) or a whole sentence stands,
and dives where it falls to nothing; everything between a surge and its dive is kept.
So stray short lines and runs of lines that are only links go, inside an article too. Text outside such elements counts only where it surges by itself and is
more than they hold in all, so that a teaser doesn't blank the body. Class words that
name a layout (`_LAYOUT`) don't blank what holds most of a page's text.

Scripts, styles, templates and comments of the markup are never text. Character
references are decoded; white space inside a block becomes one space.

Defined results: a null or empty page, and one without main text, gives an empty
text; unclosed and stray tags are tolerated; nothing is cut by length; repeated
rows each get a result; extra columns are ignored; null page_id and url stay null.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
SURGE = 80
ARTICLE = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_RAW = {
    "script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "select",
    "audio", "video", "noembed", "noframes", "xmp",
}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html",
    "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Blocks whose end tag is often left out: never kept open.
_LOOSE = {"p", "li", "dt", "dd", "tr", "tbody", "thead", "tfoot", "hr", "html", "body"}
_SPACED = {"br", "td", "th", "wbr", "img", "option"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BOILERPLATE = {"nav", "aside", "footer", "form", "menu", "dialog", "head", "button", "header"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar", "alertdialog"}
#: Words in a class or id that mark what is not the article.
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "form", "gdpr", "login", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pagination", "pager",
    "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
}
#: Those of them that often name a wrapper of the whole page.
_LAYOUT = {"sidebar", "search", "header", "footer", "banner", "menu", "nav", "navbar", "navigation", "widget", "form", "share", "social", "toolbar", "skip"}
_STATES = re.compile(r"(?i)^(?:no|has|with|without|not|hide)[-_]|(?:^|[-_])search[-_]results$")
_KEPT_OPEN = {"article", "main"}
#: A line of so many characters that ends like this is a sentence.
SENTENCE = 20
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*$")
#: So many times the strict text, a text without layout marks takes its place.
FAR_MORE = 4


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\r\n") else {}


def _is_boilerplate(tag: str, raw: str, inside: bool, ignored: frozenset[str] = frozenset()) -> bool:
    """inside: within an article, whose own header holds its title. ignored: class words that mark nothing."""
    if tag in _BOILERPLATE and not (tag == "header" and inside):
        return True
    own = _attributes(raw)
    if not own or tag in ("html", "body"):
        return False
    style = own.get("style", "").replace(" ", "").lower()
    if "hidden" in own or "display:none" in style or "visibility:hidden" in style or own.get("role", "").lower() in _ROLES:
        return True
    named = " ".join(x for x in f"{own.get('class', '')} {own.get('id', '')}".split() if not _STATES.search(x))
    words = {w.lower() for w in _PART.findall(named)}
    if tag == "main" or (tag == "article" and not words & {"comment", "comments", "reply", "replies", "ad", "ads", "related", "promo"}):
        return False
    words -= ignored
    return bool(words & _WORDS) or (not inside and "header" in words)


class _Lines:
    """Lines of a page: text, length that counts, whether blank as boilerplate, whether inside an article."""

    def __init__(self) -> None:
        self.done: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.counted = 0

    def add(self, text: str, linked: bool) -> None:
        self.parts.append(text)
        if not linked:
            self.counted += len(text) - text.count(" ")

    def end(self, blank: bool, inside: bool) -> None:
        text = " ".join("".join(self.parts).split())
        # What is cut out of an article doesn't end it.
        if text or (blank and not inside):
            if not (blank and inside):
                self.done.append(("" if blank else text, 0 if blank else self.counted, blank, inside))
        self.parts.clear()
        self.counted = 0


def lines_of(page: str, ignored: frozenset[str] = frozenset()) -> list[tuple[str, int, bool, bool]]:
    out, at = _Lines(), 0
    stack: list[tuple[str, bool]] = []  # open elements: name, boilerplate
    blank = inside = links = 0

    def close(to: int) -> None:
        nonlocal blank, inside
        while len(stack) > to:
            tag, bad = stack.pop()
            blank -= bad
            inside -= tag in _KEPT_OPEN and not bad

    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not blank:
            out.add(references.unescape(text), links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ending, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            links = 0 if ending else 1
        elif tag in _SPACED and not blank:
            out.add(" ", True)
        if not ending and tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in _BLOCK:
            out.end(blank > 0, inside > 0)
            links = 0
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in _VOID or raw.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _BLOCK and stack and stack[-1][0] in ("p", "li"):
            close(len(stack) - 1)  # their end tag is implied
        bad = _is_boilerplate(tag, raw, inside > 0, ignored)
        if tag in _KEPT_OPEN and not bad and blank:
            close(next(k for k, x in enumerate(stack) if x[1]))  # an unclosed menu doesn't swallow the article
        if bad or (tag in _BLOCK and tag not in _LOOSE):
            stack.append((tag, bad))
            blank += bad
            inside += tag in _KEPT_OPEN and not bad
    out.end(blank > 0, inside > 0)
    return out.done


def spans_of(lengths: list[int], threshold: int, window: int = WINDOW, surges: list[bool] | None = None) -> list[tuple[int, int]]:
    """Line spans [surge, dive). surges: lines that are enough for a surge, whatever their length."""
    sums = [sum(lengths[k : k + window]) for k in range(len(lengths))]
    spans, surge = [], None
    for k, total in enumerate(sums):
        if surge is None and (total >= threshold or surges and surges[k]) and lengths[k]:
            # The block that surges starts with the first of its adjoining lines.
            surge = k
            while surge and lengths[surge - 1] and (not spans or surge > spans[-1][1]):
                surge -= 1
        elif surge is not None and not total:
            spans.append((surge, k))
            surge = None
    return [*spans, (surge, len(lengths))] if surge is not None else spans


def _sentence(line: tuple[str, int, bool, bool]) -> bool:
    return line[1] >= SENTENCE and 2 * line[1] >= len(line[0]) - line[0].count(" ") and bool(_SENTENCE_END.search(line[0])) and "©" not in line[0]


def _threshold(lengths: list[int], least: int = SENTENCE) -> int:
    top = max((sum(lengths[k : k + WINDOW]) for k in range(len(lengths))), default=0)
    return max(least, min(SURGE, top // 2))


def _select(lines: list[tuple[str, int, bool, bool]]) -> tuple[str, list[tuple[int, int]]]:
    own = [0 if x[3] else x[1] for x in lines]
    outside = spans_of(own, _threshold(own), surges=[_sentence(x) for x in lines])
    held = sum(x[1] for x in lines if x[3])
    if held >= sum(lines[k][1] for a, b in outside for k in range(a, b) if not lines[k][3]):
        outside = []
    # Marks only weight the lengths; the distribution decides.
    counts = [x[3] or any(a <= k < b for a, b in outside) for k, x in enumerate(lines)]
    lengths = [(ARTICLE if x[3] else 1) * x[1] if c else 0 for x, c in zip(lines, counts, strict=True)]
    spans = spans_of(lengths, _threshold(lengths, 1 if held else SENTENCE), surges=[c and _sentence(x) for x, c in zip(lines, counts, strict=True)])
    return "\n".join(lines[k][0] for a, b in spans for k in range(a, b) if lines[k][0] and counts[k]), spans


def main_text(page: str | None) -> tuple[str, list[tuple[int, int]]]:
    """The main text and the line spans it comes from."""
    lines = lines_of(page or "")
    strict = _select(lines)
    if page and not any(x[3] and x[0] for x in lines):
        loose = _select(lines_of(page, frozenset(_LAYOUT)))
        if len(loose[0]) > max(SURGE, FAR_MORE * len(strict[0])):
            return loose
    return strict


_SPAN = pa.struct([("surge", pa.int64()), ("dive", pa.int64())])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array([x[0] for x in found], pa.string()),
             pa.array([len(x[0]) for x in found], pa.int64()),
             pa.array([[{"surge": a, "dive": b} for a, b in x[1]] for x in found], pa.list_(_SPAN))],
            ["page_id", "url", "text", "n_chars", "spans"],
        )


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, spans (of stripped lines)."""
    slim = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return slim.mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long, spans array<struct<surge:long,dive:long>>"
    )
