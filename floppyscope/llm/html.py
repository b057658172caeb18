"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. Lines that their markup tells to
be menus, headers, footers, adverts, comments and the like are taken out, and lines outside
article and main, where a page has them. Each line left weighs the length of its text, or
nothing if most of that is links. Weights are summed over a sliding window of lines; where the
sum surges over the threshold a stretch begins, which reaches back over the lines that made it
surge, and where the sum falls to zero (the dive) it ends. The lines between surge and dive are
the text, whatever they weigh; weightless lines at either end of a stretch are not.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from floppyscope.llm.common import in_batches, table

#: Lines in a window.
WINDOW = 3
#: A stretch starts where a window holds this many characters, or this share of the fullest window.
SURGE_CHARS = 86
SURGE_SHARE = 0.25

#: Elements whose content is no text.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "noframes", "xmp"}
#: Elements that never hold the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "select", "button", "fieldset", "head"}
#: Elements that end a line.
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: A start of one of these ends an open p; one of the second list ends an open element of its own kind.
ENDS_P = BLOCK - {"body", "html"}
ENDS_SAME = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Headings weigh their length even if they are links.
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Entries of the stack of open elements that one tag looks through at most.
DEPTH = 64
#: Words of a class, id or role that mark what isn't the article.
MARKS = set(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc "
    "header masthead topbar footer bottombar copyright sidebar sidenav aside rail widget widgets "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup "
    "comment comments commentlist disqus reply replies respond "
    "related recommended share sharing social login search form "
    "complementary contentinfo dialog hidden".split()
)
#: Words that may stand beside such a word in a name; beside any other word it marks nothing,
#: so that "article-header" or "search-results" stay.
BESIDE = set(
    "a the site page main global primary secondary top bottom left right upper lower inner outer fixed sticky mobile desktop "
    "box bar container wrapper wrap block area list section panel region zone slot item items unit group links link buttons button "
    "post entry reader user all more new js is has".split()
)
#: Parts of an article, whose head and foot may be its own.
OWN = {"post", "entry"}
OWN_MARKS = {"header", "footer"}

_TAG = r"</?[a-zA-Z][^\s/>]*+(?:[^>=]++|=\s*+(?:\"[^\"]*+\"?|'[^']*+'?|[^\s>]*+))*+>?"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|{_TAG}|[^<]++|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
_WORD = re.compile(r"[a-z0-9]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")


def _marked(tag: str) -> bool:
    """Whether the attributes of a start tag say that this isn't the article."""
    at = _NAME.match(tag).end()
    for name, *values in _ATTRIBUTE.findall(tag, at):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and _NO_DISPLAY.search(value):
            return True
        if name in ("class", "id", "role"):
            for word in value.split():
                parts = set(_WORD.findall(word))
                marks = parts & MARKS
                if marks and all(p in MARKS or p in BESIDE or p.isdigit() for p in parts) and not (parts & OWN and marks <= OWN_MARKS):
                    return True
    return False


@dataclass(frozen=True)
class Line:
    """A block of a page: its text, the characters of it in links, and where it stands."""

    text: str
    linked: int
    aside: bool
    article: bool
    heading: bool = False


def page_lines(page: str) -> list[Line]:
    """The blocks of a page in order."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, aside, within article
    opened: Counter[str] = Counter()  # elements of the stack by name
    parts: list[str] = []
    linked = links = 0
    aside = article = heading = False
    pos = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, min(linked, len(text)), aside, article, heading))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        for name, _, _ in stack[at:]:
            opened[name] -= 1
        del stack[at:]

    while pos < len(page):
        m = _TOKEN.match(page, pos)
        token, pos = m.group(), m.end()
        if token[0] != "<" or token == "<":
            text = entities.unescape(token)
            parts.append(text)
            if links:
                linked += len(text)
            continue
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                parts.append(token[9:].removesuffix("]]>"))
            continue
        name = _NAME.match(token).group(1).lower()
        if token[1] == "/":
            if name == "a":
                links = max(0, links - 1)
                continue
            if name in BLOCK:
                flush()
                heading = heading and name not in HEADING
            if not opened[name]:
                continue
            if name in BLOCK:
                at = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            else:  # an inline end tag never closes the blocks around it
                at = -1
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[k][0] in BLOCK:
                        break
                    if stack[k][0] == name:
                        at = k
                        break
            if at >= 0:
                if stack[at][1] != aside:
                    flush()
                aside, article = (stack[at - 1][1], stack[at - 1][2]) if at else (False, False)
                close(at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        closed = token.endswith("/>")
        if name in RAW:
            if not closed:  # up to its end tag, whatever stands there
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, pos)
                pos = end.start() if end else len(page)
            parts.append(" ")
            continue
        if name == "a":
            links += 1
            continue
        if name in BLOCK:
            flush()
            links = 0
            heading = name in HEADING
            ends = name if name in ENDS_SAME and opened[name] else "p" if name in ENDS_P and opened["p"] else ""
            if ends:
                for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                    if stack[k][0] == ends:
                        close(k)
                        break
                    if stack[k][0] in (BLOCK if ends == "p" else ENDS_SAME[name]):
                        break
            aside, article = stack[-1][1:] if stack else (False, False)
        if closed and name not in BLOCK:
            continue
        if name in ("article", "main") and stack and stack[-1][0] in ("nav", "ul", "li") and not article:
            close(0)  # a menu that was never closed
            aside = False
        away = aside or name in ASIDE or _marked(token) and name not in ("html", "body", "main")
        if away != aside:
            flush()
        aside, article = away, article or name in ("article", "main")
        if name in BLOCK or away:
            stack.append((name, aside, article))
            opened[name] += 1
    flush()
    return lines


def stretches(weights: list[int], surge: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of lines between surge and dive points of the windowed sums."""
    n = len(weights)
    total = [0, *accumulate(weights)]
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    surge = min(surge, SURGE_SHARE * max(sums, default=0))
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if sums[i] and sums[i] >= surge:
            start = i
            while start > (out[-1][1] if out else 0) and sums[start - 1]:
                start -= 1
            end = i
            while end < n and sums[end]:
                end += 1
            out.append((start, end))
            i = end
        i += 1
    return out


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The text of the article of a page; empty for a null or empty page.

    A stretch starts where a window holds SURGE_CHARS characters, or SURGE_SHARE of what the
    fullest window of the page holds, if that is less.
    """
    lines = [line for line in page_lines(page or "") if not line.aside]
    if any(line.article for line in lines):
        lines = [line for line in lines if line.article]
    weights = [0 if 2 * line.linked > len(line.text) and not line.heading else len(line.text) for line in lines]
    kept = []
    for a, b in stretches(weights, SURGE_CHARS, window):
        filled = [i for i in range(a, b) if weights[i]]
        kept += [line.text for line in lines[filled[0] : filled[-1] + 1]]
    return "\n\n".join(kept)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    One Arrow pass without a shuffle; whole pages, however long. Null html gives the empty
    text, a null page_id or url stays null, repeated rows come out as often as they went in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return in_batches(pages.select("page_id", "url", "html")).mapInArrow(run, SCHEMA)


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
