"""Main text of web pages by line-block distribution.

Markup is stripped into lines: a line is the text of a block element, and lines know whether
they stand in an article. Scripts, styles, forms, menus, headers, footers, sidebars, notices,
adverts, comments and hidden elements give no line. The lengths of the lines are then summed
over sliding windows: a text begins at a surge point, where the sums rise above a level, and ends
at a dive point, where they fall to nearly nothing. A line of an article weighs as much as the
level, so short headings and last paragraphs belong to it; a line outside articles that is mostly links
weighs nothing, so a menu without any mark starts no text. All runs and short gaps between them are
kept; where the page marks articles, all lines from the first to the last of theirs are one run.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the level its sum must pass at the surge point.
WINDOW = 3
SURGE = 80
DIVE = 20
#: Share of a line's characters in links from which it counts as a line of links.
LINKED = 0.6
#: A part with an unwanted class is the wrapper of the page if it holds this many times the text beside it.
WRAPPER = 10

# Elements by their role, and words of classes, ids and roles of unwanted parts.
RAW = "script style noscript template svg math iframe object select option textarea button title canvas audio video map"
PARTS = "nav footer aside form menu dialog fieldset header"
ARTICLES = "article main"
BLOCKS = (
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption legend dialog"
)
VOID = "area base br col embed hr img input link meta param source track wbr"
UNWANTED = (
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related "
    "replies respond share sharing sidebar signup social sponsor sponsored subscribe tags teaser toolbar widget"
)
#: Unwanted words that can also say what a text is about, and words that say nothing about it. A part whose class
#: holds one of the first and any word but the second (`login guide`, `social-science`) is left out only if
#: it is short or dense in links.
TOPICS = frozenset("header login menu navigation share sharing signup social tags toolbar".split())
LAYOUT = frozenset(
    "area bar block bottom box button buttons col column container content desktop fixed global group icon icons inline inner "
    "item items left link links list main media mobile outer panel primary right row secondary section site small sticky top unit "
    "wrap wrapper".split()
)
#: Elements whose end tag may be missing, and the start tags that end them; the end of what holds them does, too.
ENDED_BY = {
    "p": frozenset(BLOCKS.split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "tr": frozenset("tr tbody tfoot".split()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HOLDERS = frozenset("div section body td th center aside".split())
_RAW, _PARTS, _ARTICLES, _BLOCKS, _VOID, _UNWANTED = (frozenset(x.split()) for x in (RAW, PARTS, ARTICLES, BLOCKS, VOID, UNWANTED))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|\Z)|</?\Z",
    re.DOTALL,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
#: Compound names in which an unwanted word only says what stands beside the text, or what the text is about.
_BESIDE = re.compile(r"(?:^|[\s\"'])(?:has|with|without|no|not|is|page|post|entry|article|content)[-_][\w-]*|\w+[-_](?:price|prices|value)\b", re.IGNORECASE)


def _named(attributes: str) -> bool:
    """Whether a class, id or role names an unwanted part."""
    return any(_UNWANTED & set(_WORD.findall(_BESIDE.sub(" ", x).lower())) for x in _NAMES.findall(attributes))


def _about(attributes: str) -> bool:
    """Whether the unwanted words of a class, id or role may be the subject of a text."""
    found = {word for x in _NAMES.findall(attributes) for word in _WORD.findall(_BESIDE.sub(" ", x).lower())}
    return found & _UNWANTED <= TOPICS and bool(found - _UNWANTED - LAYOUT)


def _unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is one of the parts that are left out. An article's own header stays."""
    if name in _PARTS:
        return not (name == "header" and inside)
    if not attributes or name in ("body", "html") or name in _ARTICLES:
        return bool(attributes) and name == "article" and _named(attributes)
    return bool(_HIDDEN.search(attributes)) or name not in HEADINGS and _named(attributes)


def _is_prose(part: str) -> bool:
    """Whether the text of a part is neither short nor dense in links."""
    lines = _lines(part, {0})[0]
    size = sum(len(line) for line, *_ in lines)
    return size > SURGE and sum(len(line) * share for line, _, _, share in lines) < size * LINKED / 2


def lines_of(page: str) -> list[tuple[str, int, int, float]]:
    """(text, number of the article or 0, number of the innermost holder, share in links) of each block with text, in order.

    A part left out for its class is a wrapper, and is kept, if the lines beside it are no text (up to the surge
    level, without links) or it holds `WRAPPER` times as much; where lines of an article are left, no other part is. A part whose class may be its subject is kept if it is prose.
    """
    kept: set[int] = set()
    while True:
        lines, parts = _lines(page, kept)
        prose = {a for a, b, about in parts if about and _is_prose(page[a:b])}
        if prose:
            kept |= prose
            continue
        if not parts or any(article for _, article, *_ in lines):
            return lines
        size, begin = max((sum(len(line) for line, *_ in _lines(page[a:b], {0})[0]), -a) for a, b, _ in parts)
        rest = sum(len(line) for line, _, _, share in lines if share < LINKED)
        if size <= max(SURGE, rest if rest <= SURGE else WRAPPER * rest):
            return lines
        kept.add(-begin)


def _lines(page: str, kept: set[int]) -> tuple[list[tuple[str, int, int, float]], list[tuple[int, int, bool]]]:
    """Lines, and the parts left out for their class; those that begin at `kept` are not left out.

    A part is (begin, end, whether its class may be its subject).
    """
    out: list[tuple[str, int, int, float]] = []
    parts: list[tuple[int, int, bool]] = []
    text: list[str] = []
    articles, open_articles, article = 0, [], 0
    holders, holder, named, about = 0, [("", 0)], -1, False
    link, linked = False, 0
    skip, depth, inner, place = "", 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, article, holder[-1][1], min(1.0, linked / len(line))))
            text.clear()
            linked = 0

    for token in _TOKEN.finditer(page):
        if not skip:
            text.append(page[place : token.start()])
            linked += len(html.unescape(text[-1]).strip()) if link else 0
        place = token.end()
        name = (token[2] or token[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(token[1] or token[4]), token[3] or ""
        if skip:
            # raw text ends at its own end tag only; another part ends at an article, too, as its own end may be missing
            ended = False
            if skip in ENDED_BY:
                if not closing and not inner and name in ENDED_BY[skip]:
                    ended = True
                elif name in _BLOCKS and name not in _VOID and name not in ENDED_BY:
                    ended = closing and not inner
                    inner += 0 if ended else -1 if closing else 1
                elif closing and name == skip and not inner:
                    depth = 0
            elif name == skip:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
            if depth and not ended and not (name in _ARTICLES and not closing and skip not in _RAW and not _unwanted(name, attributes, False)):
                continue
            if named >= 0:
                parts.append((named, token.start(), about))
            skip, named = "", -1
            if not depth:
                continue
            depth = 0
        if not closing and name not in _VOID and not attributes.endswith("/") and (
            name in _RAW or token.start() not in kept and _unwanted(name, attributes, bool(open_articles))
        ):
            if name in _BLOCKS or name in _RAW:
                close()
            skip, depth, inner = name, 1, 0
            if name not in _RAW and name not in _PARTS and name not in _ARTICLES and not _HIDDEN.search(attributes):
                named, about = token.start(), _about(attributes)
            continue
        if name == "a":
            link = not closing
        elif closing and name in _BLOCKS:
            link = False  # its own end may be missing
        if name == "br" or name in ("td", "th"):
            text.append(" ")
        if name in _BLOCKS:
            close()
        if name in _ARTICLES:
            if not closing:
                articles += 1
                open_articles.append((name, articles))
            elif any(x == name for x, _ in open_articles):
                while open_articles.pop()[0] != name:
                    pass
            article = open_articles[-1][1] if open_articles else 0
        if name in HOLDERS:
            if not closing:
                holders += 1
                holder.append((name, holders))
            elif any(x == name for x, _ in holder):
                while holder.pop()[0] != name:
                    pass
    if not skip:
        text.append(page[place:])
    elif named >= 0:
        parts.append((named, len(page), about))
    close()
    return out, parts


def _runs(weights: list[int]) -> list[tuple[int, int]]:
    """First line and last but one of each run from a surge to a dive point; gaps of up to a window are closed.

    A page whose windows all stay below the surge level has its surge where its fullest window is.
    """
    sums = [sum(weights[i : i + WINDOW]) for i in range(len(weights))]
    surge = min(SURGE, max(sums, default=0))
    dive = min(DIVE, surge)
    runs: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        if sums[i] < surge:
            i += 1
            continue
        begin = i
        while i < len(sums) and sums[i] >= dive:
            i += 1
        # the window reaches ahead: the surge is at the first of its lines that is no short one
        begin = next((k for k in range(begin, min(begin + WINDOW, i)) if weights[k] >= dive), begin)
        if runs and begin - runs[-1][1] <= WINDOW:
            begin = runs.pop()[0]
        runs.append((begin, i))
    return runs


def main_text(page: str | None) -> str:
    """Main text, blocks joined by newlines; empty if the page has none."""
    lines = lines_of(page or "")
    marked = [i for i, (_, article, *_) in enumerate(lines) if article]
    weights = [0 if share >= LINKED else len(line) for line, _, _, share in lines]
    if marked:
        for i in range(marked[0], marked[-1] + 1):
            weights[i] = max(weights[i], SURGE)
    out, done = [], 0
    for begin, end in _runs(weights):
        # short blocks around a run belong to it if they stand in the same holder as its edge and are no links
        if end <= done:
            continue
        begin = max(begin, done)
        while begin > done and lines[begin - 1][2] == lines[begin][2] and weights[begin - 1]:
            begin -= 1
        while 0 < end < len(lines) and lines[end][2] == lines[end - 1][2] and weights[end]:
            end += 1
        out += [line for line, *_ in lines[begin:end]]
        done = max(done, end)
    return "\n".join(out)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have an empty text. Pages that end in the middle of a tag lose that tag.
    Null ids and repeated rows are rows like any other; other columns are ignored.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
