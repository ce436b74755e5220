"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of the page; what stands between two containers
is parted by empty lines. A line weighs the characters that are not link text, and every sliding
window of ``WINDOW`` lines the sum of its lines: article text makes the curve surge, menus (links)
and gaps between containers make it dive. The text between surge and dive is kept.

Where the page says where its article is (``article``, ``main``), the heaviest such element holds
the curve's main surge, and surge and dive move out to the element's first and last line: short
paragraphs at either end belong to the article. Elsewhere the container with most of the weight
takes that place, and the curve itself says where the text starts and ends.

Elements that are never article text (menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles, comments), by name, role or class, are taken out as the lines are made.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines that a window has.
WINDOW = 3
#: Characters outside of links that a window has where text surges, at least.
SURGE = 60

RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption section article main header footer nav aside form fieldset hr address details summary body html head center menu dialog noscript template".split())
CONTAINERS = frozenset("div section article main header footer nav aside form ul ol dl table body html head menu dialog fieldset blockquote".split())
SPACED = frozenset("td th img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav aside footer form button select option input label iframe object embed svg canvas audio video menu dialog noscript template map head applet frameset".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or an id that mark what is not article text.
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion cookie cookies cookiebar consent gdpr notice notices notification notifications alert banner popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets footer masthead comment comments commentlist disqus respond replies related recommended recommendations share sharing social".split()
)
#: Beside one of these words a mark says how the page is laid out, not what the element is.
LAYOUT = frozenset("has with no without open closed layout enabled disabled left right full".split())
#: Elements whose end tag may be missing; they end where another block starts or ends.
LOOSE = frozenset("p li dt dd option tr".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][-a-zA-Z]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


def _marked(name: str, attributes: str) -> bool:
    """Whether role, class, id or visibility says that the element holds no article text."""
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for item in value.split():
                words = [w.lower() for w in _WORD.findall(item)]
                told = words[:1] if name == "article" else words  # an article is what its classes' first words say
                if not DROPPED_WORDS.isdisjoint(told) and LAYOUT.isdisjoint(words):
                    return True
        elif key == "role" and value.strip().lower() in DROPPED_ROLES:
            return True
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return name not in ("html", "body", "main", "article")
    return False


def _tokens(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of tags; comments and raw elements as a tag without a name.

    After a tag whose quotes never close, the rest of the page is read without regard to quotes,
    so no page is read more than a few times.
    """
    out, at, quotes = [], 0, True
    while found := _PLAIN_TAG.search(page, at):
        if quotes:
            whole = _TAG.match(page, found.start())
            found, quotes = whole or found, whole is not None
        name, end = (found[2] or "").lower(), found.end()
        if name in RAW and not found[1] and not found[3].endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, end)
            end, name = (close.end() if close else len(page)), ""
        out.append((found.start(), end, bool(found[1]), name, found[3] or ""))
        at = end
    return out


def _closings(tokens: list) -> dict[int, int]:
    """The closing tag of each opening one, by name; without one there is none."""
    open_, out = {}, {}
    for k, (_, _, closes, name, _) in enumerate(tokens):
        if closes:
            if open_.get(name):
                out[open_[name].pop()] = k
        elif name and name not in VOID:
            open_.setdefault(name, []).append(k)
    return out


def _after(tokens: list, k: int, closings: dict[int, int], size: int) -> tuple[int, int]:
    """(next token, next place of the text) after a dropped element: past its end tag, or where one without it is over."""
    name = tokens[k][3]
    if name in VOID:
        return k + 1, tokens[k][1]
    if name not in LOOSE and k in closings:
        return closings[k] + 1, tokens[closings[k]][1]
    for j in range(k + 1, len(tokens)):
        start, end, closes, other, _ = tokens[j]
        if name in LOOSE and closes and other == name:
            return j + 1, end
        if other in BLOCKS if name in LOOSE else other in ("article", "main") or (closes and other in ("body", "html")):
            return j, start
    return len(tokens), size


class Line(NamedTuple):
    """A block's text and its weight."""

    text: str
    weight: int


class Container(NamedTuple):
    """An element with the range of lines that stand in it; the last one is not its own."""

    name: str
    first: int
    end: int


def lines_of(page: str) -> tuple[list[Line], list[Container]]:
    """The page's lines in order, an empty one where a container starts or ends, and the containers."""
    tokens = _tokens(page)
    closings = _closings(tokens)
    lines: list[Line] = []
    inside: list[tuple[str, int]] = []  # names and first lines of the containers that are open
    open_: Counter[str] = Counter()
    containers: list[Container] = []
    text: list[tuple[str, bool]] = []
    links = breaks = at = k = 0

    def flush() -> None:
        told = " ".join(entities.unescape("".join(t for t, _ in text)).split())
        if told:
            linked = " ".join(entities.unescape("".join(t for t, link in text if link)).split())
            lines.append(Line(told, max(0, len(told) - len(linked))))
        text.clear()

    def close() -> str:
        name, first = inside.pop()
        open_[name] -= 1
        containers.append(Container(name, first, len(lines)))
        return name

    while k <= len(tokens):
        start = tokens[k][0] if k < len(tokens) else len(page)
        if at < start:
            piece = page[at:start]
            if not piece.isspace():
                breaks = 0
            text.append((piece, links > 0))
        if k == len(tokens):
            break
        _, at, closes, name, attributes = tokens[k]
        block = name in BLOCKS
        if name == "br":
            breaks += 1
            if breaks > 1:  # two in a row part blocks as two paragraphs do
                flush()
            text.append((" ", links > 0))
        elif name in SPACED:
            text.append((" ", links > 0))
        elif name == "a":
            links = max(0, links + (-1 if closes else 1))
        if block:
            flush()
            breaks = links = 0
            if name in CONTAINERS:
                lines.append(Line("", 0))
        page_header = name == "header" and not open_["article"] and not open_["main"]
        if not closes and (name in DROPPED or page_header or (attributes and _marked(name, attributes))):
            k, at = _after(tokens, k, closings, len(page))
            continue
        if block and name in CONTAINERS:
            if not closes:
                inside.append((name, len(lines)))
                open_[name] += 1
            elif open_[name]:
                while close() != name:
                    pass
        k += 1
    flush()
    while inside:
        close()
    return lines, containers


def _range(lines: list[Line], containers: list[Container]) -> tuple[int, int, bool]:
    """The lines, from first to before end, of the element that holds the article, and whether the page declares it."""
    sums = list(accumulate((line.weight for line in lines), initial=0))
    weight = lambda c: sums[c.end] - sums[c.first]
    for kind in ("article", "main"):
        if own := [c for c in containers if c.name == kind]:
            best = max(own, key=lambda c: (weight(c), c.end - c.first, -c.first))
            return best.first, best.end, True
    # the smallest container that has more than four fifths of the weight
    most = min((c for c in containers if weight(c) * 5 > sums[-1] * 4), key=lambda c: (c.end - c.first, c.first), default=Container("", 0, len(lines)))
    return most.first, most.end, False


def surge_and_dive(weights: list[int], window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """(first, last) line between the first surge and the last dive of the curve; all lines if it never surges.

    The curve's value at a line is the sum of the window that starts there. It surges at the first
    window of ``surge`` or more whose first line weighs anything, and dives after the last line of
    weight in such a window. Windows do not reach over two lines without weight in a row.
    """
    n = len(weights)
    groups, k = [], 0  # runs of lines that no gap parts
    while k < n:
        if not weights[k]:
            k += 1
            continue
        end = last = k
        while end < n and end - last <= 1:
            last = end if weights[end] else last
            end += 1
        groups.append((k, last))
        k = last + 1
    sums = lambda a, b: max(sum(weights[i : min(i + window, b + 1)]) for i in range(a, b + 1))
    high = [(a, b) for a, b in groups if sums(a, b) >= surge]
    return (high[0][0], high[-1][1]) if high else (0, n - 1)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks, parted by line feeds; empty if there is none."""
    lines, containers = lines_of(page or "")
    first, end, declared = _range(lines, containers)
    held = lines[first:end]
    if not declared and held:
        a, b = surge_and_dive([line.weight for line in held])
        held = [line for line in held[a : b + 1] if line.weight]
    return "\n".join(line.text for line in held if line.text)


def text_of(column: str | Column) -> Column:
    """The main text of pages in a column, by a vectorised function."""

    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    return F.pandas_udf(texts, "string")(column)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html, ...): the main text of each whole page.

    A null or empty page, and one without any text outside of what is dropped, has the empty text.
    Repeated rows stay, nulls of the other columns stay null; further columns are dropped, so names
    cannot clash. An empty table gives an empty result. White space is what Unicode says, no-break
    spaces included. A single ``br`` is white space, two in a row part blocks.
    """
    told = pages.select(F.col("page_id").alias("page_id"), "url", text_of("html").alias("text"))
    return told.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
