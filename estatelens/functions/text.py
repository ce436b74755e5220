"""Text expressions: lines of code, fingerprints, page text and titles, slugs, tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def lines_of_code(content: Column) -> Column:
    lines = F.transform(F.split(content, "\n", -1), trimmed)
    return F.size(F.filter(lines, lambda x: (x != "") & ~x.startswith("//") & ~x.startswith("*")))


def fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("int")


# Entities in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")]


def _marked(mark: str):
    return lambda c: F.concat(F.lit(f"\n{mark} "), trimmed(F.regexp_replace(c, "<[^>]+>", "")), F.lit("\n"))


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: Spark repeats what stands in higher-order functions."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _replaced(text: Column, parts: str, inner: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with ``by`` of group 1 of ``inner`` in place of each match of ``parts``."""

    def put(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(inner), F.lit(1)), by)
        pieces = F.zip_with(F.split(t, parts, -1), found, lambda g, f: F.concat(F.coalesce(g, F.lit("")), F.coalesce(f, F.lit(""))))
        return F.array_join(pieces, "")

    return _once(text, put)


def page_text(html: Column) -> Column:
    """Plain text with fenced code, marked headings and list items. Script and style text stays."""
    untagged = lambda c: F.regexp_replace(c, "<[^>]+>", "")
    fenced = lambda c: F.concat(F.lit("\n```\n"), trimmed(untagged(c)), F.lit("\n```\n"))
    text = _replaced(html, r"(?is)<pre[^>]*>.*?</pre>", r"(?is)<pre[^>]*>(.*?)</pre>", fenced)
    for level in range(1, 5):
        text = _replaced(text, rf"(?i)<h{level}[^>]*>.*?</h{level}>", rf"(?i)<h{level}[^>]*>(.*?)</h{level}>", _marked("#" * level))
    text = F.regexp_replace(F.regexp_replace(text, "(?i)</p>", "\n\n"), "(?i)<li[^>]*>", "\n- ")
    text = untagged(text)
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return trimmed(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def page_title(html: Column) -> Column:
    """The title without the site's suffix, else the first top heading, else a fixed word."""
    title = F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)
    heading = F.regexp_extract(html, r"(?i)<h1[^>]*>([^<]+)</h1>", 1)
    bare = trimmed(F.regexp_replace(title, r"(?i)\s*[|\-–]\s*Atlassian Developer.*", ""))
    return F.when(title != "", bare).when(heading != "", trimmed(heading)).otherwise("Untitled")


def slug(c: Column) -> Column:
    dashed = F.regexp_replace(F.lower(c), r"\s+", "-")
    return F.substring(F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-"), 1, 40)
