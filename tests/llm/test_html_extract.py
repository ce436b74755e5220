"""Main text of planted pages, of the given ones, and of odd ones."""

import html
import re
import time

import pytest

from estatelens.llm import html_extract
from estatelens.llm.html_extract import main_text

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore."
ARTICLE = f"<h1>Title</h1><p>Of.</p><p>{LONG}</p><p>Sh <b>is</b>.</p><ul><li>one</li><li><a href='/x'>two</a></li></ul><p>{LONG} &amp; more&hellip;</p><p>End</p>"
WANT = f"Title\nOf.\n{LONG}\nSh is.\none\ntwo\n{LONG} & more…\nEnd"
AROUND = [
    ("<nav><ul><li><a href='/'>Home</a></li></ul></nav>", ""), ("<header><h1>Site name</h1></header>", ""), ("", f"<footer>&copy; {LONG}</footer>"), ("", f"<aside><p>{LONG}</p><p>{LONG}</p></aside>"),
    (f"<div class='cookie-notice'><p>{LONG}</p></div>", ""), (f"<div class=\"ad\">{LONG}</div>", f"<div id='ad_2'>{LONG}</div>"), ("", f"<form action='/s'><p>{LONG}</p><input><select><option>x</select></form>"),
    (f"<script>var t='</p><article>{LONG}';</script><style>p{{}}</style>", f"<script>{LONG}"), ("", f"<section id=comments><h2>Comments</h2><article class='comment'><p>{LONG}{LONG}{LONG}{LONG}{LONG}</p></article></section>"),
    ("<!-- <article> -->", "<!-- unclosed "), (f"<div role='navigation'>{LONG}</div>", f"<div hidden>{LONG}</div><div style='display: none'>{LONG}</div>"), ("<div class='menu'><a href=/a>A</a> <a href=/b>B</a></div>", ""),
    (f"<div class='sidebarLeft'>x</div><div class='widget-area sidebar'>{LONG}</div>", f"<div class='related-posts'><p>{LONG}</p></div>"),
]


@pytest.mark.parametrize("before,after", AROUND)
def test_declared_article_keeps_its_text_and_nothing_else(before, after):
    for wrap in ("<article>{}</article>", "<main class='has-sidebar'>{}</main>", "<main><article class='post with-comments'>{}</article></main>"):
        assert main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body class='no-ads'>{before}{wrap.format(ARTICLE)}{after}") == WANT


@pytest.mark.parametrize("before,after", AROUND)
def test_undeclared_article_lies_between_surge_and_dive(before, after):
    body = f"<h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG} {LONG}</p><p>Last words of it.</p>"
    want = f"Title\n{LONG}\nShort one.\n{LONG} {LONG}\nLast words of it."
    assert main_text(f"<html><body>{before}<div class='content'>{body}</div>{after}") == want


def test_surge_and_dive():
    assert html_extract.surge_and_dive([0, 3, 0, 0, 80, 5, 90, 4, 0, 0, 6, 0]) == (4, 7)
    assert html_extract.surge_and_dive([5, 0, 0, 70, 0, 70, 0, 0, 2]) == (3, 5)
    assert html_extract.surge_and_dive([1, 2, 3]) == (0, 2) and html_extract.surge_and_dive([]) == (0, -1)


def test_breaks_white_space_and_references():
    assert main_text("<article><p> a\n\t b&nbsp;c<br>d<br> <br>e&#39;&lt;i&gt;&am</article>") == "a b c d\ne'<i>&am"
    assert main_text("<article>in<em>ter</em>nal <table><tr><td>a</td><td>b</td></tr><tr><td>c</table></article>") == "internal\na b\nc"


def test_given_pages(spark, sf):
    """All given pages hold their text in an article of headings and paragraphs."""

    def want(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        return "\n".join(b for b in blocks if b)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == want(r["html"]) and got[r["page_id"]]["n_chars"] == len(want(r["html"]))


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<p>Hello"), (4, "w", "no markup &lt; at all"), (4, "w", "no markup &lt; at all"), (5, "x", "<article><p>𝒳"), (6, "y", "<nav>only a menu</nav>"), (7, "z", "<article>" + f"<p>{LONG}</p>" * 20_000)]
    got = html_extract.extract(spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")).collect()
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got[:7]] == [(1, "u", "", 0), (2, None, "", 0), (None, "v", "Hello", 5), (4, "w", "no markup < at all", 18), (4, "w", "no markup < at all", 18), (5, "x", "𝒳", 1), (6, "y", "", 0)]
    assert got[7]["n_chars"] == 20_000 * (len(LONG) + 1) - 1
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("bad", ['<a "' * 50_000, "<div>" * 50_000 + "x", "<!--" * 50_000, "<script>" * 50_000, "<p class='ad'>x" * 30_000, "<form>" * 50_000, "<" * 200_000, "<article><div>" * 20_000])
def test_broken_pages_take_linear_time(bad):
    at = time.process_time()
    main_text(bad)
    assert time.process_time() - at < 5
