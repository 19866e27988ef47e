import html
import re

import pytest

from tidewire.llm import extraction
from tidewire.llm.queries import QUERIES

LONG = "The text of the article goes on for quite a while, so that it is the longest here. " * 4
BODY = LONG.strip()


def article_of(page):
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = re.split("</?(?:p|h1|br)>", inner)
    return " ".join(" ".join(html.unescape(re.sub("<[^>]*>", "", block)) for block in blocks).split())


def test_pages_of_the_table(spark, sf_dir):
    """The pages of the table name their article, so a plain reading of that element is the brute-force version."""
    want = {r.page_id: article_of(r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = QUERIES["op12_html_extraction"](spark, sf_dir).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


NAV = '<nav><a href="/">Home</a> <a href="/x">More of it</a></nav>'
COMMENTS = "<p>" + "I do not think so at all. " * 40 + "</p>"


@pytest.mark.parametrize("page, text", [
    (f"<body>{NAV}<article><h1>T</h1><p>{LONG}</p><p>End.</p></article><footer>© us</footer>", f"T {BODY} End."),
    (f"<div id=w><div class=c1><a href=a>One</a> <a href=b>Two</a></div><div class=c2><h1>T</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
     f"<ul><li>a b</li><li>c d</li></ul></div><div class=c3><p>We use them.</p></div></div>", f"T {BODY} Short. {BODY} a b c d"),
    (f'<article><p>{LONG}</p><div class="ad-box">Buy!</div><p>On.</p></article><div id="comments">{COMMENTS}</div>', f"{BODY} On."),
    (f'<div class="post"><p>{LONG}</p></div><section class="reader-comments">{COMMENTS}</section>', BODY),
    (f"<form action=x><div><h1>T</h1><p>{LONG}</p></div></form>", f"T {BODY}"),
    (f"<article><p>{LONG}</p><form><label>Mail</label><input><button>Go</button></form></article>", BODY),
    (f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{LONG}</p><aside>No</aside></article></main>", f"T {BODY}"),
    (f'<div class="has-sidebar"><div class="entry-header"><h1>T</h1></div><p>{LONG}</p></div>', f"T {BODY}"),
    (f'<main><p>{LONG}</p><p role="alert">Now!</p><p hidden>x</p><p style="display: none">y</p></main>', BODY),
    ("<article><p>foo<b>bar</b> &lt;x&gt; &eacute;&nbsp;z &amp q<br>w", "foobar <x> é z & q w"),
    ('<article><p>a</p><script>var t="</p><p>no";</SCRIPT ><style>q{}</style><!-- <p>no</p> --><p>b', "a b"),
    ("<article><p class=it's title=\"a > b\">a  \n b</p><P>c</P></article>", "a b c"),
    ("<title>only</title>", ""), (None, ""), ("", ""), ("plain < text", "plain < text"), ("<nav><p>x</p></nav>", ""),
    (f"<article><p>{'word ' * 200000}</p></article>", ("word " * 200000).strip()),
])
def test_page(page, text):
    assert extraction.main_text(page) == text


def test_windows_by_hand():
    assert extraction.window_sums([0, 5, 0, 0, 0, 1]).tolist() == [5, 5, 5, 5, 1, 1]


@pytest.mark.parametrize("page", ["<div>" * 50000 + "x", "<b>" * 50000 + "x", "<li><div>" * 20000, '<a href="' * 50000, "<" * 100000, "<!--" * 50000,
                                  "</p>" * 50000, "<div class=ad>" * 50000, "<ul><li>" * 30000 + "x"])
def test_broken_markup_ends(page):
    assert len(extraction.main_text(page)) in (0, 1, len(page))  # "<" alone is text


def test_odd_rows(spark):
    rows = [(1, "u", "<p>a b", 1, "x"), (1, "u", "<p>a b", 1, "x"), (None, None, None, None, None), (2, None, "", 3, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, `TEXT` string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extraction.extracted(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "a b", 3), (1, "u", "a b", 3), (None, None, "", 0), (2, None, "", 0)], key=repr)
    assert extraction.extracted(pages.limit(0)).collect() == []


def test_no_part_of_the_markup_is_text():
    assert not re.search("[<>]", extraction.main_text("<article><p a='<b>' b=\"</p>\">x</p></article>"))
