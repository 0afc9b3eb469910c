import re
from html import unescape

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import html_text as H
from shelfspark.llm.queries import op12_html_text
from tests.oracle import SMALL

LOREM = "The committee met on Tuesday and spoke at length about the harbour wall, which had been damaged in the storm."
MORE = "Nobody could say how long the repairs would take, nor what they would cost the town in the end."
MENU = "<div id=top><div><a href=/>Home</a></div><div><a href=/n>News</a></div><div><a href=/c>Contact</a></div></div>"


def page(body, head="<title>The title</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


CASES = {
    "marked article": (page(f"<nav><ul><li>Home</li></ul></nav><article><h1>Storm</h1><p>{LOREM}</p><p>Yes.</p></article><footer>&copy; us</footer>"), ["Storm", LOREM, "Yes."]),
    "divisions only": (page(f"{MENU}<div class=text><div><h1>Storm</h1></div><div>{LOREM}</div><div>Short.</div><div>{MORE}</div></div><div><div><div>Copyright 2020</div></div></div>"), ["Storm", LOREM, "Short.", MORE]),
    "advert within": (page(f"<main><p>{LOREM}</p><div class='ad-slot'><div>Buy now</div></div><p>The end.</p></main>"), [LOREM, "The end."]),
    "comments": (page(f"<article><p>{LOREM}</p><section id=comments><h2>Comments</h2><article class=comment><p>{MORE}</p></article></section></article>"), [LOREM]),
    "comments outside": (page(f"<div><p>{LOREM}</p><p>{MORE}</p></div><div class=user-comments><p>{MORE}</p><p>{LOREM}</p></div>"), [LOREM, MORE]),
    "sidebar, notice and header": (page(f"<header><h1>Daily News</h1></header><div class=cookie-notice><p>We use cookies. {MORE}</p></div><aside><p>{MORE}</p></aside><div class=content><p>{LOREM}</p></div>"), [LOREM]),
    "header of an article": (page(f"<article><header class=entry-header><h1>Storm</h1></header><p>{LOREM}</p><footer>Filed under weather</footer></article>"), ["Storm", LOREM]),
    "body with names": (page(f"<div class='has-sidebar article-content'><p>{LOREM}</p></div>").replace("<body>", "<body class='no-ads sidebar'>"), [LOREM]),
    "form around the page": (page(f"<form action=/x><div>Search <input name=q></div><article><p>{LOREM}</p></article></form>"), [LOREM]),
    "form within": (page(f"<article><p>{LOREM}</p><form><label>Name</label><p>{MORE}</p></form><p>{MORE}</p></article>"), [LOREM, MORE]),
    "unclosed markup": (f"<html><body><nav><a href=/>Home</a></nav><article><p><b>Storm.<br><p>{LOREM}<p>{MORE}</article><footer>{MORE}", ["Storm.", LOREM, MORE]),
    "cut in a tag": (f"<article><p>{LOREM}</p><p>{MORE}</p><div cla", [LOREM, MORE]),
    "scripts and styles": (page(f"<script>var t = \"</p><p>x\"; if (a < b) {{}}</script><article><style>p{{}}</style><p>{LOREM}<script>document.write('{MORE}')</script></p><noscript><p>{MORE}</p></noscript></article><!-- <p>{MORE}</p> -->"), [LOREM]),
    "unclosed script": (page(f"<article><p>{LOREM}</p></article><script>var a = '{MORE}'"), [LOREM]),
    "references": (page(f"<article><p>Caf&eacute; &amp; bar&nbsp;&#8212; 1 &lt; 2 &amp;lt; 3 &unknown; &#x41;</p><p>{LOREM}</p></article>"), ["Café & bar — 1 < 2 &lt; 3 &unknown; A", LOREM]),
    "white space": (page(f"<article><p>  one\n\ttwo<br>three <b>fo</b>ur five </p>\n\n<p>{LOREM}</p></article>"), ["one two three four five", LOREM]),
    "quoted brackets": (page(f"<article><p title='a > b' data-x=\"</p>\">{LOREM}</p><p>2 < 3 and 4 > 1</p></article>"), [LOREM, "2 < 3 and 4 > 1"]),
    "hidden": (page(f"<article><p hidden>{MORE}</p><p style='display: none'>{MORE}</p><p>{LOREM}</p></article>"), [LOREM]),
    "links in prose, then a list of links": (page(f"<div><p>{LOREM} See <a href=/x>the report</a>.</p><p>{MORE}</p></div><div><ul>{'<li><a href=/x>Another story of some length</a></li>' * 9}</ul></div>"), [f"{LOREM} See the report.", MORE]),
    "lists and tables": (page(f"<article><ul><li>One<li>Two</ul><table><tr><td>a<td>b</tr></table><p>{LOREM}</p></article>"), ["One", "Two", "a b", LOREM]),
    "roles": (page(f"<div role=navigation>Home {MORE}</div><div role='main'><p>{LOREM}</p></div><div role=contentinfo>{MORE}</div>"), [LOREM]),
    "no text": (page("<nav>Home</nav><footer>us</footer>"), []),
    "plain text": ("just words", ["just words"]),
    "empty": ("", []),
    "blank": (" \n\t ", []),
}


@pytest.mark.parametrize("name", CASES)
def test_pages(name):
    html, want = CASES[name]
    assert H.main_text(html).split("\n") == (want or [""])


def test_stretches():
    assert H.stretches([]) == [] and H.stretches([0, 0, 0]) == []
    assert H.stretches([0, 0, 0, 0, 0, 50, 0, 60, 0, 0, 0, 0, 3], surge=0.2) == [(5, 8)]
    assert H.stretches([0, 0, 0, 0, 0, 50, 0, 60, 0, 0, 0, 0, 3], surge=0.0) == [(5, 8), (12, 13)]
    assert H.stretches([90, 0, 0, 0, 0, 80], window=4) == [(0, 1), (5, 6)]
    assert H.stretches([90, 0, 0, 0, 80], window=4) == [(0, 5)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/pab \"'=!-&;\n", max_size=80))
def test_any_markup_is_read(html):
    text = H.main_text(html)
    assert text == "\n".join(" ".join(line.split()) for line in text.split("\n"))


def test_very_long_pages():
    assert H.main_text(f"<article>{'<p>word word</p>' * 100_000}</article>").count("\n") == 99_999
    assert H.main_text("<div>" * 20_000 + LOREM) == LOREM
    assert H.main_text('<a href="x>' * 20_000 + LOREM) == ""  # all of it within links
    assert H.main_text("<" * 100_000 + LOREM)


def test_awkward_rows(spark):
    rows = [(1, "u", CASES["marked article"][0], "x"), (1, "u", CASES["marked article"][0], "x"), (2, None, None, None), (None, "v", "", "x"), (3, "w", "<nav>x</nav>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, H.extract_pages(pages).collect()), key=str)
    text = "\n".join(["Storm", LOREM, "Yes."])
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=str)
    assert H.extract_pages(pages.limit(0)).count() == 0


def test_code_points(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a😀é</p>")], "page_id long, url string, html string")
    assert H.extract_pages(pages).first().n_chars == 3


def test_query_against_the_marked_article(spark):
    """The given pages mark their article, so its blocks are known."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = op12_html_text(spark, SMALL).collect()
    assert len(got) == len(html) and {r.page_id for r in got} == set(html)
    for r in got:
        inner = re.search("<article>(.*?)</article>", html[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", inner))
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)


def test_without_the_mark_the_distribution_finds_the_same(spark):
    """<article> as a plain division: lengths of lines tell."""
    same = total = 0
    for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect():
        want = H.main_text(r.html)
        if len(want) > 600:
            total += 1
            same += H.main_text(r.html.replace("article>", "div>")) == want
    assert total > 20 and same >= 0.9 * total
