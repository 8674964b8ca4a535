"""Main text: held-out layouts, every page of a table against its template, broken markup."""
import html
import re
import time

import duckdb
import pytest

from cohortbeam.llm import html_blocks as hb, main_text as mt

TREE = mt.train()


def text(page):
    return "\n\n".join(mt.main_blocks(page, TREE))


def words(n, seed="w"):
    return " ".join(f"{seed}{i}" for i in range(n))


def test_the_tree_agrees_with_its_labelled_table():
    x, y = mt.labelled_blocks(mt.labelled_pages())
    assert (mt.kept(TREE, x) == y).mean() > 0.99 and 0.2 < y.mean() < 0.8


#: Layouts that are not in the labelled table: (page, main text).
HELD_OUT = {
    "blog": ("""<!doctype html><html><body class="home sidebar-left"><div id="topbar"><a href="/">Home</a></div><ul class="nav-menu"><li>
<a href="/a">News</a><li><a href="/b">Sport</a></ul><div class="hentry post"><h2 class="entry-title">A day out</h2>
<p>It rained.<p>Then the sun came out &amp; we <a href="/walk">walked</a>
 home.<blockquote>Never again</blockquote></div><div class="sidebarRight"><h3>Archive</h3><p>A long list of older entries that nobody reads any more today</p>
</div><ol class="commentlist"><li>Nice one!</li><li>I walked there last year too and liked it a lot, thanks for the story</li></ol>
<div class="footer-wrap">Made by us</div>""", ["A day out", "It rained.", "Then the sun came out & we walked home.", "Never again"]),
    "news": ("""<header role="banner"><h1>The Paper</h1></header><div class="breaking-notice"><p>Read our new terms and tell us what you think of them</p></div>
<main><article><h1>Bridge closed</h1><div class="ad-slot">Buy two coats and pay for one until the end of this week only</div><p>Closed.</p><p>For two weeks.</p>
<form action="/s"><p>Get our letter</p><input name=a><button>Go</button></form><p>Engineers said so.</p><footer>Share this</footer></article>
<section class="reader-comments"><p>About time, the thing has been shaking for years now and nobody did anything</p></section></main>
<aside>Most read</aside><footer><p>Imprint</p></footer>""", ["Bridge closed", "Closed.", "For two weeks.", "Engineers said so."]),
    "rest named": (f"""<div id="navbar"><a href=1>Home</a> <a href=2>All</a></div><h1>Harbour</h1><p>Short.</p><p>Two words.</p><p>{words(40)}</p>
<p>See <a href=3>{words(3, "k")}</a> {words(9, "z")}</p><p>End.</p><div class="commentlist"><p>I saw it too, what a great day it was for all of us there in town</p>
<p>Same here</p></div><div class="site-footer"><p>{words(30, "f")}</p></div>""",
                   ["Harbour", "Short.", "Two words.", words(40), f"See {words(3, 'k')} {words(9, 'z')}", "End."]),
    "main named": (f"""<div>Welcome to the site</div><p>{words(30, "i")}</p><div id="main-story"><h1>Snow</h1><p>It fell.</p><p><a href=1>{words(6, "l")}</a></p>
<p>{words(70)}</p></div><p>{words(45, "o")}</p><div>Bye</div>""", ["Snow", "It fell.", words(6, "l"), words(70)]),
    "plain": (f"""<table><tr><td><a href=1>One</a><td><a href=2>Two</a><td><a href=3>Three</a></table>
<h1>Of rivers</h1><p>{words(50)}</p><p>{words(31, "x")} <a href=4>see</a></p><p>{words(44, "y")}</p><p><a href=5>Next page</a></p><p>Page 3</p>""",
              ["Of rivers", words(50), words(31, "x") + " see", words(44, "y")]),
}


@pytest.mark.parametrize("name", HELD_OUT)
def test_held_out_layouts(name):
    page, want = HELD_OUT[name]
    assert text(page) == "\n\n".join(want)


def template_text(page):
    """By the template of the given pages: whatever stands in the article."""
    inside = re.search(r"(?s)<article>(.*?)</article>", page)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(p for p in parts if p)


def test_query_equals_the_template_on_all_pages(spark, sf):
    from cohortbeam.llm.queries import QUERIES
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{sf}/pages.parquet'").fetchall()
    want = sorted((i, u, t := template_text(h), len(t)) for i, u, h in rows)
    got = QUERIES["op11_main_text"](spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect())) == want


def test_white_space_references_and_inline_markup():
    page = ("<article><p> a\t<b>b</b>c\n&nbsp;d<br/>e </p>f &lt;p&gt; &amp;amp; &#x41;&#66 &eacute; a < b <i>x</i>y<!-- z --><p></p>"
            "<p>g<script>h('</p>')</script><style>i</style>j<svg><text>k</text></svg></p></article>")
    assert text(page) == "a bc d e\n\nf <p> &amp; AB é a < b xy\n\ngj"


def test_broken_markup_is_read_in_linear_time():
    n = 200_000
    for piece in ("<", "<a ", "<a \"", "<a '\">", "<!--", "<!-", "</", "<div>", "</div>", "<script>", "<p><b>", "&#" + "9" * 50,
                  "<li><div>", "<a href='", "&", "<svg>", "<a href=x>y", "<nav><article>", "\n\t ", "<x y=\"z\" y='z'", "]]>", "<title>"):
        t = time.time()
        hb.blocks(piece * (n // len(piece)))
        assert time.time() - t < 5, piece
    assert text("<article><p>" + "word " * n + "</p><p>end") == ("word " * n).strip() + "\n\nend"
    assert text("<article><p>&#" + "0" * 5000 + "65; &#" + "9" * 5000 + ";") == "A �"


def test_awkward_rows(spark):
    page = "<article><p>One two</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, page, "x"), (2, "v", None, "x"), (3, "v", "", "x"), (4, "v", " \n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").selectExpr("*", "'y' AS n_kept", "0 AS n_chars")
    got = sorted(map(tuple, mt.main_text(df, TREE).collect()), key=str)
    assert got == sorted([(1, "u", "One two", 7, 1)] * 2 + [(None, None, "One two", 7, 1), (2, "v", "", 0, 0), (3, "v", "", 0, 0),
                                                           (4, "v", "", 0, 0)], key=str)
    assert mt.main_text(df.where("false"), TREE).count() == 0
    assert mt.train([]) == 0 and mt.main_blocks(page, 0) == []
