"""A small labelled table: pages whose main text is marked.

``{n}`` stands for n words. Blocks inside an element with ``data-main`` are main
text, but for those inside one with ``data-rest``. Pages whose elements say what
they hold come in several variants with very different word counts, so that what
elements say is learned apart from the length of their texts; the others keep
the proportions of their texts.
"""
from __future__ import annotations

import re

VARIANTS = 9
FACTORS = (0.05, 2, 0.3, 1, 5, 0.1, 0.6)  # on word counts, in turn from block to block
WORDS = "river stone light under market seven paper window garden quiet number against morning letter cold bridge".split()

#: Pages whose elements or classes say what they hold. Lengths don't matter there.
MARKED = [
    # article and nav elements, an advert, a footer
    """<html><head><title>{6}</title><style>p{}</style></head><body><nav><ul><li><a href=x>{1}</a></li><li><a href=x>{2}</a>
    </li></ul></nav><div class="ad">{9}</div><article data-main><h1>{7}</h1><p>{40}</p><p>{3}</p><p>{25}<br>{8}</p><p>{1}</p>
    <p>{60}</p></article><footer>{12}</footer></body></html>""",
    # page header, notice, main with sections, sidebar, comments
    """<body><header><h1>{2}</h1><p>{8}</p><nav><a href=x>{1}</a> <a href=x>{1}</a></nav></header><div class="cookie-notice">
    <p>{30}</p><button>{2}</button></div><main data-main><h1>{6}</h1><section><h2>{4}</h2><p>{35}</p><p>{2}</p><ul><li>{6}</li>
    <li>{9}</li></ul></section><section><h2>{3}</h2><p>{50}</p><blockquote><p>{20}</p></blockquote></section></main>
    <aside><h3>{2}</h3><p>{25}</p><ul><li><a href=x>{5}</a></li><li><a href=x>{6}</a></li></ul></aside><section id="comments">
    <h2>{2}</h2><div><p>{30}</p></div><div><p>{4}</p></div><form><p>{6}</p><label>{2}</label></form></section><footer><p>{15}</p>
    <p><a href=x>{2}</a></p></footer></body>""",
    # classes only
    """<body><div id="masthead"><div>{3}</div></div><div class="menu"><a href=x>{2}</a><a href=x>{1}</a></div><div id="wrapper">
    <div class="post-content" data-main><h2>{5}</h2><p>{45}</p><div>{30}</div><p>{2}</p><div class="share" data-rest>{3}</div><p>{18} <a href=x>{3}</a>
    {10}</p></div><div class="sidebar"><h4>{2}</h4><div>{35}</div><div><a href=x>{4}</a></div></div><div class="comment-list">
    <div class="comment"><p>{2}</p><p>{40}</p></div><div class="comment"><p>{22}</p></div></div></div>
    <div id="footer"><div>{14}</div></div></body>""",
    # article with its own header, notes, form and footer; comments as articles inside
    """<body><div role="banner">{5}</div><article><header><h1 data-main>{8}</h1></header><div data-main><p>{30}</p>
    <figure><figcaption>{9}</figcaption></figure><p>{4}</p><h3>{3}</h3><p>{55}</p><pre>{12}</pre><table><tr><td>{2}</td><td>{6}</td></tr></table></div>
    <div class="advert"><p>{20}</p></div><div data-main><p>{33}</p></div><form class="newsletter-signup"><p>{12}</p></form><aside class="related"><p>{14}</p>
    </aside><footer><p>{8}</p></footer><section class="comments"><h3>{1}</h3><article class="comment"><p>{26}</p></article>
    <article><p>{11}</p><p>{3}</p></article></section></article><div role="contentinfo">{9}</div></body>""",
    # content wrapper around main text and sidebar, dialogs and hidden parts
    """<body class="has-sidebar"><div class="topbar">{4}</div><div id="content"><div class="breadcrumbs"><a href=x>{1}</a> {1}</div>
    <div class="entry" data-main><h1>{6}</h1><p>{28}</p><p>{6}</p><dl><dt>{2}</dt><dd>{9}</dd></dl><p>{31}</p></div><div id="sidebar"><div class="widget"><p>{16}</p>
    </div></div><div style="display:none"><p>{20}</p></div><div id="disqus"><p>{24}</p><p>{3}</p></div></div>
    <div class="modal" role="dialog"><p>{18}</p></div><div class="copyright">{7}</div></body>""",
    # article inside a wrapper that names a page part, adverts between paragraphs
    """<body><nav><p>{5}</p></nav><div class="page-wrap"><article itemprop="articleBody" data-main><h1>{5}</h1><p>{22}</p>
    <div class="ads" data-rest><p>{10}</p></div><p>{1}</p><aside data-rest><p>{13}</p></aside><p>{48}</p><ol><li>{4}</li><li>{12}</li></ol>
    <div class="notice" data-rest>{17}</div><p>{9}</p></article></div><div class="popular"><ul><li><a href=x>{6}</a></li></ul></div>
    <form><p>{5}</p><p>{11}</p></form><footer><div>{21}</div></footer></body>""",
    # a long text of links inside an article, and long texts outside
    """<body><header><p>{40}</p></header><article data-main><h1>{4}</h1><p><a href=x>{12}</a></p><p>{2} <a href=x>{6}</a></p><ul><li><a href=x>{3}</a></li>
    <li><a href=x>{5}</a> {2}</li></ul><p>{20}</p></article><div class="comments"><p>{70}</p><p>{45}</p></div><footer><p>{55}</p></footer></body>""",
    # nothing before or after the main text
    """<article data-main><h1>{5}</h1><p>{30}</p><p>{7}</p></article>""",
    """<main data-main><p>{12}</p></main>""",
    """<body><div class="story" data-main><p>{22}</p></div><div class="story-comments"><p>{22}</p></div></body>""",
    """<body><div class="ad">{16}</div><div class="article-body" data-main><p>{16}</p><p>{2}</p></div></body>""",
    # headings of parts that are not main text, inside a wrapper that says main
    """<body><div id="content"><article data-main><h1>{5}</h1><p>{24}</p><h2>{2}</h2><p>{3}</p></article><div class="sidebar"><h2>{2}</h2><p>{30}</p>
    <h3>{4}</h3><ul><li>{5}</li></ul></div><section class="related"><h2>{3}</h2><article><h3>{6}</h3><p>{15}</p></article></section>
    <nav><h2>{1}</h2></nav><div id="responses"><h2>{3}</h2><p>{21}</p></div></div><footer><h4>{2}</h4></footer></body>""",
    """<body><div class="page-header"><h1>{3}</h1><p>{7}</p></div><main><div class="entry-header"><h1 data-main>{7}</h1><p>{4}</p></div>
    <div class="entry" data-main><p>{26}</p></div><aside><h2>{3}</h2></aside><form><h3>{2}</h3><p>{9}</p></form></main></body>""",
    # only the other parts are named: what is left is the main text, but for lists of links
    """<body><nav><ul><li><a href=x>{2}</a></li><li><a href=x>{1}</a></li></ul></nav><div data-main><h1>{6}</h1><p>{30}</p><p>{2}</p><p>{1}</p><p>{9}</p>
    <p>{50} <a href=x>{3}</a> {14}</p><p>{4}</p></div><div><a href=x>{5}</a></div><div><a href=x>{4}</a></div><footer><p>{12}</p></footer></body>""",
    """<header><p>{4}</p><p>{20}</p></header><table><tr><td data-main><h2>{4}</h2><div>{3}</div><ul><li>{4}</li><li>{2}</li></ul><p>{1}</p><p>{25}</p>
    <p>{2}</p></td></tr></table><aside><p>{20}</p><p><a href=x>{3}</a></p></aside><form><p>{7}</p></form>""",
    """<body><div class="menu"><a href=x>{2}</a></div><div><div class="ad">{12}</div><div data-main><h1>{3}</h1><p>{1}</p><p>{2}</p></div><div class="comments"><p>{30}</p>
    </div></div><p><a href=x>{2}</a> <a href=x>{1}</a></p><div id="footer">{3}</div></body>""",
    # the main text is named, and what nothing names is none
    """<body><div><a href=x>{1}</a> {1}</div><div>{5}</div><p>{25}</p><article data-main><h1>{4}</h1><p>{3}</p><p>{36}</p></article><div>{20}</div><div>{3}</div></body>""",
    """<body><h1>{3}</h1><p>{9}</p><div class="post" data-main><h2>{5}</h2><p>{28}</p><p>{2}</p></div><p>{14}</p><p>{40}</p><div class="footer">{6}</div></body>""",
    # one form around the whole page
    """<body><form id="page"><div class="menu"><p>{6}</p></div><div class="content" data-main><h1>{4}</h1><p>{33}</p><p>{5}</p></div>
    <div class="sidebar"><p>{18}</p></div></form></body>""",
]

#: Pages whose elements say nothing: word counts and link densities decide.
PLAIN = [
    """<body><table><tr><td><a href=x>{1}</a> <a href=x>{2}</a> <a href=x>{1}</a></td></tr><tr><td><div data-main><h1>{6}</h1><p>{60}</p><p>{35}</p>
    <p>{12}</p><p>{48}</p><p>{25}</p></div></td></tr><tr><td>{6} <a href=x>{2}</a></td></tr></table></body>""",
    """<body><div><a href=x>{1}</a></div><div><a href=x>{2}</a></div><div><a href=x>{1}</a></div><div data-main><h2>{5}</h2><div>{80}</div>
    <div>{42}</div><div>{9}</div><div>{55}</div></div><div><a href=x>{4}</a></div><div><a href=x>{5}</a></div><div>{5}</div></body>""",
    """<body><p><a href=x>{3}</a> {1} <a href=x>{3}</a></p><div data-main><h1>{8}</h1><p>{30} <a href=x>{2}</a> {25}</p><p>{44}</p><h3>{3}</h3><p>{38}</p>
    <p>{16}</p><p>{29}</p></div><ul><li><a href=x>{5}</a></li><li><a href=x>{4}</a></li><li><a href=x>{6}</a></li></ul><p>{4}</p><p>{3}</p></body>""",
    """<body><div>{2}</div><div><a href=x>{2}</a></div><div data-main><p>{90}</p><p>{65}</p><p>{22}</p><p>{70}</p></div><div>{3}</div>
    <div><a href=x>{3}</a> {2}</div><div>{7}</div></body>""",
    """<body><div data-main><h1>{6}</h1><p>{45}</p><p>{30}</p><p>{52}</p></div></body>""",
    """<div data-main><p>{70}</p></div>""",
    """<body><div><a href=x>{2}</a></div><div data-main><p>{40}</p><p>{28}</p></div></body>""",
    """<body><div data-main><h1>{4}</h1><p>{38}</p><ul><li>{10}</li><li>{14}</li></ul><p>{60}</p></div><div><a href=x>{3}</a></div><div>{4}</div></body>""",
]


def _filled(page: str, factors: tuple, start: int = 0) -> str:
    places = iter(range(start, len(page)))

    def words(m: re.Match) -> str:
        n = max(1, round(int(m[1]) * factors[next(places) % len(factors)]))
        return " ".join(WORDS[(n + i) % len(WORDS)] for i in range(n))

    return re.sub(r"\{(\d+)\}", words, page)


def labelled_pages() -> list[str]:
    return [_filled(p, FACTORS, v) for p in MARKED for v in range(VARIANTS)] + [
        _filled(p, (f,)) for p in PLAIN for f in (0.8, 1, 2)]
