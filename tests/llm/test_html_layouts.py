"""Hand-marked layouts: the article is wanted whole, and nothing of what stands around it."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.llm import html

P = "The river rose, slowly at first, and then the whole valley was under water before anyone had packed a bag."
Q = "Nobody, not even the oldest farmer, had seen it reach the church, and they all said so afterwards."
R = "Short end."
C = "Great read, thanks, I will send it to all my friends, and to their friends, and to everyone, really."
LINKS = "<ul><li><a href=/1>Home page</a></li><li><a href=/2>World news</a></li><li><a href=/3>Local sport</a></li></ul>"

LAYOUTS = {
    "form_around_the_page": (f'<body><form id="aspnetForm"><input name=x><div class="nav">{LINKS}</div><div id="content"><h1>T</h1><p>{P}</p><p>{Q}</p></div><div class="footer">F</div></form></body>', f"T {P} {Q}"),
    "form_around_without_heading": (f"<form><div><p>{P}</p><p>{Q}</p></div></form>", f"{P} {Q}"),
    "search_form": (f"<body><form><label>Find</label><input><p>Search, here</p></form><div><p>{P}</p><p>{Q}</p></div></body>", f"{P} {Q}"),
    "linked_paragraph": (f"<article><h1>T</h1><p>{P}</p><p><a href=a>One source</a>, <a href=b>two source</a>, <a href=c>three source</a></p><p>{Q}</p></article>", f"T {P} One source, two source, three source {Q}"),
    "linked_paragraph_in_div": (f"<body><div><h1>T</h1><p>{P}</p><p><a href=a>One source</a> <a href=b>two source</a> <a href=c>three source</a></p><p>{Q}</p></div></body>", f"T {P} One source two source three source {Q}"),
    "references": (f"<article><p>{P}</p><h2>References</h2><ol><li><a href=a>A first</a></li><li><a href=b>A second</a></li><li><a href=c>A third</a></li></ol></article>", f"{P} References A first A second A third"),
    "short_sibling_section": (f"<body><div class=main><div class=text>{f'<p>{P}</p>' * 9}</div><div class=end><p>{R}</p></div></div></body>", " ".join([P] * 9 + [R])),
    "adverts_in_wrappers": (f'<article><p>{P}</p><div class="ad-container">Buy now, please</div><div class="sponsored-content"><p>Paid words, here</p></div><div class="newsletter-wrapper"><p>Join, us</p></div><div class="social-container">Tell, them</div><p>{Q}</p><div class="post-footer">Filed, here</div></article><div class="nav-wrapper">{LINKS}</div>', f"{P} {Q}"),
    "adverts_with_numbers": (f'<div class=content><p>{P}</p><div id="ad-300x250" class="dfp">Buy, buy, buy</div><div id="adSlot2">Buy, again</div><p>{Q}</p></div>', f"{P} {Q}"),
    "comments_as_articles": (f'<main><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><section id="comments"><h2>Comments</h2>{f"<article class=comment><p>{C}</p></article>" * 8}</section></main>', f"T {P} {Q}"),
    "comments_within_the_article": (f'<article><p>{P}</p><section class="comment-list"><article class="comment depth-1" id="comment-17"><p>{C}</p></article></section></article>', P),
    "more_comments_than_text": (f'<body><div class="content"><h1>T</h1><p>{P}</p></div><div class="post-comments">{f"<div class=comment-body><p>{C}</p></div>" * 30}</div></body>', f"T {P}"),
    "comments_without_heading": (f'<body><div class="content"><p>{P}</p><p>{Q}</p></div><ol class="commentlist"><li><p>{C}</p></li></ol></body>', f"{P} {Q}"),
    "talking_classes": (f'<body class="no-header has-sidebar"><div class="with-sidebar comments-open"><h1>T</h1><p>{P}</p></div><div class="sidebar"><p>Side, bar, text</p></div></body>', f"T {P}"),
    "wrapper_named_like_junk": (f'<body><div class="content-sidebar-wrap"><main><h1>T</h1><p>{P}</p><p>{Q}</p></main><aside><p>Aside, text</p></aside></div></body>', f"T {P} {Q}"),
    "subjects_in_classes": (f'<article class="post category-social-sciences tag-copyright-law"><h1 id="comments">T</h1><section id="discussion"><h2>Discussion</h2><p>{P}</p></section><section id="related-work"><p>{Q}</p></section></article>', f"T Discussion {P} {Q}"),
    "highlighted_code": (f'<article><p>{P}</p><pre><code><span class="comment"># note</span> x = 1</code></pre><p>{Q}</p></article>', f"{P} # note x = 1 {Q}"),
    "head_of_an_article": (f'<body><div class="site-header">Site</div><div class="post"><div class="entry-header"><h1>T</h1></div><p>{P}</p><p>{Q}</p></div></body>', f"T {P} {Q}"),
    "quoted_author": (f"<article><p>{P}</p><blockquote><p>{Q}</p><footer>An author</footer></blockquote><footer>Filed</footer></article>", f"{P} {Q} An author"),
    "related_articles": (f'<main><article><h1>T</h1><p>{P}</p><p>{Q}</p></article><div class="related-posts"><article><h3>Other</h3><p>{C}</p></article></div></main>', f"T {P} {Q}"),
    "notices": (f'<body><div id="cookie-consent-banner"><p>We use cookies, yes</p></div><div class="alert alert-info">Maintenance, tonight</div><div role="alert">Beware</div><div id=c><p>{P}</p><p>{Q}</p></div><p class="copyright">2020</p></body>', f"{P} {Q}"),
    "unclosed_nav": (f"<body><nav>{LINKS}<article><h1>T</h1><p>{P}</p><p>{Q}</p></article></body>", f"T {P} {Q}"),
    "table_layout": (f"<table><tr><td>{LINKS}</td><td><h1>T</h1><p>{P}</p><p>{Q}</p></td></tr></table>", f"T {P} {Q}"),
    "hidden_parts": (f'<article><p>{P}</p><p hidden>No, no</p><p style="display: none">No, no</p><span aria-hidden="true">x</span><p>{Q}</p></article>', f"{P} {Q}"),
    "inline_markup": ("<article><p>One<b>two</b> <i>three</i>,\n<a href=x>four</a>&nbsp;&amp; five<br>six</p></article>", "Onetwo three, four & five six"),
    "lists_tables_captions": (f"<article><p>{P}</p><ul><li>a</li><li>b</li></ul><table><caption>c</caption><tr><th>d</th><td>e</td></tr></table><figure><img alt=z><figcaption>f</figcaption></figure><dl><dt>g<dd>h</dl></article>", f"{P} a b c d e f g h"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    page, wanted = LAYOUTS[name]
    assert html.main_text(page) == wanted


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "x" + "</span>" * 20_000, "<p>" + "<b>" * 20_000 + "</i>" * 20_000, "<p><button>" + "<b>" * 20_000 + "<hr>" * 20_000, "<ul>" + "<li>x" * 50_000, "<b>" * 20_000 + "<p>x</p>" * 20_000, "<i></p>" * 50_000, "<table>" + "<tr><td>x" * 30_000])
def test_stray_and_open_tags_take_linear_time(page):
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 10


def test_table_of_pages(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<p>x, y</p>", "c"), (3, "<p>x, y</p>", "c"), (None, "<p>z</p>", None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = frame.withColumn("main", html.main_text_column(F.col("html")))
    assert sorted(((r.page_id or 0), r.main, r.text or "") for r in out.collect()) == [(0, "z", ""), (1, "", "a"), (2, "", "b"), (3, "x, y", "c"), (3, "x, y", "c")]
    assert frame.limit(0).withColumn("main", html.main_text_column(F.col("html"))).count() == 0
