import html
import re

import pytest

from clicktrail.llm import queries
from clicktrail.llm.main_text import extract_main_text, main_text, parts_of_article

LONG = "A sentence of the article, which goes on, and on, until it is long enough to count as a paragraph of its own."
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{LONG} Again, &lt;tags&gt; &amp; more&#33;</p>"
TEXT = f"Title {LONG} Short one. {LONG} Again, <tags> & more!"
MENU = "<ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href='/c'>Sport, and more</a></li></ul>"

PAGES = {
    "semantic": f"<header><h2>Site</h2>{MENU}</header><main><article>{ARTICLE}</article><aside><p>{LONG}</p></aside></main><footer>{LONG}</footer>",
    "divisions": f"<div id=header>Site{MENU}</div><div id=content><div class=post>{ARTICLE}</div></div><div class='sidebar right'><p>{LONG}</p></div>"
                 f"<div id=footer><p>{LONG}</p></div>",
    "no names": f"<div>{MENU}</div><div><div>{ARTICLE}</div></div><div>Imprint</div>",
    "notices": f"<div class='cookie-notice'><p>{LONG} {LONG}</p></div><div class='alert alert-warning'>{LONG}</div><article>{ARTICLE}</article>",
    "adverts": f"<article>{ARTICLE[:ARTICLE.index('<p>Short')]}<div class='ad-slot'>{LONG}</div><div class='sponsored'>{LONG}</div>"
               f"{ARTICLE[ARTICLE.index('<p>Short'):]}</article>",
    "form": f"<article>{ARTICLE}<form><p>Your name, please: <input name=n></p><button>Send</button></form></article>",
    "whole page in a form": f"<form id=aspnet><div class=top>{MENU}</div><div class='article-body'>{ARTICLE}</div></form>",
    "comments": f"<article>{ARTICLE}<section id=comments><h3>Comments</h3><div class=comment><p>{LONG}</p><p>{LONG}</p></div></section></article>",
    "comments beside": f"<article>{ARTICLE}</article><div class='comment-list'><article class=comment><p>{LONG}, {LONG}</p></article></div>",
    "comments by heading": f"<div class=story>{ARTICLE}<div><h3>3 comments</h3><p>{LONG}</p></div></div>",
    "menu inside": f"<div class=entry-content>{MENU}{ARTICLE}<div>Tags {MENU}</div></div>",
    "scripts": f"<script>var a='<p>{LONG}</p>';</script><style>p>a{{}}</style><article><script>x()</script>{ARTICLE}<noscript>{LONG}</noscript></article>",
    "unclosed": f"<div class=post>{ARTICLE.replace('</p>', '')}</div><div class=sidebar><p>{LONG}",
    "comment marks": f"<!-- <p>{LONG}</p> --><article>{ARTICLE}</article><!-- open <p>{LONG}</p>",
    "capitals": f"<DIV CLASS='Article'>{ARTICLE}</DIV><DIV CLASS='SideBar'><P>{LONG}</P></DIV>",
    "hidden": f"<article>{ARTICLE}<p hidden>{LONG}</p><div style='display: none'>{LONG}</div><div aria-hidden=true>{LONG}</div></article>",
    "layout class": f"<div class='page has-sidebar no-footer'><article>{ARTICLE}</article></div>",
    "article header": f"<div class=wrap><div class='siteHeader'>{LONG}</div><div class=post><div class='entry-header'><h1>Title</h1></div>"
                      f"{ARTICLE[len('<h1>Title</h1>'):]}<div class='entry-footer'>{LONG}</div></div></div>",
    "joined names": f"<div class=cookieBar>{LONG}</div><div class=adsbygoogle>{LONG}</div><article>{ARTICLE}<div class=commentsArea>{LONG}</div></article>"
                    f"<div id=sidebarRight><p>{LONG}</p></div>",
    "words alike": f"<div class='navy commentary adobe headers-none'>{ARTICLE}</div>",
    "table": f"<table><tr><td class=nav>{MENU}</td><td>{ARTICLE}</td></tr></table>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_article_of_a_page(name):
    head = "<!doctype html><html><head><title>Title</title></head><body>"
    assert main_text(f"{head}{PAGES[name]}</body></html>") == TEXT
    assert main_text(PAGES[name]) == TEXT


def test_siblings_that_look_like_parts_join_and_others_do_not():
    page = f"<div id=a><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>{LONG} A part.</p><p><a href=x>{LONG}</a></p><p>no</p></div>"
    assert main_text(page).endswith("A part.")
    assert [e.tag for e in parts_of_article(page)] == ["div", "p"]


def test_links_discount_a_container():
    links = "".join(f"<p><a href=x>{LONG}</a></p>" for _ in range(9))
    assert main_text(f"<div>{links}</div><div><p>{LONG} Own.</p></div>") == f"{LONG} Own."


def test_white_space_and_references():
    page = "<article><p> a&nbsp;\n\tb <b>c</b>d <i> e</i>&lt;<br>f</p>\n<ul><li>x<li>y</ul><p>&notin; &amp &#x41; &unknown;</p></article>"
    assert main_text(page) == "a b cd e< f x y ∉ & A &unknown;"


@pytest.mark.parametrize("page", [
    "<div>" * 200_000 + "x", "<p>x" * 100_000, "<a \"" * 100_000, "<!--" * 100_000, "</" * 100_000, "<a b='" * 100_000, "&" * 10 ** 6,
    " " * 10 ** 6 + "x", "<script>" * 100_000, "<i>" * 100_000 + "x", "<" * 300_000, "<a b" + " " * 10 ** 6, "<table><tr><td>" * 50_000 + "x"])
def test_broken_and_very_long_pages_end(page):
    main_text(page)


def test_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGES["semantic"], "odd", 0), (1, "u", PAGES["semantic"], "odd", 0), (2, None, None, None, None), (None, "v", "", "", 1),
            (3, "w", "<article></article><nav>x</nav>", "", 1)]
    got = extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0), (3, "w", "", 0)], key=str)
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []


def test_pages_of_the_table_by_their_article_element(spark, sf_dir):
    # these pages mark their article, so that a search for the mark tells what to expect
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.REGISTRY["op12_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S).group(1)
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", inside)).split())
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))
