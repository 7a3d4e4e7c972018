"""Main text of pages: furniture of many kinds, odd markup, the query against the pages' own article."""

import html
import re

from tidemark.llm.html_extract import extract, main_text, parse_lines, smoothed_ratios

LONG = "This sentence belongs to the article and is long enough to matter. " * 3


def page(body):
    return f"<!doctype html><html><head><title>t</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


def test_furniture_goes_and_all_of_the_article_stays():
    text = main_text(page(
        "<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><aside>Side</aside>"
        f"<article><h1>Title &amp; more</h1><p>To.<p>{LONG}</p><div class=ad>Buy</div><form><input>Mail</form>"
        "<p>A  <b>bold</b>\n word&nbsp;here<br>next</p><script>x()</script><footer>by me</footer></article>"
        f"<section id=comments><p>{LONG}</p></section><div role=contentinfo>(c)</div><footer>&copy; 2020</footer>"))
    assert text.split("\n") == ["Title & more", "To.", LONG.strip(), "A bold word here", "next"]


def test_without_an_article_element():
    text = main_text(page(
        "<div class=menu><a href=/>One</a> <a href=/>Two</a></div>"
        f"<div><p>{LONG}</p><p>{LONG}</p><p><a href=/x>only a link</a></p><p>{LONG}</p></div>"
        "<ul><li><a href=/>a</a></li><li><a href=/>b</a></li></ul>"))
    assert text == "\n".join([LONG.strip()] * 3)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text(page("<nav>x</nav>")) == ""
    assert main_text("plain words only, no tags at all in here") == "plain words only, no tags at all in here"
    assert main_text(f"<article><p>{LONG}<p>cut &am") == f"{LONG.strip()}\ncut &am"
    assert main_text(f"<article><p>{LONG}</p><p class='x") == LONG.strip()
    assert main_text("<article>" + f"<p>{LONG}</p>" * 3000).count("\n") == 2999
    lines = parse_lines(page(f"<p>{LONG}</p><p>x</p>"))
    assert len(smoothed_ratios(lines)) == len(lines)


def test_names_do_not_decide_on_the_main_region():
    whole = LONG.strip()
    for body in (f"<div class='layout has-sidebar'><article><p>{LONG}</p></article></div>",
                 f"<article class='post promo'><p>{LONG}</p></article>",
                 f"<div id='search-results-page'><article><p>{LONG}</p></article></div>",
                 f"<div class='widget'><p>{LONG}</p></div><p>Short.</p>"):
        assert whole in main_text(page(body)), body
    inside = f"<article><p>{LONG}</p><p class='notice-period'>Three months.</p><div class='share'>Share<div>it</div></div><p>End.</p></article>"
    assert main_text(page(inside)).split("\n") == [whole, "Three months.", "End."]
    unclosed = f"<article><p>{LONG}</p><div class=ad>Buy</article><p class='promo'>x<p>After.</p>"
    assert main_text(page(unclosed)) == whole


def test_teasers_beside_the_article_go():
    whole = LONG.strip()
    teasers = "<article><h2>Other</h2><p>A few words.</p></article>" * 3
    comments = "<div class='comments'>" + "<article class='comment'><p>I liked it.</p></article>" * 2 + "</div>"
    text = main_text(page(f"<main><h1>Title</h1><article><p>{LONG}</p><p>{LONG}</p></article>{teasers}</main>{comments}"))
    assert text.split("\n") == ["Title", whole, whole]


def test_rows(spark, sf_dir):
    pages = spark.createDataFrame([(1, "u", None, 2), (None, None, f"<article>{LONG}", 3)],
                                  "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in extract(pages).collect()) == [(0, LONG.strip()), (1, "")]
    assert extract(pages.limit(0)).count() == 0
    given = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in given.collect()}
    for r in extract(given).collect():
        body = re.sub(r"<[^>]*$", "", source[r.page_id].partition("<article>")[2].partition("</article>")[0])
        blocks = (" ".join(html.unescape(re.sub(r"</?b>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", body))
        assert r.text == "\n".join(b for b in blocks if b)
