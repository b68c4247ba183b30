"""Main text of hand-made pages, and of the generated ones, whose articles stand between their tags."""

import html
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.llm import html_text

LONG = "The committee met on Tuesday and agreed, after a long debate, that the bridge over the river would be closed for repairs until the spring of next year."
MORE = "Drivers were told to take the northern road instead, which adds about ten minutes to the journey, and the council promised that buses would run as before."
MENU = "<ul><li><a href=/>Home</a><li><a href=/n>News</a><li><a href=/s>Sport</a></ul>"

#: Page, and what its main text is.
PAGES = {
    "linked aside": (f"<article><p>{LONG}</p></article><aside><a href=/x>Ten shocking secrets that your doctor will never tell you about</a></aside>", LONG),
    "linked footer": (f"<article><p>{LONG}</p></article><footer><a href=/p>Read our privacy policy and terms of use before going on</a></footer>", LONG),
    "linked nav after an advert": (f"<div class=ad>{LONG}</div><nav><a href=/all>See all the stories of this week in one place</a></nav><article><p>{MORE}</p></article>", MORE),
    "no-sidebar": (f'<div class="no-sidebar"><p>{LONG}</p><p>{MORE}</p></div>', f"{LONG} {MORE}"),
    "has-sidebar": (f'<div class="layout has-sidebar"><p>{LONG}</p><p>{MORE}</p></div>', f"{LONG} {MORE}"),
    "entry header": (f'<article><div class="entry-header"><h1>Bridge closed</h1></div><p>{LONG}</p></article>', f"Bridge closed {LONG}"),
    "article header": (f'<article><header class="article-header"><h1>Bridge closed</h1></header><p>{LONG}</p></article>', f"Bridge closed {LONG}"),
    "related work": (f'<article><p>{LONG}</p><p class="related-work">{MORE}</p></article>', f"{LONG} {MORE}"),
    "related articles": (f'<article><p>{LONG}</p><div class="related-articles"><p>{MORE}</p></div></article>', LONG),
    "own list of links": (f"<article><p>{LONG}</p><ul><li><a href=/1>First report</a></li><li><a href=/2>Second report</a></li></ul></article>", f"{LONG} First report Second report"),
    "bare menu": (f"{MENU}<p>{LONG}</p><p>{MORE}</p>{MENU}", f"{LONG} {MORE}"),
    "bare title": (f"<p>Daily News</p>{MENU}<h1>Bridge closed</h1><p>{LONG}</p>", f"Bridge closed {LONG}"),
    "linked paragraph between text": (f"<p>{LONG}</p><p><a href=/r>The full report is online</a></p><p>{MORE}</p>", f"{LONG} The full report is online {MORE}"),
    "linked line after text": (f"<p>{LONG}</p><p><a href=/r>More stories like this one</a></p>", LONG),
    "header outside": (f"<header><h1>Daily News</h1><p>{MORE}</p></header><main><h1>Bridge closed</h1><p>{LONG}</p></main>", f"Bridge closed {LONG}"),
    "comments as articles": (f'<article><p>{LONG}</p></article><div id="comments"><article><p>{MORE}</p></article></div>', LONG),
    "camel case": (f'<article><p>{LONG}</p><div class="shareBar">Share this story</div></article>', LONG),
    "unclosed menu": (f"<nav><ul><li><a href=/>Home</a><article><p>{LONG}</p></article>", LONG),
    "form and notice": (f'<div class="cookie-notice"><p>{MORE}</p></div><article><p>{LONG}</p><form><p>{MORE}</p></form></article>', LONG),
    "references and spaces": ("<article><p>a&nbsp;&lt;b&gt;  &amp;\n\tc</p><p>d&#233;j&agrave;</p></article>", "a <b> & c déjà"),
    "hidden": (f'<article><p>{LONG}</p><p style="display: none">{MORE}</p><script>var a = "<p>no</p>"</script></article>', LONG),
    "role": (f'<div role=navigation><a href=/>Home</a></div><div role=main><p>{LONG}</p></div><div role="complementary"><p>{MORE}</p></div>', LONG),
    "cut short": (f"<article><p>{LONG}</p><p>{MORE}<div class='x", f"{LONG} {MORE}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_hand_made_page(name):
    page, want = PAGES[name]
    assert html_text.main_text(page) == want
    assert html_text.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}") == want


def test_tree_asks_for_the_neighbours():
    def asked(node):
        return {html_text.FEATURES[node[0]]} | asked(node[2]) | asked(node[3]) if isinstance(node, tuple) else set()

    assert {"links_before", "links_after"} & asked(html_text.tree()) and {"words_before", "words_after"} & asked(html_text.tree())
    for row in html_text.TABLE:
        assert html_text._main(row[:-1]) == bool(row[-1])


def test_generated_pages(spark):
    got = {r.page_id: r.text for r in html_text.extract(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).collect()}
    for page_id, page in zip(*(c.to_pylist() for c in pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["page_id", "html"]).columns)):
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", page, re.DOTALL)[1])
        assert got[page_id] == " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_odd_pages(spark):
    deep = "<div>" * 20_000 + LONG + "<article>" * 5000
    rows = [(1, "u", deep, "x", 1), (1, "u", f"<p>{LONG}</p>", "x", 1), (1, "u", f"<p>{LONG}</p>", "x", 1), (2, "u", f"<p>{LONG}" * 20_000, "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(pages.select("*", F.lit(1).alias("words"))).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, len(LONG))] * 3 + [(2, 20_000 * (len(LONG) + 1) - 1)]
