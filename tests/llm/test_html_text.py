"""Minimum-cut extraction: the cut against all labellings, blocks against known pages, the query against the pages' articles."""

import html
import itertools
import random
import re
import time

import pytest

from siltstone.llm import html_text, queries

SF = "/root/testdata/sf0.01"
BODY = [f"This is paragraph number {i} of the article and it has quite a few words in it, as articles do." for i in range(5)]


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(1)
    for _ in range(1500):
        n = rng.randint(1, 9)
        evidence = [rng.randint(-9, 9) for _ in range(rng.randint(0, n))]
        edges = [(a, b, rng.randint(0, 6)) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(labels):
            alone = sum(abs(e) for e, on in zip(evidence, labels) if (e > 0) != on and e)
            return alone + sum(c for a, b, c in edges if labels[a] != labels[b])

        assert cost(html_text.source_side(evidence, n, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def _page(article, before="", after=""):
    return f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>{before}{article}{after}</body></html>"


PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)


@pytest.mark.parametrize(
    ("before", "article", "after"),
    [
        ("<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>", f"<article><h1>Short</h1>{PARAGRAPHS}</article>", "<footer>&copy; some site</footer>"),
        ('<div id="cookie-banner">We use cookies to give you the best experience that you ever had on a site. Accept them all please.</div>', f"<main><h1>Short</h1>{PARAGRAPHS}</main>", '<div class="commentList"><article><p>I do not agree with anything that was said in this article above, at all.</p></article></div>'),
        ("<header><p>The Daily Site, all the news that fits on a page, since the year of its founding</p></header>", f'<div class="post-content"><h1>Short</h1>{PARAGRAPHS}</div>', '<aside><p>Read these other articles that we have written about the same subject before</p></aside>'),
        ("<form><label>Search</label><input><select><option>One<option>Two</select></form>", f"<article><h1>Short</h1>{PARAGRAPHS}<div class=ad>Buy this very fine thing now, before anybody else has bought all of them</div></article>", "<script>if (a < b) { '</p>' }</script>"),
        ('<table><tr><td><a href=/>Home</a></td><td><a href=/x>More</a></td></tr></table>', f"<div><h1>Short</h1>{PARAGRAPHS}</div>", "<div><a href=1>Imprint</a> | <a href=2>Privacy</a></div>"),
        ("", f"<form id=aspnet><article><h1>Short</h1>{PARAGRAPHS}</article></form>", '<div role="contentinfo"><p>All rights are reserved by the owner of this site and by nobody else in the world</p></div>'),
    ],
)
def test_pages_of_many_kinds(before, article, after):
    assert html_text.main_text(_page(article, before, after))[0] == "\n".join(["Short", *BODY])


def test_reading():
    def texts(source):
        return html_text.read_page(source).texts

    assert texts("<p>a<b>b</b>c<br>d\n\t e&nbsp;f&amp;&lt;&#233;&eacute;&unknown; &am</p>") == ["abc d e f&<éé&unknown; &am"]
    assert texts("<p>one<p>two<div>three</div>four") == ["one", "two", "three", "four"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert texts("x<!-- <p>no</p> -->y<script>var a = '<p>';</script>z<style>q</style>") == ["xyz"]
    assert texts("1 < 2 <p title='a > b'>x</P foo>y</nothing>") == ["1 < 2", "x", "y"]
    assert texts("a<p class=\"never ends>b</p>c") == ["a", "b", "c"]
    assert texts("a<!-- never ends <p>b") == ["a"]
    assert texts("a<script>never ends") == ["a"]
    assert texts("a<textarea>b</TEXTAREA >c<p") == ["ac"]
    assert texts("") == texts("   \n") == texts("<div><p></p></div>") == []


def test_whole_pages_that_are_hard_to_read_quickly():
    began = time.perf_counter()
    for source in ("<b>x" * 30_000, "<div>x" * 30_000, "<p>" * 50_000, "<x " * 50_000, "<a '" * 30_001 + ">", "</div>" * 50_000, "<p>word " * 20_000, "<" * 100_000, "&" * 100_000, "<li><a href=x>y</a>" * 20_000):
        html_text.main_text(source)
    assert time.perf_counter() - began < 60


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = queries.op13_html_text(spark, SF).collect()
    assert len(out) == len(pages)
    for r in out:
        source = pages[r.page_id].html
        article = source[source.index("<article>") : source.index("</article>")]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("<(?:/?article|/?h1|/?p)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert (r.n_chars, r.url) == (len(r.text), pages[r.page_id].url)


def test_awkward_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "clash", "clash"), (None, "u", "", "clash", "clash"), (2, "u", "<p>no", "c", "c"), (3, "u", _page(f"<article>{PARAGRAPHS}</article>"), "c", "c")]
    out = html_text.extract(spark.createDataFrame([*rows, rows[3]], schema).repartition(2)).collect()
    assert sorted((str(r.page_id), r.url, r.n_chars) for r in out) == sorted([("1", None, 0), ("None", "u", 0), ("2", "u", 0), ("3", "u", len("\n".join(BODY))), ("3", "u", len("\n".join(BODY)))])
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
