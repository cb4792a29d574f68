"""Main text of pages."""

import html as escapes
import re

import pytest

from graphloom.llm import html_text
from graphloom.llm.html_text import main_text

SF = "/root/testdata/sf0.01"


def test_articles_of_the_table(spark):
    rows = html_text.op8_html_text(spark, SF).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in rows:
        inner = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        want = " ".join(escapes.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want)


LONG = "This sentence of the main text is long enough to be told from what stands around it."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>un<b>closed <i>inline", "unclosed inline"),
        ("<p>a &amp; b &#233; &nbsp;c<br>d", "a & b é c d"),
        (f"<nav><a href=x>Home</a></nav><main><h1>Title</h1><p>{LONG}</p><p>Ok.</p></main><footer>foot</footer>", f"Title {LONG} Ok."),
        (f"<div class='cookie-notice'>We use cookies</div><div id=content><p>{LONG}</p><form><p>form</p></form><p>{LONG}</p></div><div class='comments'><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<article><header><h1>T</h1></header><p>{LONG}</p><aside>side</aside><div class=ad>buy</div></article><section id=comments><article><p>{LONG}</p></article></section>", f"T {LONG}"),
        (f"<script>var t='<p>no</p>'</script><style>p{{}}</style><p>{LONG}</p><!-- <p>gone</p> -->", LONG),
        (f"<p>{LONG}</p><!-- never closed <p>x</p>", LONG),
        ("<ul>" + "<li>a<li>b" * 2 + "</ul>", "a b a b"),
        ("</p></div>stray", "stray"),
        (f"<div class='content has-sidebar'><p>{LONG}</p></div><div class='left sidebar'><p>{LONG}</p></div>", LONG),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


def test_odd_rows(spark, odd_docs, no_docs):
    got = html_text.with_main_text(odd_docs, "text", "x")
    assert got.count() == odd_docs.count() and got.columns == odd_docs.columns
    assert all(r.x == " ".join((r.text or "").split()) for r in got.collect())
    assert html_text.with_main_text(no_docs, "text", "x").count() == 0


def test_very_long_and_deep_pages():
    assert main_text("<div>" * 3000 + LONG + "</div>" * 3000) == LONG
    assert len(main_text(f"<p>{LONG}</p>" * 5000)) == 5000 * (len(LONG) + 1) - 1
