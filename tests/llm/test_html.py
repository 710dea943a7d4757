import html as entities
import re

import pytest

from skewlens.llm.html import extract, main_text

ARTICLE = "<p>First paragraph, with commas, and some length to it, so that it scores.</p><p>Second &amp; last, also long enough to pass points upward.</p>"
TEXT = "First paragraph, with commas, and some length to it, so that it scores.\nSecond & last, also long enough to pass points upward."


@pytest.mark.parametrize(
    "page",
    [
        "<nav><ul><li><a href=/>Home</a></ul></nav><article>%s</article><footer>&copy; us</footer>",
        "<header>Site, of many words and commas, in a header</header><div id=main>%s</div><aside>Other stories, long enough, to count</aside>",
        "<div class='cookie-notice'>We use cookies, all kinds, of cookies, always.</div><div class=content>%s</div>",
        "<div class=post>%s<div class='ad'>Buy this, it is cheap, and good, and yours.</div></div>",
        "<main>%s<section class=comments><p>Nice, very nice, I like it, more please, thanks for this.</p></section></main>",
        "<article>%s<form><label>Name, please</label><input><button>Send, now</button></form></article>",
        "<div>%s<script>var a = '<p>not, text</p>';</script><style>p{}</style><!-- <p>no</p> --></div>",
        "<body class='has-sidebar'><div class='sidebar'><p>Latest, and greatest, links, of all kinds, here they are.</p></div><div>%s</div></body>",
        "<div><ul class=x><li><a href=1>One thing</a></li><li><a href=2>Another thing</a></li></ul>%s</div>",
        "<table><tr><td><a href=1>a menu of links</a><td>%s</table>",
        "<article>%s</article><div role='complementary'><p>Beside, the point, entirely, and long as well.</p></div>",
        "<ARTICLE>%s</ARTICLE><DIV HIDDEN>Hidden, text, of some, length, not shown to readers</DIV><p",
    ],
)
def test_layouts(page):
    assert main_text(f"<html><head><title>T</title></head><body>{page % ARTICLE}</body></html>") == TEXT


def test_blocks_and_white_space():
    page = "<article><h1>Head\n line</h1><p>a  <b>b</b>&nbsp;c<br>d<p>e<ul><li>f<li>g</ul><blockquote>h</blockquote></article>"
    assert main_text(page) == "Head line\na b c d\ne\nf\ng\nh"


def test_marks_are_whole_words():
    page = '<article><p class="teaser">Lead.</p><div class="navy"><p>Blue.</p></div><p class="commentary">Said.</p><div class="nav-bar"><p>No.</p></div></article>'
    assert main_text(page) == "Lead.\nBlue.\nSaid."


def test_references_and_broken_markup():
    assert main_text("<article><p>1 &lt; 2 &#233; &hellip; a < b &a</article>") == "1 < 2 é … a < b &a"
    assert main_text("<article><p>open <b>bold<p>next</i></p></div>end") == "open bold\nnext\nend"
    assert main_text("") == main_text("<p") == main_text("<!-- only") == main_text("<script>x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"


def test_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = {r["page_id"]: r for r in extract(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        parts = (re.sub(r"<[^>]+>", " ", x) for x in re.split(r"</?(?:p|h1)>", body))
        blocks = (" ".join(entities.unescape(x).split()) for x in parts)
        row = rows[page["page_id"]]
        assert row["text"] == "\n".join(b for b in blocks if b)
        assert row["n_chars"] == len(row["text"]) and row["url"] == page["url"]


def test_odd_and_empty(spark):
    ddl = "page_id long, url string, html string, text string, n_chars string"
    pages = spark.createDataFrame([(None, None, None, "x", "y"), (1, "u", "", "x", "y"), (1, "u", "", "x", "y")], ddl)
    rows = extract(pages).collect()
    assert [(r["text"], r["n_chars"]) for r in rows] == [("", 0)] * 3
    assert extract(pages.limit(0)).count() == 0


def test_never_closed_tags_take_linear_time():
    import time

    def seconds(n):
        page = "<html><body>" + "".join(f"<div><p>Paragraph {i}, with some words, and commas.<a href='#'>x</a>" for i in range(n))
        start = time.perf_counter()
        assert f"Paragraph {n - 1}," in main_text(page)
        return time.perf_counter() - start

    small = seconds(2000)
    assert seconds(16_000) < 8 * 3 * max(small, 0.02)
