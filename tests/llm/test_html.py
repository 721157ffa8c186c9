"""Main text of pages: the labelled table, odd markup, and all test pages against their markup."""

import html
import re

import pytest
from hypothesis import given, settings, strategies as st

from gleanery.llm import html_extract
from gleanery.llm.html_sample import PAGES
from gleanery.llm.queries import op9_html_extraction

TREE = html_extract.train()


@pytest.mark.parametrize("page,wanted", PAGES)
def test_labelled_pages(page, wanted):
    got = [t for t in html_extract.main_text(page, TREE).split("\n") if t]
    assert set(got) == set(wanted)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("plain words, no markup", "plain words, no markup"),
        ("<p>a &lt;b&gt; &amp;amp; &#233; &euro; &am</p>", "a <b> &amp; é € &am"),
        ("<article><p>one\n \t two<br>three</p><p> </p><p>four", "one two three\nfour"),
        ('<article><p title="a > b">x</p><script>if (a < b) "</p>"</script><p>y</p><!-- <p>no</p> --></article>', "x\ny"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<article><p>in<b>si</b>de</p><div>cell</div></article>", "inside\ncell"),
        ("<nav><li><a href=/>x</a></nav><article><p>Kept.</article><aside><p>side note</aside>", "Kept."),
        ("<main><form><p>Your name</p></form><p>Kept.</p><div class='comments'><p>No.</p></div></main>", "Kept."),
        ("<script>never closed <p>text</p>", ""),
    ],
)
def test_odd_pages(page, want):
    assert html_extract.main_text(page, TREE) == want


@pytest.mark.parametrize("around", ["content has-sidebar", "layout no-sidebar", "layout--with-search", "search", "social follow", "widget alert", "header sidebar"])
@pytest.mark.parametrize("inner", ["article", "main", "div class=content"])
def test_wrappers_of_the_article(around, inner):
    end = inner.split()[0]
    page = f"""<body><nav><a href=/>Home</a></nav><div class='{around}'><{inner}><div class='article-header'><h1>Title</h1></div><p>The text of it.</p>
    <div class='share'><p>No.</p></div></{end}><div class='comments'><article><p>No, a longer comment than the text.</p></article></div></div><footer>No</footer>"""
    assert html_extract.main_text(page, TREE) == "Title\nThe text of it."


@pytest.mark.parametrize("side", ["sidebar", "widget", "related", "comments", "sidebar widget"])
def test_articles_at_the_side(side):
    page = f"<article><p>The text of the page itself.</p></article><div class='{side}'><article><p>Another one.</p></article><div class=content><p>No.</p></div></div>"
    assert html_extract.main_text(page, TREE) == "The text of the page itself."


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><meta charset=utf-8><title>No</title><link href=x><body><article><p>Kept.</p></article></body></html>",
        "<head class=nav><title>No</title><style>p {}</style><script>'</head>'</script><body><header>No</header><article><p>Kept.</p></article>",
        "<head><title>No</title><noscript><p>No</p></noscript><article><p>Kept.</p></article><header>No</header>",
        "<head><title>No</titles> no</title></head><article><p>Kept.</p><select><option>no</selected>no</select></article>",
        "<title>No</TITLE ><article><p>Kept.</p></article>",
    ],
)
def test_head_without_end_tag(page):
    assert html_extract.main_text(page, TREE) == "Kept."


@given(st.text(alphabet=st.sampled_from("<>/&;!-\"'= apdivstyle\n"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_any_markup(page):
    text = html_extract.main_text(page, TREE)
    assert text == "\n".join(" ".join(t.split()) for t in text.split("\n"))


def plain(page):
    """The article of the test pages, from their fixed layout."""
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    found = (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", inner))
    return "\n".join(p for p in found if p)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op9_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, plain(pages[r.page_id].html))
        assert r.n_chars == len(r.text)


def test_nulls_and_repeats(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 50_000
    rows = [(1, None, None, "x"), (None, "u", "<p>a</p>", "x"), (2, "u", long, "x"), (3, "u", "", None), (3, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_extract.extract(pages).collect()}
    assert got[(1, None)] == ("", 0) and got[(None, "u")] == ("a", 1) and got[(3, "u")] == ("", 0)
    assert got[(2, "u")] == ("\n".join(["word & word"] * 50_000), 50_000 * 12 - 1)
    assert html_extract.extract(pages).count() == 5
    assert html_extract.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n, following", [(n, f) for n in (1, 3, 43, 400) for f in (0, 1, 2, 50)])
def test_lengths_decide_nothing_in_an_article(n, following):
    texts = [" ".join(["word"] * n), " ".join(["next"] * following), "end"]
    page = "<nav>Menu</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article><footer>No</footer>"
    assert html_extract.main_text(page, TREE) == "\n".join(t for t in texts if t)


def test_elements_nested_without_end():
    # Zones last however many elements are open, and end tags without start tags cost nothing.
    deep = "<div>" * 10_000
    page = f"<nav>{deep}<p>No.</p>{'</p></section>' * 10_000}<p>No.</p>{'</div>' * 10_000}</nav><article>{deep}<p>Kept.</p>{'</div>' * 10_000}<p>Too.</p></article><p>No.</p>"
    assert html_extract.main_text(page, TREE) == "Kept.\nToo."


def test_larger_table(spark):
    """Every page of the larger table is complete."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in op9_html_extraction(spark, "/root/testdata/sf0.1").collect()}
    assert [r.page_id for r in pages.collect() if got[r.page_id] != plain(r.html)] == []
