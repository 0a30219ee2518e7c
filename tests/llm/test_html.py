import itertools
from collections import Counter

import pytest

from curatrix.llm import html

PAGES = [
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>One two three.</p><p>Four&nbsp;five &amp;amp; six</p></article><footer>F</footer></body></html>", "Title\nOne two three.\nFour five &amp; six"),
    ("<body><div class='header'><h1>Site</h1></div><div id=content><div class=post><h1>T</h1><p>One two.</p><div class='ad-box'>Buy now</div><p>Three.</p><form>Email</form></div><div id=comments><p>A very long comment that has many words in it.</p></div></div><div class=sidebar>x y z</div>", "T\nOne two.\nThree."),
    ("<article><header><h1>T</h1><p>By X</p></header><p>Body <b>text</b>.<aside>rel</aside><section class='reader-comments'>bad</section></article>", "T\nBy X\nBody text."),
    ("<body><header>Brand</header><h1>Head line here</h1><p>Some words go here</p><div class='cookie-notice'>We use cookies</div><footer>f</footer>", "Head line here\nSome words go here"),
    ("<p>a &lt; b\n\t c<br>d</p>", "a < b c d"),
    ("<article><p><b>Open bold.<br><p>Next.</p></article>", "Open bold.\nNext."),
    ("<article><script>var t='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>Yes</p></article>", "Yes"),
    ("<article><p title='a > b'>Quoted</p><p hidden>h</p><p style='display: none'>h</p></article>", "Quoted"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\ntwo\nx\ny"),
    ("<article><p>Cut off &am", "Cut off &am"),
    ("<article><p>Cut tag <a href='x", "Cut tag"),
    ("<body class='has-sidebar'><div class='content with-sidebar'><h1>T</h1><p>One two.</p><p class=intro-text>Three.</p></div><div class='sidebar-content'><p>Not this one here.</p></div>", "T\nOne two.\nThree."),
    ("<main><article class=post><h1>T</h1><p>One two three.</p></article><article class=comment><p>I like it so very much indeed.</p></article><div class='comment-body'>Me too.</div></main>", "T\nOne two three."),
    ("<main><p>One two three.</p><div class=adslot>Buy it now</div><div role=navigation><a>x</a></div><p>Four.</p></main>", "One two three.\nFour."),
    ("plain text only", "plain text only"),
    ("", ""),
    (None, ""),
    ("<article></article>", ""),
    ("<body><script>only()</script></body>", ""),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_pages(page, text):
    assert html.main_text(page) == text


UNCLOSED = [
    ('<p>A</p><svg class="i"/><p>Body text</p>', "A\nBody text"),
    ("<article><p>A</p><video-player></video-player><p>Body text</p><button-bar></button-bar><p>End.</p></article>", "A\nBody text\nEnd."),
    *((f"<article><p>A</p><{x}>Label<p>Body text</p><p>More.</p></article>", "A\nBody text\nMore.") for x in ("button", "select", "object", "video", "canvas", "noscript", "svg", "template", "iframe")),
    ("<article><p>A <svg><path d='M0'/><title>Icon</title></svg>b <button>Go<span>!</span></button>c</p></article>", "A b c"),
    ("<article><svg><title/><g/></svg><p>Body</p><svg><style>a{}</svg><p>More</p></article>", "Body\nMore"),
    ("<article><object><object><p>x</p></object><p>y</p></object><p>Body</p><svg><foreignObject><div>z</div></foreignObject></svg></article>", "Body"),
    ("<article><noscript></article><p>x</p></noscript><p>Body</p><a href=/><svg></a> tail</article>", "Body\ntail"),
    ("<article><p>A</p><script>never closed <p>x</p>", "A"),
    ("<article><div class='overflow-hidden'><p>Body</p></div><p style='overflow:hidden'>More</p><p title='hidden gems' data-x='display:none'>Title</p></article>", "Body\nMore\nTitle"),
    ("<article><p>A</p><p class='x hidden'>h</p><p hidden='until-found'>h</p><p aria-hidden=true>h</p><p class=visually-hidden>h</p><p style='color:red;visibility:hidden'>h</p></article>", "A"),
]


@pytest.mark.parametrize("page, text", UNCLOSED)
def test_unclosed_and_hidden(page, text):
    assert html.main_text(page) == text


def test_labelled_pages_are_learned():
    pages = list(html.labelled_pages())
    assert all(html.main_text(p) == t for p, t in pages)
    w = html.learn(pages)
    assert w["word main"] > 0 > w["tag li"] and w["word skip"] < 0


def test_best_run_is_the_maximum():
    for scores in itertools.product((-2, -1, 0, 1, 3), repeat=5):
        a, b = html.best_run(list(scores))
        best = max((sum(scores[i:j]) for i in range(5) for j in range(i + 1, 6)), default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_very_long_page():
    page = "<article>" + "<p>word word</p>" * 30000 + "</article>" + "<div>" * 3000
    assert html.main_text(page).count("\n") == 29999


def test_dataframe(spark):
    df = spark.createDataFrame([(1, PAGES[0][0], "u", "old"), (1, PAGES[0][0], "u", "old"), (None, None, None, None)], "page_id long, html string, url string, text string")
    rows = html.extract(df).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, PAGES[0][1], len(PAGES[0][1]))] * 2 + [(None, "", 0)]
    assert html.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


def tables_pages():
    import os

    import pyarrow.parquet as pq

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    return [p for p in pq.read_table(f"{sf}/pages.parquet").column("html").to_pylist() if p]


def test_the_scan_finds_the_article_without_names():
    """Elements that name their part are turned into div and names are taken away: the weights, learned from other pages, still find the same text."""
    import re

    found = []
    for page in tables_pages():
        bare = re.sub(r"<(/?)(article|nav|aside|footer|header|main|section|form)\b", r"<\1div", page)
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", bare)
        want, got = html.main_text(page).split(), html.main_text(bare).split()
        same = sum((Counter(want) & Counter(got)).values())
        found.append(2 * same / (len(want) + len(got)) if want or got else 1)
    assert len(found) > 20 and sum(found) / len(found) >= 0.99


def test_a_page_that_scores_below_zero_is_not_lost():
    assert html.main_text("<div>a</div><div>b c</div>") == "a\nb c"
