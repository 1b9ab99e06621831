"""Main text of pages against the marked articles, on layouts the model has not seen, and edge pages."""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pytest

from shotmetrics.llm import boosting, catalog, extraction
from shotmetrics.llm.dom import Page


@pytest.fixture(scope="module")
def fitted(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    return pages, extraction.fit(pages)


def article(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner).replace("<b>", "")).split())


def test_articles_of_the_table(spark, fitted):
    pages, model = fitted
    source = {r.page_id: r.html for r in pages.collect()}
    got = extraction.extracted(spark, pages, model).collect()
    assert len(got) == len(source)
    assert np.mean([r.text == article(source[r.page_id]) for r in got]) > 0.97


def test_query_columns(spark, small_dir):
    rows = catalog.QUERIES["op1_main_text"](spark, small_dir)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in rows.collect())


def test_layouts_not_seen(fitted):
    pages, model = fitted
    split = [extraction.sample_blocks(r.html) for r in pages.limit(120).collect()]
    prose = [t for blocks, _ in split for _, t in blocks]
    rng, exact = random.Random(77), []
    for blocks, others in split:
        source = extraction.layout(rng, blocks, others, prose)
        page = Page(source)
        mark = [None] * len(page.tags)
        for v in range(len(page.tags)):
            mark[v] = page.marks[v] if page.marks[v] in ("0", "1") else mark[page.parents[v]] if v else None
        exact.append(extraction.main_texts([source], model)[0] == page.text([m == "1" for m in mark]))
    assert np.mean(exact) > 0.85


def test_decoding_never_contradicts(fitted):
    pages, model = fitted
    rng = np.random.default_rng(3)
    for row in pages.limit(20).collect():
        page = Page(row.html)
        page.marks[len(page.tags) // 2] = "hidden"
        keep = extraction.decoded(page, rng.normal(0, 4, len(page.tags)))
        assert not keep[len(page.tags) // 2]


BROKEN = [
    ("", ""),
    (None, ""),
    ("plain words only, without any markup at all, as long as a sentence usually is, and then some more of it.", None),
    ("<article><p>a &lt;b&gt; &#233;&#x20AC; &amp;amp; c<p>d<b>e</b>f &nbsp; g<br>h</article>", "a <b> é€ &amp; c def g h"),
    ("<article><p>one<script>var t='</p>';</script> two<!-- three --><style>p{}</style></p><p>four", "one two four"),
    ('<div><p title="a>b">five six</p></div><unclosed attr="', None),
    ("<table><tr><td>x<td>y</table>" * 3, None),
    ("<div>" * 3000 + "deep", None),
    ("<p>" + "long words " * 50_000, None),
]


def test_edge_pages(spark, fitted):
    _, model = fitted
    rows = [(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(BROKEN)] + [(None, None, "<p>x", None), (3, "u3", BROKEN[3][0], "")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extraction.extracted(spark, frame, model).collect()
    assert len(got) == len(rows)
    texts = {r.page_id: r.text for r in got}
    assert texts[0] == texts[1] == ""
    assert extraction.extracted(spark, frame.limit(0), model).count() == 0
    assert extraction.fit(frame.limit(0)) is None
    plain = extraction.extracted(spark, frame, None).collect()
    assert len(plain) == len(rows)
    for i in (3, 4):
        page = Page(BROKEN[i][0])
        assert page.text([True] * len(page.tags)) == BROKEN[i][1]


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.BoostedTrees(trees=40).fit(x[:2000], y[:2000], np.ones(2000))
    assert np.mean((model.log_odds(x[2000:]) > 0) == (y[2000:] > 0)) > 0.95


def read_whole(source):
    page = Page(source)
    return page.text([True] * len(page.tags))


@pytest.mark.parametrize(
    "source, text",
    [
        ("<p>one<svg width='1'/> two<math/> three</p><article>four</article>", "one two three four"),
        ("<datalist><option>a<option>b</datalist><article><p>kept</article>", "kept"),
        ("<select><option>a<option>b</select><p>kept", "kept"),
        ("<p><option>a<article><p>kept</article><option>b</option><p>more", "kept more"),
        ("<div><button>Menu</div><article><p>kept</article><button>x</button><p>more", "kept more"),
        ("<button>Menu<article><p>kept</article>", "kept"),
        ("<button><div>Menu</div></button><p>kept", "kept"),
        ("<p>a<math><mi>x</mi></math>b <video><p>no</p></video>c", "ab c"),
        ("<svg><g><svg>no</svg>no</g></svg><p>kept", "kept"),
        ("<template><ul><li>no<li>no</ul></template><ul><li>kept<li>too</ul>", "kept too"),
        ("<p>a</p><script>no<p>no", "a"),
    ],
)
def test_dropped_elements_end(source, text):
    assert read_whole(source) == text


@pytest.mark.parametrize(
    "attributes, hidden",
    [
        ('class="overflow-hidden p-4"', False),
        ("class=hidden", False),
        ('aria-hidden="false"', False),
        ('title="The hidden valley"', False),
        ('style="overflow:hidden"', False),
        ("hidden", True),
        ('class="a" HIDDEN=""', True),
        ("aria-hidden='true'", True),
        ('style="color:red; display : none"', True),
        ("style='visibility:hidden'", True),
    ],
)
def test_hidden_is_an_attribute(attributes, hidden):
    assert (Page(f"<p {attributes}>x</p>").marks[1] == "hidden") == hidden
