"""Operator 3: end tags that are left out, broken tags, references, names of columns, very long pages."""

import pytest

pytest.importorskip("spaxelflow.llm")
from spaxelflow.llm import html_text  # noqa: E402

PAGES = {
    "<html><head><title>t</title><body><article><p>Hello there": "Hello there",
    "<html><head><title>t</title><meta charset=x><article><p>Hello": "Hello",
    "<head><title>t</title>\n<link rel=x>Words<p>more": "Words\nmore",
    "<head><style>p{}</style></head><body><main>a<p>b</main>": "a\nb",
    "<article><table><tr><td>a<td class=ad>x<td>b<tr><td>c<tbody><tr><th>d</table>e</article>": "a\nb\nc\nd\ne",
    "<article><table><tr><td class='side'>x<tr><td>y</table>z</article>": "y\nz",
    "<article><table><tr><td><table><tr><td>in<td>ner</table>out<td>cell</table></article>": "in\nner\nout\ncell",
    "<article><dl><dt class=menu>a<dd>b<dt>c<dd class=ad>d<dt>e</dl></article>": "b\nc\ne",
    "<article><ul><li class=ad>a<li>b<ul><li>c<li class=nav>d</ul><li>e</ul>f</article>": "b\nc\ne\nf",
    "<article>&<b>amp;</b> &amp;lt; &lt;p&gt; &am<!-- -->p; 1 &lt 2</article>": "&amp; &lt; <p> &amp; 1 < 2",
    "<article><p class=\"x>one<p>two</article>": "one\ntwo",
    "<article><p title='it's>one</p>two < three <4</article>": "one\ntwo < three <4",
    "<article><header><h1>Headline</h1></header><p>text</article>": "text",
    "": "",
    "<": "<",
    "<head>": "",
    "<article>" + "<p>word " * 60_000: "\n".join(["word"] * 60_000),
    "<div>" * 5_000 + "deep": "deep",
}


def test_blocks_of_odd_pages():
    for page, want in PAGES.items():
        assert "\n".join(t for _, t in html_text.blocks_of(page)) == want, page[:80]


def test_pages_and_names(spark):
    rows = [(k, f"http://h{k}.example/x", p, "t", 1) for k, p in enumerate(PAGES)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    out = html_text.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.text, r.n_chars) for r in out.collect()} == {k: (v, len(v)) for k, v in enumerate(PAGES.values())}
    with pytest.raises(ValueError, match="text"):
        html_text.main_text(pages, ["page_id", "text"])
