"""What a page shows: hidden elements, open comments, deep and broken markup, odd tables."""

import time

import pytest
from pyspark.sql import functions as F

from gridsieve.llm import html_graph
from gridsieve.llm.html_graph import extract_pages, read_page
from gridsieve.llm.html_pages import labelled_pages


def runs(html):
    return [text for _, text in read_page(html).runs]


@pytest.mark.parametrize(
    "html, shown",
    [
        ("<p>a<div hidden>b<p>c</div>d", ["a", "d"]),
        ('<p style="color:red; display : none">e</p>f', ["f"]),
        ('<p style="display:none !important">e</p>f', ["f"]),
        ('<p style="display:nonesuch">e</p>f', ["e", "f"]),
        ("f<span hidden>g<span>h</span>i</span>j", ["fj"]),
        ('<i style="visibility:hidden">n</i>m</i>', ["m"]),
        ("<p hidden>x<p>y</p><ul><li hidden>1<li>2</ul>", ["y", "2"]),
        ("w<input hidden>v<script>s</script>z", ["wvz"]),
        ("<div hidden><script>s</script>t</div>u", ["u"]),
        ("a<!-- b <p>c</p>", ["a"]),
        ("a<!-- b --><p>c</p>", ["a", "c"]),
        ('<p data-hidden="1">a</p>', ["a"]),
    ],
)
def test_shown_text(html, shown):
    assert runs(html) == shown


def test_deep_and_broken_markup_takes_linear_time():
    began = time.process_time()
    page = read_page("<div>" * 5000 + "</section></span>" * 20000 + "<li>" * 5000 + "end")
    assert page.runs[-1][1] == "end"
    assert time.process_time() - began < 3


def test_odd_tables(spark):
    """Nulls, repeated rows, clashing columns and an empty table."""
    html = "<nav><a href=x>menu</a></nav><article><h1>Title</h1><p>" + "Some words here. " * 30 + "</p></article>"
    rows = [(1, "u", html), (1, "u", html), (None, None, None), (2, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"text": F.lit("clash"), "n_chars": F.lit(-1)}
    )
    found = sorted(((r.page_id or 0), r.url, r.text, r.n_chars) for r in extract_pages(pages).collect())
    want = "Title " + ("Some words here. " * 30).strip()
    assert [f[0] for f in found] == [0, 1, 1, 2]
    assert [f[2] for f in found] == ["", want, want, ""]
    assert [f[3] for f in found] == [0, len(want), len(want), 0]
    assert extract_pages(pages.limit(0)).count() == 0


def test_content_without_an_element_of_its_own():
    line = "The committee met on Tuesday to talk about the budget. Several members asked what it costs. "
    want = line.strip()
    model = html_graph.train(labelled_pages())
    pages = {
        f"<html><body>{line}</body></html>": want,
        line: want,
        f"<p>{line}</p>{line}<p>{line}</p>": " ".join([want] * 3),
        f"<body> <b>The</b>{line[3:]}</body>": want,
        f"<html><body><div><div><div><p>{line}</p></div></div></div></body></html>": want,
        f"<body><nav><a href=x>Home</a> <a href=y>News</a></nav>{line}<footer>Copyright</footer></body>": want,
    }
    assert html_graph.main_texts(model, list(pages)) == list(pages.values())
