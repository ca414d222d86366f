"""Quality rules, URL lists, extraction, voting and language fusion on small inputs."""

import html as entities
import re

import duckdb
import pytest
from llm_texts import documents  # noqa: F401

from gridsieve.llm import html_graph, language_id, quality_rules, quality_votes, url_intervals
from gridsieve.llm.html_pages import labelled_pages


def same(df, sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toArrow())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in cur.fetchall())
    got = sorted(tuple(str(r[c]) for c in order) for r in df.collect())
    assert got == want and got


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "a b c d e f g h " * 5), (5, "a b c d e f g h " * 5),
    (6, "Line one is here.\nLine one is here.\n \nhome | about | contact\nMore text that ends well."),
    (7, "a b c d e f g h i a b c d e f g h j k l m n o p q r s t u v w x y z."),
    (8, "Accept the cookie policy.\n" + "This is a fine sentence, it goes on and on. " * 2),
    (None, "Id is missing here. " * 12), (9, "x" * 5000 + " é ü " * 40), (10, "w " * 20_000),
    (11, "ALL CAPS LINE!!\n" * 3), (12, "\x0bvt\x0cff\rcr sep. " * 9),
]


def test_quality_rules(spark, documents, sf_dir):
    docs = documents(ODD)
    same(quality_rules.quality_report(docs), quality_rules.quality_sql(), documents=docs.coalesce(1))
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same(quality_rules.quality_report(real), quality_rules.quality_sql(), documents=real)
    cleaned = quality_rules.clean_lines(docs.selectExpr("*", "1 AS kept")).where("doc_id = 6").first()
    assert "about" not in cleaned.clean_text and "ends well" in cleaned.clean_text
    assert quality_rules.quality_report(documents([])).count() == 0


def test_url_intervals(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    odd = spark.createDataFrame([(900, None), (901, "no url"), (902, "http://A.B.C.:80/x"), (903, "ftp://u@h/")], "page_id bigint, url string")
    pages = pages.unionByName(odd)
    same(url_intervals.url_filter(pages), url_intervals.URL_SQL, pages=pages)
    captures = spark.createDataFrame(
        [("http://x.a.com/", 5), ("http://x.a.com/", 9), ("http://x.a.com/", 20), ("http://a.com", 9), (None, 9), ("http://a.com", None)],
        "url string, fetch_day int",
    )
    entries = spark.createDataFrame(
        [("A.com", 8, "block"), ("x.a.com", 15, "allow"), ("a.com", 8, "allow"), (None, 1, "block")],
        "domain string, day int, action string",
    )
    got = {(r.url, r.fetch_day): r.kept for r in url_intervals.filter_captures(captures, entries).collect()}
    assert got == {("http://x.a.com/", 5): True, ("http://x.a.com/", 9): False, ("http://x.a.com/", 20): True,
                   ("http://a.com", 9): False, (None, 9): True, ("http://a.com", None): True}


@pytest.fixture(scope="module")
def model():
    return html_graph.train(labelled_pages())


def test_extraction(spark, sf_dir, model):
    wrong = total = 0
    for page in labelled_pages(80, seed=5):
        read = html_graph.read_page(page)
        features, parent = html_graph._forest([read])
        content, _ = model.marginals(features, parent)
        for node, _ in read.runs:
            total += 1
            wrong += (content[node] > 0.5) != read.label[node]
    assert wrong < 0.02 * total
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in html_graph.extract_pages(pages, model).collect():
        inside = re.search("<article>(.*)</article>", raw[r.page_id], re.S).group(1)
        inside = re.sub("</?b>", "", inside)
        assert r.text == " ".join(entities.unescape(re.sub("<[^>]+>", " ", inside)).split())
        assert r.n_chars == len(r.text)


def test_messages_equal_enumeration(model):
    import itertools

    import numpy as np

    read = html_graph.read_page("<body><nav><ul><li>x</li></ul></nav><article><p>Some text.</p></article></body>")
    features, parent = html_graph._forest([read])
    content, _ = model.marginals(features, parent)
    where = html_graph.under_body(features, parent)
    n, mass, ones = len(parent), 0.0, np.zeros(len(parent))
    for y in itertools.product((0, 1), repeat=n):
        e = sum(float(features[i] @ model.weights) * y[i] for i in range(n))
        e += sum(model.edges[where[i], y[parent[i]], y[i]] for i in range(1, n))
        mass += np.exp(e)
        ones += np.exp(e) * np.array(y)
    assert np.allclose(ones / mass, content, atol=1e-6)


def test_odd_pages(model):
    for page in (None, "", "<", "<p", "<!DOCTYPE", "</div></p>", "<script>x", "<div>" * 3000, "<![CDATA[x", "&#0;&bad;<br/>"):
        assert isinstance(html_graph.main_texts(model, [page])[0], str)


def test_votes(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_votes.quality_votes(docs, labels).collect()}
    known = [(rows[r.doc_id], r.quality) for r in labels.collect()]
    tested = [(r.predicted, q) for r, q in known if r.held_out]
    assert len(tested) > 50 and sum(p == q for p, q in tested) > 0.93 * len(tested)
    # Labels of held-out rows change nothing.
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    again = quality_votes.quality_votes(docs, flipped).collect()
    assert all(abs(r.score - rows[r.doc_id].score) < 1e-9 for r in again)


def test_votes_on_odd_rows(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    got = quality_votes.quality_votes(documents([(1, None), (2, ""), (None, "a b")]), none).collect()
    assert [r.score for r in got] == [0.5] * 3 and not any(r.held_out for r in got if r.doc_id is None)


def test_languages(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pages = docs.where("doc_id % 5 = 1").selectExpr(
        "doc_id as page_id", "'http://h.example.com/x' as url", "concat('<p>', text) as html", "lang"
    )
    got = language_id.identify_languages(pages, docs.where("doc_id % 5 <> 1"))
    both = got.join(pages.selectExpr("page_id", "lang as truth"), "page_id").collect()
    assert sum(r.lang == r.truth for r in both) > 0.97 * len(both)
    odd = spark.createDataFrame([(1, None, None), (2, "http://de.x.org/", "<html lang=de>")], "page_id bigint, url string, html string")
    found = {r.page_id: r for r in language_id.identify_languages(odd, docs).collect()}
    assert found[2].lang == "de" and found[1].lang is not None and 0 < found[1].probability <= 1
    assert language_id.identify_languages(odd, docs.limit(0)).count() == 2


def test_text_after_unknown_marked_sections():
    for odd in ("<![foo]>", "<![important]", "<![ x ]>", "<![]>", "<![%a;[x]]>", "<![CDATA[x]]>", "<![if x]>"):
        page = html_graph.read_page(f"<body><p>one</p>{odd}<p>two</p><p>three</p></body>")
        assert [t for _, t in page.runs][-1] == "three" and page.runs[0][1] == "one", odd
        if odd != "<![important]":  # ends at the '>' of the next tag
            assert [t for _, t in page.runs] == ["one", "two", "three"], odd
    for odd in ("<![", "<![foo", "<![foo]", "<![ x", "<!", "<!D", "<!ELEMENT [", "<![CDATA[x", "<![if"):
        assert html_graph.read_page(f"<p>one</p>{odd}").runs[0][1].startswith("one"), odd


def test_text_after_unclosed_hidden_elements():
    texts = lambda html: [t for _, t in html_graph.read_page(html).runs]
    for head in ("<head><title>t</title>", "<head><title>t</title></head>", "<head><meta x><link y>",
                 "<head><title>t</title><script>a < b</script><style>c</style>", "<head><noscript><img>", ""):
        for body in ("<body>", "<body class=x>"):
            assert texts(f"<html>{head}{body}<article><p>one</p><p>two</p></article></html>") == ["one", "two"], head
    assert texts("<html><head><title>t</title><div><p>one</p></div>") == ["one"]
    assert texts("<head><title>t</title>one<p>two</p>") == ["one", "two"]
    for tag in ("noscript", "object", "iframe", "canvas", "audio", "video", "svg", "math", "template"):
        assert texts(f"<body><div>one<{tag}></div><p>two</p></body>") == ["one", "two"], tag
        assert texts(f"<body><div>one<{tag}>x<b>y</b></{tag}> two</div><p>three</p></body>") == ["one two", "three"], tag
    assert texts("<p>one</p><svg><path d='m'><g><p>two</p><p>three</p>") == ["one", "two", "three"]
    assert texts("<p>one</p></noscript></svg><p>two</p>") == ["one", "two"]
