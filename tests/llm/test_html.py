import itertools
import random
import re
import time

import numpy as np
import pytest

from starmart.llm import html_extract as H
from starmart.llm import queries
from starmart.llm.labelled_pages import labelled_page, labelled_pages

from .conftest import SMALL


@pytest.fixture(scope="module")
def model():
    return H.train(labelled_pages())


def labelled_text(source):
    """The text of a labelled page by its own labels."""
    page = H.parse(source)
    own = []
    for x in page.nodes:
        own.append(x.label if x.label is not None else (own[x.parent] if x.parent >= 0 else 0))
    return "\n".join(t for node, t in page.blocks if own[node])


def test_marginals_are_exact(model):
    """Sum-product against the sum over all labellings of small trees."""
    for source in ("<div>a<p>b</p><p>c <a>d</a></p></div><nav><ul><li>e</ul></nav>", "<p>x", "<main><section><p>a.</p></section></main>"):
        trees = H.Forest([H.parse(source)], model)
        p, q = trees.marginals()
        n = len(trees.parent)
        node, edge, z = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for y in itertools.product((0, 1), repeat=n):
            s = sum(trees.score[i, y[i]] for i in range(n)) + sum(trees.pair[i, y[trees.parent[i]], y[i]] for i in range(1, n))
            z += np.exp(s)
            for i in range(n):
                node[i, y[i]] += np.exp(s)
                if i:
                    edge[i, y[trees.parent[i]], y[i]] += np.exp(s)
        assert np.allclose(p, node / z) and np.allclose(q, edge / z)


def test_unseen_layouts(model):
    rng = random.Random(987)
    sources = [labelled_page(rng) for _ in range(400)]
    plain = [re.sub(r' data-label=["\']\d["\']', "", s) for s in sources]
    got = H.extract_texts(plain, model)
    want = [labelled_text(s) for s in sources]
    exact = sum(a == b for a, b in zip(got, want)) / len(want)
    kept = lost = extra = 0
    for a, b in zip(got, want):
        x, y = a.split("\n"), b.split("\n")
        kept += sum(len(t) for t in y)
        lost += sum(len(t) for t in y if t not in x)
        extra += sum(len(t) for t in x if t not in y)
    assert exact > 0.85 and lost < 0.02 * kept and extra < 0.02 * kept


def test_given_pages(spark):
    """The article of each page of the test data is known by its tag."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op8_html_extraction(spark, SMALL).collect()}
    assert len(got) == len(pages)
    for r in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        want = "\n".join(t for _, t in H.parse(article).blocks)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


def test_blocks():
    source = "<div>one  two\n three<br>four <b>bo</b>ld&amp;&eacute;<p>  par <span>x</span>y</p>tail<ul><li>a<li>b</ul><script>if (a<b) '</div>'</script><!-- no <p>text -->&lt;end&gt;</div>after"
    assert [t for _, t in H.parse(source).blocks] == ["one two three four bold&é", "par xy", "tail", "a", "b", "<end>", "after"]


@pytest.mark.parametrize("source", [None, "", " ", "<", "<p", "</div></p>", "<div" * 500, "<!--", "<script>", "<table><tr><td>x", "plain text only", "<b><i><u>" * 300 + "x", "<div>" * 3000 + "deep. Text of it here, long enough to be some prose."])
def test_broken_pages(model, source):
    assert isinstance(H.extract_texts([source], model)[0], str)
    if not (source or "").strip():
        assert H.extract_texts([source], model) == [""]


def test_long_page_and_empty_table(spark, model):
    long = "<html><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Title of it</h1>" + "".join(f"<p>Paragraph number {i} of a long article, with words.</p>" for i in range(20_000)) + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", long, 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r["text"] for r in H.extract(df, model).collect()}
    assert got[1].count("\n") == 20_000 and "home" not in got[1] and got[2] == ""
    out = H.extract(df, model)
    assert out.columns == ["page_id", "url", "html", "text"] and out.count() == 3 and H.extract(df.limit(0), model).count() == 0


@pytest.mark.parametrize("value", ['data-label="Price"', 'data-label=""', "data-label=Total", 'data-label="²"', 'data-label="-1"'])
def test_labels_of_real_pages(model, value):
    """An attribute of the page's own that is named like the training label changes nothing."""
    source = "<article><h1>A title of it</h1><p>Prose of some length, with words; and more of it.</p><table><tr><td {}>4.50, or less.</td></tr></table></article>"
    assert H.extract_texts([source.format(value)], model) == H.extract_texts([source.format("")], model)
    assert all(x.label is None for x in H.parse(source.format(value)).nodes)


PROSE = "Prose of some length, with words in it; and more of them, to be read by someone."


@pytest.mark.parametrize("head", ["<head><title>T</title>", "<head><meta charset=utf-8><link rel=x><style>p{}</style><script>1</script>", "<head><noscript><link rel=x></noscript>", "<head>"])
def test_head_without_an_end(model, head):
    """A head that the page leaves open ends where its content does."""
    assert H.extract_texts([f'<html>{head}<div class="article"><h1>A title</h1><p>{PROSE}</p></div>'], model) == [f"A title\n{PROSE}"]
    assert [t for _, t in H.parse(f"<html>{head} plain text<p>and more").blocks] == ["plain text", "and more"]


@pytest.mark.parametrize("inner", [
    "The sum <math><mi>a</mi><mo>+</mo><mi>b</mi></math> is small, as said.",
    "<noscript>A picture of the hills, seen from the east.</noscript>",
    "<object data=x>A film of the hills, with sound.</object>",
    "<canvas>A chart of the rainfall, by month and year.</canvas>",
    "<video src=x>A film of the hills, with sound.</video>",
    "<svg viewBox='0 0 1 1'><title>no</title><path d='x'/><circle r=1 /><text>The hills, drawn by hand.</text></svg>",
])
def test_text_that_stands_in(model, inner):
    source = f'<article><h1>A title of it</h1><p>{PROSE}</p><div>{inner}</div><p>{PROSE}</p></article>'
    want = re.sub(r"<[^>]*>", "", re.sub(r"<title>.*?</title>", "", inner))
    assert H.extract_texts([source], model) == [f"A title of it\n{PROSE}\n{want}\n{PROSE}"]


def test_ends_of_tags():
    blocks = lambda source: [t for _, t in H.parse(source).blocks]
    assert blocks('<p title="a > b" x=\'c > "d\'>one<p q=a"b>two<p "odd>three') == ["one", "two", "three"]
    assert blocks('<p title="never closed>one<p>two') == ["one", "two"]
    assert blocks("a <b and c") == ["a <b and c"]
    assert blocks("<b>x<div>y</b>z</div>") == ["x", "yz"]
    assert blocks("&#0000000065;&#65;&#x41;&#99999999999;&#" + "9" * 6000 + ";&#" + "0" * 6000 + "65;") == ["AAA\ufffd\ufffdA"]


@pytest.mark.parametrize("source", [
    '<a "' * 250_000, '<a ="><a "' * 100_000, '<a x="' * 160_000 + '>"', "<a x='\">" * 120_000, "<a " + "b" * 1_000_000 + ">x", "<p " + "b='" * 300_000 + ">",
    "<a" * 500_000, "<!" * 500_000, "<b>" * 100_000 + "<p>x" * 100_000, "<div><b>" * 30_000 + "</i></u></b>" * 60_000, "<div>" * 100_000 + "</p></nav>" * 100_000, "<li>" * 200_000,
], ids=range(12))
def test_time_of_broken_pages_is_linear(model, source):
    start = time.process_time()
    H.extract_texts([source], model)
    assert time.process_time() - start < 25
