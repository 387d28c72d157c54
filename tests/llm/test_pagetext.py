import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from newsweave.llm import pagetext as pt
from newsweave.llm import queries
from newsweave.llm.labelled_pages import LABELLED


@pytest.fixture(scope="module")
def model():
    return pt.TreeModel(pt.train())


def test_marginals_against_all_labellings(model):
    page = "<body><nav><ul><li><a>x</a></li></ul></nav><article><h1>T</h1><p>some text</p></article><footer>f</footer></body>"
    nodes, _ = pt.parsed(page)
    look = [0.0] + [sum(model.look.get(f, 0) for f in pt.looks(n)) for n in nodes[1:]]
    total, content = 0.0, [0.0] * len(nodes)
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        w = math.exp(-20.0 * labels[0] + sum(look[i] * y for i, y in enumerate(labels)) + sum(model.tie[labels[n.parent]][y] for n, y in zip(nodes[1:], labels[1:])))
        total += w
        content = [c + w * y for c, y in zip(content, labels)]
    assert model.marginals(nodes) == pytest.approx([c / total for c in content], abs=1e-9)


def test_labelled_pages(model):
    wrong = total = 0
    for page in LABELLED:
        nodes, blocks = pt.parsed(page)
        p = model.marginals(nodes)
        total += len(blocks)
        wrong += sum((p[n] >= pt.CONTENT) != nodes[n].main for n, _ in blocks)
    assert wrong <= 0.03 * total


def test_left_out_pages():
    """Each page by a model that was trained without it."""
    wrong = total = 0
    for i, page in enumerate(LABELLED):
        model = pt.TreeModel(tuple(LABELLED[:i] + LABELLED[i + 1:]))
        nodes, blocks = pt.parsed(page)
        p = model.marginals(nodes)
        total += len(blocks)
        wrong += sum((p[n] >= pt.CONTENT) != nodes[n].main for n, _ in blocks)
    assert wrong <= 0.2 * total


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<article><h1>A</h1><p>One<b> two<br>three<p>Four&nbsp;&lt;5<!-- no > --><script>if (a<b) '</p>'</script> six</article><footer>x", "A\nOne two three\nFour <5 six"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>", "a\nb\nc\nd\ne"),
    ("<article><p>a</div></span>b</p>tail</article>", "ab\ntail"),
    ("<article><p>ok</p><style>p{}</style><textarea>typed</textarea><noscript>js</noscript></article>", "ok"),
])
def test_reading(model, page, text):
    assert model.text(page) == text


def article_blocks(html):
    """The blocks of the only article of a given page, read by its plain markup."""
    import html as h
    body = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(h.unescape(re.sub(r"<br>|</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf, read):
    html = {r["page_id"]: r["html"] for r in read("pages").collect()}
    got = queries.QUERIES["op7_pagetext"](spark, sf).collect()
    assert len(got) == len(html)
    for r in got:
        assert r["text"] == article_blocks(html[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_odd_rows(spark, odd_texts):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    pages = spark.createDataFrame([(i, "u", t) for i, t in enumerate([*odd_texts, deep, "<p" * 5000, "<!--" * 1000, "<a href='" + "x" * 50000])], "page_id long, url string, html string")
    got = pt.main_text(pages.withColumns({"text": F.lit("clash"), "n_chars": F.lit("y")}), pt.train())
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert got.count() == len(odd_texts) + 4
    assert pt.main_text(pages.limit(0), pt.train()).collect() == []


@pytest.mark.parametrize("markup, text", [
    ("<p title=it's>Hello", "Hello"),
    ("<p title=it's class=\"a>b\">Hello</p>", "Hello"),
    ("<a href=x?a='1>one</a> two", "one two"),
    ("<p data-x='a > b' title = \"c > d\">text</p>", "text"),
    ("super<wbr>cali<img src=x>fragile", "supercalifragile"),
    ("one<br>two<br/>three", "one two three"),
    ("a<script>x < y</script>b<style>p{}</style>c<!-- - -->d", "abcd"),
    ("a &<b>amp;</b> b", "a &amp; b"),
    ("&lt;p&gt; &#65;&#x42; &nbsp; &copy", "<p> AB ©"),
    ("x <math><mi>a</mi><mo>+</mo><mi>b</mi></math> y", "x a+b y"),
    ("<svg><text>label</text></svg> and <object>fallback</object>", "label and fallback"),
    ("<p>one<p>two</div>", "one\ntwo"),
    ("<b>bold</b><i>italic</i> <u> under </u>", "bolditalic under"),
    ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
    ("<p =odd==x>still</p>", "still"),
    ("<p title=\"never closed>text", "text"),
])
def test_hard_markup(markup, text):
    """Blocks of a page whose every node is content, against what a browser shows."""
    _, blocks = pt.parsed(f"<article>{markup}")
    assert "\n".join(t for _, t in blocks) == text
