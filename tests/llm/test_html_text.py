"""op13: boosted trees against their definition, held-out layouts, and the given pages by their own template."""

import html
import itertools
import re

import numpy as np
import pytest

from plumbline.llm import html_text, page_dom
from plumbline.llm.page_samples import MARK, sample_page


@pytest.fixture(scope="module")
def forest():
    return html_text.fit()


def by_template(page):
    """The article of the given pages, by plain patterns of their one template."""
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:h1|p)>", inner[1]) if inner else []
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_given_pages(spark, sf, forest):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extract(pages, forest).collect()
    want = {r.page_id: by_template(r.html) for r in pages.collect()}
    assert len(got) == len(want) and sum(r.text == want[r.page_id] for r in got) >= 0.995 * len(want)


def test_held_out_layouts(forest):
    right = kept = wanted = exact = 0
    for k in range(200):
        page = sample_page(9_000_000 + k)
        nodes = page_dom.parse(page)
        y = html_text.truth(nodes)
        want = [n.text for n, v in zip(nodes, y) if v and n.text]
        got = html_text.main_texts([page.replace(MARK, "")], forest)[0].split("\n\n")
        right += len(set(want) & set(got))
        kept += len(set(got))
        wanted += len(set(want))
        exact += want == got
    assert right / kept > 0.97 and right / wanted > 0.97 and exact > 170, (right / kept, right / wanted, exact)


def test_site_parts_go(forest):
    page = """<!DOCTYPE html><html><head><title>t</title></head><body><div class="cookie-notice">We use cookies.</div><header><a href="/">Site name</a></header>
    <div class="content"><h1>Title &amp; more</h1><p>First paragraph of the text,\n which says&nbsp;something.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy this now.</div><p>Second one &#228; &lt;b&gt; here, with more to say.<br>And on.</div>
    <div class="sidebar"><h3>Related</h3><ul><li><a href=x>One</a></li></ul></div><form>Mail <input name=a> <button>Go</button></form>
    <section class="comments"><h3>Comments</h3><article><p>I liked this article a lot, thanks for writing it.</p></article></section><footer>&copy; somebody</footer></body></html>"""
    assert html_text.main_texts([page], forest) == ["Title & more\n\nFirst paragraph of the text, which says something.\n\nSecond one ä <b> here, with more to say. And on."]


@pytest.mark.parametrize("page", ["", " ", "<", "<p", "</p></div></ul>", "<!--", "<script>", "<p>a<p>b</b></i>", '<a href="x', "<table><tr><td>a<td>b<tr><td>c", "&am &amp &#xZZ;", "<ul><li>a<ul><li>b</ul><li>c</ul>", "<DIV><P CLASS='Ad'>x</DIV>", "<p>" * 3000, "<div>" * 3000 + "deep", "a\x00b\ud800"])
def test_broken_pages_never_fail(forest, page):
    nodes = page_dom.parse(page)
    assert all(n.parent < k for k, n in enumerate(nodes)) and all(k in nodes[n.parent].below for k, n in enumerate(nodes) if k)
    html_text.main_texts([page], forest)


def test_implied_ends():
    tags = lambda page: [(n.tag, n.parent) for n in page_dom.parse(page)[1:]]
    assert tags("<ul><li>a<ul><li>b</ul><li>c</ul>") == [("ul", 0), ("li", 1), ("", 2), ("ul", 2), ("li", 4), ("", 5), ("li", 1), ("", 7)]
    assert tags("<p>a<p>b<div>c</div>d") == [("p", 0), ("", 1), ("p", 0), ("", 3), ("div", 0), ("", 5), ("", 0)]


def test_decoding_is_the_best_consistent_choice():
    rng = np.random.default_rng(2)
    for _ in range(30):
        nodes = [page_dom.Node("div", -1, 0)] + [page_dom.Node("div", int(rng.integers(0, k)), 0) for k in range(1, 9)]
        p = rng.random(9)
        fits = [c for c in itertools.product([False, True], repeat=9) if all(not c[k] or c[nodes[k].parent] for k in range(1, 9))]
        best = max(fits, key=lambda c: sum(np.log(p[k] if v else 1 - p[k]) for k, v in enumerate(c)))
        assert html_text.decode(nodes, p) == list(best)


def test_boosting_lowers_the_loss_and_finds_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 1] > 0.4) & (x[:, 3] < 0.7)).astype(float)
    losses = []
    for trees in (1, 5, 30):
        q = np.clip(html_text.predict(html_text.boost(x, y, trees), x), 1e-9, 1 - 1e-9)
        losses.append(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    assert losses[0] > losses[1] > losses[2] and ((q > 0.5) == y).mean() > 0.98


def test_odd_rows(spark, forest):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "x", "<article><h1>A title</h1><p>Some words of text, here and there.</p></article>"), (4, "y", "<article><p>" + "word, " * 100_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as page", "'old' as text")
    got = html_text.extract(df, forest)
    assert set(got.columns) == {"page_id", "url", "html", "page", "text"}
    texts = sorted((str(r.page_id), r.text) for r in got.collect())
    assert texts == sorted([("1", ""), ("1", ""), ("2", ""), ("None", "A title\n\nSome words of text, here and there."), ("4", ("word, " * 100_000).strip())])
    assert html_text.extract(df.where("false"), forest).count() == 0
