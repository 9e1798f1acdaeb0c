"""Main text of pages: the cutter on awkward markup, gradients, layouts that weren't trained on, the table's articles."""

import re

import numpy as np
import pytest

from graphloom.llm import blocks

SCHEMA = "page_id long, url string, html string, text string, n_chars string, score double"
D = "/root/testdata/sf0.001"


def cut(page):
    return [b.text for b in blocks.blocks_of(page)]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("no markup at  all\n", ["no markup at all"]),
        ("a < b &amp; c &lt;d&gt; &#8364;&#x20ac; &nbsp;x &unknown; &amp;amp;", ["a < b & c <d> €€ x &unknown; &amp;"]),
        ("<p>one<p>two<br>three<b>four</b>five", ["one", "two threefourfive"]),
        ("<div><p><b>open<br><p>next</div>after</article>", ["open", "next", "after"]),
        ("<script>var t='</p>';</script>x<style>p{}</style><!-- <p>no</p> -->y", ["xy"]),
        ("a<script>never closed <p>b</p>", ["a"]),
        ("<title>t</title><textarea>n</textarea><SELECT><option>o</option></SELECT><p CLASS='x>y'>in</p>", ["in"]),
        ("<td>1<td>2<tr><td>3", ["1", "2", "3"]),
        ('<p title="unclosed>text</p>', ["text"]),
        ("<!DOCTYPE html><?xml x?><p>x<!-- unclosed", ["x"]),
        ("<br/><hr><img alt='a>b'>t", ["t"]),
    ],
)
def test_cutting(page, want):
    assert cut(page) == want


def test_long_and_deep_pages():
    assert len(cut("<div>" * 20_000 + "x" + "<p>y" * 5_000)) == 5_001
    assert cut("<p>" + "word " * 300_000)[0].count(" ") == 299_999


def test_gradients():
    model = blocks.Labeller.fresh(1)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    r = np.random.default_rng(2)
    xs = [r.random((n, blocks.INPUT)) * (r.random((n, blocks.INPUT)) < 0.05) for n in (1, 4, 7)]
    ys = [r.integers(0, 2, len(x)).astype(float) for x in xs]
    _, grads = model.gradients(xs, ys)
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(r.integers(0, k) for k in value.shape)
            if name == "e":
                at = (np.flatnonzero(xs[1][2])[0], at[1])
            kept, step = value[at], 1e-3
            value[at] = kept + step
            up = model.gradients(xs, ys)[0]
            value[at] = kept - step
            down = model.gradients(xs, ys)[0]
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4), name


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{D}/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return blocks.train(pages)


def test_scores_do_not_depend_on_company(model, pages):
    cuts = [blocks.blocks_of(r.html) for r in pages.limit(30).collect()]
    together = model.scores([*cuts, [], blocks.blocks_of("<p>x" * 40_000)])
    assert together[-2].size == 0 and len(together[-1]) == 40_000
    for b, s in zip(cuts, together, strict=False):
        assert np.allclose(model.scores([b])[0], s, atol=1e-4)


def test_given_articles(spark, model, pages):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{D}/pages.parquet'")
    want = sorted(c.execute(blocks.OP11_SQL).fetchall())
    assert sorted(map(tuple, blocks.extract(pages, model).collect())) == want


def test_other_layouts(model, pages):
    cuts = [blocks.blocks_of(r.html) for r in pages.limit(80).collect()]
    inside = [[x.text for x in b if blocks._in_article(x)] for b in cuts]
    layouts = blocks.Layouts(1234, inside, [x.text[:100] for b in cuts for x in b if not blocks._in_article(x)])
    right = wrong = missed = 0
    for _ in range(200):
        b, y = layouts.page()
        s = model.scores([b])[0] >= 0.5
        right, wrong, missed = right + (s & y).sum(), wrong + (s & ~y).sum(), missed + (~s & y).sum()
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


def test_written_page(model):
    page = """<html><body><header class="site"><h1>My Site</h1><a href=/>Home</a></header><div id="cookie-bar"><p>We use cookies. Accept?</p></div>
    <div class="layout"><div class="main-column"><h1>The fall of a tower</h1><p>It was a rainy day when the tower fell, and many came.</p><div class="advert-slot">Buy
    shoes now.</div><p>Nobody was hurt, said the mayor.</p><ul><li>First point made.</li></ul></div><aside><h3>Most read</h3><p>Another story.</p></aside>
    <div id="comments"><h2>3 comments</h2><div class="comment"><p>I was there and saw it all happen.</p></div></div></div><form><p>Subscribe</p></form><footer><p>Copyright 2020</p></footer></body></html>"""
    found = blocks.blocks_of(page)
    text = " ".join(b.text for b, s in zip(found, model.scores([found])[0], strict=True) if s >= 0.5)
    assert "It was a rainy day when the tower fell, and many came." in text and "Nobody was hurt, said the mayor. First point made." in text
    assert not re.search("cookies|shoes|Another story|comments|I was there|Subscribe|Copyright", text)


def test_nulls_and_clashes(spark, model):
    rows = [(1, "u", None, "t", "n", 0.1), (None, None, "", "t", "n", 0.1), (2, "u", "<article><p>Some text of it.</p></article>", "t", "n", 0.1)] * 2 + [(3, "u", "<div></div>", "", "", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = sorted(map(tuple, blocks.extract(df, model).collect()), key=repr)
    assert got == sorted([(1, "u", "", 0), (None, None, "", 0), (2, "u", "Some text of it.", 16)] * 2 + [(3, "u", "", 0)], key=repr)
    assert blocks.extract(df.filter("false"), model).collect() == []
    assert blocks.train(df.filter("false"), layouts=20, epochs=1).p["e"].shape == (blocks.INPUT, blocks.DENSE)
