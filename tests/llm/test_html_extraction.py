import html
import re
import time

import numpy as np
import pytest

from tessera.llm import html_extraction as h


@pytest.fixture(scope="module")
def weights():
    return h.labeller()


def test_blocks():
    page = "<html><head><title>t</title></head><body><div class='Side-Bar x1'>a<b>b</b> c&nbsp;&amp; d<p>one\n two<p>three<br>four</div><script>'</p>'</script><!-- x -->end <a hre"
    found = h.blocks_of(page)
    assert [b.text for b in found] == ["ab c & d", "one two", "three four", "end"]
    assert found[1].path == ("html", "body", "div", "side", "bar", "x", "p") and found[3].path == ("html", "body")
    assert h.blocks_of("") == [] and h.blocks_of("<p>") == []
    assert h.blocks_of("<ul><li><a href=x>link</a><li>x</ul>")[0].linked == 4


def words(page):
    return [b.text for b in h.blocks_of(page)]


def test_odd_markup_loses_nothing():
    assert words('<body><article><svg class="i"/><p>first para</p><p>second</p></article></body>') == ["first para", "second"]
    assert words("<p data-x=don't>alpha</p><p>beta</p><p>it's gamma</p>") == ["alpha", "beta", "it's gamma"]
    assert words("<p title='a > b' x=\"c > d\">one</p>a < b, c<3 d") == ["one", "a < b, c<3 d"]
    assert words("<nav><svg><path d=1></nav><p>a <svg><text>no</text></svg>b<p>c<math><mi>x</mi></math>") == ["a b", "cx"]
    assert words("<head><meta x><noscript><p>no<body><p>yes") == ["yes"] and words("<head><style>no</style><p>yes") == ["yes"]
    assert words("<noscript><div><p>no</div>no</noscript>yes<template><div>no</div></template>") == ["yes"]
    assert words("<div><object>no<p>no</div>yes<script>no</p>") == ["yes"] and words("a</>b<!x>c<?y>d<!-- > --") == ["abcd"]


def test_long_pages_take_linear_time():
    began = time.time()
    for part in ('<a title="', '<a title="x" ', "<div>x", "<p>x</p>", "<svg>", "</b>x", "<!-- x", "&amp", "< ", "<i", "<ul><li>x"):
        h.blocks_of(part * (1_000_000 // len(part)))
    assert time.time() - began < 60


def test_gradients():
    rng = np.random.default_rng(0)
    weights = {k: v.astype(np.float64) for k, v in h._start(rng).items()}
    x, mask = rng.normal(size=(4, 2, h.FEATURES)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    pull = rng.normal(size=(4, 2, h.HIDDEN)) * mask[..., None]
    for side in "fb":
        value = lambda: float((h._forward(weights, x, mask, side)[0] * pull).sum())  # noqa: B023, E731
        grads = {k: np.zeros_like(v) for k, v in weights.items()}
        h._backward(weights, grads, x, h._forward(weights, x, mask, side)[1], pull, side)
        for name in ("x" + side, "h" + side, "c" + side):
            at = tuple(rng.integers(0, n) for n in weights[name].shape)
            weights[name][at] += 1e-4
            above = value()
            weights[name][at] -= 2e-4
            below = value()
            weights[name][at] += 1e-4
            assert grads[name][at] == pytest.approx((above - below) / 2e-4, rel=0.02, abs=1e-3)


def test_held_out_accuracy(weights):
    pages = h.training_pages(200, 99)
    right = np.concatenate([(p > 0.5) == t for p, (_, t) in zip(h.label(weights, [v for v, _ in pages]), pages, strict=True)])
    assert right.mean() > 0.97


def article(page):
    found = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:h1|p)>", re.sub(r"<[a-z/!][^>]*\Z", "", found[1]))
    texts = (" ".join(html.unescape(re.sub(r"</?[a-z]+[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n\n".join(t for t in texts if t)


def test_rows(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = h.extract(pages).collect()
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    assert len(rows) == len(truth) and sum(r.text == truth[r.page_id] for r in rows) >= 0.96 * len(rows)
    assert all(r.n_chars == len(r.text) for r in rows)
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (2, "u", "<nav><a href=x>y</a></nav>"), (3, None, "<p" * 1000)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in h.extract(odd).collect()] == [("", 0)] * 4
    assert h.extract(odd.limit(0)).count() == 0
    page = "<html><body><nav><ul>" + "<li><a href=/x>menu</a>" * 5 + "</ul></nav><article>" + "<p>This is a sentence of the article, and here is another one of it.</p>" * 3000 + "</article></body></html>"
    names = {"rows": "x", "text": "y", "n_chars": "z", "block": "w", "path": "v"}
    shared = spark.createDataFrame([(None, None, page), (None, "u", page)], "page_id long, url string, html string").selectExpr("*", *(f"'{v}' AS {k}" for k, v in names.items()))
    found = h.extract(shared).collect()
    assert len(found) == 2 and {r.text.count("another one") for r in found} == {3000} and all("menu" not in r.text for r in found)
