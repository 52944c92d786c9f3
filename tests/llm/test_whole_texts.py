"""Operators of the subpackage do the whole job, against brute force."""

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest

from factloom.llm import fingerprints, html_extract, html_tree, pivots, queries, warc
from factloom.llm import vectext as V

SF = "/root/testdata/sf0.001"


def _prefix(text):
    return fingerprints.Prefix(np.frombuffer(text.encode("utf-32-le"), np.uint32))


def _exact_sketch(text):
    """Every window with its number of earlier occurrences in the whole text, one by one."""
    prefix, width, met, out = _prefix(text), min(fingerprints.WINDOW, len(text)), Counter(), []
    for k in range(len(text) - width + 1):
        window = text[k : k + width]
        out.append((prefix.span(k, k + width) + met[window] * 0x9E3779B97F4A7C15) % 2**64)
        met[window] += 1
    h, low = V.mix(np.array(out, np.uint64), 31), np.full(fingerprints.BINS, 2**64 - 1, np.uint64)
    np.minimum.at(low, (h % np.uint64(fingerprints.BINS)).astype(np.int64), h)
    return low


@pytest.mark.parametrize("step", [fingerprints.STEP, 500])
def test_repeats_count_over_the_whole_text(monkeypatch, step):
    monkeypatch.setattr(fingerprints, "STEP", step)
    r = random.Random(3)
    lines = ["".join(r.choice("abcdef ") for _ in range(r.randrange(5, 60))) + "\n" for _ in range(40)]
    texts = ["x", "short", "abc" * 5, "one line that repeats.\n" * 417, "".join(lines), "".join(r.choice(lines) for _ in range(300)), "ab" * 4000]
    for text in texts:
        assert (fingerprints.sketch(_prefix(text))[0] == _exact_sketch(text)).all()
    own, other = texts[3], texts[5][: len(texts[3])]
    edited = fingerprints._row((0, 1, own), (0, 2, other))
    kept = len(own) - len(own) // 3
    changed = own[:kept] + other[: len(own) // 3]
    assert edited[4] == fingerprints.fingerprint(_prefix(changed), _exact_sketch(changed))


def test_a_long_repetitive_text_against_half_of_it():
    line = "".join(random.Random(5).choice("abcdefgh ") for _ in range(2000)) + "\n"
    long, half = line * 400, line * 200
    one, two = (Counter(t[k : k + fingerprints.WINDOW] for k in range(len(t) - fingerprints.WINDOW + 1)) for t in (long, half))
    exact = 2 * (one & two).total() / (one.total() + two.total())
    got = fingerprints.likeness(*(fingerprints.fingerprint(_prefix(t), fingerprints.sketch(_prefix(t))[0]) for t in (long, half)))
    assert abs(exact - 2 / 3) < 0.01 and abs(got - exact) < 0.2


def _main_text(inside):
    body = "<p>Some words of the article come first, and then some more.</p>%s<p>The article ends here, after all the rest of it.</p>"
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>Head</h1>%s</article><footer>&copy; 2024 us</footer></body></html>"
    return html_extract.main_texts([page % (body % inside)], html_extract.model())[0]


FIRST, LAST = "Head Some words of the article come first, and then some more. ", " The article ends here, after all the rest of it."


def test_formulas_are_text():
    formula = "<math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><mspace/><mi>y</mi></math>"
    assert _main_text(f"<p>Here ({formula}) is a formula, set in the text.</p>") == FIRST + "Here (x2+y) is a formula, set in the text." + LAST
    assert "A drawing: Axis of the drawing Other The" in _main_text("<p>A drawing: <svg><path d='M0'/><g><text>Axis of the drawing</text><text>Other</text></g></svg></p>")


@pytest.mark.parametrize("tag", ["svg", "math", "select", "template", "noscript"])
def test_an_unclosed_element_loses_nothing(tag):
    for inside in (f"<{tag}>", f"<div><{tag}></div>", f"<p><{tag}>"):
        assert _main_text(inside).split() == (FIRST + LAST).split(), inside


def test_long_quoted_attributes():
    for size in (10, 70_000, 1_000_000):
        page = html_tree.parse(f"<p title='a > {'b' * size} > c' class=\"x>y\">It's <a href=x'>one</a> <b title=\"two>three</p>")
        assert "".join(t for _, t, _ in page.chunks) == "It's one three"
        assert page.tags == ["#root", "p", "a", "b"]
    assert html_tree.parse("<p t='" + "> " * 200_000 + "'>x").chunks == [(1, "x", 1)]


def test_near_vectors_of_every_length(spark):
    r = np.random.default_rng(8)
    rows = [(0, [1.0, 0.0, 0.0])]
    for size, many in ((64, 60), (32, 40), (5, 2)):
        for v in r.normal(size=(many // 2, size)):
            rows += [(len(rows), v.tolist()), (len(rows) + 1, (v + r.normal(size=size) * 0.05 * np.linalg.norm(v) / size**0.5).tolist())]
    want = {}
    for k, v in rows:
        want[k] = sum(len(v) == len(w) and k != j and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95 for j, w in rows)
    got = {x.vec_id: x for x in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {k: x.n_links for k, x in got.items()} == want
    assert sum(want.values()) >= 2 * 51 and all(got[k].component_id == (k if k % 2 else k - 1) for k in range(1, len(rows)) if want[k] == 1)


def test_all_references_are_decoded(spark):
    rows = [(1, "u", "<p>&copy; 2024 &middot; it&apos;s &#233;&#xe9;&nbsp;&#160;x &amp;lt; y &unknown; &lt;b&gt;</p>"), (2, "u", None)]
    made = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string"))).filter("warc_type = 'conversion'")
    got = {r.source_key: r for r in made.collect()}
    want = "\u00a9 2024 \u00b7 it's \u00e9\u00e9 x &lt; y &unknown; <b>"
    assert got[1].block == want and got[2].block == ""
    assert got[1].content_length == len(want.encode()) and got[1].block_digest == "sha256:" + hashlib.sha256(want.encode()).hexdigest()


def test_conversions_of_the_pages(spark):
    got = {r.source_key: r.block for r in queries.op2_warc_derivatives(spark, SF).filter("warc_type = 'conversion'").collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        text = re.sub(r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ", r.html)
        text = html.unescape(re.sub("<[^<>]*>", " ", text))
        assert got[r.page_id] == re.sub(r"[ \t\n\r\f\u00a0]+", " ", text).strip(" ")


@pytest.mark.parametrize("count", [128, 256, 512, 1024, 2048, 4096])
def test_near_vectors_share_reference_points_at_every_size(count):
    r = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    one, two = unit(r.normal(size=(4000, 64))), r.normal(size=(4000, 64))
    two = 0.95 * one + (1 - 0.95**2) ** 0.5 * unit(two - (one * two).sum(1, keepdims=True) * one)
    points, order, many = unit(r.normal(size=(count, 64))), np.arange(count), pivots.described(count)
    a, b = (pivots.nearest(x, points, order, many) for x in (one, two))
    shared = (a[:, :, None] == b[:, None, :]).sum((1, 2))
    assert (shared >= pivots.SHARED).mean() > 0.965


def test_more_reference_points_find_the_same_links(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = []
    for v in r.normal(size=(300, 64)):
        rows += [(len(rows), v.tolist()), (len(rows) + 1, (v + r.normal(size=64) * 0.1).tolist())]
    monkeypatch.setattr(pivots, "PIVOTS", 256)
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [x.n_links for x in got] == [1] * 600
