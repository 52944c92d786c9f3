"""Language ID, toxicity, HTML extraction: held-out accuracy and odd rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import html_extract, html_tree, html_training, langid, queries, toxicity

SF = "/root/testdata/sf0.01"
LONG = "The quick words of this text go on. " * 40_000


def odd(spark):
    rows = [(1, None, "en", 5.0), (2, "", "fr", 1.0), (3, "12 34 !!", None, 2.0), (4, LONG, "en", 3.0), (5, "the and of", "en", None), (5, "the and of", "en", None), (None, "the and of", "de", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumn("rejected", F.lit("x")).withColumn("key", F.lit(7))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    assert (got.lang_pred == got.lang)[got.held_out].mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.02


def test_language_odd_rows(spark):
    model = langid.fit(odd(spark))
    got = {(r.doc_id, r.lang_pred): r for r in langid.predict(odd(spark), model).collect()}
    assert got[1, "und"].score == 0 and got[2, "und"].rejected and got[3, "und"].rejected
    assert sum(1 for r in langid.predict(odd(spark), model).collect() if r.doc_id == 5) == 2
    nothing = langid.fit(odd(spark).filter("false"))
    assert {r.lang_pred for r in langid.predict(odd(spark), nothing).collect()} == {"und"}
    assert langid.predict(odd(spark).filter("false"), model).count() == 0


def test_language_does_not_see_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    hidden = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    spoiled = docs.withColumn("lang", F.when(hidden, "xx").otherwise(F.col("lang")))
    assert "xx" not in langid.fit(spoiled).languages


def test_toxicity_held_out_and_located(spark):
    got = queries.op10_toxicity(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    toxic, clean = both[(both.toxic == 1) & both.held_out], both[(both.toxic == 0)]
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert clean.predicted.mean() < 0.05
    assert toxic.score.mean() > 10 * clean.score.mean()


def test_toxicity_odd_rows(spark):
    docs = odd(spark).select("doc_id", "text", "score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (5, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    one = toxicity.fit(docs, labels.filter("toxic = 1"))
    assert {r.score for r in toxicity.score(docs, one).collect()} == {1.0}
    none = toxicity.fit(docs, labels.filter("false"))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_toxicity_gradient_is_the_slope():
    """The analytic gradient against differences of the loss, feature by feature and by the bias."""
    draw = np.random.default_rng(3)
    labels, owner = np.array([1.0, 0, 1, 0, 1]), np.array([0, 0, 1, 2, 2, 2, 3, 3])  # the last bag is empty
    row, col = draw.integers(0, len(owner), 30), draw.integers(0, 6, 30)
    weight, bias = draw.normal(size=6), -0.7

    def loss(w, b):
        logits = [b + sum(w[c] for r, c in zip(row, col, strict=True) if r == k) for k in range(len(owner))]
        total = 0.0
        for k, label in enumerate(labels):
            clean = np.prod([1 / (1 + np.exp(z)) for z, o in zip(logits, owner, strict=True) if o == k])
            total -= np.log(max(1 - clean, 1e-9) if label else clean)
        return total / len(labels) + 0.01 / 2 * sum(w * w)

    value, by_weight, by_bias = toxicity.gradient(weight, bias, labels, owner, row, col, 0.01)
    assert value == pytest.approx(loss(weight, bias))
    step = 1e-6
    for k in range(6):
        move = step * (np.arange(6) == k)
        assert by_weight[k] == pytest.approx((loss(weight + move, bias) - loss(weight - move, bias)) / (2 * step), abs=1e-5)
    assert by_bias == pytest.approx((loss(weight, bias + step) - loss(weight, bias - step)) / (2 * step), abs=1e-5)


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """An id that many rows bear teaches once; long texts and more bytes than the bound are left out of the sample."""
    docs = spark.createDataFrame([(1, "bad words here")] * 50 + [(k, "fine words. " * 20) for k in range(3, 60)] + [(2, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 3)) for k in range(60)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 16_000)
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda words, start, bags, **_: seen.append(bags) or toxicity.Model(words, start, -3.0))
    monkeypatch.setattr(toxicity, "held_out", lambda key: F.lit(False))
    toxicity.fit(docs, labels)
    assert not seen or len(seen[0]) <= 58 and sum(b[0] for b in seen[0]) <= 1


def test_hash_sample_at_any_size(spark):
    """About as many rows as wanted, also where the share is far below a millionth."""
    from factloom.llm.common import chosen

    ids = spark.range(200_000)
    assert 150 < ids.filter(chosen(200_000, 200, "id")).count() < 260
    assert ids.filter(chosen(2_000_000_000_000, 200, "id")).count() == 0
    assert ids.filter(chosen(10, 200, "id")).count() == 200_000


def _grams(text):
    """Bigram and trigram counts, one sign at a time: the features' definition."""
    import regex

    from factloom.llm import vectext as V

    out, letters, code = np.zeros(langid.FEATURES, np.float32), 0, []
    for c in text:
        if regex.match(r"\p{L}", c):
            low = c.lower() if len(c.lower()) == 1 else c
            code.append(int(V.mix(np.array([ord(low)], np.uint64), 1)[0]) & 0xFFFFFFFF | 1)
            letters += 1
        elif code and code[-1]:
            code.append(0)
    for k in range(len(code)):
        before = code[k - 1] if k else 0
        two = ((before * 0x9E3779B1 & 0xFFFFFFFF) ^ code[k]) * 0x85EBCA77 & 0xFFFFFFFF
        out[two >> 20] += 1
        if k + 1 < len(code):
            three = (two * 0xC2B2AE3D & 0xFFFFFFFF) ^ code[k + 1]
            out[(three * 0x27D4EB2F & 0xFFFFFFFF) >> 20 | 4096] += 1
    return out, letters


def test_language_equals_nearest_centroid(spark):
    """Predictions against cosines computed document by document from the definition."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(120).collect()] + [(-1, "Stra\u00dfe \u0130x"), (-2, "a"), (-3, "1 2"), (-4, "\u043f\u0440\u0438\u0432\u0435\u0442")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for key, text in texts:
        counts, letters = _grams(text or "")
        x = [np.log1p(c) * w for c, w in zip(counts.astype(float), model.idf.astype(float), strict=True)]
        norm = np.sqrt(sum(v * v for v in x))
        cosines = [sum(a * float(b) for a, b in zip(x, center, strict=True) if a) / norm if norm else 0.0 for center in model.centers]
        best = int(np.argmax(cosines))
        assert got[key].lang_pred == (model.languages[model.owner[best]] if letters else "und")
        assert got[key].score == pytest.approx(min(max(cosines[best], 0), 1) if letters else 0.0, abs=1e-4)
        least = model.floor[min(letters.bit_length(), len(model.floor) - 1)]
        if abs(cosines[best] - least) > 1e-4:
            assert got[key].rejected == (not letters or cosines[best] < least)
    assert got[-4].rejected and not got[-2].rejected  # no size is let through unseen


def test_language_sample_does_not_depend_on_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    one, two = (langid.fit(d, sample_rows=60) for d in (docs, docs.repartition(7).orderBy(F.desc("text"))))
    assert one.languages == two.languages and np.allclose(one.centers, two.centers, atol=1e-5) and np.allclose(one.floor, two.floor, atol=1e-5)


def test_null_ids_are_not_held_out(spark):
    from factloom.llm.common import held_out

    rows = spark.createDataFrame([(None,), (1,), (2,)], "doc_id long").select(held_out().alias("h")).collect()
    assert all(r.h is not None for r in rows) and rows[0].h is False


def test_noisy_or_of_sentences():
    model = toxicity.Model(np.sort(toxicity.sentences(np.frombuffer(b"bad", np.uint8), np.array([0, 3]))[0]), np.array([3.0]), -2.0)
    data = b"bad. fine words. so bad"
    score, start, top, many = model.score(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0, 1.0)]
    assert score[0] == pytest.approx(1 - np.prod([1 - x for x in p])) and many[0] == 3 and start[0] == 0 and top[0] == pytest.approx(p[0])


def test_sentences_are_located(spark):
    words = toxicity.sentences(np.frombuffer(b"nasty", np.uint8), np.array([0, 5]))[0]
    model = toxicity.Model(np.sort(words), np.full(len(words), 4.0), -3.0)
    docs = spark.createDataFrame([(1, "A fine day. You nasty thing! Bye."), (2, "Nothing here.")], "doc_id long, text string")
    found = toxicity.locate(docs, model).collect()
    assert [(r.doc_id, r.sentence) for r in found] == [(1, "You nasty thing!")] and found[0].probability == pytest.approx(1 / (1 + np.exp(-4.0 * len(words) + 3)))


def test_html_marginals_equal_brute_force():
    """The messages against the sum over all assignments of a small tree."""
    import itertools

    model = html_extract.model(60)
    page = html_tree.parse("<div class=nav><a href=x>One two</a></div><article><p>Some words, here.</p></article>")
    feats, n = html_extract.features(page), len(page.tags)
    look = [sum((model.shown.get(f, np.zeros(3)) for f in fs), np.zeros(3)) for fs in feats]
    look[0] = look[0] + np.array([0.0, -9.0, -9.0])
    total = np.zeros((n, 3))
    for states in itertools.product(range(3), repeat=n):
        weight = sum(look[k][s] for k, s in enumerate(states)) + sum(model.table[model.index.get(page.tags[k], len(model.index))][states[page.parents[k]], states[k]] for k in range(1, n))
        for k, s in enumerate(states):
            total[k, s] += np.exp(weight)
    assert np.allclose(model.marginals([page])[0], total / total.sum(axis=1, keepdims=True))


def test_html_on_held_out_layouts():
    model, right, all_ = html_extract.model(), 0, 0
    for source in html_training.labelled_pages(80, seed=4242):
        page = html_tree.parse(source)
        label, p = html_extract.states(page), model.marginals([page])[0]
        for node, text, _ in page.chunks:
            if text.strip() and page.tags[node] not in html_tree.SKIPPED:
                all_ += 1
                right += (p[node, 1] > p[node, 2]) == (label[node] == 1)
    assert right / all_ > 0.98


@pytest.mark.parametrize("named", [True, False])
def test_html_on_names_never_seen(named):
    """Site words that no training page bears, or none: structure, text and links alone must tell. By signs of text."""
    model, draw, right, every = html_extract.model(), np.random.default_rng(1), 0, 0
    for source in html_training.labelled_pages(80, seed=99):
        own = {}
        fresh = lambda m: f'{m.group(1)}="' + " ".join(own.setdefault(w, "q" + "".join(draw.choice(list("bcdfghz"), 6))) for w in m.group(2).split()) + '"'  # noqa: B023, E731
        page = html_tree.parse(re.sub(r'(class|id)="([^"]*)"', fresh if named else "", source))
        label, p = html_extract.states(page), model.marginals([page])[0]
        for node, text, _ in page.chunks:
            if text.strip() and page.tags[node] not in html_tree.SKIPPED:
                every += len(text)
                right += len(text) * ((p[node, 1] > p[node, 2]) == (label[node] == 1))
    assert right / every > 0.95


def test_html_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>A &amp; B</h1><p>First  line,\n with <b>bold</b>&nbsp;text.<p>Second<br>line.</p><script>var t='</p>';</script></article><section class='comments'><div class='comment'><p>I agree!</p></div></section><footer>&copy; 2024 us</footer></body></html>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>text"), (5, "x", "<" * 2000), (None, "y", "just words here, no markup at all.")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 7 and by[1].text == "A & B First line, with bold text. Second line." and by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[3].n_chars == 0
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_pages_table(spark):
    got = {r.page_id: r.text for r in queries.op7_html_extraction(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(html_tree.html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", body))).split())
        assert got[r.page_id] == want


def test_deep_and_broken_pages():
    deep = "<div>" * 3000 + "text in the middle of it" + "</div>" * 10
    assert len(html_extract.main_texts([deep, "<a <b <c", "<!-- open", "</p></div>x"], html_extract.model())) == 4
