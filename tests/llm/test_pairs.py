"""Near-duplicates, joins, fingerprints, WARC and the pipeline against brute force."""

import gzip
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import components, fingerprints, ngram_join, pivots, queries, toxicity, warc
from factloom.llm.common import stash

SF = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def test_components(spark):
    r = random.Random(3)
    edges = [(k, k + 1) for k in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(30)] + [(500, k) for k in range(501, 540)] + [(7, 7)]
    sets = Sets({x for e in edges for x in e})
    for a, b in edges:
        sets.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for e in edges for x in e if e[0] != e[1]} | {k: v for k, v in got.items() if k == 7}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    near = base[:60] + 0.12 * rng.normal(size=(60, 16))
    crowd = base[0] + 0.08 * rng.normal(size=(90, 16))
    every = np.concatenate([base, near, crowd, base[10:14], base[10:12] * 3.0]).astype(np.float32)
    return [(k, [float(x) for x in v]) for k, v in enumerate(every)]


@pytest.mark.parametrize("block", [1024, 16])
def test_pivot_index(spark, monkeypatch, block):
    monkeypatch.setattr(pivots, "BLOCK", block)
    rows = vectors()
    odd = [(1001, None), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [1.0, 2.0]), (1006, []), (1007, [1e-30] * 16), (1008, [1e30] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = {r.vec_id: r for r in pivots.near_duplicates(df).collect()}
    assert len(got) == len(rows) + len(odd)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    degree, found = link.sum(axis=1), np.array([got[k].n_links for k, _ in rows])
    assert (found <= degree).all() and found.sum() >= 0.95 * degree.sum()
    sets = Sets(range(len(rows)))
    for a, b in zip(*np.nonzero(link), strict=True):
        sets.join(int(a), int(b))
    assert np.mean([got[k].component_id == sets.find(k) for k, _ in rows]) > 0.95
    assert all(got[k].n_links == 0 and got[k].kept for k in (1001, 1002, 1003, 1004, 1005, 1006))
    assert got[1007].component_id == got[1008].component_id == 1007
    assert pivots.near_duplicates(df.filter("false")).count() == 0


def test_pivot_recall_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = rng.normal(size=x.shape)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * e
    rows = [(2 * k, x[k].tolist()) for k in range(len(x))] + [(2 * k + 1, y[k].tolist()) for k in range(len(x))]
    got = pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).agg(F.sum("n_links").alias("n")).first().n
    assert got >= 0.9 * 2 * len(x)


def shingles(text, words=5):
    tab = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(tab))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_join(rows, percent=80):
    sets = {k: shingles(t) for k, t in rows}
    groups = Sets(sets)
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                groups.join(a, b)
    return {k: (len(sets[k]), groups.find(k)) for k in keys}


def corpus(seed, crowd):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    rows = [(k, " ".join([word() for _ in range(r.randint(0, 60))] + (passage if k % 3 == 0 else []))) for k in range(80)]
    for k in range(60):
        w = rows[r.randrange(80)][1].split() or ["x"]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = word()
        rows.append((200 + k, " ".join(w).upper() if k % 4 == 0 else "  ".join(w)))
    base = [word() for _ in range(40)]
    for k in range(crowd):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = word()
        rows.append((1000 + k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "only three words"), (5004, "only THREE  words"), (5005, "only three words more"), (5006, "ünï Ünï a b c"), (5007, "long " * 30_000)]
    return rows


@pytest.mark.parametrize("crowd", [0, 120])
def test_jaccard_join(spark, crowd):
    rows = corpus(crowd + 1, crowd)
    df = spark.createDataFrame(rows + [(None, "no key"), (5003, "only three words")], "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("token", F.lit("x"))
    got = ngram_join.join(df).collect()
    assert len(got) == len(rows) + 2
    want = brute_join(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for _, c in want.values()})


def test_jaccard_join_small_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 512)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    rows = corpus(9, 90)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_join(rows)
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_jaccard_join_without_a_repeated_shingle(spark):
    """No shingle occurs twice: profiles have no frequent tokens, in any batch."""
    rows = [(k, f"w{k} x{k} y{k} z{k} v{k} u{k}") for k in range(40)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (2, k) for k, _ in rows}


def test_prefix_hashes():
    r = random.Random(1)
    a = "".join(r.choice("abé日") for _ in range(400))
    b = a[:150] + "Z" + a[151:]
    p, q = (fingerprints.Prefix(np.frombuffer(t.encode("utf-32-le"), np.uint32)) for t in (a, b))
    for _ in range(300):
        i, j, n = r.randrange(400), r.randrange(400), r.randrange(60)
        assert fingerprints.equal(p, i, q, j, n) == (i + n <= 400 and j + n <= 400 and a[i : i + n] == b[j : j + n])
        want = 0
        while i + want < 400 and j + want < 400 and a[i + want] == b[j + want]:
            want += 1
        assert fingerprints.common_extension(p, i, q, j) == want


def test_fingerprints(spark):
    rows = [(k, f"{'text %d with several words in it. ' % k * (k % 7)}") for k in range(60)] + [(100, None), (101, ""), (102, "é😀" * 500), (103, "same"), (104, "same"), (105, "a very long one " * 20_000), (7, "again"), (7, "again"), (None, "no key")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash"))
    got = fingerprints.edited_neighbours(df).collect()
    assert len(got) == len(rows)
    order = sorted(((k if k is not None else -1, t or "") for k, t in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        third = len(t) // 3
        want.append((k, len(t), hashlib.sha256((t[: len(t) - third] + n[:third]).encode()).hexdigest()))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by = {r.doc_id: r for r in got}
    assert by[103].fingerprint == by[104].fingerprint and by[104].near_next == 1.0 and by[100].fingerprint == by[101].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert by[102].near_edited > 0.4 and by[102].near_next < 0.2
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df).collect()}[102] == by[102].fingerprint
    assert fingerprints.edited_neighbours(df.filter("false")).count() == 0
    assert fingerprints.edited_neighbours(df.filter("doc_id = 102")).first().near_next == 1.0


def _window_share(a, b):
    """Exact likeness: windows in common, as multisets, against all windows of both."""
    from collections import Counter

    if not a or not b:
        return float(a == b)
    width = lambda t: min(fingerprints.WINDOW, len(t))
    one, two = (Counter(t[k : k + width(t)] for k in range(len(t) - width(t) + 1)) for t in (a, b))
    return 2 * (one & two).total() / (one.total() + two.total())


def test_likeness_against_exact_windows(spark):
    """near_edited and near_next of real documents against the multisets of windows themselves."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(400)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_neighbours(docs).collect()}
    off = []
    for (key, own), (_, following) in zip(texts, texts[1:] + texts[:1], strict=True):
        third = len(own) // 3
        edited = own[: len(own) - third] + following[:third]
        off += [abs(got[key].near_edited - _window_share(own, edited)), abs(got[key].near_next - _window_share(own, following))]
    print("off", np.mean(off), max(off))
    assert np.mean(off) < 0.025 and max(off) < 0.15


def test_fingerprints_of_a_key_that_fills_ranges(spark):
    """A third of all rows bear one key, a third none: cut by lots, every row once, neighbours in a ring."""
    rows = [(5, f"five {k}") for k in range(400)] + [(None, f"none {k}") for k in range(400)] + [(k, f"own {k}") for k in range(10, 410)] + [(2, "low"), (5, "five 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        made = fingerprints.edited_neighbours(df)
        got = made.collect()
        largest = max(r[0] for r in made.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert largest < 250
    prints = {r.doc_id for r in got if r.doc_id is not None}
    assert len(got) == len(rows) and prints == {5, 2, *range(10, 410)}
    one = lambda t: fingerprints.fingerprint(p := fingerprints.Prefix(np.frombuffer(t.encode("utf-32-le"), np.uint32)), fingerprints.sketch(p)[0])
    assert sorted(r.fingerprint for r in got) == sorted(one(t) for _, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 3] + b[: len(a) // 3]).encode()).hexdigest()
    for k in range(11, 410):
        assert by[k][0].edited_sha256 == sha(f"own {k}", f"own {k - 1}")
    fives, nones = [t for k, t in rows if k == 5], [t for k, t in rows if k is None]
    assert by[10][0].edited_sha256 in {sha("own 10", t) for t in fives} and by[2][0].edited_sha256 in {sha("low", t) for t in nones}
    assert {r.edited_sha256 for r in by[5]} <= {sha(a, b) for a in set(fives) for b in [*set(fives), "low"]}
    assert {r.edited_sha256 for r in by[None]} <= {sha(a, b) for a in nones for b in [*nones, "own 409"]}


def test_fingerprints_over_many_ranges(spark):
    """More ranges than the plain expression serves."""
    rows = [(7 * k % 1009, f"document {7 * k % 1009} " * 9) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r.doc_id: r.edited_sha256 for r in fingerprints.edited_neighbours(df).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "80")
    try:
        assert {r.doc_id: r.edited_sha256 for r in fingerprints.edited_neighbours(df).collect()} == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_warc_files(spark):
    body = b"<html><head><title> A  page </title></head><body><script>x</script><p>One &amp; two</p><a href='/x'>l</a></body></html>"
    http = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + body
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: " + str(len(http)).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    files = spark.createDataFrame([("a", bytearray(info + record)), ("b", bytearray(gzip.compress(info) + gzip.compress(record))), ("c", None), ("d", bytearray(b"junk"))], "path string, content binary")
    records = warc.read_records(files)
    assert records.count() == 4
    made = warc.derive(warc.from_records(records)).collect()
    assert len(made) == 4 and {r.warc_type for r in made} == {"metadata", "conversion"}
    text = [r for r in made if r.warc_type == "conversion"][0]
    assert text.block == "A page One & two l" and text.refers_to == "<urn:uuid:1>" and text.target_uri == "http://a/" and text.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
    meta = [r for r in made if r.warc_type == "metadata"][0]
    assert "Server: s" in meta.block and "title: A page" in meta.block and "links: 1" in meta.block
    again = [h for h, _ in warc.cut(warc.serialise(warc.derive(warc.from_records(records))).first().record.encode())]
    assert again[0]["warc-refers-to"] == "<urn:uuid:1>"


def _record(n, body, kind="response", length=None):
    size = str(len(body)) if length is None else length
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{n}>\r\nContent-Length: {size}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_broken_files(spark):
    good = _record(3, b"end")
    draw = random.Random(1)
    long = bytes(draw.randrange(32, 127) for _ in range(300_000))
    zipped = gzip.compress(_record(1, long)) + gzip.compress(good)
    files = {
        "number": _record(1, b"foo", length="abc") + good,
        "huge": good + _record(2, b"foo", length="9" * 30),
        "cut": zipped[:200_000],
        "damaged": zipped[:150_000] + b"\xff" * 40 + zipped[150_040:],
        "head": good + b"WARC/1.1\r\nWARC-Type: resp",
        "whole": zipped,
        "empty": b"",
    }
    got = {}
    for r in warc.read_records(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")).orderBy("path", "position").collect():
        got.setdefault(r.path, []).append((bytes(r.block), r.problem))
    assert got["number"] == [(b"foo", "content-length"), (b"end", None)]
    assert got["huge"][0] == (b"end", None) and got["huge"][1][0].startswith(b"foo") and got["huge"][1][1] == "cut"
    (part, problem), = got["cut"]
    assert problem == "cut" and len(part) > 100_000 and long.startswith(part)
    part, problem = got["damaged"][0]
    assert problem in ("cut", "gzip") and long.startswith(part[:50_000])
    assert got["head"] == [(b"end", None), (b"", "cut")]
    assert got["whole"] == [(long, None), (b"end", None)] and "empty" not in got


def test_warc_payloads_of_any_bytes(spark):
    """Charsets, codings and bytes of no charset; digests are of what was sent."""
    page = "<p>caf\u00e9 \u20ac</p>"
    sent = {
        "latin": (b"Content-Type: text/html; charset=ISO-8859-1", "<p>caf\u00e9</p>".encode("latin-1"), "caf\u00e9"),
        "unnamed": (b"X: y", page.encode("cp1252"), "caf\u00e9 \u20ac"),
        "meta": (b"X: y", b"<meta charset=koi8-r>" + "\u043c\u0438\u0440".encode("koi8-r"), "\u043c\u0438\u0440"),
        "gzip": (b"Content-Encoding: gzip", gzip.compress(page.encode(), mtime=0), "caf\u00e9 \u20ac"),
        "chunked": (b"Transfer-Encoding: chunked", b"3\r\n<p>\r\n2;x\r\nhi\r\n0\r\n\r\n", "hi"),
        "untrue": (b"Content-Encoding: gzip\r\nContent-Type: a; charset=no-such", page.encode(), "caf\u00e9 \u20ac"),
        "raw": (b"X: y", b"\x81\x8d\xff", "\ufffd\ufffd\u00ff"),
    }
    body = b"".join(_record(k, b"HTTP/1.1 200 OK\r\n" + h + b"\r\n\r\n" + p) for k, (h, p, _) in sent.items()) + _record("none", b"")
    files = spark.createDataFrame([("f", bytearray(body))], "path string, content binary")
    derived = warc.derive(warc.from_records(warc.read_records(files)))
    made = derived.collect()
    assert len(made) == 2 * len(sent) + 2
    for r in made:
        head, payload, text = sent.get(r.source_key.strip("<>"), (b"", b"", ""))
        assert r.payload_digest == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert head.decode() in r.source_headers
        if r.warc_type == "conversion":
            assert r.block == text, r.source_key
    lines = warc.serialise(derived).filter("source_key = '<latin>'").first().record.split("\r\n")
    assert "WARC-Source-Header: HTTP/1.1 200 OK" in lines and "WARC-Source-Header: Content-Type: text/html; charset=ISO-8859-1" in lines


def test_warc_sql_decodes_all_references():
    import html

    texts = ["&copy; it&apos;s &#233;&#xe9;&nbsp;x &amp;lt; &unknown; &notit; &notin; &#128; &#0; &#xD800; &#x110000; &#99999999999999999999; &#xFFFF; &#1; && &; &#; &#x; &ampx &amp", "none"]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, 'u', ?)", [(k, t) for k, t in enumerate(texts)] + [(1, texts[1])])
    got = con.sql(f"select source_key, block from ({warc.ORACLE}) where warc_type = 'conversion' order by 1").fetchall()
    assert got == [(k, " ".join(x for x in html.unescape(t).replace("\u00a0", " ").split(" ") if x)) for k, t in [*enumerate(texts), (1, texts[1])]]


def test_warc_odd_rows(spark):
    rows = [(1, None, None), (None, "http://a", "<p>x"), (2, "http://a", ""), (2, "http://a", "")]
    made = warc.derive(warc.responses(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("block", F.lit(1)))).collect()
    assert len(made) == 8
    assert warc.derive(warc.responses(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_oracle(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(warc.ORACLE).df()
    got = queries.op2_warc_derivatives(spark, SF).toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stash(stage(spark, now, SF), name)
        assert after.columns == docs.columns and after.join(now, "doc_id", "left_anti").count() == 0
        if name == "toxicity":
            model = toxicity.fit(now, spark.read.parquet(f"{SF}/labels.parquet"))
            assert {r.doc_id for r in after.select("doc_id").collect()} == {r.doc_id for r in toxicity.score(now, model).filter("predicted = 0").collect()}
        if name == "near_duplicates":
            want = brute_join([(r.doc_id, r.text) for r in now.collect()])
            assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in want.values()})
        now = after
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in now.select("doc_id").collect()}
    assert (packed.groupby("sequence_id").length.sum() <= 1024).all()
