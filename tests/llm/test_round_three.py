"""Closed itemsets, secret scans and the Merkle manifest against brute force and SQL."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.llm import concepts, manifest, queries, secrets

SF = "/root/testdata/sf0.001"


def plain(frame):
    number = lambda x: None if pd.isna(x) else int(x) if isinstance(x, float) and x == int(x) else x
    return sorted(tuple(str(number(x)) for x in r) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", ["op11_closed_itemsets", "op12_secret_scan", "op13_merkle_manifest"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert len(got) and sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


# Closed itemsets


def brute_itemsets(baskets, least, per):
    total = len(baskets)
    enough = max(least, -(-total // per))
    closed, front = {}, {frozenset(b) for b in baskets.values()}
    every = set(front)
    while front:  # all intersections of baskets are the closed sets
        new = {a & b for a in front for b in {frozenset(x) for x in baskets.values()}} - every
        every |= new
        front = new
    support = lambda s: sum(s <= b for b in baskets.values())
    out = {}
    for s in every:
        if s and support(s) >= enough:
            closed[s] = support(s)
    for s, n in closed.items():
        kept = []
        for c in sorted(s):
            if len(s) < 2:
                break
            a, own = support(s - {c}), support(frozenset([c]))
            if 100 * n >= 30 * a and n * total > a * own:
                kept.append((c, a, own))
        best = min(kept, key=lambda r: (r[1], r[0]))[0] if kept else None
        out[",".join(map(str, sorted(s)))] = (len(s), n, len(kept), best, hashlib.sha256(";".join(f"{c}:{a}:{o}" for c, a, o in kept).encode()).hexdigest())
    return out


@pytest.mark.parametrize("heavy,held,everywhere", [(2_000_000, 4_000_000, False), (0, 50, False), (30, 4_000_000, True)])
def test_closed_itemsets(spark, monkeypatch, heavy, held, everywhere):
    monkeypatch.setattr(concepts, "HEAVY", heavy)
    monkeypatch.setattr(concepts, "HELD", held)
    r = random.Random(heavy + held)
    groups = [r.sample(range(100, 130), 5) for _ in range(6)]
    baskets = defaultdict(set)
    for k in range(120):
        baskets[k] |= {x for x in r.choice(groups) if r.random() < 0.8} | {100 + int(30 * r.random() ** 3) for _ in range(r.randrange(4))} | {7}
        if not everywhere and k % 3:
            baskets[k].discard(7)
        if not baskets[k]:
            del baskets[k]
    baskets[1000] = set(range(95, 130))  # one basket of every item
    rows = [(k, x, "extra") for k, b in baskets.items() for x in b for _ in range(r.randrange(1, 3))] + [(None, 100, "x"), (3, None, "x"), (None, None, None)]
    r.shuffle(rows)
    got = concepts.closed_itemsets(spark.createDataFrame(rows, "sale_id long, item_id long, items string"), least=3, per=50).collect()
    want = brute_itemsets(baskets, 3, 50)
    assert len(got) == len(want) > 100
    assert {x["items"]: (x["n_items"], x["support"], x["n_rules"], x["best_item"], x["rules_sha256"]) for x in got} == want


def test_inherited_failures_avoid_closures():
    """Where an extension failed for want of an item, it is not closed again further down."""
    r = random.Random(4)
    rows = [sorted(r.sample(range(12), r.randrange(2, 8))) for _ in range(200)]
    items, bounds = [x for row in rows for x in row], [0, *itertools.accumulate(len(row) for row in rows)]
    import numpy as np

    node = {"intent": [], "last": -1, "fails": []}
    every = concepts._go_down(node, np.array(items), np.array(bounds), np.ones(len(rows), np.int64), 2)
    assert len({tuple(x) for x, _ in every}) == len(every)
    assert {tuple(x): n for x, n in every} == {tuple(map(int, k.split(","))): v[1] for k, v in brute_itemsets({k: set(x) for k, x in enumerate(rows)}, 2, 10**6).items()}
    barred = concepts._go_down(node | {"fails": [{"k": k, "low": [99]} for k in range(12)]}, np.array(items), np.array(bounds), np.ones(len(rows), np.int64), 2)
    assert barred == []


def test_no_itemsets(spark):
    empty = spark.createDataFrame([], "sale_id long, item_id long")
    assert concepts.closed_itemsets(empty).count() == 0
    few = spark.createDataFrame([(k, 1) for k in range(11)], "sale_id long, item_id long")
    assert concepts.closed_itemsets(few).count() == 0
    one = concepts.closed_itemsets(spark.createDataFrame([(k, 1) for k in range(12)] * 2, "sale_id long, item_id long")).collect()
    assert [(x["items"], x["support"], x["n_rules"], x["best_item"]) for x in one] == [("1", 12, 0, None)]


# Secrets


def brute_secrets(text):
    base = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    found = sorted(base)
    for k, (_, sign, _, bits) in enumerate(secrets.CLASSES, 3):
        most = math.floor(secrets.SCALE * secrets.WINDOW * (math.log2(secrets.WINDOW) - bits))
        for run in re.finditer(f"{sign}{{{secrets.WINDOW},}}", text):
            spans = []
            for w in range(run.start(), run.end() - secrets.WINDOW + 1):
                part = text[w : w + secrets.WINDOW]
                if sum(round(c * math.log2(c) * secrets.SCALE) for c in Counter(part.lower() if k == 3 else part).values()) <= most:
                    if spans and w <= spans[-1][1]:
                        spans[-1][1] = w + secrets.WINDOW
                    else:
                        spans.append([w, w + secrets.WINDOW])
            found += [(a, k, b) for a, b in spans if not any(re.search(p, text[a:b]) for p in secrets.ALLOWED) and not any(s <= a and b <= e for s, _, e in base)]
    return sorted(base), sorted(found)


@pytest.mark.parametrize("block,chunk", [(4096, 1024), (7, 3)])
def test_secrets(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(secrets, "BLOCK", block)
    monkeypatch.setattr(secrets, "CHUNK", chunk)
    r = random.Random(block)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    pieces = [lambda: "".join(r.choices(b64, k=r.randrange(10, 90))), lambda: "".join(r.choices("0123456789abcdef", k=r.randrange(8, 60))), lambda: "".join(r.choices("0123456789ABCDEF", k=r.randrange(8, 60))), lambda: r.choice(["password", "Passwd", "SECRET", "token", "api_key", "ApiKey"]) + r.choice(["=", ": ", "' : \"", " =  "]), lambda: "AKIA", lambda: "é𝄞ü " * r.randrange(3), lambda: "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", lambda: "donaudampfschifffahrtsgesellschaft", lambda: " EXAMPLE", lambda: " ", lambda: "\n"]
    texts = ["".join(r.choice(pieces)() for _ in range(r.randrange(1, 25))) for _ in range(60)] + [None, "", "x", "password=" + "a1" * 6, "password=short", "password: token: abcdefghijklmnop", "AKIA" + "A" * 13, "AKIA" + "A" * 14, "".join(r.choices(b64, k=700)), "ſecret=abcdefghijklmn", "0" * 16]
    docs = spark.createDataFrame([(k, t, [1]) for k, t in enumerate(texts)] + [(None, "secret=0123456789ab", None)], "doc_id long, text string, base_spans array<int>")
    names = [*secrets.KINDS, *[c[0] for c in secrets.CLASSES]]
    said = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
    got = {x["doc_id"]: x for x in secrets.digests(docs).collect()}
    assert len(got) == len(texts) + 1 and got[None]["n_assign"] == 1
    added = 0
    for k, text in enumerate(texts):
        base, every = brute_secrets(text or "")
        assert got[k]["spans"] == said(every), text
        assert got[k]["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest()
        assert [got[k][f"n_{n}"] for n in secrets.KINDS] == [sum(x[1] == i for x in base) for i in range(3)]
        added += len(every) - len(base)
    assert added > 20


def test_secrets_of_a_long_text(spark):
    long = "token=abc " * 20_000 + "AKIA" + "B7" * 9 + " word" * 50_000
    row = secrets.digests(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (0, 1, 0)
    assert row["spans"] == "access:200000:200022"
    assert secrets.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Manifest


def brute_manifest(rows):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    said = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    own = lambda r, text: h(*map(said, (r[0], r[2], r[1], r[3], text)))
    lower = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """(root, for each first node its siblings (left, right) on the way)"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, place in enumerate(at):
                run = place // 8 * 8
                paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 8])))
            nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], paths

    groups = defaultdict(list)
    for r in rows:
        leaf = own(r, r[4])
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf, own(r, lower(r[4])) if tampered else leaf, r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        for (_, _, leaf, altered, key), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            now = altered
            for left, right in path + top:
                now = h(left, now, right)
            out.append((str(key), leaf, trees[g][0], root, h(*[a + b for a, b in path + top]), now, now == root))
    return sorted(out)


@pytest.mark.parametrize("limit,bits,spread", [(4096, 10, 1), (3, 2, 1), (3, 3, 977_777_777_777)])
def test_manifest(spark, monkeypatch, limit, bits, spread):
    monkeypatch.setattr(manifest, "LIMIT", limit)
    monkeypatch.setattr(manifest, "BITS", bits)
    monkeypatch.setattr(manifest, "RADIX", 1 << bits)
    r = random.Random(limit)
    rows = []
    for lang, many in (("en", 700), ("de", 65), ("fr", 8), ("es", 1), (None, 9), ("", 2), ("zh-Ünï", 3), ("en-x", 64), *[(f"l{k}", 1) for k in range(9)]):
        for k in range(many):
            rows.append(((r.randrange(-400, 400) + k * 2) * spread, lang, r.choice(["web", None]), r.choice([k, None]), r.choice(["Some Text", "lower", None, "", "ÄÖ É", f"T{k}"])))
    rows += [(5, "en", "web", 1, "Same")] * 40 + [(None, "en", None, None, None)] * 3 + [(5, "en", "web", 1, f"Other{k}") for k in range(20)]
    r.shuffle(rows)
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, lang string, source string, n_chars long, text string, rank int, g int").repartition(5)
    got = sorted((str(x["doc_id"]), *x[1:]) for x in manifest.manifest(docs).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())
    assert got == brute_manifest(rows)
    assert {x[6] for x in got} == {True, False}


def test_small_manifests(spark):
    shape = "doc_id long, lang string, source string, n_chars long, text string"
    assert manifest.manifest(spark.createDataFrame([], shape)).count() == 0
    row = (3, None, None, None, "ABC")
    only = manifest.manifest(spark.createDataFrame([row], shape)).first()
    assert only["leaf"] == only["subroot"] == only["root"] == brute_manifest([row])[0][1]
    assert only["proof_sha256"] == hashlib.sha256(b"").hexdigest() and only["verified"] == (only["folded_root"] == only["root"])
    ranks, _ = manifest.ranked(manifest.stash(spark.range(500).select(F.lit("g").alias("g"), (F.col("id") * 3 % 500).alias("doc_id")), "t"), [F.shiftright("doc_id", 5).cast("int")], ["doc_id"])
    assert all(x["rank"] == x["doc_id"] for x in ranks.collect())


# Hostile input of the earlier operators


def test_chunk_sizes_that_are_no_sizes():
    from factloom.llm import warc

    assert warc._unchunked(b"5\r\nhello\r\n-6\r\nhello\r\n0\r\n\r\n") == b"hello"
    assert warc._unchunked(b"5;x=y\r\nhello\r\n 6 \r\n world\r\n0\r\n\r\n") == b"hello world"
    assert warc.decoded(b"-6\r\nhello", "Transfer-Encoding: chunked\r\n") == ("-6\r\nhello", None)
    assert warc.decoded(b"+5\r\nhello", "Transfer-Encoding: chunked\r\n")[0] == "+5\r\nhello"


def test_inflation_is_bounded(spark, monkeypatch):
    import gzip

    from factloom.llm import warc

    monkeypatch.setattr(warc, "MOST_BYTES", 3 << 20)
    text, problem = warc.decoded(gzip.compress(b"a" * (50 << 20)), "Content-Encoding: gzip\r\n")
    assert problem == "too_large" and set(text) == {"a"} and len(text) <= 4 << 20
    assert warc.decoded(gzip.compress(b"hello"), "Content-Encoding: gzip\r\n") == ("hello", None)
    assert warc.decoded(gzip.compress(bytes(range(97, 123)) * 2000)[:-9], "Content-Encoding: gzip\r\n")[0].startswith("abcdef")
    assert warc.decoded(b"no gzip", "Content-Encoding: gzip\r\n") == ("no gzip", None)
    head = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 100_000 + b"\r\nContent-Encoding: gzip\r\n\r\n"
    records = spark.createDataFrame([({"warc-type": "response", "warc-record-id": "<a>"}, bytearray(head + gzip.compress(b"<p>hi</p>")))], "headers map<string,string>, block binary")
    got = {x["warc_type"]: x for x in warc.derive(warc.from_records(records)).collect()}
    assert (got["conversion"]["block"], got["conversion"]["problem"]) == ("hi", None)


def test_unmatched_tags_cost_no_search():
    import time

    from factloom.llm import html_tree

    began = time.time()
    for page in ("<div>" * 40_000 + "</x>" * 40_000, "<b>" * 40_000 + "<hr>" * 40_000, "<i><div>" + "<b>" * 40_000 + "</i>" * 40_000, "<ul>" + "<b>" * 40_000 + "<li>" * 40_000, "<b><div>" * 20_000 + "</b>" * 40_000):
        html_tree.parse(page)
    assert time.time() - began < 20


def test_columns_named_like_ours(spark):
    from factloom.llm import ngram_join

    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, 5, "a", 1), (2, text, 6, "b", 2), (1, text, 7, "c", 3), (None, None, 8, "d", 4)], "doc_id long, text string, __rows int, document string, kept int")
    got = ngram_join.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((x["doc_id"] or 0, x["document"]) for x in got.collect())[0] == (0, "d") and got.count() == 2
