"""Operators that SQL cannot express, against brute force, and the rules of single operators."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import governance as V
from factloom.operators import graph as G
from factloom.operators import knowledge as K
from factloom.operators import layout as L
from factloom.operators import retrieval as R
from factloom.operators import safety as S
from factloom.operators import selection
from factloom.sources import blocks as B
from factloom.streaming import logs


def test_packed_blocks_equal_the_sequential_rule(spark):
    r = random.Random(4)
    rows = [(q, d, n, float(r.randrange(40)), "é" * r.choice([3, 10, 10, 25, 60])) for q in range(3) for d in range(12) for n in range(12)]
    got = {}
    for x in R.packed_blocks(spark.createDataFrame(rows, "item_id int, doc_id int, line_no int, score double, text string").withColumns({"chars": F.length("text"), "bytes": F.octet_length("text")}), 5, 90, 150).collect():
        got.setdefault(x.item_id, []).append((x.position, x.doc_id, x.line_no))
    for q in range(3):
        ranked = sorted((x for x in rows if x[0] == q), key=lambda x: (-x[3], x[1], x[2]))
        chosen, chars, size = [], 0, 0
        for spread in (True, False):
            for x in ranked:
                if len(chosen) >= 5:
                    break
                if (x[1], x[2]) in [(c[1], c[2]) for c in chosen] or spread and x[1] in [c[1] for c in chosen]:
                    continue
                if chars + len(x[4]) > 90 or size + len(x[4].encode()) > 150:
                    continue
                chosen.append(x)
                chars, size = chars + len(x[4]), size + len(x[4].encode())
        assert sorted(got.get(q, [])) == [(k + 1, c[1], c[2]) for k, c in enumerate(chosen)]


def test_subject_focus_takes_the_longest(spark):
    prompts = spark.createDataFrame([(1, "What does North Harbour Pier charge at north harbour?"), (2, "northern harbour")], "item_id int, text string")
    subjects = spark.createDataFrame([("North Harbour",), ("north harbour pier",), ("Pier",)], "subject string")
    assert sorted((r.item_id, r.subject) for r in selection.focus(prompts, subjects).collect()) == [(1, "north harbour"), (1, "north harbour pier")]


def test_nfkc_is_exact(spark):
    got = spark.createDataFrame([("ﬁne STRASSE Straße Ａ",), (None,)], "t string").select(T.nfkc_casefold("t").alias("t")).collect()
    assert got[0].t == "fine strasse strasse a" and got[1].t is None


def test_markdown(spark):
    text = "# Title\n\nBody with [a link](http://x).\n```\ncode # one\ncode two\n```\n## Sub\nEnd"
    rows = B.markdown_blocks(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("line_no", "type").collect()
    assert [(r.type, r.level, r.text) for r in rows] == [("heading", 1, "Title"), ("link", None, "a link"), ("paragraph", None, "Body with [a link](http://x)."), ("code", None, "code # one\ncode two"), ("heading", 2, "Sub"), ("paragraph", None, "End")]


def test_html_nested_tag_drops_the_outer_text(spark):
    rows = B.html_blocks(spark.createDataFrame([(1, "<h2>Head</h2><p>lost <a href=x>kept</a> lost too</p><li>item</li>")], "page_id int, html string")).collect()
    assert [(r.type, r.level, r.text) for r in rows] == [("heading", 2, "Head"), ("link", None, "kept"), ("list", None, "item")]


def test_docx_and_pdf(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    files = spark.createDataFrame([("a.docx", bytearray(out.getvalue())), ("b.docx", bytearray(b"no zip")), ("c", None)], "path string, content binary")
    assert [(r.type, r.level, r.text) for r in B.docx_blocks(files).collect()] == [("heading", 1, "Head"), ("paragraph", None, "Some text"), ("table", None, "a\tb")]
    pdf = spark.createDataFrame([("a", bytearray(b"BT (Hello \\(you\\)) Tj ET"))], "path string, content binary")
    assert [r.text for r in B.pdf_literal_blocks(pdf).collect()] == ["Hello (you)"]


def test_files_are_verified(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = B.read_files(spark, str(tmp_path))
    expected = files.select("path", F.when(F.col("path").endswith("a.txt"), B.content_digest(b"one")).otherwise("x").alias("expected_digest"))
    assert [r.path[-5:] for r in B.verified(files, expected).collect()] == ["a.txt"]


def test_reachability_levels(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(3, 0), (50, 51)], "a int, b int")
    got = {r.node: r.level for r in G.reachable(edges, spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 1, **{k: k - 2 for k in range(4, 13)}}


def test_replay_through_rollbacks(spark):
    r = random.Random(6)
    parents = [(g, s, (s - 1 or None) if r.random() < 0.7 or s == 1 else r.randrange(1, s)) for g in range(4) for s in range(1, 60)]
    df = spark.createDataFrame(parents, "g int, s int, p int")
    got = {}
    for x in K.replay(df, "g", "s", F.col("p")).collect():
        got.setdefault(x.g, set()).add(x.s)
    for g in range(4):
        up, at, want = {s: p for q, s, p in parents if q == g}, 59, set()
        while at:
            want.add(at)
            at = up[at]
        assert got[g] == want


def test_contradiction_modes(spark):
    rows = [(1, "The door is open"), (1, "The door is not open"), (2, "It is not so"), (2, "Other things are"), (3, "Plain")]
    df = spark.createDataFrame(rows, "g int, text string")
    assert {r.g: r.contradict for r in K.contradict(df, "g").collect()} == {1: True, 2: True, 3: False}
    assert {r.g: r.contradict for r in K.contradict(df, "g", strict=True).collect()} == {1: True, 2: False, 3: False}


def test_chain_faults_and_grants(spark):
    log = V.chain(spark.createDataFrame([(1, k, f"e{k}") for k in range(5)], "g int, s int, e string"), "g", "s", F.col("e"))
    assert V.chain_faults(log, "g", "s").count() == 0
    assert [r.s for r in V.chain_faults(log.filter("s <> 2"), "g", "s").orderBy("s").collect()] == [3, 4]
    grants = spark.createDataFrame([(1, "apply", "d", 0, 10), (2, "apply", "d", 0, 3), (3, "apply", "x", 0, 10)], "grant_id int, operation string, digest string, issued_at int, expires_at int")
    asked = spark.createDataFrame([(1, "apply", "d"), (2, "apply", "d"), (3, "apply", "d")], "grant_id int, operation string, digest string")
    used = spark.createDataFrame([(9,)], "grant_id int")
    assert [r.grant_id for r in V.authorised(asked, grants, used, F.lit(5)).collect()] == [1]


def test_lines_compare_with_the_first_box(spark):
    rows = [(1, k, 0, 5, t, t + 10, 1) for k, t in enumerate([0, 4, 8, 30, 33])]
    df = spark.createDataFrame(rows, "page int, box int, l int, r int, t int, b int, col int")
    assert [r.line for r in L.lines(df, "page").orderBy("box").collect()] == [1, 1, 2, 3, 3]


@pytest.mark.parametrize("text,want", [("mail a.b@c.org now", "email"), ("at 10.0.0.1", "ip_address"), ('token = "0cf1bbc67ab39b2ddebadc80"', "secret"), ("see https://x.org/y", "locator"), ("fine", "")])
def test_safety(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(S.flags(F.col("t")).alias("f")).first().f == want


def test_stream_keeps_state_between_batches(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    rows = [(1, 1, "open"), (1, 2, "closed"), (2, 1, "closed"), (1, 3, "closed")]
    allowed = [("start", "open"), ("open", "closed")]
    schema = "k int, s int, state string"
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        found = logs.audit(spark.readStream.schema(schema).parquet(str(source)), "k", "state", "s", allowed)
        logs.append(found, str(sink), str(tmp_path / "check")).awaitTermination(120)
    assert sorted((r.k, r.s, r.before, r.after) for r in spark.read.parquet(str(sink)).collect()) == [(1, 3, "closed", "closed"), (2, 1, "start", "closed")]


def test_late_rows_fall_behind_the_watermark(spark, tmp_path):
    schema = "id int, ts timestamp"
    for part in ([(1, "2024-01-01 00:00:00"), (2, "2024-01-03 00:00:00")], [(3, "2024-01-01 00:10:00"), (4, "2024-01-05 00:00:00")], [(5, "2024-01-08 00:00:00")]):
        spark.createDataFrame(part, "id int, t string").select("id", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        counted = logs.aged(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "1 day", [])
        logs.append(counted.select(F.col("window.start").alias("w"), "n"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = {str(r.w): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01 00:00:00"] == 1
