"""Graph and workspace queries, parsing with fallback, identities and line ends against plain Python."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import layout as L
from factloom.operators import transactions as X
from factloom.operators import workspace as W
from factloom.sources import adapters as D
from factloom.sources import blocks as B

TERMS = "red blue green plate widget gear bolt".split()


def graph(seed):
    r = random.Random(seed)
    roles = list(W.ROLE_NOTES)
    sources = [(f"s{k}", r.choice(roles), "current" if r.random() < 0.85 else "stale") for k in range(6)]
    claims = [(f"c{k:02}", f"s{r.randrange(6)}", r.choice(roles), " ".join(r.sample(TERMS, 2)), "d") for k in range(30)]
    edges = []
    for k in range(8):
        a, b = (("claim", f"c{r.randrange(30):02}") if r.random() < 0.7 else ("source", f"s{r.randrange(6)}") for _ in range(2))
        edges.append((f"g{k}", r.choice(["conflicts_with", "supports"]), *(("workflow", "w") if k == 0 else a), *b, "d"))
    prompts = [(k, " ".join(r.sample(TERMS, r.randrange(1, 3)))) for k in range(6)] + [(9, "unknown words")]
    return sources, claims, edges, prompts, [f"s{r.randrange(6)}"]


def asked(sources, claims, edges, prompt, changed, limit):
    """The rules of a graph query, one prompt at a time."""
    word = lambda t: {w for w in re.findall(r"[a-z]+", t) if len(w) > 2}
    source_of = {c: s for c, s, *_ in claims}
    score = {c: len(word(prompt) & word(text)) for c, _, _, text, _ in claims}
    matching = [c for c, n in score.items() if n]
    first = sorted(matching, key=lambda c: (-score[c], c))[:limit]
    near = {("claim", c) for c in matching} | {("source", source_of[c]) for c in matching}
    clash = set()
    for edge, kind, sk, s, tk, t, _ in edges:
        if kind == "conflicts_with" and near & {(sk, s), (tk, t)}:
            clash |= {edge if k == "workflow" else x for k, x in ((sk, s), (tk, t))}
    fill = lambda must, rest: set((sorted(must) + sorted(set(rest) - set(must)))[:limit])
    chosen = fill(clash, first)
    used = {source_of[x] if x in source_of else x for x in chosen if x in source_of or x.startswith("s")}
    stale = {s for s, _, status in sources if status != "current" and s in used}
    moved = set(changed) & ({source_of[c] for c in matching} | used)
    final = fill(clash | stale | moved, chosen)
    role_of = {s: r for s, r, _ in sources}
    roles = {r for c, _, r, *_ in claims if c in final} | {role_of[source_of.get(x, x)] for x in final if source_of.get(x, x) in role_of}
    outcome = "investigate" if clash or stale or moved else "refuse" if not final else "answer" if len(roles) > 1 else "partial"
    return outcome, [r for r in W.ROLES if r in roles], sorted(final)


@pytest.mark.parametrize("seed,limit", [(1, 64), (2, 8), (3, 64), (5, 12)])
def test_graph_query(spark, seed, limit):
    sources, claims, edges, prompts, changed = graph(seed)
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    c = frame(claims, "claim_id string, source_id string, role string, text string, digest string")
    s = frame(sources, "source_id string, role string, status string")
    e = frame(edges, "edge_id string, edge_type string, source_kind string, source_id string, target_kind string, target_id string, digest string")
    p = frame(prompts, "item_id long, text string")
    outcomes, evidence = W.query_graph(p, c, s, e, frame([(x,) for x in changed], "source_id string"), limit)
    ids = {}
    for r in evidence.collect():
        ids.setdefault(r.item_id, []).append(r.evidence_id)
    got = {r.item_id: (r.outcome, r.roles, sorted(ids.get(r.item_id, []))) for r in outcomes.collect()}
    assert got == {k: asked(sources, claims, edges, text, changed, limit) for k, text in prompts}
    records = W.resolve(evidence, c, e).collect()
    assert {r.evidence_id for r in records if r.item_id == 0} >= {x for x in ids.get(0, []) if x[0] in "cg"}


def test_workspace_merge(spark):
    part = lambda item, ws, outcome, restricted=False, fallback=False, notes=(): (item, ws, outcome, restricted, fallback, list(notes))
    parts = [part(1, "a", "answer", notes=["z", W.FRESHNESS]), part(1, "b", "refuse"), part(2, "a", "answer", restricted=True), part(3, "a", "investigate", notes=[W.FRESHNESS]), part(3, "b", "answer"), part(4, "a", "refuse"), part(5, "a", "answer", fallback=True), part(6, "a", "answer"), part(7, "a", "answer"), part(8, "a", "investigate")]
    one = lambda item, ws, i: (item, ws, "graph_claim", i, "d")
    origins = [one(1, "a", "x"), one(1, "a", "x"), one(2, "a", "x"), one(3, "a", "m"), one(3, "b", "o"), one(5, "a", "x"), one(6, "a", "l"), one(6, "a", "r"), *[one(7, "a", f"e{k:03}") for k in range(5)], *[one(8, "a", f"e{k:03}") for k in range(5)]]
    pairs = spark.createDataFrame([("l", "r"), ("x", "nowhere")], "left_id string, right_id string")
    p = spark.createDataFrame([(k,) for k in range(1, 10)], "item_id long")
    frames = spark.createDataFrame(parts, "item_id long, workspace_id string, outcome string, restricted boolean, fallback boolean, qualifications array<string>"), spark.createDataFrame(origins, "item_id long, workspace_id string, evidence_kind string, evidence_id string, evidence_digest string")
    outcomes, evidence = W.merge(p, *frames, pairs, cap=4)
    got, ids = {r.item_id: (r.outcome, r.qualifications) for r in outcomes.collect()}, {}
    for r in evidence.collect():
        ids.setdefault(r.item_id, set()).add(r.evidence_id)
    assert got == {1: ("answer", [W.FRESHNESS, "z"]), 2: ("refuse", [W.RESTRICTED]), 3: ("investigate", [W.FRESHNESS]), 4: ("refuse", []), 5: ("partial", []), 6: ("investigate", [W.CONFLICT]), 7: ("partial", []), 8: ("investigate", [W.SATURATED]), 9: ("refuse", [])}
    assert ids == {1: {"x"}, 3: {"m", "o"}, 5: {"x"}, 6: {"l", "r"}, 7: {"e000", "e001", "e002", "e003"}}
    alone = {r.item_id: r.outcome for r in W.merge(p, *frames, pairs, graph_only=True, cap=4)[0].collect()}
    assert alone[5] == alone[7] == "answer" and alone[9] == "refuse"


def test_parsing_falls_back(spark):
    crash = D.Parser("first", ("bin",), lambda _: 1 / 0, 0.9)
    odd = D.Parser("odd", ("odd",), lambda _: [("poem", None, "x"), ("paragraph", None, "y")], 0.9)
    fine = D.Parser("second", ("bin", "odd"), lambda b: [("heading", 1, "Head"), ("paragraph", None, b.decode())], 0.5)
    registry = D.default_registry().register(crash).register(odd).register(fine)
    with pytest.raises(ValueError):
        registry.register(fine)
    files = spark.createDataFrame([("a", "bin", bytearray(b"body")), ("b", "odd", bytearray(b"z")), ("c", "none", bytearray(b"")), ("d", "txt", bytearray(b"one\n\ntwo")), ("e", "pdf", bytearray(b"(shown) Tj")), ("f", "txt", None)], "path string, media_type string, content binary")
    got = D.parse_files(files, registry).orderBy("path", "attempt").collect()
    assert [(r.path, r.attempt, r.parser_id, r.decision, r.failures) for r in got] == [("a", 0, "first", "fallback", ["parser_crash"]), ("a", 1, "second", "accept", []), ("b", 0, "odd", "fallback", ["invalid_ir"]), ("b", 1, "second", "accept", []), ("c", 0, None, "rejected", ["no_eligible_parser"]), ("d", 0, "text-lines", "accept", []), ("e", 0, "pdf-literal", "accept", []), ("f", 0, "text-lines", "quarantine", ["no_readable_content"])]
    blocks = {r.path: r.blocks for r in got if r.decision == "accept"}
    assert [(x.type, x.text, x.start, x.end) for x in blocks["a"]] == [("heading", "Head", 0, 4), ("paragraph", "body", 5, 9)]
    ir = {r.source.resource: r for r in D.document_ir(D.parse_files(files, registry), files).collect()}
    assert set(ir) == {"a", "b", "d", "e"} and ir["a"].source.digest == "sha256:" + hashlib.sha256(b"body").hexdigest()
    assert [p.parser_id for p in D.default_registry(lambda _: []).ranked("pdf", 1)] == ["pdf-converter", "pdf-literal"]


def test_adapters_are_bound_to_their_ledger(spark):
    import pandas as pd

    ledger = spark.createDataFrame([(1, 1, "c1", "one", "q1", True), (1, 2, "c2", "two", "q2", True), (1, 3, "c3", "three", "q3", False)], "item_id long, position int, claim_id string, text string, citation string, verified boolean")
    got = D.synthesize(ledger, "item_id", lambda claims: [*[c["claim_id"] for c in reversed(claims)], "invented"]).first()
    assert got.claim_ids == ["c2", "c1"] and got.dropped == 1 and got.answer == "two [q2]\none [q1]"
    blocks = spark.createDataFrame([("d", "b1"), ("d", "b2")], "doc string, block_id string")
    made = D.distill(blocks, "doc", lambda f: pd.DataFrame([("d", "k1", ["b1"]), ("d", "k2", ["b9"])], columns=["doc", "claim_id", "block_ids"]), "doc string, claim_id string, block_ids array<string>")
    assert {r.claim_id: r.bound for r in made.collect()} == {"k1": True, "k2": False}
    rows = spark.createDataFrame([("pdf", bytearray(b"\0\0\0\0\x001.4")), ("docx", bytearray(b"\0\0\0\0rest")), ("pdf", bytearray(b"%PDF-1.4"))], "kind string, content binary")
    assert [bytes(r.c) for r in rows.select(D.restore_signature(F.col("content"), F.col("kind")).alias("c")).collect()] == [b"%PDF-1.4", b"PK\x03\x04rest", b"%PDF-1.4"]
    report = spark.range(1).select(D.quality_report(F.expr("map('text', 0.9D, 'layout', cast(null as double))")).alias("r")).first().r
    assert [(x.name, x.applicable) for x in report] == [("layout", False), ("text", True)]


def test_identities_do_not_run_together(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", "")], "x string, y string").select("x", "y", T.digest(F.col("x"), F.col("y")).alias("d")).collect()
    assert len({r.d for r in rows}) == 4
    assert all(r.d == "sha256:" + hashlib.sha256(json.dumps([r.x, r.y], separators=(",", ":")).encode()).hexdigest() for r in rows)


def test_lines_end_where_unicode_ends_them(spark):
    text = "one\r\ntwo\rthree\n\nfour\x0bfive\x0csix\x1cseven\x85eight nine  \nlast"
    got = B.line_blocks(spark.createDataFrame([(1, text), (2, None), (3, "\n")], "doc_id long, text string")).orderBy("line_no").collect()
    want, at = [], 0
    for n, piece in enumerate(text.splitlines(keepends=True)):
        own = piece.splitlines()[0]
        if own.strip(" "):
            want.append((n, at, at + len(own), own))
        at += len(piece)
    assert [(r.line_no, r.start, r.end, r.text) for r in got] == want


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_accuracies(spark):
    many = [f"w{k}" for k in range(500)]
    swapped = [*many[:10], many[210], *many[11:]]
    cases = [("ab".split(), "ab XY".split()), (many, swapped), (many, many[200:] + many[:200]), ([], ["a"]), (["a"], []), ([], [])]
    rows = spark.createDataFrame([(k, a, b, " ".join(a), " ".join(b)) for k, (a, b) in enumerate(cases)], "k int, a array<string>, b array<string>, s string, t string")
    for r in rows.select("*", L.word_accuracy(F.col("a"), F.col("b")).alias("words"), L.edit_accuracy(F.col("s"), F.col("t")).alias("signs")).collect():
        right = lambda x, y: max(0, (n := max(1, len(x), len(y))) - _distance(x, y)) * 1_000_000 // n
        assert r.words == right(r.a, r.b) and r.signs == right(r.s, r.t)


def test_convex_and_fragments(spark):
    shapes = {"square": [(0, 0), (2, 0), (2, 2), (0, 2)], "dart": [(0, 0), (4, 0), (1, 1), (0, 4)], "line": [(0, 0), (1, 1), (2, 2)], "turned": [(0, 2), (2, 2), (2, 0), (0, 0)]}
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in v]) for k, v in shapes.items()], "k string, p array<struct<x:double,y:double>>")
    assert {r.k: r.c for r in df.select("k", L.convex(F.col("p")).alias("c")).collect()} == {"square": True, "dart": False, "line": False, "turned": True}
    boxes = spark.createDataFrame([(1, 1, 1, 0, 10, "he", 0.9), (1, 1, 1, 8, 20, "llo", 0.8), (1, 1, 1, 20, 30, "you", 0.7), (1, 1, 2, 0, 5, "x", 0.5)], "page int, col int, line int, l int, r int, text string, confidence double")
    got = L.reading_order(L.merge_fragments(boxes, "page"), "page").orderBy("place").collect()
    assert [(r.text, r.confidence, r.place) for r in got] == [("he llo", 0.8, 1), ("you", 0.7, 2), ("x", 0.5, 3)]


def test_lines_need_an_overlap(spark):
    boxes = spark.createDataFrame([(1, 1, 1, 0, 0, 0, 1), (1, 1, 2, 0, 0, 5, 2), (1, 1, 3, 5, 9, 5, 3)], "page int, col int, box int, t int, b int, l int, r int")
    assert len({r.line for r in L.lines(boxes, "page").collect()}) == 3


def test_generations_apply_and_roll_back(spark):
    log = spark.createDataFrame([(1, "add", "a"), (2, "add", "b")], "sequence int, kind string, entry_id string")
    new = X.apply_promotions(log, spark.createDataFrame([("d", 2), ("c", 1)], "entry_id string, at int"), "at").orderBy("sequence").collect()
    assert [(r.sequence, r.entry_id, r.previous) for r in new] == [(3, "c", 2), (4, "d", 3)]
    assert [(r.sequence, r.restores) for r in X.rollback_generation(log, F.lit(1)).collect()] == [(3, 1)]
    assert X.rollback_generation(log, F.lit(2)).count() == X.rollback_generation(log, F.lit(9)).count() == 0
    made = X.provenance(spark.createDataFrame([("k", "s", "p", "d", "batch")], "candidate_id string, source_digest string, parse_digest string, distillation_digest string, origin string"))
    own = spark.createDataFrame([("k", "s")], "candidate_id string, source_digest string")
    assert X.provenance_faults(made, own).count() == 0
    assert X.provenance_faults(made.withColumn("origin", F.lit("web")), own.filter("false")).first().violations == "candidate_missing,source_differs,self_digest,origin"


def test_policy_of_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x" * 10)
    (tmp_path / "b.bin").write_bytes(b"x" * 200)
    rows = {r.path.rsplit("/", 1)[1]: r for r in B.by_policy(B.read_files(spark, str(tmp_path), 100), ["txt"], 50, str(tmp_path)).collect()}
    assert rows["a.txt"].refused == "" and rows["b.bin"].status == "too_large" and rows["b.bin"].refused == "kind,too_large" and rows["b.bin"].content is None
