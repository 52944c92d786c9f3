"""Steps that grew faster than their input, or cost far too much of it: the same results by lighter plans."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import benchmarks as M
from factloom.operators import graph as G
from factloom.operators import knowledge as K
from factloom.operators import navigation as N
from factloom.operators import retrieval as R
from factloom.operators import selection as S
from factloom.plans import contract, contract_selection
from factloom.sources import blocks as B
from factloom.sources import docx as D
from factloom.sources import scans as C


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cut_without_matching_them(spark):
    texts = ["", "a", "a\n", "\r\n\r\nb\r\n", "a\rb\n\rc d\x85e\x1cf \n \ng", "\n\n", "x\r\n", "퟿ \r\r\n\U0001f600\x0b\x0cy", " \r\n z \n"] + ["".join(random.Random(k).choices("ab \n\r\x1d\x85 \U0001f600", k=40)) for k in range(200)]
    got = B.line_blocks(spark.createDataFrame([*enumerate(texts), (len(texts), None)], "doc_id long, text string"))
    want = []
    for k, text in enumerate(texts):
        for n, m in enumerate(re.finditer("[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])|[^\n\r\x0b\x0c\x1c-\x1e\x85  ]+", text)):
            line = re.sub("(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])$", "", m[0]) if m[0][-1] in B.END_SIGNS else m[0]
            if line.strip(" "):
                want.append((k, n, m.start(), m.start() + len(line), line))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "regexp_extract_all" not in plan(got)


def walk(visits, weights, target, nodes, tokens):
    whole, states, spent, before, out = sum(weights.values()), {}, 0, 0.0, []
    for step in sorted({v[0] for v in visits if v[0] <= nodes}):
        part = sorted(v for v in visits if v[0] == step)
        if spent + part[0][4] > tokens:
            break
        spent += part[0][4]
        for _, requirement, _, status, _ in part:
            states[requirement] = min(states.get(requirement, status), status, key=N.PRECEDENCE.index)
        now = round(sum(weights.get(k, 0.0) * N.WORTH[s] for k, s in states.items()) / whole, 12) if whole else 0.0
        out.append((step, part[0][2], now, round(now - before, 12), now >= target))
        before = now
        if now >= target:
            break
    return out


def test_navigator_needs_no_python_for_each_query(spark):
    rng, visits, weights = random.Random(3), [], {}
    for q in range(60):
        weights[q] = {f"r{k}": rng.choice([0.1, 0.7, 1.0, 3.0]) for k in range(rng.randint(1, 4))} if q else {"r0": 0.0}
        for step in range(1, rng.randint(2, 14)):
            visits += [(q, step, f"r{k}", f"n{step}.{k}", rng.choice(N.PRECEDENCE[rng.randint(0, 3) :]), rng.randint(0, 30)) for k in rng.sample(range(5), rng.randint(1, 3))]
    trace = N.navigate(
        spark.createDataFrame(visits, "query_id int, step int, requirement string, node string, status string, tokens int"),
        spark.createDataFrame([(q, k, w) for q, own in weights.items() for k, w in own.items()], "query_id int, requirement string, weight double"), 0.8, 10, 120)
    want = [(q, *line) for q in weights for line in walk([v[1:] for v in visits if v[0] == q], weights[q], 0.8, 10, 120)]
    assert sorted(tuple(r) for r in trace.collect()) == want
    assert "Pandas" not in plan(trace)


def test_elements_that_are_not_asked_for_stay_in_the_task(spark):
    body = D.write_package("<w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc/></w:tr></w:tbl></w:tc></w:tr></w:tbl>")
    files = spark.createDataFrame([("x", body), ("y", None)], "path string, content binary")
    whole, few, cells = (D.shred(files, **more) for more in ({}, {"tags": D.GRID_TAGS}, {"tags": D.CELL_TAGS}))
    assert "MapInPandas" not in plan(few) and 0 < few.count() < cells.count() < whole.count()
    assert few.filter("tag = '!'").collect()[0]["text"] == "no_package"
    assert sorted(D.table_sizes(few).collect()) == sorted(D.table_sizes(whole).collect()) == [("x", 2, 2, 2, 1)]
    assert sorted(D.table_cells(cells).collect()) == sorted(D.table_cells(whole).collect())


def test_pairs_are_counted_by_all_tasks_and_logs_are_not_broadcast(spark):
    claims = spark.createDataFrame([(k, f"red bolt word{k}") for k in range(50)], "claim_id int, text string").coalesce(1)
    found = G.claim_query(claims, spark.createDataFrame([(1, "red bolt word7"), (2, "none")], "item_id int, text string"), 3)
    assert sorted((r.item_id, r.claim_id, r.score, r["rank"]) for r in found.collect()) == [(1, 0, 2, 2), (1, 1, 2, 3), (1, 7, 3, 1)]
    assert "RepartitionByExpression [claim_id" in plan(found)
    log = spark.createDataFrame([(g, s) for g in range(3) for s in range(1, 9)], "g int, s int")
    kept = K.replay(log, "g", "s", F.nullif(F.floor(F.col("s") / 2).cast("int"), F.lit(0)))
    assert sorted(tuple(r) for r in kept.collect()) == [(g, s) for g in range(3) for s in (1, 2, 4, 8)]
    assert "strategy=merge" in plan(kept)


def test_scores_meet_few_texts_and_no_word_is_an_object(spark, monkeypatch):
    rng, words = random.Random(5), ["fee", "Water", "effective", "7", "the", "pump", "Bau", "x_y", "ǅungla"]
    rows = [(k, n, " ".join(rng.choices(words, k=rng.randint(1, 7)))) for k in range(60) for n in range(4)]
    blocks = spark.createDataFrame(rows, "doc_id long, line_no int, text string").coalesce(2)
    prompts = spark.createDataFrame([(1, "water pump bau fee"), (2, "fee 7 pump bau"), (3, "bau pump the water 7"), (4, "none")], "item_id int, text string")
    written, whole = [], R.checkpointed
    monkeypatch.setattr(R, "checkpointed", lambda df: written.append(plan(df)) or whole(df))
    every = R.ranked(blocks, prompts, 60)
    assert "regexp_extract_all" not in written[0] and "strategy=broadcast" in plan(every)
    some = R.ranked(blocks, prompts, 60, bonused=True)
    bonus = "phrase_bonus + numeric_bonus + effective_bonus > 0"
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(some.filter(bonus)) == got(every.filter(bonus)) and 0 < some.count() < every.count()
    assert got(R.top_blocks(R.ranked(blocks, prompts, 60, 3), 3)) == got(R.top_blocks(every, 3))
    monkeypatch.setattr(R, "asked_arrays", lambda *_: None)  # joins, with the same results
    assert got(R.ranked(blocks, prompts, 60).select(every.columns)) == got(every)


def test_found_claims_meet_their_texts_where_these_lie(spark):
    claims = spark.createDataFrame([(k, 0, f"red bolt word{k}") for k in range(50)], "entry_id long, claim_id int, text string")
    found = K.search(claims, spark.createDataFrame([(1, "bolt word7"), (2, "red bolt word9")], "item_id int, text string"), 2)
    assert sorted((r.item_id, r.entry_id, r.exact, r.within, r.hits, r["rank"]) for r in found.collect()) == [(1, 0, 0, 0, 1, 2), (1, 7, 0, 1, 2, 1), (2, 0, 0, 0, 2, 2), (2, 9, 1, 1, 3, 1)]
    assert "strategy=broadcast" in plan(found)


def test_the_state_of_a_run_does_not_grow_with_its_actions(spark, monkeypatch):
    event = "array(named_struct('requirement', 'r0', 'status', 'partial', 'provenance', true, 'citation', true, 'fresh', true, 'trusted', true, 'contradicts', false))"
    actions = spark.range(1, 401).selectExpr("'q' query_id", "cast(id as int) step", "case when id % 9 = 0 then 'replan' when id = 5 then 'reject' else 'visit' end action", "cast(id % 10 as string) node", "1 tokens", "1 seconds", f"{event} events", "array('r0') targets")
    need = spark.createDataFrame([("q", "r0", 1.0, True, False, True)], "query_id string, requirement string, weight double, mandatory boolean, citation_required boolean, provenance_required boolean")
    written, whole = [], N.checkpointed
    monkeypatch.setattr(N, "checkpointed", lambda df: written.append(whole(df)) or written[-1])
    runs = N.run_plans(actions, N.requirement_plan(need), 0.8, {"depth": 50, "nodes": 50, "tokens": 5000, "seconds": 60, "replans": 3})
    results = [r.result for r in runs.orderBy("step").collect()]
    seen, replans, want = set(), 0, []
    for k in range(1, 401):
        if k % 9 == 0:
            want.append("replanned" if replans < 3 else "budget")
            replans += 1
        elif k == 5:
            want.append("rejected")
        else:
            want.append("visited_before" if k % 10 in seen else "rejected_before" if k % 10 == 5 and k > 5 else "visited")
            seen |= {k % 10} if want[-1] == "visited" else set()
    assert results == want
    assert written[0].filter("tries").count() == len(written[1].first()["made"]) == 9


def test_small_files_are_scanned_in_a_table(spark, tmp_path):
    bodies = ['{"b": 1, "a": [2]}\n', '{"a": 1, "a": 2}', '{"a": NaN}', "[1]", "{", '{"long": "' + "x" * 99 + '"}']
    for k, body in enumerate(bodies):
        (tmp_path / f"{k}.json").write_text(body)
    table = spark.createDataFrame([(f"{k}.json", len(body), body.encode()) for k, body in enumerate(bodies)], "path string, length long, content binary")
    got = lambda df: sorted((r.path.rsplit("/", 1)[-1], *r[1:]) for r in df.collect())
    assert got(C.strict_contents(table, 100)) == got(C.strict_files(spark, str(tmp_path), 100))
    assert [r[3] for r in got(C.strict_contents(table, 100))] == [None, "repeated_key", "non_finite", "not_an_object", "malformed", "too_large"]


def test_sample_reads_its_lines_once_and_shuffles_them_once(spark, tmp_path):
    rng = random.Random(5)
    said = lambda n: "\n".join(rng.choice(["Ab, c", "ab C", "Ab, c", "x.", "# y", "1 | 2", "Käİz", f"Z{rng.randrange(99)}."]) for _ in range(n))
    spark.createDataFrame([(k, said(k % 30)) for k in range(90)] + [(None, "a\nb"), (91, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = contract.QUERIES["quality_sample"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(duck.sql(contract.ORACLE["quality_sample"]).fetchall())
    physical = contract.QUERIES["quality_sample"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 1 and physical.count("FileScan") == 1


def test_duplicate_keys_list_words_and_replace_nothing(spark):
    texts = [None, "", " -", "Ab, c", "  1äBİKßΣσ \n\t2 ", "--x--"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(T.t5_text(F.col("text")).alias("key"), F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")).alias("want"))
    assert all(r.key == r.want for r in rows.collect())
    assert "regexp_replace" not in plan(rows.select("key"))


def test_selector_gets_tables_that_are_written(spark, monkeypatch):
    given = []
    monkeypatch.setattr(contract_selection.S, "select_blocks", lambda *tables: (given.extend(tables[:3]), tables[0])[1:])
    contract.QUERIES["select_document_blocks"](spark, "/root/testdata/sf0.001")
    assert len(given) == 3 and all(plan(x).startswith("Relation") for x in given)


def test_only_blocks_with_an_assignment_meet_subjects(spark):
    blocks = spark.createDataFrame([(1, 0, "Intro. Acme_co PuRcHaSeS\tService  FROM Big Co."), (1, 1, "Acme co buys. acme co purchases service from X"), (1, 2, "Other purchases service from X"), (2, 0, "purchases service"), (2, 1, None)], "doc_id int, line_no int, text string")
    got = S.assignments(blocks, spark.createDataFrame([(1, "acme co"), (2, "b")], "doc_id int, subject string"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, "acme co", "big co."), (1, 1, "acme co", "x")]
    assert T.ASSIGNS in plan(got)


def test_scores_of_attempts_are_one_aggregate(spark):
    rows = [(1, "a", 2.0, False), (1, "b", 5.0, False), (1, "z", 9.0, False), (2, "a", None, False), (2, "b", 1.0, True), (3, None, 1.0, False), (4, "zero", 1.0, False), (4, "b", 0.5, None)]
    manifests = spark.createDataFrame(rows, "id int, metric string, score double, excluded boolean")
    got = M.applicable_scores(manifests, spark.createDataFrame([("a", 3.0), ("b", 1.0), ("zero", 0.0)], "metric string, weight double"), "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2.75, "a,b"), (2, None, ""), (3, None, ""), (4, None, "")]
    assert plan(got).count("Aggregate") == 1


def test_next_attempts_are_compared_without_a_broadcast(spark):
    out = contract.QUERIES["applicable_scores"](spark, "/root/testdata/sf0.001")
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and "Aggregate" not in plan(out)
