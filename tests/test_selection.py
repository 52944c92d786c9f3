"""The selector against plain Python over random corpora."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import retrieval as R
from factloom.operators import selection as S

WORDS = "alpha beta gamma delta price fee effective replace owner value 12 7 red blue".split()


def words(text):
    return re.findall(r"[^\W_]+", text.lower().replace("_", " "))


def terms(text):
    return {w for w in words(text) if w not in T.STOP}


def corpus(seed, long=False):
    r = random.Random(seed)
    some = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    titles = ["Alpha Beta", "Beta", "Alpha Beta Gamma", "Delta_Red", "beta-gamma", "Blue (12)"]
    docs, blocks = [], []
    for k in range(30):
        docs.append((k, r.random() < 0.1, r.random() < 0.9, f"{'abc'[k % 3]}-{k}"))
        head = f"# {r.choice(titles)}{r.choice(['', ' - more', ' | x'])}" if r.random() < 0.7 else some(3)
        rows = [some(2), head] if r.random() < 0.2 else [head]
        rows += [some(r.randrange(1, 400 if long else 9)) + r.choice([".", " 5", ""]) for _ in range(r.randrange(1, 6))]
        blocks += [(k, n, t) for n, t in enumerate(rows)]
    prompts = [(k, r.choice(["", "the " + r.choice(titles) + " ", "about alphabeta and alpha beta gamma, "]) + some(r.randrange(0, 4))) for k in range(25)]
    prompts += [(90, "the of and"), (91, "what is alpha beta beta"), (92, "alpha beta gamma")]
    return docs, blocks, prompts


def flat(text):
    return " ".join(text.lower().replace("_", " ").split())


def subject_of(rows):
    for text in rows[:2]:
        if text.lstrip().startswith("#"):
            return flat(re.split(r"\s+[—–|]\s+|\s+-\s+", text.lstrip("# ").strip())[0]) or None
    return None


def named_in(prompt, subjects):
    text, taken, out = flat(prompt), set(), set()
    spans = [(-len(s), i, s) for s in subjects for i in range(len(text)) if text.startswith(s, i) and not re.match(r"\w", text[i - 1 : i]) and not re.match(r"\w", text[i + len(s) : i + len(s) + 1])]
    for size, start, subject in sorted(spans):
        own = set(range(start, start - size))
        if not own & taken:
            taken |= own
            out.add(subject)
    return out


def expected(docs, blocks, prompts, limit, cap, room):
    texts = {k: [t for d, _, t in blocks if d == k] for k, *_ in docs}
    subject = {k: subject_of(v) for k, v in texts.items()}
    chosen, gates = {}, {}
    for item, prompt in prompts:
        asked, named = terms(prompt), named_in(prompt, {s for s in subject.values() if s})
        shut = [k for k, hidden, *_ in docs if hidden]
        no = bool(asked) and any(subject[k] in named if named else any(asked & terms(t) for t in texts[k]) for k in shut)
        if no or not asked:
            chosen[item], gates[item] = [], (no, False, no)
            continue
        open_ = [(k, current) for k, hidden, current, _ in docs if not hidden]
        mine = [x for x in open_ if subject[x[0]] in named] or open_
        mine = mine[:cap]
        frequency = {w: sum(w in terms(t) for k, _ in mine for t in texts[k]) for w in asked}
        found = []
        for k, _ in mine:
            for n, text in enumerate(texts[k]):
                shared = asked & terms(text)
                used = {w for w in shared if w not in terms(subject[k] or "") and w not in T.DIRECTIVES} or shared
                if not used:
                    continue
                score = sum(max(0.5, math.log(1 + (len(mine) - frequency[w] + 0.5) / (frequency[w] + 0.5))) for w in used)
                score += 10 * (" ".join(words(prompt)) in " ".join(words(text)))
                score += 2 * bool(asked & set(T.NUMERIC) and re.search(r"\d", text)) + 1.5 * bool(re.search(T.EFFECTIVE, text))
                found.append((-round(score * (0.12 if text.lstrip().startswith("#") else 1), 6), k, n, len(text)))
        out, used, short = [], 0, False
        for spread in (True, False):
            for row in sorted(found):
                if len(out) < limit and row not in out and not (spread and row[1] in [x[1] for x in out]):
                    if used + row[3] <= room:
                        out.append(row)
                        used += row[3]
                    else:
                        short = True
        chosen[item], gates[item] = [(k, n) for _, k, n, _ in out], (False, any(not c for _, c in mine), short or len(mine) == cap)
    return chosen, gates


def frames(spark, docs, blocks, prompts):
    return (spark.createDataFrame(blocks, "doc_id long, line_no int, text string"), spark.createDataFrame(prompts, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, restricted boolean, current boolean, source_id string"))


@pytest.mark.parametrize("seed,cap,long,look", [(1, 64, False, 512), (2, 5, False, 512), (3, 64, True, 512), (4, 64, True, 6)])
def test_selector(spark, monkeypatch, seed, cap, long, look):
    monkeypatch.setattr(R, "LOOK", look)
    docs, blocks, prompts = corpus(seed, long)
    docs.sort()
    if seed == 4:  # few restricted documents, so that packing shows
        docs = [(k, False, c, s) for k, _, c, s in docs]
    want, gates = expected(docs, blocks, prompts, 6, cap, R.MOST_CHARS if not long else 6000)
    if long:
        monkeypatch.setattr(R.packed_blocks, "__defaults__", (6000, 6000, None))
    chosen, got = S.select_blocks(*frames(spark, docs, blocks, prompts), 6, cap)
    by = {item: [] for item, _ in prompts}
    for r in chosen.orderBy("item_id", "position").collect():
        by[r.item_id].append((r.doc_id, r.line_no))
    assert by == want
    assert {r.item_id: (r.restricted, r.stale, r.incomplete) for r in got.collect()} == gates
    assert any(want.values()) and (seed == 4 or any(g[0] for g in gates.values()))


def test_context_is_admitted_after_all_seeds(spark):
    blocks = spark.createDataFrame([(1, n, t) for n, t in enumerate(["aa", "bb", "# h", "cc", "dd", "ee"])], "doc_id long, line_no int, text string")
    chosen = spark.createDataFrame([(7, 1, 4, 1), (7, 1, 0, 2), (8, 1, 2, 1)], "item_id long, doc_id long, line_no int, position long")
    got = lambda *a: {k: [x[1:] for x in sorted(v)] for k, v in _grouped(S.admit_context(chosen, blocks, *a).collect()).items()}
    assert got(2, 9, 100) == {7: [(4, False), (0, False), (5, False), (3, False), (1, False)], 8: [(2, False)]}
    assert got(2, 3, 100) == {7: [(4, True), (0, True), (5, True)], 8: [(2, False)]}
    assert got(1, 9, 4) == {7: [(4, True), (0, True)], 8: [(2, False)]}
    assert got(0, 9, 1) == {7: [(None, True)], 8: [(None, True)]}


def _grouped(rows):
    out = {}
    for r in rows:
        out.setdefault(r.item_id, []).append((r.position or 0, r.line_no, r.limited))
    return out


def test_cohorts_of_a_provider(spark):
    blocks = [(1, 0, "# Site A"), (1, 1, "Intro. Site A purchases service from Acme Ltd."), (1, 2, "The owner is Jo."), (2, 0, "# Site B"), (2, 1, "Site B purchases service from Acme Ltd"), (2, 2, "Unit price 5."), (3, 0, "# Site C"), (3, 1, "Site C purchases service from Other Co."), (3, 2, "The owner is Al."), (4, 0, "# Bill"), (4, 1, "Price 9 takes effect."), (5, 0, "# Site D"), (5, 1, "Site D purchases service from Acme Ltd"), (6, 0, "# Site E"), (6, 1, "nothing")]
    docs = [(1, False, True, "x-1"), (2, False, True, "y-1"), (3, False, True, "z-1"), (4, False, True, "y-2"), (5, True, True, "w-1"), (6, False, True, "v-1")]
    prompts = [(1, "all sites with the same provider as site a: owner"), (2, "other sites with the provider of Site A, price"), (3, "same provider as site e"), (4, "site a owner"), (5, "same provider")]
    b, p, d = frames(spark, docs, blocks, prompts)
    named = S.subjects(b)
    got = {}
    for r in S.cohort_blocks(b, p, d, named, S.focus(p, named)).collect():
        got.setdefault(r.item_id, set()).add((r.doc_id, r.line_no, r.part, r.resolved))
    # "Acme Ltd." with its stop and "Acme Ltd" are two providers, as the stop belongs to the name.
    assert got[1] == {(1, 1, 0, True), (1, 2, 1, True)}
    assert got[2] == {(None, None, None, True)}
    assert got[3] == {(None, None, None, False)} and set(got) == {1, 2, 3}


def test_cohort_prompts_in_the_selector(spark):
    sites = "ABDEFGH"
    blocks, docs = [], []
    for k, x in enumerate(sites):
        provider = "Acme Ltd" if x != "H" else "Other Co"
        blocks += [(k, 0, f"# Site {x}"), (k, 1, f"Site {x} purchases service from {provider}"), (k, 2, f"The owner is P{k}." + "x" * (40 * k)), (k, 3, "Something else of site.")]
        docs.append((k, x == "G", x != "F", f"{x.lower()}-1"))
    blocks += [(9, 0, "# Site Z"), (9, 1, "no assignment")]
    docs.append((9, False, True, "z-1"))
    prompts = [(1, "owner of all sites with the same provider as site a"), (2, "owner of other sites with the provider of site a"), (3, "all with the same provider as site z"), (4, "all sites with the same provider as site g"), (5, "who is the owner of site a"), (6, "all sites with the same provider as site b")]
    b, p, d = frames(spark, docs, blocks, prompts)
    for limit in (3, 20):
        chosen, gates = S.select_blocks(b, p, d, limit)
        got = {}
        for r in chosen.orderBy("item_id", "position").collect():
            got.setdefault(r.item_id, []).append((r.doc_id, r.line_no))
        gate = {r.item_id: (r.restricted, r.stale, r.incomplete, r.cohort) for r in gates.collect()}
        members = [0, 1, 2, 3, 4]
        assert got[1] == ([(k, 1) for k in members] + [(k, 2) for k in members])[:limit]
        assert got[2] == ([(k, 1) for k in members[1:]] + [(k, 2) for k in members])[:limit] or got[2] == ([(k, 1) for k in members[1:]] + [(k, 2) for k in members[1:]])[:limit]
        assert got[6] == [(k, 1) for k in members][:limit] and 3 not in got and 4 not in got
        assert gate[3] == (False, False, True, "unresolved") and gate[4] == (True, False, True, None)
        assert gate[1] == (False, limit == 20, False, "resolved") and gate[5][3] is None
    outcomes, evidence = S.query_documents(b, p.unionByName(spark.createDataFrame([(7, "bell" + chr(7))], p.schema)), d, 20)
    said = {r.item_id: r for r in outcomes.collect()}
    assert {k: (r.outcome, r.reason) for k, r in said.items() if k != 5} == {1: ("investigate", "freshness_investigation_required"), 2: ("investigate", "freshness_investigation_required"), 3: ("refuse", "no_evidence"), 4: ("refuse", "restricted_evidence"), 6: ("investigate", "freshness_investigation_required"), 7: ("refuse", "query_invalid")}
    assert said[3].qualifications == [S.SAYS["unresolved"]] and said[4].qualifications == [S.SAYS["restricted"]]
    shown = evidence.filter("item_id = 6").orderBy("position").collect()
    assert [r.render_text for r in shown] == [f"Site {x} purchases service from Acme Ltd" for x in "ABDEF"] and len({r.evidence_id for r in shown}) == 5


def test_prompts_are_checked(spark):
    texts = ["", " ", "fine", "x" * 1024, "x" * 1025, "tab\there", "zero​width", "é", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("ok", S.valid_prompt(F.col("text"))).collect()
    assert [r.ok for r in sorted(rows, key=lambda r: r.k)] == [False, False, True, True, False, False, False, True, False]


def test_scores_by_joins_equal_scores_by_arrays(spark, monkeypatch):
    """Prompts of too many terms to go to the workers as arrays take the joins; pruned scores keep the best."""
    _, blocks, prompts = corpus(8)
    b, p, _ = frames(spark, [(0, False, True, "a")], blocks, prompts)
    show = lambda rows: {(r.item_id, r.doc_id, r.line_no): tuple(round(r[c], 5) for c in ("overlap", "score", "phrase_bonus", "numeric_bonus", "effective_bonus", "chars")) for r in rows.collect()}
    arrays = show(R.ranked(b, p, 30))
    best = R.diverse_blocks(R.ranked(b, p, 30, 4, True), 4).select("item_id", "rank", "doc_id", "line_no").collect()
    packed = R.packed(b, p, 30, 4).collect()
    monkeypatch.setattr(R, "asked_arrays", lambda *_: None)
    assert arrays == show(R.ranked(b, p, 30)) and len(arrays) > 500
    assert sorted(best) == sorted(R.diverse_blocks(R.ranked(b, p, 30), 4).select("item_id", "rank", "doc_id", "line_no").collect())
    assert sorted(packed) == sorted(R.packed(b, p, 30, 4).collect())
