"""Tiered samples, line matching, attempts, clipping, transactions: against brute force and known faults."""

import itertools
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from factloom.operators import layout as L
from factloom.operators import quality as Q
from factloom.operators import transactions as X


# Samples


def brute_sample(records, quota):
    """One claim after the other, tier by tier."""
    if len(records) <= quota:
        return [("digest_fill", r) for r in records]
    taken, seen, left = [], set(), quota
    by_digest = lambda rows: sorted(rows, key=lambda r: (r["digest"], r["claim"]))

    def add(reason, rows):
        nonlocal left
        fresh = [r for r in dict.fromkeys(r["claim"] for r in rows) if r not in seen]
        rows = {r["claim"]: r for r in rows}
        if len(fresh) > left:
            fresh = [r["claim"] for r in by_digest([rows[c] for c in fresh])][:left]
        for c in fresh:
            taken.append((reason, rows[c]))
            seen.add(c)
        left -= len(fresh)

    for reason, flag in (("binding_risk", "binding_risk"), ("normalized_duplicate", "duplicate"), ("fragmentation", "fragment")):
        add(reason, by_digest([r for r in records if r[flag]]))
    add("position", [records[0], records[(len(records) - 1) // 2], records[-1]])
    add("length", [by_digest([r for r in records if r["size"] == pick(x["size"] for x in records)])[0] for pick in (max, min)])
    kinds = [k for k in dict.fromkeys(r["block_type"] for r in records) if not any(x["block_type"] == k for _, x in taken)]
    add("block_type_representative", [by_digest([r for r in records if r["block_type"] == k])[0] for k in kinds])
    add("digest_fill", by_digest(records))
    return taken


@pytest.mark.parametrize("rate", [0.05, 0.3])
def test_tiered_sample(spark, rate):
    r = random.Random(int(rate * 100))
    rows = []
    for group in range(60):
        for k in range(r.randrange(1, 40)):
            rows.append((group, f"c{k:02d}", k, r.randrange(6), r.choice("abcdefg"[: r.randrange(1, 8)]), f"{r.randrange(20):02d}", r.random() < rate, r.random() < rate, r.random() < rate))
    names = "grp claim ordinal_no size block_type digest binding_risk duplicate fragment".split()
    claims = spark.createDataFrame(rows, "grp int, claim string, ordinal_no int, size int, block_type string, digest string, binding_risk boolean, duplicate boolean, fragment boolean")
    policy = Q.sampling_policy(claims, "grp", 9)
    got = {}
    for x in Q.tiered_sample(claims, policy, "grp").orderBy("grp", "ordinal").collect():
        got.setdefault(x["grp"], []).append((x["reason"], x["claim"]))
    reasons = set()
    for group, of in itertools.groupby(rows, key=lambda x: x[0]):
        records = [dict(zip(names, x, strict=True)) for x in of]
        want = [(reason, x["claim"]) for reason, x in brute_sample(records, min(9, len(records)))]
        assert got[group] == want
        reasons |= {x for x, _ in want}
    assert reasons == set(Q.TIERS) if rate < 0.1 else reasons
    assert {x["grp"]: x["quota"] for x in policy.collect()} == {g: min(9, len(list(of))) for g, of in itertools.groupby(rows, key=lambda x: x[0])}


# Lines


def cross(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def shoelace(points):
    return abs(sum((a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True)), Fraction(0))) / 2 if len(points) > 2 else Fraction(0)


def exact_overlap(one, two):
    one, two = ([(Fraction(x), Fraction(y)) for x, y in p] for p in (one, two))
    if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(two, two[1:] + two[:1], strict=True)) < 0:
        two = two[::-1]
    cut = one
    for a, b in zip(two, two[1:] + two[:1], strict=True):
        kept = []
        for p, q in zip(cut, cut[1:] + cut[:1], strict=True):
            u, v = cross(a, b, p), cross(a, b, q)
            if u >= 0:
                kept.append(p)
            if u * v < 0:
                kept.append((p[0] + (q[0] - p[0]) * u / (u - v), p[1] + (q[1] - p[1]) * u / (u - v)))
        cut = kept
    common = shoelace(cut)
    whole = shoelace(one) + shoelace(two) - common
    return common / whole if whole else Fraction(0)


def convex(r):
    """Corners on an ellipse, either way round."""
    import math

    cx, cy, w, h = r.randrange(20), r.randrange(20), r.randrange(3, 12), r.randrange(3, 12)
    corners = [(round(cx + w * math.cos(t), 3), round(cy + h * math.sin(t), 3)) for t in sorted(r.random() * 6.28 for _ in range(r.randrange(3, 8)))]
    return corners if r.random() < 0.5 else corners[::-1]


def polygon(corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def test_overlap_of_convex_polygons(spark):
    r = random.Random(2)
    pairs = [(convex(r), convex(r)) for _ in range(150)] + [([(0, 0), (4, 0), (4, 2), (0, 2)],) * 2, ([(0, 0), (1, 0), (1, 1), (0, 1)], [(5, 5), (6, 5), (6, 6), (5, 6)])]
    shape = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(k, polygon(a), polygon(b)) for k, (a, b) in enumerate(pairs)], f"k int, a {shape}, b {shape}")
    for x in df.select("k", L.overlap(F.col("a"), F.col("b")).alias("o")).collect():
        assert abs(x["o"] - float(exact_overlap(*pairs[x["k"]]))) < 1e-9


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def accuracy(a, b):
    n = max(1, len(a), len(b))
    return (n - distance(a, b)) * 1_000_000 // n


def test_attempts(spark):
    r = random.Random(8)
    sides = {"e": [], "a": []}
    for name, rows in sides.items():
        for key in range(14):
            for page in range(r.randrange(1, 4)):
                for place in range(r.randrange(0 if name == "a" else 1, 7)):
                    rows.append((key, page, place, " ".join(r.choices(["red", "read", "bolt", "gear", "a"], k=r.randrange(1, 4))), convex(r)))
    frame = lambda rows: spark.createDataFrame([(k, p, n, t, polygon(c)) for k, p, n, t, c in rows], "doc int, page int, place int, text string, polygon array<struct<x:double,y:double>>")
    got = {x["doc"]: x for x in L.attempt_scores(frame(sides["e"]), frame(sides["a"]), "doc").collect()}
    for key in range(14):
        e, a = ([x for x in sides[s] if x[0] == key] for s in "ea")
        free, met = set(range(len(a))), []
        for k, x in enumerate(e):
            held = [j for j in free if a[j][1] == x[1]]
            if held:
                best = min(held, key=lambda j: (distance(x[3], a[j][3]), -round(exact_overlap(x[4], a[j][4]), 9), a[j][2]))
                free.remove(best)
                met.append((k, best))
        texts = ["\n".join(x[3] for x in side) for side in (e, a)]
        pairs = list(itertools.combinations(met, 2))
        mean = sum(float(exact_overlap(e[k][4], a[j][4])) for k, j in met) / len(met) if met else 0
        pages = {x[1] for x in e}
        want = {
            "char_accuracy": accuracy(*texts),
            "word_accuracy": accuracy(*[t.split() for t in texts]),
            "precision": len(met) * 1_000_000 // max(1, len(a)),
            "recall": len(met) * 1_000_000 // max(1, len(e)),
            "order_accuracy": sum(x[1] < y[1] for x, y in pairs) * 1_000_000 // len(pairs) if pairs else 1_000_000,
            "pages": len(pages & {a[j][1] for _, j in met}) * 1_000_000 // len(pages),
            "invented": len(free),
        }
        assert {k: got[key][k] for k in want} == want
        assert abs(got[key]["overlap"] - mean * 1_000_000) < 2


def test_lines_of_a_column(spark):
    r = random.Random(1)
    rows = [(k % 30, k % 2, k, t := r.randrange(60), t + r.randrange(1, 14), r.randrange(5)) for k in range(900)]
    got = {x["box"]: x["line"] for x in L.lines(spark.createDataFrame(rows, "page int, col int, box int, t int, b int, l int"), "page").collect()}
    for _, of in itertools.groupby(sorted(rows, key=lambda x: (x[0], x[1], x[3], x[5], x[2])), key=lambda x: x[:2]):
        head, line = None, 0
        for _, _, box, t, b, _ in of:
            common = min(b, head[1]) - max(t, head[0]) if head else 0
            if not (common > 0 and 2 * common >= min(b - t, head[1] - head[0])):
                head, line = (t, b), line + 1
            assert got[box] == line


# Transactions


def test_a_promotion_with_two_proposals(spark):
    """Its authorisation is bound to the proposal of its digest, and is judged once."""
    bound = lambda digest: tuple(digest if b == "proposal_digest" else "c1" if b == "promotion_id" else "same" for b in X.BINDINGS)
    shape = ", ".join(f"{b} string" for b in X.BINDINGS)
    proposals = spark.createDataFrame([("apply", *bound("p1")), ("rollback", *bound("p2")), ("apply", *bound("p1"))], f"operation string, {shape}")
    grants = spark.createDataFrame([("a1", "n1", True, "apply", "2024-01-01 00:00:00", "2024-01-02 00:00:00", *bound("p1")), ("a2", "n2", True, "apply", "2024-01-01 00:00:00", "2024-01-02 00:00:00", *bound("p2"))], f"authorization_id string, nonce string, one_use_only boolean, operation string, issued_at string, expires_at string, {shape}")
    grants = grants.withColumns({c: F.col(c).cast("timestamp") for c in ("issued_at", "expires_at")})
    none = spark.createDataFrame([], "authorization_id string, nonce string, proposal_digest string, state string")
    found = X.validate_authorizations(grants, proposals, none, F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("same")).collect()
    assert sorted(map(tuple, found)) == [("a1", ""), ("a2", "operation")]


def test_own_and_foreign_staging_give_one_result(spark):
    intents = spark.createDataFrame([("t1", "p1", "i1"), ("t2", "p2", "i2")], "transaction_id string, promotion_id string, intent string")
    uses = spark.createDataFrame([(f"i{k}", "reserved", "a", None, "r") for k in (1, 2)], "intent string, state string, authorization string, previous string, record string")
    staging = spark.createDataFrame([("t1", "i1"), ("t1", "foreign"), ("t2", "i2"), ("t2", "i2")], "transaction_id string, intent string")
    found = X.recover(intents, spark.createDataFrame([], "transaction_id string"), spark.createDataFrame([("p1",), ("p2",)], "promotion_id string"), uses, spark.createDataFrame([("a",)], "authorization string"), staging).collect()
    assert sorted(map(tuple, found)) == [("t1", "investigate", "staging_ownership_uncertain"), ("t2", "recovered", "resumed_exact_transaction")]


def test_candidates_without_a_key(spark):
    candidates = spark.createDataFrame([("c1", "e1", None, "accepted"), ("c2", "e2", None, "accepted"), ("c3", "e3", "k", "accepted")], "candidate_id string, entry_id string, semantic_key string, review string")
    active = spark.createDataFrame([("e3", None)], "entry_id string, semantic_key string")
    assert sorted(map(tuple, X.prepare_promotions(candidates, active).collect())) == [("c1", ""), ("c2", ""), ("c3", "entry_exists")]
