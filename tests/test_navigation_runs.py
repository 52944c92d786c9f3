"""Runs of plans against a sequential navigator."""

import random

from factloom.operators import navigation as N

WORTH = {"satisfied": 1.0, "partial": 0.5}


def brute(actions, plan, target, budgets):
    left, states, events, visited, rejected = dict(budgets), dict.fromkeys(plan, "missing"), {r: [] for r in plan}, [], []
    version, coverage, stopped, out = 1, 0.0, False, []
    for a in actions:
        gain, result = 0.0, None
        if stopped:
            result = "stopped"
        elif a["action"] == "visit":
            if a["node"] in visited:
                result = "visited_before"
            elif a["node"] in rejected:
                result = "rejected_before"
            elif left["depth"] <= 0 or left["nodes"] <= 0 or a["tokens"] > left["tokens"] or a["seconds"] > left["seconds"]:
                result = "budget"
            elif any(e["requirement"] not in plan or e["status"] not in N.PRECEDENCE for e in a["events"]):
                result = "evidence_unknown"
            else:
                result = "visited"
                visited.append(a["node"])
                for b, cost in (("depth", 1), ("nodes", 1), ("tokens", a["tokens"]), ("seconds", a["seconds"])):
                    left[b] -= cost
                for e in a["events"]:
                    events[e["requirement"]].append(e)
                for r in plan:
                    found = ["contradictory" if e["contradicts"] else e["status"] for e in events[r]]
                    states[r] = min(found, key=N.PRECEDENCE.index, default="missing")
                before, coverage = coverage, round(sum(plan[r]["weight"] * WORTH.get(states[r], 0) for r in plan) / sum(p["weight"] for p in plan.values()), 12)
                gain = round(coverage - before, 12)
                some = [(r, e) for r in plan if states[r] in WORTH for e in events[r]] or [(r, e) for r in plan for e in events[r]]
                gates = all((e["provenance"] or not plan[r]["provenance_required"]) and (e["citation"] or not plan[r]["citation_required"]) and e["fresh"] and e["trusted"] for r, e in some) and "contradictory" not in states.values()
                stopped = coverage >= target and gates and all(states[r] == "satisfied" for r in plan if plan[r]["mandatory"])
        elif a["action"] == "reject":
            result = "visited_before" if a["node"] in visited else "rejected"
            if result == "rejected":
                rejected.append(a["node"])
        elif a["action"] == "replan":
            if left["replans"] <= 0:
                result = "budget"
            elif not a["targets"] or any(t not in plan or states[t] == "satisfied" for t in a["targets"]):
                result = "targets"
            else:
                result, version = "replanned", version + 1
                left["replans"] -= 1
        else:
            result = "action"
        spent = any(left[b] <= 0 for b in ("depth", "nodes", "tokens", "seconds"))
        out.append((a["step"], a["action"], a["node"], result, coverage, gain, version, "answer" if stopped else "exhausted" if spent else "continue"))
    return out


def test_runs(spark):
    r = random.Random(6)
    plans, actions = {}, {}
    for q in range(80):
        plans[q] = {f"r{k}": {"weight": float(r.randrange(1, 5)), "mandatory": r.random() < 0.3, "citation_required": r.random() < 0.5, "provenance_required": r.random() < 0.5} for k in range(r.randrange(1, 5))}
        actions[q] = []
        for step in range(r.randrange(1, 14)):
            events = [{"requirement": r.choice([*plans[q], *plans[q], "r9"] if r.random() < 0.1 else [*plans[q]]), "status": r.choice(["satisfied"] * 4 + N.PRECEDENCE), **{f: r.random() < 0.95 for f in ("provenance", "citation", "fresh", "trusted")}, "contradicts": r.random() < 0.03} for _ in range(r.randrange(3))]
            actions[q].append({"step": step, "action": r.choice(["visit"] * 6 + ["reject", "replan", "jump"]), "node": f"n{r.randrange(9)}", "tokens": r.randrange(40), "seconds": r.randrange(10), "events": events, "targets": r.sample([*plans[q], "r9"], r.randrange(2))})
    budgets = {"depth": 6, "nodes": 7, "tokens": 150, "seconds": 40, "replans": 2}
    need = spark.createDataFrame([(q, k, *p.values()) for q, plan in plans.items() for k, p in plan.items()], "query_id int, requirement string, weight double, mandatory boolean, citation_required boolean, provenance_required boolean")
    asked = spark.createDataFrame([(q, a["step"], a["action"], a["node"], a["tokens"], a["seconds"], a["events"], a["targets"]) for q, of in actions.items() for a in of], f"query_id int, step int, action string, node string, tokens int, seconds int, events array<{N.EVENT}>, targets array<string>")
    got, results = {}, set()
    for x in N.run_plans(asked, N.requirement_plan(need), 0.8, budgets).orderBy("query_id", "step").collect():
        got.setdefault(x["query_id"], []).append(tuple(x)[1:])
        results.add(x["result"])
    assert got == {q: brute(actions[q], plans[q], 0.8, budgets) for q in actions}
    assert results >= {"visited", "visited_before", "rejected", "rejected_before", "replanned", "targets", "budget", "stopped", "action", "evidence_unknown"}


def test_plans_with_problems(spark):
    rows = [(1, "a", 1.0, True, True, True), (1, "a", 2.0, True, True, True), (2, "a", 0.0, True, True, True), (3, "a", float("nan"), True, True, True), (4, "a", 1.0, None, True, True), (5, "a", 1.0, True, True, True), (5, "b", 2.0, False, True, False)]
    need = spark.createDataFrame(rows, "query_id int, requirement string, weight double, mandatory boolean, citation_required boolean, provenance_required boolean")
    got = {x["query_id"]: x for x in N.requirement_plan(need).collect()}
    assert {k: x["problem"] for k, x in got.items()} == {1: "requirement_repeated", 2: "requirement", 3: "requirement", 4: "requirement", 5: None}
    assert (got[5]["ids"], got[5]["weights"], got[5]["mandatory"]) == (["a", "b"], [1.0, 2.0], [True, False])
