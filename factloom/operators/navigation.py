"""Planning: the sequential navigator over each query's own visits, and runs of plans as folds over the visits that may be made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import checkpointed, spread

# What a requirement's state is worth, by falling precedence of states.
PRECEDENCE = ["contradictory", "satisfied", "partial", "stale", "disqualified", "missing"]
WORTH = {"satisfied": 1.0, "partial": 0.5, "contradictory": 0.0, "stale": 0.0, "disqualified": 0.0, "missing": 0.0}


def navigate(visits: DataFrame, requirements: DataFrame, target: float, nodes: int, tokens: int) -> DataFrame:
    """(query_id, step, node, coverage, gain, stopped): visits in order until coverage reaches the target or a budget ends.

    visits: query_id, step, node, requirement, status, tokens; requirements: query_id, requirement, weight. A step's node and
    tokens are those of its first requirement. A requirement's state is the leading one so far, so what a step adds to the
    coverage is what its requirements rise or fall by, and the walk is running sums in windows that all lie by query_id.
    """
    first = visits.filter(F.col("step") <= nodes)  # a budget of nodes is a bound on the walk
    listed = requirements.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("requirement", "weight"))).alias("weights"))
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(PRECEDENCE) for x in (s, k)])
    worth = lambda k: F.element_at(F.array(*[F.lit(WORTH[s]) for s in PRECEDENCE]), k + 1)
    head = F.struct(F.col("requirement").isNull().alias("last"), "requirement", "tokens", "node")
    each = first.groupBy("query_id", "step", "requirement").agg(F.min(rank[F.col("status")]).alias("rank"), F.min(head).alias("head"))
    own = Window.partitionBy("query_id", "requirement").orderBy("step")
    each = each.withColumn("rank", F.min("rank").over(own)).withColumn("before", F.lag("rank").over(own))
    rise = F.coalesce(worth(F.col("rank")), F.lit(0.0)) - F.coalesce(worth(F.col("before")), F.lit(0.0))
    whole = F.aggregate(F.map_values("weights"), F.lit(0.0), lambda a, w: a + w)
    each = each.join(listed, "query_id").withColumn("whole", whole).withColumn("rise", rise * F.coalesce(F.try_element_at("weights", F.col("requirement")), F.lit(0.0)))
    steps = each.groupBy("query_id", "step").agg(F.sum("rise").alias("rise"), F.first("whole").alias("whole"), F.min("head").alias("head"))
    place = Window.partitionBy("query_id").orderBy("step")
    steps = steps.withColumns({"spent": F.sum("head.tokens").over(place), "covered": F.sum("rise").over(place)})
    now = F.when(F.col("whole") != 0, F.round(F.col("covered") / F.col("whole"), 12)).otherwise(0.0)
    steps = steps.withColumns({"most": F.max("spent").over(place), "coverage": now}).withColumn("stopped", F.col("coverage") >= target)
    over = F.max("stopped").over(place.rowsBetween(Window.unboundedPreceding, -1))
    steps = steps.withColumns({"gain": F.round(F.col("coverage") - F.lag("coverage", 1, 0.0).over(place), 12), "over": F.coalesce(over, F.lit(False))})
    kept = steps.filter((F.col("most") <= tokens) & ~F.col("over"))
    return kept.select("query_id", F.col("step").cast("int").alias("step"), F.col("head.node").alias("node"), "coverage", "gain", "stopped")


def efficiency(trace: DataFrame) -> DataFrame:
    """Nodes visited, last coverage, and coverage for each node of every query."""
    last = F.max_by("coverage", "step")
    return trace.groupBy("query_id").agg(F.count("*").alias("nodes"), last.alias("coverage"), F.round(last / F.count("*"), 6).alias("yield_per_node"))


EVENT = "struct<requirement:string,status:string,provenance:boolean,citation:boolean,fresh:boolean,trusted:boolean,contradicts:boolean>"
BUDGETS = ("depth", "nodes", "tokens", "seconds", "replans")


def requirement_plan(requirements: DataFrame) -> DataFrame:
    """query_id, ids, weights, mandatory, citation, provenance (arrays in order of the ids), problem: the initial plan of each query.

    requirements: query_id, requirement, weight, mandatory, citation_required, provenance_required. A repeated id, a weight that is
    not positive and finite, or a null flag are problems.
    """
    row = F.struct("requirement", "weight", "mandatory", "citation_required", "provenance_required")
    sound = (F.col("weight") > 0) & ~F.isnan("weight") & (F.col("weight") < float("inf")) & F.col("mandatory").isNotNull() & F.col("citation_required").isNotNull() & F.col("provenance_required").isNotNull() & (F.length("requirement") > 0)
    plan = requirements.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), (F.count_distinct("requirement") == F.count("*")).alias("distinct"))
    field = lambda name: F.transform("rows", lambda r: r[name])
    problem = F.when(~F.col("distinct"), "requirement_repeated").when(~F.col("sound"), "requirement")
    return plan.select("query_id", field("requirement").alias("ids"), field("weight").cast("array<double>").alias("weights"), field("mandatory").alias("mandatory"), field("citation_required").alias("citation"), field("provenance_required").alias("provenance"), problem.alias("problem"))


def run_plans(actions: DataFrame, plans: DataFrame, target: float, budgets: dict[str, int]) -> DataFrame:
    """(query_id, step, action, node, result, coverage, gain, version, decision): every query's actions in order, against its plan.

    actions: query_id, step, action (visit, reject, replan), node, tokens, seconds, events (array of EVENT), targets (array of requirements; of a replan).
    A visit spends depth, a node, tokens and seconds and folds its events into the states of requirements; a rejected branch cannot be
    visited, a visited one not rejected; a replan spends a replan, must name requirements that are not satisfied, and adds a version of the
    plan, without forgetting anything. An action that its budgets or rules forbid changes nothing; ``result`` says why. The run ends
    with the decision ``answer``: enough coverage, every mandatory requirement satisfied, and all gates open for the evidence of satisfied
    and partial requirements (of all, if there are none); ``exhausted`` says that a budget is.

    Only a visit that is made changes what others meet, so the fold of a query, in expressions, takes the visits that may still be made:
    not behind a rejection of their branch, nor behind a visit of it that needs no more. It keeps what each visit leaves behind, no more
    entries than the budgets allow; every action then looks up the state that it met, and replans are counted. So no state grows with the actions.
    """
    missing = len(PRECEDENCE) - 1
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(PRECEDENCE) for x in (s, k)])
    worth = F.array(*[F.lit(WORTH[s]) for s in PRECEDENCE])
    sound = plans.filter("problem is null")
    asks = ["step", "action", "node", "tokens", "seconds", "events", "targets"]
    run, branch = Window.partitionBy("query_id"), Window.partitionBy("query_id", "node")
    own = actions.select("query_id", *asks).withColumn("at", F.row_number().over(run.orderBy(*asks))).join(sound.select("query_id", "ids"), "query_id")
    known = F.forall("events", lambda e: F.array_contains("ids", e["requirement"]) & rank[e["status"]].isNotNull())
    odd = (F.col("action") == "visit") & F.coalesce((F.col("tokens") < 0) | (F.col("seconds") < 0), F.lit(True))
    own = own.withColumns({"known": F.coalesce(known, F.lit(True)), "odd": F.max(odd).over(run)}).withColumn("tries", (F.col("action") == "visit") & F.col("known"))
    own = own.withColumn("refused", F.min(F.when(F.coalesce(F.col("action") == "reject", F.lit(True)) & F.col("node").isNotNull(), F.col("at"))).over(branch))
    before = Window.partitionBy("query_id", "node", "seconds").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("tries"), F.col("tokens"))).over(before)
    new = F.coalesce(F.col("at") < F.col("refused"), F.lit(True)) & (F.col("odd") | F.col("node").isNull() | least.isNull() | (F.col("tokens") < least))
    own = checkpointed(own.withColumn("least", least).withColumn("tries", F.coalesce(F.col("tries") & new, F.lit(False))).drop("odd", "least"))
    every = lambda value: F.transform("ids", lambda _: F.lit(value))
    listed = own.filter("tries").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "node", "tokens", "seconds", "events"))).alias("visits"))
    listed = spread(listed, "query_id").join(sound, "query_id")
    gates = ("g_provenance", "g_citation", "g_fresh", "g_trusted")
    left = [F.lit(budgets[b]).cast("long").alias(b) for b in BUDGETS[:4]]
    shape = "struct<at:int,node:string,depth:bigint,nodes:bigint,tokens:bigint,seconds:bigint,ranks:array<int>,coverage:double,gain:double,stopped:boolean,decision:string>"
    state = F.struct(F.array().cast("array<string>").alias("visited"), *left, every(missing).alias("ranks"), every(False).alias("seen"), *[every(True).alias(g) for g in gates], F.lit(0.0).alias("coverage"), F.lit(False).alias("stopped"), F.array().cast(f"array<{shape}>").alias("out"))

    def let(value: Column, body) -> Column:
        return F.transform(F.array(value), body)[0]

    def of(now: Column, **change: Column) -> Column:
        names = ["visited", *BUDGETS[:4], "ranks", "seen", *gates, "coverage", "stopped", "out"]
        return F.struct(*[(change[n] if n in change else now[n]).alias(n) for n in names])

    def decision(now: Column) -> Column:
        spent = F.exists(F.array(*[now[b] for b in BUDGETS[:4]]), lambda left: left <= 0)
        return F.when(now["stopped"], "answer").when(spent, "exhausted").otherwise("continue")

    def noted(now: Column, x: Column, gain: Column) -> Column:
        entry = F.struct(x["at"].alias("at"), x["node"].alias("node"), *[now[n].alias(n) for n in (*BUDGETS[:4], "ranks", "coverage")], gain.alias("gain"), now["stopped"].alias("stopped"), decision(now).alias("decision"))
        return of(now, out=F.array_append(now["out"], entry.cast(shape)))

    def visit(now: Column, x: Column) -> Column:
        mine = lambda i: F.filter(x["events"], lambda e: e["requirement"] == F.col("ids")[i])
        best = lambda events: F.array_min(F.transform(events, lambda e: F.when(e["contradicts"], 0).otherwise(rank[e["status"]])))
        both = lambda gate, field: F.transform(now[gate], lambda ok, i: ok & F.forall(mine(i), lambda e: e[field]))
        after = of(now, visited=F.array_append(now["visited"], x["node"]), depth=now["depth"] - 1, nodes=now["nodes"] - 1, tokens=now["tokens"] - x["tokens"], seconds=now["seconds"] - x["seconds"], ranks=F.transform(now["ranks"], lambda r, i: F.least(r, F.coalesce(best(mine(i)), r))), seen=F.transform(now["seen"], lambda s, i: s | (F.size(mine(i)) > 0)), g_provenance=both("g_provenance", "provenance"), g_citation=both("g_citation", "citation"), g_fresh=both("g_fresh", "fresh"), g_trusted=both("g_trusted", "trusted"))

        def judged(s: Column) -> Column:
            total = F.aggregate("weights", F.lit(0.0), lambda a, w: a + w)
            found = F.aggregate(F.zip_with("weights", s["ranks"], lambda w, r: w * worth[r]), F.lit(0.0), lambda a, w: a + w)
            relevant = F.transform(s["ranks"], lambda r: r.isin(1, 2))
            counted = F.when(F.exists(relevant, lambda r: r), relevant).otherwise(s["seen"])
            gate = lambda name, needed=None: F.forall(F.transform(s[name], lambda ok, i: ok | ~counted[i] | (~F.col(needed)[i] if needed else F.lit(False))), lambda ok: ok)
            open_ = gate("g_provenance", "provenance") & gate("g_citation", "citation") & gate("g_fresh") & gate("g_trusted") & ~F.exists(s["ranks"], lambda r: r == 0)
            met = F.forall(F.zip_with("mandatory", s["ranks"], lambda m, r: ~m | (r == 1)), lambda ok: ok)
            return let(F.round(found / total, 12), lambda share: of(s, coverage=share, stopped=(share >= target) & met & open_))

        return let(let(after, judged), lambda s: noted(s, x, F.round(s["coverage"] - now["coverage"], 12)))

    def spent(now: Column, x) -> Column:
        return F.coalesce((now["depth"] <= 0) | (now["nodes"] <= 0) | (x["tokens"] > now["tokens"]) | (x["seconds"] > now["seconds"]), F.lit(False))

    def step(now: Column, x: Column) -> Column:
        return F.when(now["stopped"] | F.coalesce(F.array_contains(now["visited"], x["node"]), F.lit(False)) | spent(now, x), now).otherwise(visit(now, x))

    made = checkpointed(listed.select("query_id", F.aggregate("visits", state, step, lambda s: s["out"]).alias("made")))
    fresh = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("node"), *left, every(missing).alias("ranks"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("gain"), F.lit(False).alias("stopped"), F.lit("exhausted" if min(budgets[b] for b in BUDGETS[:4]) <= 0 else "continue").alias("decision")).cast(shape)
    met = own.drop("events").join(made, "query_id", "left").withColumn("made", F.coalesce("made", F.array().cast(f"array<{shape}>")))
    met = met.withColumn("past", F.filter("made", lambda e: e["at"] < F.col("at"))).withColumn("now", F.coalesce(F.try_element_at("past", F.lit(-1)), fresh))
    met = met.withColumn("done", F.try_element_at(F.filter("made", lambda e: e["at"] == F.col("at")), F.lit(1))).withColumn("again", F.exists("past", lambda e: F.coalesce(e["node"] == F.col("node"), F.lit(False))))
    now, action = F.col("now"), F.col("action")
    settled = F.transform(F.filter(F.zip_with("ids", now["ranks"], lambda k, r: F.struct(k.alias("k"), r.alias("r"))), lambda p: p["r"] == 1), lambda p: p["k"])
    aimless = F.coalesce((F.size("targets") == 0) | (F.size(F.array_except("targets", F.array_except("ids", settled))) > 0), F.lit(False))
    met = met.withColumn("plans", F.coalesce((action == "replan") & ~now["stopped"] & ~aimless, F.lit(False))).drop("made", "past")
    tried, most = F.sum(F.col("plans").cast("int")).over(run.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)), max(budgets["replans"], 0)
    met = met.withColumn("tried", tried)
    visiting = F.when(F.col("done").isNotNull(), "visited").when(F.col("again"), "visited_before").when(F.col("refused") < F.col("at"), "rejected_before").when(spent(now, {c: F.col(c) for c in ("tokens", "seconds")}), "budget").otherwise("evidence_unknown")
    planning = F.when(F.col("tried") - F.col("plans").cast("int") >= most, "budget").when(F.col("plans"), "replanned").otherwise("targets")
    result = F.when(now["stopped"], "stopped").when(action == "visit", visiting).when(action == "replan", planning).when((action == "reject") & F.col("again"), "visited_before").when(~action.isin("visit", "replan", "reject"), "action").otherwise("rejected")
    after = F.coalesce("done", "now")
    return met.select("query_id", F.col("step").cast("int").alias("step"), "action", "node", result.alias("result"), after["coverage"].alias("coverage"), F.coalesce(F.col("done.gain"), F.lit(0.0)).alias("gain"), (F.least(F.col("tried").cast("int"), F.lit(most)) + 1).alias("version"), after["decision"].alias("decision"))
