"""Graph queries and whole workspace queries for batches of prompts: components are asked, merged, capped and gated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.graph import ROLES, checkpointed, spread

LIMIT, MERGED = 64, 128
# What a role, a conflict or a limit says of an answer; gate texts come before all others.
ROLE_NOTES = {"primary_law": "Primary source predicates require review.", "official_interpretation": "Interpretation does not replace the primary source.", "local_enforcement_guidance": "Source scope requires applicability review.", "technical_guidance": "Technical guidance requires source review."}
CONFLICT, FRESHNESS, UNSUPPORTED = "Conflicting or stale evidence remains unresolved.", "Source freshness requires review.", "The connected public graph does not support this question."
RESTRICTED, SATURATED = "Restricted evidence cannot be rendered.", "Mandatory evidence exceeds the limit."
GATE_NOTES = [RESTRICTED, CONFLICT, FRESHNESS, SATURATED]


def record_digest(prefix: str, *columns: Column) -> Column:
    """Derived identity of a claim, an edge or a question: a prefix and 24 hexadecimal digits of its fields' digest."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(T.digest(*columns), 8, 24))


def evidence_records(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(evidence_id, evidence_kind, source_id, evidence_digest, role) of all claims and edges."""
    own = claims.select(F.col("claim_id").alias("evidence_id"), F.lit("claim").alias("evidence_kind"), "source_id", F.col("digest").alias("evidence_digest"), "role")
    return own.unionByName(edges.select(F.col("edge_id").alias("evidence_id"), F.lit("edge").alias("evidence_kind"), F.lit(None).cast("string").alias("source_id"), F.col("digest").alias("evidence_digest"), F.lit(None).cast("string").alias("role")))


def resolve(ids: DataFrame, claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Records of evidence ids (item_id, evidence_id): a claim, an edge, or a source's claims; each once."""
    records = evidence_records(claims, edges)
    by_source = ids.withColumnRenamed("evidence_id", "source_id").join(records.filter("evidence_kind = 'claim'"), "source_id")
    return ids.join(records, "evidence_id").unionByName(by_source).distinct()


def resolve_one(ids: DataFrame, records: DataFrame, key: str = "evidence_id") -> DataFrame:
    """Each id with its number of records and whether it is just one."""
    found = records.groupBy(key).agg(F.count("*").alias("records"))
    return ids.select(key).distinct().join(found, key, "left").select(key, F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) == 1).alias("resolved"))


def query_graph(prompts: DataFrame, claims: DataFrame, sources: DataFrame, edges: DataFrame, changed: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(outcomes, evidence) of every prompt: (item_id, outcome, roles, qualifications), (item_id, evidence_id).

    claims: claim_id, source_id, role, text; sources: source_id, role, status; edges: edge_id, edge_type, source_kind, source_id, target_kind,
    target_id; changed: source_id of sources whose observation is not unchanged. Conflicts that touch a matching claim or its source come first, with
    stale and changed sources if there are any; more of these than the limit saturate the answer. Two roles answer, one is partial.
    """
    held = spread(claims.select("claim_id", "source_id", "text"), "claim_id").select("claim_id", "source_id", F.explode(T.t2_terms(F.col("text"))).alias("term"))
    asked = prompts.select("item_id", F.explode(T.t2_terms(F.col("text"))).alias("term"))
    match = checkpointed(held.join(asked, "term").groupBy("item_id", "claim_id", "source_id").agg(F.count("*").alias("score")))
    best = match.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "claim_id"))).filter(F.col("n") <= limit).select("item_id", F.col("claim_id").alias("id"))
    touched = match.select("item_id", F.lit("claim").alias("kind"), F.col("claim_id").alias("id")).unionByName(match.select("item_id", F.lit("source").alias("kind"), F.col("source_id").alias("id"))).distinct()
    conflict = edges.filter("edge_type = 'conflicts_with'")
    side = lambda s: conflict.join(touched.withColumnsRenamed({"kind": f"{s}_kind", "id": f"{s}_id"}), [f"{s}_kind", f"{s}_id"]).select("item_id", *conflict.columns)
    conflicts = side("source").unionByName(side("target")).distinct()
    end = lambda s: conflicts.select("item_id", F.when(F.col(f"{s}_kind") == "workflow", F.col("edge_id")).otherwise(F.col(f"{s}_id")).alias("id"))
    clashing = checkpointed(end("source").unionByName(end("target")).distinct())
    chosen = checkpointed(_capped(best, clashing, limit))
    of_claims = claims.select(F.col("claim_id").alias("id"), "source_id")
    of_sources = sources.select(F.col("source_id").alias("id"), "source_id")
    used = chosen.join(of_claims.unionByName(of_sources), "id").select("item_id", "source_id").distinct()
    stale = used.join(sources.filter("status <> 'current'").select("source_id"), "source_id", "left_semi")
    of_edges = edges.select(F.col("edge_id").alias("id"), F.explode(F.array(F.struct(F.col("source_kind").alias("k"), F.col("source_id").alias("e")), F.struct(F.col("target_kind").alias("k"), F.col("target_id").alias("e")))).alias("x"))
    ends = of_edges.filter("x.k = 'source'").select("id", F.col("x.e").alias("source_id")).unionByName(of_edges.filter("x.k = 'claim'").select("id", F.col("x.e").alias("claim_id")).join(claims.select("claim_id", "source_id"), "claim_id").select("id", "source_id"))
    related = chosen.join(of_claims.unionByName(of_sources).unionByName(ends), "id").select("item_id", "source_id").unionByName(match.select("item_id", "source_id")).distinct()
    moved = related.join(changed.select("source_id").distinct(), "source_id", "left_semi")
    flags = prompts.select("item_id").distinct()
    for name, rows in (("conflict", clashing), ("stale", stale), ("changed", moved)):
        flags = flags.join(rows.groupBy("item_id").agg(F.lit(True).alias(name)), "item_id", "left")
    flags = checkpointed(flags.fillna(False, ["conflict", "stale", "changed"]))
    must = clashing.unionByName(stale.select("item_id", F.col("source_id").alias("id"))).unionByName(moved.select("item_id", F.col("source_id").alias("id"))).distinct()
    evidence = checkpointed(_capped(chosen, must, limit))
    count = must.groupBy("item_id").agg(F.count("*").alias("must"))
    roles = evidence.join(claims.select(F.col("claim_id").alias("id"), "role", "source_id"), "id").select("item_id", "role", "source_id")
    direct = evidence.join(sources.select(F.col("source_id").alias("id"), "role"), "id").select("item_id", "role")
    every = roles.select("item_id", "role").unionByName(direct).unionByName(roles.select("item_id", "source_id").join(sources.select("source_id", "role"), "source_id").select("item_id", "role"))
    held_roles = every.groupBy("item_id").agg(F.collect_set("role").alias("have"))
    some = evidence.groupBy("item_id").agg(F.count("*").alias("n"))
    rows = flags.join(held_roles, "item_id", "left").join(some, "item_id", "left").join(count, "item_id", "left").fillna(0, ["n", "must"])
    own = F.filter(F.array(*[F.lit(r) for r in ROLES]), lambda r: F.coalesce(F.array_contains("have", r), F.lit(False)))
    gate = F.col("conflict") | F.col("stale") | F.col("changed")
    outcome = F.when(gate, "investigate").when(F.col("n") == 0, "refuse").when(F.size("roles") >= 2, "answer").otherwise("partial")
    notes = [F.when(F.array_contains("roles", r), F.lit(text)) for r, text in ROLE_NOTES.items()]
    notes += [F.when(F.col("conflict") | F.col("stale"), F.lit(CONFLICT)), F.when(F.col("changed"), F.lit(FRESHNESS)), F.when(F.col("must") > limit, F.lit(SATURATED))]
    said = F.when((F.col("n") == 0) & ~gate, F.array(F.lit(UNSUPPORTED))).otherwise(F.array_sort(F.array_compact(F.array(*notes))))
    out = rows.withColumn("roles", own).withColumn("outcome", outcome).withColumn("qualifications", said)
    return out.select("item_id", "outcome", "roles", "qualifications"), evidence.select("item_id", F.col("id").alias("evidence_id"))


def _capped(rows: DataFrame, first: DataFrame, limit: int) -> DataFrame:
    """(item_id, id): ``first`` by id, then ``rows`` by id, up to the limit; each once."""
    both = first.select("item_id", "id", F.lit(0).alias("k")).unionByName(rows.select("item_id", "id", F.lit(1).alias("k"))).groupBy("item_id", "id").agg(F.min("k").alias("k"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy("k", "id"))).filter(F.col("n") <= limit).select("item_id", "id")


ORIGIN = ["workspace_id", "evidence_kind", "evidence_id", "evidence_digest"]


def merge(prompts: DataFrame, components: DataFrame, origins: DataFrame, pairs: DataFrame, graph_only: bool = False, cap: int = MERGED) -> tuple[DataFrame, DataFrame]:
    """(outcomes, evidence) of whole workspace queries over the components' results.

    components: item_id, workspace_id, outcome, restricted, fallback, qualifications; origins: item_id and ORIGIN; pairs of conflicting
    evidence: left_id, right_id. What a component investigates and conflicting pairs are mandatory; the rest fills up to ``cap``. With
    ``graph_only`` a cut does not make an answer partial and one answering component answers. A restricted component refuses; too much mandatory
    evidence, or any component or conflict to investigate, investigates.
    """
    kinds = components.select("item_id", "workspace_id", (F.col("outcome") == "investigate").alias("must"))
    both = origins.join(kinds, ["item_id", "workspace_id"]).groupBy("item_id", *ORIGIN).agg(F.bool_or("must").alias("must"))
    selected = both.filter(F.col("evidence_kind").isin("claim", "graph_claim")).select("item_id", "evidence_id").distinct()
    hit = pairs.join(selected.withColumnRenamed("evidence_id", "left_id"), "left_id").join(selected.withColumnRenamed("evidence_id", "right_id"), ["item_id", "right_id"])
    clashing = hit.select("item_id", F.explode(F.array("left_id", "right_id")).alias("evidence_id")).distinct().withColumn("clash", F.lit(True))
    rows = both.join(clashing, ["item_id", "evidence_id"], "left").withColumn("must", F.col("must") | F.coalesce("clash", F.lit(False)))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("item_id").orderBy((~F.col("must")).cast("int"), *ORIGIN)))
    sizes = ranked.groupBy("item_id").agg(F.count_if("must").alias("must"), F.count("*").alias("all"), F.coalesce(F.bool_or("clash"), F.lit(False)).alias("clash"))
    has = lambda o: F.bool_or(F.col("outcome") == o).alias(f"any_{o}")
    parts = components.groupBy("item_id").agg(F.bool_or("restricted").alias("restricted"), F.bool_or("fallback").alias("fallback"), *[has(o) for o in ("answer", "partial", "investigate")], F.array_distinct(F.flatten(F.collect_list("qualifications"))).alias("said"))
    rows = prompts.select("item_id").distinct().join(parts, "item_id", "left").join(sizes, "item_id", "left").fillna(False).fillna(0)
    saturated = F.col("must") > cap
    gate = F.when(F.col("restricted"), "refuse").when(saturated | F.col("any_investigate") | F.col("clash"), "investigate")
    if graph_only:
        outcome = gate.when(F.col("any_answer"), "answer").when(F.col("any_partial"), "partial").otherwise("refuse")
    else:
        outcome = gate.when(F.col("must") > 0, "investigate").when(F.col("all") == 0, "refuse").when(F.col("fallback") | (F.col("all") > cap) | F.col("any_partial"), "partial").otherwise("answer")
    noted = F.array_compact(F.array(F.when(F.col("restricted"), F.lit(RESTRICTED)), F.when(F.col("clash"), F.lit(CONFLICT)), F.when(saturated & ~F.col("restricted"), F.lit(SATURATED))))
    rows = rows.withColumn("outcome", outcome).withColumn("qualifications", ordered_notes(F.array_union(F.coalesce("said", F.array().cast("array<string>")), noted)))
    shown = ranked.filter(F.col("n") <= cap).join(rows.select("item_id", "outcome", saturated.alias("saturated")), "item_id").filter("outcome <> 'refuse' and not saturated")
    return rows.select("item_id", "outcome", "qualifications"), shown.select("item_id", *ORIGIN)


def ordered_notes(notes: Column) -> Column:
    """Gate texts first in their order, then the others sorted; 16 at most."""
    first = F.filter(F.array(*[F.lit(n) for n in GATE_NOTES]), lambda n: F.array_contains(notes, n))
    return F.slice(F.concat(first, F.array_sort(F.array_except(F.array_distinct(notes), first))), 1, 16)
