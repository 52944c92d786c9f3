"""Knowledge answers for batches of prompts: hits become verified evidence, evidence passes gates, and what passes is written out with citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T

# Budgets of a prompt, and what a requirement's state is worth.
NODES, TOKENS, ANSWER_BYTES = 200, 100_000, 32_768
EXTERNAL = ["provenance_present", "citations_present", "freshness_met", "trust_met", "no_hard_contradiction", "deterministic_validation_passed"]


def external_gates(events: DataFrame, group: str) -> DataFrame:
    """The six gates that events decide: all or any over the satisfied events of a group, or over all if none is."""
    good = F.col("status") == "satisfied"
    over = lambda test: F.coalesce(F.bool_and(F.when(good, F.col(test))), F.bool_and(test))
    return events.groupBy(group).agg(over("provenance_present").alias("provenance_present"), over("citation_present").alias("citations_present"), over("freshness_met").alias("freshness_met"), over("trust_met").alias("trust_met"), (~F.bool_or("hard_contradiction")).alias("no_hard_contradiction"), F.lit(True).alias("deterministic_validation_passed"))


def coverage_report(requirements: DataFrame, gates: DataFrame, group: str, target: float, exhausted: Column | None = None) -> DataFrame:
    """Coverage, eight gates, decision of each group.

    requirements: group, id, weight, status, value, mandatory. An answer needs every gate; a hard contradiction, or a mandatory
    requirement that is contradicted or disqualified, refuses; a spent budget gives a partial answer, else there is a new plan.
    """
    share = F.round(F.sum(F.col("weight") * F.col("value")) / F.sum("weight"), 12)
    own = requirements.groupBy(group).agg(share.alias("coverage"), F.bool_and(~F.col("mandatory") | (F.col("status") == "satisfied")).alias("mandatory_requirements_met"), F.bool_or(F.col("mandatory") & F.col("status").isin("contradictory", "disqualified")).alias("hard"))
    rows = own.join(gates, group).withColumn("coverage_target_met", F.col("coverage") >= target)
    every = F.lit(True)
    for g in ["coverage_target_met", "mandatory_requirements_met", *EXTERNAL]:
        every = every & F.col(g)
    decision = F.when(every, "answer").when(F.col("hard") | ~F.col("no_hard_contradiction"), "refuse").when(exhausted if exhausted is not None else F.lit(False), "partial").otherwise("replan")
    return rows.withColumn("decision", decision).drop("hard")


def evidence_id(*parts: Column) -> Column:
    return F.concat(F.lit("evidence-"), F.substring(T.digest(*parts), 8, 32))


def project(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Hits of a search (item_id, rank, entry_id, claim_id, text) as evidence: only those bound to an active entry, in rank order until one satisfies or a budget ends.

    entries: entry_id, fresh, trusted. A prompt whose hits hold claims with and without the word not is contradicted as a whole.
    """
    bound = hits.join(entries, "entry_id")
    negated = F.array_contains(T.words(F.col("text")), "not")
    whole = bound.groupBy("item_id").agg((F.bool_or(negated) & F.bool_or(~negated)).alias("hard_contradiction"))
    rows = bound.join(whole, "item_id").withColumn("tokens", F.greatest(F.lit(1), F.size(T.words(F.col("text")))))
    status = F.when(F.col("hard_contradiction"), "contradictory").when(~F.col("fresh"), "stale").when(~F.col("trusted"), "disqualified").otherwise("satisfied")
    before = Window.partitionBy("item_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("status", status)
    rows = rows.withColumn("met", F.coalesce(F.max((F.col("status") == "satisfied").cast("int")).over(before), F.lit(0))).withColumn("spent", F.coalesce(F.sum("tokens").over(before), F.lit(0)) + F.col("tokens"))
    rows = rows.filter((F.col("met") == 0) & (F.col("spent") <= TOKENS) & (F.col("rank") <= NODES))
    return rows.select("item_id", "rank", "entry_id", "claim_id", "text", evidence_id(F.col("entry_id"), F.col("claim_id"), F.col("text")).alias("evidence_id"), F.concat(F.lit("canonical:"), F.col("entry_id").cast("string"), F.lit("#"), F.col("claim_id").cast("string")).alias("source_ref"), "status", F.lit(True).alias("provenance_present"), F.lit(True).alias("citation_present"), F.col("fresh").alias("freshness_met"), F.col("trusted").alias("trust_met"), "hard_contradiction")


# States of a requirement by falling precedence, and what they are worth.
STATES = ["contradictory", "satisfied", "partial", "stale", "disqualified", "missing"]


def answer(prompts: DataFrame, evidence: DataFrame, target: float = 1.0) -> DataFrame:
    """(item_id, status, reason_code, claims, answer) of every prompt: contradiction, then trust, then freshness and coverage, then the evidence in order."""
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(STATES) for x in (s, k)])[F.col("status")]
    folded = evidence.groupBy("item_id").agg(F.min_by("status", rank).alias("status"))
    requirement = folded.select("item_id", F.lit("query").alias("id"), F.lit(1.0).alias("weight"), "status", F.when(F.col("status") == "satisfied", 1.0).when(F.col("status") == "partial", 0.5).otherwise(0.0).alias("value"), F.lit(True).alias("mandatory"))
    report = coverage_report(requirement, external_gates(evidence, "item_id"), "item_id", target)
    line = F.concat("text", F.lit(" ["), "source_ref", F.lit("]"))
    told = evidence.groupBy("item_id").agg(F.count("*").alias("claims"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    rows = prompts.select("item_id").join(report, "item_id", "left").join(told, "item_id", "left")
    no = F.col("decision").isNull()
    status = F.when(no | ~F.col("no_hard_contradiction") | ~F.col("trust_met"), "refuse").when((F.col("decision") == "replan") | ~F.col("freshness_met"), "partial").when(F.col("decision") == "answer", "answer").when(F.col("decision") == "partial", "partial").otherwise("refuse")
    reason = F.when(no, "coverage_insufficient").when(~F.col("no_hard_contradiction"), "hard_contradiction").when(~F.col("trust_met"), "trust_gate_failed").when(~F.col("freshness_met"), "freshness_gate_failed").when(F.col("decision") == "answer", "none").otherwise("coverage_insufficient")
    shown = F.col("status").isin("answer", "partial") & (F.octet_length("answer") <= ANSWER_BYTES)
    out = rows.withColumn("status", status).withColumn("reason_code", reason)
    return out.select("item_id", "status", "reason_code", F.when(shown, F.col("claims")).otherwise(0).cast("long").alias("claims"), F.when(shown, F.col("answer")).otherwise("").alias("answer"))
