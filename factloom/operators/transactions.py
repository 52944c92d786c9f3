"""Transactions over append-only records: selections and promotions are prepared, authorised, applied, rolled back and recovered as ladders over joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.metrics import reasons

# What an authorisation must share with its proposal, and how long a proposal lives.
BINDINGS = "proposal_digest promotion_id candidate_digest provenance_digest review_head entry_digest inventory_digest generation_id write_set_digest source_head".split()
MINUTES, MOST_EVIDENCE = 5, 32


def prepare_selection(requests: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Proposals of requested evidence ids: request_id, proposal_id, violations, candidate_id, prepared_at, expires_at.

    requests: request_id, evidence_id rows; evidence: evidence_id, kind, restricted, current, role, conflict, source_end, target_end. One to 32 distinct ids, each
    of one record, none restricted, stale, case evidence or in conflict, and the ends of an edge selected with it.
    """
    records = evidence.groupBy("evidence_id").agg(F.count("*").alias("records"), *[F.first(c).alias(c) for c in ("kind", "restricted", "current", "role", "conflict", "source_end", "target_end")])
    rows = requests.join(records, "evidence_id", "left").withColumn("known", F.coalesce("records", F.lit(0)) == 1)
    ids = F.array_sort(F.collect_set("evidence_id"))
    ends = F.array_compact(F.flatten(F.collect_list(F.when(F.col("kind") == "edge", F.array("source_end", "target_end")))))
    own = rows.groupBy("request_id").agg(ids.alias("ids"), F.count("*").alias("asked"), F.bool_and("known").alias("known"), *[F.bool_or(c).alias(n) for n, c in (("restricted", F.col("restricted")), ("stale", ~F.col("current")), ("case", F.col("role") == "case_evidence"), ("conflict", F.col("conflict")))], ends.alias("ends"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    why = reasons({"evidence_count": F.col("asked").between(1, MOST_EVIDENCE) & (F.col("asked") == F.size("ids")), "evidence_unknown": F.col("known"), "restricted": no("restricted"), "stale": no("stale"), "case_evidence": no("case"), "conflict": no("conflict"), "edge_ends": F.size(F.array_except("ends", "ids")) == 0})
    digest = T.digest(F.col("request_id"), F.array_join("ids", ","))
    return own.select("request_id", F.concat(F.lit("proposal-"), F.substring(digest, 8, 24)).alias("proposal_id"), F.concat(F.lit("candidate-"), F.substring(digest, 32, 16)).alias("candidate_id"), why.alias("violations"), now.alias("prepared_at"), (now + F.expr(f"INTERVAL {MINUTES} MINUTES")).alias("expires_at"))


def validate_authorizations(authorizations: DataFrame, proposals: DataFrame, consumed: DataFrame, now: Column, head: Column, retry: bool = False) -> DataFrame:
    """(authorization_id, violations): one-use, in its time, of the right operation, bound to its proposal (that of its proposal digest) by ten digests, and neither its id nor its nonce used.

    With ``retry`` a use that is exactly its own (same id, nonce and proposal, reserved or committed) does not count.
    """
    own = proposals.dropDuplicates(["proposal_digest"]).select(F.col("operation").alias("own_operation"), *[F.col(b).alias(f"own_{b}") for b in BINDINGS])
    bound = authorizations.join(own, F.col("proposal_digest") == F.col("own_proposal_digest"), "left")
    uses = lambda key: consumed.select(F.col(key), F.col("authorization_id" if key == "nonce" else "nonce").alias("other"), F.col("proposal_digest").alias("used_for"), "state")
    exact = lambda other: (F.col("other") == F.col(other)) & (F.col("used_for") == F.col("proposal_digest")) & F.col("state").isin("reserved", "committed")
    spent = []
    for key, other in (("authorization_id", "nonce"), ("nonce", "authorization_id")):
        met = authorizations.select("authorization_id", "nonce", "proposal_digest").join(uses(key), key)
        spent.append(met.filter(~F.coalesce(exact(other), F.lit(False)) if retry else F.lit(True)).select("authorization_id"))
    used = reduce(DataFrame.unionByName, spent).distinct().withColumn("used", F.lit(True))
    rows = bound.join(used, "authorization_id", "left")
    pairs = F.lit(True)
    for b in BINDINGS:
        pairs = pairs & F.col(b).eqNullSafe(F.col(f"own_{b}"))
    why = reasons({"one_use": F.col("one_use_only"), "operation": F.col("operation") == F.col("own_operation"), "future": F.col("issued_at") <= now, "expired": (now < F.col("expires_at")) & (F.col("issued_at") < F.col("expires_at")), "binding": pairs, "source_head": F.col("source_head") == head, "consumed": F.col("used").isNull()})
    return rows.select("authorization_id", why.alias("violations"))


def prepare_promotions(candidates: DataFrame, active: DataFrame) -> DataFrame:
    """(candidate_id, violations): accepted, and neither its id nor its semantic key in an active entry or another candidate."""
    seen = lambda key: active.select(F.col(key)).distinct().withColumn(f"has_{key}", F.lit(True))
    twice = candidates.filter("semantic_key is not null").groupBy("semantic_key").agg((F.count("*") > 1).alias("twice"))
    rows = candidates.join(seen("entry_id"), "entry_id", "left").join(seen("semantic_key"), "semantic_key", "left").join(twice, "semantic_key", "left")
    why = reasons({"not_accepted": F.col("review") == "accepted", "entry_exists": F.col("has_entry_id").isNull(), "semantic_key_exists": F.col("has_semantic_key").isNull(), "semantic_key_repeated": ~F.coalesce("twice", F.lit(False))})
    return rows.select("candidate_id", why.alias("violations"))


def apply_promotions(log: DataFrame, accepted: DataFrame, order: str) -> DataFrame:
    """The next generations (sequence, kind, entry_id, previous) after ``log``: one added entry each, in ``order``, each linked to the one before."""
    last = log.agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("last"))
    placed = accepted.withColumn("step", F.row_number().over(Window.orderBy(order)))  # promotions are serial: one lock, one chain
    rows = placed.join(F.broadcast(last)).withColumn("sequence", F.col("last") + F.col("step"))
    return rows.select("sequence", F.lit("add").alias("kind"), "entry_id", F.nullif(F.col("sequence") - 1, F.lit(0)).alias("previous"))


def rollback_generation(log: DataFrame, target: Column) -> DataFrame:
    """A generation without entries that restores ``target``, where it is in the log and not the latest."""
    last = log.agg(F.max("sequence").alias("last"))
    known = log.filter(F.col("sequence") == target).select(F.col("sequence").alias("restores"))
    return known.join(F.broadcast(last)).filter(F.col("restores") < F.col("last")).select((F.col("last") + 1).alias("sequence"), F.lit("rollback").alias("kind"), F.lit(None).cast("string").alias("entry_id"), "restores")


def recover(intents: DataFrame, transactions: DataFrame, proposals: DataFrame, uses: DataFrame, retained: DataFrame, staging: DataFrame) -> DataFrame:
    """(transaction_id, status, reason) of pending transactions: finished ones are recovered, those whose records are whole resume, all others are investigated.

    intents: transaction_id, promotion_id, intent; transactions: transaction_id; proposals: promotion_id; uses: intent, state, authorization, previous, record; retained:
    authorization; staging: transaction_id, intent.
    """
    count = lambda rows, key, name, cond=None: rows.groupBy(key).agg((F.count("*") if cond is None else F.count_if(cond)).alias(name))
    rows = intents.join(count(transactions, "transaction_id", "done"), "transaction_id", "left").join(count(proposals, "promotion_id", "proposals"), "promotion_id", "left")
    reserved, committed = F.col("state") == "reserved", F.col("state") == "committed"
    use = uses.groupBy("intent").agg(F.count_if(reserved).alias("reserved"), F.count_if(committed).alias("committed"), F.max(F.when(reserved, F.col("record"))).alias("record"), F.max(F.when(committed, F.col("previous"))).alias("previous"), F.max(F.when(reserved, F.col("authorization"))).alias("authorization"))
    rows = rows.join(use, "intent", "left").join(retained.select("authorization").distinct().withColumn("kept", F.lit(True)), "authorization", "left")
    foreign = staging.select("transaction_id", F.col("intent").alias("staged")).join(intents.select("transaction_id", "intent"), "transaction_id").groupBy("transaction_id").agg(F.bool_or(F.col("staged") != F.col("intent")).alias("foreign"))
    rows = rows.join(foreign, "transaction_id", "left").fillna(0, ["done", "proposals", "reserved", "committed"])
    whole = (F.col("reserved") == 1) & (F.col("committed") <= 1) & ((F.col("committed") == 0) | F.col("previous").eqNullSafe(F.col("record")))
    reason = F.when(F.col("done") > 0, "completed_terminal_evidence").when(F.col("proposals") != 1, "proposal_evidence_conflict").when(~whole, "reservation_evidence_conflict").when(F.col("kept").isNull(), "retained_authorization_missing").when(F.coalesce("foreign", F.lit(False)), "staging_ownership_uncertain").otherwise("resumed_exact_transaction")
    return rows.select("transaction_id", F.when(reason.isin("completed_terminal_evidence", "resumed_exact_transaction"), "recovered").otherwise("investigate").alias("status"), reason.alias("reason"))


def recover_runs(bundles: DataFrame, parts: DataFrame, foreign: DataFrame) -> DataFrame:
    """(bundle_id, status) of refresh or acquisition runs: complete with all their parts, to be resumed with some, investigated where foreign records lie among them."""
    have = parts.groupBy("bundle_id").agg(F.count_distinct("part").alias("have"))
    rows = bundles.join(have, "bundle_id", "left").join(foreign.select("bundle_id").distinct().withColumn("foreign", F.lit(True)), "bundle_id", "left")
    return rows.select("bundle_id", F.when(F.col("foreign").isNotNull(), "investigate").when(F.col("have") >= F.col("expected"), "complete").otherwise("resume").alias("status"))


def reconcile(proposed: DataFrame, existing: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, state): created, unchanged (the same content keeps its first time), or conflict."""
    now = existing.groupBy(key).agg(F.min_by(digest, "created_at").alias("held"), F.min("created_at").alias("first_at"))
    rows = proposed.join(now, key, "left")
    return rows.select(key, F.when(F.col("held").isNull(), "created").when(F.col("held") == F.col(digest), "unchanged").otherwise("conflict").alias("state"), F.coalesce("first_at", "created_at").alias("created_at"))


def provenance(results: DataFrame) -> DataFrame:
    """Provenance of candidates: the digests of source, parse, distillation and candidate bound into one."""
    bound = T.digest(F.col("candidate_id"), F.col("source_digest"), F.col("parse_digest"), F.col("distillation_digest"), F.col("origin"))
    return results.select("candidate_id", "source_digest", "parse_digest", "distillation_digest", "origin", bound.alias("provenance_digest"))


def provenance_faults(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(candidate_id, violations) of provenance records that their candidates do not bear out."""
    both = records.join(candidates.select("candidate_id", F.col("source_digest").alias("own_source"), F.lit(True).alias("there")), "candidate_id", "left")
    again = T.digest(F.col("candidate_id"), F.col("source_digest"), F.col("parse_digest"), F.col("distillation_digest"), F.col("origin"))
    why = reasons({"candidate_missing": F.col("there"), "source_differs": F.col("source_digest") == F.col("own_source"), "self_digest": F.col("provenance_digest") == again, "origin": F.col("origin").isin("cli", "batch", "workspace")})
    return both.select("candidate_id", why.alias("violations")).filter("violations <> ''")


# Failures of an item by falling precedence, and the code that each gives.
FAILURES = {"digest_mismatch": "source_digest_mismatch", "missing": "source_missing", "not_contained": "source_invalid", "unreadable": "source_invalid", "parser": "parser_failed", "quality": "quality_gate", "distillation": "distillation_failed", "conflict": "candidate_conflict"}


def error_code(failures: Column) -> Column:
    """The code of the leading failure in an array of failure classes; null without one, parser_failed for an unknown one."""
    known = F.coalesce(*[F.when(F.array_contains(failures, k), F.lit(v)) for k, v in FAILURES.items()])
    return F.when(F.size(failures) > 0, F.coalesce(known, F.lit("parser_failed")))
