"""The contracts of single records. Every one comes with a record that keeps it and changes that break it by one known reason."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.contracts.rules import DIGEST, HEAD, REFERENCE, among, contract, day, digest, distinct, each, ident, ids, instant, locator, many, media, no_authority, optional, span, text

D, E = f"'sha256:{'a' * 64}'", f"'sha256:{'b' * 64}'"
NONE = "cast(null as string)"
# Classes of freshness and the reason that each must give; reasons of an answer; the gates of coverage; codes of failed items.
CLASSES = {"unchanged": "content_unchanged", "updated": "content_changed", "superseded": "declared_successor_verified", "unavailable": "terminal_unavailable"}
ANSWER_REASONS = "none no_answerable_entries legacy_metadata_only coverage_insufficient hard_contradiction freshness_gate_failed trust_gate_failed canonical_state_invalid unsupported_active_version snapshot_drift".split()
GATES = "coverage_target_met mandatory_requirements_met provenance_present citations_present freshness_met trust_met no_hard_contradiction deterministic_validation_passed".split()
BLOCK_TYPES = "heading paragraph list table code image caption footnote link".split()
LEVELS = ["public", "internal", "restricted"]

T1, T2 = "'2024-01-01T00:00:00Z'", "'2024-01-01T00:05:00Z'"


def _is(value: str):
    return lambda x: x == value


def _field(name: str):
    return lambda x: x[name]


# Knowledge


@contract("knowledge", {"claims": "array(named_struct('claim_id', 'c1', 'text', 'a claim', 'source_block_ids', array('b1'), 'citation_id', 'q1'))"}, ({"claims": "array(named_struct('claim_id', 'C 1', 'text', 'a claim', 'source_block_ids', array('b1'), 'citation_id', 'q1'))"}, "claim_identity"), ({"claims": "array(named_struct('claim_id', 'c1', 'text', repeat('x', 1025), 'source_block_ids', array('b1'), 'citation_id', 'q1'))"}, "claim_text"), ({"claims": "array(named_struct('claim_id', 'c1', 'text', 'a', 'source_block_ids', array('b1'), 'citation_id', 'q1'), named_struct('claim_id', 'c1', 'text', 'b', 'source_block_ids', array('b2'), 'citation_id', 'q2'))"}, "claim_repeated"), ({"claims": "array(named_struct('claim_id', 'c1', 'text', 'a', 'source_block_ids', array('b1', 'b1'), 'citation_id', 'q1'))"}, "claim_blocks"))
def claims():
    return {"claim_count": many("claims", 0, 5000), "claim_identity": each("claims", lambda x: ident(x["claim_id"]) & ident(x["citation_id"])), "claim_text": each("claims", lambda x: text(x["text"], 1024)), "claim_blocks": each("claims", lambda x: ids(x["source_block_ids"], 1)), "claim_repeated": distinct("claims", lambda x: x["claim_id"])}


@contract("knowledge", {"citations": "array(named_struct('citation_id', 'q1', 'render_text', 'shown', 'source_block_ids', array('b1')))"}, ({"citations": "array(named_struct('citation_id', 'q1', 'render_text', repeat('x', 513), 'source_block_ids', array('b1')))"}, "citation_text"), ({"citations": "array(named_struct('citation_id', '', 'render_text', 'x', 'source_block_ids', array('b1')))"}, "citation_identity"), ({"citations": "array(named_struct('citation_id', 'q1', 'render_text', 'x', 'source_block_ids', array('b1')), named_struct('citation_id', 'q1', 'render_text', 'y', 'source_block_ids', array('b1')))"}, "citation_repeated"))
def citations():
    return {"citation_count": many("citations", 0, 5000), "citation_identity": each("citations", lambda x: ident(x["citation_id"])), "citation_text": each("citations", lambda x: text(x["render_text"], 512)), "citation_blocks": each("citations", lambda x: ids(x["source_block_ids"], 1)), "citation_repeated": distinct("citations", lambda x: x["citation_id"])}


@contract("knowledge", {"claims": "array(named_struct('citation_id', 'q1', 'source_block_ids', array('b1', 'b2')))", "citations": "array(named_struct('citation_id', 'q1', 'source_block_ids', array('b1', 'b2')))"}, ({"claims": "array(named_struct('citation_id', 'q2', 'source_block_ids', array('b1', 'b2')))"}, "citation_missing,anchors_differ"), ({"claims": "array(named_struct('citation_id', 'q1', 'source_block_ids', array('b2', 'b1')))"}, "anchors_differ"))
def claim_citation_anchors():
    cited = lambda x, more: F.exists("citations", lambda y: (y["citation_id"] == x["citation_id"]) & more(y))
    return {"citation_missing": each("claims", lambda x: cited(x, lambda y: F.lit(True))), "anchors_differ": each("claims", lambda x: cited(x, lambda y: y["source_block_ids"] == x["source_block_ids"]))}


@contract("knowledge", {"concepts": "array(named_struct('candidate_concept_id', 'k1', 'title', 'T', 'source_block_ids', array('b1'), 'status', 'proposed'))", "claim_mappings": "array(named_struct('claim_id', 'c1', 'block_ids', array('b1')))", "links": "array(named_struct('source_block_id', 'b1', 'label', '', 'target', 'x', 'status', 'proposed'))"}, ({"concepts": "array(named_struct('candidate_concept_id', 'k1', 'title', 'T', 'source_block_ids', array('b1'), 'status', 'accepted'))"}, "concept"), ({"claim_mappings": "array(named_struct('claim_id', 'c1', 'block_ids', array('b1')), named_struct('claim_id', 'c1', 'block_ids', array('b2')))"}, "mapping_repeated"), ({"links": "array(named_struct('source_block_id', 'b1', 'label', repeat('l', 257), 'target', 'x', 'status', 'proposed'))"}, "link"))
def semantic_arrays():
    return {"sizes": many("concepts", 0, 10_000) & many("claim_mappings", 0, 10_000) & many("links", 0, 10_000), "concept": each("concepts", lambda x: ident(x["candidate_concept_id"]) & text(x["title"], 256) & ids(x["source_block_ids"]) & (x["status"] == "proposed")), "mapping": each("claim_mappings", lambda x: ident(x["claim_id"]) & ids(x["block_ids"])), "mapping_repeated": distinct("claim_mappings", lambda x: x["claim_id"]), "link": each("links", lambda x: ident(x["source_block_id"]) & text(x["label"], 256, 0) & text(x["target"], 256, 0) & (x["status"] == "proposed"))}


_HIT = "named_struct('classification', 'answerable', 'evidence_id', concat('evidence-', repeat('0', 32)), 'canonical_entry_id', 'e1', 'claim_id', 'c1', 'citation_id', 'q1', 'claim_text', 'a claim', 'citation', 'shown', 'source_ref', 'canonical:e1#q1', 'hits', 3, 'concept_id', cast(null as string), 'concept_title', cast(null as string))"


def _hit(**change: str) -> str:
    out = _HIT
    for name, value in change.items():
        at = out.index(f"'{name}', ") + len(name) + 4
        depth, end = 0, at
        while depth or out[end] not in ",)":
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = out[:at] + value + out[end:]
    return f"array({out})"


@contract("knowledge", {"version": "'v0.2'", "status": "'completed'", "snapshot_digest": D, "query_digest": E, "legacy_count": "0", "answerable_count": "3", "newest_count": "1", "hits": _hit()}, ({"status": "'failed'"}, "status"), ({"version": "'v0.3'"}, "status"), ({"snapshot_digest": "'sha256:x'"}, "digests"), ({"legacy_count": "10001"}, "counts"), ({"newest_count": "0"}, "newest_count"), ({"hits": _hit(source_ref="'canonical:e1#q2'")}, "answerable_hit"), ({"hits": _hit(hits="257")}, "answerable_hit"), ({"hits": _hit(evidence_id="'evidence-1'")}, "answerable_hit"), ({"hits": _hit(classification="'other'")}, "hit_kind"), ({"hits": _hit(classification="'metadata_only'")}, "metadata_hit"), ({"hits": _hit(classification="'metadata_only'", concept_id="'k1'", concept_title="'T'")}, ""))
def search_readback():
    answerable = lambda x: x["evidence_id"].rlike("^evidence-[0-9a-f]{32}$") & ident(x["canonical_entry_id"]) & ident(x["claim_id"]) & ident(x["citation_id"]) & text(x["claim_text"], 1024) & text(x["citation"], 512) & (x["source_ref"] == F.concat(F.lit("canonical:"), x["canonical_entry_id"], F.lit("#"), x["citation_id"])) & x["hits"].between(0, 256)
    metadata = lambda x: ident(x["canonical_entry_id"]) & ident(x["concept_id"]) & text(x["concept_title"], 256)
    return {"status": among("version", "v0.1", "v0.2") & (F.col("status") == "completed"), "digests": digest("snapshot_digest") & digest("query_digest"), "counts": F.col("legacy_count").between(0, 10_000) & F.col("answerable_count").between(0, 10_000), "newest_count": (F.col("version") != "v0.2") | F.col("newest_count").between(1, 10_000), "hit_count": many("hits", 0, 200), "hit_kind": each("hits", lambda x: x["classification"].isin("answerable", "metadata_only")), "answerable_hit": each("hits", lambda x: (x["classification"] != "answerable") | answerable(x)), "metadata_hit": each("hits", lambda x: (x["classification"] != "metadata_only") | metadata(x))}


@contract("knowledge", {"version": "'v0.1'", "status": "'answer'", "snapshot_digest": D, "coverage_report_digest": E, "claim_ids": "array('c1')", "evidence_ids": "array(concat('evidence-', repeat('0', 32)))", "citations": "array('canonical:e1#q1')", "legacy_count": "0", "answer": "'It is so.'", "reason_code": "'none'"}, ({"status": "'maybe'"}, "status"), ({"reason_code": "'coverage_insufficient'"}, "answer_reason"), ({"reason_code": "'other'"}, "reason,answer_reason"), ({"status": "'refuse'", "reason_code": "'trust_gate_failed'"}, "claims_without_answer"), ({"claim_ids": "array('')"}, "claim_ids"), ({"citations": "cast(array() as array<string>)"}, "answer_without_evidence"), ({"citations": "array('canonical:e1#q1', 'canonical:e1#q1')"}, "citations"), ({"answer": "repeat('é', 20000)"}, "answer_bytes"), ({"status": "'partial'", "reason_code": "'coverage_insufficient'"}, ""))
def answer_readback():
    found = (F.size("claim_ids") > 0) & (F.size("evidence_ids") > 0) & (F.size("citations") > 0) & (F.length("answer") > 0)
    some = (F.size("claim_ids") > 0) | (F.size("evidence_ids") > 0) | (F.size("citations") > 0) | (F.length("answer") > 0)
    return {"version": among("version", "v0.1", "v0.2"), "status": among("status", "answer", "partial", "refuse", "investigate"), "digests": digest("snapshot_digest") & digest("coverage_report_digest"), "claim_ids": ids("claim_ids", 0, 200), "evidence_ids": many("evidence_ids", 0, 200) & distinct("evidence_ids") & each("evidence_ids", lambda x: x.rlike("^evidence-[0-9a-f]{32}$")), "citations": many("citations", 0, 200) & distinct("citations") & each("citations", lambda x: (F.length(x) <= 512) & x.rlike(REFERENCE)), "counts": F.col("legacy_count").between(0, 10_000), "answer_bytes": F.octet_length("answer") <= 32_768, "reason": among("reason_code", *ANSWER_REASONS), "answer_reason": (F.col("status") != "answer") | (F.col("reason_code") == "none"), "claims_without_answer": ~among("status", "refuse", "investigate") | ~some, "answer_without_evidence": ~among("status", "answer", "partial") | found}


@contract("knowledge", {"evidence_id": "'e1'", "requirement_ids": "array('r1')", "claim_ids": "array('c1')", "source_ref": "'canonical:e1#q1'", "source_digest": D, "citation": "'shown'", "provenance": "map('entry', 'e1')", "freshness_met": "true", "trust_met": "true", "verified": "true"}, ({"verified": "false"}, "verified"), ({"citation": "''"}, "citation"), ({"requirement_ids": "cast(array() as array<string>)"}, "requirements"), ({"provenance": "cast(map() as map<string,string>)"}, "provenance"), ({"source_digest": "'sha256:12'"}, "source_digest"), ({"trust_met": "cast(null as boolean)"}, "flags"), ({"claim_ids": "array('c1', 'c1')"}, "claims"))
def ledger_entry():
    return {"identity": F.length("evidence_id") > 0, "requirements": many("requirement_ids", 1, 10_000) & each("requirement_ids", lambda x: F.length(x) > 0), "claims": many("claim_ids", 1, 10_000) & distinct("claim_ids"), "source_ref": F.length("source_ref") > 0, "source_digest": F.col("source_digest").rlike(DIGEST), "citation": F.length("citation") > 0, "provenance": F.size("provenance") > 0, "flags": F.col("freshness_met").isNotNull() & F.col("trust_met").isNotNull(), "verified": F.col("verified")}


@contract("knowledge", {"gates": f"map_from_arrays(array({', '.join(repr(g) for g in GATES)}), array_repeat(true, 8))", "decision": "'answer'", "coverage": "0.9D", "target": "0.8D", "requirements": "array(named_struct('id', 'r1', 'status', 'satisfied', 'evidence_refs', array('e1')))", "ledger_requirements": "array('r1')", "ledger_refs": "array('e1')"}, ({"gates": "map('coverage_target_met', true)"}, "gates"), ({"decision": "'perhaps'"}, "decision"), ({"coverage": "0.7D"}, "below_target"), ({"gates": f"map_from_arrays(array({', '.join(repr(g) for g in GATES)}), array_append(array_repeat(true, 7), false))"}, "answer_gates"), ({"ledger_requirements": "array('r2')"}, "requirement_binding"), ({"ledger_refs": "array('e2')"}, "evidence_binding"), ({"decision": "'refuse'", "coverage": "0.1D"}, ""))
def coverage_report():
    answer = F.col("decision") != "answer"
    satisfied = lambda rule: each("requirements", lambda x: (x["status"] != "satisfied") | rule(x))
    return {"gates": F.array_sort(F.map_keys("gates")) == F.array(*[F.lit(g) for g in sorted(GATES)]), "decision": among("decision", "answer", "partial", "refuse", "replan"), "answer_gates": answer | F.forall(F.map_values("gates"), lambda x: x), "below_target": answer | (F.col("coverage") >= F.col("target")), "requirement_binding": satisfied(lambda x: F.array_contains("ledger_requirements", x["id"])), "evidence_binding": satisfied(lambda x: F.forall(x["evidence_refs"], lambda r: F.array_contains("ledger_refs", r)))}


@contract("knowledge", {"workspace_id": "'w1'", "evidence_kind": "'graph_claim'", "evidence_id": "'c1'", "evidence_digest": D, "origins": "array(named_struct('kind', 'graph_claim', 'anchor', 'c1'), named_struct('kind', 'graph_edge', 'anchor', 'g1'))", "anchors": "array('c1', 'c1')"}, ({"evidence_kind": "'page'"}, "kind"), ({"anchors": "array('c1', 'g1')"}, "origin_ambiguous"), ({"evidence_id": "'A b'"}, "identity"), ({"evidence_digest": "''"}, "digest"))
def origin_for_anchors():
    """One origin alone bears every anchor."""
    return {"workspace": ident("workspace_id"), "kind": among("evidence_kind", "document_block", "graph_claim", "graph_edge"), "identity": ident("evidence_id") | digest("evidence_id"), "digest": digest("evidence_digest"), "origin_ambiguous": F.size(F.filter("origins", lambda o: F.forall("anchors", lambda a: a == o["anchor"]))) == 1}


@contract("knowledge", {"entry_id": "'e1'", "evidence_id": "concat('evidence-', repeat('1', 32))", "claim_id": "'c1'", "claim_text": "'a claim'", "source_ref": "'canonical:e1#q1'", "freshness_met": "true", "trust_met": "false", "status": "'partial'"}, ({"source_ref": "'canonical:e2#q1'"}, "source_ref"), ({"status": "'done'"}, "status"), ({"claim_text": "''"}, "claim_text"), ({"freshness_met": "cast(null as boolean)"}, "flags"), ({"status": "'satisfied'"}, "satisfied_without_trust"))
def evidence_projection():
    return {"identity": ident("entry_id") & ident("claim_id") & F.col("evidence_id").rlike("^evidence-[0-9a-f]{32}$"), "claim_text": text("claim_text", 1024), "source_ref": F.col("source_ref").rlike(REFERENCE) & F.startswith("source_ref", F.concat(F.lit("canonical:"), "entry_id", F.lit("#"))), "flags": F.col("freshness_met").isNotNull() & F.col("trust_met").isNotNull(), "status": among("status", "satisfied", "partial", "contradictory", "stale", "disqualified"), "satisfied_without_trust": (F.col("status") != "satisfied") | (F.col("trust_met") & F.col("freshness_met"))}


# Freshness


@contract("freshness", {"acquisition_id": "'a1'", "source_id": "'s1'", "requested_locator": "'https://example.org/a'", "final_locator": "'https://example.org/b'", "retrieved_at": T1, "status": "'acquired'", "http_status": "200", "media_type": "'text/html'", "byte_count": "10", "content_digest": D, "redirect_chain": "array('https://example.org/c')"}, ({"status": "'lost'"}, "status"), ({"content_digest": NONE}, "retained_identity"), ({"byte_count": "0"}, "retained_identity"), ({"status": "'unavailable'", "content_digest": NONE, "final_locator": NONE}, ""), ({"requested_locator": "'http://example.org/'"}, "locators"), ({"requested_locator": "'https://127.0.0.1/'"}, "locators"), ({"http_status": "99"}, "bounds"), ({"retrieved_at": "'2024-13-01T00:00:00Z'"}, "retrieved_at"), ({"redirect_chain": "array_repeat('https://example.org/c', 9)"}, "redirects"), ({"media_type": "'html'"}, "media_type"))
def acquisition_record():
    return {"identity": ident("acquisition_id") & ident("source_id"), "locators": locator("requested_locator") & optional("final_locator", locator), "retrieved_at": instant("retrieved_at"), "status": among("status", "acquired", "verified", "unavailable", "investigate"), "bounds": F.col("http_status").between(100, 599) & F.col("byte_count").between(0, 16 << 20), "media_type": optional("media_type", media), "content_digest": optional("content_digest", digest), "redirects": many("redirect_chain", 0, 8) & each("redirect_chain", locator), "retained_identity": ~among("status", "acquired", "verified") | (F.col("final_locator").isNotNull() & F.col("content_digest").isNotNull() & (F.col("byte_count") > 0))}


@contract("freshness", {"policy_id": "'p1'", "graph_digest": D, "interval_seconds": "3600", "age_seconds": "86400", "most_bytes": "1000", "most_redirects": "2", "media_types": "array('text/html')", "classes": "array('unchanged', 'updated')", "sources": "array(named_struct('source_id', 's1', 'locator', 'https://example.org/a', 'media_type', 'text/html'))"}, ({"interval_seconds": "0"}, "bounds"), ({"age_seconds": "31536001"}, "bounds"), ({"most_redirects": "9"}, "bounds"), ({"media_types": "array('text/html', 'text/html')"}, "media_types"), ({"classes": "array('fresh')"}, "classes"), ({"sources": "array(named_struct('source_id', 's1', 'locator', 'https://example.org/a', 'media_type', 'text/plain'))"}, "source_media"), ({"sources": "array(named_struct('source_id', 's1', 'locator', 'https://example.org/a', 'media_type', 'text/html'), named_struct('source_id', 's2', 'locator', 'https://example.org/a', 'media_type', 'text/html'))"}, "source_locators"), ({"sources": "array(named_struct('source_id', 's1', 'locator', 'https://example.org/a', 'media_type', 'text/html'), named_struct('source_id', 's1', 'locator', 'https://example.org/b', 'media_type', 'text/html'))"}, "source_ids"))
def freshness_policy():
    return {"identity": ident("policy_id") & digest("graph_digest"), "bounds": F.col("interval_seconds").between(1, 31_536_000) & F.col("age_seconds").between(1, 31_536_000) & F.col("most_bytes").between(1, 16 << 20) & F.col("most_redirects").between(0, 8), "media_types": many("media_types", 1, 8) & distinct("media_types") & each("media_types", media), "classes": many("classes", 1, 5) & distinct("classes") & each("classes", lambda x: x.isin(*CLASSES, "investigate")), "source_count": many("sources", 1, 16), "source_ids": distinct("sources", lambda x: x["source_id"]) & each("sources", lambda x: ident(x["source_id"])), "source_locators": distinct("sources", lambda x: x["locator"]) & each("sources", lambda x: locator(x["locator"])), "source_media": each("sources", lambda x: F.array_contains("media_types", x["media_type"]))}


@contract("freshness", {"observation_id": "'o1'", "policy_id": "'p1'", "policy_of_policy": "'p1'", "graph_digest": D, "graph_of_policy": D, "prior_record_digest": E, "prior_of_source": E, "requested_locator": "'https://example.org/a'", "locator_of_source": "'https://example.org/a'", "final_locator": "'https://example.org/a'", "observed_at": T1, "status": "'observed'", "http_status": "200", "media_type": "'text/html'", "media_types": "array('text/html')", "byte_count": "10", "most_bytes": "1000", "content_digest": D, "redirects": "0", "most_redirects": "2", "effective_date": "'2024-02-29'"}, ({"status": "'seen'"}, "status"), ({"content_digest": NONE}, "retained_identity"), ({"status": "'unavailable'"}, "claims_content"), ({"policy_id": "'p2'"}, "policy_binding"), ({"requested_locator": "'https://example.org/b'"}, "source_binding"), ({"byte_count": "1001"}, "policy_bounds"), ({"redirects": "3"}, "policy_bounds"), ({"media_type": "'text/plain'"}, "media_type"), ({"effective_date": "'2023-02-29'"}, "dates"), ({"effective_date": NONE}, ""))
def freshness_observation():
    seen = F.col("status") == "observed"
    return {"identity": ident("observation_id") & ident("policy_id"), "status": among("status", "observed", "unavailable", "investigate"), "dates": instant("observed_at") & optional("effective_date", day), "retained_identity": ~seen | (F.col("final_locator").isNotNull() & F.col("media_type").isNotNull() & F.col("content_digest").isNotNull() & (F.col("byte_count") > 0)), "claims_content": ~among("status", "unavailable", "investigate") | F.col("content_digest").isNull(), "policy_binding": (F.col("policy_id") == F.col("policy_of_policy")) & (F.col("graph_digest") == F.col("graph_of_policy")), "source_binding": (F.col("prior_record_digest") == F.col("prior_of_source")) & (F.col("requested_locator") == F.col("locator_of_source")), "policy_bounds": (F.col("byte_count") <= F.col("most_bytes")) & (F.col("redirects") <= F.col("most_redirects")), "media_type": F.col("media_type").isNull() | F.array_contains("media_types", F.col("media_type"))}


@contract("freshness", {"classification": "'unchanged'", "reason_codes": "array('content_unchanged')", "prior_digest": D, "observed_digest": D, "prior_locator": "'https://example.org/a'", "observed_locator": "'https://example.org/a'", "prior_media_type": "'text/html'", "observed_media_type": "'text/html'", "successor": NONE, "observed_version": NONE, "observed_date": NONE}, ({"classification": "'fresh'"}, "class"), ({"reason_codes": "array('content_changed')"}, "class_reason"), ({"observed_digest": E}, "unchanged_identity"), ({"observed_locator": "'https://example.org/b'"}, "unchanged_identity"), ({"classification": "'updated'", "reason_codes": "array('content_changed')"}, "updated_content"), ({"classification": "'updated'", "reason_codes": "array('content_changed')", "observed_digest": E}, ""), ({"classification": "'superseded'", "reason_codes": "array('declared_successor_verified')"}, "successor"), ({"classification": "'superseded'", "reason_codes": "array('declared_successor_verified', 'version_ambiguous')", "successor": "'https://example.org/a'", "observed_version": "'2'", "observed_date": "'2024-01-01'"}, "ambiguous_version"), ({"classification": "'unavailable'", "reason_codes": "array('terminal_unavailable')"}, "unavailable_content"), ({"classification": "'investigate'"}, "investigate_reason"), ({"classification": "'investigate'", "reason_codes": "array('version_ambiguous')"}, ""))
def freshness_classification():
    """Also the rules of a comparison's classes, reasons and identities."""
    kind, same = F.col("classification"), lambda a, b: F.col(a).eqNullSafe(F.col(b))
    needed = F.create_map(*[F.lit(x) for p in CLASSES.items() for x in p])[kind]
    return {"class": among("classification", *CLASSES, "investigate"), "reasons": many("reason_codes", 1, 8) & distinct("reason_codes"), "class_reason": needed.isNull() | F.array_contains("reason_codes", needed), "investigate_reason": (kind != "investigate") | F.exists("reason_codes", lambda x: ~x.isin(*CLASSES.values())), "unchanged_identity": (kind != "unchanged") | (same("prior_digest", "observed_digest") & same("prior_locator", "observed_locator") & same("prior_media_type", "observed_media_type")), "updated_content": (kind != "updated") | (F.col("observed_digest").isNotNull() & ~same("prior_digest", "observed_digest")), "successor": (kind != "superseded") | (F.col("successor").isNotNull() & same("successor", "observed_locator") & F.col("observed_version").isNotNull() & F.col("observed_date").isNotNull()), "ambiguous_version": (kind != "superseded") | ~F.arrays_overlap("reason_codes", F.array(F.lit("version_ambiguous"), F.lit("effective_date_ambiguous"))), "unavailable_content": (kind != "unavailable") | F.col("observed_digest").isNull()}


@contract("freshness", {"comparison_id": "'k1'", "policy_id": "'p1'", "observation_id": "'o1'", "observation_of": "'o1'", "observation_digest": D, "digest_of": D, "source_id": "'s1'", "source_of": "'s1'", "observed_locator": "'https://example.org/a'", "qualification": "'As observed.'"}, ({"observation_id": "'o2'"}, "observation_binding"), ({"source_id": "'s2'"}, "observation_binding"), ({"observation_digest": E}, "observation_binding"), ({"qualification": "''"}, "qualification"), ({"observed_locator": "'ftp://x'"}, "locator"), ({"comparison_id": "'K'"}, "identity"))
def freshness_comparison():
    return {"identity": ident("comparison_id") & ident("policy_id"), "observation_binding": (F.col("observation_id") == F.col("observation_of")) & (F.col("observation_digest") == F.col("digest_of")) & (F.col("source_id") == F.col("source_of")), "locator": optional("observed_locator", locator), "qualification": text("qualification", 512)}


@contract("freshness", {"results": "array('unchanged', 'updated')", "counts": "map('unchanged', 1, 'updated', 1, 'superseded', 0, 'unavailable', 0, 'investigate', 0)", "rebuild_required": "true", "sources": "array('s1', 's2')", "compared": "array('s2', 's1')", "observed_through": T1, "latest": T1}, ({"counts": "map('unchanged', 2, 'updated', 0, 'superseded', 0, 'unavailable', 0, 'investigate', 0)"}, "counts"), ({"rebuild_required": "false"}, "rebuild"), ({"compared": "array('s1')"}, "coverage"), ({"observed_through": T2}, "observed_through"))
def freshness_summary_record():
    """A summary's counts, need of a rebuild and coverage follow from its results."""
    right = [F.element_at("counts", k) == F.size(F.filter("results", _is(k))) for k in [*CLASSES, "investigate"]]
    every = right[0]
    for r in right[1:]:
        every = every & r
    return {"counts": every, "rebuild": F.col("rebuild_required") == F.exists("results", lambda x: x != "unchanged"), "coverage": F.array_sort("sources") == F.array_sort("compared"), "observed_through": F.col("observed_through") == F.col("latest")}


@contract("freshness", {"observed_through": T1, "now": T2, "most_seconds": "300"}, ({"now": "'2023-12-31T23:59:59Z'"}, "future"), ({"most_seconds": "299"}, "too_old"))
def summary_currency():
    age = F.unix_timestamp(F.try_to_timestamp("now", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))) - F.unix_timestamp(F.try_to_timestamp("observed_through", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return {"future": age >= 0, "too_old": age <= F.col("most_seconds")}


# Selection and promotion

_FLAGS = {"flag_publish": "false", "flag_promote": "false", "flag_execute": "false"}


@contract("selection", {"request_id": "'r1'", "workspace_id": "'w1'", "registry_digest": D, "requested_at": T1, "evidence_ids": "array('e1', 'e2')", **_FLAGS}, ({"evidence_ids": "cast(array() as array<string>)"}, "evidence"), ({"evidence_ids": "transform(sequence(1, 33), x -> concat('e', x))"}, "evidence"), ({"flag_promote": "true"}, "authority"), ({"requested_at": "'yesterday'"}, "requested_at"), ({"registry_digest": "'x'"}, "registry"))
def selection_request():
    return {"identity": ident("request_id") & ident("workspace_id"), "registry": digest("registry_digest"), "requested_at": instant("requested_at"), "evidence": ids("evidence_ids", 1, 32), "authority": no_authority(*_FLAGS)}


@contract("selection", {"proposal_id": "'p1'", "prepared_at": T1, "expires_at": T2, "candidate_id": "'candidate-1'", "write_set": "array('a', 'b')", "evidence": "array(named_struct('workspace_id', 'w1', 'kind', 'claim', 'id', 'e1', 'digest', 'd'))", **_FLAGS}, ({"expires_at": T1}, "times"), ({"candidate_id": "'c1'"}, "candidate"), ({"write_set": "array('a', 'a')"}, "write_set"), ({"write_set": "array('a')"}, "write_set"), ({"evidence": "array_repeat(named_struct('workspace_id', 'w1', 'kind', 'claim', 'id', 'e1', 'digest', 'd'), 2)"}, "evidence_repeated"), ({"expires_at": "'2024-01-01T00:05:01Z'"}, "five_minutes"), ({"flag_execute": "true"}, "authority"))
def selection_proposal():
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return {"identity": ident("proposal_id"), "times": instant("prepared_at") & instant("expires_at") & (F.col("prepared_at") < F.col("expires_at")), "five_minutes": seconds("expires_at") - seconds("prepared_at") <= 300, "candidate": ident("candidate_id") & F.startswith("candidate_id", F.lit("candidate-")), "write_set": many("write_set", 2, 32) & distinct("write_set") & each("write_set", lambda x: text(x, 256)), "evidence": many("evidence", 1, 32), "evidence_repeated": distinct("evidence"), "authority": no_authority(*_FLAGS)}


@contract("selection", {"authorization_id": "'a1'", "proposal_id": "'p1'", "proposal_digest": D, "operation": "'apply'", "operator_id": "'Jo'", "nonce": "'n1'", "source_head": f"'{'0' * 40}'", "issued_at": T1, "expires_at": T2, "one_use_only": "true", "product_self_issued": "false"}, ({"operation": "'rollback'"}, "operation"), ({"one_use_only": "false"}, "one_use"), ({"product_self_issued": "true"}, "self_issued"), ({"source_head": "'main'"}, "source_head"), ({"issued_at": T2}, "times"), ({"operator_id": "''"}, "operator"), ({"nonce": "'N 1'"}, "identity"))
def selection_authorization():
    return {"identity": ident("authorization_id") & ident("proposal_id") & ident("nonce") & digest("proposal_digest"), "operation": F.col("operation") == "apply", "operator": text("operator_id", 256), "source_head": F.col("source_head").rlike(HEAD), "times": instant("issued_at") & instant("expires_at") & (F.col("issued_at") < F.col("expires_at")), "one_use": F.col("one_use_only"), "self_issued": ~F.col("product_self_issued")}


@contract("selection", {"promotion_id": "'p1'", "target_generation": "'g1'", "current_generation": "'g1'", "state": "'applied'", "restores": "'g0'", "entries": "0"}, ({"current_generation": "'g2'"}, "target_not_current"), ({"state": "'prepared'"}, "not_applied"), ({"entries": "1"}, "adds_entries"), ({"restores": "'g1'"}, "restores_itself"))
def rollback_proposal():
    return {"identity": ident("promotion_id"), "target_not_current": F.col("target_generation") == F.col("current_generation"), "not_applied": F.col("state") == "applied", "adds_entries": F.col("entries") == 0, "restores_itself": F.col("restores") != F.col("target_generation")}


# Ingestion and parsing

ERROR_CODES = "source_missing source_digest_mismatch source_invalid parser_failed quality_gate distillation_failed candidate_conflict".split()


@contract("ingestion", {"item_id": "'item-1'", "source_digest": D, "status": "'created'", "candidate_id": "'candidate-1'", "candidate_digest": D, "provenance_digest": E, "review_status": "'unreviewed'", "error_code": NONE}, ({"status": "'lost'"}, "status"), ({"candidate_id": NONE}, "candidate"), ({"review_status": "'seen'"}, "candidate"), ({"error_code": "'quality_gate'"}, "error_with_candidate"), ({"status": "'rejected'", "error_code": "'quality_gate'"}, "candidate_with_error"), ({"status": "'rejected'", "candidate_id": NONE, "candidate_digest": NONE, "provenance_digest": NONE, "review_status": NONE, "error_code": "'other'"}, "error"), ({"status": "'rejected'", "candidate_id": NONE, "candidate_digest": NONE, "provenance_digest": NONE, "review_status": NONE, "error_code": "'quality_gate'"}, ""), ({"source_digest": "'x'"}, "source"))
def terminal_item():
    done, empty = among("status", "created", "unchanged"), F.coalesce("candidate_id", "candidate_digest", "provenance_digest", "review_status").isNull()
    return {"identity": ident("item_id"), "source": digest("source_digest"), "status": among("status", "created", "unchanged", "rejected"), "candidate": ~done | F.coalesce(F.col("candidate_id").rlike("^candidate-") & digest("candidate_digest") & digest("provenance_digest") & among("review_status", "unreviewed", "accepted", "rejected"), F.lit(False)), "error_with_candidate": ~done | F.col("error_code").isNull(), "candidate_with_error": (F.col("status") != "rejected") | empty, "error": (F.col("status") != "rejected") | F.coalesce(among("error_code", *ERROR_CODES), F.lit(False))}


_BLOCK = "named_struct('id', 'b1', 'type', 'paragraph', 'text', 'words', 'source_span', named_struct('start', 0, 'end', 5))"


@contract("ingestion", {"version": "'v0.1'", "digest": D, "source_digest": D, "resource": "'a'", "source_resource": "'a'", "parser_id": "'p1'", "adapter_id": "'p1'", "blocks": f"array({_BLOCK})"}, ({"version": "'v9'"}, "invalid_ir"), ({"digest": E}, "source_digest_mismatch"), ({"resource": "'b'"}, "lost_provenance"), ({"parser_id": "'p2'"}, "invalid_ir"), ({"blocks": f"array({_BLOCK.replace('paragraph', 'poem')})"}, "invalid_ir"), ({"blocks": f"array({_BLOCK.replace(chr(39) + 'end' + chr(39) + ', 5', chr(39) + 'end' + chr(39) + ', -1')})"}, "invalid_ir"), ({"blocks": f"array({_BLOCK.replace('words', ' ')})"}, "no_readable_content"), ({"blocks": f"array({_BLOCK}, {_BLOCK})"}, "block_repeated"))
def document_ir():
    """What a parse must keep of its source."""
    return {"invalid_ir": (F.col("version") == "v0.1") & (F.col("parser_id") == F.col("adapter_id")) & each("blocks", lambda x: x["type"].isin(*BLOCK_TYPES) & x["text"].isNotNull() & span(x["source_span"])), "source_digest_mismatch": F.col("digest") == F.col("source_digest"), "lost_provenance": F.col("resource") == F.col("source_resource"), "no_readable_content": F.exists("blocks", lambda x: F.trim(x["text"]) != ""), "block_repeated": distinct("blocks", lambda x: x["id"])}


@contract("ingestion", {"mappings": "array(named_struct('claim_id', 'c1', 'block_ids', array('b1')))", "blocks": "map('b1', 'one', 'b2', 'two')", "claims": "array(named_struct('text', 'one\\ntwo', 'source_block_ids', array('b1', 'b2')))"}, ({"mappings": "array(named_struct('claim_id', 'c1', 'block_ids', array('b3')))"}, "mapping_blocks"), ({"mappings": "array(named_struct('claim_id', 'c1', 'block_ids', cast(array() as array<string>)))"}, "mapping_blocks"), ({"mappings": "array(named_struct('claim_id', '', 'block_ids', array('b1')))"}, "claim_identity"), ({"claims": "array(named_struct('text', 'one two', 'source_block_ids', array('b1', 'b2')))"}, "claim_text"), ({"claims": "array(named_struct('text', 'one', 'source_block_ids', array('b9')))"}, "claim_blocks,claim_text"))
def distilled_proposal():
    """Mappings name blocks of the document, and claims are their blocks' texts joined by line ends."""
    known = lambda x: F.array_contains(F.map_keys("blocks"), x)
    return {"claim_identity": each("mappings", lambda x: F.length(x["claim_id"]) > 0) & distinct("mappings", lambda x: x["claim_id"]), "mapping_blocks": each("mappings", lambda x: (F.size(x["block_ids"]) > 0) & F.forall(x["block_ids"], known)), "claim_blocks": each("claims", lambda x: F.forall(x["source_block_ids"], known)), "claim_text": each("claims", lambda x: x["text"] == F.array_join(F.transform(x["source_block_ids"], lambda b: F.coalesce(F.try_element_at("blocks", b), F.lit("\x00"))), "\n"))}


@contract("ingestion", {"document_digest": D, "ir_digest": D, "report_digest": D, "selected_parser": "'p1'", "attempts": "array('p2', 'p1')", "candidates": "array('p2', 'p1', 'p3')", "decision": "'accept'", "report_decision": "'accept'", "has_ir": "true", "score": "0.9D", "accept": "0.8D"}, ({"ir_digest": E}, "source_binding"), ({"selected_parser": "'p2'"}, "selected_parser"), ({"attempts": "array('p9', 'p1')"}, "attempts"), ({"attempts": "array('p2', 'p3', 'p1')"}, "attempts"), ({"report_decision": "'fallback'"}, "decision"), ({"has_ir": "false"}, "accepted_ir"), ({"score": "0.5D"}, "threshold"))
def parse_result():
    accepted = F.col("decision") == "accept"
    return {"source_binding": (F.col("document_digest") == F.col("ir_digest")) & (F.col("document_digest") == F.col("report_digest")), "attempts": many("attempts", 1, 2) & (F.size(F.array_except("attempts", "candidates")) == 0), "selected_parser": F.element_at("attempts", -1) == F.col("selected_parser"), "decision": F.col("decision") == F.col("report_decision"), "accepted_ir": accepted == F.col("has_ir"), "threshold": ~accepted | (F.col("score") >= F.col("accept"))}


@contract("ingestion", {"parser": "'p1'", "benchmark_parser": "'p1'", "configuration": D, "expected_configuration": D, "structure": "0.5D", "text_score": "0.9D", "location": "0.7D", "reliability": "1.0D", "repeatability": "1.0D"}, ({"benchmark_parser": "'p2'"}, "identity"), ({"configuration": E}, "identity"), ({"structure": "0.49D"}, "floors"), ({"reliability": "0.99D"}, "floors"))
def converter_gate():
    """A converter may run if its benchmark is its own and above the floors."""
    return {"identity": (F.col("parser") == F.col("benchmark_parser")) & (F.col("configuration") == F.col("expected_configuration")), "floors": (F.least("structure", "text_score", "location") >= 0.5) & (F.least("reliability", "repeatability") >= 1.0)}


@contract("ingestion", {"documents": "100", "accepted": "88", "rejected": "12", "text_score": "0.9D", "structure": "0.9D", "location": "0.5D", "outcome": "1.0D", "configuration_digest": D, "expected": D}, ({"accepted": "87"}, "counts"), ({"outcome": "0.99D"}, "floors"), ({"location": "0.4D"}, "floors"), ({"expected": E}, "configuration"))
def docx_benchmark():
    return {"counts": (F.col("documents") == 100) & (F.col("accepted") == 88) & (F.col("rejected") == 12), "floors": (F.least("text_score", "structure", "location") >= 0.5) & (F.col("outcome") >= 1.0), "configuration": F.col("configuration_digest") == F.col("expected")}


@contract("ingestion", {"items": "array(named_struct('id', 'i1', 'digest', concat('sha256:', repeat('a', 64)), 'review', 'reviewed'))", "report": "'12 of 12'"}, ({"items": "array(named_struct('id', 'i1', 'digest', 'x', 'review', 'reviewed'))"}, "digests"), ({"items": "array_repeat(named_struct('id', 'i1', 'digest', concat('sha256:', repeat('a', 64)), 'review', 'reviewed'), 2)"}, "identity"), ({"items": "array(named_struct('id', 'i1', 'digest', concat('sha256:', repeat('a', 64)), 'review', 'open'))"}, "reviewed"), ({"report": "'see /home/jo/x.pdf'"}, "path_free"))
def private_corpus():
    """A private corpus: its manifest, its review, and a report without paths."""
    return {"identity": many("items", 1, 1000) & distinct("items", lambda x: x["id"]) & each("items", lambda x: ident(x["id"])), "digests": each("items", lambda x: digest(x["digest"])), "reviewed": each("items", lambda x: x["review"] == "reviewed"), "path_free": ~F.col("report").rlike(r"(^|[\s\"'])(/|[A-Za-z]:\\|\.\./)")}


# Queries

_PAIR = "named_struct('workspace', 'w1', 'id', 'e1', 'digest', 'd')"


@contract("queries", {"outcome": "'answer'", "reason": "'ok'", "evidence": "array('e1', 'e2')", "known": "array('e1', 'e2', 'e3')", "qualifications": "array('q')"}, ({"outcome": "'unsure'"}, "outcome"), ({"reason": "'no_evidence'"}, "reason"), ({"evidence": "array('e9')"}, "evidence_unknown"), ({"outcome": "'refuse'", "reason": "'restricted_evidence'"}, "refused_evidence"), ({"outcome": "'refuse'", "reason": "'no_evidence'", "evidence": "cast(array() as array<string>)"}, ""), ({"qualifications": "transform(sequence(1, 33), x -> concat('q', x))"}, "qualifications"), ({"evidence": "array('e1', 'e1')"}, "evidence_repeated"))
def document_query_readback():
    fits = F.create_map(*[F.lit(x) for x in ("answer", "ok", "partial", "ok", "investigate", "freshness_investigation_required")])[F.col("outcome")]
    return {"outcome": among("outcome", "answer", "partial", "refuse", "investigate"), "reason": fits.isNull() | (fits == F.col("reason")), "evidence_unknown": F.size(F.array_except("evidence", "known")) == 0, "evidence_repeated": distinct("evidence"), "refused_evidence": (F.col("outcome") != "refuse") | (F.size("evidence") == 0), "qualifications": many("qualifications", 0, 32)}


@contract("queries", {"evidence": f"array({_PAIR}, {_PAIR.replace('e1', 'e2')})", "consulted": "array('w1', 'w2')", "selected": "array('w2', 'w1')", "outcome": "'answer'", "qualifications": "array('q1')"}, ({"evidence": f"array({_PAIR.replace('e1', 'e2')}, {_PAIR})"}, "evidence_order"), ({"evidence": f"array({_PAIR}, {_PAIR})"}, "evidence_order"), ({"evidence": f"transform(sequence(1, 129), x -> named_struct('workspace', 'w1', 'id', lpad(x, 4, '0'), 'digest', 'd'))"}, "evidence_count"), ({"consulted": "array('w1')"}, "consulted"), ({"evidence": f"array({_PAIR.replace('w1', 'w3')})"}, "workspace_unknown"), ({"outcome": "'refuse'"}, "refused_evidence"), ({"qualifications": "transform(sequence(1, 17), x -> concat('q', x))"}, "qualifications"))
def workspace_query_readback():
    return {"evidence_count": many("evidence", 0, 128), "evidence_order": (F.array_sort("evidence") == F.col("evidence")) & distinct("evidence"), "consulted": F.col("consulted") == F.array_sort("selected"), "workspace_unknown": each("evidence", lambda x: F.array_contains("selected", x["workspace"])), "refused_evidence": (F.col("outcome") != "refuse") | (F.size("evidence") == 0), "qualifications": many("qualifications", 0, 16)}


@contract("queries", {"evidence_ids": "array('c1', 's1')", "graph_ids": "array('c1', 'c2', 's1')", "allowed": "cast(null as array<string>)", "claims": "2", "claim_count": "2", "orphans": "0", "orphan_count": "0"}, ({"evidence_ids": "array('x1')"}, "evidence_unknown"), ({"allowed": "array('c1')"}, "evidence_not_allowed"), ({"claim_count": "3"}, "counts"), ({"orphan_count": "1"}, "counts"))
def graph_readback():
    """A graph query's ids and an inspection's counts against the graph itself."""
    return {"evidence_unknown": F.size(F.array_except("evidence_ids", "graph_ids")) == 0, "evidence_not_allowed": F.col("allowed").isNull() | (F.size(F.array_except("evidence_ids", F.coalesce("allowed", "evidence_ids"))) == 0), "counts": (F.col("claims") == F.col("claim_count")) & (F.col("orphans") == F.col("orphan_count"))}


@contract("queries", {"definitions": "array(named_struct('workspace', 'w1', 'registry', 'r1', 'case', 'k1', 'graph', 'g1'), named_struct('workspace', 'w2', 'registry', 'r2', 'case', 'k2', 'graph', 'g2'))"}, ({"definitions": "array_repeat(named_struct('workspace', 'w1', 'registry', 'r1', 'case', 'k1', 'graph', 'g1'), 2)"}, "workspace,registry,case,graph"), ({"definitions": "array(named_struct('workspace', 'w1', 'registry', 'r1', 'case', 'k1', 'graph', 'g1'), named_struct('workspace', 'w2', 'registry', 'r2', 'case', 'k1', 'graph', 'g2'))"}, "case"))
def identity_collisions():
    """Four identities that no two workspaces of a generation share."""
    return {k: distinct("definitions", _field(k)) for k in ("workspace", "registry", "case", "graph")}


@contract("queries", {"pairs": "array(named_struct('left', 'w1', 'right', 'w2', 'edge', 'g1'))", "linked": "array('w1>w2')", "edges": "array('g1')"}, ({"pairs": "array(named_struct('left', 'w2', 'right', 'w1', 'edge', 'g1'))"}, "order,not_linked"), ({"linked": "array('w1>w3')"}, "not_linked"), ({"edges": "array('g2')"}, "edge_missing"), ({"pairs": "array_repeat(named_struct('left', 'w1', 'right', 'w2', 'edge', 'g1'), 2)"}, "repeated"))
def conflict_bindings():
    """At most 128 ordered pairs of directly linked workspaces, each with an explicit conflict edge."""
    return {"count": many("pairs", 0, 128), "order": each("pairs", lambda x: x["left"] < x["right"]), "not_linked": each("pairs", lambda x: F.array_contains("linked", F.concat(x["left"], F.lit(">"), x["right"]))), "edge_missing": each("pairs", lambda x: F.array_contains("edges", x["edge"])), "repeated": distinct("pairs")}


# Evaluation, benchmarks, release, viewer


@contract("evaluation", {"baseline_task": "'t1'", "challenger_task": "'t1'", "baseline_corpus": D, "challenger_corpus": D, "baseline_metrics": "array('recall', 'precision')", "challenger_metrics": "array('precision', 'recall')"}, ({"challenger_task": "'t2'"}, "binding"), ({"challenger_corpus": E}, "binding"), ({"challenger_metrics": "array('recall')"}, "applicability"))
def evaluation_pair():
    return {"binding": (F.col("baseline_task") == F.col("challenger_task")) & (F.col("baseline_corpus") == F.col("challenger_corpus")), "applicability": F.array_sort("baseline_metrics") == F.array_sort("challenger_metrics")}


@contract("evaluation", {"corpus_digest": D, "expected_corpus": D, "configuration_digest": E, "expected_configuration": E, "body": "'body'", "manifest_digest": "concat('sha256:', sha2('body', 256))", "scores": "map('a', 0.5D)", "metrics": "array('a', 'b')"}, ({"manifest_digest": D}, "self_digest"), ({"expected_corpus": E}, "corpus"), ({"expected_configuration": D}, "configuration"), ({"scores": "map('a', 1.5D)"}, "scores"), ({"metrics": "array('b', 'a')"}, "sorted"))
def benchmark_manifest():
    return {"self_digest": F.col("manifest_digest") == F.concat(F.lit("sha256:"), F.sha2("body", 256)), "corpus": F.col("corpus_digest") == F.col("expected_corpus"), "configuration": F.col("configuration_digest") == F.col("expected_configuration"), "scores": F.forall(F.map_values("scores"), lambda x: x.between(0, 1)), "sorted": (F.array_sort("metrics") == F.col("metrics")) & distinct("metrics")}


@contract("evaluation", {"char_accuracy": "980000", "word_accuracy": "950000", "precision": "980000", "recall": "950000", "order_accuracy": "1000000", "overlap": "800000", "pages": "1000000", "outcome": "1000000", "invented_lines": "0", "runtime_digest": D, "model_digests": f"array({D}, {E})"}, ({"char_accuracy": "979999"}, "floors"), ({"order_accuracy": "999999"}, "floors"), ({"invented_lines": "1"}, "invented"), ({"model_digests": f"array({D}, {D})"}, "models"))
def ocr_qualification():
    # Least accuracies in millionths.
    floors = {"char_accuracy": 980_000, "word_accuracy": 950_000, "precision": 980_000, "recall": 950_000, "order_accuracy": 1_000_000, "overlap": 800_000, "pages": 1_000_000, "outcome": 1_000_000}
    return {"floors": F.forall(F.array(*[F.col(k) >= v for k, v in floors.items()]), lambda x: x), "invented": F.col("invented_lines") == 0, "models": digest("runtime_digest") & distinct("model_digests") & each("model_digests", digest)}


@contract("evaluation", {"pages": "array(named_struct('page', 1, 'width', 100, 'height', 50))", "detections": "array(named_struct('page', 1, 'text', 'x', 'confidence', 0.9D, 'polygon', array(0, 0, 10, 0, 10, 5, 0, 5)))"}, ({"detections": "array(named_struct('page', 2, 'text', 'x', 'confidence', 0.9D, 'polygon', array(0, 0, 10, 0, 10, 5, 0, 5)))"}, "page"), ({"detections": "array(named_struct('page', 1, 'text', '', 'confidence', 0.9D, 'polygon', array(0, 0, 10, 0, 10, 5, 0, 5)))"}, "text"), ({"detections": "array(named_struct('page', 1, 'text', 'x', 'confidence', 1.1D, 'polygon', array(0, 0, 10, 0, 10, 5, 0, 5)))"}, "confidence"), ({"detections": "array(named_struct('page', 1, 'text', 'x', 'confidence', 0.9D, 'polygon', array(0, 0, 10)))"}, "polygon"))
def ocr_worker_result():
    return {"page": each("detections", lambda x: F.exists("pages", lambda p: p["page"] == x["page"])), "text": each("detections", lambda x: F.length(x["text"]) > 0), "confidence": each("detections", lambda x: x["confidence"].between(0, 1)), "polygon": each("detections", lambda x: (F.size(x["polygon"]) == 8) & F.forall(x["polygon"], lambda v: v >= 0))}


@contract("release", {"included_files": "array('README.md', 'src/a.py')", "included_prefixes": "array('docs/')", "excluded_prefixes": "array('private/')", "max_files": "100", "max_depth": "8", "exceptions": "array(named_struct('path', 'tests/x', 'reason', 'inert_private_path', 'test_only', true))"}, ({"included_files": "array('src/a.py', 'README.md')"}, "sorted"), ({"included_files": "array('private/x')"}, "excluded"), ({"included_files": "array('../x')"}, "paths"), ({"max_depth": "65"}, "limits"), ({"exceptions": "array(named_struct('path', 'src/x', 'reason', 'inert_private_path', 'test_only', true))"}, "exceptions"), ({"exceptions": "array(named_struct('path', 'tests/x', 'reason', 'because', 'test_only', true))"}, "exceptions"))
def release_policy():
    inner = lambda x: ~x.rlike(r"(^/|(^|/)\.\.(/|$)|\\)") & (F.length(x) > 0)
    gone = lambda x: F.exists("excluded_prefixes", lambda e: F.startswith(x, e) | (F.concat(x, F.lit("/")) == e))
    return {"paths": each("included_files", inner) & each("included_prefixes", lambda x: inner(x) & F.endswith(x, F.lit("/"))), "sorted": (F.array_sort("included_files") == F.col("included_files")) & distinct("included_files"), "excluded": each("included_files", lambda x: ~gone(x)), "limits": F.col("max_files").between(1, 100_000) & F.col("max_depth").between(1, 64), "exceptions": each("exceptions", lambda x: F.startswith(x["path"], F.lit("tests/")) & x["reason"].isin("inert_private_path", "inert_secret_candidate", "inert_network_locator") & x["test_only"])}


@contract("release", {"path": "'docs/a.md'", "included_files": "array('README.md')", "included_prefixes": "array('docs/')", "excluded_prefixes": "array('docs/private/')"}, ({"path": "'docs/private/a.md'"}, "allowed"), ({"path": "'docs/private'"}, "allowed"), ({"path": "'src/a.py'"}, "allowed"), ({"path": "'README.md'"}, ""))
def release_path():
    gone = F.exists("excluded_prefixes", lambda e: F.startswith(F.col("path"), e) | (F.concat("path", F.lit("/")) == e))
    return {"allowed": ~gone & (F.array_contains("included_files", F.col("path")) | F.exists("included_prefixes", lambda p: F.startswith(F.col("path"), p)))}


@contract("release", {"grant_id": "'g1'", "workspace_id": "'w1'", "binding_digest": D, "created_at": T1, "expires_at": "'2024-01-02T00:00:00Z'", "max_sensitivity": "'internal'", "scope": "'whole-source'"}, ({"expires_at": T1}, "lifetime"), ({"expires_at": "'2024-01-02T00:00:01Z'"}, "lifetime"), ({"max_sensitivity": "'restricted'"}, "sensitivity"), ({"scope": "'page'"}, "scope"), ({"binding_digest": "''"}, "binding"))
def viewer_grant():
    seconds = lambda c: F.unix_timestamp(F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return {"identity": ident("grant_id") & ident("workspace_id"), "binding": digest("binding_digest"), "lifetime": (seconds("expires_at") - seconds("created_at")).between(1, 86_400), "sensitivity": among("max_sensitivity", "public", "internal"), "scope": F.col("scope") == "whole-source"}


_RECORD = "named_struct('workspace', 'w1', 'key', 'k1', 'format', 'pdf', 'basis', 'physical-one-based', 'sensitivity', 'public', 'original', 'internal', 'source', 's1')"


@contract("release", {"primary": "'w1'", "references": "array('w2')", "records": f"array({_RECORD})"}, ({"references": "array('w1')"}, "references"), ({"records": f"array({_RECORD.replace(chr(39) + 'w1' + chr(39), chr(39) + 'w9' + chr(39))})"}, "workspace_denied"), ({"records": f"array({_RECORD.replace('pdf', 'text')})"}, "page_basis"), ({"records": f"array({_RECORD.replace(chr(39) + 'public' + chr(39), chr(39) + 'restricted' + chr(39))})"}, "sensitivity"), ({"records": f"array({_RECORD}, {_RECORD})"}, "identity_collision"), ({"records": f"array({_RECORD}, {_RECORD.replace('k1', 'k2').replace('internal', 'public')})"}, "binding_drift"))
def viewer_manifest():
    level = lambda x: F.array_position(F.array(*[F.lit(v) for v in LEVELS]), x)
    scope = lambda x: (x["workspace"] == F.col("primary")) | F.array_contains("references", x["workspace"])
    source = lambda x: F.struct(x["workspace"].alias("w"), x["source"].alias("s"))
    whole = lambda x: F.struct(x["workspace"].alias("w"), x["source"].alias("s"), x["format"].alias("f"), x["original"].alias("o"))
    return {"references": many("references", 0, 32) & distinct("references") & ~F.array_contains("references", F.col("primary")), "workspace_denied": each("records", scope), "page_basis": each("records", lambda x: x["basis"] == F.when(x["format"] == "pdf", "physical-one-based").otherwise("not-applicable")), "sensitivity": each("records", lambda x: x["original"].isin("public", "internal") & (level(x["sensitivity"]) <= level(x["original"]))), "identity_collision": distinct("records", lambda x: F.struct(x["workspace"].alias("w"), x["key"].alias("k"))), "binding_drift": F.size(F.array_distinct(F.transform("records", source))) == F.size(F.array_distinct(F.transform("records", whole)))}


@contract("release", {"claim_id": "'c1'", "candidate_id": "'candidate-1'", "owner": "'candidate-1'", "body": "'b'", "record_digest": "concat('sha256:', sha2('b', 256))", "flag_publish": "false", "flag_promote": "false", "flag_execute": "false"}, ({"owner": "'candidate-2'"}, "candidate"), ({"record_digest": D}, "self_digest"), ({"flag_publish": "true"}, "authority"))
def claim_record():
    return {"identity": ident("claim_id"), "candidate": F.col("candidate_id") == F.col("owner"), "self_digest": F.col("record_digest") == F.concat(F.lit("sha256:"), F.sha2("body", 256)), "authority": no_authority(*_FLAGS)}
