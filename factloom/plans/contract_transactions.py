"""Contract queries of answers and transactions: sales, their lines, clients and their changes stand for proposals, authorisations, uses and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import answers as A
from factloom.operators import knowledge as K
from factloom.operators import transactions as X
from factloom.operators import workspace as W
from factloom.plans.contract import _LINES, ORACLE, _sql_words, contract, lines, prompts, table


def _entries(spark, d):
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = table(spark, d, "documents").select("doc_id").distinct().join(label, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("entry_id"), (F.coalesce("quality", F.lit(1)) == 1).alias("fresh"), (F.coalesce("toxic", F.lit(0)) != 1).alias("trusted"))


_ANSWER = f"""hits AS ({ORACLE["knowledge_search"]}), {_LINES}, lab AS (SELECT doc_id, max(toxic) AS t, min(quality) AS q FROM labels GROUP BY 1),
h AS (SELECT item_id, rank, entry_id, claim_id, b.text, coalesce(q, 1) = 1 AS fresh, coalesce(t, 0) <> 1 AS trusted, {_sql_words("b.text")} AS w FROM hits JOIN blocks b ON b.doc_id = entry_id AND b.line_no = claim_id LEFT JOIN lab ON lab.doc_id = entry_id),
n AS (SELECT *, bool_or(list_contains(w, 'not')) OVER p AND bool_or(NOT list_contains(w, 'not')) OVER p AS clash FROM h WINDOW p AS (PARTITION BY item_id)),
s AS (SELECT *, CASE WHEN clash THEN 'contradictory' WHEN NOT fresh THEN 'stale' WHEN NOT trusted THEN 'disqualified' ELSE 'satisfied' END AS status FROM n),
f AS (SELECT *, min(CASE WHEN status = 'satisfied' THEN rank END) OVER (PARTITION BY item_id) AS first, sum(greatest(1, len(w))) OVER (PARTITION BY item_id ORDER BY rank) AS spent FROM s),
l AS (SELECT * FROM f WHERE (first IS NULL OR rank <= first) AND spent <= {A.TOKENS}),
a AS (SELECT item_id, bool_or(clash) AS clash, bool_or(status = 'satisfied') AS met, bool_and(fresh) AS fresh, bool_and(trusted) AS trusted, count(*) AS c, string_agg(text || ' [canonical:' || entry_id || '#' || claim_id || ']', chr(10) ORDER BY rank) AS told FROM l GROUP BY 1),
o AS (SELECT item_id, told, c, CASE WHEN c IS NULL OR clash THEN 'refuse' WHEN met THEN 'answer' WHEN NOT trusted THEN 'refuse' ELSE 'partial' END AS status,
  CASE WHEN c IS NULL THEN 'coverage_insufficient' WHEN clash THEN 'hard_contradiction' WHEN met THEN 'none' WHEN NOT trusted THEN 'trust_gate_failed' ELSE 'freshness_gate_failed' END AS reason_code FROM benchmark LEFT JOIN a USING (item_id))"""


@contract(f"""WITH {_ANSWER} SELECT item_id, status, reason_code, CAST(CASE WHEN status <> 'refuse' AND octet_length(encode(told)) <= {A.ANSWER_BYTES} THEN c ELSE 0 END AS BIGINT) AS claims,
CASE WHEN status <> 'refuse' AND octet_length(encode(told)) <= {A.ANSWER_BYTES} THEN told ELSE '' END AS answer FROM o""")
def knowledge_answer(spark, d):
    """Search, projection, coverage, gates and synthesis for every prompt."""
    claims = lines(spark, d).select(F.col("doc_id").alias("entry_id"), F.col("line_no").alias("claim_id"), "text")
    hits = K.search(claims, prompts(spark, d), 20).join(claims, ["entry_id", "claim_id"])
    return A.answer(prompts(spark, d), A.project(hits, _entries(spark, d)))


def _ids(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


_WIDTHS = "k AS (SELECT sale_id, count(*) AS n, count(*) FILTER (flag <> 'returned') AS kept FROM sale_lines GROUP BY 1)"


@contract(f"""WITH {_WIDTHS}, p AS (SELECT s.*, coalesce(n, 0) AS n, coalesce(kept, 0) AS kept FROM sales s LEFT JOIN k USING (sale_id)),
u AS (SELECT DISTINCT 'a' || sale_id AS a, 'n' || client_id || '/' || priority AS n FROM sales WHERE sale_id IN (SELECT sale_id FROM sale_lines WHERE flag = 'swapped' AND line_no = 3))
SELECT sale_id, array_to_string(list_filter([
  CASE WHEN priority = 5 OR priority IS NULL THEN 'one_use' END,
  CASE WHEN status = 'open' OR status = 'held' THEN 'operation' END,
  CASE WHEN sold_at > TIMESTAMP '2024-03-01 12:00:00' OR sold_at IS NULL THEN 'future' END,
  CASE WHEN NOT (arrived_at + INTERVAL 30 DAY > TIMESTAMP '2024-03-01 12:00:00' AND sold_at < arrived_at + INTERVAL 30 DAY) OR sold_at IS NULL THEN 'expired' END,
  CASE WHEN status = 'open' OR n <> kept THEN 'binding' END,
  CASE WHEN client_id IS NULL THEN 'source_head' END,
  CASE WHEN 'a' || sale_id IN (SELECT a FROM u) OR 'n' || client_id || '/' || priority IN (SELECT n FROM u WHERE n IS NOT NULL) THEN 'consumed' END], lambda x: x IS NOT NULL), ',') AS violations FROM p""")
def authorization_validate(spark, d):
    """Sales that are not open are proposals (held: to roll back), with two of them for many a client; every sale has an authorisation to
    apply, bound to as many lines as it has, while a proposal counts those that were not returned. Sales with a swapped third line have been used, and
    their nonce, which sales of one client and priority share."""
    lines_ = table(spark, d, "sale_lines").groupBy("sale_id").agg(F.count("*").alias("n"), F.count_if(F.col("flag") != "returned").alias("kept"))
    sales = table(spark, d, "sales").join(lines_, "sale_id", "left").fillna(0, ["n", "kept"])
    nonce = F.concat(F.lit("n"), F.col("client_id").cast("string"), F.lit("/"), F.col("priority").cast("string"))
    names = dict(proposal_digest=_ids("p", "sale_id"), promotion_id=_ids("c", "client_id"), candidate_digest=_ids("k", "client_id"), provenance_digest=_ids("v", "priority"), review_head=_ids("h", "total"), entry_digest=_ids("e", "sale_id"), inventory_digest=_ids("i", "sold_at"), generation_id=_ids("g", "priority"), source_head=_ids("b", "client_id"))
    bound = lambda many: [v.alias(k) for k, v in (names | {"write_set_digest": _ids("w", many)}).items()]
    proposals = sales.filter("status <> 'open'").select(F.when(F.col("status") == "held", "rollback").otherwise("apply").alias("operation"), *bound("kept"))
    grants = sales.select("sale_id", _ids("a", "sale_id").alias("authorization_id"), nonce.alias("nonce"), (F.col("priority") != 5).alias("one_use_only"), F.lit("apply").alias("operation"), F.col("sold_at").alias("issued_at"), (F.col("arrived_at") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"), *bound("n"))
    used = grants.join(table(spark, d, "sale_lines").filter("flag = 'swapped' and line_no = 3").select("sale_id").distinct(), "sale_id", "left_semi")
    found = X.validate_authorizations(grants, proposals, used.select("authorization_id", "nonce", "proposal_digest", F.lit("committed").alias("state")), F.lit("2024-03-01 12:00:00").cast("timestamp"), F.col("source_head"))
    return found.select(F.substring("authorization_id", 2, 20).cast("long").alias("sale_id"), "violations")


@contract("""WITH l AS (SELECT sale_id, item_id, vendor_id, quantity, line_no, flag FROM sale_lines), p AS (SELECT master_id AS c, count(*) AS proposals FROM clients GROUP BY 1),
u AS (SELECT sale_id, count(*) FILTER (line_no = 1) AS reserved, count(*) FILTER (line_no = 2) AS committed, max(CASE WHEN line_no = 1 THEN 'r' || (quantity % 3) END) AS record, max(CASE WHEN line_no = 2 THEN 'r' || (quantity % 3) END) AS previous, max(CASE WHEN line_no = 1 THEN 'a' || vendor_id END) AS grant_ FROM l GROUP BY 1),
f AS (SELECT sale_id, bool_or(flag = 'returned') AS foreign_ FROM l WHERE line_no IN (3, 4) GROUP BY 1), t AS (SELECT sale_id, 
  CASE WHEN s.status = 'held' THEN 'completed_terminal_evidence' WHEN coalesce(proposals, 0) <> 1 THEN 'proposal_evidence_conflict'
    WHEN NOT (coalesce(reserved, 0) = 1 AND coalesce(committed, 0) <= 1 AND (coalesce(committed, 0) = 0 OR previous IS NOT DISTINCT FROM record)) THEN 'reservation_evidence_conflict'
    WHEN grant_ IS NULL OR grant_ NOT IN (SELECT 'a' || vendor_id FROM vendors WHERE balance > 0) THEN 'retained_authorization_missing'
    WHEN coalesce(foreign_, false) THEN 'staging_ownership_uncertain' ELSE 'resumed_exact_transaction' END AS reason
  FROM sales s LEFT JOIN p ON p.c = s.client_id LEFT JOIN u USING (sale_id) LEFT JOIN f USING (sale_id))
SELECT sale_id, CASE WHEN reason IN ('completed_terminal_evidence', 'resumed_exact_transaction') THEN 'recovered' ELSE 'investigate' END AS status, reason FROM t""")
def promotion_recover(spark, d):
    """A sale is a transaction of its client's promotion (merged clients have several proposals); its first lines reserve, its second ones commit,
    third and fourth ones are staged, returned ones by another; vendors in credit retain their authorisation."""
    sales, items = table(spark, d, "sales"), table(spark, d, "sale_lines")
    intents = sales.select(_ids("t", "sale_id").alias("transaction_id"), _ids("c", "client_id").alias("promotion_id"), _ids("i", "sale_id").alias("intent"))
    record = F.concat(F.lit("r"), (F.col("quantity") % 3).cast("string"))
    use = lambda no, state: items.filter(F.col("line_no") == no).select(_ids("i", "sale_id").alias("intent"), F.lit(state).alias("state"), _ids("a", "vendor_id").alias("authorization"), record.alias("previous"), record.alias("record"))
    staged = items.filter("line_no in (3, 4)").select(_ids("t", "sale_id").alias("transaction_id"), F.when(F.col("flag") == "returned", "foreign").otherwise(_ids("i", "sale_id")).alias("intent"))
    found = X.recover(intents, sales.filter("status = 'held'").select(_ids("t", "sale_id").alias("transaction_id")), table(spark, d, "clients").select(_ids("c", "master_id").alias("promotion_id")), use(1, "reserved").unionByName(use(2, "committed")), table(spark, d, "vendors").filter("balance > 0").select(_ids("a", "vendor_id").alias("authorization")), staged)
    return found.select(F.substring("transaction_id", 2, 20).cast("long").alias("sale_id"), "status", "reason")


@contract("""WITH q AS (SELECT sale_id, 'i' || item_id AS e FROM sale_lines WHERE item_id IS NOT NULL AND sale_id IS NOT NULL UNION ALL SELECT sale_id, 'g' || item_id FROM sale_lines WHERE item_id IS NOT NULL AND sale_id IS NOT NULL AND line_no = 2),
r AS (SELECT 'i' || item_id AS e, kind = 'office' AS restricted, price IS NOT NULL AS current, brand = 'B8' AS case_, size > 45 AS conflict, NULL AS z FROM items UNION ALL SELECT 'g' || item_id, false, true, false, false, 'i' || (item_id + item_id % 2) FROM items),
g AS (SELECT sale_id, count(*) AS n, count(DISTINCT q.e) AS k, bool_and(r.e IS NOT NULL) AS known, coalesce(bool_or(restricted), false) AS restricted, coalesce(bool_or(NOT current), false) AS stale, coalesce(bool_or(case_), false) AS case_, coalesce(bool_or(conflict), false) AS conflict,
  len(list_filter(list(CASE WHEN starts_with(q.e, 'g') AND r.e IS NOT NULL THEN 'i' || q.e[2:] END), lambda x: x IS NOT NULL AND NOT list_contains(list(q.e), x))) + len(list_filter(list(z), lambda x: x IS NOT NULL AND NOT list_contains(list(q.e), x))) AS loose FROM q LEFT JOIN r USING (e) GROUP BY 1)
SELECT sale_id, array_to_string(list_filter([CASE WHEN n > 32 OR n <> k THEN 'evidence_count' END, CASE WHEN NOT known THEN 'evidence_unknown' END, CASE WHEN restricted THEN 'restricted' END, CASE WHEN stale THEN 'stale' END, CASE WHEN case_ THEN 'case_evidence' END, CASE WHEN conflict THEN 'conflict' END, CASE WHEN loose > 0 THEN 'edge_ends' END], lambda x: x IS NOT NULL), ',') AS violations FROM g""")
def selection_prepare(spark, d):
    """A sale asks for its items, and for the edge of its second line's item, which links an odd item with the next one and an even one with itself."""
    items, asked = table(spark, d, "items"), table(spark, d, "sale_lines").filter("item_id is not null and sale_id is not null")
    requests = asked.select(F.col("sale_id").alias("request_id"), _ids("i", "item_id").alias("evidence_id")).unionByName(asked.filter("line_no = 2").select(F.col("sale_id").alias("request_id"), _ids("g", "item_id").alias("evidence_id")))
    none = F.lit(None).cast("string")
    claims = items.select(_ids("i", "item_id").alias("evidence_id"), F.lit("claim").alias("kind"), (F.col("kind") == "office").alias("restricted"), F.col("price").isNotNull().alias("current"), F.when(F.col("brand") == "B8", "case_evidence").otherwise("primary_law").alias("role"), (F.col("size") > 45).alias("conflict"), none.alias("source_end"), none.alias("target_end"))
    edges = items.select(_ids("g", "item_id").alias("evidence_id"), F.lit("edge").alias("kind"), F.lit(False).alias("restricted"), F.lit(True).alias("current"), none.alias("role"), F.lit(False).alias("conflict"), _ids("i", "item_id").alias("source_end"), F.concat(F.lit("i"), (F.col("item_id") + F.col("item_id") % 2).cast("string")).alias("target_end"))
    found = X.prepare_selection(requests, claims.unionByName(edges), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return found.select(F.col("request_id").alias("sale_id"), "violations")


@contract("""WITH c AS (SELECT client_id, 'e' || master_id AS e, city || '/' || segment || '/' || source AS k, balance > 2000 AS ok FROM clients), a AS (SELECT 'e' || client_id AS e, city || '/' || segment || '/' || source AS k FROM client_changes WHERE op = 'D' OR seq > 6)
SELECT client_id, array_to_string(list_filter([CASE WHEN NOT coalesce(ok, false) THEN 'not_accepted' END, CASE WHEN e IN (SELECT e FROM a WHERE e IS NOT NULL) THEN 'entry_exists' END, CASE WHEN k IN (SELECT k FROM a WHERE k IS NOT NULL) THEN 'semantic_key_exists' END, CASE WHEN count(k) OVER (PARTITION BY k) > 1 THEN 'semantic_key_repeated' END], lambda x: x IS NOT NULL), ',') AS violations FROM c""")
def promotion_prepare(spark, d):
    """Clients are candidates, accepted with a balance; entries and keys of deleted or often changed clients are active."""
    key = F.when(F.col("city").isNotNull() & F.col("segment").isNotNull() & F.col("source").isNotNull(), F.concat_ws("/", "city", "segment", "source"))
    candidates = table(spark, d, "clients").select(F.col("client_id").alias("candidate_id"), _ids("e", "master_id").alias("entry_id"), key.alias("semantic_key"), F.when(F.col("balance") > 2000, "accepted").otherwise("rejected").alias("review"))
    active = table(spark, d, "client_changes").filter("op = 'D' or seq > 6").select(_ids("e", "client_id").alias("entry_id"), key.alias("semantic_key"))
    return X.prepare_promotions(candidates, active).select(F.col("candidate_id").alias("client_id"), "violations")


@contract("""WITH h AS (SELECT client_id, strftime(valid_at, '%Y-%m-%d %H:%M:%S') || '/' || change_id AS made_at, coalesce(segment, '') || '/' || coalesce(city, '') AS digest FROM client_changes WHERE valid_at IS NOT NULL AND op <> 'D'),
f AS (SELECT client_id, arg_min(digest, made_at) AS held, min(made_at) AS first_at FROM h GROUP BY 1)
SELECT c.client_id, CASE WHEN held IS NULL THEN 'created' WHEN held = coalesce(segment, '') || '/' || coalesce(city, '') THEN 'unchanged' ELSE 'conflict' END AS state, coalesce(first_at, '2024-06-01') AS created_at FROM clients c LEFT JOIN f USING (client_id)""")
def candidate_reconcile(spark, d):
    """Clients as they are now against the first of their changes."""
    digest = F.concat(F.coalesce("segment", F.lit("")), F.lit("/"), F.coalesce("city", F.lit(""))).alias("digest")
    held = table(spark, d, "client_changes").filter("valid_at is not null and op <> 'D'").select("client_id", digest, F.concat(F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss"), F.lit("/"), F.col("change_id").cast("string")).alias("created_at"))
    proposed = table(spark, d, "clients").select("client_id", digest, F.lit("2024-06-01").alias("created_at"))
    return X.reconcile(proposed, held, "client_id", "digest").select("client_id", "state", "created_at")


@contract("""WITH p AS (SELECT sale_id, count(DISTINCT line_no) AS have FROM sale_lines GROUP BY 1), f AS (SELECT DISTINCT sale_id FROM sale_lines WHERE quantity IS NULL OR shipped_at IS NULL)
SELECT sale_id, CASE WHEN sale_id IN (SELECT sale_id FROM f WHERE sale_id IS NOT NULL) THEN 'investigate' WHEN have >= coalesce(priority, 3) THEN 'complete' ELSE 'resume' END AS status FROM sales LEFT JOIN p USING (sale_id)""")
def run_recover(spark, d):
    """A sale is a run of as many parts as its priority says; broken lines are foreign."""
    items = table(spark, d, "sale_lines").withColumnRenamed("sale_id", "bundle_id")
    bundles = table(spark, d, "sales").select(F.col("sale_id").alias("bundle_id"), F.coalesce("priority", F.lit(3)).alias("expected"))
    found = X.recover_runs(bundles, items.select("bundle_id", F.col("line_no").alias("part")), items.filter("quantity is null or shipped_at is null").select("bundle_id"))
    return found.withColumnRenamed("bundle_id", "sale_id")


@contract("""WITH x AS (SELECT doc_id, text IS NULL AS missing, coalesce(n_chars <> length(text), false) AS drift, coalesce(length(text) < 200, false) AS short, coalesce(contains(text, '@'), false) AS parser, coalesce(lang = 'es', false) AS odd, lang IS NULL AS unreadable, source LIKE '%0' AS kept FROM documents)
SELECT doc_id, CASE WHEN drift THEN 'source_digest_mismatch' WHEN missing THEN 'source_missing' WHEN unreadable THEN 'source_invalid' WHEN parser THEN 'parser_failed' WHEN short THEN 'quality_gate' WHEN kept THEN 'candidate_conflict' WHEN odd THEN 'parser_failed' END AS code FROM x""")
def ingest_errors(spark, d):
    """What is wrong with each document: null or short texts, other lengths than stated, addresses, no language; Spanish is a class nobody knows."""
    text = F.col("text")
    marks = {"quality": F.length(text) < 200, "conflict": F.col("source").endswith("0"), "never heard of": F.col("lang") == "es", "missing": text.isNull(), "parser": text.contains("@"), "unreadable": F.col("lang").isNull(), "digest_mismatch": F.col("n_chars") != F.length(text)}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in marks.items()]))
    return table(spark, d, "documents").select("doc_id", X.error_code(found).alias("code"))


@contract("""WITH r AS (SELECT click_id, props AS b FROM clicks UNION ALL SELECT -1 - event_id, props FROM events UNION ALL SELECT 1000000000000 + click_id, '{"k": 1, ' || substr(props, 2) FROM clicks WHERE starts_with(props, '{"k"') UNION ALL SELECT 2000000000000 + click_id, '[' || props || ']' FROM clicks WHERE props IS NOT NULL UNION ALL SELECT 3000000000000 + click_id, regexp_replace(props, ': 1[0-9.]*', ': NaN', 'g') FROM clicks WHERE contains(props, ': 1') AND length(replace(props, '{', '')) = length(replace(props, '}', ''))),
v AS (SELECT click_id, b, CASE WHEN b IS NULL OR NOT json_valid(replace(b, ': NaN', ': null')) THEN 'malformed' WHEN starts_with(b, '[') THEN 'not_an_object' WHEN len(json_keys(replace(b, ': NaN', ': null'))) > len(list_distinct(json_keys(replace(b, ': NaN', ': null')))) THEN 'repeated_key' WHEN contains(b, 'NaN') THEN 'non_finite' ELSE '' END AS problem FROM r)
SELECT click_id, problem, CASE WHEN problem = '' THEN '{' || array_to_string(list_transform(list_sort(json_keys(b)), lambda k: '"' || k || '":' || regexp_replace(CAST(json_extract(b, '$."' || k || '"') AS VARCHAR), '\\{"sku":([^,}]*),"qty":([^}]*)\\}', '{"qty":\\2,"sku":\\1}', 'g')), ',') || '}' END AS canonical FROM v""")
def strict_json(spark, d):
    """The properties of clicks and events as they are, with a key repeated, within an array, and, where they are whole, with numbers that are none."""
    clicks, events = table(spark, d, "clicks").select("click_id", "props"), table(spark, d, "events").select((-1 - F.col("event_id")).alias("click_id"), "props")
    more = lambda n, body, rows: rows.select((F.col("click_id") + F.lit(n * 10**12)).alias("click_id"), body.alias("props"))
    bodies = clicks.unionByName(events).unionByName(more(1, F.concat(F.lit('{"k": 1, '), F.expr("substring(props, 2)")), clicks.filter(F.col("props").startswith('{"k"'))))
    bodies = bodies.unionByName(more(2, F.concat(F.lit("["), "props", F.lit("]")), clicks.filter("props is not null"))).unionByName(more(3, F.regexp_replace("props", ": 1[0-9.]*", ": NaN"), clicks.filter(F.col("props").contains(": 1") & (F.length(F.translate("props", "{", "")) == F.length(F.translate("props", "}", ""))))))
    out = bodies.select("click_id", T.canonical_json(F.col("props")).alias("j"))
    return out.select("click_id", F.coalesce("j.problem", F.lit("")).alias("problem"), "j.canonical")


def _graph(spark, d):
    """Parts are claims, suppliers their sources; orders between parts are edges, some in conflict."""
    role = F.element_at(F.array(*[F.lit(r) for r in W.ROLE_NOTES]), (F.col("p_partkey") % 4 + 1).cast("int"))
    claims = table(spark, d, "part").select(F.concat(F.lit("c"), "p_partkey").alias("claim_id"), F.concat(F.lit("s"), (F.col("p_partkey") % 50).cast("string")).alias("source_id"), role.alias("role"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.sha2(F.col("p_name"), 256).alias("digest"))
    sources = spark.range(50).select(F.concat(F.lit("s"), "id").alias("source_id"), F.lit("technical_guidance").alias("role"), F.when(F.col("id") == 7, "superseded").otherwise("current").alias("status"))
    pair = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_partkey % 97 = 0").select("l_orderkey", F.concat(F.lit("c"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), (F.col("l_suppkey") % 50).cast("string")).alias("target_id"))
    edges = pair.groupBy("source_id", "target_id").agg(F.min("l_orderkey").alias("k")).select(F.concat(F.lit("g"), "k").alias("edge_id"), F.when(F.col("k") % 5 == 0, "conflicts_with").otherwise("supports").alias("edge_type"), F.lit("claim").alias("source_kind"), "source_id", F.lit("source").alias("target_kind"), "target_id", F.lit("d").alias("digest"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.element_at(F.array(*[F.lit(w) for w in ("red widget", "economy bolt", "small plate gear", "nothing known")]), (F.col("n_nationkey") % 4 + 1).cast("int")).alias("text"))
    return asked, claims, sources, edges, sources.filter("source_id = 's9'").select("source_id")


@contract()
def graph_query(spark, d):
    outcomes, evidence = W.query_graph(*_graph(spark, d))
    listed = evidence.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("evidence_id")), ",").alias("evidence"))
    return outcomes.join(listed, "item_id", "left").select("item_id", "outcome", F.array_join("roles", ",").alias("roles"), F.array_join("qualifications", " ").alias("qualifications"), "evidence")


@contract()
def workspace_query(spark, d):
    """Two workspaces, one of all parts and one of every third, asked together; conflicting edges bind their claims."""
    asked, claims, sources, edges, changed = _graph(spark, d)
    parts, origins = [], []
    for name, own in (("w1", claims), ("w2", claims.filter("cast(substring(claim_id, 2) as long) % 3 = 0"))):
        outcomes, evidence = W.query_graph(asked, own, sources, edges, changed)
        records = W.resolve(evidence, own, edges)
        closed = records.groupBy("item_id").agg(F.bool_or(F.col("role") == "case_evidence").alias("closed"))
        parts.append(outcomes.join(closed, "item_id", "left").select("item_id", F.lit(name).alias("workspace_id"), "outcome", F.coalesce("closed", F.lit(False)).alias("restricted"), F.lit(False).alias("fallback"), "qualifications"))
        origins.append(records.select("item_id", F.lit(name).alias("workspace_id"), F.concat(F.lit("graph_"), "evidence_kind").alias("evidence_kind"), "evidence_id", "evidence_digest"))
    pairs = edges.filter("edge_type = 'conflicts_with'").select(F.col("source_id").alias("left_id"), F.col("target_id").alias("right_id"))
    outcomes, evidence = W.merge(asked, parts[0].unionByName(parts[1]), origins[0].unionByName(origins[1]), pairs)
    many = evidence.groupBy("item_id").agg(F.count("*").alias("evidence"))
    return outcomes.join(many, "item_id", "left").select("item_id", "outcome", F.array_join("qualifications", " ").alias("qualifications"), F.coalesce("evidence", F.lit(0)).alias("evidence"))
