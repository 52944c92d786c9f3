"""Contract queries of the record contracts: records projected from the tables, and SQL that states each rule on the same columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.contracts import records  # noqa: F401  registers the contracts
from factloom.contracts.rules import CONTRACTS, violations
from factloom.plans.contract import _LINES, ORACLE, QUERIES, lines, table

PROJECTED: dict[str, dict[str, Callable[[SparkSession, str], DataFrame]]] = {}
SQL: dict[str, list[str]] = {}

_IDENT, _DIGEST = "'^[a-z0-9][a-z0-9._-]{0,127}$'", "'^sha256:[0-9a-f]{64}$'"


def projected(family: str, source: str, /, **rules: str):
    """A projection (id and the contract's columns) of the contract that bears its name, with the SQL of the same rows and of what each rule demands."""

    def add(f):
        PROJECTED.setdefault(family, {})[f.__name__] = f
        cases = ", ".join(f"CASE WHEN NOT coalesce({rule}, false) THEN '{reason}' END" for reason, rule in rules.items())
        SQL.setdefault(family, []).append(f"SELECT CAST(id AS VARCHAR) AS id, '{f.__name__}' AS contract, array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',') AS violations FROM ({source})")
        return f

    return add


def _ident(x: str) -> str:
    return f"regexp_full_match({x}, {_IDENT})"


def _all(of: str, rule: str) -> str:
    return f"len(list_filter({of}, lambda x: NOT coalesce({rule}, false))) = 0"


def _distinct(of: str) -> str:
    return f"len(list_distinct({of})) = len({of})"


def _text(x: str, most: int, least: int = 1) -> str:
    return rf"(length({x}) BETWEEN {least} AND {most} AND NOT regexp_matches({x}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]'))"


def _iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%SZ')"


def _instant(x: str) -> str:
    return rf"(regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') AND try_strptime({x}, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL)"


def iso(column: str):
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def s(prefix: str, column):
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# Knowledge: claims and citations are lines of documents, anchors and entries are sales with their lines


@projected(
    "knowledge",
    "SELECT doc_id AS id, list({'claim': 'c' || length(text) % 1000, 'text': text, 'blocks': ['b' || line_no, 'b' || line_no * 2 % 7], 'citation': CASE WHEN contains(text, '@') THEN 'Q 1' ELSE 'q' || line_no END}) AS c FROM blocks GROUP BY 1",
    claim_count="len(c) <= 5000",
    claim_identity=_all("c", f"{_ident('x.claim')} AND {_ident('x.citation')}"),
    claim_text=_all("c", _text("x.text", 1024)),
    claim_blocks=_all("c", "x.blocks[1] <> x.blocks[2]"),
    claim_repeated=_distinct("list_transform(c, lambda x: x.claim)"),
)
def claims(spark, d):
    claim = F.struct(s("c", F.length("text") % 1000).alias("claim_id"), "text", F.array(s("b", "line_no"), s("b", F.col("line_no") * 2 % 7)).alias("source_block_ids"), F.when(F.col("text").contains("@"), "Q 1").otherwise(s("q", "line_no")).alias("citation_id"))
    return lines(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(claim).alias("claims"))


@projected(
    "knowledge",
    "SELECT doc_id AS id, list({'citation': 'q' || line_no % 9, 'text': text}) AS c FROM blocks GROUP BY 1",
    citation_count="len(c) <= 5000",
    citation_identity=_all("c", _ident("x.citation")),
    citation_text=_all("c", _text("x.text", 512)),
    citation_blocks="true",
    citation_repeated=_distinct("list_transform(c, lambda x: x.citation)"),
)
def citations(spark, d):
    citation = F.struct(s("q", F.col("line_no") % 9).alias("citation_id"), F.col("text").alias("render_text"), F.array(s("b", "line_no")).alias("source_block_ids"))
    return lines(spark, d).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(citation).alias("citations"))


@projected(
    "knowledge",
    "SELECT sale_id AS id, list({'q': 'q' || line_no, 'b': 'i' || coalesce(item_id, -1)}) AS c, coalesce(list({'q': 'q' || line_no, 'b': 'i' || coalesce(CASE WHEN quantity > 3 THEN item_id ELSE vendor_id END, -1)}) FILTER (flag <> 'returned'), []) AS y FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IS NOT NULL GROUP BY 1",
    citation_missing="len(list_filter(list_transform(c, lambda x: x.q), lambda q: NOT list_contains(list_transform(y, lambda z: z.q), q))) = 0",
    anchors_differ="len(list_filter(c, lambda x: NOT list_contains(y, x))) = 0",
)
def claim_citation_anchors(spark, d):
    item = table(spark, d, "sale_lines").filter("sale_id is not null and line_no is not null")
    anchor = lambda block: F.struct(s("q", "line_no").alias("citation_id"), F.array(s("i", F.coalesce(block, F.lit(-1)))).alias("source_block_ids"))
    cited = F.when(F.col("flag") != "returned", anchor(F.when(F.col("quantity") > 3, F.col("item_id")).otherwise(F.col("vendor_id"))))
    return item.groupBy(F.col("sale_id").alias("id")).agg(F.collect_list(anchor(F.col("item_id"))).alias("claims"), F.collect_list(cited).alias("citations"))


@projected(
    "knowledge",
    "SELECT s.sale_id AS id, r, c, client_id, 'sha256:' || sha256(CAST(total AS VARCHAR)) AS digest, status, client_id IS NOT NULL AS told, sold_at IS NOT NULL AS dated, priority IS NOT NULL AS ranked, status <> 'held' AS verified FROM sales s LEFT JOIN (SELECT sale_id, list(DISTINCT flag) AS r, list('c' || item_id) FILTER (item_id IS NOT NULL) AS c FROM sale_lines WHERE flag <> 'returned' GROUP BY 1) USING (sale_id)",
    identity="true",
    requirements="len(r) >= 1",
    claims=f"len(c) >= 1 AND {_distinct('c')}",
    source_ref="client_id IS NOT NULL",
    source_digest="total IS NOT NULL".replace("total", "digest"),
    citation="status <> ''",
    provenance="told",
    flags="dated AND ranked",
    verified="verified",
)
def ledger_entry(spark, d):
    held = table(spark, d, "sale_lines").filter("flag <> 'returned'").groupBy("sale_id").agg(F.collect_set("flag").alias("requirement_ids"), F.collect_list(s("c", "item_id")).alias("claim_ids"))
    sales = table(spark, d, "sales").join(held, "sale_id", "left")
    none = F.array().cast("array<string>")
    told = F.when(F.col("client_id").isNotNull(), F.create_map(F.lit("client"), s("", "client_id"))).otherwise(F.create_map().cast("map<string,string>"))
    return sales.select(F.col("sale_id").alias("id"), s("e", "sale_id").alias("evidence_id"), F.coalesce("requirement_ids", none).alias("requirement_ids"), F.coalesce("claim_ids", none).alias("claim_ids"), s("k", "client_id").alias("source_ref"), F.concat(F.lit("sha256:"), F.sha2(F.col("total").cast("string"), 256)).alias("source_digest"), F.col("status").alias("citation"), told.alias("provenance"), (F.col("sold_at") > F.lit("2024-02-01")).alias("freshness_met"), (F.col("priority") < 4).alias("trust_met"), (F.col("status") != "held").alias("verified"))


# Freshness: sales arrive after they were made, stamps say when in many forms


@projected(
    "freshness",
    "SELECT sale_id AS id, date_diff('second', sold_at, arrived_at) AS age FROM sales",
    future="age >= 0",
    too_old="age <= 600",
)
def summary_currency(spark, d):
    whole = lambda c: iso(c).alias({"sold_at": "observed_through", "arrived_at": "now"}[c])
    return table(spark, d, "sales").select(F.col("sale_id").alias("id"), whole("sold_at"), whole("arrived_at"), F.lit(600).alias("most_seconds"))


@projected(
    "freshness",
    r"SELECT stamp_id AS id, stamp_id, raw, lower(regexp_replace(coalesce(zone, ''), '[^A-Za-z]', '', 'g')) AS host, source, stamp_id % 4 AS k, stamp_id % 11 AS hops, stamp_id % 9 AS m FROM stamps",
    identity=_ident("source"),
    locators="host <> ''",
    retrieved_at=_instant("raw"),
    status="true",
    bounds="stamp_id % 520 + 90 BETWEEN 100 AND 599",
    media_type="m <> 0",
    content_digest="true",
    redirects="hops <= 8",
    retained_identity="k <> 1 AND coalesce(length(raw), 0) > 0 OR k > 1",
)
def acquisition_record(spark, d):
    k, n = F.col("stamp_id") % 4, F.col("stamp_id")
    host = F.lower(F.regexp_replace(F.coalesce("zone", F.lit("")), "[^A-Za-z]", ""))
    place = F.concat(F.lit("https://"), F.when(host != "", F.concat(host, F.lit(".example.org"))).otherwise(""), F.lit("/"), n.cast("string"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("acquired", "verified", "unavailable", "investigate")]), (k + 1).cast("int"))
    final = F.when(k != 1, place)
    hops = F.transform(F.sequence(F.lit(1), F.greatest((n % 11).cast("int"), F.lit(1))), lambda _: F.lit("https://example.org/c"))
    return table(spark, d, "stamps").select(F.col("stamp_id").alias("id"), s("a", "stamp_id").alias("acquisition_id"), F.col("source").alias("source_id"), place.alias("requested_locator"), final.alias("final_locator"), F.col("raw").alias("retrieved_at"), status.alias("status"), (n % 520 + 90).alias("http_status"), F.when(n % 9 == 0, "html").otherwise("text/plain").alias("media_type"), F.coalesce(F.length("raw"), F.lit(0)).alias("byte_count"), F.concat(F.lit("sha256:"), F.sha2(F.coalesce("raw", F.lit("")), 256)).alias("content_digest"), hops.alias("redirect_chain"))


# Selection: a sale asks for its items until it arrives; changes of a client are generations


@projected(
    "selection",
    f"SELECT s.sale_id AS id, status, {_iso('sold_at')} AS asked_at, coalesce(e, []) AS e FROM sales s LEFT JOIN (SELECT sale_id, list('i' || item_id) AS e FROM sale_lines WHERE item_id IS NOT NULL GROUP BY 1) USING (sale_id)",
    identity="true",
    registry="true",
    requested_at=_instant("asked_at"),
    evidence=f"len(e) BETWEEN 1 AND 32 AND {_distinct('e')}",
    authority="status <> 'held'",
)
def selection_request(spark, d):
    asked = table(spark, d, "sale_lines").filter("item_id is not null").groupBy("sale_id").agg(F.collect_list(s("i", "item_id")).alias("e"))
    sales = table(spark, d, "sales").join(asked, "sale_id", "left")
    flag = F.lit(False)
    return sales.select(F.col("sale_id").alias("id"), s("r", "sale_id").alias("request_id"), F.lit("w1").alias("workspace_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("sale_id").cast("string"), 256)).alias("registry_digest"), iso("sold_at").alias("requested_at"), F.coalesce("e", F.array().cast("array<string>")).alias("evidence_ids"), flag.alias("flag_publish"), (F.col("status") == "held").alias("flag_promote"), flag.alias("flag_execute"))


@projected(
    "selection",
    f"SELECT s.sale_id AS id, status, sold_at, arrived_at, client_id, coalesce(w, []) AS w, coalesce(e, []) AS e FROM sales s LEFT JOIN (SELECT sale_id, list(DISTINCT 'v' || vendor_id) AS w, list({{'v': vendor_id, 'i': item_id}}) AS e FROM sale_lines GROUP BY 1) USING (sale_id)",
    identity="true",
    times="date_trunc('second', sold_at) < date_trunc('second', arrived_at)",
    five_minutes="date_diff('second', date_trunc('second', sold_at), date_trunc('second', arrived_at)) <= 300",
    candidate="client_id IS NOT NULL",
    write_set="len(w) BETWEEN 2 AND 32",
    evidence="len(e) BETWEEN 1 AND 32",
    evidence_repeated=_distinct("e"),
    authority="status <> 'held'",
)
def selection_proposal(spark, d):
    own = table(spark, d, "sale_lines").groupBy("sale_id").agg(F.collect_set(s("v", "vendor_id")).alias("w"), F.collect_list(F.struct("vendor_id", "item_id")).alias("e"))
    sales = table(spark, d, "sales").join(own, "sale_id", "left")
    flag = F.lit(False)
    return sales.select(F.col("sale_id").alias("id"), s("p", "sale_id").alias("proposal_id"), iso("sold_at").alias("prepared_at"), iso("arrived_at").alias("expires_at"), s("candidate-", "client_id").alias("candidate_id"), F.coalesce("w", F.array().cast("array<string>")).alias("write_set"), F.coalesce("e", F.array().cast("array<struct<vendor_id:bigint,item_id:bigint>>")).alias("evidence"), flag.alias("flag_publish"), flag.alias("flag_promote"), (F.col("status") == "held").alias("flag_execute"))


@projected(
    "selection",
    "SELECT change_id AS id, seq, op, city, max(seq) OVER (PARTITION BY client_id) AS last FROM client_changes WHERE client_id IS NOT NULL",
    identity="true",
    target_not_current="seq = last",
    not_applied="op <> 'D'",
    adds_entries="op <> 'I'",
    restores_itself="seq > 0",
)
def rollback_proposal(spark, d):
    changes = table(spark, d, "client_changes").filter("client_id is not null").withColumn("last", F.max("seq").over(Window.partitionBy("client_id")))
    return changes.select(F.col("change_id").alias("id"), s("p", "change_id").alias("promotion_id"), s("g", "seq").alias("target_generation"), s("g", "last").alias("current_generation"), F.when(F.col("op") == "D", "prepared").when(F.col("op").isNotNull(), "applied").alias("state"), s("g", F.greatest(F.col("seq") - 1, F.lit(0))).alias("restores"), F.when(F.col("op") == "I", 1).when(F.col("op").isNotNull(), 0).alias("entries"))


# Ingestion: documents are items, their lines blocks


@projected(
    "ingestion",
    "SELECT doc_id AS id, doc_id, text IS NULL OR length(text) < 200 AS bad, lang, source, n_chars FROM documents",
    identity="doc_id >= 0",
    source="true",
    status="true",
    candidate="bad OR lang <> 'fr'",
    error_with_candidate="bad OR n_chars % 10 > 0",
    candidate_with_error="NOT bad OR lang = 'de'",
    error="NOT bad OR lang <> 'es'",
)
def terminal_item(spark, d):
    digest = lambda c: F.concat(F.lit("sha256:"), F.sha2(F.col(c).cast("string"), 256))
    bad, lang = F.col("text").isNull() | (F.length("text") < 200), F.col("lang")
    kept = lambda value: F.when(~bad | ~F.coalesce(lang == "de", F.lit(False)), value)
    code = F.when(bad, F.when(lang != "es", "quality_gate").otherwise("unheard_of")).when(F.col("n_chars") % 10 == 0, "quality_gate")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), s("item-", "doc_id").alias("item_id"), digest("doc_id").alias("source_digest"), F.when(bad, "rejected").otherwise("created").alias("status"), kept(s("candidate-", "doc_id")).alias("candidate_id"), kept(digest("doc_id")).alias("candidate_digest"), kept(digest("n_chars")).alias("provenance_digest"), kept(F.when(lang == "fr", "seen").otherwise("unreviewed")).alias("review_status"), code.alias("error_code"))


@projected(
    "ingestion",
    "SELECT d.doc_id AS id, d.n_chars, length(d.text) AS size, d.lang, d.source, coalesce(b, []) AS b FROM documents d LEFT JOIN (SELECT doc_id, list({'id': 'b' || length(text) % 5000, 'kind': CASE WHEN contains(text, '|') THEN 'bars' ELSE 'paragraph' END}) AS b FROM blocks GROUP BY 1) USING (doc_id)",
    invalid_ir="lang <> 'es' AND len(list_filter(b, lambda x: x.kind = 'bars')) = 0",
    source_digest_mismatch="n_chars = size",
    lost_provenance="source IS NOT NULL",
    no_readable_content="len(b) > 0",
    block_repeated=_distinct("list_transform(b, lambda x: x.id)"),
)
def document_ir(spark, d):
    block = F.struct(s("b", F.length("text") % 5000).alias("id"), F.when(F.col("text").contains("|"), "bars").otherwise("paragraph").alias("type"), "text", F.struct("start", "end").alias("source_span"))
    own = lines(spark, d).groupBy("doc_id").agg(F.collect_list(block).alias("blocks"))
    docs = table(spark, d, "documents").join(own, "doc_id", "left")
    empty = F.array().cast(own.schema["blocks"].dataType)
    return docs.select(F.col("doc_id").alias("id"), F.lit("v0.1").alias("version"), s("", "n_chars").alias("digest"), s("", F.length("text")).alias("source_digest"), F.col("source").alias("resource"), F.col("source").alias("source_resource"), F.lit("p1").alias("parser_id"), F.when(F.col("lang") == "es", "p2").when(F.col("lang").isNotNull(), "p1").alias("adapter_id"), F.coalesce("blocks", empty).alias("blocks"))


# Queries: clients of a nation share identities


@projected(
    "queries",
    "SELECT nation_id AS id, list(client_id) AS w, list(coalesce(master_id, -client_id)) AS r, list(coalesce(email, CAST(client_id AS VARCHAR))) AS c, list(coalesce(name, CAST(client_id AS VARCHAR))) AS g FROM clients WHERE nation_id IS NOT NULL GROUP BY 1",
    workspace=_distinct("w"),
    registry=_distinct("r"),
    case=_distinct("c"),
    graph=_distinct("g"),
)
def identity_collisions(spark, d):
    own = F.col("client_id").cast("string")
    row = F.struct(own.alias("workspace"), F.coalesce("master_id", -F.col("client_id")).alias("registry"), F.coalesce("email", own).alias("case"), F.coalesce("name", own).alias("graph"))
    return table(spark, d, "clients").filter("nation_id is not null").groupBy(F.col("nation_id").alias("id")).agg(F.collect_list(row).alias("definitions"))


@projected(
    "queries",
    "SELECT sale_id AS id, status, e, k FROM sales LEFT JOIN (SELECT sale_id, list(item_id) FILTER (item_id IS NOT NULL AND flag <> 'returned') AS k, list(item_id) FILTER (item_id IS NOT NULL AND line_no < 5) AS e FROM sale_lines GROUP BY 1) USING (sale_id)",
    outcome="status IS NOT NULL",
    reason="status <> 'open' OR sale_id_even".replace("sale_id_even", "id % 2 = 0"),
    evidence_unknown="len(list_filter(coalesce(e, []), lambda x: NOT list_contains(coalesce(k, []), x))) = 0",
    evidence_repeated=_distinct("coalesce(e, [])"),
    refused_evidence="status <> 'held' OR len(coalesce(e, [])) = 0",
    qualifications="true",
)
def document_query_readback(spark, d):
    items = table(spark, d, "sale_lines").filter("item_id is not null")
    of = lambda cond: F.collect_list(F.when(cond, F.col("item_id")))
    held = items.groupBy("sale_id").agg(of(F.col("flag") != "returned").alias("k"), of(F.col("line_no") < 5).alias("e"))
    none = F.array().cast("array<bigint>")
    status = F.col("status")
    outcome = F.when(status == "done", "answer").when(status == "open", "partial").when(status == "held", "refuse")
    return table(spark, d, "sales").join(held, "sale_id", "left").select(F.col("sale_id").alias("id"), outcome.alias("outcome"), F.when((status == "open") & (F.col("sale_id") % 2 == 1), "no_evidence").otherwise("ok").alias("reason"), F.coalesce("e", none).alias("evidence"), F.coalesce("k", none).alias("known"), F.array().cast("array<string>").alias("qualifications"))


# Evaluation: suppliers of parts as readers, documents as corpora


@projected(
    "evaluation",
    "SELECT l_suppkey AS id, avg(l_quantity) AS q, min(l_discount) AS low, count(*) FILTER (l_returnflag = 'R') AS r, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1",
    floors="q * 40000 >= 1000000 AND n >= 7",
    invented="r < 10",
    models="low < 0.01",
)
def ocr_qualification(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.min("l_discount").alias("low"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count_distinct("l_linenumber").alias("n"))
    mark = F.col("q") * 40_000
    digest = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    same = F.when(F.col("low") < 0.01, "b").otherwise("a")
    return rows.select(F.col("l_suppkey").alias("id"), mark.alias("char_accuracy"), mark.alias("word_accuracy"), mark.alias("precision"), mark.alias("recall"), mark.alias("order_accuracy"), (F.col("n") * 120_000).alias("overlap"), F.lit(1_000_000).alias("pages"), F.lit(1_000_000).alias("outcome"), F.greatest(F.col("r") - 9, F.lit(0)).alias("invented_lines"), digest(F.lit("r")).alias("runtime_digest"), F.array(digest(F.lit("a")), digest(same)).alias("model_digests"))


@projected(
    "evaluation",
    "SELECT doc_id AS id, text, n_chars, lang, source, quality, toxic FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)",
    self_digest="text IS NOT NULL AND n_chars = length(text)",
    corpus="lang <> 'es'",
    configuration="source IS NOT NULL",
    scores="coalesce(quality + toxic, 0) <= 1",
    sorted="lang > 'd'",
)
def benchmark_manifest(spark, d):
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    digest = lambda x: F.concat(F.lit("sha256:"), F.sha2(x, 256))
    told = F.when(F.col("n_chars") == F.length("text"), F.col("text")).otherwise("other")
    return table(spark, d, "documents").join(label, "doc_id", "left").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", "a").when(F.col("lang").isNotNull(), "b").alias("corpus_digest"), F.lit("b").alias("expected_corpus"), F.col("source").alias("configuration_digest"), F.col("source").alias("expected_configuration"), F.col("text").alias("body"), digest(told).alias("manifest_digest"), F.create_map(F.lit("a"), F.coalesce((F.col("quality") + F.col("toxic")).cast("double"), F.lit(0.0))).alias("scores"), F.array(F.lit("d"), F.col("lang")).alias("metrics"))


# Release: documents as files, sales as grants, changes as records


@projected(
    "release",
    "SELECT doc_id AS id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source, doc_id FROM documents",
    allowed="doc_id % 5 = 0 OR lang IN ('en', 'de') AND NOT (lang = 'de' AND starts_with(source, 's1'))",
)
def release_path(spark, d):
    none = F.lit("none")
    path = F.when(F.col("doc_id") % 5 == 0, "README.md").otherwise(F.concat_ws("/", F.coalesce("lang", none), F.coalesce("source", none), "doc_id"))
    listed = lambda *x: F.array(*[F.lit(v) for v in x])
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), path.alias("path"), listed("README.md").alias("included_files"), listed("en/", "de/").alias("included_prefixes"), listed("de/s1", "fr/").alias("excluded_prefixes"))


@projected(
    "release",
    "SELECT sale_id AS id, date_diff('second', date_trunc('second', sold_at), date_trunc('second', arrived_at)) AS life, priority, status, client_id FROM sales",
    identity="client_id IS NOT NULL",
    binding="true",
    lifetime="life BETWEEN 1 AND 86400",
    sensitivity="priority <= 3",
    scope="status <> 'held'",
)
def viewer_grant(spark, d):
    return table(spark, d, "sales").select(F.col("sale_id").alias("id"), s("g", "client_id").alias("grant_id"), F.lit("w1").alias("workspace_id"), F.concat(F.lit("sha256:"), F.sha2(F.col("sale_id").cast("string"), 256)).alias("binding_digest"), iso("sold_at").alias("created_at"), iso("arrived_at").alias("expires_at"), F.when(F.col("priority") <= 3, "internal").when(F.col("priority").isNotNull(), "restricted").alias("max_sensitivity"), F.when(F.col("status") == "held", "page").otherwise("whole-source").alias("scope"))


@projected(
    "release",
    "SELECT c.client_id AS id, c.master_id, c.segment, c.city, c.source FROM clients c",
    identity="true",
    candidate="master_id = id",
    self_digest="city IS NOT NULL AND segment IS NOT NULL",
    authority="source <> 'web'",
)
def claim_record(spark, d):
    flag = F.lit(False)
    body = F.concat_ws("/", "city", "segment")
    told = F.when(F.col("city").isNotNull() & F.col("segment").isNotNull(), body).otherwise("another")
    return table(spark, d, "clients").select(F.col("client_id").alias("id"), s("c", "client_id").alias("claim_id"), s("candidate-", "client_id").alias("candidate_id"), s("candidate-", "master_id").alias("owner"), F.concat(body, F.lit(".")).alias("body"), F.concat(F.lit("sha256:"), F.sha2(F.concat(told, F.lit(".")), 256)).alias("record_digest"), (F.col("source") == "web").alias("flag_publish"), flag.alias("flag_promote"), flag.alias("flag_execute"))


def _query(family):
    def run(spark, d):
        parts = []
        for name, project in PROJECTED[family].items():
            found = violations(project(spark, d), CONTRACTS[family][name].rules)
            parts.append(found.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("contract"), "violations"))
        return reduce(lambda a, b: a.unionByName(b), parts)

    run.__name__ = f"contracts_{family}"
    return run


for _family in CONTRACTS:
    QUERIES[f"contracts_{_family}"] = _query(_family)
    ORACLE[f"contracts_{_family}"] = f"WITH {_LINES} " + " UNION ALL ".join(SQL[_family])
