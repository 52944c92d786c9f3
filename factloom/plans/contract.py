"""The contract queries: every operator over the whole driver tables, and the same in DuckDB's SQL.

``documents`` stand for text sources (toxic = 1: restricted, quality = 0: stale), ``pages`` for HTML sources, ``benchmark``
for prompts, ``conversations`` and ``events`` for logs, ``orders`` for a queue, the star schema for a graph, ``lineitem``
and ``part`` for metric samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import governance as V
from factloom.operators import graph as G
from factloom.operators import knowledge as K
from factloom.operators import layout as L
from factloom.operators import metrics as M
from factloom.operators import quality as Q
from factloom.operators import retrieval as R
from factloom.operators import safety as S
from factloom.sources import blocks as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def contract(sql: str | None = None):
    """Register a query under its name, with its SQL where SQL can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.line_blocks(table(spark, sf_dir, "documents"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark")


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP) + "]"
_NUMERIC = "[" + ", ".join(f"'{w}'" for w in T.NUMERIC) + "]"


def _sql_words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{N}}]+')"


def _sql_t1(x: str) -> str:
    return f"list_distinct(list_filter({_sql_words(x)}, lambda w: NOT list_contains({_STOP}, w)))"


def _sql_t2(x: str) -> str:
    return f"list_distinct(list_filter({_sql_words(x)}, lambda w: length(w) >= 3))"


_LINES = rf"""cut AS (
  SELECT doc_id, unnest(l) AS piece, unnest(generate_series(0, len(l) - 1)) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{B.LINE}') AS l FROM documents)
), blocks AS (
  SELECT doc_id, CAST(n AS INTEGER) AS line_no, CAST(start AS BIGINT) AS start, CAST(start + length(text) AS BIGINT) AS "end", text
  FROM (SELECT *, regexp_replace(piece, '(\r\n|[{B.ENDS}])$', '') AS text, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n) - length(piece) AS start FROM cut) WHERE trim(text, ' ') <> ''
)"""
_SCORES = f"""{_LINES}, bt AS (SELECT doc_id, line_no, unnest({_sql_t1("text")}) AS term FROM blocks),
pt AS (SELECT item_id, unnest({_sql_t1("text")}) AS term FROM benchmark),
f AS (SELECT term, count(*) AS f FROM bt GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
scored AS (SELECT item_id, doc_id, line_no, count(*) AS overlap, sum(greatest(0.5, ln(1 + (n - f + 0.5) / (f + 0.5)))) AS score
  FROM bt JOIN pt USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY ALL)"""
_BONUS = rf"""{_SCORES}, asked AS (SELECT item_id, array_to_string({_sql_words("text")}, ' ') AS phrase, len(list_intersect({_sql_t1("text")}, {_NUMERIC})) > 0 AS cue FROM benchmark),
bonus AS (SELECT item_id, doc_id, line_no, overlap, text, score AS base,
  CASE WHEN phrase <> '' AND contains(array_to_string({_sql_words("text")}, ' '), phrase) THEN 10.0 ELSE 0.0 END AS phrase_bonus,
  CASE WHEN cue AND regexp_matches(text, '[0-9]') THEN 2.0 ELSE 0.0 END AS numeric_bonus,
  CASE WHEN regexp_matches(text, '(?i)\b(?:effective|amend|replace|supersed)\w*\b') THEN 1.5 ELSE 0.0 END AS effective_bonus
  FROM scored JOIN blocks USING (doc_id, line_no) JOIN asked USING (item_id)),
ranked AS (SELECT *, round((base + phrase_bonus + numeric_bonus + effective_bonus) * CASE WHEN starts_with(ltrim(text), '#') THEN 0.12 ELSE 1.0 END, 6) AS score FROM bonus)"""


# Sources and parsing


@contract(f"WITH {_LINES} SELECT * FROM blocks")
def blocks_lines(spark, d):
    return lines(spark, d)


@contract()
def blocks_html(spark, d):
    return B.html_blocks(table(spark, d, "pages"))


@contract()
def blocks_markdown(spark, d):
    return B.markdown_blocks(table(spark, d, "documents"))


@contract(r"""WITH s AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>', '', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>', 1), '</?[a-zA-Z][^>]*>', '', 'g'), '\s+', ' ', 'g')) AS heading FROM s""")
def html_headings(spark, d):
    return B.html_headings(table(spark, d, "pages"))


@contract(f"""WITH {_LINES}, c AS (SELECT doc_id, sum(length(text)) AS covered, count(*) AS blocks FROM blocks GROUP BY 1),
s AS (SELECT d.doc_id, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, round(least(1.0, CAST(coalesce(covered, 0) AS DOUBLE) / greatest(1, length(trim(coalesce(d.text, ''), ' ')))), 6) AS coverage FROM documents d LEFT JOIN c USING (doc_id))
SELECT *, CASE WHEN coverage >= 0.98 THEN 'accept' WHEN coverage >= 0.5 THEN 'fallback' ELSE 'quarantine' END AS decision FROM s""")
def parse_quality(spark, d):
    return B.parse_quality(table(spark, d, "documents"))


_TAG = r"(?:[\s/][^>]*)?>"
#: Headings and paragraphs, each up to the next block tag: pages are cut before every block tag.
PARAGRAPHS = rf"""seen AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script{_TAG}.*?</script{_TAG}|<style{_TAG}.*?</style{_TAG}', '', 'g') AS h FROM pages),
pieces AS (SELECT page_id, string_split(regexp_replace(h, '(?i)(</?(?:{B.BLOCK_TAGS}){_TAG})', chr(1) || '\1', 'g'), chr(1)) AS l FROM seen),
each_ AS (SELECT page_id, unnest(l) AS piece, unnest(generate_series(1, len(l))) AS n FROM pieces),
paragraphs AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS ordinal, regexp_matches(piece, '^(?i)<h1') AS heading,
  regexp_replace(regexp_replace(regexp_replace(piece, '^<[^>]*>', ''), '(?i)<br{_TAG}', ' ', 'g'), '<[a-zA-Z/!?][^>]*>', '', 'g') AS text FROM each_ WHERE regexp_matches(piece, '^(?i)<(h1|p){_TAG}'))"""


@contract(f"""WITH {PARAGRAPHS} SELECT page_id, ordinal, text, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS concept FROM paragraphs""")
def distill_forward_fill(spark, d):
    filled = B.forward_fill(B.html_paragraphs(table(spark, d, "pages")), "page_id", "ordinal", F.col("heading"), F.col("text"))
    return filled.select("page_id", "ordinal", "text", "concept")


# Retrieval


@contract(f"SELECT doc_id, unnest({_sql_t2('text')}) AS term FROM documents")
def tokens_t2(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(T.t2_terms(F.col("text"))).alias("term"))


@contract(f"WITH {_LINES}, bt AS (SELECT unnest({_sql_t1('text')}) AS term FROM blocks) SELECT term, count(*) AS blocks FROM bt GROUP BY term")
def term_block_frequency(spark, d):
    return R.block_frequency(R.block_terms(lines(spark, d)))


def _documents(spark, d) -> int:
    return table(spark, d, "documents").count()


@contract(f"WITH {_SCORES} SELECT item_id, doc_id, line_no, overlap, round(score, 6) AS score FROM scored")
def idf_scores(spark, d):
    return R.idf_scores(lines(spark, d), prompts(spark, d), _documents(spark, d))


def _ranked(spark, d, best=None, spread=False, bonused=False):
    return R.ranked(lines(spark, d), prompts(spark, d), _documents(spark, d), best, spread, bonused)


@contract(f"""WITH {_BONUS}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, line_no) AS rank FROM ranked)
SELECT item_id, doc_id, line_no, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def retrieve_topk(spark, d):
    return R.top_blocks(_ranked(spark, d, 20), 20).select("item_id", "doc_id", "line_no", "score", "rank")


@contract(f"""WITH {_BONUS}, o AS (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY score DESC, line_no) AS k FROM ranked),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CAST(k > 1 AS INTEGER), score DESC, doc_id, line_no) AS rank FROM o)
SELECT item_id, doc_id, line_no, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def retrieve_diverse(spark, d):
    return R.diverse_blocks(_ranked(spark, d, 20, True), 20).select("item_id", "doc_id", "line_no", "score", "rank")


@contract()
def retrieve_packed(spark, d):
    return R.packed(lines(spark, d), prompts(spark, d), _documents(spark, d), 20).drop("short")


@contract(f"WITH {_BONUS} SELECT item_id, doc_id, line_no, phrase_bonus, numeric_bonus, effective_bonus, score FROM ranked WHERE phrase_bonus + numeric_bonus + effective_bonus > 0")
def phrase_bonus(spark, d):
    return _ranked(spark, d, bonused=True).filter("phrase_bonus + numeric_bonus + effective_bonus > 0").select("item_id", "doc_id", "line_no", "phrase_bonus", "numeric_bonus", "effective_bonus", "score")


@contract(f"""WITH {_LINES}, h AS (SELECT *, starts_with(ltrim(text), '#') AS heading FROM blocks),
s AS (SELECT *, sum(CAST(heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM h),
n AS (SELECT doc_id, line_no, heading, list_filter([lead(line_no, 1) OVER w, lead(line_no, 2) OVER w, lag(line_no, 1) OVER w, lag(line_no, 2) OVER w], lambda x: x IS NOT NULL) AS near
  FROM s WINDOW w AS (PARTITION BY doc_id, section, heading ORDER BY line_no))
SELECT doc_id, line_no, CASE WHEN heading THEN '' ELSE array_to_string(near, ',') END AS neighbours FROM n""")
def context_window(spark, d):
    return R.context_window(lines(spark, d))


@contract("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), n AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND p_type = 'ECONOMY' AND p_size = 11),
p AS (SELECT DISTINCT l_suppkey FROM a WHERE l_partkey IN (SELECT p_partkey FROM n)) SELECT l_partkey, l_suppkey FROM a WHERE l_suppkey IN (SELECT l_suppkey FROM p)""")
def cohort_same_provider(spark, d):
    named = table(spark, d, "part").filter("p_brand = 'Brand#2' and p_type = 'ECONOMY' and p_size = 11").select(F.col("p_partkey").alias("l_partkey"))
    return R.cohort(table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct(), named, "l_partkey", "l_suppkey")


# Graph

_NODES = "SELECT 'r' || r_regionkey AS node FROM region UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier"
_EDGES = "SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier"
_WALK = f"WITH RECURSIVE e AS ({_EDGES}), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), walk(node) AS (SELECT 'r' || r_regionkey FROM region WHERE r_name = 'ASIA' UNION SELECT b FROM walk JOIN both_ ON a = node)"


def _star(spark, d) -> tuple[DataFrame, DataFrame]:
    tables = [table(spark, d, t) for t in ("region", "nation", "customer", "supplier")]
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r, n, c, s = tables
    nodes = r.select(name("r", "r_regionkey").alias("node")).unionAll(n.select(name("n", "n_nationkey"))).unionAll(c.select(name("c", "c_custkey"))).unionAll(s.select(name("s", "s_suppkey")))
    edges = n.select(name("r", "n_regionkey").alias("a"), name("n", "n_nationkey").alias("b")).unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).unionAll(s.select(name("n", "s_nationkey"), name("s", "s_suppkey")))
    return nodes, edges


def _walk(spark, d) -> DataFrame:
    roots = table(spark, d, "region").filter("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return G.reachable(_star(spark, d)[1], roots)


@contract(f"{_WALK} SELECT node FROM walk")
def graph_reachability(spark, d):
    return _walk(spark, d).select("node")


@contract(f"{_WALK} SELECT node FROM ({_NODES}) WHERE node NOT IN (SELECT node FROM walk)")
def graph_orphans(spark, d):
    return _star(spark, d)[0].join(_walk(spark, d).select("node"), "node", "left_anti")


@contract("SELECT o_orderkey AS edge_id, 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT o_orderkey, 'customer', o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def graph_dangling_edges(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("edge_id"), F.lit("customer").alias("source_kind"), F.col("o_custkey").alias("source_id"), F.lit("order").alias("target_kind"), F.col("o_orderkey").alias("target_id"))
    nodes = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionAll(table(spark, d, "lineitem").select(F.lit("order"), "l_orderkey").distinct())
    return G.dangling(edges, nodes).select("edge_id", "kind", "id")


@contract("""WITH a AS (SELECT s_nationkey AS n_nationkey, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS m FROM supplier GROUP BY 1)
SELECT n_nationkey, coalesce(n, 0) = coalesce(m, 0) AS equal FROM nation LEFT JOIN a USING (n_nationkey)""")
def graph_incident_edges(spark, d):
    edges = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.col("s_suppkey").cast("string").alias("edge"), "s_acctbal")
    declared = edges.filter("s_acctbal > 0").groupBy("n_nationkey").agg(F.collect_list("edge").alias("declared"))
    every = table(spark, d, "nation").select("n_nationkey").join(declared, "n_nationkey", "left").withColumn("declared", F.coalesce("declared", F.array().cast("array<string>")))
    return G.incident_equal(edges, every, "n_nationkey", "edge", "declared")


@contract(f"""WITH c AS (SELECT p_partkey AS claim_id, unnest({_sql_t2("p_name || ' ' || p_type || ' ' || p_brand")}) AS term FROM part),
p AS (SELECT DISTINCT n_nationkey AS item_id, unnest(CASE WHEN n_regionkey % 2 = 0 THEN ['red', 'widget', 'economy'] ELSE ['blue', 'bolt', 'small', 'brand'] END) AS term FROM nation),
s AS (SELECT item_id, claim_id, count(*) AS score FROM c JOIN p USING (term) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, claim_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 64""")
def graph_claim_query(spark, d):
    claims = table(spark, d, "part").select(F.col("p_partkey").alias("claim_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("item_id"), F.when(F.col("n_regionkey") % 2 == 0, "red widget economy").otherwise("blue bolt small brand").alias("text"))
    return G.claim_query(claims, asked, 64)


@contract("""WITH m AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0) SELECT o_orderkey AS edge_id, o_custkey AS source_id, o_orderkey AS target_id FROM orders
WHERE o_orderstatus = 'F' AND (o_custkey IN (SELECT id FROM m) OR o_orderkey IN (SELECT id FROM m))""")
def graph_conflict_projection(spark, d):
    edges = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("target_id"))
    return G.conflict_projection(edges, table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))).select("edge_id", "source_id", "target_id")


_SEGMENTS = ["MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]
_RANK = "CASE c_mktsegment " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(_SEGMENTS)) + " END"


@contract(f"SELECT c_nationkey, array_to_string(list_transform(list_sort(list_distinct(list({_RANK} || c_mktsegment))), lambda x: substr(x, 2)), ',') AS roles, arg_min(c_mktsegment, {_RANK}) AS leading FROM customer GROUP BY 1")
def role_precedence(spark, d):
    return G.precedence(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", _SEGMENTS)


@contract("""SELECT (SELECT count(*) FROM region) AS source_count, (SELECT count(*) FROM customer) AS claim_count, (SELECT count(*) FROM orders) AS edge_count,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS conflict_count, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS stale_count,
CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0 OR (SELECT count(*) FROM customer WHERE c_acctbal < 0) > 0 THEN 'investigate' ELSE 'pass' END AS result""")
def graph_inspection(spark, d):
    orders, customers = table(spark, d, "orders"), table(spark, d, "customer")
    return G.inspection({"source": table(spark, d, "region"), "claim": customers, "edge": orders}, orders.filter("o_orderstatus = 'P'"), customers.filter("c_acctbal < 0"))


@contract("""WITH refs AS (SELECT a.n_nationkey AS workspace, b.n_nationkey AS member FROM nation a JOIN nation b USING (n_regionkey)),
n AS (SELECT c_nationkey AS member, count(*) AS n FROM customer GROUP BY 1)
SELECT workspace, CAST(sum(n) FILTER (workspace = member) AS BIGINT) AS own, CAST(sum(n) AS BIGINT) AS visible FROM refs JOIN n USING (member) GROUP BY 1""")
def workspace_union_refs(spark, d):
    nation = table(spark, d, "nation")
    refs = nation.select(F.col("n_nationkey").alias("workspace"), "n_regionkey").join(nation.select(F.col("n_nationkey").alias("member"), "n_regionkey"), "n_regionkey")
    counts = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("member")).agg(F.count("*").alias("n"))
    return refs.join(counts, "member").groupBy("workspace").agg(F.sum(F.when(F.col("workspace") == F.col("member"), F.col("n"))).alias("own"), F.sum("n").alias("visible"))


@contract("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderpriority <> '1-URGENT' AS INTEGER), o_orderkey) AS position,
sum(CAST(o_orderpriority = '1-URGENT' AS INTEGER)) OVER (PARTITION BY o_custkey) > 5 AS saturated FROM orders) SELECT o_custkey, o_orderkey, CAST(position AS INTEGER) AS position, saturated FROM r WHERE position <= 5""")
def mandatory_first_cap(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return G.mandatory_first(rows, "o_custkey", F.col("o_orderpriority") == "1-URGENT", ["o_orderkey"], 5).drop("o_orderpriority")


@contract("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def evidence_except(spark, d):
    orders = table(spark, d, "orders")
    return orders.filter("o_orderstatus = 'O'").select("o_custkey").distinct().join(orders.filter("o_orderstatus = 'F'").select("o_custkey").distinct(), "o_custkey", "left_anti")


# Knowledge

_LOG = """log AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
linked AS (SELECT *, CASE WHEN event_type = 'error' THEN nullif(s // 2, 0) ELSE nullif(s - 1, 0) END AS p FROM log)"""


@contract(f"""WITH RECURSIVE {_LOG}, walk AS (SELECT user_id, max(s) AS s FROM linked GROUP BY 1 UNION ALL SELECT w.user_id, l.p FROM walk w JOIN linked l ON l.user_id = w.user_id AND l.s = w.s WHERE l.p IS NOT NULL)
SELECT user_id, event_id, CAST(s AS INTEGER) AS s FROM linked JOIN walk USING (user_id, s)""")
def knowledge_replay(spark, d):
    log = table(spark, d, "events").select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("s"))
    parent = F.nullif(F.when(F.col("event_type") == "error", F.floor(F.col("s") / 2)).otherwise(F.col("s") - 1).cast("int"), F.lit(0))
    return K.replay(log, "user_id", "s", parent).select("user_id", "event_id", "s")


@contract("""WITH c AS (SELECT o_custkey, count(*) AS entries, count(*) FILTER (o_orderstatus = 'F') AS legacy FROM orders GROUP BY 1)
SELECT *, CASE WHEN entries = 0 THEN 'empty' WHEN legacy = entries THEN 'legacy_only' WHEN legacy > 0 THEN 'mixed_version_partial' ELSE 'fully_answerable' END AS status FROM c""")
def knowledge_status(spark, d):
    return K.status(table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "legacy").otherwise("current").alias("version")), "o_custkey", "version")


@contract(f"""WITH {_LINES}, h AS (SELECT doc_id AS entry_id, line_no AS claim_id, array_to_string({_sql_words("text")}, ' ') AS normal FROM blocks),
t AS (SELECT entry_id, claim_id, unnest(list_distinct(string_split(normal, ' '))) AS term FROM h), a AS (SELECT item_id, array_to_string({_sql_words("text")}, ' ') AS prompt FROM benchmark),
w AS (SELECT item_id, unnest(list_distinct(string_split(prompt, ' '))) AS term FROM a),
s AS (SELECT item_id, entry_id, claim_id, count(*) AS hits FROM t JOIN w USING (term) WHERE term <> '' GROUP BY ALL),
x AS (SELECT item_id, entry_id, claim_id, CAST(normal = prompt AS INTEGER) AS exact, CAST(contains(normal, prompt) AS INTEGER) AS within, hits FROM s JOIN h USING (entry_id, claim_id) JOIN a USING (item_id)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY exact DESC, within DESC, hits DESC, entry_id, claim_id) AS INTEGER) AS rank FROM x) SELECT * FROM r WHERE rank <= 20""")
def knowledge_search(spark, d):
    return K.search(lines(spark, d).select(F.col("doc_id").alias("entry_id"), F.col("line_no").alias("claim_id"), "text"), prompts(spark, d), 20)


@contract(f"""WITH {_LINES}, n AS (SELECT doc_id, contains(' ' || array_to_string({_sql_words("text")}, ' ') || ' ', ' not ') AS negated FROM blocks)
SELECT doc_id, bool_or(negated) AND bool_or(NOT negated) AS contradict FROM n GROUP BY 1""")
def claims_contradict(spark, d):
    return K.contradict(lines(spark, d), "doc_id")


@contract("""WITH c AS (SELECT l_orderkey, round(sum(l_quantity * (100 - round(l_discount * 100))) / (100.0 * sum(l_quantity)), 6) AS coverage, bool_and(l_tax < 0.075) AS gates FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN gates AND coverage >= 0.9 THEN 'answer' WHEN NOT gates THEN 'refuse' WHEN coverage >= 0.5 THEN 'partial' ELSE 'replan' END AS decision FROM c""")
def coverage_score(spark, d):
    return K.coverage(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity"), 100 - F.round(F.col("l_discount") * 100), F.col("l_tax") < 0.075, scale=100.0)


_STATE = {"error": "contradictory", "purchase": "satisfied", "signup": "partial", "view": "stale", "click": "missing"}
_STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATE.items()) + " END"
_STATE_RANK = "CASE state " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(K.STATES)) + " END"


@contract(f"WITH s AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_STATE_SQL} AS state FROM events) SELECT user_id, day, arg_min(state, {_STATE_RANK}) AS status, count(*) AS events FROM s GROUP BY 1, 2")
def requirement_fold(spark, d):
    state = F.create_map(*[F.lit(x) for p in _STATE.items() for x in p])[F.col("event_type")]
    return K.fold_status(table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), state.alias("state")), ["user_id", "day"], F.col("state"))


@contract("""WITH p AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 10000 / l_quantity) AS BIGINT) AS priority FROM lineitem)
SELECT l_orderkey, max(priority) AS priority, arg_min(l_linenumber, (-priority, l_linenumber)) AS branch FROM p GROUP BY 1""")
def branch_priority(spark, d):
    return K.best_branch(table(spark, d, "lineitem"), "l_orderkey", F.col("l_extendedprice"), F.col("l_quantity"), "l_linenumber")


# Scoring, evaluation, monitoring

_PART = """p AS (SELECT *, least(1.0, greatest(0.0, (p_retailprice - 900) / (2000 - 900))) AS quality, least(1.0, greatest(0.0, (CAST(p_size AS DOUBLE) - 1) / (50 - 1))) AS size_cost FROM part)"""


def _scored_parts(spark, d):
    return table(spark, d, "part").withColumn("quality", M.clamp(F.col("p_retailprice"), 900, 2000)).withColumn("size_cost", M.clamp(F.col("p_size").cast("double"), 1, 50))


@contract(f"WITH {_PART} SELECT p_partkey, round(quality, 6) AS quality, round(size_cost, 6) AS size_cost FROM p")
def normalize_clamp(spark, d):
    return _scored_parts(spark, d).select("p_partkey", F.round("quality", 6).alias("quality"), F.round("size_cost", 6).alias("size_cost"))


@contract(f"""WITH {_PART}, s AS (SELECT p_brand, p_partkey, round((quality * 0.7 + CASE WHEN p_type = 'PROMO' THEN 1.0 ELSE 0.0 END * 0.3) / 1.0 - size_cost, 9) AS score FROM p)
SELECT p_brand, arg_min(p_partkey, (-score, p_partkey)) AS selected, round(max(score), 6) AS score FROM s GROUP BY 1""")
def parser_select(spark, d):
    promo = F.when(F.col("p_type") == "PROMO", 1.0).otherwise(0.0)
    rows = _scored_parts(spark, d).withColumn("promo", promo).withColumn("score", F.round(M.weighted({"quality": 0.7, "promo": 0.3}) - M.weighted({"size_cost": 1.0}), 9))
    return rows.groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("score"), F.col("p_partkey"))).alias("selected"), F.round(F.max("score"), 6).alias("score"))


@contract("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN NOT coalesce(p_size <= 40, false) THEN 'too_large' END, CASE WHEN NOT coalesce(p_retailprice < 1050, false) THEN 'too_dear' END, CASE WHEN NOT coalesce(p_type <> 'PROMO', false) THEN 'media_type' END], lambda x: x IS NOT NULL), ',') AS reasons FROM part""")
def eligibility_reasons(spark, d):
    return table(spark, d, "part").select("p_partkey", M.reasons({"too_large": F.col("p_size") <= 40, "too_dear": F.col("p_retailprice") < 1050, "media_type": F.col("p_type") != "PROMO"}).alias("reasons"))


@contract("""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 1 - l_discount END AS a, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_quantity / 50 END AS b FROM lineitem),
s AS (SELECT *, round((coalesce(a * 0.6, 0) + coalesce(b * 0.4, 0)) / nullif(CASE WHEN a IS NULL THEN 0.0 ELSE 0.6 END + CASE WHEN b IS NULL THEN 0.0 ELSE 0.4 END, 0), 6) AS score FROM q)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, score, CASE WHEN score IS NULL THEN 'exhausted' WHEN score >= 0.8 THEN 'accept' WHEN score >= 0.5 THEN 'intermediate' ELSE 'fallback' END AS decision FROM s""")
def quality_decision(spark, d):
    a, b = F.when(F.col("l_returnflag") != "R", 1 - F.col("l_discount")), F.when(F.col("l_linestatus") != "O", F.col("l_quantity") / 50)
    rows = table(spark, d, "lineitem").withColumn("a", a).withColumn("b", b).withColumn("score", F.round(M.weighted({"a": 0.6, "b": 0.4}), 6))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "score", F.when(F.col("score").isNull(), "exhausted").when(F.col("score") >= 0.8, "accept").when(F.col("score") >= 0.5, "intermediate").otherwise("fallback").alias("decision"))


@contract("""WITH c AS (SELECT l_orderkey, l_returnflag, CAST(coalesce(sum(CASE WHEN l_discount > 0.01 THEN CAST(l_quantity AS BIGINT) * l_linenumber END) // nullif(sum(CASE WHEN l_discount > 0.01 THEN l_linenumber END), 0), 0) AS BIGINT) AS composite FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2),
b AS (SELECT l_orderkey, CAST(coalesce(sum(composite) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS left_score, CAST(coalesce(sum(composite) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS right_score FROM c GROUP BY 1)
SELECT *, CASE WHEN left_score > right_score THEN 'A' WHEN left_score < right_score THEN 'N' ELSE 'tie' END AS winner FROM b""")
def evaluation_compare(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag in ('A', 'N')")
    both = M.composite(rows, ["l_orderkey", "l_returnflag"], F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_discount") > 0.01)
    return M.winners(both, "l_orderkey", "l_returnflag", "A", "N")


@contract("SELECT event_type, round(CAST(quantile_disc(value, 0.5) AS DOUBLE), 6) AS p50, round(CAST(quantile_disc(value, 0.95) AS DOUBLE), 6) AS p95, round(avg(value), 6) AS mean, count(*) AS samples FROM events GROUP BY 1")
def benchmark_percentiles(spark, d):
    return M.percentiles(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@contract("""WITH m AS (SELECT l_suppkey, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS before, round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS after FROM lineitem GROUP BY 1)
SELECT l_suppkey, before, after, round(before - after, 6) AS "drop" FROM m WHERE round(before - after, 6) > 0.5""")
def benchmark_regression(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))), 6).alias("f"), F.round(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 6).alias("o"))
    return M.regressions(rows.select("l_suppkey", F.col("f").alias("v")), rows.select("l_suppkey", F.col("o").alias("v")), "l_suppkey", "v", 0.5)


@contract("""WITH a AS (SELECT l_returnflag, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), b AS (SELECT l_returnflag, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT l_returnflag, a.v AS a, b.v AS b, round(b.v - a.v, 6) AS delta FROM a FULL JOIN b USING (l_returnflag)""")
def benchmark_compare(spark, d):
    rows = table(spark, d, "lineitem")
    side = lambda s: rows.filter(F.col("l_linestatus") == s).groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 6).alias("v"))
    return M.compare(side("F"), side("O"), "l_returnflag", "v")


@contract("""WITH day AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') * 10000 // count(*) AS error_bp, count(DISTINCT user_id) AS users FROM events GROUP BY 1),
x AS (SELECT day, round(mean - lag(mean) OVER w, 6) AS dm, error_bp - lag(error_bp) OVER w AS de, users - lag(users) OVER w AS du FROM day WINDOW w AS (ORDER BY day)),
v AS (SELECT *, list_filter([CASE WHEN abs(dm) > 3 THEN 'mean' END, CASE WHEN abs(de) > 200 THEN 'errors' END, CASE WHEN abs(du) > 10 THEN 'users' END], lambda q: q IS NOT NULL) AS o FROM x)
SELECT CAST(day AS VARCHAR) AS day, array_to_string(o, ',') AS violations, CASE WHEN len(o) > 1 OR abs(dm) > 6 OR abs(de) > 400 OR abs(du) > 20 THEN 'incident' WHEN len(o) = 1 THEN 'hold' ELSE 'clear' END AS verdict FROM v""")
def monitoring_verdict(spark, d):
    day = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("mean"), F.expr("count_if(event_type = 'error') * 10000 div count(*)").alias("error_bp"), F.countDistinct("user_id").alias("users"))
    before = day.select(F.date_add("day", 1).alias("day"), F.col("mean").alias("m0"), F.col("error_bp").alias("e0"), F.col("users").alias("u0"))  # the log has every day; a join needs no global window
    both = day.join(before, "day", "left")
    over, verdict = M.verdict({"mean": (F.round(F.col("mean") - F.col("m0"), 6), 3), "errors": (F.col("error_bp") - F.col("e0"), 200), "users": (F.col("users") - F.col("u0"), 10)})
    return both.select(F.date_format("day", "yyyy-MM-dd").alias("day"), over.alias("violations"), verdict.alias("verdict"))


_FRESH = """x AS (SELECT user_id, event_id, event_type, value, props, lag(event_type) OVER w AS t0, lag(value) OVER w AS v0, lag(props) OVER w AS p0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, list_filter([CASE WHEN event_type <> t0 THEN 'type_changed' END, CASE WHEN abs(value - v0) > 10 THEN 'value_changed' END, CASE WHEN props <> p0 THEN 'content_changed' END], lambda q: q IS NOT NULL) AS r FROM x),
z AS (SELECT user_id, event_id, array_to_string(r, ',') AS reasons, CASE WHEN event_type = 'error' THEN 'unavailable' WHEN event_type = 'signup' THEN 'superseded' WHEN len(r) = 0 THEN 'unchanged' WHEN len(r) = 1 THEN 'updated' ELSE 'investigate' END AS class FROM y)"""


def _fresh(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "props", F.lag("event_type").over(w).alias("t0"), F.lag("value").over(w).alias("v0"), F.lag("props").over(w).alias("p0"))
    why, kind = M.freshness({"type_changed": F.col("event_type") != F.col("t0"), "value_changed": F.abs(F.col("value") - F.col("v0")) > 10, "content_changed": F.col("props") != F.col("p0")}, F.col("event_type") == "error", F.col("event_type") == "signup")
    return rows.select("user_id", "event_id", why.alias("reasons"), kind.alias("class"))


@contract(f"WITH {_FRESH} SELECT * FROM z")
def freshness_classify(spark, d):
    return _fresh(spark, d)


_CLASSES = ["unchanged", "updated", "superseded", "unavailable", "investigate"]


@contract(f"WITH {_FRESH} SELECT user_id, {', '.join(f'''count(*) FILTER (class = '{c}') AS {c}''' for c in _CLASSES)}, bool_or(class <> 'unchanged') AS rebuild_required FROM z GROUP BY 1")
def freshness_summary(spark, d):
    return _fresh(spark, d).groupBy("user_id").agg(*[F.count_if(F.col("class") == c).alias(c) for c in _CLASSES], F.bool_or(F.col("class") != "unchanged").alias("rebuild_required"))


@contract("""SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-25 00:00:00' THEN 'future' WHEN ts < TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 7 DAY THEN 'too_old' ELSE 'accepted' END AS age FROM events""")
def observation_age_gate(spark, d):
    now = F.lit("2024-01-25 00:00:00").cast(table(spark, d, "events").schema["ts"].dataType)
    return table(spark, d, "events").select("event_id", F.when(F.col("ts") > now, "future").when(F.col("ts") < now - F.expr("interval 7 days"), "too_old").otherwise("accepted").alias("age"))


# Quality


def _t5(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@contract(f"""WITH {_LINES}, e AS (SELECT text, {_t5("text")} AS normal, count(*) AS c FROM blocks GROUP BY ALL)
SELECT normal, CAST(sum(c) AS BIGINT) AS copies, count(*) AS spellings, max(c) AS most_exact FROM e WHERE normal <> '' GROUP BY 1 HAVING sum(c) > 1""")
def quality_duplicates(spark, d):
    return Q.duplicates(lines(spark, d))


_FRAGMENT = r"(NOT regexp_matches(trim(text, ' '), '[.!?]$') OR regexp_matches(trim(text, ' '), '^\p{Ll}'))"


@contract(f"WITH {_LINES} SELECT doc_id, count(*) AS claims, count(*) FILTER ({_FRAGMENT}) AS fragments FROM blocks GROUP BY 1")
def quality_fragments(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("claims"), F.count_if(Q.fragment(F.col("text"))).alias("fragments"))


_CLAIMS = rf"""{_LINES}, s AS (SELECT doc_id, line_no, length(text) AS size, sha256(text) AS digest, CASE WHEN starts_with(text, '#') THEN 'heading' WHEN contains(text, '|') THEN 'table' WHEN regexp_matches(text, '^[-*0-9]') THEN 'list' ELSE 'paragraph' END AS block_type,
count(*) OVER (PARTITION BY doc_id, text) > 1 AS risk, count(*) OVER (PARTITION BY doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) > 1 AS copied, {_FRAGMENT} AS cut, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n,
row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, sha256(text), line_no) AS long_, row_number() OVER (PARTITION BY doc_id ORDER BY length(text), sha256(text), line_no) AS short_ FROM blocks)"""


@contract(f"""WITH {_CLAIMS}, t AS (SELECT *, CASE WHEN risk THEN 0 WHEN copied THEN 1 WHEN cut THEN 2 WHEN k IN (0, (n - 1) // 2, n - 1) THEN 3 WHEN long_ = 1 OR short_ = 1 THEN 4 ELSE 9 END AS a, least(12, n) AS q FROM s),
e AS (SELECT doc_id, line_no FROM t WHERE a < 9 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY a, digest, line_no) <= q),
y AS (SELECT doc_id, block_type, arg_min(line_no, (digest, line_no)) AS line_no, min(k) AS seen FROM t WHERE (doc_id, block_type) NOT IN (SELECT doc_id, block_type FROM t SEMI JOIN e USING (doc_id, line_no)) GROUP BY 1, 2),
u AS (SELECT t.*, CASE WHEN a < 9 THEN a WHEN y.seen IS NOT NULL THEN 5 ELSE 6 END AS tier, CASE WHEN a = 3 THEN k WHEN a = 4 AND long_ > 1 THEN 1 WHEN a = 9 AND y.seen IS NOT NULL THEN y.seen ELSE 0 END AS listed FROM t LEFT JOIN y USING (doc_id, line_no)),
c AS (SELECT doc_id, tier, count(*) AS many FROM u GROUP BY 1, 2), z AS (SELECT doc_id, tier, many, sum(many) OVER (PARTITION BY doc_id ORDER BY tier) - many AS used FROM c),
o AS (SELECT u.doc_id, line_no, digest, CASE WHEN n <= q THEN 6 ELSE u.tier END AS tier, CASE WHEN n <= q THEN k WHEN used + many <= q THEN listed ELSE 0 END AS place, q FROM u JOIN z ON z.doc_id = u.doc_id AND z.tier = u.tier)
SELECT doc_id, line_no, tier, ['binding_risk', 'normalized_duplicate', 'fragmentation', 'position', 'length', 'block_type_representative', 'digest_fill'][tier + 1] AS reason, row_number() OVER (PARTITION BY doc_id ORDER BY tier, place, digest, line_no) AS ordinal FROM o QUALIFY ordinal <= q""")
def quality_sample(spark, d):
    """Twelve lines of each document; a line stands for a claim, whose text names one block unless it is repeated."""
    return Q.tiered_sample(_claims(spark, d), 12, "doc_id").withColumnRenamed("claim", "line_no")


def _claims(spark, d):
    """Lines as claims, shuffled once, by document: as every window over them needs it."""
    text = F.col("text")
    kind = F.when(text.startswith("#"), "heading").when(text.contains("|"), "table").when(text.rlike("^[-*0-9]"), "list").otherwise("paragraph")
    digest = lambda x: F.unhex(F.sha2(x.cast("binary"), 256))
    slim = lines(spark, d).select("doc_id", F.col("line_no").alias("claim"), F.col("line_no").alias("ordinal_no"), F.length("text").alias("size"), kind.alias("block_type"), digest(text).alias("digest"), digest(T.t5_text(text)).alias("normal"), Q.fragment(text).alias("fragment"))
    # Equal texts are equal when normalised, so one order brings both kinds of copies together.
    order = Window.partitionBy("doc_id").orderBy("normal", "digest")
    copied = lambda c: F.coalesce((F.lag(c).over(order) == F.col(c)) | (F.lead(c).over(order) == F.col(c)), F.lit(False))
    return slim.repartition("doc_id").withColumns({"binding_risk": copied("digest"), "duplicate": copied("normal")}).drop("normal")


@contract(f"""WITH {_CLAIMS} SELECT doc_id, n AS claims, least(12, n) AS quota, 'sha256:' || sha256(CAST(to_json([CAST(doc_id AS VARCHAR), CAST(n AS VARCHAR), CAST(least(12, n) AS VARCHAR)]) AS VARCHAR)) AS policy_digest FROM s GROUP BY doc_id, n""")
def sampling_policy(spark, d):
    return Q.sampling_policy(lines(spark, d), "doc_id", 12)


@contract(f"""WITH d AS (SELECT doc_id, {_sql_words("text")} AS held FROM documents), q AS (SELECT item_id, {_sql_words("text")} AS asked FROM benchmark),
need AS (SELECT item_id, term, count(*) AS n FROM (SELECT item_id, unnest(asked) AS term FROM q) GROUP BY ALL), have AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(held) AS term FROM d) GROUP BY ALL),
size AS (SELECT item_id, count(*) AS k FROM need GROUP BY 1), g AS (SELECT item_id, doc_id, count(*) AS c FROM need JOIN have USING (term) WHERE have.n >= need.n GROUP BY ALL),
m AS (SELECT item_id, doc_id FROM g JOIN size USING (item_id) WHERE c = k)
SELECT item_id, doc_id AS claim, CASE WHEN contains(' ' || array_to_string(held, ' ') || ' ', ' ' || array_to_string(asked, ' ') || ' ') THEN 'phrase' ELSE 'multiset' END AS kind FROM m JOIN d USING (doc_id) JOIN q USING (item_id)""")
def question_match(spark, d):
    return Q.question_match(prompts(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("claim"), "text"))


@contract("""WITH s AS (SELECT o_custkey, coalesce(list(DISTINCT month(o_orderdate)) FILTER (o_orderstatus = 'F'), []) AS a, coalesce(list(DISTINCT month(o_orderdate)) FILTER (o_orderstatus = 'O'), []) AS b FROM orders GROUP BY 1),
n AS (SELECT o_custkey, len(list_intersect(a, b)) AS i, len(a) + len(b) - len(list_intersect(a, b)) AS u FROM s)
SELECT o_custkey, CAST(CASE WHEN u = 0 THEN 1000000 ELSE i * 1000000 // u END AS BIGINT) AS similarity FROM n""")
def jaccard_millionths(spark, d):
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(*[F.collect_set(F.when(F.col("o_orderstatus") == s, F.month("o_orderdate"))).alias(a) for s, a in (("F", "a"), ("O", "b"))])
    return sets.select("o_custkey", Q.jaccard_millionths(F.col("a"), F.col("b")).alias("similarity"))


@contract("""WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) * 10000 // count(*) AS useful_bp, count(*) FILTER (toxic = 1) * 10000 // count(*) AS duplicate_bp, count(*) FILTER (length(text) < 200) * 10000 // count(*) AS fragment_bp FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT *, CASE WHEN useful_bp >= 9000 AND duplicate_bp <= 500 AND fragment_bp <= 500 THEN 'pass' WHEN useful_bp >= 7000 THEN 'hold' ELSE 'reject' END AS decision FROM r""")
def quality_result(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("size")), "doc_id")
    return Q.decision(rows, "source", F.col("quality") == 1, F.col("toxic") == 1, F.col("size") < 200)


# Governance


@contract("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'accepted' WHEN role = 'user' THEN 'rejected' ELSE 'unreviewed' END AS status FROM r WHERE k = 1""")
def review_status(spark, d):
    last = V.latest(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn")])
    return last.select("conv_id", "turn", F.when(F.col("role") == "assistant", "accepted").when(F.col("role") == "user", "rejected").otherwise("unreviewed").alias("status"))


_CHAIN = "c AS (SELECT conv_id, turn, sha256(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text)) AS event_digest FROM conversations), h AS (SELECT *, lag(event_digest) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_digest FROM c)"


def _chain(spark, d):
    record = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text")
    return V.chain(table(spark, d, "conversations"), "conv_id", "turn", record).select("conv_id", "turn", "event_digest", "previous_digest")


@contract(f"WITH {_CHAIN} SELECT * FROM h")
def chain_digests(spark, d):
    return _chain(spark, d)


@contract(f"""WITH {_CHAIN}, t AS (SELECT * FROM h WHERE turn <> 2), f AS (SELECT *, row_number() OVER w AS k, min(turn) OVER (PARTITION BY conv_id) AS m, lag(event_digest) OVER w AS l FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn FROM f WHERE turn <> m + k - 1 OR previous_digest IS DISTINCT FROM l""")
def chain_verify(spark, d):
    """A log from which one turn is cut must show where the chain breaks."""
    return V.chain_faults(_chain(spark, d).filter("turn <> 2"), "conv_id", "turn").select("conv_id", "turn")


_ALLOWED = [("start", "view"), ("start", "signup"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("signup", "view"), ("view", "purchase"), ("purchase", "click"), ("signup", "click")]


@contract(f"""WITH s AS (SELECT user_id, event_id, event_type, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'start') AS before FROM events)
SELECT user_id, event_id, before, event_type FROM s WHERE (before, event_type) NOT IN ({', '.join(str(p) for p in _ALLOWED)})""")
def audit_transitions(spark, d):
    allowed = spark.createDataFrame(_ALLOWED, "before string, after string")
    return V.transitions(table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], "event_type", allowed).select("user_id", "event_id", "before", "event_type")


@contract("""SELECT o_orderdate, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND (o_orderdate, o_orderkey) > (TIMESTAMP '1998-01-01 00:00:00', 0) ORDER BY 1, 2 LIMIT 50""")
def queue_page(spark, d):
    rows = table(spark, d, "orders")
    return G.keyset_page(rows, ["o_orderdate", "o_orderkey"], ("1998-01-01 00:00:00", 0), 50, F.col("o_orderstatus") == "O").select("o_orderdate", "o_orderkey", "o_totalprice")


@contract("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_id, event_type, value FROM r WHERE k = 1")
def generation_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    early = F.col("event_id") % 2 == 0
    return V.upsert(rows.filter(early), rows.filter(~early), "user_id", "event_id")


@contract("""WITH s AS (SELECT source, CASE WHEN length(text) < 100 THEN 'rejected' WHEN lang = 'en' THEN 'unchanged' ELSE 'created' END AS state FROM documents),
c AS (SELECT source, count(*) FILTER (state = 'created') AS created, count(*) FILTER (state = 'unchanged') AS unchanged, count(*) FILTER (state = 'rejected') AS rejected FROM s GROUP BY 1) SELECT *, CASE WHEN rejected = 0 THEN 'completed' ELSE 'partial' END AS result FROM c""")
def batch_readback(spark, d):
    state = F.when(F.length("text") < 100, "rejected").when(F.col("lang") == "en", "unchanged").otherwise("created")
    return V.readback(table(spark, d, "documents").select("source", state.alias("state")), "source", "state")


@contract(f"WITH {_LINES} SELECT doc_id, count(*) AS passages, count(*) FILTER (substr(d.text, CAST(b.start AS INTEGER) + 1, length(b.text)) = b.text) AS exact FROM blocks b JOIN documents d USING (doc_id) GROUP BY 1")
def export_verify(spark, d):
    both = lines(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("source_text")), "doc_id")
    exact = F.expr("substring(source_text, cast(start as int) + 1, length(text)) = text")
    return both.groupBy("doc_id").agg(F.count("*").alias("passages"), F.count_if(exact).alias("exact"))


_FLAGS = "[" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in S.PATTERNS.items()) + "]"


@contract(f"SELECT doc_id, array_to_string(list_filter({_FLAGS}, lambda x: x IS NOT NULL), ',') AS reasons FROM documents")
def safety_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", S.flags(F.col("text")).alias("reasons"))


@contract(f"""WITH {_LINES}, x AS (SELECT doc_id, line_no, start + (line_no % 2) AS start, b.text AS excerpt, d.text AS content FROM blocks b JOIN documents d USING (doc_id)),
y AS (SELECT *, strpos(content, excerpt) AS once FROM x)
SELECT doc_id, line_no, CASE WHEN substr(content, CAST(start AS INTEGER) + 1, length(excerpt)) = excerpt THEN 'verified' WHEN once = 0 THEN 'unavailable' WHEN strpos(substr(content, once + 1), excerpt) > 0 THEN 'ambiguous' ELSE 'unique' END AS match FROM y""")
def span_ladder(spark, d):
    both = lines(spark, d).join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id").withColumn("start", (F.col("start") + F.col("line_no") % 2).cast("int"))
    return both.select("doc_id", "line_no", S.span_ladder(F.col("content"), F.col("text"), F.col("start"), F.col("start") + F.length("text")).alias("match"))


# Layout


def _boxes(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"), F.min("l_suppkey").alias("y"))
    return rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("box"), (F.col("p") % 1000).alias("l"), (F.col("p") % 1000 + F.col("q") * 4).alias("r"), (F.col("y") % 100).alias("t"), (F.col("y") % 100 + 10).alias("b"))


_BOXES = "x AS (SELECT l_orderkey AS page, l_linenumber AS box, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q, min(l_suppkey) AS y FROM lineitem GROUP BY ALL), boxes AS (SELECT page, box, p % 1000 AS l, p % 1000 + q * 4 AS r, y % 100 AS t, y % 100 + 10 AS b FROM x)"


@contract(f"""WITH {_BOXES}, f AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY page ORDER BY l, r, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > l THEN 0 ELSE 1 END AS fresh FROM boxes)
SELECT page, box, l, r, t, b, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY l, r, box) AS BIGINT) AS col FROM f""")
def ocr_columns(spark, d):
    return L.columns(_boxes(spark, d), "page")


@contract(f"""WITH RECURSIVE {_BOXES}, f AS (SELECT *, CASE WHEN max(r) OVER (PARTITION BY page ORDER BY l, r, box ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > l THEN 0 ELSE 1 END AS fresh FROM boxes),
c AS (SELECT page, box, l, r, t, b, CAST(sum(fresh) OVER (PARTITION BY page ORDER BY l, r, box) AS BIGINT) AS col FROM f), s AS (SELECT *, row_number() OVER (PARTITION BY page, col ORDER BY t, l, box) AS k FROM c),
w AS (SELECT page, box, l, r, t, b, col, k, t AS top, b AS bottom, CAST(1 AS BIGINT) AS line FROM s WHERE k = 1
UNION ALL SELECT page, box, l, r, t, b, col, k, CASE WHEN joins THEN top ELSE t END, CASE WHEN joins THEN bottom ELSE b END, CASE WHEN joins THEN line ELSE line + 1 END FROM (
  SELECT s.*, w.top, w.bottom, w.line, least(s.b, w.bottom) > greatest(s.t, w.top) AND 2 * (least(s.b, w.bottom) - greatest(s.t, w.top)) >= least(s.b - s.t, w.bottom - w.top) AS joins FROM w JOIN s ON s.page = w.page AND s.col = w.col AND s.k = w.k + 1))
SELECT page, box, l, r, t, b, col, line FROM w""")
def ocr_lines(spark, d):
    return L.lines(L.columns(_boxes(spark, d), "page"), "page")


@contract(f"WITH {_BOXES} SELECT page, box, abs(CAST((l * t - r * t) + (r * b - r * t) + (r * (b + 3) - (l + 2) * b) + ((l + 2) * t - l * (b + 3)) AS DOUBLE)) / 2 AS area FROM boxes")
def polygon_area(spark, d):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    l, r, t, b = (F.col(c) for c in "lrtb")
    return _boxes(spark, d).select("page", "box", L.area(F.array(point(l, t), point(r, t), point(r, b), point(l + 2, b + 3))).alias("area"))


@contract("""WITH p AS (SELECT p_partkey, p_name, p_type || ' ' || p_name AS other FROM part)
SELECT p_partkey, CAST(greatest(0, greatest(length(p_name), length(other), 1) - levenshtein(p_name, other)) * 1000000 // greatest(length(p_name), length(other), 1) AS BIGINT) AS accuracy FROM p""")
def edit_accuracy(spark, d):
    return table(spark, d, "part").select("p_partkey", L.edit_accuracy(F.col("p_name"), F.concat_ws(" ", "p_type", "p_name")).alias("accuracy"))


@contract("""WITH c AS (SELECT conv_id, turn, length(text) * 100 + turn AS a FROM conversations), p AS (SELECT x.conv_id, count(*) AS pairs, count(*) FILTER (x.a < y.a) AS good FROM c x JOIN c y ON x.conv_id = y.conv_id AND x.turn < y.turn GROUP BY 1)
SELECT conv_id, coalesce(pairs, 0) AS pairs, CAST(CASE WHEN coalesce(pairs, 0) = 0 THEN 1000000 ELSE good * 1000000 // pairs END AS BIGINT) AS accuracy FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)""")
def pair_order_accuracy(spark, d):
    return L.order_accuracy(table(spark, d, "conversations").withColumn("a", F.length("text") * 100 + F.col("turn")), "conv_id", "turn", "a")


# Identities


@contract("SELECT doc_id, 'sha256:' || sha256(CAST(to_json([CAST(doc_id AS VARCHAR), lang, source, text]) AS VARCHAR)) AS evidence_id FROM documents")
def evidence_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", T.digest(F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")).alias("evidence_id"))


@contract(f"""WITH {_LINES} SELECT doc_id, line_no, 'claim-' || substr(sha256(CAST(to_json([CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR), text]) AS VARCHAR)), 1, 24) AS claim_id, 'citation-' || substr(sha256(CAST(to_json([CAST(doc_id AS VARCHAR), CAST(start AS VARCHAR), CAST("end" AS VARCHAR)]) AS VARCHAR)), 1, 24) AS citation_id FROM blocks""")
def selection_targets(spark, d):
    claim = T.digest(F.col("doc_id"), F.col("line_no"), F.col("text"))
    citation = T.digest(F.col("doc_id"), F.col("start"), F.col("end"))
    return lines(spark, d).select("doc_id", "line_no", F.concat(F.lit("claim-"), F.substring(claim, 8, 24)).alias("claim_id"), F.concat(F.lit("citation-"), F.substring(citation, 8, 24)).alias("citation_id"))


@contract("""WITH l AS (SELECT l_orderkey, string_agg(l_partkey || '/' || l_suppkey || ' [' || l_linenumber || ']', chr(10) ORDER BY l_partkey, l_suppkey, l_linenumber) AS answer FROM lineitem GROUP BY 1) SELECT * FROM l""")
def synthesis(spark, d):
    ledger = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("place"), F.concat(F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("text"), F.col("l_linenumber").cast("string").alias("citation_id"))
    return K.synthesise(ledger, "l_orderkey", "place")
