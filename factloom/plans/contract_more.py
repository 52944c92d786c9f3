"""Contract queries of the semantics, navigation, ingestion and remaining layout operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import ingest as I
from factloom.operators import layout as L
from factloom.operators import navigation as N
from factloom.operators import semantics as X
from factloom.operators.graph import checkpointed
from factloom.plans.contract import _LINES, ORACLE, _boxes, _sql_words, contract, lines, table


@contract(rf"""WITH {_LINES}, b AS (SELECT doc_id, line_no, text, contains(text, '|') AS bar FROM blocks),
g AS (SELECT *, CASE WHEN bar THEN row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - row_number() OVER (PARTITION BY doc_id, bar ORDER BY line_no) ELSE -1 - line_no END AS run FROM b),
t AS (SELECT doc_id, min(line_no) AS line_no, bar, string_agg(text, chr(10) ORDER BY line_no) AS text, count(*) AS n, count(DISTINCT len(string_split(text, '|'))) AS widths FROM g GROUP BY doc_id, bar, run)
SELECT doc_id, line_no, n AS lines, regexp_matches(trim(text, ' '), '^(?i)(page *)?[0-9]+( *(of|/) *[0-9]+)?$') OR contains(text, chr(65533)) OR (bar AND (n < 2 OR widths > 1)) AS artifact FROM t""")
def layout_artifacts(spark, d):
    """Lines with bars that follow one another are a table, all others paragraphs."""
    place, bar = Window.partitionBy("doc_id").orderBy("line_no"), F.col("text").contains("|")
    run = F.when(bar, F.row_number().over(place) - F.row_number().over(Window.partitionBy("doc_id", bar).orderBy("line_no"))).otherwise(-1 - F.col("line_no"))
    rows = lines(spark, d).select("doc_id", "line_no", "text", bar.alias("bar")).withColumn("run", run)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    blocks = rows.groupBy("doc_id", "bar", "run").agg(F.min("line_no").alias("line_no"), text.alias("text"), F.count("*").alias("lines"))
    return blocks.select("doc_id", "line_no", "lines", X.layout_artifact(F.when(F.col("bar"), "table").otherwise("paragraph"), F.col("text")).alias("artifact"))


@contract(f"""WITH {_LINES}, w AS (SELECT doc_id, line_no, text, list_filter({_sql_words("text")}, lambda x: length(x) >= 3) AS t FROM blocks),
c AS (SELECT doc_id || ':' || line_no AS claim_id, text, t[1] AS term, line_no % 3 = 0 AS copied, line_no % 7 = 0 AS cut, t FROM w WHERE len(t) > 0),
k AS (SELECT *, CASE WHEN copied THEN 'the same words' ELSE array_to_string(t, ' ') END AS reason FROM c),
n AS (SELECT reason, count(DISTINCT term) AS topics FROM k GROUP BY 1)
SELECT claim_id, array_to_string(list_filter([CASE WHEN cut THEN 'excerpt_binding' END, CASE WHEN copied AND NOT contains(' the same words ', ' ' || term || ' ') THEN 'topic_mismatch' END, CASE WHEN topics <> 1 THEN 'copied_rationale' END], lambda x: x IS NOT NULL), ',') AS reasons FROM k JOIN n USING (reason)""")
def semantic_review(spark, d):
    """Claims are lines; every third review has a copied rationale, every seventh excerpt is not its block's text."""
    terms = T.t4_terms(F.col("text"))
    claim = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("line_no").cast("string"))
    rows = lines(spark, d).select(claim.alias("claim_id"), "line_no", "text", terms.alias("terms")).filter(F.size("terms") > 0)
    rows = checkpointed(rows)  # three tables are made of it
    claims = rows.select("claim_id", F.col("text").alias("excerpt"), F.col("claim_id").alias("anchor"), F.slice("terms", 1, 1).alias("terms"))
    reviews = rows.select("claim_id", F.col("claim_id").alias("block_id"), F.when(F.col("line_no") % 3 == 0, "the same words").otherwise(F.array_join("terms", " ")).alias("rationale"))
    blocks = rows.select(F.col("claim_id").alias("block_id"), F.lit("paragraph").alias("type"), F.when(F.col("line_no") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    return X.review(claims, reviews, blocks)


@contract("SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    return X.repeated_keys(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@contract("""WITH t AS (SELECT DISTINCT c_custkey AS k, 'customer' AS side FROM customer UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders UNION ALL SELECT DISTINCT user_id, 'events' FROM events)
SELECT k, array_to_string(list_sort(list(side)), ',') AS present FROM t GROUP BY 1 HAVING count(*) < 3""")
def set_equality(spark, d):
    side = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    return X.set_difference({"customer": side("customer", "c_custkey"), "orders": side("orders", "o_custkey"), "events": side("events", "user_id")}, "k")


@contract("""WITH d AS (SELECT n_nationkey AS workspace, CASE WHEN n_nationkey % 4 = 0 THEN 'reference' ELSE 'property' END AS kind FROM nation),
r AS (SELECT a.n_nationkey AS workspace, b.n_nationkey AS reference FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey % 3 = 0 AND b.n_nationkey > a.n_nationkey)
SELECT r.workspace, reference FROM r LEFT JOIN d ON d.workspace = reference WHERE coalesce(kind, '') <> 'reference' OR reference IN (SELECT workspace FROM r)""")
def registry_references(spark, d):
    nation = table(spark, d, "nation")
    definitions = nation.select(F.col("n_nationkey").alias("workspace"), F.when(F.col("n_nationkey") % 4 == 0, "reference").otherwise("property").alias("kind"))
    left, right = nation.select(F.col("n_nationkey").alias("workspace"), "n_regionkey").filter("workspace % 3 = 0"), nation.select(F.col("n_nationkey").alias("reference"), "n_regionkey")
    return X.indirect_references(definitions, left.join(right, "n_regionkey").filter("reference > workspace").select("workspace", "reference"))


@contract("""WITH then_ AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) % 7 AS v FROM events GROUP BY 1), now_ AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, min(event_id) % 7 AS v FROM events WHERE user_id % 10 <> 3 GROUP BY 1)
SELECT user_id, CASE WHEN n.user_id IS NULL THEN 'missing' ELSE 'changed' END AS state FROM then_ t LEFT JOIN now_ n USING (user_id) WHERE n.user_id IS NULL OR t.event_type IS DISTINCT FROM n.event_type OR t.v IS DISTINCT FROM n.v""")
def snapshot_drift(spark, d):
    events = table(spark, d, "events")
    side = lambda rows, pick: rows.groupBy("user_id").agg(pick("event_type", "event_id").alias("event_type"), (F.min("event_id") % 7).alias("v"))
    return X.drift(side(events, F.min_by), side(events.filter("user_id % 10 <> 3"), F.max_by), "user_id", ["event_type", "v"])


@contract("""WITH s AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000), p AS (SELECT DISTINCT o_custkey AS a, l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT a, b FROM p WHERE a IN (SELECT id FROM s) AND b IN (SELECT id FROM s)""")
def cross_workspace_conflicts(spark, d):
    pairs = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return X.linked_pairs(pairs, table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("id")), "a", "b").select("a", "b")


_STATES = {"error": "contradictory", "purchase": "satisfied", "signup": "partial", "view": "stale", "click": "missing"}


@contract()
def navigator_trace(spark, d):
    """Each user's day is a query, each event a visit."""
    state = F.create_map(*[F.lit(x) for p in _STATES.items() for x in p])[F.col("event_type")]
    visits = table(spark, d, "events").withColumn("query_id", F.concat(F.col("user_id").cast("string"), F.lit("/"), F.date_format("ts", "yyyy-MM-dd")))
    visits = visits.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "event_id")).alias("step"), F.col("event_id").alias("node"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("requirement"), state.alias("status"), (F.col("event_id") % 500).cast("int").alias("tokens"))
    requirements = visits.select("query_id").distinct().select("query_id", F.explode(F.array(*[F.struct(F.lit(f"r{k}").alias("requirement"), F.lit(float(k + 1)).alias("weight")) for k in range(3)])).alias("r")).select("query_id", "r.*")
    return N.navigate(visits, requirements, 0.8, 200, 2000)


@contract("""WITH c AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS item, source, text, sha256(coalesce(text, '')) AS digest FROM documents),
q AS (SELECT doc_id, sum(length(line)) AS covered FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE trim(line, ' ') <> '' GROUP BY 1),
x AS (SELECT c.*, round(least(1.0, CAST(coalesce(covered, 0) AS DOUBLE) / greatest(1, length(trim(coalesce(text, ''), ' ')))), 6) < 0.5 AS bad, digest IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE lang = 'fr') AS known FROM c LEFT JOIN q USING (doc_id))
SELECT source, CAST(item AS INTEGER) AS item, doc_id, CASE WHEN text IS NULL OR bad THEN 'rejected' WHEN known THEN 'unchanged' ELSE 'created' END AS state, CASE WHEN text IS NULL THEN 'source_missing' WHEN bad THEN 'quality_gate' ELSE '' END AS reason FROM x""")
def batch_items(spark, d):
    docs = table(spark, d, "documents")
    manifest = I.numbered(docs.select("doc_id", "source"), "source", ["doc_id"])
    done = I.items(manifest, docs, docs.filter("lang = 'fr'").select(T.digest(F.col("text")).alias("digest")))
    return manifest.select("doc_id", "source").join(done, "doc_id").select("source", "item", "doc_id", "state", "reason")


@contract("WITH RECURSIVE i AS (" + ORACLE["batch_items"] + """), c AS (SELECT source, item, sha256('|' || item || '|' || state) AS checkpoint FROM i WHERE item = 1 UNION ALL SELECT i.source, i.item, sha256(checkpoint || '|' || i.item || '|' || state) FROM c JOIN i ON i.source = c.source AND i.item = c.item + 1) SELECT * FROM c""")
def batch_checkpoints(spark, d):
    """The states of batch items, chained source by source."""
    return I.checkpoint_chain(batch_items(spark, d), "source")


@contract(f"""WITH {_LINES} SELECT doc_id, line_no, coalesce(last_value(CASE WHEN starts_with(ltrim(text), '#') THEN trim(regexp_replace(text, '^[# ]+', ''), ' ') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS concept,
CASE WHEN length(text) <= 512 THEN text END AS text, 'claim-' || substr(sha256(CAST(to_json([CAST(doc_id AS VARCHAR), CAST(line_no AS VARCHAR), blocks.text]) AS VARCHAR)), 1, 24) AS claim_id FROM blocks QUALIFY NOT starts_with(ltrim(blocks.text), '#')""")
def distilled_claims(spark, d):
    return I.distil(lines(spark, d))


@contract("""WITH g AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'A') AS g, count(*) FILTER (l_returnflag = 'R') AS u, count(*) FILTER (l_linestatus = 'O' AND l_quantity > 45) AS f FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey, coalesce(g, 0) AS g, coalesce(u, 0) AS u, coalesce(f, 0) AS f FROM orders LEFT JOIN g ON k = o_orderkey)
SELECT o_orderkey, CASE WHEN f > 0 AND u > 0 THEN 'recovered' WHEN f > 1 OR u > 1 THEN 'investigate' WHEN u > 0 AND g > 0 THEN 'applied' WHEN g > 0 THEN 'authorised' WHEN u > 0 OR f > 0 THEN 'investigate' ELSE 'prepared' END AS state FROM p""")
def promotion_status(spark, d):
    items = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return I.terminal_status(table(spark, d, "orders"), items.filter("l_returnflag = 'A'"), items.filter("l_returnflag = 'R'"), items.filter("l_linestatus = 'O' and l_quantity > 45"), "o_orderkey")


@contract("""WITH x AS (SELECT l_orderkey AS page, l_linenumber AS box, min(l_partkey) AS p, CAST(min(l_quantity) AS BIGINT) AS q, min(l_suppkey) AS y FROM lineitem GROUP BY ALL), b AS (SELECT page, box, p % 1000 AS l, p % 1000 + q * 4 AS r, y % 100 AS t, y % 100 + 10 AS b FROM x),
c AS (SELECT m.page, m.box AS one, n.box AS two, greatest(0, least(m.r, n.r) - greatest(m.l, n.l)) * greatest(0, least(m.b, n.b) - greatest(m.t, n.t)) AS i, (m.r - m.l) * (m.b - m.t) + (n.r - n.l) * (n.b - n.t) AS s FROM b m JOIN b n ON m.page = n.page AND n.box = m.box + 1)
SELECT page, one, two, round(CASE WHEN s - i > 0 THEN CAST(i AS DOUBLE) / (s - i) ELSE 0.0 END, 6) AS overlap FROM c""")
def box_overlaps(spark, d):
    one = _boxes(spark, d)
    two = one.select("page", (F.col("box") - 1).alias("box"), *[F.col(c).alias(f"{c}2") for c in "lrtb"])
    share = L.box_overlap(*[F.col(c) for c in ("l", "t", "r", "b", "l2", "t2", "r2", "b2")])
    return one.join(two, ["page", "box"]).select("page", F.col("box").alias("one"), (F.col("box") + 1).alias("two"), F.round(share, 6).alias("overlap"))


_READ = """e AS (SELECT p_partkey // 8 AS page, p_partkey AS place, p_name AS text, CAST(p_size AS DOUBLE) AS l, CAST(p_partkey % 8 * 20 AS DOUBLE) AS t FROM part),
a AS (SELECT page, 1000000 - place AS place, translate(text, 'aeou', 'oeaa') || CASE WHEN place % 3 = 0 THEN ' x' ELSE '' END AS text, l + place % 4 AS l, t + place % 3 AS t FROM e WHERE place % 7 <> 0
  UNION ALL SELECT p_partkey // 8, p_partkey, p_type, CAST(p_size + 5 AS DOUBLE), CAST(p_partkey % 8 * 20 AS DOUBLE) FROM part WHERE p_partkey % 11 = 0)"""
_MATCHED = f"""{_READ}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY place) AS n FROM e), h AS (SELECT page, list({{'p': place, 'x': text, 'l': l, 't': t}}) AS held FROM a GROUP BY 1),
w AS (SELECT page, CAST(0 AS BIGINT) AS n, []::BIGINT[] AS taken, CAST(NULL AS BIGINT) AS expected, CAST(NULL AS BIGINT) AS actual, CAST(NULL AS BIGINT) AS distance, CAST(NULL AS DOUBLE) AS overlap FROM h
UNION ALL SELECT page, n, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.p) END, CASE WHEN b IS NULL THEN NULL ELSE place END, b.p, b.d, round(-b.o, 6) FROM (
  SELECT k.page, k.n, taken, k.place, list_sort(list_transform(list_filter(held, lambda x: NOT list_contains(taken, x.p)), lambda x: {{'d': levenshtein(k.text, x.x), 'o': -round(greatest(0.0, 30 - abs(k.l - x.l)) * greatest(0.0, 10 - abs(k.t - x.t)) / (600 - greatest(0.0, 30 - abs(k.l - x.l)) * greatest(0.0, 10 - abs(k.t - x.t))), 9), 'p': x.p}}))[1] AS b
  FROM w JOIN k ON k.page = w.page AND k.n = w.n + 1 JOIN h ON h.page = w.page)),
m AS (SELECT page, expected, actual, distance, overlap FROM w WHERE expected IS NOT NULL)"""


def _read(spark, d):
    """Parts are lines, eight to a page; they are read back to front with other vowels, one in seven lost, and some lines are invented."""
    box = lambda l, t: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((l, t), (l + 30, t), (l + 30, t + 10), (l, t + 10))])
    part = table(spark, d, "part").withColumn("page", F.floor(F.col("p_partkey") / 8))
    place, l, t = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 8 * 20
    expected = part.select("page", place.alias("place"), F.col("p_name").alias("text"), box(l, t).alias("polygon"))
    heard = F.concat(F.translate("p_name", "aeou", "oeaa"), F.when(place % 3 == 0, " x").otherwise(""))
    actual = part.filter("p_partkey % 7 <> 0").select("page", (1_000_000 - place).alias("place"), heard.alias("text"), box(l + place % 4, t + place % 3).alias("polygon"))
    invented = part.filter("p_partkey % 11 = 0").select("page", place.alias("place"), F.col("p_type").alias("text"), box(l + 5, t).alias("polygon"))
    return expected, actual.unionByName(invented)


@contract(f"WITH RECURSIVE {_MATCHED} SELECT * FROM m")
def line_matches(spark, d):
    return L.match_lines(*_read(spark, d), "page")


@contract(f"""WITH RECURSIVE {_MATCHED}, f AS (SELECT *, page // 5 AS attempt FROM m), te AS (SELECT page // 5 AS attempt, string_agg(text, chr(10) ORDER BY page, place) AS x, count(*) AS n, count(DISTINCT page) AS pages FROM e GROUP BY 1), ta AS (SELECT page // 5 AS attempt, string_agg(text, chr(10) ORDER BY page, place) AS x, count(*) AS n FROM a GROUP BY 1),
o AS (SELECT x.attempt, count(*) AS pairs, count(*) FILTER ((x.page, x.actual) < (y.page, y.actual)) AS good FROM (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY page, expected) AS i FROM f) x JOIN (SELECT *, row_number() OVER (PARTITION BY attempt ORDER BY page, expected) AS i FROM f) y ON x.attempt = y.attempt AND x.i < y.i GROUP BY 1),
g AS (SELECT attempt, count(*) AS n, avg(overlap) AS overlap, count(DISTINCT page) AS pages FROM f GROUP BY 1)
SELECT attempt, greatest(length(te.x), length(ta.x), 1) AS whole, CAST((greatest(length(te.x), length(coalesce(ta.x, '')), 1) - levenshtein(te.x, coalesce(ta.x, ''))) * 1000000 // greatest(length(te.x), length(coalesce(ta.x, '')), 1) AS BIGINT) AS char_accuracy,
coalesce(g.n, 0) * 1000000 // greatest(1, coalesce(ta.n, 0)) AS precision, coalesce(g.n, 0) * 1000000 // greatest(1, te.n) AS recall, coalesce(good * 1000000 // pairs, 1000000) AS order_accuracy, CAST(floor(round(coalesce(overlap, 0) * 1000000, 3)) AS BIGINT) AS overlap, coalesce(g.pages, 0) * 1000000 // te.pages AS pages, coalesce(ta.n, 0) - coalesce(g.n, 0) AS invented
FROM te LEFT JOIN ta USING (attempt) LEFT JOIN g USING (attempt) LEFT JOIN o USING (attempt)""")
def attempt_scores(spark, d):
    """Five pages are an attempt."""
    expected, actual = (side.withColumn("attempt", F.floor(F.col("page") / 5)) for side in _read(spark, d))
    texts = lambda side: side.groupBy("attempt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "place", "text"))), lambda x: x["text"]), "\n").alias("x"))
    sizes = texts(expected).join(texts(actual).withColumnRenamed("x", "y"), "attempt", "left").select("attempt", F.greatest(F.length("x"), F.length("y"), F.lit(1)).alias("whole"))
    return L.attempt_scores(expected, actual, "attempt").drop("word_accuracy").join(sizes, "attempt")


@contract("""SELECT l_suppkey, CAST(min(l_quantity) AS DOUBLE) AS low, CAST(max(l_quantity) AS DOUBLE) AS high, round(avg(l_quantity), 6) AS mean, arg_min(l_partkey, (-l_quantity, l_discount, l_partkey)) AS leading FROM lineitem GROUP BY 1""")
def summary_and_leader(spark, d):
    best = F.min_by("l_partkey", F.struct(-F.col("l_quantity"), F.col("l_discount"), F.col("l_partkey")))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 6).alias("mean"), best.alias("leading"))


@contract("""WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS e, string_split(p_type || ' ' || p_name, ' ') AS a FROM part)
SELECT p_partkey, CAST(CASE WHEN e = a THEN 1000000 ELSE 1000000 * (len(e) - 2) // len(e) END AS BIGINT) AS accuracy FROM p""")
def word_accuracy(spark, d):
    """A word moved from the end to the front is one word out and one in."""
    expected, actual = F.split(F.concat_ws(" ", "p_name", "p_type"), " "), F.split(F.concat_ws(" ", "p_type", "p_name"), " ")
    return table(spark, d, "part").select("p_partkey", L.word_accuracy(expected, actual).alias("accuracy"))
