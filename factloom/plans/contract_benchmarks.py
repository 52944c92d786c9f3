"""Contract queries of the benchmarks: suppliers are readers, the parts of an order its fixtures; sales are attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import benchmarks as B
from factloom.operators.graph import checkpointed
from factloom.plans.contract import contract, table

_DUE = "WITH r AS (SELECT l_suppkey AS corpus, l_orderkey AS fixture, l_linenumber AS n, CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'conversion_failed' END AS failure, l_quantity AS latency, l_discount, l_tax FROM lineitem)"


@contract(f"""{_DUE}, f AS (SELECT corpus, count(DISTINCT fixture) AS a, count(DISTINCT CASE WHEN failure IS NOT NULL THEN fixture END) AS b FROM r GROUP BY 1), g AS (SELECT * FROM r WHERE failure IS NULL),
q AS (SELECT corpus, latency, row_number() OVER (PARTITION BY corpus ORDER BY latency) AS k, count(*) OVER (PARTITION BY corpus) AS n FROM g)
SELECT corpus, metric, round(value, 9) AS value FROM (SELECT corpus, 'fixture_count' AS metric, CAST(a AS DOUBLE) AS value FROM f UNION ALL SELECT corpus, 'successful_fixture_count', a - b FROM f UNION ALL SELECT corpus, 'failure_rate', b / a FROM f
UNION ALL SELECT corpus, 'discount', avg(l_discount) FROM g GROUP BY 1 UNION ALL SELECT corpus, 'tax', avg(l_tax) FROM g GROUP BY 1 UNION ALL SELECT corpus, 'p50_latency_ms', latency FROM q WHERE k = ceil(n * 50 / 100.0) UNION ALL SELECT corpus, 'p95_latency_ms', latency FROM q WHERE k = ceil(n * 95 / 100.0))""")
def corpus_metrics(spark, d):
    item = table(spark, d, "lineitem")
    failure = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "conversion_failed")
    metric = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    rows = item.select(F.col("l_suppkey").alias("corpus"), F.col("l_orderkey").alias("fixture"), failure.alias("failure"), F.explode(F.array(metric("latency_ms", "l_quantity"), metric("discount", "l_discount"), metric("tax", "l_tax"))).alias("x"))
    out = B.corpus_metrics(rows.select("corpus", "fixture", "failure", "x.*"), "corpus")
    return out.select("corpus", "metric", F.round("value", 9).alias("value"))


@contract("""WITH m AS (SELECT sale_id, flag AS metric, avg(discount) AS score, bool_or(quantity IS NULL) AS excluded FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT * FROM (VALUES ('kept', 3.0), ('swapped', 1.0), ('returned', 0.0)) t(metric, weight)),
k AS (SELECT sale_id, round(sum(score * weight) / sum(weight), 6) AS score, string_agg(metric, ',' ORDER BY metric) AS metrics FROM m JOIN w USING (metric) WHERE weight > 0 AND score IS NOT NULL AND NOT excluded GROUP BY 1)
SELECT a.sale_id, x.score, coalesce(x.metrics, '') AS metrics, CASE WHEN y.score > x.score THEN CAST(b.sale_id AS VARCHAR) WHEN x.score > y.score THEN CAST(a.sale_id AS VARCHAR) ELSE 'tie' END AS winner
FROM (SELECT DISTINCT sale_id FROM m) a JOIN (SELECT DISTINCT sale_id FROM m) b ON b.sale_id = a.sale_id + 1 LEFT JOIN k x ON x.sale_id = a.sale_id LEFT JOIN k y ON y.sale_id = b.sale_id""")
def applicable_scores(spark, d):
    """A sale's manifest has a score for each flag of its lines; each is compared with the next one."""
    lines = table(spark, d, "sale_lines").filter("sale_id is not null")
    manifests = lines.groupBy("sale_id", F.col("flag").alias("metric")).agg(F.avg("discount").alias("score"), F.bool_or(F.col("quantity").isNull()).alias("excluded"))
    scores = checkpointed(B.applicable_scores(manifests, spark.createDataFrame([("kept", 3.0), ("swapped", 1.0), ("returned", 0.0)], "metric string, weight double"), "sale_id"))  # both sides of the comparison read it
    name = lambda c: F.col(c).cast("string")
    other = scores.select((F.col("sale_id") - 1).alias("sale_id"), F.round("score", 6).alias("after"), F.col("sale_id").alias("next"))
    own = scores.withColumn("score", F.round("score", 6))
    return own.join(other.hint("merge"), "sale_id").select("sale_id", "score", "metrics", B.winner(F.col("score"), F.col("after"), name("sale_id"), name("next")).alias("winner"))


@contract("""WITH b AS (SELECT l_orderkey AS fixture, string_agg(coalesce(p_name, ''), chr(10) ORDER BY l_linenumber, p_name) AS said, list(DISTINCT l_returnflag) AS types, count(*) FILTER (l_quantity > 20) AS placed, count(*) AS n FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT o_orderkey AS fixture, CASE WHEN o_orderkey % 4 > 0 THEN round(coalesce((CAST(list_contains(types, 'A') AS INTEGER) + CAST(list_contains(types, 'N') AS INTEGER)) / 2, 0), 9) END AS structure,
round(coalesce((CAST(contains(said, 'red') AS INTEGER) + CAST(contains(said, 'gear') AS INTEGER) + CAST(contains(said, 'plate') AS INTEGER)) / 3, 0), 9) AS text, CASE WHEN o_orderkey % 5 > 0 THEN round(coalesce(placed / n, 0), 9) END AS location FROM (SELECT DISTINCT o_orderkey FROM orders) LEFT JOIN b ON fixture = o_orderkey""")
def fixture_scores(spark, d):
    """An order is a fixture, its lines the blocks that were read."""
    blocks = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("l_orderkey").alias("fixture"), F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("type"), F.col("p_name").alias("text"), (F.col("l_quantity") > 20).alias("located"))
    listed = lambda *x: F.array(*[F.lit(v) for v in x])
    k = F.col("o_orderkey")
    fixtures = table(spark, d, "orders").select("o_orderkey").distinct().select(k.alias("fixture"), listed("red", "gear", "plate").alias("expected_text"), listed("A", "N").alias("required_types"), F.array_compact(F.array(F.lit("text"), F.when(k % 4 > 0, "structure"), F.when(k % 5 > 0, "location"))).alias("applicable"))
    scores = B.fixture_scores(blocks, fixtures)
    return scores.select("fixture", *[F.round(c, 9).alias(c) for c in ("structure", "text", "location")])


@contract("""WITH r AS (SELECT client_id, status <> 'held' AS ok, status, CASE WHEN priority < 3 THEN 'encrypted' ELSE 'conversion_failed' END AS code, total, CASE WHEN priority = 5 THEN priority END AS top FROM sales WHERE client_id IS NOT NULL),
f AS (SELECT client_id, string_agg(code || ':' || n, ',' ORDER BY code || ':' || n) AS failures FROM (SELECT client_id, code, count(*) AS n FROM r WHERE NOT ok GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT client_id, count(*) AS total, count(*) FILTER (ok) AS successful, round(avg(total) FILTER (ok), 4) AS amount, round(avg(top) FILTER (ok), 4) AS top FROM r GROUP BY 1)
SELECT client_id, g.total, successful, g.total - successful AS rejected, amount, top, concat_ws(',', CASE WHEN amount IS NULL THEN 'amount' END, CASE WHEN top IS NULL THEN 'top' END) AS exclusions, coalesce(failures, '') AS failures FROM g LEFT JOIN f USING (client_id)""")
def calibration(spark, d):
    rows = table(spark, d, "sales").filter("client_id is not null").select("client_id", F.when(F.col("status") != "held", "accepted").otherwise("rejected").alias("status"), F.when(F.col("priority") < 3, "encrypted").otherwise("conversion_failed").alias("error_code"), F.col("total").alias("amount"), F.when(F.col("priority") == 5, F.col("priority")).alias("top"))
    out = B.calibration(rows, "client_id", ["amount", "top"])
    return out.withColumns({c: F.round(c, 4) for c in ("amount", "top")})


@contract("""WITH l AS (SELECT DISTINCT ON (sale_id, line_no) sale_id, line_no, flag, quantity, vendor_id, item_id FROM sale_lines WHERE sale_id IS NOT NULL AND line_no IN (1, 2) ORDER BY sale_id, line_no, flag NULLS FIRST, quantity NULLS FIRST, vendor_id NULLS FIRST, item_id NULLS FIRST),
t AS (SELECT sale_id, count(*) AS tries, bool_and(flag <> 'returned') AS read, max(CASE WHEN line_no = 1 AND flag = 'returned' THEN 'active' END) AS r1, max(CASE WHEN line_no = 2 AND flag = 'returned' THEN 'active' END) AS r2, max(CASE WHEN line_no = 1 THEN coalesce(quantity, 0) % 2 END) AS a1, max(CASE WHEN line_no = 2 THEN coalesce(quantity, 0) % 2 END) AS a2, max(CASE WHEN line_no = 1 THEN vendor_id % 2 END) AS v1, max(CASE WHEN line_no = 2 THEN vendor_id % 2 END) AS v2, max(CASE WHEN line_no = 1 THEN 1 / (1 + item_id % 3) END) AS place FROM l GROUP BY 1),
x AS (SELECT coalesce(client_id, -1) AS client_id, status <> 'held' AS accept, coalesce(read AND tries = 2, false) AS read, coalesce(read AND tries = 2 AND a1 = a2 AND v1 = v2, false) AS same, coalesce(tries = 2 AND r1 = 'active' AND r2 = 'active', false) AS refused, a1, v1, priority, place FROM sales LEFT JOIN t USING (sale_id)),
s AS (SELECT client_id, CASE WHEN accept THEN CASE WHEN read THEN CAST(a1 = 1 AS DOUBLE) ELSE 0 END END AS t, CASE WHEN accept THEN CASE WHEN read THEN (CAST(v1 = 1 AS INTEGER) + 1 + CAST(v1 = 0 AS INTEGER)) / 3 ELSE 0 END END AS u, CASE WHEN accept THEN CASE WHEN read THEN place ELSE 0 END END AS p, CASE WHEN accept THEN same ELSE refused END AS good, CASE WHEN accept AND NOT read THEN 'unexpected_rejection' WHEN accept AND NOT same THEN 'nonrepeatable' WHEN NOT accept AND NOT refused THEN 'unexpected_rejection_outcome' END AS why FROM x),
g AS (SELECT client_id, count(*) AS documents, round(coalesce(avg(t), 0), 9) AS text_fidelity, round(coalesce(avg(u), 0), 9) AS structural_fidelity, round(coalesce(avg(p), 0), 9) AS location_fidelity, round(avg(CAST(good AS DOUBLE)), 9) AS outcome_accuracy, count(why) AS failed, coalesce(string_agg(DISTINCT why, ',' ORDER BY why), '') AS failures FROM s GROUP BY 1)
SELECT client_id, documents, text_fidelity, structural_fidelity, location_fidelity, outcome_accuracy, failed = 0 AS identical, failures, CASE WHEN failed > 0 THEN 'investigate' WHEN text_fidelity < 0.5 OR structural_fidelity < 0.5 OR location_fidelity < 0.5 OR outcome_accuracy < 1 THEN 'candidate_change' ELSE 'hold' END AS decision FROM g""")
def reader_benchmark(spark, d):
    """A client's sales are a corpus, the first two lines of a sale the attempts at a document; held sales are to be rejected."""
    sales = table(spark, d, "sales").withColumn("client_id", F.coalesce("client_id", F.lit(-1)))
    first = F.min(F.struct("flag", "quantity", "vendor_id", "item_id")).alias("x")
    lines = table(spark, d, "sale_lines").filter("sale_id is not null and line_no in (1, 2)").groupBy("sale_id", "line_no").agg(first).select("sale_id", "line_no", "x.*")
    digest = lambda c: F.concat(F.lit("d"), c.cast("string"))
    kinds = lambda n: F.create_map(F.lit("paragraph"), n.cast("int"), F.lit("table"), F.lit(1))
    expected = sales.select("client_id", F.col("sale_id").alias("document"), F.when(F.col("status") != "held", "accept").otherwise("reject").alias("outcome"), F.lit("active").alias("rejection"), F.lit("d1").alias("text_digest"), F.lit("d0").alias("event_digest"), kinds(F.lit(1)).alias("counts"))
    attempts = lines.join(sales.select("sale_id", "client_id"), "sale_id").select("client_id", F.col("sale_id").alias("document"), F.col("line_no").alias("attempt"), F.when(F.col("flag") == "returned", "active").alias("rejection"), digest(F.coalesce("quantity", F.lit(0)) % 2).alias("text_digest"), digest(F.col("vendor_id") % 2).alias("event_digest"), kinds(F.col("vendor_id") % 2).alias("counts"), (1 / (1 + F.col("item_id") % 3)).alias("location"))
    return B.reader_benchmark(expected, attempts, "client_id")


@contract("""WITH r AS (SELECT l_suppkey AS c, l_orderkey AS f, l_linenumber AS k, l_returnflag <> 'R' AS accepted, CAST(1000000 - l_discount * 100000 AS BIGINT) AS v, CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END AS invented, l_linestatus AS semantic, CAST(l_quantity AS BIGINT) AS latency, l_partkey AS memory FROM lineitem),
s AS (SELECT c, bool_and(same) AS identical FROM (SELECT c, f, count(DISTINCT semantic) = 1 AS same FROM r GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT c, CAST(floor(coalesce(sum(CASE WHEN accepted THEN v END) / greatest(1, count(*) FILTER (accepted)), 0)) AS BIGINT) AS v, CAST(floor(sum(v) / count(*)) AS BIGINT) AS o, coalesce(sum(CASE WHEN accepted THEN invented END), 0) AS invented, CAST(floor(avg(latency)) AS BIGINT) AS latency, max(memory) AS memory FROM r GROUP BY 1),
p AS (SELECT g.*, identical, identical AND invented = 0 AND v >= 1000000 AND o >= 1000000 AS hard, identical AND invented < 3 AS passes FROM g JOIN s USING (c)),
x AS (SELECT c % 10 AS team, bool_and(identical) AS identical, bool_and(passes) AS every, arg_min(c, (-v, invented, -v, -v, memory, latency, c)) FILTER (passes) AS best FROM p GROUP BY 1)
SELECT team, CASE WHEN best IS NULL OR NOT identical THEN 'investigate' WHEN every THEN 'hold' ELSE 'candidate_change' END AS decision, CASE WHEN best IS NOT NULL AND identical THEN best END AS chosen, (SELECT count(*) FROM p WHERE c % 10 = team AND hard) AS hard, (SELECT CAST(sum(v) AS BIGINT) FROM p WHERE c % 10 = team) AS accuracy FROM x""")
def ocr_candidates(spark, d):
    """Suppliers are readers, in teams of candidates; a reader passes here with few inventions, the hard gates are counted beside it."""
    value = (1_000_000 - F.col("l_discount") * 100_000).cast("long")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("reader"), F.col("l_orderkey").alias("fixture"), F.col("l_linenumber").alias("attempt"), (F.col("l_returnflag") != "R").alias("accepted"), *[value.alias(c) for c in B.GATES], F.when(F.col("l_quantity") > 49, 1).otherwise(0).alias("invented"), F.col("l_linestatus").alias("semantic"), F.col("l_quantity").cast("long").alias("latency"), F.col("l_partkey").alias("memory"), F.lit(False).alias("unexpected"))
    scores = B.candidate_scores(rows, "reader").withColumn("team", F.col("reader") % 10)
    hard = scores.groupBy("team").agg(F.count_if("passes").alias("hard"), F.sum("char_accuracy").alias("accuracy"))
    eased = scores.withColumn("passes", F.col("identical") & (F.col("invented") < 3))
    return B.choose_candidate(eased, "team", "reader").join(hard, "team")
