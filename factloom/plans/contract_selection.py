"""Contract queries of the selector: pages stand for documents (labels.toxic: restricted, labels.quality = 0: not current), their headings
for subjects; every other prompt of ``benchmark`` names the heading of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import selection as S
from factloom.operators.graph import checkpointed
from factloom.plans.contract import PARAGRAPHS, _sql_t1, contract, table
from factloom.sources import blocks as B

LIMIT = 20


def page_blocks(spark, d):
    """Paragraphs as blocks; a heading is marked as such."""
    rows = B.html_paragraphs(table(spark, d, "pages")).filter("trim(text) <> ''")
    return rows.select(F.col("page_id").alias("doc_id"), F.col("ordinal").alias("line_no"), F.when(F.col("heading"), F.concat(F.lit("# "), "text")).otherwise(F.col("text")).alias("text"))


def page_documents(spark, d):
    label = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("doc_id")).distinct().join(label, "doc_id", "left")
    family = F.concat((F.col("doc_id") % 7).cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", (F.coalesce("toxic", F.lit(0)) == 1).alias("restricted"), (F.coalesce("quality", F.lit(1)) == 1).alias("current"), family.alias("source_id"))


def page_prompts(spark, d, blocks: DataFrame):
    heads = blocks.filter("line_no = 0").select((F.col("doc_id") / 3).alias("item"), F.substring("text", 3, 1000).alias("head")).filter("item = floor(item) and item % 2 = 0")
    rows = table(spark, d, "benchmark").join(heads, F.col("item_id") == F.col("item"), "left")
    return rows.select("item_id", F.when(F.col("head").isNotNull(), F.concat(F.lit("What value does "), "head", F.lit(" give? "), F.substring("text", 1, 40))).otherwise(F.col("text")).alias("text"))


def page_tables(spark, d):
    """(blocks, prompts, documents), written: the selector reads them up to a dozen times, and pages are cut by patterns that cost far more than a read."""
    blocks = checkpointed(page_blocks(spark, d))
    return blocks, checkpointed(page_prompts(spark, d, blocks)), checkpointed(page_documents(spark, d))


def _flat(x: str) -> str:
    return rf"trim(regexp_replace(replace(lower(coalesce({x}, '')), '_', ' '), '\s+', ' ', 'g'))"


_TABLES = rf"""{PARAGRAPHS}, blocks AS (SELECT page_id AS doc_id, ordinal AS line_no, CASE WHEN heading THEN '# ' || text ELSE text END AS text FROM paragraphs WHERE trim(text, ' ') <> ''),
label AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY 1),
docs AS (SELECT DISTINCT page_id AS doc_id, coalesce(toxic, 0) = 1 AS restricted, coalesce(quality, 1) = 1 AS current FROM pages LEFT JOIN label ON doc_id = page_id),
prompts AS (SELECT item_id, CASE WHEN h.text IS NOT NULL THEN 'What value does ' || substr(h.text, 3) || ' give? ' || substr(b.text, 1, 40) ELSE b.text END AS text
  FROM benchmark b LEFT JOIN blocks h ON h.line_no = 0 AND h.doc_id = b.item_id * 3 AND b.item_id % 2 = 0),
heads AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place FROM blocks QUALIFY place <= 2),
named AS (SELECT doc_id, arg_min({_flat("regexp_split_to_array(trim(regexp_replace(text, '^[# ]+', '')), '\\s+[—–|]\\s+|\\s+-\\s+')[1]")}, place) AS subject FROM heads WHERE starts_with(ltrim(text), '#') GROUP BY 1 HAVING subject <> ''),
spans AS (SELECT item_id, subject, strpos(' ' || {_flat("text")} || ' ', subject) AS start, length(subject) AS size FROM prompts, (SELECT DISTINCT subject FROM named)
  WHERE regexp_matches(subject, '[\p{{L}}\p{{N}}]') AND regexp_matches({_flat("text")}, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(subject) || '($|[^\p{{L}}\p{{N}}_])')),
focused AS (SELECT DISTINCT item_id, subject FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans o WHERE o.item_id = s.item_id AND o.start < s.start + s.size AND s.start < o.start + o.size AND (-o.size, o.start, o.subject) < (-s.size, s.start, s.subject))),
bt AS (SELECT doc_id, line_no, unnest({_sql_t1("text")}) AS term FROM blocks), pt AS (SELECT item_id, unnest({_sql_t1("text")}) AS term FROM prompts),
shut AS (SELECT item_id FROM focused WHERE subject IN (SELECT subject FROM named JOIN docs USING (doc_id) WHERE restricted) AND item_id IN (SELECT item_id FROM pt)
  UNION SELECT item_id FROM pt WHERE item_id NOT IN (SELECT item_id FROM focused) AND term IN (SELECT term FROM bt JOIN docs USING (doc_id) WHERE restricted)),
own AS (SELECT DISTINCT item_id, doc_id FROM focused JOIN named USING (subject) JOIN docs USING (doc_id) WHERE NOT restricted),
first_ AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS n FROM own QUALIFY n <= {S.CANDIDATES}),
rest AS (SELECT doc_id FROM docs WHERE NOT restricted ORDER BY doc_id LIMIT {S.CANDIDATES}),
candidates AS (SELECT item_id, doc_id FROM first_ UNION ALL SELECT item_id, doc_id FROM prompts, rest WHERE item_id NOT IN (SELECT item_id FROM own)),
facts AS (SELECT item_id, count(*) AS documents, bool_or(NOT current) AS stale FROM candidates JOIN docs USING (doc_id) GROUP BY 1)"""


@contract(f"WITH {_TABLES} SELECT doc_id, subject FROM named")
def document_subjects(spark, d):
    return S.subjects(page_blocks(spark, d))


@contract(f"WITH {_TABLES} SELECT item_id, subject FROM focused")
def subject_focus(spark, d):
    blocks, prompts, _ = page_tables(spark, d)
    return S.focus(prompts, S.subjects(blocks))


def _focus(spark, d):
    blocks, prompts, documents = page_tables(spark, d)
    named = checkpointed(S.subjects(blocks))
    return blocks, prompts, documents, named, S.focus(prompts, named)


@contract(f"WITH {_TABLES} SELECT item_id, item_id IN (SELECT item_id FROM shut) AS restricted FROM prompts")
def restricted_gate(spark, d):
    _, prompts, *_ = every = _focus(spark, d)
    shut = S.restricted_items(*every).withColumn("hit", F.lit(True))
    return prompts.select("item_id").join(shut, "item_id", "left").select("item_id", F.coalesce("hit", F.lit(False)).alias("restricted"))


@contract(f"WITH {_TABLES} SELECT item_id, documents, stale FROM facts")
def candidate_facts(spark, d):
    _, prompts, documents, named, focused = _focus(spark, d)
    return S.candidate_facts(prompts, documents, *S.candidates(documents, named, focused))


@contract(f"""WITH {_TABLES}, met AS (SELECT item_id, doc_id, line_no, term FROM candidates JOIN bt USING (doc_id) JOIN pt USING (item_id, term)),
f AS (SELECT item_id, term, count(*) AS f FROM met GROUP BY ALL), w AS (SELECT item_id, term, greatest(0.5, ln(1 + (documents - f + 0.5) / (f + 0.5))) AS w FROM f JOIN facts USING (item_id)),
c AS (SELECT met.*, w, NOT list_contains(coalesce({_sql_t1("subject")}, []), term) AND term NOT IN ({', '.join(f"'{w}'" for w in T.DIRECTIVES)}) AS content FROM met JOIN w USING (item_id, term) LEFT JOIN named USING (doc_id))
SELECT item_id, doc_id, line_no, count(*) AS overlap, round(coalesce(sum(w) FILTER (content), sum(w)), 6) AS score FROM c GROUP BY 1, 2, 3""")
def candidate_scores(spark, d):
    out = S.candidate_scores(*page_tables(spark, d))
    return out.select("item_id", "doc_id", "line_no", "overlap", F.round("score", 6).alias("score"))


@contract()
def select_document_blocks(spark, d):
    return S.select_blocks(*page_tables(spark, d), LIMIT)[0]


def _asked(spark, d):
    """The tables of pages; every seventh prompt asks for what shares a provider with a page's subject."""
    blocks, prompts, documents = page_tables(spark, d)
    asked = prompts.withColumn("text", F.when(F.col("item_id") % 7 == 0, F.concat(F.lit("all of the same provider: "), "text")).otherwise(F.col("text")))
    return blocks, asked, documents


@contract()
def outcome_ladder(spark, d):
    """The document query: chosen blocks with their neighbours, then the gates."""
    outcomes, _ = S.query_documents(*_asked(spark, d), LIMIT, 1, 2 * LIMIT, 20_000)
    return outcomes.select("item_id", "evidence", "outcome", "reason")


@contract()
def document_query(spark, d):
    """What the document query shows, with what identifies it."""
    _, evidence = S.query_documents(*_asked(spark, d), LIMIT)
    return evidence.select("item_id", "position", "doc_id", "line_no", "evidence_id", F.length("render_text").alias("chars"))


@contract("""WITH p AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '/' || turn, text FROM conversations UNION ALL SELECT 'q' || item_id, text FROM benchmark UNION ALL SELECT 's' || stamp_id, raw FROM stamps)
SELECT id, coalesce(length(text) BETWEEN 1 AND 1024 AND NOT regexp_matches(text, '[\\p{Cc}\\p{Cf}\\p{Co}\\p{Cs}]') AND trim(text, ' ') <> '', false) AS valid FROM p""")
def prompt_validation(spark, d):
    """Documents, turns, benchmark passages and stamps as prompts: long ones and those with line ends are none."""
    rows = [(F.concat(F.lit("d"), "doc_id"), "text", "documents"), (F.concat(F.lit("c"), "conv_id", F.lit("/"), "turn"), "text", "conversations"), (F.concat(F.lit("q"), "item_id"), "text", "benchmark"), (F.concat(F.lit("s"), "stamp_id"), "raw", "stamps")]
    each = [table(spark, d, name).select(key.alias("id"), F.coalesce(S.valid_prompt(F.col(text)), F.lit(False)).alias("valid")) for key, text, name in rows]
    return reduce(DataFrame.unionByName, each)
