"""Claim semantics: layout artifacts, excerpt binding, subject terms, copied rationales; referential set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.graph import checkpointed, small

# Block types that hold no statement, and what a page number looks like.
FURNITURE = ["header", "footer", "page_number", "page-number"]
PAGE_NUMBER = r"^(?i)(page *)?[0-9]+( *(of|/) *[0-9]+)?$"


def layout_artifact(kind: Column, text: Column) -> Column:
    """Page furniture, a page number, a replacement sign, or a table whose rows differ in width."""
    rows = F.filter(F.split(text, "\n"), lambda r: F.trim(r) != "")
    widths = F.transform(rows, lambda r: F.size(F.split(r, r"\|")))
    ragged = (F.size(rows) < 2) | (F.array_min(widths) < 2) | (F.size(F.array_distinct(widths)) != 1)
    return F.coalesce(F.lower(kind).isin(FURNITURE) | F.trim(text).rlike(PAGE_NUMBER) | text.contains("�") | ((F.lower(kind) == "table") & ragged), F.lit(True))


def review(claims: DataFrame, reviews: DataFrame, blocks: DataFrame) -> DataFrame:
    """(claim_id, reasons): why a review does not bind its claim; an empty text where it does.

    claims: claim_id, excerpt, anchor, terms array; reviews: claim_id, block_id, rationale; blocks: block_id, type, text.
    The checks of a claim are written once, with digests of its rationale and topic in place of texts: only these are counted and joined.
    """
    both = claims.join(reviews, "claim_id", "left").join(blocks, "block_id", "left")
    both = both.withColumns({"said": T.t4_terms(F.col("excerpt")), "why": T.t4_terms(F.col("rationale"))})
    terms = F.transform("terms", lambda t: T.t4_terms(t))
    in_excerpt = F.forall(terms, lambda t: T.contains_phrase(F.col("said"), t))
    in_reason = F.exists(terms, lambda t: T.contains_phrase(F.col("why"), t))
    checks = {
        "excerpt_binding": (F.col("text") == F.col("excerpt")) & (F.col("block_id") == F.col("anchor")),
        "layout_artifact": ~layout_artifact(F.col("type"), F.col("text")),
        "topic_mismatch": in_excerpt & in_reason,
    }
    key = lambda text: F.unhex(F.sha2(text, 256))
    keyed = checkpointed(both.select("claim_id", *[F.coalesce(ok, F.lit(False)).alias(n) for n, ok in checks.items()], key(F.array_join("why", " ")).alias("rationale_key"), key(F.array_join(F.array_sort("terms"), "|")).alias("topic")))
    copied = keyed.groupBy("rationale_key").agg(F.count_distinct("topic").alias("topics")).filter("topics <> 1").select("rationale_key", F.lit(True).alias("copied"))
    fails = {n: ~F.col(n) for n in checks} | {"copied_rationale": F.col("rationale_key").isNull() | F.coalesce("copied", F.lit(False))}
    why_not = F.array_join(F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in fails.items()])), ",")
    return keyed.join(small(copied), "rationale_key", "left").select("claim_id", why_not.alias("reasons"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def set_difference(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys that not every side has, with the sides that do; empty if all sets are equal."""
    tagged = None
    for name, rows in sides.items():
        own = rows.select(key).distinct().withColumn("side", F.lit(name))
        tagged = own if tagged is None else tagged.unionByName(own)
    found = tagged.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("side")), ",").alias("present"), F.count("*").alias("n"))
    return found.filter(F.col("n") < len(sides)).drop("n")


def indirect_references(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """References (workspace, reference) to what is no reference workspace, or has references itself."""
    kinds = definitions.select(F.col("workspace").alias("reference"), "kind")
    own = references.select(F.col("workspace").alias("reference")).distinct().withColumn("has", F.lit(True))
    found = references.join(kinds, "reference", "left").join(own, "reference", "left")
    return found.filter((F.coalesce("kind", F.lit("")) != "reference") | F.coalesce("has", F.lit(False))).select("workspace", "reference")


def drift(selected: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Selected records that are gone or differ from the current ones, field by field and null-safe."""
    now = current.select(key, F.struct(*fields).alias("now"), F.lit(True).alias("there"))
    both = selected.select(key, F.struct(*fields).alias("then")).join(now, key, "left")
    state = F.when(F.col("there").isNull(), "missing").when(~F.col("then").eqNullSafe(F.col("now")), "changed")
    return both.withColumn("state", state).filter("state is not null").select(key, "state")


def linked_pairs(pairs: DataFrame, selected: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs both of whose ends are selected (column id)."""
    ids = selected.select("id").distinct()
    return pairs.join(ids.withColumnRenamed("id", left), left, "left_semi").join(ids.withColumnRenamed("id", right), right, "left_semi")


def drifted_fields(proposed: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, field, proposed, current) of every field in which a proposal differs from the records it was made of; a record that is gone is the field ``*``.

    Both sides are told field by field, so that one join finds all differences; fields that the current side lacks are differences.
    """
    fields = [c for c in proposed.columns if c != key]
    told = lambda df: F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(f"`{c}`").cast("string") if c in df.columns else F.lit(None).cast("string")).alias("value")) for c in fields]))
    side = lambda df, name: df.select(key, told(df).alias("x")).select(key, "x.field", F.col("x.value").alias(name))
    gone = proposed.join(current, key, "left_anti").select(key, F.lit("*").alias("field"), F.lit(None).cast("string").alias("proposed"), F.lit(None).cast("string").alias("current"))
    both = side(proposed, "proposed").join(side(current, "current"), [key, "field"]).filter(~F.col("proposed").eqNullSafe(F.col("current")))
    return both.unionByName(gone)
