"""Claim quality: duplicates, fragments, stratified samples, question matching, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T


def duplicates(claims: DataFrame, text: str = "text") -> DataFrame:
    """Normalised texts that occur more than once, with exact and normalised multiplicities: two aggregates, no window."""
    exact = claims.groupBy(text).agg(F.count("*").alias("copies")).withColumn("normal", T.t5_text(F.col(text)))
    return exact.filter("normal <> ''").groupBy("normal").agg(F.sum("copies").alias("copies"), F.count("*").alias("spellings"), F.max("copies").alias("most_exact")).filter("copies > 1")


def fragment(text: Column) -> Column:
    """No sentence end, or a lower-case start."""
    return ~F.trim(text).rlike(r"[.!?]$") | F.trim(text).rlike(r"^\p{Ll}")


#: Why a claim is in a sample, in falling precedence.
TIERS = ("binding_risk", "normalized_duplicate", "fragmentation", "position", "length", "block_type_representative", "digest_fill")


def sampling_policy(claims: DataFrame, group: str, most: int) -> DataFrame:
    """(group, claims, quota, policy_digest): ``most`` claims of each group, or all it has; the digest binds group, size and quota."""
    counts = claims.groupBy(group).agg(F.count("*").alias("claims")).withColumn("quota", F.least(F.col("claims"), F.lit(most)))
    return counts.withColumn("policy_digest", T.digest(F.col(group), F.col("claims"), F.col("quota")))


def tiered_sample(claims: DataFrame, quotas: DataFrame | int, group: str) -> DataFrame:
    """(group, claim, tier, reason, ordinal): ``quota`` claims of each group by cascaded tiers; a number is the quota of every group with as many claims.

    claims: group, claim, ordinal_no (place in its group), size, block_type, digest, binding_risk, duplicate, fragment. Each tier takes what the tiers before
    it left of the quota: all its claims in its own order if they fit, else those of the least digests; a claim is taken once.
    Tiers: risks, duplicates and fragments by digest; first, middle and last place; the longest and the shortest claim (least digest); a
    claim for each block type that none of these has (least digest, types in order of appearance); the rest by digest. A
    group that has no more claims than its quota gives them all, in their order, as a fill.

    Only keys, digests and flags are ranked: the texts stay where they are. All windows are dealt by the group, so claims that are dealt so are
    not shuffled again, and a window that needs no order comes after one whose order will do.
    """
    whole, place = Window.partitionBy(group), Window.partitionBy(group).orderBy("ordinal_no")
    rows = claims.filter(F.col(group).isNotNull()) if isinstance(quotas, int) else claims.join(quotas.select(group, "quota"), group)
    first = lambda size: F.min(F.struct(size.alias("size"), "digest", "claim")).over(whole)
    rows = rows.withColumn("k", F.row_number().over(place) - 1).withColumns({"n": F.count("*").over(whole), "long": first(-F.col("size")), "short": first(F.col("size"))})
    if isinstance(quotas, int):
        rows = rows.withColumn("quota", F.least(F.col("n"), F.lit(quotas)))
    own_claim = lambda c: (F.col(f"{c}.digest") == F.col("digest")) & (F.col(f"{c}.claim") == F.col("claim"))
    rows = rows.withColumns({"longest": own_claim("long"), "shortest": own_claim("short")}).drop("long", "short")
    middle = F.floor((F.col("n") - 1) / 2)
    own = F.when(F.col("binding_risk"), 0).when(F.col("duplicate"), 1).when(F.col("fragment"), 2).when((F.col("k") == 0) | (F.col("k") == middle) | (F.col("k") == F.col("n") - 1), 3).when(F.col("longest") | F.col("shortest"), 4).otherwise(6)
    listed = F.when(own == 3, F.col("k")).when(own == 4, F.when(F.col("longest"), 0).otherwise(1)).otherwise(0)
    rows = rows.withColumn("tier", own).withColumn("listed", listed.cast("long")).drop("longest", "shortest", "binding_risk", "duplicate", "fragment")
    # Tiers 0 to 4 as far as the quota goes, then the types that they do not have.
    early = F.row_number().over(Window.partitionBy(group).orderBy("tier", "digest", "claim"))
    rows = rows.withColumn("taken", (F.col("tier") < 5) & (early <= F.col("quota")))
    of_type = Window.partitionBy(group, "block_type")
    rows = rows.withColumn("stands", F.row_number().over(of_type.orderBy(F.col("taken"), "digest", "claim")) == 1)
    rows = rows.withColumn("covered", F.max(F.col("taken").cast("int")).over(of_type) == 1).withColumn("seen", F.min("k").over(of_type))
    represents = ~F.col("covered") & F.col("stands") & (F.col("tier") == 6)
    rows = rows.withColumns({"tier": F.when(represents, 5).otherwise(F.col("tier")), "listed": F.when(represents, F.col("seen")).otherwise(F.col("listed"))})
    # What is left for a tier: the quota without the tiers before it.
    rows = rows.withColumn("counts", F.array(*[F.count_if(F.col("tier") == k).over(whole) for k in range(len(TIERS))]))
    before = F.aggregate(F.slice("counts", 1, F.col("tier")), F.lit(0).cast("long"), lambda total, x: total + x)
    rows = rows.withColumn("left", F.col("quota") - before).withColumn("many", F.element_at("counts", F.col("tier") + 1)).drop("counts")
    order = F.when(F.col("n") <= F.col("quota"), F.col("k")).when(F.col("many") <= F.col("left"), F.col("listed")).otherwise(0)
    lead = F.when(F.col("n") <= F.col("quota"), F.lit(6)).otherwise(F.col("tier"))
    rows = rows.withColumns({"tier": lead, "by": order})
    out = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy("tier", "by", "digest", "claim"))).filter(F.col("ordinal") <= F.col("quota"))
    reason = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier") + 1)
    return out.select(group, "claim", "tier", reason.alias("reason"), "ordinal")


def question_match(questions: DataFrame, claims: DataFrame) -> DataFrame:
    """(item_id, claim, kind): claims that hold a question's words as a phrase, or else as a multiset.

    The rarest word of a question is the join key, so a question meets only the claims that can hold it.
    """
    terms = claims.select("claim", F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    asked = questions.select("item_id", T.words(F.col("text")).alias("asked")).filter(F.size("asked") > 0)
    frequency = terms.join(asked.select(F.explode("asked").alias("term")).distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    every = asked.select("item_id", "asked", F.explode(F.array_distinct("asked")).alias("term")).join(frequency, "term", "left")
    rare = every.groupBy("item_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"), F.any_value("asked").alias("asked"))
    met = terms.join(rare, "term").select("item_id", "claim", "asked").join(claims.select("claim", T.words(F.col("text")).alias("held")), "claim")
    phrase = T.contains_phrase(F.col("held"), F.col("asked"))
    enough = F.forall(F.array_distinct("asked"), lambda w: F.size(F.filter("held", lambda x: x == w)) >= F.size(F.filter("asked", lambda x: x == w)))
    return met.withColumn("kind", F.when(phrase, "phrase").when(enough, "multiset")).filter("kind is not null").select("item_id", "claim", "kind")


def question_coverage(questions: DataFrame, candidates: DataFrame, categories: DataFrame) -> DataFrame:
    """(candidate, category, have, problem): cells of candidates by categories that do not have exactly one question, and questions outside all cells.

    A cell without a question is found by taking the asked ones from its candidate's categories, not by listing all cells:
    each candidate carries the categories (a few) and keeps those it lacks.
    """
    have = questions.groupBy("candidate", "category").agg(F.count("*").alias("have"))
    kinds = categories.select("category").distinct()
    asked = have.join(kinds, "category", "left_semi").groupBy("candidate").agg(F.collect_set("category").alias("asked"))
    all_ = kinds.agg(F.array_sort(F.collect_list("category")).alias("all"))
    lacking = candidates.select("candidate").distinct().join(asked, "candidate", "left").crossJoin(F.broadcast(all_))  # one row on the other side
    none = F.array().cast("array<string>")
    missing = lacking.select("candidate", F.explode(F.array_except("all", F.coalesce("asked", none))).alias("category")).withColumn("have", F.lit(0).cast("long")).withColumn("problem", F.lit("missing"))
    known = candidates.select("candidate").distinct().withColumn("is_candidate", F.lit(True))
    odd = have.join(known, "candidate", "left").join(kinds.withColumn("is_category", F.lit(True)), "category", "left")
    problem = F.when(F.col("is_candidate").isNull(), "candidate_unknown").when(F.col("is_category").isNull(), "category_unknown").when(F.col("have") > 1, "repeated")
    return missing.unionByName(odd.select("candidate", "category", "have", problem.alias("problem")).filter("problem is not null"))


def question_results(questions: DataFrame, matches: DataFrame, most: int = 4) -> DataFrame:
    """(item_id, outcome, supporting, claims, similarity, problem) of questions (item_id, expected array of claims): claims that hold the phrase count, or where none does those
    with all words; over ``most`` of them are no evidence (``too_many``). Similarity is that of expected and found claims, in millionths, 0 for a refusal."""
    best = matches.groupBy("item_id").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == "phrase", F.col("claim")))).alias("phrase"), F.array_sort(F.collect_set(F.when(F.col("kind") == "multiset", F.col("claim")))).alias("words"))
    rows = questions.join(best, "item_id", "left")
    found = F.when(F.coalesce(F.size("phrase"), F.lit(0)) > 0, F.col("phrase")).otherwise(F.coalesce("words", F.array().cast(matches.select(F.collect_set("claim")).schema[0].dataType)))
    rows = rows.withColumn("found", found).withColumn("problem", F.when(F.size("found") > most, "too_many"))
    rows = rows.withColumn("supporting", F.when(F.col("problem").isNull(), F.col("found")).otherwise(F.slice("found", 1, 0)))
    similar = F.when(F.size("supporting") == 0, F.lit(0)).otherwise(jaccard_millionths(F.col("expected"), F.col("supporting"))).cast("long")
    return rows.select("item_id", F.when(F.size("supporting") > 0, "supported").otherwise("refusal").alias("outcome"), "supporting", F.size("supporting").cast("long").alias("claims"), similar.alias("similarity"), "problem")


def jaccard_millionths(left: Column, right: Column) -> Column:
    """Integer similarity of two id sets in millionths; two empty sets are equal."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1_000_000)).otherwise(F.floor(F.size(F.array_intersect(left, right)) * 1_000_000 / union)).cast("long")


def decision(rows: DataFrame, group: str, useful: Column, duplicate: Column, fragment_: Column) -> DataFrame:
    """Shares in basis points and pass (>= 90 % useful, <= 5 % others), hold or reject."""
    n = F.count("*")
    out = rows.groupBy(group).agg(n.alias("n"), *[F.floor(F.count_if(c) * 10_000 / n).alias(a) for c, a in ((useful, "useful_bp"), (duplicate, "duplicate_bp"), (fragment_, "fragment_bp"))])
    good = (F.col("useful_bp") >= 9000) & (F.col("duplicate_bp") <= 500) & (F.col("fragment_bp") <= 500)
    return out.withColumn("decision", F.when(good, "pass").when(F.col("useful_bp") >= 7000, "hold").otherwise("reject"))
