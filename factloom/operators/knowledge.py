"""Canonical knowledge: replay of append-only generations, ranked search, contradiction, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import retrieval as R
from factloom.operators.graph import checkpointed, small


def replay(log: DataFrame, group: str, sequence: str, parent: Column, rounds: int = 40) -> DataFrame:
    """Rows of ``log`` that are active at its end: those on the last row's chain of parents.

    An added row's parent is the row before it, a rollback's is the row it restores. The chain is followed by
    pointer doubling: 2**r ancestors after r joins, whatever the length of the log. ``parent`` gives the parent's
    sequence, null at the start. Every join is a merge: a broadcast in each round would pass the log through the driver.
    """
    rows = log.select(group, F.col(sequence).alias("s"), parent.alias("p"))
    last = rows.groupBy(group).agg(F.max("s").alias("s"))
    jump, active = checkpointed(rows.filter("p is not null").select(group, "s", "p")), last
    for _ in range(rounds):
        more = active.join(jump.hint("merge"), [group, "s"]).select(group, F.col("p").alias("s"))
        grown = checkpointed(active.unionByName(more).distinct())
        step = jump.alias("a").join(jump.select(F.col(group).alias("g"), F.col("s").alias("t"), F.col("p").alias("q")).hint("merge").alias("b"), (F.col(f"a.{group}") == F.col("b.g")) & (F.col("a.p") == F.col("b.t"))).select(F.col(f"a.{group}").alias(group), F.col("a.s").alias("s"), F.col("b.q").alias("p"))
        jump, active = checkpointed(step), grown
        if not jump.limit(1).count():
            break
    return log.join(active.withColumnRenamed("s", sequence).hint("merge"), [group, sequence], "left_semi")


def status(entries: DataFrame, group: str, version: str) -> DataFrame:
    """Counts by answerability and the class of the whole: empty, legacy only, mixed or fully answerable."""
    old = F.count_if(F.col(version) == "legacy")
    counts = entries.groupBy(group).agg(F.count("*").alias("entries"), old.alias("legacy"))
    kind = F.when(F.col("entries") == 0, "empty").when(F.col("legacy") == F.col("entries"), "legacy_only").when(F.col("legacy") > 0, "mixed_version_partial").otherwise("fully_answerable")
    return counts.withColumn("status", kind)


def search(claims: DataFrame, prompts: DataFrame, limit: int, citations: DataFrame | None = None) -> DataFrame:
    """Claims (entry_id, claim_id, text) of each prompt by: exact text, prompt within the claim, words shared, words shared with its
    citation (entry_id, claim_id, text), entry, claim.

    A claim leaves its batch only if it is among the best ``limit`` there by shared words, or shares so many that it can hold the
    prompt; only those meet their texts. With citations, a claim is known by the words of both.
    """
    blocks = claims.select(F.col("entry_id").alias("doc_id"), F.col("claim_id").alias("line_no"), "text")
    few = R.asked_arrays(prompts, T.distinct_words)
    if few is not None and citations is None:
        found = R.score_index(R.block_index(blocks, few, False), few, limit, bonus=False).select("item_id", *R.BLOCK, "overlap", "may")
    else:
        asked = checkpointed(R.prompt_terms(prompts, T.distinct_words))
        count = lambda rows, name: R.block_terms(rows, T.distinct_words).join(small(asked), "term").groupBy("item_id", *R.BLOCK).agg(F.count("*").alias(name))
        need = asked.groupBy("item_id").agg((F.count("*") - 2).alias("need"))
        found = count(blocks, "overlap")
        if citations is not None:
            cited = count(citations.select(F.col("entry_id").alias("doc_id"), F.col("claim_id").alias("line_no"), "text"), "cited")
            found = found.join(cited, ["item_id", *R.BLOCK], "full_outer").fillna(0, ["overlap", "cited"])
        found = found.join(small(need), "item_id").withColumn("may", F.col("overlap") >= F.col("need")).drop("need")
    found = checkpointed(found.withColumn("cited", F.lit(0).cast("long")) if citations is None else found)
    near = small(found.filter("may").select("item_id", *R.BLOCK))
    said = small(prompts.select("item_id", T.t3_text(F.col("text")).alias("prompt")))
    texts = near.join(blocks, R.BLOCK).select("item_id", *R.BLOCK, T.t3_text(F.col("text")).alias("normal"))
    close = small(checkpointed(texts.join(said, "item_id").filter(F.col("normal").contains(F.col("prompt")))))
    close = close.select("item_id", *R.BLOCK, (F.col("normal") == F.col("prompt")).cast("int").alias("exact"), F.lit(1).alias("within"))
    rows = found.join(close, ["item_id", *R.BLOCK], "left").fillna(0, ["exact", "within"])
    w = Window.partitionBy("item_id").orderBy(F.desc("exact"), F.desc("within"), F.desc("overlap"), F.desc("cited"), *R.BLOCK)
    best = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    shown = ["hits"] if citations is None else ["hits", "cited"]
    return best.select("item_id", F.col("doc_id").alias("entry_id"), F.col("line_no").alias("claim_id"), "exact", "within", F.col("overlap").alias("hits"), "cited", "rank").select("item_id", "entry_id", "claim_id", "exact", "within", *shown, "rank")


def contradict(claims: DataFrame, group: str, strict: bool = False) -> DataFrame:
    """Whether a group holds claims with and without the word not; ``strict``: the same claim with and without it."""
    padded = F.concat(F.lit(" "), T.t3_text(F.col("text")), F.lit(" "))
    rows = claims.select(group, padded.contains(" not ").alias("negated"), F.trim(F.regexp_replace(padded, " not ", " ")).alias("base"))
    if strict:
        pair = rows.groupBy(group, "base").agg((F.bool_or("negated") & F.bool_or(~F.col("negated"))).alias("both"))
        return pair.groupBy(group).agg(F.bool_or("both").alias("contradict"))
    return rows.groupBy(group).agg((F.bool_or("negated") & F.bool_or(~F.col("negated"))).alias("contradict"))


def coverage(requirements: DataFrame, group: str, weight: Column, value: Column, gate: Column, scale: float = 1.0) -> DataFrame:
    """Weighted mean of requirement values, all gates, and what to do next. Whole values in ``scale``ths sum exactly in any order."""
    share = F.round(F.sum(weight * value) / (F.lit(scale) * F.sum(weight)), 6)
    rows = requirements.groupBy(group).agg(share.alias("coverage"), F.bool_and(gate).alias("gates"))
    return rows.withColumn("decision", F.when(F.col("gates") & (F.col("coverage") >= 0.9), "answer").when(~F.col("gates"), "refuse").when(F.col("coverage") >= 0.5, "partial").otherwise("replan"))


# Requirement states by falling precedence.
STATES = ["contradictory", "satisfied", "partial", "stale", "disqualified", "missing"]


def fold_status(events: DataFrame, group: list[str], state: Column) -> DataFrame:
    """The leading state of each requirement's events."""
    rank = F.create_map(*[F.lit(x) for k, s in enumerate(STATES) for x in (s, k)])[state]
    return events.groupBy(*group).agg(F.min_by(state, rank).alias("status"), F.count("*").alias("events"))


def best_branch(branches: DataFrame, group: str, gain: Column, cost: Column, key: str) -> DataFrame:
    """The branch of most gain for its cost (in ten-thousandths, so that equals are equal), the smallest id of equals."""
    worth = F.floor(gain * 10_000 / cost)
    rows = branches.select(group, F.col(key), worth.alias("priority"))
    return rows.groupBy(group).agg(F.max("priority").alias("priority"), F.min_by(key, F.struct(-F.col("priority"), F.col(key))).alias("branch"))


def synthesise(ledger: DataFrame, group: str, order: str) -> DataFrame:
    """The answer text of each group: its verified claims in ledger order, each with its citation."""
    line = F.concat("text", F.lit(" ["), "citation_id", F.lit("]"))
    return ledger.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), line.alias("v")))), lambda x: x["v"]), "\n").alias("answer"))
