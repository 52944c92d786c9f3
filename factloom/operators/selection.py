"""The selector: which blocks of which documents answer each prompt, behind subject, restriction and freshness gates.

Tables: blocks (doc_id, line_no, text), documents (doc_id, restricted, current booleans; source_id for cohorts), prompts
(item_id, text). Everything is keyed by the prompt; sequential choices are folds over the arrays of one prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import retrieval as R
from factloom.operators.graph import checkpointed, small

#: Candidate documents of a prompt; the limit is a feature of the selector (None: all).
CANDIDATES = 64
#: Signs that make a word: a subject must not touch one on either side.
_SIGN = r"^[\p{L}\p{N}_]$"

# Words that ask for a cohort of one provider, for owners and invoice facts, and what states them.
COHORT = r"(?i)\b(?:same|other|all|every|across|portfolio|cohort)\b"
PROVIDER = r"(?i)\b(?:provider|vendor|supplier|contractor)\b"
OTHER = r"(?i)\bother\b"
OWNER = r"(?i)\b(?:owner|accountable|responsible)\b"
INVOICE_ASKED = r"(?i)\b(?:quantity|price|unit|total|sum|invoice|effective)\b"
INVOICE_TOLD = r"(?i)\b(?:price|quantity|unit|effective|amend|takes effect)\b"


def subjects(blocks: DataFrame) -> DataFrame:
    """(doc_id, subject): the title of the first heading among a document's first two blocks, up to a dash or bar between blanks."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    heads = blocks.withColumn("place", place).filter((F.col("place") <= 2) & F.ltrim("text").startswith("#"))
    title = F.split(F.trim(F.regexp_replace("text", r"^[# ]+", "")), r"\s+[—–|]\s+|\s+-\s+", 2)[0]
    out = heads.groupBy("doc_id").agg(F.min_by(T.flat(title), "place").alias("subject"))
    return out.filter("subject <> ''")


def focus(prompts: DataFrame, named: DataFrame) -> DataFrame:
    """(item_id, subject): subjects that stand in a prompt as whole words, the longest first, none over another.

    A subject meets the prompts that hold its first word; places are found and chosen in the arrays of one prompt.
    """
    asked = prompts.select("item_id", T.flat(F.col("text")).alias("asked"))
    first = F.regexp_extract("subject", T.WORD, 0)
    subject = named.select(T.flat(F.col("subject")).alias("subject")).distinct().withColumn("word", first).filter("word <> ''")
    met = asked.select("item_id", "asked", F.explode(F.array_distinct(T.words(F.col("asked")))).alias("word")).join(subject, "word")
    size, whole = F.length("subject"), F.length("asked")
    at = lambda i: F.substr(F.col("asked"), i, F.lit(1))
    alone = lambda i: F.coalesce(~at(i - 1).rlike(_SIGN), F.lit(True)) | (i == 1)
    ends = lambda i: ~at(i + size).rlike(_SIGN)
    places = F.filter(F.sequence(F.lit(1), F.greatest(whole - size + 1, F.lit(1))), lambda i: (F.substr(F.col("asked"), i, size) == F.col("subject")) & alone(i) & ends(i))
    spans = met.filter(F.col("asked").contains(F.col("subject"))).select("item_id", F.explode(F.transform(places, lambda i: F.struct((-size).alias("longest"), i.alias("start"), F.col("subject").alias("subject")))).alias("span"))
    listed = spans.groupBy("item_id").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    kind = listed.schema["spans"].dataType.simpleString()
    clash = lambda kept, x: F.exists(kept, lambda y: (x["start"] < y["start"] - y["longest"]) & (y["start"] < x["start"] - x["longest"]))
    kept = F.aggregate("spans", F.array().cast(kind), lambda s, x: F.when(clash(s, x), s).otherwise(F.array_append(s, x)).cast(kind))
    return listed.select("item_id", F.explode(F.array_distinct(F.transform(kept, lambda x: x["subject"]))).alias("subject"))


def restricted_items(blocks: DataFrame, prompts: DataFrame, documents: DataFrame, named: DataFrame, focused: DataFrame) -> DataFrame:
    """(item_id) of prompts that restricted documents refuse: those whose subject a prompt names; without a named subject, those that share a term."""
    closed = documents.filter("restricted").select("doc_id")
    asked = R.prompt_terms(prompts)
    by_name = focused.join(named.join(closed, "doc_id", "left_semi").select("subject").distinct(), "subject", "left_semi").select("item_id")
    unnamed = asked.join(focused.select("item_id").distinct(), "item_id", "left_anti")
    held = blocks.join(closed, "doc_id", "left_semi").select(F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    held = held.join(small(unnamed.select("term").distinct()), "term", "left_semi").distinct()  # few of all words are asked for
    by_term = unnamed.join(held, "term", "left_semi").select("item_id")
    return by_name.join(asked.select("item_id"), "item_id", "left_semi").unionAll(by_term).distinct()


def candidates(documents: DataFrame, named: DataFrame, focused: DataFrame, cap: int | None = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """((item_id, doc_id) of prompts that name a subject of open documents, doc_id of the documents of all other prompts): the first ``cap`` of each."""
    open_ = documents.filter("not restricted").select("doc_id")
    own = focused.join(named.join(open_, "doc_id", "left_semi"), "subject").select("item_id", "doc_id").distinct()
    if cap is None:
        return own, open_
    w = Window.partitionBy("item_id").orderBy("doc_id")
    return own.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= cap).drop("n"), open_.orderBy("doc_id").limit(cap)


def candidate_facts(prompts: DataFrame, documents: DataFrame, own: DataFrame, other: DataFrame) -> DataFrame:
    """(item_id, documents: how many candidates, stale: whether one of them is not current)."""
    fresh = documents.select("doc_id", (~F.col("current")).alias("stale"))
    facts = [F.count("*").alias("documents"), F.coalesce(F.bool_or("stale"), F.lit(False)).alias("stale")]
    mine = own.join(fresh, "doc_id").groupBy("item_id").agg(*facts)
    rest = prompts.select("item_id").join(own.select("item_id").distinct(), "item_id", "left_anti").crossJoin(F.broadcast(other.join(fresh, "doc_id").agg(*facts)))  # one row
    return mine.unionByName(rest)


def candidate_scores(blocks: DataFrame, prompts: DataFrame, documents: DataFrame, cap: int | None = CANDIDATES, named: DataFrame | None = None, focused: DataFrame | None = None) -> DataFrame:
    """(item_id, doc_id, line_no, overlap, score and the blocks' flags) over each prompt's candidates.

    N counts a prompt's candidate documents and f its candidates' blocks with a term. A block is scored by the terms that it shares
    besides its document's subject and directive words, or, if there are none, by all that it shares.
    """
    named = named if named is not None else checkpointed(subjects(blocks))
    focused = focused if focused is not None else checkpointed(focus(prompts, named))
    own, other = candidates(documents, named, focused, cap)
    facts = candidate_facts(prompts, documents, own, other)
    asked = R.prompt_terms(prompts)
    wanted = own.select("doc_id").unionAll(other).distinct()
    tokens = R.asked_terms(blocks.join(small(wanted), "doc_id", "left_semi"), asked, True)
    mine = asked.join(own, "item_id").join(tokens, ["doc_id", "term"])
    rest = asked.join(own.select("item_id").distinct(), "item_id", "left_anti").join(tokens.join(other, "doc_id", "left_semi"), "term")
    met = mine.unionByName(rest.select(*mine.columns))
    frequency = met.groupBy("item_id", "term").agg(F.count("*").alias("f")).join(facts, "item_id")
    weighted = frequency.select("item_id", "term", R.weight(F.col("documents"), F.col("f")).alias("weight"))
    skipped = F.array(*[F.lit(w) for w in T.DIRECTIVES])
    met = met.join(weighted, ["item_id", "term"]).join(named.select("doc_id", T.t1_terms(F.col("subject")).alias("skipped")), "doc_id", "left")
    content = ~F.coalesce(F.array_contains("skipped", F.col("term")), F.lit(False)) & ~F.array_contains(skipped, F.col("term"))
    shown = ["digit", "effective", "heading", "chars", "bytes"]
    out = met.groupBy("item_id", *R.BLOCK).agg(F.count("*").alias("overlap"), F.sum("weight").alias("every"), F.sum(F.when(content, F.col("weight"))).alias("some"), *[F.first(c).alias(c) for c in shown])
    return out.withColumn("score", F.coalesce("some", "every")).drop("some", "every")


def select_blocks(blocks: DataFrame, prompts: DataFrame, documents: DataFrame, limit: int, cap: int | None = CANDIDATES) -> tuple[DataFrame, DataFrame]:
    """(chosen, gates) of every prompt.

    chosen: item_id, doc_id, line_no, score, position. gates: item_id, restricted, stale (a candidate is not current), incomplete (as many
    candidates as the cap, or a block passed over for want of room), cohort. Restricted prompts and those without terms choose nothing.
    Prompts that ask for what shares a named subject's provider get that cohort instead of a ranking: its assignments, then facts of
    its members, under the same limit and budgets; ``cohort`` says whether the provider was resolved (null: no such prompt), unresolved
    ones are incomplete, and stale are those that a document shown makes stale. A cohort's blocks have no score.
    """
    named = checkpointed(subjects(blocks))
    focused = checkpointed(focus(prompts, named))
    shut = checkpointed(restricted_items(blocks, prompts, documents, named, focused))
    asking = prompts.join(R.prompt_terms(prompts).select("item_id").distinct(), "item_id", "left_semi").join(shut, "item_id", "left_anti")
    held = checkpointed(cohort_blocks(blocks, asking, documents, named, focused))
    cohorts = held.groupBy("item_id").agg(F.bool_or("resolved").alias("resolved"))
    asking = asking.join(cohorts, "item_id", "left_anti")
    scored = R.bonuses(candidate_scores(blocks, asking, documents, cap, named, focused), blocks, asking)
    ranked = checkpointed(R.packed_blocks(scored, limit))
    members = checkpointed(packed_cohorts(held, blocks, limit))
    own, other = candidates(documents, named, focused, cap)
    facts = candidate_facts(asking, documents, own, other)
    short = ranked.groupBy("item_id").agg(F.bool_or("short").alias("short"))
    old = members.join(documents.filter("not current").select("doc_id"), "doc_id", "left_semi").select("item_id").distinct().withColumn("old", F.lit(True))
    gates = prompts.select("item_id").join(shut.withColumn("restricted", F.lit(True)), "item_id", "left").join(facts, "item_id", "left").join(short, "item_id", "left").join(cohorts, "item_id", "left").join(old, "item_id", "left")
    no = F.lit(False)
    full = (F.col("documents") == cap) if cap else no
    incomplete = F.coalesce("restricted", no) | F.when(F.col("resolved").isNotNull(), ~F.col("resolved")).otherwise(F.coalesce(full | F.coalesce("short", no), no))
    stale = F.when(F.col("resolved").isNotNull(), F.coalesce("old", no)).otherwise(F.coalesce("stale", no)) & ~F.coalesce("restricted", no)
    chosen = ranked.drop("short").unionByName(members)
    return chosen, gates.select("item_id", F.coalesce("restricted", no).alias("restricted"), stale.alias("stale"), incomplete.alias("incomplete"), F.when(F.col("resolved").isNotNull(), F.when(F.col("resolved"), "resolved").otherwise("unresolved")).alias("cohort"))


def packed_cohorts(held: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """Blocks of cohorts (as ``cohort_blocks`` gives them) in their order, as many as limit and budgets admit."""
    text = F.col("text")
    sizes = blocks.select(*R.BLOCK, F.length(text).cast("long").alias("chars"), F.octet_length(text).cast("long").alias("bytes"))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("part", *R.BLOCK))
    rows = small(held.filter("line_no is not null")).join(sizes, R.BLOCK).withColumn("score", -place.cast("double"))
    return R.packed_blocks(rows.select("item_id", *R.BLOCK, "score", "chars", "bytes"), limit, spread_first=False).select("item_id", *R.BLOCK, F.lit(None).cast("double").alias("score"), "position")


# What an answer says beside its evidence.
SAYS = {
    "restricted": "Restricted evidence cannot be rendered.",
    "stale": "Document freshness requires review.",
    "limited": "Context expansion was limited; evidence may be incomplete.",
    "incomplete": "Evidence-set selection reached a bounded retrieval budget; evidence may be incomplete.",
    "unresolved": "The requested provider assignment was not resolved in eligible source text; do not infer cohort membership.",
}


def query_documents(blocks: DataFrame, prompts: DataFrame, documents: DataFrame, limit: int = 20, radius: int = 0, context_limit: int = 128, most_chars: int = 65_536, generation: str = "") -> tuple[DataFrame, DataFrame]:
    """(outcomes, evidence) of every prompt over one generation of documents.

    outcomes: item_id, query_id, evidence (number), outcome, reason, qualifications. evidence: item_id, position, doc_id, line_no, source_id, current,
    render_text, block_digest, evidence_id, in the order shown: chosen blocks first, then their neighbours while there is room. A prompt that
    is none (``valid_prompt``) is refused as invalid. Identities bind generation, document, block and its text.
    """
    asked = prompts.filter(valid_prompt(F.col("text")))
    chosen, gates = select_blocks(blocks, asked, documents, limit)
    shown = checkpointed(admit_context(chosen, blocks, radius, context_limit, most_chars) if radius or context_limit < limit or most_chars < 65_536 else chosen.select("item_id", *R.BLOCK, "position", F.lit(False).alias("limited")))
    cut = shown.groupBy("item_id").agg(F.bool_or("limited").alias("limited"), F.count("doc_id").alias("n"))
    gates = gates.join(cut.select("item_id", "limited"), "item_id", "left").withColumn("limited", F.coalesce("limited", F.lit(False)))
    decided = outcome(gates.withColumn("incomplete", F.col("incomplete") | F.col("limited")).select("item_id", "restricted", "stale", "incomplete"), cut.select("item_id", "n"))
    said = lambda name, when: F.when(when, F.lit(SAYS[name]))
    incomplete = F.col("incomplete") & ~F.col("restricted")
    told = F.array_compact(F.array(said("limited", F.col("limited") & ~F.col("restricted")), said("unresolved", incomplete & (F.col("cohort") == "unresolved")), said("incomplete", incomplete & F.col("cohort").isNull()), said("restricted", F.col("restricted")), said("stale", F.col("stale"))))
    query = F.concat(F.lit("query-"), F.substring(T.digest(F.col("text"), F.lit(generation), F.lit(limit), F.lit(radius), F.lit(context_limit), F.lit(most_chars)), 8, 24))
    rows = prompts.select("item_id", query.alias("query_id")).join(decided, "item_id", "left").join(gates.select("item_id", told.alias("qualifications")), "item_id", "left")
    outcomes = rows.select("item_id", "query_id", F.coalesce("evidence", F.lit(0)).cast("long").alias("evidence"), F.coalesce("outcome", F.lit("refuse")).alias("outcome"), F.coalesce("reason", F.lit("query_invalid")).alias("reason"), F.coalesce("qualifications", F.array().cast("array<string>")).alias("qualifications"))
    kept = shown.filter("line_no is not null").join(gates.filter("not restricted").select("item_id"), "item_id", "left_semi")
    digest = T.digest(F.col("doc_id"), F.col("line_no"), F.col("text"))
    records = kept.join(blocks.select(*R.BLOCK, "text"), R.BLOCK).join(documents.select("doc_id", "source_id", "current"), "doc_id").withColumn("block_digest", digest)
    return outcomes, records.select("item_id", "position", *R.BLOCK, "source_id", "current", F.col("text").alias("render_text"), "block_digest", T.digest(F.lit(generation), F.col("doc_id"), F.col("line_no"), F.col("block_digest")).alias("evidence_id"))


def assignments(blocks: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, line_no, subject, provider): blocks with a sentence that assigns a document's own subject to a provider; the block's first such sentence.

    Only blocks with the words of an assignment meet the subjects and are cut.
    """
    sentences = F.split(F.trim("text"), r"\n+|(?<=[.!?])\s+")
    stated = blocks.filter(F.col("text").rlike(T.ASSIGNS)).join(named, "doc_id").select("doc_id", "line_no", "subject", F.posexplode(sentences).alias("n", "sentence"))
    part = lambda k: F.regexp_extract(F.trim("sentence"), T.ASSIGNMENT, k)
    found = stated.filter((part(1) != "") & (F.translate(F.lower(part(1)), "_", " ") == F.col("subject")))
    return found.groupBy("doc_id", "line_no", "subject").agg(F.min_by(F.translate(F.lower(part(2)), "_", " "), "n").alias("provider"))


def cohort_blocks(blocks: DataFrame, prompts: DataFrame, documents: DataFrame, named: DataFrame, focused: DataFrame) -> DataFrame:
    """(item_id, doc_id, line_no, part, resolved) of prompts that ask for what shares a named subject's provider.

    part 0: the assignments of that provider (without the named ones where the prompt says other); part 1: blocks of the members, or
    of records of their family, that state owners or invoice facts the prompt asks for. A prompt whose subject has no
    assignment gives one row without a block. Restricted documents are not read.
    """
    open_ = documents.filter("not restricted").select("doc_id", F.substring_index("source_id", "-", 1).alias("family"))
    readable = blocks.join(open_, "doc_id")
    given = checkpointed(assignments(readable.select(*R.BLOCK, "text"), named))
    text = F.col("text")
    asking = prompts.filter(text.rlike(COHORT) & text.rlike(PROVIDER)).join(focused.select("item_id").distinct(), "item_id", "left_semi")
    asking = asking.select("item_id", text.rlike(OTHER).alias("other"), text.rlike(OWNER).alias("owner"), text.rlike(INVOICE_ASKED).alias("invoice"))
    providers = focused.join(given.select("subject", "provider").distinct(), "subject").select("item_id", "provider").distinct()
    members = providers.join(given, "provider").join(asking, "item_id").join(focused.withColumn("own", F.lit(True)), ["item_id", "subject"], "left")
    stated = members.filter(~(F.col("other") & F.coalesce("own", F.lit(False)))).select("item_id", *R.BLOCK, F.lit(0).alias("part"))
    related = members.join(open_, "doc_id")
    facts = readable.join(named, "doc_id", "left").withColumn("owns", text.rlike(OWNER)).withColumn("bills", text.rlike("[0-9]") & text.rlike(INVOICE_TOLD)).filter("owns or bills")
    by = lambda c: related.select("item_id", c, "owner", "invoice").distinct()
    told = small(by("subject")).join(facts, "subject").unionByName(small(by("family")).join(facts, "family"), allowMissingColumns=True)
    told = told.filter("(owner and owns) or (invoice and bills)").select("item_id", *R.BLOCK, F.lit(1).alias("part"))
    rows = stated.unionByName(told).groupBy("item_id", *R.BLOCK).agg(F.min("part").alias("part"))
    return asking.select("item_id").join(rows, "item_id", "left").join(providers.select("item_id").distinct().withColumn("resolved", F.lit(True)), "item_id", "left").select("item_id", *R.BLOCK, "part", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def admit_context(chosen: DataFrame, blocks: DataFrame, radius: int, limit: int, most_chars: int) -> DataFrame:
    """(item_id, doc_id, line_no, position, limited): chosen blocks in their order, then their neighbours, while there is room; none twice."""
    near = R.context_window(blocks, radius) if radius else blocks.select(*R.BLOCK, F.lit("").alias("neighbours"))
    sizes = blocks.select(*R.BLOCK, F.length("text").alias("chars"))
    seeds = chosen.join(sizes, R.BLOCK).join(near, R.BLOCK).select("item_id", "position", *R.BLOCK, "chars", F.filter(F.split("neighbours", ","), lambda x: x != "").alias("near"))
    first = seeds.select("item_id", F.lit(0).alias("round"), "position", F.lit(0).alias("k"), *R.BLOCK, "chars", F.lit(None).cast("int").alias("seed"))
    around = seeds.select("item_id", F.lit(1).alias("round"), "position", "doc_id", F.col("line_no").alias("seed"), F.posexplode("near").alias("k", "line"))
    around = around.withColumn("line_no", F.col("line").cast("int")).join(sizes, R.BLOCK).select(*first.columns)
    listed = first.unionByName(around).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("round", "position", "k", *R.BLOCK, "chars", "seed"))).alias("rows"))
    item = listed.schema["rows"].dataType.simpleString()
    kind = f"struct<chosen:{item},chars:bigint,limited:boolean>"
    empty = F.struct(F.array().cast(item).alias("chosen"), F.lit(0).alias("chars"), F.lit(False).alias("limited")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        has = lambda doc, line: F.exists(s["chosen"], lambda y: (y["doc_id"] == doc) & (y["line_no"] == line))
        offered = ~has(x["doc_id"], x["line_no"]) & (x["seed"].isNull() | has(x["doc_id"], x["seed"]))
        room = (F.size(s["chosen"]) < limit) & (s["chars"] + x["chars"] <= most_chars)
        entered = F.struct(F.array_append(s["chosen"], x).alias("chosen"), (s["chars"] + x["chars"]).alias("chars"), s["limited"].alias("limited"))
        passed = F.struct(s["chosen"].alias("chosen"), s["chars"].alias("chars"), (s["limited"] | offered).alias("limited"))
        return F.when(offered & room, entered).otherwise(passed).cast(kind)

    done = listed.select("item_id", F.aggregate("rows", empty, step).alias("s"))
    out = done.select("item_id", F.col("s.limited").alias("limited"), F.posexplode_outer("s.chosen").alias("at", "x"))
    return out.select("item_id", "x.doc_id", "x.line_no", (F.col("at") + 1).cast("long").alias("position"), "limited")


def outcome(gates: DataFrame, evidence: DataFrame) -> DataFrame:
    """(item_id, evidence, outcome, reason): restricted, then a candidate that is not current, then evidence; partial where a limit cut it.

    gates: item_id, restricted, stale, incomplete; evidence: item_id, n blocks.
    """
    rows = gates.join(evidence, "item_id", "left").withColumn("n", F.when(F.col("restricted"), 0).otherwise(F.coalesce("n", F.lit(0))))
    found = F.col("n") > 0
    what = F.when(F.col("restricted"), "refuse").when(F.col("stale"), "investigate").when(found & F.col("incomplete"), "partial").when(found, "answer").otherwise("refuse")
    why = F.when(F.col("restricted"), "restricted_evidence").when(F.col("stale"), "freshness_investigation_required").when(found, "ok").otherwise("no_evidence")
    return rows.select("item_id", F.col("n").cast("long").alias("evidence"), what.alias("outcome"), why.alias("reason"))


def valid_prompt(text: Column) -> Column:
    """1 to 1,024 signs, no control, format or unassigned sign, some word."""
    return F.coalesce(F.length(text).between(1, 1024) & ~text.rlike(r"\p{C}") & (F.trim(text) != ""), F.lit(False))
