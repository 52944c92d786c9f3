"""Batched lexical retrieval: every operator is keyed by the prompt, and any number of prompts runs in one job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from factloom.functions import text as T
from factloom.operators.graph import checkpointed, small, with_fields

BLOCK = ["doc_id", "line_no"]
MOST_CHARS = MOST_BYTES = 20_000
#: Best blocks of a prompt that packing looks at first; prompts that need more are folded over all that can matter.
LOOK = 128


def block_terms(blocks: DataFrame, terms=T.t1_terms) -> DataFrame:
    """(doc_id, line_no, term), a term once a block."""
    return blocks.select(*BLOCK, F.explode(terms(F.col("text"))).alias("term"))


def prompt_terms(prompts: DataFrame, terms=T.t1_terms) -> DataFrame:
    return prompts.select("item_id", F.explode(terms(F.col("text"))).alias("term"))


def block_frequency(tokens: DataFrame) -> DataFrame:
    """Number of blocks that hold each term."""
    return tokens.groupBy("term").agg(F.count("*").alias("blocks"))


def weight(documents: Column, frequency: Column) -> Column:
    """max(0.5, log1p((N - f + 0.5) / (f + 0.5))), N documents, f blocks."""
    return F.greatest(F.lit(0.5), F.log1p((documents - frequency + 0.5) / (frequency + 0.5)))


def block_flags(blocks: DataFrame) -> DataFrame:
    """What scores ask of a block besides its terms; patterns are matched once a block."""
    return blocks.select(*BLOCK, "text", F.col("text").rlike("[0-9]").alias("digit"), F.col("text").rlike(T.EFFECTIVE).alias("effective"), F.ltrim("text").startswith("#").alias("heading"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def asked_terms(blocks: DataFrame, asked: DataFrame, flags: bool = False) -> DataFrame:
    """(doc_id, line_no, term) of the terms that any prompt asks, with the blocks' flags if wanted: written once, for all that count or score them.

    The asked terms go to the blocks where they are counted to be few, so other words are dropped as they are cut.
    """
    shown = ["digit", "effective", "heading", "chars", "bytes"] if flags else []
    rows = (block_flags(blocks) if flags else blocks).select(*BLOCK, *shown, F.explode(F.array_distinct(T.words(F.col("text")))).alias("term"))
    return checkpointed(rows.join(small(asked.select("term").distinct()), "term", "left_semi").select(*BLOCK, "term", *shown))


def _scored(tokens: DataFrame, asked: DataFrame, documents: int, shown: list[str]) -> DataFrame:
    weighted = block_frequency(tokens).select("term", weight(F.lit(documents), F.col("blocks")).alias("weight")).join(asked, "term")
    return tokens.join(small(weighted), "term").groupBy("item_id", *BLOCK).agg(F.count("*").alias("overlap"), F.sum("weight").alias("score"), *[F.first(c).alias(c) for c in shown])


@dataclass
class Asked:
    """What prompts ask, as arrays that go to every worker: the prompts of each term, and each prompt's facts."""

    terms: list[str]
    starts: np.ndarray
    prompts: np.ndarray
    weights: np.ndarray
    items: pa.Array
    #: Terms that a block must share before it can hold the phrase, and whether numbers are asked for.
    need: np.ndarray
    cue: np.ndarray


def asked_arrays(prompts: DataFrame, terms=T.t1_terms, most: int = 1_000_000) -> Asked | None:
    """The prompts' terms as arrays, if they are counted to be at most ``most`` rows; weights are 1 until frequencies are known."""
    cue = F.size(F.array_intersect(T.t1_terms(F.col("text")), F.array(*[F.lit(w) for w in T.NUMERIC]))) > 0
    rows = prompts.select("item_id", cue.alias("cue"), (T.t3_text(F.col("text")) != "").alias("phrase"), F.explode_outer(terms(F.col("text"))).alias("term"))
    if rows.limit(most + 1).count() > most:
        return None
    found = rows.orderBy("item_id").toArrow()
    items = found.column("item_id").combine_chunks().dictionary_encode()
    number, many = items.indices.to_numpy(zero_copy_only=False), len(items.dictionary)
    asking = found.column("term").is_valid().to_numpy()
    words = found.column("term").combine_chunks().filter(pa.array(asking)).dictionary_encode()
    own, term = number[asking], words.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(term, kind="stable")
    fact = lambda name: np.bincount(number, weights=found.column(name).to_numpy().astype(float), minlength=many) > 0
    need = np.where(fact("phrase"), np.bincount(own, minlength=many) - 2, 1 << 30)
    return Asked(words.dictionary.to_pylist(), np.searchsorted(term[order], np.arange(len(words.dictionary) + 1)), own[order], np.ones(len(words.dictionary)), items.dictionary, need, fact("cue"))


def block_index(blocks: DataFrame, asked: Asked, flags: bool) -> DataFrame:
    """(doc_id, line_no, flags, terms): the asked terms of each block that has any, as their numbers; written once, for all that count or score them.

    A block's words leave the JVM as one text and are cut and numbered by Arrow, so no word of the corpus becomes an object.
    """
    shown = ["digit", "effective", "heading", "chars", "bytes"] if flags else []
    rows = (block_flags(blocks) if flags else blocks).select(*BLOCK, *shown, T.spaced(F.col("text")).alias("words"))
    wanted = blocks.sparkSession.sparkContext.broadcast(asked.terms)

    def number(batches):
        known = pa.array(wanted.value, pa.string())
        for batch in batches:
            lists = pc.split_pattern(batch.column(batch.num_columns - 1), " ")
            ends = lists.offsets.to_numpy()
            place = pc.index_in(lists.values[ends[0] : ends[-1]], value_set=known)
            hit = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            block = np.searchsorted(ends - ends[0], hit, side="right") - 1
            term = place.drop_null().to_numpy()
            first = np.sort(np.unique(block * len(known) + term, return_index=True)[1])  # a term once a block, where it came first
            many = np.bincount(block[first], minlength=batch.num_rows)
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(term[first].astype(np.int32)))
            yield pa.record_batch([*batch.columns[:-1], own], names=[*batch.schema.names[:-1], "terms"]).filter(pa.array(many > 0))

    return checkpointed(rows.mapInArrow(number, with_fields(rows.drop("words"), "terms array<int>")))


def weighted(index: DataFrame, asked: Asked, documents: int) -> Asked:
    """The same with a weight for each term from its blocks: one row a term comes back."""
    counts = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("f")).toArrow()
    frequency = np.zeros(len(asked.terms))
    frequency[counts.column("t").to_numpy()] = counts.column("f").to_numpy()
    return replace(asked, weights=np.maximum(0.5, np.log1p((documents - frequency + 0.5) / (frequency + 0.5))))


def score_index(index: DataFrame, asked: Asked, best: int | None = None, spread: bool = False, bonus: bool = True, bonused: bool = False) -> DataFrame:
    """(item_id, doc_id, line_no, overlap, score, ...) of every block and prompt that share a term, without a shuffle.

    ``bonus`` adds all but the phrase's. ``best``: only what can be among a prompt's ``best`` blocks leaves a batch: its ``best`` of
    the batch (with ``spread``, as many first blocks of documents and as many others) and blocks that may hold the phrase.
    ``bonused``: only what has a bonus or may hold the phrase leaves a batch.
    """
    held = index.sparkSession.sparkContext.broadcast(asked)
    extra = "numeric_bonus double, effective_bonus double, factor double, chars int, bytes int" if bonus else ""
    kind = StructType([StructField("item_id", from_arrow_type(asked.items.type)), *index.select(*BLOCK).schema.fields, *StructType.fromDDL("overlap long, score double, may boolean" + (", " + extra if extra else "")).fields])

    def score(batches):
        own = held.value
        many = len(own.items)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_numpy()
            term = lists.values.to_numpy()[ends[0] : ends[-1]]
            count = own.starts[term + 1] - own.starts[term]
            block = np.repeat(np.repeat(np.arange(batch.num_rows), np.diff(ends)), count)
            total = int(count.sum())
            place = np.repeat(own.starts[term] - (np.cumsum(count) - count), count) + np.arange(total)
            at, weight = block * many + own.prompts[place], np.repeat(own.weights[term], count)
            dense = batch.num_rows * many <= 1_000_000 + 8 * total
            if dense:  # a place for each block and prompt, so that nothing is sorted
                overlap = np.bincount(at, minlength=batch.num_rows * many)
                pair = np.flatnonzero(overlap)
                overlap, value = overlap[pair], np.bincount(at, weights=weight, minlength=batch.num_rows * many)[pair]
            else:
                pair, at = np.unique(at, return_inverse=True)
                overlap, value = np.bincount(at, minlength=len(pair)), np.bincount(at, weights=weight, minlength=len(pair))
            block, item = pair // many, pair % many
            may = overlap >= own.need[item]
            more = []
            if bonus:
                flag = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("digit", "effective", "heading")}
                more = [np.where(own.cue[item] & flag["digit"][block], 2.0, 0.0), np.where(flag["effective"][block], 1.5, 0.0), np.where(flag["heading"][block], 0.12, 1.0)]
                value = (value + more[0] + more[1]) * more[2]
            value = np.floor(value * 1e6 + 0.5) / 1e6
            keep = np.arange(len(pair))
            if bonused:
                keep = np.flatnonzero(may | (more[0] + more[1] > 0))
            elif best is not None and not batch.column(0).null_count:
                doc, line = (np.unique(batch.column(k).to_numpy(zero_copy_only=False), return_inverse=True)[1][block] for k in (0, 1))
                later, own_rank = np.zeros(len(pair), bool), keep
                if dense and not spread and batch.num_rows > best:  # what is below a prompt's best of the batch is not put in order
                    table = np.full(batch.num_rows * many, -np.inf)
                    table[pair] = value
                    own_rank = np.flatnonzero(value >= np.partition(table.reshape(batch.num_rows, many), -best, axis=0)[-best][item])
                if spread:
                    order = np.lexsort((line, -value, doc, item))
                    later[order[1:]] = (item[order][1:] == item[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                order = own_rank[np.lexsort(tuple(x[own_rank] for x in (line, doc, -value, later, item)))]
                group = item[order] * 2 + later[order]
                head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else group
                rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
                keep = np.sort(np.concatenate([order[rank < best], np.flatnonzero(may)]))
                keep = keep[np.append(True, keep[1:] != keep[:-1])] if len(keep) else keep
            row = pa.array(block[keep])
            sizes = [batch.column(batch.schema.get_field_index(c)).take(row) for c in (("chars", "bytes") if bonus else ())]
            yield pa.record_batch([own.items.take(pa.array(item[keep])), batch.column(0).take(row), batch.column(1).take(row), pa.array(overlap[keep]), pa.array(value[keep]), pa.array(may[keep]), *(pa.array(x[keep]) for x in more), *sizes], names=kind.names)

    return index.mapInArrow(score, kind)


def idf_scores(blocks: DataFrame, prompts: DataFrame, documents: int) -> DataFrame:
    """(item_id, doc_id, line_no, overlap, score to 6 places) of every block that shares a term with the prompt."""
    few = asked_arrays(prompts)
    if few is None:
        asked = prompt_terms(prompts)
        return _scored(asked_terms(blocks, asked), asked, documents, []).withColumn("score", F.round("score", 6))
    index = block_index(blocks, few, False)
    return score_index(index, weighted(index, few, documents), bonus=False).drop("may")


def bonuses(scored: DataFrame, blocks: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds phrase (+10), numeric (+2) and effective-date (+1.5) bonuses to scores that carry their blocks' flags; a heading keeps 0.12 of its score.

    A block can hold the phrase only if it shares all of the prompt's terms but two (the outer words may match in part;
    ``overlap`` counts the terms shared), so few pairs meet their texts.
    """
    terms = T.t1_terms(F.col("text"))
    cue = F.size(F.array_intersect(terms, F.array(*[F.lit(w) for w in T.NUMERIC]))) > 0
    asked = prompts.select("item_id", cue.alias("numeric_cue"), (T.t3_text(F.col("text")) != "").alias("phrase"), F.size(terms).alias("terms"))
    out = scored.join(small(asked), "item_id")
    out = out.withColumns({"numeric_bonus": F.when(F.col("numeric_cue") & F.col("digit"), 2.0).otherwise(0.0), "effective_bonus": F.when(F.col("effective"), 1.5).otherwise(0.0), "factor": F.when(F.col("heading"), 0.12).otherwise(1.0), "may": F.col("phrase") & (F.col("overlap") >= F.col("terms") - 2)})
    out = out.withColumn("score", F.round((F.col("score") + F.col("numeric_bonus") + F.col("effective_bonus")) * F.col("factor"), 6))
    return with_phrase(out.drop("digit", "effective", "heading", "numeric_cue", "phrase", "terms"), blocks, prompts)


def with_phrase(scored: DataFrame, blocks: DataFrame, prompts: DataFrame) -> DataFrame:
    """Adds the phrase's bonus; only pairs that may hold it meet their texts, and where these are counted to be few, they go to the texts."""
    near = small(scored.filter("may").select("item_id", *BLOCK))
    phrase = prompts.select("item_id", T.t3_text(F.col("text")).alias("phrase"))
    held = near.join(blocks.select(*BLOCK, "text"), BLOCK).join(small(phrase), "item_id").filter(T.t3_text(F.col("text")).contains(F.col("phrase"))).select("item_id", *BLOCK, F.lit(10.0).alias("phrase_bonus"))
    out = scored.join(small(checkpointed(held)), ["item_id", *BLOCK], "left").withColumn("phrase_bonus", F.coalesce("phrase_bonus", F.lit(0.0)))
    return out.withColumn("score", F.round(F.col("score") + F.col("phrase_bonus") * F.col("factor"), 6)).drop("may", "factor")


def ranked(blocks: DataFrame, prompts: DataFrame, documents: int, best: int | None = None, spread: bool = False, bonused: bool = False) -> DataFrame:
    """Scores with bonuses over the whole corpus: N is its documents, f its blocks with a term. ``best``: at least each prompt's ``best``. ``bonused``: at least the pairs with a bonus."""
    few = asked_arrays(prompts)
    if few is None:
        asked = prompt_terms(prompts)
        shown = ["digit", "effective", "heading", "chars", "bytes"]
        return bonuses(_scored(asked_terms(blocks, asked, True), asked, documents, shown), blocks, prompts)
    index = block_index(blocks, few, True)
    return with_phrase(checkpointed(score_index(index, weighted(index, few, documents), best, spread, bonused=bonused)), blocks, prompts)


def top_blocks(scored: DataFrame, k: int) -> DataFrame:
    """The k best blocks of each prompt: by score, then document, then place."""
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "line_no")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def diverse_blocks(scored: DataFrame, k: int) -> DataFrame:
    """First the best block of every document, then the others, each by rank; k of each prompt.

    Only a document's first k blocks and the prompt's first k of each pass can be among them, so both windows keep a
    bounded number of rows before the next one.
    """
    own = Window.partitionBy("item_id", "doc_id").orderBy(F.desc("score"), "line_no")
    narrow = scored.withColumn("in_document", F.row_number().over(own)).filter(F.col("in_document") <= k)
    w = Window.partitionBy("item_id").orderBy((F.col("in_document") > 1).cast("int"), F.desc("score"), "doc_id", "line_no")
    return narrow.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _admit(rows: Column, state: Column, kind: str, k: int, most_chars: int, most_bytes: int, spread: bool) -> Column:
    """``state`` after one pass over ``rows`` in their order: a block enters if there is room, and with ``spread`` only as its document's first."""

    def step(s: Column, x: Column) -> Column:
        known = F.exists(s["chosen"], lambda y: (y["doc_id"] == x["doc_id"]) & (F.lit(spread) | (y["line_no"] == x["line_no"])))
        open_ = (F.size(s["chosen"]) < k) & ~known
        fits = (s["chars"] + x["chars"] <= most_chars) & (s["bytes"] + x["bytes"] <= most_bytes)
        entered = F.struct(F.array_append(s["chosen"], x).alias("chosen"), (s["chars"] + x["chars"]).alias("chars"), (s["bytes"] + x["bytes"]).alias("bytes"), s["short"].alias("short"))
        passed = F.struct(s["chosen"].alias("chosen"), s["chars"].alias("chars"), s["bytes"].alias("bytes"), (s["short"] | open_).alias("short"))
        return F.when(open_ & fits, entered).otherwise(passed).cast(kind)

    return F.aggregate(rows, state, step)


def packed_blocks(scored: DataFrame, k: int, most_chars: int = MOST_CHARS, most_bytes: int = MOST_BYTES, rest: Callable[[DataFrame], DataFrame] | None = None, *, spread_first: bool = True) -> DataFrame:
    """Skip-greedy selection under character and byte budgets: one block a document first (unless not ``spread_first``), then the rest.

    (item_id, doc_id, line_no, score, position, short: a block was passed over for want of room). The choice is sequential, so it
    is a fold over each prompt's ``LOOK`` best blocks. Prompts that these do not serve go on with their ``LOOK`` best of the blocks that
    can still enter (of a new document in the first pass, and no larger than the room left, once a block was passed over); the first of
    them always enters, so there are at most k more rounds. ``scored`` may hold no more than the ``LOOK`` best; then ``rest``
    gives all scores of the prompts that it is handed.
    """
    held = scored.select("item_id", *BLOCK, "score", "chars", "bytes")
    held = held if rest else checkpointed(held)
    item = F.struct((-F.col("score")).alias("order"), *BLOCK, F.col("chars").cast("long").alias("chars"), F.col("bytes").cast("long").alias("bytes"))
    inner = held.select(item.alias("x")).schema["x"].dataType.simpleString()
    kind = f"struct<chosen:array<{inner}>,chars:bigint,bytes:bigint,short:boolean>"
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), *BLOCK))

    def listed(rows: DataFrame) -> DataFrame:
        few = rows.withColumn("place", place).filter(F.col("place") <= LOOK)
        return few.groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("rows"))

    def after(lists: DataFrame, state: Column, spread: bool) -> DataFrame:
        return checkpointed(lists.withColumn("state", _admit(F.col("rows"), state, kind, k, most_chars, most_bytes, spread)))  # a row a prompt

    empty = F.struct(F.array().cast(f"array<{inner}>").alias("chosen"), F.lit(0).alias("chars"), F.lit(0).alias("bytes"), F.lit(False).alias("short")).cast(kind)
    first = after(listed(held), empty, spread_first)
    full = F.size("state.chosen") >= k
    done = [first.filter(full).select("item_id", "state"), after(first.filter(~full & (F.col("n") < LOOK)), F.col("state"), False).select("item_id", "state")]
    left = first.filter(~full & (F.col("n") >= LOOK)).select("item_id", "state")
    if left.limit(1).count():
        every = checkpointed((rest(left.select("item_id")) if rest else held.join(left.select("item_id"), "item_id", "left_semi")).select("item_id", *BLOCK, "score", "chars", "bytes"))
        for spread in (True, False) if spread_first else (False,):
            now = left
            while now.limit(1).count():
                s = F.col("state")
                known = F.exists(s["chosen"], lambda y: (y["doc_id"] == F.col("doc_id")) & (F.lit(spread) | (y["line_no"] == F.col("line_no"))))  # noqa: B023
                room = (F.col("chars") <= most_chars - s["chars"]) & (F.col("bytes") <= most_bytes - s["bytes"])
                can = every.join(small(now), "item_id").filter(~known & (room | ~s["short"]))
                moved = after(now.join(listed(can), "item_id", "left").withColumns({"rows": F.coalesce("rows", F.array().cast(f"array<{inner}>")), "n": F.coalesce("n", F.lit(0))}), s, spread)
                over = full | (F.col("n") < LOOK)
                done.append(moved.filter(over if not spread else full).select("item_id", "state"))
                left = moved.filter(over & ~full).select("item_id", "state") if now is left else left.unionByName(moved.filter(over & ~full).select("item_id", "state"))
                now = moved.filter(~over).select("item_id", "state")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    picked = out.select("item_id", F.col("state.short").alias("short"), F.posexplode("state.chosen").alias("at", "x"))
    return picked.select("item_id", "x.doc_id", "x.line_no", (-F.col("x.order")).alias("score"), (F.col("at") + 1).cast("long").alias("position"), "short")


def packed(blocks: DataFrame, prompts: DataFrame, documents: int, k: int) -> DataFrame:
    """``packed_blocks`` of the corpus-wide scores; one index serves the best blocks and, for prompts that need them, all."""
    few = asked_arrays(prompts)
    if few is None:
        return packed_blocks(ranked(blocks, prompts, documents), k)
    index = block_index(blocks, few, True)
    few = weighted(index, few, documents)
    rest = lambda left: with_phrase(checkpointed(score_index(index, few).join(small(left), "item_id", "left_semi")), blocks, prompts)
    return packed_blocks(with_phrase(checkpointed(score_index(index, few, LOOK)), blocks, prompts), k, rest=rest)


def context_window(blocks: DataFrame, radius: int = 2) -> DataFrame:
    """Neighbours of each block within its section, next ones first; a heading ends a section."""
    heading = F.ltrim("text").startswith("#")
    w = Window.partitionBy("doc_id").orderBy("line_no")
    section = blocks.withColumn("heading", heading).withColumn("section", F.sum(heading.cast("int")).over(w))
    own = Window.partitionBy("doc_id", "section", "heading").orderBy("line_no")
    near = [F.lead("line_no", d).over(own) for d in range(1, radius + 1)] + [F.lag("line_no", d).over(own) for d in range(1, radius + 1)]
    return section.select("doc_id", "line_no", F.when(~F.col("heading"), F.array_join(F.transform(F.array_compact(F.array(*near)), lambda x: x.cast("string")), ",")).otherwise("").alias("neighbours"))


def cohort(assignments: DataFrame, named: DataFrame, member: str, provider: str) -> DataFrame:
    """All members that share a provider with a named member."""
    providers = assignments.join(named, member, "left_semi").select(provider).distinct()
    return assignments.join(providers, provider, "left_semi").select(member, provider).distinct()


def record_family(documents: DataFrame, source: str) -> DataFrame:
    """The family of a source id: what stands before its first hyphen."""
    return documents.withColumn("family", F.substring_index(source, "-", 1))
