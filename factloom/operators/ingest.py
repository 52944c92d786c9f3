"""Batch ingestion: parse, judge, distil and record every document of a manifest, with a digest-chained checkpoint."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.sources import blocks as B


def items(manifest: DataFrame, documents: DataFrame, known: DataFrame) -> DataFrame:
    """(item, doc_id, state, reason) of each manifest row: created, unchanged if its digest is known, or rejected."""
    digest = T.digest(F.col("text"))
    quality = B.parse_quality(documents).select("doc_id", "decision")
    rows = manifest.join(documents.select("doc_id", "text", digest.alias("digest")), "doc_id", "left").join(quality, "doc_id", "left").join(known.select("digest").distinct().withColumn("known", F.lit(True)), "digest", "left")
    reason = F.when(F.col("text").isNull(), "source_missing").when(F.col("decision") == "quarantine", "quality_gate").otherwise("")
    state = F.when(reason != "", "rejected").when(F.coalesce("known", F.lit(False)), "unchanged").otherwise("created")
    return rows.select("item", "doc_id", state.alias("state"), reason.alias("reason"))


def distil(blocks: DataFrame, most: int = 512) -> DataFrame:
    """A claim for every body block under the latest heading; the text, its citation, is withheld (null) above ``most`` signs."""
    heading = F.ltrim("text").startswith("#")
    filled = B.forward_fill(blocks, "doc_id", "line_no", heading, F.trim(F.regexp_replace("text", "^[# ]+", "")))
    shown = F.when(F.length("text") <= most, F.col("text")).alias("text")
    return filled.filter(~heading).select("doc_id", "line_no", F.coalesce("concept", F.lit("")).alias("concept"), shown, F.concat(F.lit("claim-"), F.substring(T.digest(F.col("doc_id"), F.col("line_no"), F.col("text")), 8, 24)).alias("claim_id"))


def checkpoint_chain(done: DataFrame, group: str) -> DataFrame:
    """Digest of each prefix of a group's items: every one depends on the one before it, so a group is one fold."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item")
        before, out = "", []
        for item, state in zip(frame["item"], frame["state"], strict=True):
            before = hashlib.sha256(f"{before}|{item}|{state}".encode()).hexdigest()
            out.append((frame[group].iloc[0], item, before))
        return pd.DataFrame(out, columns=[group, "item", "checkpoint"])

    kinds = {f.name: f.dataType.simpleString() for f in done.schema.fields}
    return done.select(group, "item", "state").groupBy(group).applyInPandas(fold, f"{group} {kinds[group]}, item {kinds['item']}, checkpoint string")


def resume(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Manifest rows without a terminal item."""
    return manifest.join(done.select("item"), "item", "left_anti")


def terminal_status(proposals: DataFrame, grants: DataFrame, uses: DataFrame, finished: DataFrame, key: str) -> DataFrame:
    """State of each proposal from the records that exist for it: recovered, applied, authorised, investigate or prepared."""
    mark = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    rows = proposals.select(key).join(mark(grants, "g"), key, "left").join(mark(uses, "u"), key, "left").join(mark(finished, "f"), key, "left").fillna(0, ["g", "u", "f"])
    state = F.when((F.col("f") > 0) & (F.col("u") > 0), "recovered").when((F.col("f") > 1) | (F.col("u") > 1), "investigate").when((F.col("u") > 0) & (F.col("g") > 0), "applied").when(F.col("g") > 0, "authorised").when((F.col("u") > 0) | (F.col("f") > 0), "investigate").otherwise("prepared")
    return rows.select(key, state.alias("state"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds item numbers within each group."""
    return rows.withColumn("item", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
