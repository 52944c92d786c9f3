"""A corpus pipeline of four operators: language, toxicity, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet into the shared
folder and reads it again as the next stage's documents. All but the last return the columns of documents, as they
came: a column that bears the name of a score or a decision stays the documents' own.

Null texts and texts without a letter have no language, so the first stage rejects them; so do texts that are like no
learnt language. A text without sentences is not toxic. Texts without words are no copies of one another. Rows that
repeat a doc_id are judged each by itself until near_duplicates, which keeps one row of a doc_id and of each group, and
all rows without a doc_id. Very long texts are read whole. An empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, ngram_join, packing, toxicity
from factloom.llm.common import stash, table


def _apart(docs: DataFrame) -> DataFrame:
    """The documents as one column beside their text, so that no result replaces a column of theirs."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("text"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.predict(_apart(docs), langid.fit(docs)).filter("not rejected").select("document.*")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(_apart(docs), model).filter("predicted = 0").select("document.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest doc_id."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("toxicity", clean), ("near_duplicates", distinct), ("packing", pack)]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
