"""Operator 8: byte-level BPE encoding and decoding by corpus-level merge replay (see bpe.py).

Null texts are empty texts: no ids, and the digests of nothing. Repeated rows give repeated rows. Columns
besides ``key`` and ``text`` are not read, so extra or clashing names do not matter. Work is one pass without a
shuffle; a document of any length is whole in its block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import bpe


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>: the ids of every text by the ranks at ``path``, special strings as plain text."""

    def run(batches):
        for rows, ids, first in bpe.encode_blocks(path, batches, "text"):
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
            yield pa.record_batch([rows.column(0), lists], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, data binary: the bytes that each list of ids stands for (null ids: null)."""

    def run(batches):
        tokens = bpe.load(path).tokens
        for batch in batches:
            data = [None if x is None else b"".join([tokens[i] for i in x]) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["key", "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, data binary").withColumnRenamed("key", key)


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of an encode and decode round trip, without moving ids or bytes."""

    def run(batches):
        tokens = bpe.load(path).tokens
        names = [str(i) for i in range(len(tokens))]
        for rows, ids, first in bpe.encode_blocks(path, batches, "text"):
            listed, bounds = ids.tolist(), first.tolist()
            shown, back = [], []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                own = listed[a:b]
                shown.append(hashlib.sha256(" ".join([names[i] for i in own]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([tokens[i] for i in own])).hexdigest())
            yield pa.record_batch([rows.column(0), pa.array(np.diff(first)), pa.array(shown, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
