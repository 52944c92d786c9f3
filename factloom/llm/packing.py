"""Operator 9: best-fit packing by length-histogram planning.

Documents become token ids plus an end id, pieces of at most ``capacity`` ids, and a histogram of piece
lengths. Best-fit decreasing runs over the *counts* on the driver: its input has ``capacity`` entries and its
plan a few rows for each of them, whatever the corpus. Pieces then take the planned slots by their rank
within their length; the ranks come from counts by length and salt, so that a length that most pieces
share is never one task's work.

Null texts are empty texts (one piece, the end id alone); repeated rows are packed each on its own; a null
key stays null; an empty table packs into nothing. Other columns are not read.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import bpe
from factloom.llm.common import stash

#: Pieces to a rank group at most and at least (between them, a quarter of a task's share), and at most so many groups a length.
GROUP_ROWS, LEAST_ROWS, MOST_GROUPS = 20_000, 256, 4096


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32: only documents over ``capacity`` are cut, and only their first piece may be short."""

    def run(batches):
        for rows, ids, first in bpe.encode_blocks(path, batches, "text", special=True):
            source = rows.column(0)
            owner, number, start, length, crc = [], [], [], [], []
            ids = ids.astype("<u4")
            for k, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                at, piece = 0, 0
                while at < len(own):
                    size = len(own) % capacity or capacity if at == 0 else capacity
                    owner.append(k)
                    number.append(piece)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(own[at : at + size].tobytes()))
                    at, piece = at + size, piece + 1
            yield pa.record_batch([source.take(pa.array(owner, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, slots in a sequence, first sequence, offset) rows.

    Open sequences are groups with one residual. Pieces of a length go to the smallest residual that
    holds them, as many to each sequence as fit, since after one of them that sequence is the best fit again.
    """
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # residual: (first sequence, how many)
    out: list[tuple[int, int, int, int, int]] = []
    fresh = 0
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, rank = counts[length], 0
        residuals = sorted(r for r in open_ if r >= length and open_[r])
        while left:
            if residuals:
                residual = residuals[0]
                base, many = open_[residual].pop()
                if not open_[residual]:
                    residuals.pop(0)
            else:
                residual, base, many = capacity, fresh, -(-left // (capacity // length))
                fresh += many
            each = residual // length
            full = min(many, left // each)
            if full:
                out.append((length, rank, each, base, capacity - residual))
                open_[residual - each * length].append((base, full))
                rank, left = rank + full * each, left - full * each
            if full < many and left:
                out.append((length, rank, left, base + full, capacity - residual))
                open_[residual - left * length].append((base + full, 1))
                full, left = full + 1, 0
            if full < many:
                open_[residual].append((base + full, many - full))
    return out


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a *written* table of pieces (its files' row numbers name the rows)."""
    spark = cut.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity)
    share = sum(counts.values()) // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = max(LEAST_ROWS, min(GROUP_ROWS, share))
    groups = [min(MOST_GROUPS, max(1, math.ceil(counts.get(k, 0) / size))) for k in range(capacity + 1)]  # by length, so that no group is larger than another's
    many = F.element_at(F.from_json(F.lit(json.dumps(groups)), "array<int>"), F.col("length").cast("int") + 1)
    named = cut.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("file", "row"), many).cast("int"))
    sizes = named.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("file", "row")) - 1
    ranked = named.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before"))
    by_length: dict[int, np.ndarray] = {}
    for row in rows:
        by_length.setdefault(row[0], []).append(row[1:])
    by_length = {k: np.array(v, np.int64) for k, v in by_length.items()}
    keep = cut.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"

    def place(batches):
        for batch in batches:
            length, rank = batch.column(batch.schema.get_field_index("length")).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length).tolist():
                mine, slots = np.flatnonzero(length == size), by_length[size]
                at = np.searchsorted(slots[:, 0], rank[mine], "right") - 1
                within = rank[mine] - slots[at, 0]
                sequence[mine] = slots[at, 2] + within // slots[at, 1]
                offset[mine] = slots[at, 3] + within % slots[at, 1] * size
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.select(*keep, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document in a sequence."""
    return pack(stash(pieces(docs, path, capacity, end_id, key, text), "pieces"), capacity)
