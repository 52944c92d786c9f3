"""Operator 5: embedding near-duplicates by a pivot-permutation index.

Reference points are a bounded sample of the vectors. A vector is described by its ``NEAREST`` or more (``described``)
reference points in order of rareness, and indexed under every pair of them except those with the last: two vectors
that share at least ``SHARED`` = 3 of them share such a pair. So each inverted list is one pair of pivots, its members
are compared only if they share enough pivots, and the cosine in double precision decides. Every vector is indexed.

Equal vectors are one class with a weight; only classes are compared. A list longer than ``BLOCK`` is cut into
chunks, and each pair of chunks is a unit of work of its own, so no list is gathered in one task. A unit gives link
counts and a spanning forest, never its pairs; a pair is counted in the least list that both of it are in.
The reference points double until the mean list is at most ``MEAN_LIST`` long.

Vectors that are null, zero, or hold null or non-finite components link with nothing. Vectors of each length
are indexed by themselves; vectors of two lengths never link. Repeated rows are vectors of their own
that link with each other. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import vectext as V
from factloom.llm.common import bounded_sample, plan_bytes, stash
from factloom.llm.components import components
from factloom.llm.groups import forest, whole_groups

PIVOTS, MOST_PIVOTS, NEAREST, SHARED, BLOCK, MEAN_LIST = 128, 4096, 6, 3, 1024, 4096
#: Vectors whose postings leave a task together.
POSTED_ROWS = 1024


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that no square overflows or vanishes."""
    block = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    block /= np.abs(block).max(axis=1, keepdims=True)
    return block / np.sqrt((block * block).sum(axis=1, keepdims=True))


def describe(vectors: DataFrame, key: str, embedding: str, kind: str) -> DataFrame:
    """(key, h1, h2, vec): 128 bits of hash and the bytes of each usable vector as it is stored, null for others."""

    width = np.dtype(kind).itemsize

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)  # a null component is no number
            bad, some = (np.concatenate([[0], np.cumsum(x)])[ends] for x in (~np.isfinite(flat), flat != 0))
            usable = lists.is_valid().to_numpy(zero_copy_only=False) & (np.diff(bad) == 0) & (np.diff(some) > 0)
            with np.errstate(over="ignore", invalid="ignore"):
                held = memoryview(flat.astype(kind).tobytes())
            raw = [bytes(held[a:b]) if x else None for a, b, x in zip((ends[:-1] * width).tolist(), (ends[1:] * width).tolist(), usable.tolist(), strict=True)]
            digest = [None if x is None else xxhash.xxh3_128_digest(x) for x in raw]
            high, low = (pa.array([None if d is None else int.from_bytes(d[k : k + 8], "big", signed=True) for d in digest], pa.int64()) for k in (0, 8))
            yield pa.record_batch([batch.column(0), high, low, pa.array(raw, pa.binary())], names=["key", "h1", "h2", "vec"])

    return vectors.select(F.col(key).cast("long").alias("key"), F.col(embedding).cast("array<double>").alias("vec")).mapInArrow(run, "key long, h1 long, h2 long, vec binary")


def described(count: int) -> int:
    """How many of ``count`` reference points describe a vector: the more there are, the fewer of the nearest do near vectors share."""
    return NEAREST + (count > 128) + (count > 256) + 2 * (count > 2048)


def nearest(unit: np.ndarray, pivots: np.ndarray, rank: np.ndarray, many: int = NEAREST) -> np.ndarray:
    """The ``many`` nearest pivots of each vector as ranks, ascending."""
    near = np.argpartition(-(unit @ pivots.T), min(many, len(pivots) - 1), axis=1)[:, :many]
    return np.sort(rank[near], axis=1)


def near_duplicates(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """key, n_links, component_id, kept, class_id of every row."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[embedding].dataType.elementType.simpleString() == "float" else "<f8"
    rows = stash(describe(vectors, key, embedding, kind), "vectors")
    # The class of a vector: the least key of those with equal bytes; null keys form classes among themselves only.
    classes = stash(rows.filter(F.col("h1").isNotNull() & F.col("key").isNotNull()).groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count("*").alias("weight"), F.any_value("vec").alias("vec")), "classes")
    sizes = classes.groupBy(F.length("vec").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").collect()
    links, edges, spent = spark.createDataFrame([], "rep long, n long"), spark.createDataFrame([], "a long, b long"), []
    for r in sizes:  # a length that one class has links with nothing
        if r["n"] > 1:
            own_links, own_edges, used = _links(classes.filter(F.length("vec") == r["size"]), r["n"], least, kind)
            links, edges = links.unionAll(own_links), edges.unionAll(own_edges)
            spent.append(used)
    found = stash(components(edges).withColumnRenamed("node", "rep"), "components")
    counted = classes.select("h1", "h2", "rep", "weight").join(links.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(found, "rep", "left")
    out = rows.select("key", "h1", "h2").join(counted, ["h1", "h2"], "left")  # a hot class is a skewed join
    own = F.coalesce("component", "rep", "key")
    del spent
    return out.select(F.col("key").alias(key), F.when(F.col("key").isNull() | F.col("rep").isNull(), F.lit(0)).otherwise(F.col("weight") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("key").isNotNull(), own).alias("component_id"), F.col("key").eqNullSafe(F.when(F.col("key").isNotNull(), own)).alias("kept"), F.when(F.col("key").isNotNull(), F.coalesce("rep", "key")).alias("class_id"))


def _links(classes: DataFrame, many: int, least: float, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(link counts, forest edges) among classes of one vector length."""
    spark = classes.sparkSession
    count = PIVOTS
    lists = lambda: (described(count) - 1) * (described(count) - 2) // 2  # noqa: E731  pairs among all but the last
    while count < MOST_PIVOTS and many * lists() / (count * (count - 1) / 2) > MEAN_LIST:
        count *= 2
    closest = described(count)
    sample = bounded_sample(classes, "rep", many, 8 * count).select("rep", "vec").orderBy(F.xxhash64("rep")).limit(8 * count).collect()
    pool = _unit([bytes(r["vec"]) for r in sample], kind)
    chosen = [0]  # reference points that are no near copies of one another
    for i in range(1, len(pool)):
        if len(chosen) == count:
            break
        if (pool[chosen] @ pool[i]).max() < 0.8:
            chosen.append(i)
    pivots = pool[chosen]
    use = np.bincount(np.argpartition(-(pool @ pivots.T), min(closest, len(pivots) - 1), axis=1)[:, :closest].ravel(), minlength=len(pivots))
    rank = np.empty(len(pivots), np.int64)
    rank[np.argsort(use, kind="stable")] = np.arange(len(pivots))
    held = spark.sparkContext.broadcast((pivots, rank))  # MOST_PIVOTS vectors at most
    width = min(closest, len(pivots))
    short = len(pivots) <= closest  # then all vectors share all pivots, in one list
    pairs = [(0, 0)] if short else list(itertools.combinations(range(closest - 1), 2))

    def listed(column, order: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest reference points, list of each posting, its vector's row) of a column of vectors."""
        near = nearest(_unit(column.to_pylist(), kind), own, order, closest).astype(np.int32)
        codes = [near[:, a] * np.int64(MOST_PIVOTS) + near[:, b] if not short else np.zeros(len(near), np.int64) for a, b in pairs]
        return near, np.concatenate(codes), np.tile(np.arange(len(near)), len(pairs))

    def count_lists(batches):
        own, order = held.value
        for batch in batches:
            if batch.num_rows:
                code, n = np.unique(listed(batch.column(0), order, own)[1], return_counts=True)
                yield pa.record_batch([pa.array(code), pa.array(n)], names=["list", "n"])

    # At most MOST_PIVOTS ** 2 / 2 lists, whatever the table: two numbers each, 134 MB here and in each worker at the very most.
    sizes = classes.select("vec").mapInArrow(count_lists, "list long, n long").groupBy("list").agg(F.sum("n").alias("n")).filter("n > 1").toArrow()
    codes, many_in = (sizes.column(c).to_numpy() for c in ("list", "n"))
    by_code = np.argsort(codes)
    lengths = spark.sparkContext.broadcast((codes[by_code], many_in[by_code]))

    def post(batches):
        own, order = held.value
        known, size = lengths.value
        for batch in batches:
            for start in range(0, batch.num_rows if len(known) else 0, POSTED_ROWS):
                part = batch.slice(start, POSTED_ROWS)
                near, code, row = listed(part.column(2), order, own)
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                hit = np.flatnonzero(known[at] == code)  # a list of one has no pair
                code, row, chunks = code[hit], row[hit], -(-size[at[hit]] // BLOCK)
                rep = part.column(0).to_numpy()
                with np.errstate(over="ignore"):
                    chunk = (V.mix(rep[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ code.view(np.uint64), 41) % chunks.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.arange(len(code)), chunks)  # a posting meets each chunk of its list
                other = np.arange(len(copy)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                mine = chunk[copy]
                take = pa.array(row[copy])
                body = pa.array([n.tobytes() for n in near], pa.binary()).take(take)
                yield pa.record_batch([pa.array(code[copy]), pa.array(np.minimum(mine, other)), pa.array(np.maximum(mine, other)), pa.array(mine), *(c.take(take) for c in part.columns), body], names=["list", "i", "j", "chunk", "rep", "weight", "vec", "near"])

    units = classes.select("rep", "weight", "vec").mapInArrow(post, "list long, i long, j long, chunk long, rep long, weight long, vec binary, near binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(classes) * len(pairs) // (32 << 20))
    units = units.repartition(parts, "list", "i", "j").sortWithinPartitions("list", "i", "j", "chunk", "rep")

    def verify(batches):
        for rows, bounds in whole_groups(batches, ["list", "i", "j"]):
            rep, weight, chunk = (rows.column(k).to_numpy() for k in ("rep", "weight", "chunk"))
            listed, low, high = (rows.column(k).to_numpy() for k in ("list", "i", "j"))
            unit = _unit(rows.column("vec").to_pylist(), kind)
            near = np.frombuffer(b"".join(rows.column("near").to_pylist()), np.int32).reshape(len(rep), width)
            counts, total, edges = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if low[a] == high[a]:
                    left, right = a, a
                    x = y = unit[a:b]
                else:
                    mid = a + int(np.searchsorted(chunk[a:b], high[a]))
                    left, right, x, y = a, mid, unit[a:mid], unit[mid:b]
                one, two = np.nonzero(x @ y.T >= least - 1e-9)
                one, two = one + left, two + right
                if left == right:
                    one, two = one[one < two], two[one < two]
                if not len(one):
                    continue
                cosine = np.einsum("ij,ij->i", unit[one], unit[two])
                same = near[one][:, :, None] == near[two][:, None, :]
                good = (cosine >= least) & (same.sum(axis=(1, 2)) >= min(SHARED, width))
                if not short:  # counted in the least list of both
                    common = same[:, :-1, :-1].any(axis=2)
                    first = common.argmax(axis=1)
                    common[np.arange(len(one)), first] = False
                    second = common.argmax(axis=1)
                    mine = near[one, first] * np.int64(MOST_PIVOTS) + near[one, second]
                    good &= mine == listed[a]
                one, two = one[good], two[good]
                if len(one):
                    counts += [rep[one], rep[two]]
                    total += [weight[two], weight[one]]
                    node, root = forest(one - a, two - a, b - a)
                    edges.append((rep[node + a], rep[root + a]))
            if counts:
                who, at = np.unique(np.concatenate(counts), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate(total)).astype(np.int64)
                yield pa.record_batch([pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(n)], names=["a", "b", "n"])
                left, right = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
                yield pa.record_batch([pa.array(left), pa.array(right), pa.nulls(len(left), pa.int64())], names=["a", "b", "n"])

    out = stash(units.mapInArrow(verify, "a long, b long, n long"), "links")
    return out.filter("b is null").select(F.col("a").alias("rep"), "n"), out.filter("b is not null").select("a", "b"), out
