"""Operator 6: exact Jaccard join on word shingles by prefix filters under several global orders.

A document's set holds its distinct shingles of ``WORDS`` words. Two documents link if their Jaccard similarity is at
least ``percent`` / 100. If it is, then under *any* order of all tokens they share one of the first
n - ceil(percent * n / 100) + 1 tokens of each set, n its size. The orders used here begin with the rarest tokens and
break ties by different hashes, so candidates must share a prefix token under each of ``ORDERS`` orders; the
intersection of these filters is verified over whole sets.

How the plan stays bounded:

* Equal sets are one class, named by a 64-bit hash of the set (and its size); only classes are compared.
* Token frequencies are exact over all documents. Tokens travel as 6 bytes with their documents' class names, packed by
  bucket; a token of a single class is dropped there, so only repeated tokens come back. A token is verified by these 48
  bits and up to 14 of its bucket: two of a pair's tokens are taken for one once in 10**9 pairs of 500 tokens at 64
  buckets, and less often the more buckets there are. Tokens in over ``HOT`` of all
  documents are found first (heavy hitters; at most mean set size / HOT of them, whatever the corpus), are never
  shuffled, and stand last in every order.
* A class whose repeated tokens are under ``percent`` of its set has no partner and goes no further.
* A prefix list of at most ``SMALL`` classes gives its pairs. A longer one gives one star around a pivot; only where its
  members are not yet one component, its classes are packed into blocks of bounded size, and each pair of blocks that
  share a prefix token under every order is a unit of work that gives a spanning forest. No list is gathered whole, no group
  emits its pairs, and no link between different sets is lost to the components.

Null and empty texts, and texts without words, have the empty set and link with nothing. A text of fewer than
``WORDS`` words has one shingle, all of them. Rows that repeat a key share its component; a null key has none. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import vectext as V
from factloom.llm.common import plan_bytes, stash, unstash
from factloom.llm.components import components
from factloom.llm.groups import forest, whole_groups

WORDS, PERCENT, ORDERS, SMALL = 5, 80, 3, 32
#: A token in more than this share of the documents (and in more than 4 of each batch's) is hot for certain; one in less than half of it never.
HOT = 0.001
#: A list longer than HEAVY meets its classes by broadcast, if there are at most SMALL_ROWS such lists.
HEAVY, SMALL_ROWS = 256, 1_000_000
BUCKET_BYTES, BATCH_TOKENS, BLOCK_TOKENS = 8 << 20, 1_000_000, 1 << 16
_K = np.array([pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every document of a block."""
    low = V.lower_ascii(data)
    starts, ends, first = V.word_spans(low, offsets)
    own = V.span_hashes(low, starts, ends)
    with np.errstate(over="ignore"):
        many = max(len(own) - words + 1, 0)
        run = np.zeros(many, np.uint64)
        for k in range(words):
            run += own[k : k + many] * _K[k]
        run = V.mix(run, 5)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        elif b > a:
            with np.errstate(over="ignore"):
                out.append(V.mix(np.array([(own[a:b] * _K[: b - a]).sum()], np.uint64), b - a + 100))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _name(tokens: np.ndarray) -> int:
    """Class name of a set."""
    with np.errstate(over="ignore"):
        total = V.mix(tokens, 9).sum(dtype=np.uint64) + np.uint64(len(tokens)) * np.uint64(0xD6E8FEB86659FD93)
    return int(V.mix(np.array([total], np.uint64), 11).view(np.int64)[0])


def _batches(batches, width: int):
    """(rows, sets) of several blocks together, about BATCH_TOKENS tokens."""
    rows, sets, size = [], [], 0
    for part, data, offsets in V.blocks(batches, "text", 1 << 20):
        own = shingle_sets(data, offsets)
        rows.append(part.select(list(range(width))) if width else None)
        sets += own
        size += sum(map(len, own))
        if size >= BATCH_TOKENS:
            yield rows, sets
            rows, sets, size = [], [], 0
    if sets:
        yield rows, sets


def profiles(docs: DataFrame) -> DataFrame:
    """Rows (key, n, name, null) of documents and rows (token, count, null, 'hot') of locally frequent tokens."""

    def run(batches):
        for rows, sets in _batches(batches, 1):
            yield pa.record_batch([pa.concat_arrays([r.column(0) for r in rows]), pa.array([len(s) for s in sets], pa.int64()), pa.array([_name(s) for s in sets], pa.int64()), pa.array([False] * len(sets), pa.bool_())], names=["key", "n", "name", "hot"])
            token, count = np.unique(np.concatenate(sets), return_counts=True)
            often = count >= max(2, HOT / 2 * len(sets))
            yield pa.record_batch([pa.array(token[often].view(np.int64)), pa.array(count[often]), pa.nulls(int(often.sum()), pa.int64()), pa.array([True] * int(often.sum()), pa.bool_())], names=["key", "n", "name", "hot"])

    return docs.select("key", "text").mapInArrow(run, "key long, n long, name long, hot boolean")


def _scatter(docs: DataFrame, hot, buckets: int) -> DataFrame:
    """Packed tokens by bucket (kind 0), and packed sizes and hot tokens of classes by target (kind 1)."""

    def run(batches):
        known = hot.value
        for _, sets in _batches(batches, 0):
            name = np.array([_name(s) for s in sets], np.int64)
            once = np.unique(name, return_index=True)[1]
            sets, name = [sets[i] for i in once.tolist()], name[once]
            size = np.array([len(s) for s in sets], np.int64)
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            if len(known) and len(flat):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = known[at] == flat
            else:
                at, often = np.zeros(len(flat), np.int64), np.zeros(len(flat), bool)
            target = (V.mix(name.view(np.uint64), 3) % np.uint64(buckets)).astype(np.int64)
            many = np.bincount(owner[often], minlength=len(sets))
            rows: list[tuple] = []
            before = np.concatenate([[0], np.cumsum(many)])
            listed = at[often]
            order = np.argsort(target, kind="stable")
            edges = np.concatenate([[0], np.flatnonzero(np.diff(target[order])) + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                mine = order[a:b]
                mine = mine[size[mine] > 0]
                if len(mine):
                    rows.append((int(target[mine[0]]), 1, name[mine].tobytes(), size[mine].astype(np.int32).tobytes(), listed[V.ragged(before[mine], many[mine])].astype(np.int32).tobytes(), many[mine].astype(np.int32).tobytes()))
            flat, owner = flat[~often], owner[~often]
            bucket = ((flat >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets < 65_536 else bucket, kind="stable")
            flat, owner, bucket = flat[order], owner[order], bucket[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                who, n = np.unique(owner[a:b], return_counts=True)
                rows.append((int(bucket[a]), 0, name[who].tobytes(), n.astype(np.int32).tobytes(), (flat[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), ((flat[a:b] >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            for k in range(0, len(rows), 64):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 64], strict=True), kinds, strict=True)], names=["bucket", "kind", "names", "counts", "low", "high"])

    return docs.select("text").mapInArrow(run, "bucket int, kind int, names binary, counts binary, low binary, high binary")


def _join(column) -> bytes:
    return b"".join(column.to_pylist())


def _repeated(packed: DataFrame, buckets: int) -> DataFrame:
    """Of each bucket, the tokens of several classes, packed again by the classes' targets; kind 1 passes."""

    def run(batches):
        for rows, bounds in whole_groups(batches, ["bucket"]):
            bucket, kind = rows.column("bucket").to_numpy(), rows.column("kind").to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = rows.slice(a, b - a)
                if (kind[a:b] == 1).any():
                    yield from own.filter(pa.array(kind[a:b] == 1)).rename_columns(["target", "kind", "names", "counts", "low", "high"]).combine_chunks().to_batches()
                own = own.filter(pa.array(kind[a:b] == 0))
                if not own.num_rows:
                    continue
                token = np.frombuffer(_join(own.column("low")), np.uint32).astype(np.uint64) | np.frombuffer(_join(own.column("high")), np.uint16).astype(np.uint64) << np.uint64(32)
                name = np.repeat(np.frombuffer(_join(own.column("names")), np.int64), np.frombuffer(_join(own.column("counts")), np.int32))
                order = np.argsort(token, kind="stable")
                sorted_ = token[order]
                same = np.zeros(len(order) + 1, bool)
                same[1:-1] = sorted_[1:] == sorted_[:-1]
                order = order[same[1:] | same[:-1]]
                token, name = token[order], name[order]
                order = np.lexsort((name, token))
                token, name = token[order], name[order]
                fresh = np.ones(len(token), bool)
                fresh[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
                token, name = token[fresh], name[fresh]
                _, at, df = np.unique(token, return_inverse=True, return_counts=True)
                df = df[at]
                keep = df > 1
                token, name, df = token[keep], name[keep], np.minimum(df[keep], 65_535).astype(np.uint16)
                if not len(token):
                    continue
                target = (V.mix(name.view(np.uint64), 3) % np.uint64(buckets)).astype(np.int32)
                order = np.lexsort((token, name, target))
                token, name, df, target = token[order] | np.uint64((int(bucket[a]) & 0x3FFF) << 48), name[order], df[order], target[order]
                edges = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1, [len(target)]])
                out = []
                for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    start = np.concatenate([[x], np.flatnonzero(np.diff(name[x:y])) + 1 + x])
                    out.append((int(target[x]), 0, name[start].tobytes(), np.diff(np.append(start, y)).astype(np.int32).tobytes(), token[x:y].tobytes(), df[x:y].tobytes()))
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["target", "kind", "names", "counts", "low", "high"])

    dealt = packed.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "target int, kind int, names binary, counts binary, low binary, high binary")


def _sets(packed: DataFrame, buckets: int, percent: int) -> DataFrame:
    """(name, n, tokens, pre1, pre2, pre3) of the classes that may have a partner: their repeated tokens and prefixes."""

    def run(batches):
        for rows, bounds in whole_groups(batches, ["target"]):
            kind = rows.column("kind").to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = rows.slice(a, b - a)
                docs, found = own.filter(pa.array(kind[a:b] == 1)), own.filter(pa.array(kind[a:b] == 0))
                name = np.frombuffer(_join(docs.column("names")), np.int64)
                size = np.frombuffer(_join(docs.column("counts")), np.int32).astype(np.int64)
                hot, many = np.frombuffer(_join(docs.column("low")), np.int32), np.frombuffer(_join(docs.column("high")), np.int32).astype(np.int64)
                before = np.cumsum(many) - many
                _, once = np.unique(name, return_index=True)  # sorted names
                name, size, many, before = name[once], size[once], many[once], before[once]
                who = np.repeat(np.frombuffer(_join(found.column("names")), np.int64), np.frombuffer(_join(found.column("counts")), np.int32))
                token, df = np.frombuffer(_join(found.column("low")), np.int64), np.frombuffer(_join(found.column("high")), np.uint16)
                order = np.argsort(who, kind="stable")
                who, token, df = who[order], token[order], df[order]
                lo, hi = np.searchsorted(who, name), np.searchsorted(who, name, "right")
                may = np.flatnonzero(100 * (hi - lo + many) >= percent * size)
                out: list[list] = [[] for _ in range(3 + ORDERS)]
                for i in may.tolist():
                    n, t, f, h = int(size[i]), token[lo[i] : hi[i]], df[lo[i] : hi[i]], hot[before[i] : before[i] + many[i]].astype(np.int64) | (1 << 62)
                    take = n - (percent * n + 99) // 100 + 1 - (n - len(t) - len(h))
                    if take <= 0:
                        continue
                    every = np.concatenate([t, h])
                    rare = np.concatenate([f, np.full(len(h), 65_535, np.uint16)]).astype(np.int64)
                    coarse = np.where(rare < 65_535, np.log2(rare).astype(np.int64), 99)
                    out[0].append(int(name[i]))
                    out[1].append(n)
                    out[2].append(np.sort(every))
                    for k in range(ORDERS):
                        level = rare if k == 0 else coarse if k == 1 else coarse // 2
                        first = np.lexsort((V.mix(every.view(np.uint64), 20 + k), level))[:take]
                        out[3 + k].append(every[first])
                for x in range(0, len(out[0]), 500):
                    yield pa.record_batch([pa.array(out[0][x : x + 500], pa.int64()), pa.array(out[1][x : x + 500], pa.int64()), *(pa.array(c[x : x + 500], pa.list_(pa.int64())) for c in out[2:])], names=["name", "n", "tokens", *(f"pre{k + 1}" for k in range(ORDERS))])

    dealt = packed.repartitionById(buckets, F.col("target")).sortWithinPartitions("target")
    return dealt.mapInArrow(run, "name long, n long, tokens array<long>, " + ", ".join(f"pre{k + 1} array<long>" for k in range(ORDERS)))


def _small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted to be small."""
    return F.broadcast(written) if written.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else written


def _fits(a: str, b: str, percent: int):
    return (F.lit(percent) * F.greatest(a, b)) <= (F.lit(100) * F.least(a, b))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those that pass the other orders and link."""
    def side(end: str, columns: list[str]) -> DataFrame:
        return sets.select(F.col("name").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])

    more = [f"pre{k + 1}" for k in range(1, ORDERS)]
    filtered = pairs.join(side("a", more), "a").join(side("b", more), "b")
    for c in more:
        filtered = filtered.filter(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    full = filtered.select("a", "b").join(side("a", ["n", "tokens"]), "a").join(side("b", ["n", "tokens"]), "b")
    inter = F.size(F.array_intersect("tokens_a", "tokens_b"))
    full = full.withColumn("inter", inter)
    return full.filter(F.lit(100) * F.col("inter") >= F.lit(percent) * (F.col("n_a") + F.col("n_b") - F.col("inter"))).select("a", "b")


def _pack_blocks(members: DataFrame, parts: int) -> DataFrame:
    """One row a block: its classes' names, sizes, tokens and token counts."""

    def run(batches):
        for rows, bounds in whole_groups(batches, ["block"]):
            block, name, n = rows.column("block").to_numpy(), rows.column("name").to_numpy(), rows.column("n").to_numpy()
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                tokens = rows.column("tokens").slice(a, b - a).combine_chunks()
                count = np.diff(tokens.offsets.to_numpy()).astype(np.int32)
                yield pa.record_batch([pa.array([int(block[a])], pa.int64()), *(pa.array([x], pa.binary()) for x in (name[a:b].tobytes(), n[a:b].tobytes(), tokens.flatten().to_numpy().tobytes(), count.tobytes()))], names=["block", "names", "sizes", "tokens", "counts"])

    dealt = members.select("block", "name", "n", "tokens").repartition(parts, "block").sortWithinPartitions("block", "name")
    return dealt.mapInArrow(run, "block long, names binary, sizes binary, tokens binary, counts binary")


def _shared(x: tuple, y: tuple) -> np.ndarray:
    """Sizes of the intersections of all sets of two blocks."""
    (tx, cx), (ty, cy) = x, y
    both = np.intersect1d(tx, ty)
    out = np.zeros((len(cx), len(cy)), np.float32)
    at = [np.searchsorted(both, t) for t in (tx, ty)]
    who = [np.repeat(np.arange(len(c)), c) for c in (cx, cy)]
    for k, t in enumerate((tx, ty)):
        hit = np.flatnonzero((at[k] < len(both)) & (both[np.minimum(at[k], max(len(both) - 1, 0))] == t)) if len(both) else np.zeros(0, np.int64)
        at[k], who[k] = at[k][hit], who[k][hit]
    for start in range(0, len(both), 4096):
        side = []
        for k, c in enumerate((cx, cy)):
            m = np.zeros((len(c), 4096), np.float32)
            hit = (at[k] >= start) & (at[k] < start + 4096)
            m[who[k][hit], at[k][hit] - start] = 1
            side.append(m)
        out += side[0] @ side[1].T
    return out


def _dense_links(units: DataFrame, percent: int) -> DataFrame:
    """Forests of the links within pairs of blocks."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left = [np.frombuffer(row[f"{c}_a"], d) for c, d in (("names", np.int64), ("sizes", np.int64), ("tokens", np.int64), ("counts", np.int32))]
                right = [np.frombuffer(row[f"{c}_b"], d) for c, d in (("names", np.int64), ("sizes", np.int64), ("tokens", np.int64), ("counts", np.int32))]
                inter = _shared((left[2], left[3]), (right[2], right[3])).astype(np.int64)
                union = left[1][:, None] + right[1][None, :] - inter
                one, two = np.nonzero(100 * inter >= percent * union)
                names = np.concatenate([left[0], right[0]])
                node, root = forest(one, two + len(left[0]), len(names))
                yield pa.record_batch([pa.array(names[node]), pa.array(names[root])], names=["a", "b"])
                if row["block_a"] == row["block_b"]:  # node numbers of one class on either side
                    yield pa.record_batch([pa.array(left[0]), pa.array(right[0])], names=["a", "b"])

    return units.mapInArrow(run, "a long, b long").filter("a <> b")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan_bytes(docs) // BUCKET_BYTES)
    profile = stash(profiles(docs), "profiles")
    rows = profile.filter("not hot").select("key", "n", "name")
    many = rows.count()
    often = profile.filter("hot").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, HOT / 2 * many)).select("key").collect()  # mean set size / (HOT / 2) at most
    hot = spark.sparkContext.broadcast(np.sort(np.array([r["key"] for r in often], np.int64).view(np.uint64)))
    sets = stash(_sets(_repeated(_scatter(docs, hot, buckets), buckets), buckets, percent), "sets")
    lists = sets.select("name", "n", F.explode("pre1").alias("token"))
    pivot = F.min(F.struct(F.xxhash64("name").alias("h"), F.col("name").alias("name"), F.col("n").alias("n")))
    sizes = stash(lists.groupBy("token").agg(F.count("*").alias("c"), pivot.alias("pivot")).filter("c > 1").select("token", "c", F.col("pivot.name").alias("pivot"), F.col("pivot.n").alias("pivot_n")), "sizes")
    heavy = _small(sizes.filter(F.col("c") > HEAVY))
    few = lists.join(heavy.select("token"), "token", "left_anti").join(sizes.filter(F.col("c") <= HEAVY), "token")
    listed = stash(few.unionByName(lists.join(heavy, "token")).select("token", "name", "n", "c", "pivot", "pivot_n"), "lists")
    small = listed.filter(F.col("c") <= SMALL).select("token", "name", "n")
    pairs = small.select("token", F.col("name").alias("a"), F.col("n").alias("x")).join(small.select("token", F.col("name").alias("b"), F.col("n").alias("y")), "token").filter("a < b").filter(_fits("x", "y", percent)).select("a", "b")
    large = listed.filter((F.col("c") > SMALL) & (F.col("name") != F.col("pivot")))
    stars = large.filter(_fits("n", "pivot_n", percent)).select(F.least("name", "pivot").alias("a"), F.greatest("name", "pivot").alias("b"))
    candidates = stash(pairs.unionAll(stars).distinct(), "pairs")
    edges = stash(_verified(candidates, sets, percent), "edges")
    if large.limit(1).count():
        edges = stash(edges.unionAll(_open_lists(listed.filter(F.col("c") > SMALL), sets, edges, percent)), "edges")
    for done in (sets, sizes, listed, candidates):
        unstash(done)
    # Classes by their least key: then the least label of a component is the smallest key reachable.
    classes = stash(rows.filter("n > 0 and key is not null").groupBy("name", "n").agg(F.min("key").alias("rep")), "classes")
    ids = classes.select("name", "rep")
    named = edges.join(ids.select(F.col("name").alias("a"), F.col("rep").alias("ra")), "a").join(ids.select(F.col("name").alias("b"), F.col("rep").alias("rb")), "b")
    found = stash(components(named.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "components")
    labelled = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("name", "n", F.coalesce("component", "rep").alias("component"))
    out = rows.join(labelled, ["name", "n"], "left")  # a hot class is a skewed join
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("key").isNotNull(), F.coalesce("component", "key")).alias("component_id"))


def _open_lists(listed: DataFrame, sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """Links in long lists whose members are not one component yet."""
    spark = listed.sparkSession
    label = stash(components(edges), "labels")
    placed = listed.select("token", "name", "n").join(label.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    open_ = stash(placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token"), "tokens")
    placed = stash(placed.join(_small(open_), "token"), "open")
    # A block holds classes of one large component, or of one list; its size is bounded by their tokens.
    members = placed.groupBy("name").agg(F.any_value("n").alias("n"), F.any_value("component").alias("component"), F.min("token").alias("token"))
    grown = members.groupBy("component").agg(F.count("*").alias("m")).filter("m > 64")
    members = members.join(grown, "component", "left").withColumn("group", F.when(F.col("m").isNotNull(), F.xxhash64(F.lit(1), "component")).otherwise(F.xxhash64(F.lit(2), "token")))
    chunks = members.groupBy("group").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("chunks"))
    members = stash(members.join(chunks, "group").select("name", "n", "component", F.xxhash64("group", F.pmod(F.xxhash64("name"), "chunks")).alias("block")), "members")
    pure = members.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).select("block", F.when(F.col("x") == F.col("y"), F.col("x")).alias("only"))
    tokens = placed.select("token", "name").join(members.select("name", "block"), "name").select("token", "block").distinct().join(pure, "block")
    units = tokens.select("token", F.col("block").alias("block_a"), F.col("only").alias("only_a")).join(tokens.select("token", F.col("block").alias("block_b"), F.col("only").alias("only_b")), "token")
    units = units.filter("block_a <= block_b and not coalesce(only_a = only_b, false)").select("block_a", "block_b").distinct()
    # The other orders: a link between two blocks needs a prefix token of each order that both hold.
    held = members.select("name", "block").join(sets, "name")
    more = [f"pre{k + 1}" for k in range(1, ORDERS)]
    prefixes = stash(held.select("block", *more).groupBy("block").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in more]), "prefixes")  # BLOCK_TOKENS a block at most

    def filters(end: str) -> DataFrame:
        return prefixes.select(F.col("block").alias(f"block_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in more])

    units = units.join(filters("a"), "block_a").join(filters("b"), "block_b")
    for c in more:
        units = units.filter(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    units = stash(units.select("block_a", "block_b"), "units")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), units.count() // 64)
    packed = stash(_pack_blocks(held.select("block", "name", "n", "tokens"), parts), "blocks")

    def side(end: str) -> DataFrame:
        return packed.select(F.col("block").alias(f"block_{end}"), *[F.col(c).alias(f"{c}_{end}") for c in ("names", "sizes", "tokens", "counts")])

    work = units.join(side("a"), "block_a").join(side("b"), "block_b").repartition(parts, "block_a", "block_b")
    return _dense_links(work, percent)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of ``docs``, one of each component: the one with the smallest key (one row of a repeated key)."""
    kept = join(docs, key, text, percent).filter(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("kept")).agg(F.count("*").alias("rows"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))  # no column of theirs can clash with ours
    held = whole.join(kept, F.col(f"document.`{key}`") == F.col("kept"))
    once = held.filter("rows = 1").select("document.*")
    again = held.filter("rows > 1").dropDuplicates(["kept"]).select("document.*")
    return once.unionByName(again).unionByName(docs.filter(F.col(key).isNull()))
