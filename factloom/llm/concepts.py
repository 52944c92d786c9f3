"""Operator 11: closed frequent itemsets and their rules, by close-by-one over the iceberg lattice.

A formal concept is a set of baskets with all items they share; its items (the intent) are a closed itemset and the
number of its baskets is the support. Close-by-one extends an intent by one item beyond the last one, closes it (all
items that are in every basket left), and keeps the closure only if it adds no earlier item (the canonicity test): so
each concept is made once. A failed test is inherited: where the items that made it fail are still missing further
down, the same extension fails again and its closure is not computed.

Items are numbered by ascending support, so that an item of many baskets has few extensions. The breadth phase works
on all open concepts of a level at once: extents are rows (intent, items, weight), equal rows are one with their
weights added, counts of items in extensions are summed within a task before the shuffle. It seeds the depth phase:
a concept whose extent has at most ``HEAVY`` items in all (after merging) goes to one task, which goes down from there;
larger ones take another level of breadth, so that nothing unbounded is ever in one task.

The driver holds the frequent items: each is in ``share`` of the baskets, so there are at most the average basket's
size divided by ``share`` of them, whatever the number of baskets.

Rows with a null basket or item count nowhere; repeated rows count once; ties in support are ordered by item; an empty
table has no itemsets; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stash, unstash

#: Items in a concept's extent (equal rows merged) up to which one task goes down from it.
HEAVY = 2_000_000
#: Different (extension, item) counts that a task holds before it sends them on.
HELD = 4_000_000

_NODE = "intent array<int>, last int, support long, locals array<int>, candidates array<int>, fails array<struct<k:int, low:array<int>>>"


def baskets(lines: DataFrame, basket: str, item: str, least: int, per: int) -> tuple[DataFrame, DataFrame, list[int], int, int]:
    """(items array<int>, weight), (item, number, own), supports by number (ascending), number of baskets, least support."""
    spark = lines.sparkSession
    pairs = stash(lines.select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item")).dropna().distinct(), "incidences")
    total = pairs.select("basket").distinct().count()
    enough = max(least, -(-total // per))
    found = sorted((r["own"], r["item"]) for r in pairs.groupBy("item").agg(F.count("*").alias("own")).filter(F.col("own") >= enough).collect())  # at most per * average size of a basket
    numbers = spark.createDataFrame([(item, k, own) for k, (own, item) in enumerate(found)], "item long, number int, own long")
    whole = pairs.join(F.broadcast(numbers.select("item", "number")), "item").groupBy("basket").agg(F.sort_array(F.collect_list("number")).alias("items"))
    rows = stash(whole.groupBy("items").agg(F.count("*").alias("weight")), "baskets")
    unstash(pairs)
    return rows, numbers, [own for own, _ in found], total, enough


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a list column."""
    bounds = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _one(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, n, len(keys)).astype(np.int64)


def _counts(rows: DataFrame, enough: int, width: int) -> DataFrame:
    """(intent, k, i, n): baskets of each concept with both k (one of the row's ``extends``) and i; n of i = k is k's own."""

    def run(batches):
        names: dict[tuple, int] = {}
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def out():
            every = [list(x) for x in names]
            node, rest = np.divmod(keys, width * width)
            k, i = np.divmod(rest, width)
            if len(keys):
                yield pa.record_batch([pa.array([every[x] for x in node.tolist()], pa.list_(pa.int32())), pa.array(k.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(n)], names=["intent", "k", "i", "n"])

        for batch in batches:
            intents, weights = batch.column(0).to_pylist(), batch.column(3).to_numpy()
            extends, first = _lists(batch.column(1))
            items, start = _lists(batch.column(2))
            row = np.repeat(np.arange(batch.num_rows), np.diff(first))  # of each extension
            sizes = np.diff(start)[row]
            upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
            while at < len(row):
                end = max(at + 1, int(np.searchsorted(upto, upto[at] + HELD, "right")) - 1)
                mine, many = row[at:end], sizes[at:end]
                node = np.array([names.setdefault(tuple(intents[r]), len(names)) for r in mine.tolist()], np.int64)
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                code = np.repeat((node * width + extends[at:end]) * width, many) + items[np.repeat(start[mine], many) + within]
                keys, n = _summed(np.concatenate([keys, code]), np.concatenate([n, np.repeat(weights[mine], many)]))
                if len(keys) >= HELD:
                    yield from out()
                    names, keys, n = {}, np.empty(0, np.int64), np.empty(0, np.int64)
                at = end
        yield from out()

    summed = rows.select("intent", "extends", "items", "weight").mapInArrow(run, "intent array<int>, k int, i int, n long")
    return summed.groupBy("intent", "k", "i").agg(F.sum("n").alias("n")).filter(F.col("n") >= enough)


def _inside(some: Column, of: Column) -> Column:
    return F.size(F.array_except(some, of)) == 0


def _children(parents: DataFrame, counts: DataFrame) -> DataFrame:
    """Canonical concepts one extension below ``parents`` (as _NODE), from the counts of their extensions."""
    tried = counts.groupBy("intent", "k").agg(F.sort_array(F.collect_list(F.struct("i", "n"))).alias("found"), F.max(F.when(F.col("i") == F.col("k"), F.col("n"))).alias("own"))
    shared = F.transform(F.filter("found", lambda x: x["n"] == F.col("own")), lambda x: x["i"])
    tried = tried.withColumn("shared", shared).withColumn("low", F.filter("shared", lambda i: i < F.col("k")))
    failed = tried.filter(F.size("low") > 0).groupBy("intent").agg(F.collect_list(F.struct("k", "low")).alias("failed"))
    known = parents.select("intent", "fails").join(failed, "intent", "left")
    known = known.select("intent", F.concat("fails", F.coalesce("failed", F.array().cast("array<struct<k:int, low:array<int>>>"))).alias("fails"))
    made = tried.filter(F.size("low") == 0).join(known, "intent")
    made = made.withColumn("closed", F.array_sort(F.concat("intent", "shared")))
    made = made.withColumn("locals", F.array_except(F.transform("found", lambda x: x["i"]), F.col("shared")))
    made = made.withColumn("blocked", F.transform(F.filter("fails", lambda f: ~_inside(f["low"], F.col("closed"))), lambda f: f["k"]))
    made = made.withColumn("candidates", F.array_except(F.filter("locals", lambda i: i > F.col("k")), F.col("blocked")))
    return made.select(F.col("closed").alias("intent"), F.col("k").alias("last"), F.col("own").alias("support"), "locals", "candidates", "fails", F.col("intent").alias("parent"))


def _extents(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Rows of the open children, of their parents' ``rows``: items that are frequent there, equal rows merged."""
    each = rows.select(F.col("intent").alias("parent"), "items", "weight", F.explode("extends").alias("last"))
    down = each.join(open_, ["parent", "last"]).select("intent", F.array_intersect("items", "locals").alias("items"), "candidates", "weight")
    down = down.filter(F.size("items") > 0).groupBy("intent", "items").agg(F.sum("weight").alias("weight"), F.first("candidates").alias("candidates"))
    return down.select("intent", F.array_intersect("items", "candidates").alias("extends"), "items", "weight")


def _go_down(node: dict, items: np.ndarray, bounds: np.ndarray, weights: np.ndarray, enough: int) -> list[tuple[list[int], int]]:
    """All concepts below ``node``, depth first; its extent is given by rows of items and weights."""
    out: list[tuple[list[int], int]] = []
    inherited: dict[int, list[np.ndarray]] = {}
    for f in node["fails"]:
        inherited.setdefault(f["k"], []).append(np.array(f["low"]))
    todo = [(np.array(node["intent"], np.int64), node["last"], inherited, items.astype(np.int64), bounds, weights)]
    while todo:
        intent, last, fails, items, bounds, weights = todo.pop()
        names, local = np.unique(items, return_inverse=True)
        row = np.repeat(np.arange(len(weights)), np.diff(bounds))
        order = np.argsort(local, kind="stable")
        edge = np.searchsorted(local[order], np.arange(len(names) + 1))
        below, failed = [], dict(fails)
        for k in np.flatnonzero(names > last).tolist():
            name = int(names[k])
            if any(not np.isin(low, intent).all() for low in fails.get(name, ())):
                continue
            mine = row[order[edge[k] : edge[k + 1]]]
            own = int(weights[mine].sum())
            if own < enough:
                continue
            taken = np.zeros(len(weights), bool)
            taken[mine] = True
            entries = np.flatnonzero(taken[row])
            counts = np.bincount(local[entries], weights[row[entries]], len(names)).astype(np.int64)
            shared = names[counts == own]
            if len(low := shared[shared < name]):
                failed[name] = [*failed.get(name, ()), low]
                continue
            stay = (counts >= enough) & (counts != own)
            closed = np.sort(np.concatenate([intent, shared]))
            out.append((closed.tolist(), own))
            if (names[stay] > name).any():
                below.append((closed, name, mine, stay))
        for closed, name, mine, stay in below:
            taken = np.zeros(len(weights), bool)
            taken[mine] = True
            entries = np.flatnonzero(taken[row] & stay[local])
            sizes = np.bincount(row[entries], minlength=len(weights))
            rows = np.flatnonzero(sizes)
            todo.append((closed, name, failed, items[entries], np.concatenate([[0], np.cumsum(sizes[rows])]), weights[rows]))
    return out


def _depth(rows: DataFrame, nodes: DataFrame, enough: int) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[list[int], int]] = []
        if left.num_rows and right.num_rows:
            node = right.select(["intent", "last", "fails"]).to_pylist()[0]
            items, bounds = _lists(_one(left.column("items")))
            out = _go_down(node, items, bounds, _one(left.column("weight")).to_numpy(), enough)
        return pa.table([pa.array([x for x, _ in out], pa.list_(pa.int32())), pa.array([n for _, n in out], pa.int64())], names=["intent", "support"])

    own = nodes.select("intent", "last", "fails")
    return rows.select("intent", "items", "weight").groupBy("intent").cogroup(own.groupBy("intent")).applyInArrow(run, "intent array<int>, support long")


def concepts(rows: DataFrame, total: int, enough: int, owns: list[int]) -> DataFrame:
    """(intent array<int>, support) of all concepts of ``rows`` (items, weight) with a support of ``enough`` and an item."""
    spark = rows.sparkSession
    top = [k for k, n in enumerate(owns) if n == total]
    root = spark.createDataFrame([(top, -1, total, [], [], [])], _NODE)
    everywhere = F.array(*[F.lit(k) for k in top]).cast("array<int>")
    items = F.array_except("items", everywhere)
    level = rows.select(everywhere.alias("intent"), items.alias("extends"), items.alias("items"), "weight").filter(F.size("items") > 0)
    parents, found, deep, spent = root, [], [], []
    if top:
        found.append(root.select("intent", "support"))
    while True:
        nodes = stash(_children(parents, _counts(level, enough, max(1, len(owns)))), "concepts")
        found.append(nodes.select("intent", "support"))
        open_ = nodes.filter(F.size("candidates") > 0)
        if open_.isEmpty():
            break
        extents = stash(_extents(level, open_), "extents")
        spent.append(extents)
        sizes = stash(extents.groupBy("intent").agg(F.sum(F.size("items").cast("long")).alias("entries"), F.max(F.size("extends")).alias("more")), "sizes")
        live = sizes.filter("more > 0")
        small, large = live.filter(F.col("entries") <= HEAVY).select("intent"), live.filter(F.col("entries") > HEAVY).select("intent")
        deep.append(_depth(extents.join(small, "intent", "left_semi"), nodes.join(small, "intent", "left_semi"), enough))
        if large.isEmpty():
            break
        level, parents = extents.join(large, "intent", "left_semi"), nodes.join(large, "intent", "left_semi")
    out = found[0]
    for more in [*found[1:], *deep]:
        out = out.unionByName(more)
    out = stash(out, "closed")
    for x in spent:
        unstash(x)
    return out


def rules(closed: DataFrame, numbers: DataFrame, total: int, confidence: int = 30) -> DataFrame:
    """items, n_items, support, n_rules, best_item, rules_sha256 of the closed sets ``closed`` (intent, support).

    A closed set without one item c is closed itself or has the closed set's own support: its closure is
    closed, within the set, and lacks c only if it is the rest. So one left join gives the support of every rest.
    """
    one = closed.select("intent", "support", F.explode("intent").alias("number")).join(F.broadcast(numbers), "number")
    one = one.withColumn("rest", F.array_remove("intent", F.col("number")))
    rest = closed.select(F.col("intent").alias("rest"), F.col("support").alias("whole"))
    one = one.join(rest, "rest", "left").withColumn("a", F.coalesce("whole", "support"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    holds = (F.size("intent") > 1) & (100 * wide("support") >= confidence * wide("a")) & (wide("support") * F.lit(total).cast("decimal(19,0)") > wide("a") * wide("own"))
    back = one.groupBy("intent", "support").agg(F.array_sort(F.collect_list("item")).alias("all"), F.array_sort(F.collect_list(F.when(holds, F.struct("item", "a", "own")))).alias("kept"), F.min(F.when(holds, F.struct("a", "item"))).alias("best"))
    text = F.array_join(F.transform("kept", lambda r: F.concat_ws(":", r["item"], r["a"], r["own"])), ";")
    return back.select(
        F.array_join(F.transform("all", lambda x: x.cast("string")), ",").alias("items"),
        F.size("all").cast("long").alias("n_items"),
        "support",
        F.size("kept").cast("long").alias("n_rules"),
        F.col("best")["item"].alias("best_item"),
        F.sha2(text.cast("binary"), 256).alias("rules_sha256"),
    )


def closed_itemsets(lines: DataFrame, basket: str = "sale_id", item: str = "item_id", least: int = 12, per: int = 10_000) -> DataFrame:
    """Every non-empty closed itemset of at least ``least`` baskets and a ``per``-th of all, with its rules."""
    rows, numbers, owns, total, enough = baskets(lines, basket, item, least, per)
    closed = concepts(rows, total, enough, owns)
    return rules(closed, numbers, total)


ORACLE = """
WITH RECURSIVE d AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT sale_id) AS b FROM d),
f AS (SELECT item_id, count(*) AS s, list(sale_id) AS t FROM d GROUP BY 1 HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT b FROM n)),
e AS (SELECT d.* FROM d SEMI JOIN f USING (item_id)),
p AS (SELECT x.item_id AS i, y.item_id AS j FROM e x JOIN e y ON x.sale_id = y.sale_id AND x.item_id < y.item_id GROUP BY 1, 2 HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT b FROM n)),
r AS (SELECT [item_id] AS items, item_id AS last, t, s FROM f
  UNION ALL
  SELECT items, last, t, len(t) AS s FROM (SELECT list_append(r.items, f.item_id) AS items, f.item_id AS last, list_intersect(r.t, f.t) AS t FROM r JOIN p ON p.i = r.last JOIN f ON f.item_id = p.j)
  WHERE len(t) >= 12 AND len(t) * 10000 >= (SELECT b FROM n)),
c AS (SELECT items, s FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.s = r.s AND len(q.items) = len(r.items) + 1 AND list_has_all(q.items, r.items))),
u AS (SELECT items, s, unnest(items) AS c FROM c),
v AS (SELECT u.items, u.s, u.c, w.s AS a, f.s AS o FROM u JOIN f ON f.item_id = u.c LEFT JOIN r w ON w.items = list_filter(u.items, lambda x: x <> u.c)),
k AS (SELECT * FROM v WHERE a IS NOT NULL AND 100 * s >= 30 * a AND s * (SELECT b FROM n) > a * o),
g AS (SELECT items, count(*) AS n_rules, first(c ORDER BY a, c) AS best_item, string_agg(c || ':' || a || ':' || o, ';' ORDER BY c) AS rules FROM k GROUP BY 1)
SELECT array_to_string(c.items, ',') AS items, len(c.items) AS n_items, c.s AS support, coalesce(g.n_rules, 0) AS n_rules, g.best_item, sha256(coalesce(g.rules, '')) AS rules_sha256
FROM c LEFT JOIN g ON g.items = c.items
"""
