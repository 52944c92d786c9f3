"""Operator 13: a Merkle manifest of a dataset, as a trie over exact ranks.

A row's leaf is the digest of its fields. Within a group (a language) leaves are ordered by doc_id; every ``FANOUT``
consecutive nodes become one node, until one is left, the group's subroot; subroots, ordered by group, become the root.
A row's proof are its siblings on the way up.

Ranks come without a global sort. Histograms of the leading digits of doc_id, group by group, give each bucket of rows
its offset: counts of the digits before it under the same parent, summed over the levels of the hierarchy, so that no
window holds more than ``RADIX`` siblings. Buckets of over ``LIMIT`` rows are cut by further digits (of doc_id, then of
the leaf, then of a row's place in its file, so that repeated ids and repeated rows end too); a row's place within its
bucket completes the rank. The rank's digits to base ``FANOUT`` name the trie's nodes: rows of one prefix meet in one
row of ``FANOUT ** STEP`` children, ``STEP`` levels at a time, the longest prefixes first. Paths go back down the same
tables, so that proofs are put together where the children are and never shuffled.

Null fields count as ``-``; a null doc_id comes first in its group, a null group before all; repeated ids are ordered by
leaf, and equal rows are leaves of their own. A lone row is its group's subroot, a lone group's subroot the root; an
empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import stash, unstash

FANOUT, STEP = 8, 3
#: Bits of a digit of the histograms, their siblings, and rows of a bucket that one window orders.
BITS = 10
RADIX = 1 << BITS
LIMIT = 4096
#: Levels of leaf bytes and of place bytes that follow the digits of doc_id.
TIES = 7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields: ``-`` for null, else length in bytes, colon, value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return digest(F.concat(*said))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, g (lang, orderable: null first, bytewise), leaf, altered (the leaf of the tampered row)."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    row = lambda text: leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    group = F.coalesce(F.concat(F.lit("1"), F.col("lang")), F.lit("0"))
    found = docs.select("doc_id", group.alias("g"), row(F.col("text")).alias("leaf"), F.when(tampered, row(F.translate("text", _UPPER, _LOWER))).alias("other"))
    return found.select("doc_id", "g", "leaf", F.coalesce("other", "leaf").alias("altered"))


def _digits(rows: DataFrame) -> list[Column]:
    """Digits by which rows are ordered: of doc_id from the first bit that differs, of the leaf, of the row's place."""
    b = F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))  # unsigned, in order
    ends = rows.agg(F.min("doc_id").cast("long").alias("lo"), F.max("doc_id").cast("long").alias("hi")).first()
    bits = ((ends["lo"] ^ ends["hi"]) & ((1 << 64) - 1)).bit_length() if ends["lo"] is not None else 0
    out = []
    for top in range(bits, 0, -BITS):
        low = max(0, top - BITS)
        out.append(F.coalesce(F.shiftrightunsigned(b, low).bitwiseAND(F.lit((1 << (top - low)) - 1).cast("long")).cast("int"), F.lit(-1)))
    out += [F.conv(F.substring("leaf", 2 * k + 1, 2), 16, 10).cast("int") for k in range(TIES)]
    return out + [F.shiftrightunsigned("place", 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int") for k in range(TIES)]


def ranked(rows: DataFrame, digits: list[Column], order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """The columns of a *written* table of rows with g, and rank: its exact place (from 0) in its g by ``order``, which ``digits`` follow; and written tables to delete later."""
    total, depth = rows.count(), 1
    while depth < len(digits) and RADIX**depth * LIMIT < 2 * total:
        depth += 1
    waiting, above, ready = rows.withColumn("before", F.lit(0).cast("long")), 0, []
    spent = []
    while True:
        path = F.array(*digits[:depth])
        counts = stash(waiting.groupBy("g", path.alias("path")).agg(F.count("*").alias("n"), F.first("before").alias("at")), "histogram")
        spent.append(counts)
        for level in range(depth, above, -1):  # offsets under the same parent, level by level
            own = counts.groupBy("g", F.slice("path", 1, level).alias("p")).agg(F.sum("n").alias("m"))
            siblings = Window.partitionBy("g", F.slice("p", 1, level - 1)).orderBy(F.col("p")[level - 1])
            own = own.select("g", "p", (F.sum("m").over(siblings) - F.col("m")).alias("more"))
            counts = counts.withColumn("p", F.slice("path", 1, level)).join(own, ["g", "p"]).withColumn("at", F.col("at") + F.col("more")).drop("p", "more")
        last = depth == len(digits)
        placed = waiting.drop("before").withColumn("path", path).join(counts, ["g", "path"])
        within = Window.partitionBy("g", "path").orderBy(*order)
        ready.append((placed if last else placed.filter(F.col("n") <= LIMIT)).withColumn("rank", F.col("at") + F.row_number().over(within) - 1).drop("path", "n", "at"))
        if last or counts.filter(F.col("n") > LIMIT).isEmpty():
            break
        waiting = stash(placed.filter(F.col("n") > LIMIT).withColumn("before", F.col("at")).drop("path", "n", "at"), "waiting")
        spent.append(waiting)
        above, depth = depth, depth + 1
    return reduce(DataFrame.unionByName, ready), spent


def _up(nodes: Column) -> Column:
    """One level up: digests of runs of FANOUT nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(nodes, k * FANOUT + 1, FANOUT), "")))


def _depth(many: Column) -> Column:
    """Levels over so many nodes."""
    return F.when(many <= 1, 0).otherwise(F.ceil(F.length(F.bin(many - 1)) / (FANOUT.bit_length() - 1))).cast("int")


def _meet(nodes: DataFrame, level: int) -> DataFrame:
    """Nodes (g, rank, hash, depth and more) by prefix: g, depth, node, kids in order, l0 to l{STEP} (their hashes, level by level while there are levels)."""
    more = [c for c in nodes.columns if c not in ("g", "depth", "rank")]
    met = nodes.groupBy("g", "depth", F.shiftright("rank", STEP * (FANOUT.bit_length() - 1)).alias("node")).agg(F.sort_array(F.collect_list(F.struct("rank", *more))).alias("kids"))
    met = met.withColumn("l0", F.transform("kids", lambda k: k["hash"]))
    for k in range(STEP):
        met = met.withColumn(f"l{k + 1}", F.when(F.col("depth") > level + k, _up(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return met


def _steps(level: int, i: Column) -> Column:
    """Siblings of kid ``i`` within its row, level by level: array<struct<left, right>>."""
    steps = []
    for k in range(STEP):
        nodes, at = F.col(f"l{k}"), F.shiftright(i, k * (FANOUT.bit_length() - 1))
        own = at % FANOUT
        left, right = F.slice(nodes, at - own + 1, own), F.slice(nodes, at + 2, FANOUT - 1 - own)
        steps.append(F.when(F.col("depth") > level + k, F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _climb(nodes: DataFrame, deepest: int) -> list[DataFrame]:
    """Written tables of met nodes, from the leaves up; the last has one row for each g."""
    tables, level = [], 0
    while True:
        tables.append(stash(_meet(nodes, level), "trie"))
        level += STEP
        if level >= deepest:
            return tables
        nodes = tables[-1].select("g", "depth", F.col("node").alias("rank"), F.col(f"l{STEP}")[0].alias("hash"))


def _paths(name: str, level: int) -> Column:
    """array<struct<name, hash, path>> of the kids of a row with its own path."""
    return F.transform("kids", lambda kid, i: F.struct(kid[name].alias(name), kid["hash"].alias("hash"), F.concat(_steps(level, i), F.col("path")).alias("path")))


def _descend(tables: list[DataFrame], path: DataFrame) -> DataFrame:
    """(g, node, path) for the rows of the first table: siblings from their top node to the root; ``path`` (g, path) starts at each g's top."""
    down = tables[-1].select("g", "node").join(path, "g")
    for k in range(len(tables) - 1, 0, -1):
        own = tables[k].join(down, ["g", "node"])
        down = stash(own.select("g", F.explode(_paths("rank", k * STEP)).alias("kid")).select("g", F.col("kid.rank").alias("node"), "kid.path"), "paths")
    return down


def _levels(many: int) -> int:
    """As ``_depth``, of a number."""
    levels = 0
    while many > 1:
        many, levels = -(-many // FANOUT), levels + 1
    return levels


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    made = stash(leaves(docs), "leaves")
    rows = made.select("*", F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("place"))
    order, spent = ranked(rows, _digits(made), ["doc_id", "leaf", "place"])
    sizes = stash(made.groupBy("g").agg(_depth(F.count("*")).alias("depth")), "sizes")
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    tables = _climb(order.drop("place").join(sizes, "g").withColumnRenamed("leaf", "hash"), deepest)
    for x in (made, sizes, *spent):
        unstash(x)
    top = F.col(f"l{STEP}")[0]
    subroots = stash(tables[-1].select("g", top.alias("hash")), "subroots")
    many = subroots.count()
    letters = [F.coalesce(F.conv(F.hex(F.substring(F.col("key").cast("binary"), k + 1, 1)), 16, 10).cast("int"), F.lit(-1)) for k in range(2 * TIES)]
    order, spent = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("key"), "hash"), letters, ["key"])
    tops = _climb(order.withColumn("depth", F.lit(_levels(many))), _levels(many))
    root = next((r[0] for r in tops[-1].select(top).collect()), None)  # one row, or none
    for x in spent:
        unstash(x)
    above = _descend(tops, tops[-1].select("g", F.array().cast("array<struct<left:string,right:string>>").alias("path")))
    groups = tops[0].join(above, ["g", "node"]).select(F.explode(_paths("key", 0)).alias("kid"))
    groups = stash(groups.select(F.col("kid.key").alias("g"), F.col("kid.hash").alias("subroot"), "kid.path"), "groups")
    down = _descend(tables, groups.select("g", "path")).join(groups.select("g", "subroot"), "g")

    def proven(kid: Column, i: Column) -> Column:
        path = F.concat(_steps(0, i), F.col("path"))
        return F.transform(
            F.array(path),
            lambda p: F.struct(
                kid["doc_id"].alias("doc_id"),
                kid["hash"].alias("leaf"),
                digest(F.array_join(F.transform(p, lambda s: F.concat(s["left"], s["right"])), "")).alias("proof_sha256"),
                F.aggregate(p, kid["altered"], lambda now, s: digest(F.concat(s["left"], now, s["right"]))).alias("folded_root"),
            ),
        )[0]

    out = tables[0].join(down, ["g", "node"]).select("subroot", F.explode(F.transform("kids", proven)).alias("row"))
    return out.select("row.doc_id", "row.leaf", "subroot", F.lit(root).alias("root"), "row.proof_sha256", "row.folded_root", (F.col("row.folded_root") == root).alias("verified"))


def _oracle(levels: int = 8, group_levels: int = 3) -> str:
    """The tree level by level: enough levels for 8^levels rows of a language and 8^group_levels languages."""
    said = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    row = lambda text: "sha256(" + " || ".join(said(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END)"
    parts = [f"""WITH e AS MATERIALIZED (SELECT doc_id, lang, {row("text")} AS leaf, CASE WHEN xor({bits}, 4294967295) % 3 = 0 THEN {row("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
d0 AS MATERIALIZED (SELECT doc_id, coalesce('1' || lang, '0') AS g, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, coalesce(other, leaf) AS now, '' AS proof FROM e),
l0 AS (SELECT g, r, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM d0)"""]

    def climb(a: str, b: str, d: str, e: str) -> None:
        run = f"OVER (PARTITION BY g, r // {FANOUT} ORDER BY r ROWS BETWEEN"
        parts.append(f"s{a} AS (SELECT g, r, n, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS a, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS b FROM l{a})")
        parts.append(f"{e} AS MATERIALIZED (SELECT d.* REPLACE (d.r // {FANOUT} AS r, CASE WHEN n > 1 THEN sha256(a || now || b) ELSE now END AS now, proof || a || b AS proof) FROM {d} d JOIN s{a} s ON s.g = d.g AND s.r = d.r)")
        parts.append(f"l{b} AS (SELECT g, r, h, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, r // {FANOUT} AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM l{a} GROUP BY g, r // {FANOUT}))")

    for k in range(levels):
        climb(str(k), str(k + 1), f"d{k}", f"d{k + 1}")
    parts.append(f"q AS MATERIALIZED (SELECT g AS own, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM l{levels})")
    parts.append("lx0 AS (SELECT '' AS g, place AS r, subroot AS h, count(*) OVER () AS n FROM q)")
    parts.append(f"x0 AS (SELECT d.* REPLACE ('' AS g, place AS r), subroot FROM d{levels} d JOIN q ON q.own = d.g)")
    for k in range(group_levels):
        climb(f"x{k}", f"x{k + 1}", f"x{k}", f"x{k + 1}")
    return ", ".join(parts) + f" SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = h AS verified FROM x{group_levels} CROSS JOIN (SELECT h FROM lx{group_levels})"


ORACLE = _oracle()
