"""Evidence graphs as tables: referential checks, reachability, claim queries, conflict projection."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import text as T

# Roles by falling precedence.
ROLES = ["primary_law", "official_interpretation", "local_enforcement_guidance", "technical_guidance", "operator_procedure", "case_evidence"]


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge ends (edge_id, kind, id) that no node (kind, id) has."""
    ends = edges.select("edge_id", F.explode(F.array(F.struct(F.col("source_kind").alias("kind"), F.col("source_id").alias("id")), F.struct(F.col("target_kind").alias("kind"), F.col("target_id").alias("id")))).alias("end")).select("edge_id", "end.kind", "end.id")
    return ends.join(nodes.select("kind", "id"), ["kind", "id"], "left_anti")


def incident_equal(edges: DataFrame, declared: DataFrame, node: str, edge: str, listed: str) -> DataFrame:
    """Whether each node's declared edge ids are just its incident ones."""
    actual = edges.groupBy(node).agg(F.array_sort(F.collect_set(edge)).alias("actual"))
    both = declared.join(actual, node, "left")
    return both.select(node, F.array_sort(F.array_distinct(listed)).eqNullSafe(F.coalesce("actual", F.array().cast("array<string>"))).alias("equal"))


def reachable(edges: DataFrame, roots: DataFrame, levels: int = 1000) -> DataFrame:
    """Nodes (column node) reachable from ``roots`` along undirected edges (a, b), with their level.

    A frontier join: each level meets the edges once and drops what was seen. Written levels cut the lineage, so a
    lost executor repeats one level and not the whole walk.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = frontier = roots.select("node").distinct().withColumn("level", F.lit(0))
    for level in range(1, levels + 1):
        step = both.join(frontier.select(F.col("node").alias("a")), "a").select(F.col("b").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti").withColumn("level", F.lit(level))
        frontier = checkpointed(frontier)
        if not frontier.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(frontier))
    raise ValueError("the walk did not end within its levels")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs in one process."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: lineage ends in files that outlive any executor, and the work is done once."""
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` and the fields of the text ``more``."""
    return StructType([*df.schema.fields, *StructType.fromDDL(more).fields])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by ``keys`` to as many tasks as a shuffle has, however few bytes there are: for what grows much, or costs much, only afterwards."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A table to be broadcast if it is counted to have at most ``most`` rows; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def claim_query(claims: DataFrame, prompts: DataFrame, limit: int, key: str = "claim_id") -> DataFrame:
    """Claims by the number of distinct terms shared with each prompt, then id: the first ``limit``, with their rank.

    A claim's pairs with all prompts are counted where the claim lies, and each task gives its first ``limit`` of a prompt.
    """
    held = spread(claims.select(key, "text"), key).select(key, F.explode(T.t2_terms(F.col("text"))).alias("term"))
    asked = prompts.select("item_id", F.explode(T.t2_terms(F.col("text"))).alias("term"))
    score = held.join(asked, "term").groupBy("item_id", key).agg(F.count("*").alias("score"))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), key)
    return score.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def conflict_projection(edges: DataFrame, matched: DataFrame) -> DataFrame:
    """Conflict edges that touch a matched id at either end: two semi-joins, so that no OR makes a nested loop."""
    ids = matched.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    right = edges.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return left.unionByName(right).distinct()


def precedence(roles: DataFrame, group: str, role: str, order: list[str]) -> DataFrame:
    """The distinct roles of each group in the fixed order, and the first of them."""
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(order) for x in (r, k)])[F.col(role)]
    return roles.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("k"), F.col(role).alias("r")))), lambda x: x["r"]), ",").alias("roles"), F.min_by(role, rank).alias("leading"))


def inspection(parts: dict[str, DataFrame], conflicts: DataFrame, stale: DataFrame) -> DataFrame:
    """One row of counts, and pass or investigate."""
    counts = [d.agg(F.count("*").alias(f"{n}_count")) for n, d in parts.items()] + [conflicts.agg(F.count("*").alias("conflict_count")), stale.agg(F.count("*").alias("stale_count"))]
    row = reduce(lambda a, b: a.join(b), counts)  # one row each
    return row.withColumn("result", F.when((F.col("conflict_count") > 0) | (F.col("stale_count") > 0), "investigate").otherwise("pass"))


def mandatory_first(rows: DataFrame, group: str, mandatory: Column, order: list, limit: int) -> DataFrame:
    """Mandatory rows, then others up to the limit; more mandatory rows than that saturate the group."""
    w = Window.partitionBy(group).orderBy((~mandatory).cast("int"), *order)
    total = F.sum(mandatory.cast("int")).over(Window.partitionBy(group))
    return rows.withColumn("position", F.row_number().over(w)).withColumn("saturated", total > limit).filter(F.col("position") <= limit)


def keyset_page(rows: DataFrame, order: list[str], after: tuple, limit: int, wanted: Column) -> DataFrame:
    """One page of wanted rows after an exclusive cursor in ``order``; its last row is the next cursor."""
    beyond = F.struct(*order) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType) for v, c in zip(after, order, strict=True)])
    page = rows.filter(beyond & wanted).orderBy(*order).limit(limit)
    return page
