"""Append-only logs: hash chains, state machines, upserts, pages, readbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(previous: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """A new generation: latest wins by key."""
    return latest(previous.unionByName(changes), [key], [F.desc(version)])


def chain(log: DataFrame, group: str, sequence: str, record: Column) -> DataFrame:
    """The log with each row's digest and that of the row before it."""
    own = log.withColumn("event_digest", F.sha2(record.cast("binary"), 256))
    return own.withColumn("previous_digest", F.lag("event_digest").over(Window.partitionBy(group).orderBy(sequence)))


def chain_faults(log: DataFrame, group: str, sequence: str, previous: str = "previous_digest", own: str = "event_digest") -> DataFrame:
    """Rows whose sequence has a gap or whose link is not the digest before them."""
    w = Window.partitionBy(group).orderBy(sequence)
    seen = log.withColumn("_place", F.row_number().over(w)).withColumn("_first", F.min(sequence).over(Window.partitionBy(group))).withColumn("_link", F.lag(own).over(w))
    return seen.filter((F.col(sequence) != F.col("_first") + F.col("_place") - 1) | ~F.col(previous).eqNullSafe(F.col("_link"))).drop("_place", "_first", "_link")


def transitions(log: DataFrame, group: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Steps (before, after) of each group that ``allowed`` does not have."""
    step = log.withColumn("before", F.coalesce(F.lag(state).over(Window.partitionBy(group).orderBy(*order)), F.lit("start")))
    return step.join(allowed.select("before", F.col("after").alias(state)), ["before", state], "left_anti")


def readback(items: DataFrame, group: str, state: str) -> DataFrame:
    """Counts by terminal state; completed only without rejections."""
    counts = items.groupBy(group).agg(*[F.count_if(F.col(state) == s).alias(s) for s in ("created", "unchanged", "rejected")])
    return counts.withColumn("result", F.when(F.col("rejected") == 0, "completed").otherwise("partial"))


def authorised(requests: DataFrame, grants: DataFrame, consumed: DataFrame, now: Column) -> DataFrame:
    """Requests with a matching grant that is valid now and not used yet."""
    valid = grants.filter((F.col("issued_at") <= now) & (now < F.col("expires_at"))).join(consumed.select("grant_id"), "grant_id", "left_anti")
    return requests.join(valid, ["grant_id", "operation", "digest"])
