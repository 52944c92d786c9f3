"""Append-only logs as streams: age gate, ingestion with a checkpoint, per-key state machines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aged(events: DataFrame, time: str, late: str, group: list[str], window: str = "1 hour") -> DataFrame:
    """Counts by window; rows later than ``late`` are dropped by the watermark, as the age rule drops old observations."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), *group).agg(F.count("*").alias("n"))


def once(events: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each event once, whatever the number of deliveries within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append(events: DataFrame, path: str, checkpoint: str, partition: str | None = None):
    """Exactly-once append of a stream to a table; a restart resumes at its checkpoint."""
    writer = events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(partition) if partition else writer).start()


def audit(events: DataFrame, key: str, state: str, order: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """Steps of each key that are not allowed, over batches: the last state is kept between them."""
    steps = set(allowed)
    kind = events.schema[key].dataType.simpleString()

    def run(group, frames: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        before = kept.get[0] if kept.exists else "start"
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for at, after in zip(rows[order], rows[state], strict=True):
            if (before, after) not in steps:
                out.append((group[0], at, before, after))
            before = after
        kept.update((before,))
        yield pd.DataFrame(out, columns=[key, order, "before", "after"])

    shape = f"{key} {kind}, {order} {events.schema[order].dataType.simpleString()}, before string, after string"
    return events.groupBy(key).applyInPandasWithState(run, shape, "state string", "append", "NoTimeout")
