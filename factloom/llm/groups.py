"""Streams of whole groups out of key-sorted Arrow batches: one group at a time is in memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds): groups of equal integer ``keys``, complete; group i is rows bounds[i]:bounds[i + 1]."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and not all(batch.column(batch.schema.get_field_index(k))[0] == held[-1].column(held[-1].schema.get_field_index(k))[-1] for k in keys):
            yield from _cut(pa.Table.from_batches(held), keys, True)
            held = []
        change = _changes(batch, keys)
        if len(change) and held:
            held.append(batch.slice(0, int(change[0])))
            yield from _cut(pa.Table.from_batches(held), keys, True)
            batch, held = batch.slice(int(change[0])), []
            change = _changes(batch, keys)
        if len(change):
            last = int(change[-1])
            yield from _cut(pa.Table.from_batches([batch.slice(0, last)]), keys, False)
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield from _cut(pa.Table.from_batches(held), keys, True)


def _changes(batch, keys: list[str]) -> np.ndarray:
    moved = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        x = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
        moved |= x[1:] != x[:-1]
    return np.flatnonzero(moved) + 1


def _cut(table: pa.Table, keys: list[str], single: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
    table = table.combine_chunks()
    if single:
        yield table, np.array([0, table.num_rows])
    else:
        yield table, np.concatenate([[0], _changes(table.to_batches()[0], keys), [table.num_rows]])


def forest(left: np.ndarray, right: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join just what the links among nodes 0..many-1 join: fewer than ``many``."""
    label = np.arange(many)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = np.minimum(label, label[label])
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(many))
    return node, label[node]
