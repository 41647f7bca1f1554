"""Sorted groups of rows as they pass a task, many in each Arrow batch, without a call of pandas for every group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def in_groups(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a group in one partition, side by side and in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, order)


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the rows, but the first, that don't have the keys of the row before."""
    changed = np.zeros(max(t.num_rows - 1, 0), bool)
    for key in keys if t.num_rows > 1 else ():
        a, b = t.column(key).slice(1), t.column(key).slice(0, t.num_rows - 1)
        changed |= pc.fill_null(pc.not_equal(a, b), False).to_numpy() | (pc.is_null(a).to_numpy() != pc.is_null(b).to_numpy())
    return np.flatnonzero(changed) + 1


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """(rows, (first, end) of each group in them) of a partition of ``in_groups``: no group is cut by the ends of batches. A
    task holds a batch and a group."""
    held: list[pa.Table] = []

    def done(parts: list[pa.Table]) -> tuple[pa.Table, list[tuple[int, int]]]:
        t = pa.concat_tables(parts).combine_chunks()
        ends = [0, *_begins(t, keys).tolist(), t.num_rows]
        return t, list(zip(ends, ends[1:], strict=False))

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        edge = len(held) and len(_begins(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), t.slice(0, 1)]), keys))
        inner = _begins(t, keys)
        cut = int(inner[-1]) if len(inner) else 0
        if not cut and not edge:
            held.append(t)
            continue
        parts = [*held, t.slice(0, cut)] if cut else held
        yield done(parts)
        held = [t.slice(cut)]
    if held:
        yield done(held)
