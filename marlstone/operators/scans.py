"""Recursive averages over long series, in blocks of time instead of one task for each ticker.

A smoothing average is affine in its value before: over a block of rows it multiplies that by a power and adds a sum. The
maps of all blocks are made at once, composed along each ticker over the small table of blocks, and then every block is
filled from the value it begins with. A ticker's minutes of ten years are many tasks, not one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.groups import in_groups, whole_groups
from ..functions.ship import ship
from ..functions.store import written

MADE = "block_count long, seed_sum double, power double, added double"


def _steps(x: np.ndarray, before: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid values of a block whose ticker has had ``before`` of them: those of the seed, and those after it."""
    valid = x[~np.isnan(x)]
    cut = min(max(n - before, 0), len(valid))
    return valid[:cut], valid[cut:]


def block_map(x: np.ndarray, before: int, n: int, keep: float) -> tuple[int, float, float, float]:
    """(valid values, sum of those of the seed, power, added): value -> power * value + added over the rest of a block."""
    seed, rest = _steps(x, before, n)
    added = 0.0
    for v in rest.tolist():
        added = keep * added + (1 - keep) * v
    return len(seed) + len(rest), float(seed.sum()), keep ** len(rest), added


def fill(x: np.ndarray, before: int, seed_sum: float, value: float | None, n: int, keep: float) -> np.ndarray:
    """The averages of a block: ``before`` valid values and their seed's sum came earlier, ``value`` is the last average."""
    out, total, count = np.full(len(x), np.nan), seed_sum, before
    for k, v in enumerate(x.tolist()):
        if v != v:
            continue
        count += 1
        if count <= n:
            total += v
            value = total / n if count == n else None
        else:
            value = keep * value + (1 - keep) * v
        if count >= n:
            out[k] = value
    return out


def compose(counts: list[int], sums: list[float], powers: list[float], added: list[float], n: int) -> list[tuple[int, float, float | None]]:
    """What each block of a ticker begins with: valid values so far, the seed's sum, and the average (None before its time)."""
    out, before, total, value = [], 0, 0.0, None
    for count, seed, power, add in zip(counts, sums, powers, added, strict=True):
        out.append((before, total, value))
        total += seed
        if before < n <= before + count:
            value = total / n
        before += count
        if value is not None:
            value = power * value + add
    return out


def smoothed(rows: DataFrame, value: Column, name: str, n: int, block: Column, keep: float | None = None, order: str = "date") -> DataFrame:
    """``rows`` with ``name``: Wilder's average of ``value`` over ``n`` of each ticker's rows in ``order``; or with ``keep`` the
    share of the value before that stays (an exponential average of a span has 1 - 2 / (span + 1), and starts from the mean).

    ``block`` cuts a ticker's rows into blocks that don't overlap in ``order``, such as the month of the date; its values
    sort as the rows do. The average starts with the mean of the first ``n`` values, wherever blocks end; missing values
    are passed over and get none. The result doesn't depend on the blocks, but for the last bits.
    """
    spark, keep = rows.sparkSession, (n - 1) / n if keep is None else keep
    ship(spark)
    held = written(rows.withColumns({"_x": value.cast("double"), "_block": block}), "series")
    narrow = held.select("ticker", "_block", F.col(order).alias("_at"), F.when(~F.isnan("_x"), F.col("_x")).alias("_x"))
    counts = narrow.groupBy("ticker", "_block").agg(F.count("_x").alias("_n"))
    so_far = F.coalesce(F.sum("_n").over(W.partitionBy("ticker").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    befores = written(counts.select("ticker", "_block", so_far.alias("_before")), "counts")  # one row for each block
    kind, own = dict(held.dtypes)["_block"], rows.columns

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, ["ticker", "_block"]):
            x, before = t.column("_x").to_numpy().astype(float), t.column("_before").to_numpy()
            got = [block_map(x[a:b], int(before[a]), n, keep) for a, b in groups]
            first = t.select(["ticker", "_block"]).take([a for a, _ in groups]).combine_chunks().columns
            made = [pa.array(v, k) for v, k in zip(zip(*got, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
            yield from pa.Table.from_arrays([*first, *made], names=["ticker", "_block", *[c.split()[0] for c in MADE.split(", ")]]).to_batches()

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, ["ticker"]):
            columns = [t.column(c.split()[0]).to_pylist() for c in MADE.split(", ")]
            got = [g for a, b in groups for g in compose(*[c[a:b] for c in columns], n)]
            made = [pa.array(v, k) for v, k in zip(zip(*got, strict=True), (pa.int64(), pa.float64(), pa.float64()), strict=True)]
            yield from pa.Table.from_arrays([t.column("ticker"), t.column("_block"), *made], names=["ticker", "_block", "_before", "_sum", "_value"]).to_batches()

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in whole_groups(batches, ["ticker", "_block"]):
            x = t.column("_x").to_numpy().astype(float)
            before, total, value = (t.column(c).take([a for a, _ in groups]).to_pylist() for c in ("_before", "_sum", "_value"))
            made = np.concatenate([fill(x[a:b], *begin, n, keep) for (a, b), *begin in zip(groups, before, total, value, strict=True)])
            yield from t.select(own).append_column(name, pa.array(made, from_pandas=True)).to_batches()

    blocks = in_groups(narrow.join(befores, ["ticker", "_block"]), ["ticker", "_block"], "_at").mapInArrow(maps, f"ticker string, _block {kind}, {MADE}")
    begins = written(in_groups(blocks, ["ticker"], "_block").mapInArrow(starts, f"ticker string, _block {kind}, _before long, _sum double, _value double"), "starts")
    schema = rows.select("*", F.lit(None).cast("double").alias(name)).schema
    return in_groups(held.join(begins, ["ticker", "_block"]), ["ticker", "_block"], order).mapInArrow(filled, schema)


def blocked_range(bars: DataFrame, block: Column, order: str = "date") -> DataFrame:
    """``bars`` with ``true_range``, by blocks: the first bar of a block takes the close of the last one before it."""
    held = bars.withColumn("_block", block)
    ends = held.groupBy("ticker", "_block").agg(F.max_by("close", order).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(W.partitionBy("ticker").orderBy("_block"))).drop("_end")  # one row for each block
    held = held.join(ends, ["ticker", "_block"])
    before = F.coalesce(F.lag("close").over(W.partitionBy("ticker", "_block").orderBy(order)), F.col("_carry"))
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return held.withColumn("true_range", reach).drop("_block", "_carry")
