"""Search of rules: conjunctions of conditions, scored by date on mined and held-out rows.

The conjunctions of a length are one job. Every partition goes through its rows by date: conditions are a matrix of bits,
the conjunctions one condition shorter are rows of ANDs, and one matrix product of the two gives the counts and sums of
all longer ones on that date. A conjunction has at most the rows and dates of its parts, so that what fails the gate
isn't carried on. What moves depends on rules and dates, not on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from ..functions.store import written

MIN_ROWS, MIN_DATES, HOLD_DATES, LEAST_T, TOP = 150, 8, 5, 2.0, 25
#: Rules that are summed up together, and rows that are multiplied at once.
BLOCK, ROWS = 512, 4_096
SPLITS = ("mine", "holdout")
STATS = "rule string, length int, value string, split string, n_rows long, n_dates long, mean double, t double"


def longer(rules: list[tuple[int, ...]], group: list[int]) -> list[tuple[int, ...]]:
    """Conjunctions one condition longer than ``rules`` (sorted tuples of condition numbers) of which all parts are among
    them, with one condition of an attribute (``group``) at most."""
    there = set(rules)
    out = []
    for rule in rules:
        for (last,) in (r for r in there if len(r) == 1) if len(rule) == 1 else (r[-1:] for r in rules if r[:-1] == rule[:-1]):
            if last > rule[-1] and all(group[last] != group[c] for c in rule):
                new = (*rule, last)
                if all(part in there for part in combinations(new, len(rule))):
                    out.append(new)
    return sorted(set(out))


def _sums(rules: list[tuple[int, ...]], n_values: int):
    """Counts and sums of every rule and value on each (split, date) of a partition, in blocks of rules."""
    heads = sorted({r[:-1] for r in rules})
    place = {h: k for k, h in enumerate(heads)}
    row, col = np.array([place[r[:-1]] for r in rules]), np.array([r[-1] for r in rules])

    def one(flags: np.ndarray, values: np.ndarray) -> np.ndarray:
        """[rules, values, 2] of rows of one date: flags [rows, conditions], values [rows, values] with NaN."""
        total = np.zeros((len(rules), n_values, 2))
        for a in range(0, len(flags), ROWS):
            f, v = flags[a : a + ROWS], values[a : a + ROWS]
            masks = np.stack([f[:, list(h)].all(axis=1) for h in heads]).astype(float)
            known = ~np.isnan(v)
            for k in range(n_values):
                for j, w in enumerate((known[:, k].astype(float), np.where(known[:, k], v[:, k], 0.0))):
                    total[:, k, j] += (masks @ (f * w[:, None]))[row, col]
        return total

    def emit(split: str, day: int, total: np.ndarray) -> Iterator[tuple]:
        for b in range(0, len(rules), BLOCK):
            if (part := total[b : b + BLOCK])[..., 0].any():
                yield b // BLOCK, split, day, part.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = None, None
        for batch in batches:
            flags = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names if c.startswith("f_")], axis=1).astype(bool)
            values = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names if c.startswith("v_")], axis=1)
            days, splits = batch.column("day").to_numpy(), np.array(batch.column("split").to_pylist())
            cuts = [0, *np.flatnonzero((days[1:] != days[:-1]) | (splits[1:] != splits[:-1])) + 1, len(days)] if len(days) else []
            out: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = (str(splits[a]), int(days[a]))
                if key != held:
                    out += emit(*held, total) if held else ()
                    held, total = key, np.zeros((len(rules), n_values, 2))
                total += one(flags[a:b], values[a:b])
            yield _batch(out)
        yield _batch(list(emit(*held, total)) if held else [])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["block", "split", "day", "sums"])


def _score(rules: list[tuple[int, ...]], names: list[str], values: list[str]):
    """Rows, dates, mean over the dates of the daily mean, and its t, of a block's rules in one split."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        block, split = key[0].as_py(), key[1].as_py()
        mine = rules[block * BLOCK : (block + 1) * BLOCK]
        by_day: dict[int, np.ndarray] = {}
        for day, blob in zip(part.column("day").to_pylist(), part.column("sums").to_pylist(), strict=True):
            x = np.frombuffer(blob, np.float64).reshape(len(mine), len(values), 2)
            by_day[day] = by_day[day] + x if day in by_day else x
        whole = np.stack([by_day[d] for d in sorted(by_day)])
        n, has = whole[..., 0], whole[..., 0] > 0
        daily = np.where(has, whole[..., 1] / np.where(has, n, 1), np.nan)
        k = has.sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.where(has, daily, 0).sum(axis=0) / k
            spread = np.sqrt(np.where(has, (daily - mean) ** 2, 0).sum(axis=0) / (k - 1))
            t = mean / (spread / np.sqrt(k))
        enough = k >= 3
        keep = np.argwhere(k > 0)
        number = lambda x: [float(v) if ok and np.isfinite(v) else None for v, ok in zip(x[tuple(keep.T)], enough[tuple(keep.T)], strict=True)]
        out = [
            pa.array([" & ".join(names[c] for c in mine[i]) for i, _ in keep], pa.string()), pa.array([len(mine[i]) for i, _ in keep], pa.int32()), pa.array([values[j] for _, j in keep], pa.string()),
            pa.array([split] * len(keep), pa.string()), pa.array(n.sum(axis=0)[tuple(keep.T)].astype(np.int64)), pa.array(k[tuple(keep.T)].astype(np.int64)), pa.array(number(mean), pa.float64()), pa.array(number(t), pa.float64()),
        ]
        return pa.Table.from_arrays(out, names=[f.split()[0] for f in STATS.split(", ")])

    return run


def mine_rules(rows: DataFrame, conditions: dict[str, dict[str, Column]], values: list[str], longest: int = 3, min_rows: int = MIN_ROWS, min_dates: int = MIN_DATES, id_col: str = "id") -> DataFrame:
    """(rule, length, value, mine_*, holdout_*, survivor) of every conjunction of up to ``longest`` conditions that passes the
    gate of rows and dates on the mined rows.

    ``conditions``: attribute -> name -> condition; a rule has one condition of an attribute at most, and null is false.
    ``rows`` has ``date``, ``split`` (mine or holdout) and the ``values``, of which nulls don't count. The mean is that of
    the dates' means, t is clustered by date. A rule survives if its held-out mean has the mined one's sign, with a t of 2
    or more on 150 or more rows; held-out figures need five dates. The search looks at mined rows alone.
    """
    ship(rows.sparkSession)
    names = [n for own in conditions.values() for n in own]
    group = [k for k, own in enumerate(conditions.values()) for _ in own]
    if len(set(names)) < len(names):
        raise ValueError("names of conditions must differ")
    flags = [F.coalesce(c, F.lit(False)).alias(f"f_{k}") for k, c in enumerate(c for own in conditions.values() for c in own.values())]
    numbers = [F.col(v).cast("double").alias(f"v_{k}") for k, v in enumerate(values)]
    table = rows.select(F.unix_date("date").alias("day"), "split", F.xxhash64(id_col).alias("h"), *flags, *numbers)
    # By ranges of date and hash: the rows of a crowded date are split among tasks.
    table = written(table.repartitionByRange("day", "h").sortWithinPartitions("split", "day").drop("h"), "rule-rows")

    found, rules = None, [(k,) for k in range(len(names))]
    for length in range(1, longest + 1):
        if not rules:
            break
        sums = table.mapInArrow(_sums(rules, len(values)), "block int, split string, day int, sums binary")
        stats = written(sums.groupBy("block", "split").applyInArrow(_score(rules, names, values), STATS), "rules")
        found = stats if found is None else found.unionByName(stats)
        if length < longest:
            kept = stats.filter((F.col("split") == "mine") & (F.col("n_rows") >= min_rows) & (F.col("n_dates") >= min_dates)).select("rule").distinct()
            alive = {r["rule"] for r in kept.collect()}  # rules of the grid
            rules = longer([r for r in rules if " & ".join(names[c] for c in r) in alive], group)
    enough = (F.col("split") != "mine") & (F.col("n_rows") >= min_rows) & (F.col("n_dates") >= HOLD_DATES) | (F.col("split") == "mine")
    pick = lambda s, c: F.max(F.when((F.col("split") == s) & (enough if c in ("mean", "t") else F.lit(True)), F.col(c))).alias(f"{s}_{c}")
    wide = found.groupBy("rule", "length", "value").agg(*[pick(s, c) for s in SPLITS for c in ("n_rows", "n_dates", "mean", "t")])
    wide = wide.filter((F.col("mine_n_rows") >= min_rows) & (F.col("mine_n_dates") >= min_dates))
    alive = (F.signum("mine_mean") == F.signum("holdout_mean")) & (F.abs("holdout_t") >= LEAST_T) & (F.col("holdout_n_rows") >= MIN_ROWS)
    return wide.withColumn("survivor", F.coalesce(alive, F.lit(False)))


def candidates(found: DataFrame, family: str = "family", top: int = TOP) -> DataFrame:
    """The ``top`` rules of each family by the size of their mined t: the pool that the held-out rows decide about."""
    order = W.partitionBy(family).orderBy(F.desc(F.abs("mine_t")), "rule", "value")
    return found.filter("mine_t is not null").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
