"""Averages by blocks against the plain recursion, wherever the blocks are cut."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import kernels
from marlstone.operators import scans


@pytest.mark.parametrize("n", [1, 2, 5, 14])
def test_any_cut_gives_the_plain_average(n):
    rng = np.random.default_rng(n)
    for case in range(60):
        x = rng.normal(10, 3, rng.integers(0, 60))
        x[: rng.integers(0, 4)] = np.nan  # as a series of differences begins
        cuts = np.sort(rng.integers(0, len(x) + 1, rng.integers(0, 9)))
        parts = np.split(x, cuts)
        counts = [int((~np.isnan(p)).sum()) for p in parts]
        before = np.concatenate([[0], np.cumsum(counts)])
        keep = (n - 1) / n
        maps = [scans.block_map(p, int(b), n, keep) for p, b in zip(parts, before, strict=False)]
        begins = scans.compose(*map(list, zip(*maps, strict=True)), n)
        got = np.concatenate([scans.fill(p, *b, n, keep) for p, b in zip(parts, begins, strict=True)]) if len(parts) else x
        assert np.allclose(got, kernels.wilder(x, n), equal_nan=True), (case, cuts)


def test_blocks_of_a_table(spark):
    rng = np.random.default_rng(7)
    rows = [(t, dt.date(2020, 1, 1) + dt.timedelta(days=3 * k), float(h), float(h - rng.random()), float(h - 0.3), 7) for t, n in (("A", 90), ("B", 13), ("C", 14), ("D", 1)) for k, h in enumerate(rng.normal(50, 4, n))]
    df = spark.createDataFrame(rows, "ticker string, date date, high double, low double, close double, _n int").drop("_n")
    month = F.date_trunc("month", "date")
    out = scans.smoothed(scans.blocked_range(df, month), F.col("true_range"), "atr", 14, month).toPandas()
    for t, g in out.sort_values("date").groupby("ticker"):
        high, low, close = (g[c].to_numpy() for c in ("high", "low", "close"))
        before = np.concatenate([[np.nan], close[:-1]])
        ranges = np.fmax(high - low, np.fmax(abs(high - before), abs(low - before)))
        assert np.allclose(g["true_range"], ranges), t
        assert np.allclose(g["atr"], kernels.wilder(ranges, 14), equal_nan=True), t
    assert len(out) == len(rows)
    odd = df.withColumn("x", F.when(F.dayofmonth("date") % 5 > 0, F.col("high")))
    gaps = scans.smoothed(odd, F.col("x"), "avg", 3, month, keep=0.5).filter("ticker = 'A'").orderBy("date").toPandas()
    x = gaps["x"].dropna().to_numpy()
    want = [x[:3].mean()]
    for v in x[3:]:
        want.append(0.5 * want[-1] + 0.5 * v)
    assert np.allclose(gaps.loc[gaps["x"].notna(), "avg"].to_numpy()[2:], want) and gaps.loc[gaps["x"].isna(), "avg"].isna().all()
    assert scans.smoothed(df.limit(0), F.col("high"), "avg", 3, month).count() == 0


def test_groups_pass_whole_whatever_the_batches():
    import pyarrow as pa

    from marlstone.functions.groups import whole_groups

    rng = np.random.default_rng(5)
    for _ in range(40):
        sizes = rng.integers(1, 9, rng.integers(1, 8))
        keys = [k if k != 2 else None for k, size in enumerate(sizes) for _ in range(size)]
        t = pa.table({"k": pa.array(keys, pa.int64()), "v": list(range(len(keys)))})
        cuts = [0, *np.sort(rng.integers(0, len(keys) + 1, rng.integers(0, 9))).tolist(), len(keys)]
        batches = [b for a, z in zip(cuts, cuts[1:], strict=False) for b in t.slice(a, z - a).to_batches()]
        got = [part.slice(a, z - a).column("v").to_pylist() for part, groups in whole_groups(iter(batches), ["k"]) for a, z in groups]
        ends = np.cumsum([0, *sizes]).tolist()
        assert got == [list(range(a, z)) for a, z in zip(ends, ends[1:], strict=False)]
