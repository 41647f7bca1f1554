"""Indicators, features, labels and detectors: recursions, no look into the future, isolation, exact cases."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.functions import kernels
from marlstone.operators import detectors
from marlstone.operators import technicals as T


def walk(n=420, ticker="A", seed=1):
    """Bars of a price that swings around two slow waves, on every day of the calendar."""
    rng, t = np.random.default_rng(seed), np.arange(n)
    level = 40 + 6 * np.sin(t / 23 + seed) + 3 * np.sin(t / 7.5) + np.cumsum(rng.normal(0, 0.25, n))
    close = np.maximum(level + rng.normal(0, 0.5, n), 5.0)
    open_ = np.concatenate([[close[0]], close[:-1]]) + rng.normal(0, 0.3, n)
    reach = rng.gamma(2.0, 0.25, (2, n))
    dates = [dt.date(2021, 3, 1) + dt.timedelta(days=int(k)) for k in t]
    return pd.DataFrame({"ticker": ticker, "date": dates, "open": open_, "high": np.maximum(open_, close) + reach[0], "low": np.minimum(open_, close) - reach[1], "close": close, "volume": np.round(50 + 20 * np.cos(t / 5) + rng.integers(0, 9, n)), "vwap": close, "transactions": 3})


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk())


def features(spark, pdf):
    return T.build_features(spark.createDataFrame(pdf)).toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)


def test_recursions_match_plain_loops():
    x = np.array([np.nan, 2.0, 4.0, 6.0, 1.0, 3.0])
    assert np.allclose(kernels.wilder(x, 3)[3:], [4.0, 3.0, 3.0]) and np.isnan(kernels.wilder(x, 3)[:3]).all()
    assert np.isnan(kernels.wilder(x, 6)).all()
    assert np.allclose(kernels.exponential(np.array([1.0, 2.0, 3.0]), 3)[2], 2.25)
    flat = kernels.relative_strength(np.full(20, 5.0), 14)
    assert np.isnan(flat[:14]).all() and (flat[14:] == 50).all()
    assert kernels.relative_strength(np.arange(20.0), 14)[-1] == 100
    assert np.allclose(kernels.percentile_rank(np.arange(10.0), 4)[3:], 1.0) and np.allclose(kernels.percentile_rank(-np.arange(10.0), 4)[3:], 0.25)


def test_features_never_read_the_future(spark):
    pdf = walk()
    whole = features(spark, pdf)
    cut = features(spark, pdf.iloc[:360])
    columns = [c for c in whole.columns if not c.startswith(("swing_high_m", "swing_low_m")) or c.endswith("_conf")]
    a, b = whole.iloc[:360][columns], cut[columns]
    for c in columns:
        if a[c].dtype.kind in "fi":
            assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True), c
        else:
            assert (a[c] == b[c]).all(), c
    raw = whole["swing_high_m5"].iloc[:360].notna() != cut["swing_high_m5"].notna()
    assert raw.any() or whole["swing_high_m5"].iloc[355:360].isna().all()


def test_tickers_are_isolated(spark):
    a, b = walk(ticker="A"), walk(ticker="B", seed=2)
    alone = features(spark, a)
    both = features(spark, pd.concat([a, b]))
    both = both[both.ticker == "A"].reset_index(drop=True)
    for c in ("rsi_14", "sma_200", "bb_bandwidth_pctile", "bars_since_reclaim", "squeeze_duration", "trend_stack_state"):
        assert np.allclose(alone[c].astype(float), both[c].astype(float), equal_nan=True), c


def still(changed, n=48):
    """Bars that stay at 50 within 0.4 either way, so that the range is 0.8, but for the changed ones."""
    rows = []
    for k in range(n):
        row = {"open": 50.0, "high": 50.4, "low": 49.6, "close": 50.0} | changed.get(k, {})
        rows.append({"ticker": "Q", "date": dt.date(2022, 6, 1) + dt.timedelta(days=k), "volume": 7.0, **row})
    return pd.DataFrame(rows)


def labels(spark, pdf):
    return T.barrier_labels(T.with_recursions(spark.createDataFrame(pdf))).toPandas().sort_values("date").reset_index(drop=True)


def test_a_bar_beyond_both_levels_counts_as_stopped(spark):
    out = labels(spark, still({31: {"high": 52.0, "low": 48.0}}))
    assert out.loc[28, ["label_long_barrier", "label_short_barrier"]].tolist() == ["stop", "stop"]
    assert out.loc[28, ["label_long", "label_short", "label_long_bars_to_outcome"]].tolist() == [0, 0, 3]
    assert out["label_short_barrier"][33] == "timeout" and out["label_short"][33] == 0 and out["label_short_bars_to_outcome"][33] == 10
    assert out["label_short_barrier"][41] is None and np.isnan(out["label_short"][41])


def test_the_first_level_reached_decides(spark):
    out = labels(spark, still({25: {"low": 48.7, "close": 48.9}, 27: {"high": 53.0}}))
    assert (out["label_short_barrier"][22], out["label_short_bars_to_outcome"][22]) == ("profit", 3) and out["label_long_barrier"][22] == "stop"
    assert out["label_short_outcome_return"][22] == pytest.approx(1 - 48.9 / 50)


def test_warmup_is_trimmed(spark, bars):
    whole, trimmed = T.build_dataset(bars, trim=False).toPandas(), T.build_dataset(bars).toPandas()
    assert whole["is_warmup"].sum() == T.Config().warmup == 266 and len(trimmed) == whole["is_valid"].sum() == 420 - 266 - whole.iloc[266:][["label_long", "label_short"]].isna().any(axis=1).sum()


def events(spark, pdf):
    return detectors.all_events(spark.createDataFrame(pdf)).toPandas()


def test_detectors_never_read_the_future(spark):
    pdf = walk(400, seed=4)
    whole, cut = events(spark, pdf), events(spark, pdf.iloc[:340])
    last = pdf["date"].iloc[339]
    key = lambda e: sorted((r.detector, r.side, str(r.date), round(r.strength, 6)) for r in e.itertuples())
    assert key(whole[whole.date <= last]) == key(cut)
    assert len(set(whole.detector)) > 15 and len(whole) < 40 * len(pdf)
    assert (whole.date >= pdf["date"].iloc[13]).all()


def test_a_level_flip_fires_on_its_retest(spark):
    close = [100.0] * 20
    for top in range(3):
        close += [102, 104, 105, 104, 102, 100, 99, 98, 99, 100]
    close += [103, 106, 109, 112, 112, 110, 108, 106.2, 107.5, 109, 111]
    pdf = pd.DataFrame({"ticker": "A", "date": [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(len(close))], "open": close, "high": np.array(close) + 0.5, "low": np.array(close) - 0.5, "close": close, "volume": 1.0})
    df = T.with_recursions(spark.createDataFrame(pdf))
    got = detectors.detect_universe(df, ["srflip_base", "srflip_loose"]).toPandas()
    assert "long" in set(got.side) and (got.strength > 0).all()


def test_weekly_state_uses_the_week_before(spark):
    pdf = walk(200, seed=6)
    whole = detectors.weekly_state(spark.createDataFrame(pdf)).toPandas().sort_values("date")
    weeks = pd.Series(pdf["close"].to_numpy(), index=pd.to_datetime(pdf["date"])).resample("W-FRI").last()
    fast, slow = weeks.rolling(10).mean(), weeks.rolling(20).mean()
    state = pd.Series(np.where(slow.isna(), np.nan, np.where((weeks > fast) & (fast > slow), 1.0, np.where((weeks < fast) & (fast < slow), -1.0, 0.0))), index=weeks.index).shift(1)
    week_of = pd.to_datetime(whole["date"]).dt.to_period("W-FRI").dt.end_time.dt.normalize()
    assert np.allclose(whole["htf"].astype(float), state.reindex(week_of).to_numpy(), equal_nan=True)
    assert detectors.weekly_state(spark.createDataFrame(pdf), 0.0).filter("htf is null").count() == 0


def test_own_detector(spark, bars):
    detectors.register_detector("every_50", lambda b: [(t, "long", 1.0) for t in range(0, len(b["close"]), 50)])
    try:
        assert detectors.detect_universe(T.with_recursions(bars), ["every_50"]).agg(F.count("*")).first()[0] == 9
    finally:
        del detectors.STATEFUL["every_50"]


def test_long_windows_are_rolled_in_the_pass(spark):
    """The pass gives what Spark's windows give, missing values included, and the matrix has no long sliding window left."""
    rng = np.random.default_rng(5)
    close = np.round(rng.uniform(5, 9, 90), 2).tolist()
    close[30] = None
    rows = [(t, pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=k), c, c and c + 1, c and c - 1, 100.0 + k) for t, n in (("A", 90), ("B", 12)) for k, c in enumerate(close[:n])]
    df = spark.createDataFrame(rows, "ticker string, date date, close double, high double, low double, volume double")
    rolls = T.average_rolls() | T.band_rolls() | T.reach_rolls() | T.range_rolls()
    got = T.with_recursions(df, want=("atr_14",), rolls=rolls).orderBy("ticker", "date").toPandas()
    want = df.select("*", *[c.alias(n) for n, c in T._rolls(df, rolls).items()]).orderBy("ticker", "date").toPandas()
    for n in rolls:
        np.testing.assert_allclose(got[n].astype(float), want[n].astype(float), rtol=1e-12, err_msg=n)
    assert got["sma_20"].notna().sum() == 90 - 19 - 20
    plan = T.build_features(df.withColumns({"open": F.col("close"), "vwap": F.col("close"), "transactions": F.lit(1)}))._jdf.queryExecution().analyzed().toString()
    assert "avg(close" not in plan and "stddev_pop(" not in plan
