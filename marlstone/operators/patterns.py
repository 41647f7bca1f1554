"""The detectors' events over whole tickers as arrays, with labels and the weekly trend: one pass for an event study.

The families of ``detectors`` are windows upon windows, and a study joins their events with labels and trends again. Here a
task makes all of it as the tickers pass. The windows say the same, and a test compares the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.groups import whole_groups
from ..functions.kernels import exponential, percentile_rank, relative_strength, wilder
from ..functions.series import Series, picked, ratio
from ..functions.ship import ship
from . import detectors
from .matrix import PRICES, Columns, arrays, labels, placed, true_range
from .technicals import Config, bandwidth

#: Detector, where it is long and short, and the strength of either.
Signals = Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
LABELS = ("label_long", "label_long_outcome_return", "label_short", "label_short_outcome_return", "terminal_return_10")


def divergences(s: Series, x: Columns) -> Signals:
    rsi = s.each(lambda v: relative_strength(v, 14), x["close"])
    at = {}
    for m in (3, 5):
        for side in ("high", "low"):
            swing = s.pivots(x[side], m, side == "high")
            price, strength = s.lag(swing, m), s.lag(np.where(np.isnan(swing), np.nan, rsi), m)
            earlier = s.before(~np.isnan(price))
            at[m, side] = price, picked(price, earlier), strength - picked(strength, earlier), picked(strength, earlier)
    for name, m, extreme in (("rsi_div_m3", 3, None), ("rsi_div_m5", 5, None), ("rsi_div_m3_ext", 3, 40.0)):
        (low, low0, up, first), (high, high0, down, last) = at[m, "low"], at[m, "high"]
        long_, short = (low < low0) & (up > 0), (high > high0) & (down < 0)
        if extreme is not None:
            long_, short = long_ & (first <= extreme), short & (last >= 100 - extreme)
        yield name, long_, short, up, -down


def gaps(s: Series, x: Columns) -> Signals:
    g, up, down = ratio(x["open"] - s.lag(x["close"]), s.lag(x["atr_14"])), x["close"] > x["open"], x["close"] < x["open"]
    for k in (1.0, 1.5):
        yield f"gap_go_{k}", (g >= k) & up, (g <= -k) & down, np.abs(g), np.abs(g)
        yield f"gap_fade_{k}", (g <= -k) & up, (g >= k) & down, np.abs(g), np.abs(g)


def clouds(s: Series, x: Columns) -> Signals:
    close, atr, c1 = x["close"], x["atr_14"], s.lag(x["close"])
    ema = {n: s.each(lambda v, n=n: exponential(v, n), close) for n in detectors.CLOUD_SPANS}
    for name, (a, b, c, d) in detectors.CLOUDS.items():
        top, bottom, upper, lower = np.fmax(ema[a], ema[b]), np.fmin(ema[a], ema[b]), np.fmax(ema[c], ema[d]), np.fmin(ema[c], ema[d])
        mid = (ema[c] + ema[d]) / 2
        slope = mid - s.lag(mid)
        slope1, warm = s.lag(slope), s.at + 1 > max(a, b, c, d, 14) + 2
        yield (
            f"{name}_reclaim", warm & (c1 < s.lag(bottom)) & (close > top) & (close > upper) & (slope >= 0), warm & (c1 > s.lag(top)) & (close < bottom) & (close < lower) & (slope <= 0),
            np.fmax(ratio(close - top, atr), 0), np.fmax(ratio(bottom - close, atr), 0),
        )
        tilt = ratio(slope, atr)
        yield f"{name}_curl_flip", warm & (slope1 <= 0) & (slope > 0) & (close > upper), warm & (slope1 >= 0) & (slope < 0) & (close < lower), np.fmax(tilt, 0), np.fmax(-tilt, 0)


def false_breaks(s: Series, x: Columns, least: float = 0.25, most: float = 1.5) -> Signals:
    high, low, close, atr = x["high"], x["low"], x["close"], x["atr_14"]
    deep = lambda v: (v >= least) & (v <= most)
    for name, k in (("k20_1bar", 20), ("k55_1bar", 55)):
        lo, hi = s.rolled("min", low, k, 1), s.rolled("max", high, k, 1)
        under, over = ratio(lo - low, atr), ratio(high - hi, atr)
        yield name, (low < lo) & (close > lo) & deep(under), (high > hi) & (close < hi) & deep(over), under, over
    lo, hi, (c1, c2, c3) = s.rolled("min", low, 20, 3), s.rolled("max", high, 20, 3), (s.lag(close, k) for k in (1, 2, 3))
    below, above = (c1 < lo) & ((c2 >= lo) | (c2 < lo) & (c3 >= lo)), (c1 > hi) & ((c2 <= hi) | (c2 > hi) & (c3 <= hi))
    under, over = ratio(lo - s.rolled("min", low, 3), atr), ratio(s.rolled("max", high, 3) - hi, atr)
    yield "k20_2bar", below & (close > lo) & deep(under), above & (close < hi) & deep(over), under, over


def flags(s: Series, x: Columns, pole: int = 5, lengths: range = range(3, 11)) -> Signals:
    high, low, close, atr, volume, tr = (x[c] for c in ("high", "low", "close", "atr_14", "volume", "true_range"))
    speed = s.each(lambda v: percentile_rank(v, 252), ratio(close - s.lag(close, 5), atr))
    atr1, c1 = s.lag(atr), s.lag(close)
    best = {name: tuple(np.full(len(close), np.nan) for _ in range(2)) for name in detectors.FLAGS}
    for f in lengths:  # the shorter pause wins a tie
        e = f + 1
        top, bottom, moved, fell = s.rolled("max", high, f, 1), s.rolled("min", low, f, 1), s.lag(close, e) - s.lag(close, e + pole), c1 - s.lag(close, e)
        span, move, mp = ratio(top - bottom, atr1), ratio(moved, s.lag(atr, e)), s.lag(speed, e)
        calm, before = s.rolled("mean", tr, f, 1), s.rolled("mean", tr, pole, e)
        quiet, busy = s.rolled("mean", volume, f, 1), s.rolled("mean", volume, pole, e)
        strength = np.abs(move) / np.fmax(span, 0.25)
        for name, (least, tight, retrace, contraction, share) in detectors.FLAGS.items():
            common = (span <= tight) & (calm <= contraction * before)
            if share is not None:
                common &= quiet <= share * busy
            up, down = (move >= least, move <= -least) if least is not None else ((mp >= 0.9) & (move > 0), (mp <= 1 - 0.9) & (move < 0))
            fired = common & up & (fell <= 0) & (-fell <= retrace * moved) & (close > top), common & down & (fell >= 0) & (fell <= retrace * -moved) & (close < bottom)
            for held, now in zip(best[name], fired, strict=True):
                better = now & ~(strength <= held)
                held[better] = strength[better]
    for name, (a, b) in best.items():
        yield name, ~np.isnan(a) & np.isnan(b), ~np.isnan(b) & np.isnan(a), a, b


def squeezes(s: Series, x: Columns) -> Signals:
    close, atr, span, cfg = x["close"], x["atr_14"], x["high"] - x["low"], Config()
    calm = s.each(lambda v: percentile_rank(bandwidth(v, cfg), cfg.bb_window), close)
    before, narrow1, wide_bar = s.lag(calm), s.lag((span <= s.rolled("min", span, 7)).astype(float)) == 1, ratio(x["true_range"], atr)
    weight = np.fmax(1 - before, 0)
    for name, (share, bars_, k, wide, narrow) in detectors.SQUEEZES.items():
        hi, lo, run1 = s.rolled("max", x["high"], k, 1), s.rolled("min", x["low"], k, 1), s.lag(s.run(calm <= share))
        broke1 = s.lag(((close > hi) | (close < lo)).astype(float)) == 1
        ready = (run1 >= bars_) & (run1 > 0) & ~broke1 & (wide_bar >= wide)
        if narrow:
            ready &= narrow1
        yield name, ready & (close > hi), ready & (close < lo), ratio(close - hi, atr) * weight, ratio(lo - close, atr) * weight


#: The window expressions' families -> the same over arrays.
ARRAYS: dict[Callable, Callable[[Series, Columns], Signals]] = {
    detectors.divergences: divergences, detectors.gaps: gaps, detectors.clouds: clouds, detectors.false_breaks: false_breaks, detectors.flags: flags, detectors.squeezes: squeezes,
}


def events_in(s: Series, x: Columns, families: list[Callable], stateful: dict[str, Callable]) -> tuple[np.ndarray, list[str], list[str], np.ndarray]:
    """(row, detector, side, strength) of all events."""
    row, names, sides, strength = [np.empty(0, int)], [], [], [np.empty(0)]
    for family in families:
        for name, long_, short, a, b in ARRAYS[family](s, x):
            for side, held, v in (("long", long_, a), ("short", short, b)):
                at = np.flatnonzero(held)
                row.append(at)
                names += [name] * len(at)
                sides += [side] * len(at)
                strength.append(np.nan_to_num(v[at], nan=0.0, posinf=np.inf, neginf=-np.inf))
    if stateful:
        tickers = [{c: x[c][a:b] for c in PRICES} | {"atr": np.nan_to_num(x["atr_14"][a:b])} for a, b in s.ranges]
        found = list(detectors.found_in(tickers, stateful))
        row.append(np.array([s.ranges[k][0] + e[0] for k, _, e in found], int))
        names += [n for _, n, _ in found]
        sides += [e[1] for *_, e in found]
        strength.append(np.array([e[2] for *_, e in found], float))
    return np.concatenate(row), names, sides, np.concatenate(strength)


STUDY = ("ticker string, date date, htf double, " + ", ".join(f"{c} double" for c in LABELS)
         + ", events array<struct<detector: string, side: string, strength: double>>")


def study_rows(bars: DataFrame, families: list[Callable] | None = None, cfg: Config = Config()) -> DataFrame:
    """Every bar's labels, weekly trend and events of the families (of all detectors, if none is named).

    A task holds a batch, its longest ticker, and up to ``detectors.TOGETHER`` tickers or ``MOST_BARS`` bars.
    """
    ship(bars.sparkSession)
    chosen = [f for f in (families or detectors.NEEDS) if f in ARRAYS]
    stateful = dict(detectors.STATEFUL) if families is None or detectors.detect_universe in families else {}

    def made(t: pa.Table, ranges: list[tuple[int, int]]) -> pa.RecordBatch:
        s, x = Series(ranges), arrays(t)
        with np.errstate(all="ignore"):
            x["true_range"] = true_range(s, x)
            x["atr_14"] = s.each(lambda v: wilder(v, 14), x["true_range"])
            labels(s, x, cfg)
            row, names, sides, strength = events_in(s, x, chosen, stateful)
        days = t.column("date").to_numpy().astype("datetime64[D]").astype(np.int64)
        htf = np.concatenate([detectors._trend_of_bars(days[a:b], x["close"][a:b]) for a, b in ranges])
        order = np.argsort(row, kind="stable")
        ends = np.r_[0, np.cumsum(np.bincount(row, minlength=t.num_rows))]
        fields = [pa.array(names, pa.string()), pa.array(sides, pa.string()), pa.array(strength)]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, ["detector", "side", "strength"]).take(pa.array(order)))
        own = [t.column(c).combine_chunks() for c in ("ticker", "date")]
        whole = [*[c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in own], pa.array(htf, from_pandas=True), *[pa.array(x[c], from_pandas=True) for c in LABELS], lists]
        return pa.RecordBatch.from_arrays(whole, names=["ticker", "date", "htf", *LABELS, "events"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        sizes: list[int] = []

        def done() -> pa.RecordBatch:
            ends = np.r_[0, np.cumsum(sizes)].tolist()
            return made(pa.concat_tables(held).combine_chunks(), list(zip(ends, ends[1:], strict=False)))

        for t, groups in whole_groups(batches, ["ticker"]):
            held.append(t)
            sizes += [b - a for a, b in groups]
            if len(sizes) >= detectors.TOGETHER or sum(sizes) >= detectors.MOST_BARS:
                yield done()
                held, sizes = [], []
        if sizes:
            yield done()

    return placed(bars.select("ticker", "date", *PRICES)).mapInArrow(run, STUDY)
