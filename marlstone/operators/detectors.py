"""Chart-pattern detectors: events (ticker, date, detector, side, strength, kind, meta) on closed bars.

``kind`` names the shape where a family knows several; ``meta`` has the family's own figures of the event by name.
``with_state`` adds the weekly trend.

The first six families are window expressions. Level flips, wedges and retracements keep a book of pivots as they
go along a ticker: small state machines, all variants in one pass over sorted partitions. Books of levels go along many
tickers at once, as arrays; lines are fitted at all pivots of a ticker at once. ``register_detector`` adds one's own.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import DateType, StructType

from ..functions.exprs import flag, lag, per_ticker, ratio, rolling, run_length
from ..functions.groups import whole_groups
from ..functions.kernels import exponential, wilder
from ..functions.market import week_end
from ..functions.ship import ship
from . import technicals as T

EVENTS = "ticker string, date date, detector string, side string, strength double, kind string, meta map<string,double>"


def _weekly_trend(bars: DataFrame, exponential_: bool = False, fast: int = 10, slow: int = 20, empty_weeks: bool = False) -> DataFrame:
    """(ticker, week, htf): the trend of the week before, for each week by its end."""
    weeks = bars.groupBy("ticker", week_end(F.col("date")).alias("date")).agg(F.max_by("close", "date").alias("close"))
    if empty_weeks:
        span = weeks.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
        dense = span.select("ticker", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("date"))
        weeks = dense.join(weeks, ["ticker", "date"], "left")
    if exponential_:
        ship(bars.sparkSession)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("date")
            c = pdf["close"].to_numpy(float)
            return pdf.assign(f=exponential(c, fast), s=exponential(c, slow))

        weeks = weeks.groupBy("ticker").applyInPandas(run, "ticker string, date date, close double, f double, s double").withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "fs"})
    else:
        weeks = weeks.withColumns({"f": rolling(F.avg, "close", fast), "s": rolling(F.avg, "close", slow)})
    c, f, s = F.col("close"), F.col("f"), F.col("s")
    state = F.when(s.isNull() | f.isNull(), None).when((c > f) & (f > s), 1.0).when((c < f) & (f < s), -1.0).otherwise(0.0)
    return weeks.withColumn("state", state).select("ticker", F.col("date").alias("week"), F.lag("state").over(per_ticker()).alias("htf"))


def _in_week(rows: DataFrame, weeks: DataFrame, warmup_value: float | None) -> DataFrame:
    out = rows.withColumn("week", week_end(F.col("date"))).join(weeks, ["ticker", "week"], "left").drop("week")
    return out.na.fill(warmup_value, ["htf"]) if warmup_value is not None else out


def weekly_state(bars: DataFrame, warmup_value: float | None = None, **how) -> DataFrame:
    """(ticker, date, htf): the trend of the week completed before each day's: close over fast over slow average is 1,
    the reverse -1, else 0; ``warmup_value`` until the slow average is there. A week without bars doesn't count, or with
    ``empty_weeks`` it leaves the averages missing until they are full again (the convention of the squeezes)."""
    return _in_week(bars.select("ticker", "date"), _weekly_trend(bars, **how), warmup_value)


def with_state(events: DataFrame, bars: DataFrame, warmup_value: float | None = None, **how) -> DataFrame:
    """Events with ``htf``, the weekly trend of their day, as in ``weekly_state``: they meet the weeks, not the bars."""
    return _in_week(events, _weekly_trend(bars, **how), warmup_value)


Meta = dict[str, tuple[Column, Column]]


def _events(df: DataFrame, found: list[tuple[str, Column, Column, Column, Column, Meta]]) -> DataFrame:
    """(name, long, short, strength if long, strength if short, figures by name for either) -> the rows of events."""
    entries = []
    for name, long_, short, x, y, meta in found:
        for k, (side, c, v) in enumerate((("long", long_, x), ("short", short, y))):
            pairs = [z for key, both in meta.items() for z in (F.lit(key), both[k].cast("double"))]
            figures = F.create_map(*pairs) if pairs else F.lit(None)
            entries.append(F.when(flag(c), F.struct(F.lit(name).alias("detector"), F.lit(side).alias("side"), F.coalesce(v, F.lit(0.0)).alias("strength"), F.lit(None).cast("string").alias("kind"), figures.cast("map<string,double>").alias("meta"))))
    return df.select("ticker", "date", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("ticker", "date", "e.*")


def divergences(df: DataFrame) -> DataFrame:
    """Price and RSI at odds between pivots, of either half-width; one variant wants an extreme first RSI (40, 60)."""
    made = {3: T.divergence(df, 3), 5: T.divergence(df, 5)}
    out = df.withColumns({f"_{m}{k}": v for m, cols in made.items() for k, v in cols.items()})
    c, found = F.col, []
    for name, m, extreme in (("rsi_div_m3", 3, None), ("rsi_div_m5", 5, None), ("rsi_div_m3_ext", 3, 40.0)):
        low, high = (c(f"_{m}low_rsi") - c(f"_{m}low_rsi_0")), (c(f"_{m}high_rsi") - c(f"_{m}high_rsi_0"))
        long_ = (c(f"_{m}low_price") < c(f"_{m}low_price_0")) & (low > 0)
        short = (c(f"_{m}high_price") > c(f"_{m}high_price_0")) & (high < 0)
        if extreme is not None:
            long_, short = long_ & (c(f"_{m}low_rsi_0") <= extreme), short & (c(f"_{m}high_rsi_0") >= 100 - extreme)
        found.append((name, long_, short, low, -high, {}))
    return _events(out, found)


def gaps(df: DataFrame) -> DataFrame:
    """Opening gaps of 1 or 1.5 of the last bar's ATR that go on or turn back by the close."""
    out = df.withColumn("_g", ratio(F.col("open") - lag("close"), lag("atr_14")))
    g, up, down, found = F.col("_g"), F.col("close") > F.col("open"), F.col("close") < F.col("open"), []
    for k in (1.0, 1.5):
        found.append((f"gap_go_{k}", (g >= k) & up, (g <= -k) & down, F.abs(g), F.abs(g), {"gap_atr": (g, g)}))
        found.append((f"gap_fade_{k}", (g <= -k) & up, (g >= k) & down, F.abs(g), F.abs(g), {"gap_atr": (g, g)}))
    return _events(out, found)


CLOUDS = {"ripster": (5, 12, 34, 50), "classic": (8, 21, 34, 50), "wide": (9, 20, 50, 100)}
CLOUD_SPANS = tuple(sorted({s for spans in CLOUDS.values() for s in spans}))


def clouds(df: DataFrame) -> DataFrame:
    """Close back through the fast pair of averages on the slow pair's side, and turns of the slow pair's slope.

    Needs ``ema_s`` of all spans (``with_recursions(..., spans=CLOUD_SPANS)``).
    """
    n, close, atr = F.row_number().over(per_ticker()), F.col("close"), F.col("atr_14")
    out, found = df, []
    for name, (a, b, c, d) in CLOUDS.items():
        ema = lambda s: F.col(f"ema_{s}")
        out = out.withColumns({f"_{name}_ft": F.greatest(ema(a), ema(b)), f"_{name}_fb": F.least(ema(a), ema(b)), f"_{name}_st": F.greatest(ema(c), ema(d)), f"_{name}_sb": F.least(ema(c), ema(d)), f"_{name}_mid": F.when(ema(c).isNotNull() & ema(d).isNotNull(), (ema(c) + ema(d)) / 2)})
        out = out.withColumn(f"_{name}_slope", F.col(f"_{name}_mid") - lag(f"_{name}_mid"))
        out = out.withColumns({f"_{name}_slope1": lag(f"_{name}_slope"), f"_{name}_ft1": lag(f"_{name}_ft"), f"_{name}_fb1": lag(f"_{name}_fb"), f"_{name}_warm": n > max(a, b, c, d, 14) + 2, f"_{name}_c1": lag("close")})
        x = lambda k, p=name: F.col(f"_{p}_{k}")
        bull, bear = (close > x("st")) & (x("slope") >= 0), (close < x("sb")) & (x("slope") <= 0)
        pos = lambda v: F.greatest(v, F.lit(0.0))
        tilt = {"slow_slope_atr": (ratio(x("slope"), atr),) * 2}
        found.append((f"{name}_reclaim", x("warm") & (x("c1") < x("fb1")) & (close > x("ft")) & bull, x("warm") & (x("c1") > x("ft1")) & (close < x("fb")) & bear, pos(ratio(close - x("ft"), atr)), pos(ratio(x("fb") - close, atr)), tilt))
        found.append((f"{name}_curl_flip", x("warm") & (x("slope1") <= 0) & (x("slope") > 0) & (close > x("st")), x("warm") & (x("slope1") >= 0) & (x("slope") < 0) & (close < x("sb")), pos(ratio(x("slope"), atr)), pos(-ratio(x("slope"), atr)), tilt))
    return _events(out, found)


def false_breaks(df: DataFrame, least: float = 0.25, most: float = 1.5) -> DataFrame:
    """Sweeps of the prior 20 or 55 bars' extreme by 0.25 to 1.5 ATR that close back: in the bar, or after 1 or 2 closes."""
    close, atr, found, out = F.col("close"), F.col("atr_14"), [], df
    deep = lambda v: (v >= least) & (v <= most)
    for name, k in (("k20_1bar", 20), ("k55_1bar", 55)):
        out = out.withColumns({f"_lo{k}": rolling(F.min, "low", k, 1), f"_hi{k}": rolling(F.max, "high", k, 1)})
        lo, hi = F.col(f"_lo{k}"), F.col(f"_hi{k}")
        under, over = ratio(lo - F.col("low"), atr), ratio(F.col("high") - hi, atr)
        found.append((name, (F.col("low") < lo) & (close > lo) & deep(under), (F.col("high") > hi) & (close < hi) & deep(over), under, over, {"overshoot_atr": (under, over), "level": (lo, hi)}))
    out = out.withColumns({"_lo": rolling(F.min, "low", 20, 3), "_hi": rolling(F.max, "high", 20, 3), "_c1": lag("close"), "_c2": lag("close", 2), "_c3": lag("close", 3), "_dlo": rolling(F.min, "low", 3), "_dhi": rolling(F.max, "high", 3)})
    lo, hi, c1, c2, c3 = (F.col(x) for x in ("_lo", "_hi", "_c1", "_c2", "_c3"))
    below = (c1 < lo) & (flag(c2 >= lo) | (flag(c2 < lo) & flag(c3 >= lo)))
    above = (c1 > hi) & (flag(c2 <= hi) | (flag(c2 > hi) & flag(c3 <= hi)))
    under, over = ratio(lo - F.col("_dlo"), atr), ratio(F.col("_dhi") - hi, atr)
    found.append(("k20_2bar", below & (close > lo) & deep(under), above & (close < hi) & deep(over), under, over, {"overshoot_atr": (under, over), "level": (lo, hi)}))
    return _events(out, found)


FLAGS = {"base": (2.5, 1.5, 0.6, 0.9, None), "strict": (3.0, 1.2, 0.5, 0.75, 0.85), "momentum_decile": (None, 1.5, 0.6, 0.9, None)}


def flags(df: DataFrame, pole: int = 5, lengths: range = range(3, 11)) -> DataFrame:
    """A pole, a tight pause of 3 to 10 bars against it, and a close out of the pause. The strongest length counts;
    bars that fit both ways are dropped. The decile variant needs ``momentum_pctile``, else it finds nothing."""
    out, close = df, F.col("close")
    out = out.withColumn("_atr1", lag("atr_14"))
    cols: dict[str, Column] = {}
    for f in lengths:
        e = f + 1
        cols |= {f"_fh{f}": rolling(F.max, "high", f, 1), f"_fl{f}": rolling(F.min, "low", f, 1), f"_ftr{f}": rolling(F.avg, "true_range", f, 1), f"_pm{f}": lag("close", e) - lag("close", e + pole), f"_pa{f}": lag("atr_14", e), f"_ptr{f}": rolling(F.avg, "true_range", pole, e), f"_dr{f}": lag("close") - lag("close", e), f"_fv{f}": rolling(F.avg, "volume", f, 1), f"_pv{f}": rolling(F.avg, "volume", pole, e)}
        if "momentum_pctile" in df.columns:
            cols[f"_mp{f}"] = lag("momentum_pctile", e)
    out = out.withColumns(cols)
    found = []
    for name, (least, tight, retrace, contraction, volume) in FLAGS.items():
        longs, shorts = [], []
        for f in lengths:
            c = lambda k, n=f: F.col(f"_{k}{n}")
            span, pm = ratio(c("fh") - c("fl"), F.col("_atr1")), c("pm")
            move = ratio(pm, c("pa"))
            common = (span <= tight) & (c("ftr") <= contraction * c("ptr"))
            if volume is not None:
                common = common & (c("fv") <= volume * c("pv"))
            if least is not None:
                up, down = move >= least, move <= -least
            elif "momentum_pctile" in df.columns:
                up, down = (c("mp") >= 0.9) & (move > 0), (c("mp") <= 1 - 0.9) & (move < 0)
            else:
                up = down = F.lit(False)
            strength = F.abs(move) / F.greatest(span, F.lit(0.25))
            won = F.struct(strength.alias("s"), F.lit(-f).alias("len"), move.alias("move"))  # the shorter pause wins a tie
            longs.append(F.when(flag(common & up & (c("dr") <= 0) & (-c("dr") <= retrace * pm) & (close > c("fh"))), won))
            shorts.append(F.when(flag(common & down & (c("dr") >= 0) & (c("dr") <= retrace * -pm) & (close < c("fl"))), won))
        out = out.withColumns({f"_{name}_a": F.greatest(*longs), f"_{name}_b": F.greatest(*shorts)})
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        found.append((name, a.isNotNull() & b.isNull(), b.isNotNull() & a.isNull(), a["s"], b["s"], {"flag_len": (-a["len"], -b["len"]), "pole_move_atr": (a["move"], b["move"])}))
    return _events(out, found)


SQUEEZES = {"bb_squeeze": (0.15, 5, 20, 1.0, False), "nr7_squeeze": (0.30, 1, 7, 1.0, True), "deep_squeeze": (0.10, 10, 20, 1.25, False)}


def squeezes(df: DataFrame) -> DataFrame:
    """The first bar that leaves the prior range on a wide bar, out of a lasting squeeze of the bands."""
    close, atr, found = F.col("close"), F.col("atr_14"), []
    span = F.col("high") - F.col("low")
    out = df.withColumns({"_bp1": lag("bb_bandwidth_pctile"), "_nr7": span <= rolling(F.min, span, 7)})
    for name, (share, bars_, k, wide, narrow) in SQUEEZES.items():
        out = out.withColumns({f"_{name}_hi": rolling(F.max, "high", k, 1), f"_{name}_lo": rolling(F.min, "low", k, 1), f"_{name}_run": run_length(flag(F.col("bb_bandwidth_pctile") <= share))})
        hi, lo = F.col(f"_{name}_hi"), F.col(f"_{name}_lo")
        out = out.withColumn(f"_{name}_broke", flag(close > hi) | flag(close < lo))
        out = out.withColumns({f"_{name}_run1": lag(f"_{name}_run"), f"_{name}_broke1": F.coalesce(lag(f"_{name}_broke"), F.lit(False)), "_nr71": lag("_nr7")})
        ready = (F.col(f"_{name}_run1") >= bars_) & (F.col(f"_{name}_run1") > 0) & ~F.col(f"_{name}_broke1") & (ratio(F.col("true_range"), atr) >= wide)
        if narrow:
            ready = ready & flag(F.col("_nr71"))
        calm = F.greatest(1 - F.col("_bp1"), F.lit(0.0))
        found.append((name, ready & (close > hi), ready & (close < lo), ratio(close - hi, atr) * calm, ratio(lo - close, atr) * calm, {"squeeze_pctile_prev": (F.col("_bp1"),) * 2, "squeeze_run_prev": (F.col(f"_{name}_run1"),) * 2, "expansion_tr_atr": (ratio(F.col("true_range"), atr),) * 2}))
    return _events(out, found)


# --- detectors with state ------------------------------------------------------------------------------------------

#: Row, side, strength, kind and figures by name of each event.
Found = list[tuple[int, str, float, str | None, dict[str, float]]]


def _pivots(bars: dict[str, np.ndarray], m: int, top: bool) -> np.ndarray:
    """Places whose high (low) is the extreme of the m bars on either side; found once for all variants."""
    key = f"_pivots_{m}_{top}"
    if key not in bars:
        bars[key] = _extremes(bars["high" if top else "low"], m, top)
    return bars[key]


def _extremes(x: np.ndarray, m: int, top: bool) -> np.ndarray:
    n = len(x)
    if n < 2 * m + 1:
        return np.empty(0, int)
    view = np.lib.stride_tricks.sliding_window_view(x, 2 * m + 1)
    return np.flatnonzero(x[m : n - m] == (view.max(axis=1) if top else view.min(axis=1))) + m


def _lists(bars: dict[str, np.ndarray]) -> tuple[list[float], ...]:
    """High, low, close and atr as plain floats, which loops over bars read faster; made once for all variants."""
    if "_lists" not in bars:
        bars["_lists"] = tuple(bars[c].tolist() for c in ("high", "low", "close", "atr"))
    return bars["_lists"]


FLIPS = {
    "srflip_base": dict(cluster=0.25, touches=2, margin=0.25, zone=0.25, pierce=0.5, hold=0.0, soonest=2, latest=40, held=10, age=250),
    "srflip_strict": dict(cluster=0.25, touches=3, margin=0.25, zone=0.25, pierce=0.5, hold=0.1, soonest=2, latest=30, held=10, age=250),
    "srflip_loose": dict(cluster=0.25, touches=2, margin=0.1, zone=0.4, pierce=0.5, hold=0.0, soonest=1, latest=60, held=5, age=250),
}


class Level:
    """A price at which pivots cluster; ``side`` is where the close stands, ``armed`` the direction of a break that waits
    for its retest."""

    def __init__(self, price: float, side: int, t: int):
        self.price, self.total, self.touches, self.side, self.since, self.armed, self.broke, self.last = price, price, 1, side, t, 0, -1, t

    def absorb(self, price: float, t: int) -> None:
        self.total, self.touches, self.last = self.total + price, self.touches + 1, t
        self.price = self.total / self.touches


def level_flips(bars: dict[str, np.ndarray], p: dict, m: int = 3) -> Found:
    """Breaks of a level that had held, retested from the other side: the first bar back in its zone decides."""
    high, low, close, atr = _lists(bars)
    confirmed: dict[int, list[float]] = {}
    for x, top in ((high, True), (low, False)):
        for at in _pivots(bars, m, top):
            confirmed.setdefault(int(at) + m, []).append(float(x[at]))
    book: list[Level] = []
    out: Found = []
    for t in range(len(close)):
        a = atr[t]
        if not a > 0:
            continue
        best: dict[int, tuple] = {1: (0.0, None), -1: (0.0, None)}
        for lev in book:
            way = lev.armed
            if way == 0 or t - lev.broke < p["soonest"]:
                continue
            near = low[t] if way > 0 else high[t]
            depth = way * (lev.price - near)  # how far the bar goes beyond the level
            if t - lev.broke > p["latest"]:
                lev.armed = 0
            elif depth >= -p["zone"] * a:
                lev.armed = 0
                holds = depth <= p["pierce"] * a and way * (close[t] - lev.price) > p["hold"] * a and way * (close[t - 1] - lev.price) > 0
                if holds and lev.touches >= p["touches"]:
                    clean = 1 - 0.75 * min(max(depth, 0.0) / (p["pierce"] * a), 1.0)
                    if lev.touches * clean > best[way][0]:
                        best[way] = (lev.touches * clean, {"level_price": lev.price, "level_touches": float(lev.touches), "break_age": float(t - lev.broke)})
        out += [(t, "long" if way > 0 else "short", s, None, meta) for way, (s, meta) in best.items() if s > 0]
        for lev in book:
            beyond = close[t] - lev.price
            now = 1 if beyond > p["margin"] * a else -1 if beyond < -p["margin"] * a else lev.side
            if now != lev.side:
                if t - lev.since >= p["held"]:
                    lev.armed, lev.broke = now, t
                lev.side, lev.since, lev.last = now, t, t
        for price in confirmed.get(t, []):
            near = [lev for lev in book if abs(lev.price - price) <= p["cluster"] * a]
            if near:
                lev = min(reversed(near), key=lambda x: abs(x.price - price))
                lev.absorb(price, t)
            else:
                book.append(Level(price, 1 if close[t] > price else -1, t))
        book = [lev for lev in book if t - lev.last <= p["age"]]
    return out


def _side_by_side(tickers: list[dict[str, np.ndarray]], m: int) -> dict[str, np.ndarray]:
    """Arrays (bar, ticker): prices, atr (0 beyond a ticker's last bar), and the prices of pivots where they are confirmed."""
    shape = max(len(b["close"]) for b in tickers), len(tickers)
    out = {c: np.zeros(shape) for c in ("high", "low", "close", "atr")} | {c: np.full(shape, np.nan) for c in ("top", "bottom")}
    for k, b in enumerate(tickers):
        for c in ("high", "low", "close", "atr"):
            out[c][: len(b[c]), k] = b[c]
        for c, x, top in (("top", "high", True), ("bottom", "low", False)):
            at = _pivots(b, m, top)
            out[c][at + m, k] = b[x][at]
    return out


class Books:
    """The levels of many tickers: arrays (place in the ticker's book, ticker). Places are taken in the order in which levels
    are made; one without a level has no price."""

    EMPTY = {"price": np.nan, "total": 0.0, "touches": 0, "above": False, "since": 0, "armed": 0, "broke": -1, "last": np.iinfo(np.int32).max}
    KINDS = {"price": float, "total": float, "touches": np.int32, "above": bool, "since": np.int32, "armed": np.int8, "broke": np.int32, "last": np.int32}

    def __init__(self, width: int, places: int = 64):
        self.held = {c: np.full((places, width), v, self.KINDS[c]) for c, v in self.EMPTY.items()}
        self.count = np.zeros(width, int)

    def flat(self, name: str) -> np.ndarray:
        return self.held[name].reshape(-1)

    def room(self) -> None:
        """Places for one more level in each book: those of levels that are gone, or else twice as many as there are."""
        places = len(self.held["price"])
        if self.count.max() < places:
            return
        gone = np.isnan(self.held["price"])
        order = np.argsort(gone, axis=0, kind="stable")
        self.held = {c: np.take_along_axis(x, order, axis=0) for c, x in self.held.items()}
        self.count = places - gone.sum(axis=0)
        if self.count.max() > places * 3 // 4:
            self.held = {c: np.concatenate([x, np.full(x.shape, self.EMPTY[c], x.dtype)]) for c, x in self.held.items()}


def level_flips_together(tickers: list[dict[str, np.ndarray]], p: dict, m: int = 3) -> list[Found]:
    """``level_flips`` of each of many tickers of about the same length: the same steps, a bar of all tickers at a time."""
    b, width = _side_by_side(tickers, m), len(tickers)
    books = Books(width)
    fired: list[tuple[np.ndarray, ...]] = []
    for t in range(len(b["close"])):
        high, low, close, atr = (b[c][t] for c in ("high", "low", "close", "atr"))
        live = atr > 0
        if not live.any():
            continue
        flat = books.flat
        if len(at := np.flatnonzero(flat("armed"))):
            at = at[live[at % width] & (t - flat("broke")[at] >= p["soonest"])]
            k, way, price, waited = at % width, flat("armed")[at].astype(float), flat("price")[at], t - flat("broke")[at]
            a, late = atr[k], waited > p["latest"]
            depth = way * (price - np.where(way > 0, low[k], high[k]))
            back = ~late & (depth >= -p["zone"] * a)
            flat("armed")[at[late | back]] = 0
            holds = back & (depth <= p["pierce"] * a) & (way * (close[k] - price) > p["hold"] * a) & (way * (b["close"][t - 1][k] - price) > 0) & (flat("touches")[at] >= p["touches"])
            if holds.any():
                at, k, way, price, waited, depth, a = (x[holds] for x in (at, k, way, price, waited, depth, a))
                touches = flat("touches")[at].astype(float)
                score = touches * (1 - 0.75 * np.minimum(np.maximum(depth, 0.0) / (p["pierce"] * a), 1.0))
                fired.append((k, np.full(len(k), t), way, score, at // width, price, touches, waited.astype(float)))
        used = int(books.count.max())
        above = books.held["above"][:used]
        beyond, margin = close - books.held["price"][:used], np.where(live, p["margin"] * atr, np.inf)
        changed = np.where(above, beyond < -margin, beyond > margin)
        if len(at := np.flatnonzero(changed)):
            held = at[t - flat("since")[at] >= p["held"]]
            above ^= changed
            flat("armed")[held] = np.where(flat("above")[held], 1, -1)
            flat("broke")[held] = t
            flat("since")[at] = t
            flat("last")[at] = t
        for prices in (b["top"][t], b["bottom"][t]):
            k = np.flatnonzero(live & ~np.isnan(prices))
            if not len(k):
                continue
            x, used = prices[k], int(books.count.max())
            away = np.abs(books.held["price"][:used, k] - x)
            away = np.where(away <= p["cluster"] * atr[k], away, np.inf)
            if used:
                j = used - 1 - np.argmin(away[::-1], axis=0)  # of equally near ones the newest
                near = away[j, np.arange(len(k))] < np.inf
                at = (j * width + k)[near]
                flat("total")[at] += x[near]
                flat("touches")[at] += 1
                flat("price")[at] = flat("total")[at] / flat("touches")[at]
                flat("last")[at] = t
                k, x = k[~near], x[~near]
            books.room()
            at = books.count[k] * width + k
            for name, value in (("price", x), ("total", x), ("touches", 1), ("above", close[k] > x), ("since", t), ("armed", 0), ("broke", -1), ("last", t)):
                books.flat(name)[at] = value
            books.count[k] += 1
        old = np.flatnonzero((books.held["last"][: int(books.count.max())] < t - p["age"]) & live)
        for name in ("price", "armed", "last") if len(old) else ():
            books.flat(name)[old] = Books.EMPTY[name]
    out: list[Found] = [[] for _ in tickers]
    if fired:
        k, t, way, score, place, *figures = (np.concatenate(x) for x in zip(*fired, strict=True))
        order = np.lexsort((place, -score, -way, t, k))
        k, t, way, score, *figures = (x[order] for x in (k, t, way, score, *figures))
        best = np.r_[True, (np.diff(k) != 0) | (np.diff(t) != 0) | (np.diff(way) != 0)]
        for ticker, bar, side, s, price, touches, waited in zip(*(x[best].tolist() for x in (k, t, way, score, *figures)), strict=True):
            out[ticker].append((bar, "long" if side > 0 else "short", s, None, {"level_price": price, "level_touches": touches, "break_age": waited}))
    return out


WEDGES = {
    "wedge_base": dict(m=3, back=60, most=4, flat=0.03, converge=0.02, fit=0.40, shrink=0.25, margin=0.05, age=15),
    "wedge_strict": dict(m=3, back=50, most=5, flat=0.025, converge=0.03, fit=0.28, shrink=0.40, margin=0.10, age=12),
    "wedge_loose": dict(m=2, back=45, most=4, flat=0.04, converge=0.015, fit=0.55, shrink=0.15, margin=0.0, age=20),
}


def _recent(pivots: np.ndarray, t: np.ndarray, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) in ``pivots`` of the recent ones that are confirmed at each bar t: the last few that aren't too old."""
    end = np.searchsorted(pivots + p["m"], t, "right")
    return np.maximum(np.searchsorted(pivots, t - p["back"], "left"), end - min(p["most"], 12)).clip(0), end


def _lines(pivots: np.ndarray, x: np.ndarray, first: np.ndarray, end: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and mean absolute residual of the least-squares line through the pivots of each range, of two or more."""
    n = (end - first).astype(float)
    spots = [np.minimum(first + j, end - 1) for j in range(most)]
    there = [(first + j < end).astype(float) for j in range(most)]
    at, y = [pivots[s].astype(float) for s in spots], [x[pivots[s]] for s in spots]
    total = lambda parts: sum((v * w for v, w in zip(parts, there, strict=True)), np.zeros(len(n)))
    centre = total(at) / n
    d = [v - centre for v in at]
    slope = total([v * w for v, w in zip(d, y, strict=True)]) / total([v * v for v in d])
    base = total(y) / n - slope * centre
    return slope, base, total([np.abs(w - base - slope * v) for v, w in zip(at, y, strict=True)]) / n


#: Shape and the directions it may break in: rising wedges down, falling ones up, triangles either way.
SHAPES: list[tuple[str, tuple[int, ...]]] = [("rising_wedge", (-1,)), ("falling_wedge", (1,)), *((f"{n}_triangle", (1, -1)) for n in ("ascending", "descending", "symmetric"))]


def _shapes(top: np.ndarray, bottom: np.ndarray, flat: float) -> np.ndarray:
    """Which of ``SHAPES`` each pair of slopes is, or -1."""
    level = np.abs(top) <= flat
    rules = [(top > flat) & (bottom > flat), (top < -flat) & (bottom < -flat), level & (bottom > flat), (top < -flat) & (np.abs(bottom) <= flat), (top < -flat) & (bottom > flat)]
    return np.select(rules, range(len(rules)), -1)


def wedges(bars: dict[str, np.ndarray], p: dict) -> Found:
    """Converging lines through recent pivots, refitted at each confirmed one; the first close beyond a line uses them up."""
    high, low, m, (_, _, close, atr) = bars["high"], bars["low"], p["m"], _lists(bars)
    tops, bottoms = _pivots(bars, m, True), _pivots(bars, m, False)
    made = np.union1d(tops + m, bottoms + m)  # bars at which a pivot is confirmed; lines last until the next of them
    until = np.append(made, len(close))[1:]
    (r0, r1), (s0, s1) = _recent(tops, made, p), _recent(bottoms, made, p)
    a = bars["atr"][made]
    ready = (a > 0) & (r1 - r0 >= 2) & (s1 - s0 >= 2)
    made, until, r0, r1, s0, s1, a = (x[ready] for x in (made, until, r0, r1, s0, s1, a))
    if not len(made):
        return []
    (rs, rb, rm), (ss, sb, sm) = _lines(tops, high, r0, r1, p["most"]), _lines(bottoms, low, s0, s1, p["most"])
    shape, start = _shapes(rs / a, ss / a, p["flat"]), np.minimum(tops[r0], bottoms[s0])
    first, now = (rb + rs * start) - (sb + ss * start), (rb + rs * made) - (sb + ss * made)
    fits = (shape >= 0) & (np.maximum(rm, sm) <= p["fit"] * a) & ((ss - rs) / a >= p["converge"]) & (first > 0) & (now > 0)
    c, slack = bars["close"][made], p["margin"] * a
    fits &= (1 - now / np.where(first > 0, first, 1.0) >= p["shrink"]) & (sb + ss * made - slack <= c) & (c <= rb + rs * made + slack)
    out: Found = []
    touches = (r1 - r0) + (s1 - s0)
    for start_, end, u, v, r, s, wide, n, k in zip(*(x[fits].tolist() for x in (made, until, rs, rb, ss, sb, first, touches, shape)), strict=True):
        kind, ways = SHAPES[k]
        for t in range(start_, min(end, start_ + p["age"] + 1)):
            top, bottom, slack = v + u * t, s + r * t, p["margin"] * atr[t]
            if top <= bottom or not atr[t] > 0:
                break
            way = 1 if close[t] > top + slack else -1 if close[t] < bottom - slack else 0
            if way:
                if way in ways:
                    narrowed = min(max(1 - (top - bottom) / wide, 0.0), 1.0)
                    out.append((t, "long" if way > 0 else "short", n * narrowed, kind, {"touch_count": float(n), "convergence": narrowed}))
                break
    return out


ALL_LEVELS = (0.382, 0.5, 0.618, 0.786)
RETRACEMENTS = {
    f"fib_{name}{suffix}": dict(m=3, levels=levels, near=near, leg=leg, age=40, use=use)
    for name, levels, near, leg in (("base", ALL_LEVELS, 0.3, 2.0), ("tight", (0.5, 0.618), 0.2, 3.0), ("loose", ALL_LEVELS, 0.5, 1.5))
    for suffix, use in (("", True), ("_nofib", False))
}


def _others(prices: list[float], price: float, reach: float, ends: tuple[float, float]) -> int:
    """How many sorted prices lie within reach of a price and aren't the leg's own ends."""
    first, end = bisect_left(prices, price - reach), bisect_right(prices, price + reach)
    if abs(price - ends[0]) > reach + 1e-6 and abs(price - ends[1]) > reach + 1e-6:
        return end - first
    return sum(abs(x - ends[0]) > 1e-9 and abs(x - ends[1]) > 1e-9 for x in prices[first:end])


def _known(bars: dict[str, np.ndarray], m: int) -> list[tuple[int, int, float]]:
    """(bar, way, price) of all pivots, found once for all variants. A bar that is both kinds of pivot counts as a high first, then as a low: the low is the leg's end."""
    key = f"_known_{m}"
    if key not in bars:
        tops, bottoms = ([(int(k), way, float(bars[c][k])) for k in _pivots(bars, m, way > 0)] for way, c in ((1, "high"), (-1, "low")))
        bars[key] = sorted(tops + bottoms, key=lambda r: r[0])
    return bars[key]


def retracements(bars: dict[str, np.ndarray], p: dict) -> Found:
    """A leg between the last two opposite pivots, pulled back into a retracement near other pivots, and closed out of
    the pull-back bar again. Without ``use`` any pull-back counts: the control."""
    (high, low, close, atr), m, use, age = _lists(bars), p["m"], p["use"], p["age"]
    pivots = _known(bars, m)
    prices: list[float] = []  # of the pivots before nxt, sorted
    nxt, end, out, t = 0, len(close), [], -1
    way, levels, zone = 0, [], None  # without a leg the way is 0
    start = to = at = 0
    while True:
        t += 1
        if not way:  # nothing happens before the next pivot is confirmed
            if nxt == len(pivots):
                break
            t = max(t, pivots[nxt][0] + m)
        if t >= end:
            break
        before = nxt
        while nxt < len(pivots) and pivots[nxt][0] + m <= t:
            insort(prices, pivots[nxt][2])
            nxt += 1
        a = atr[t]
        if not a > 0:
            continue
        if nxt > before and nxt > 1:
            (_, k0, p0), (place, k1, p1) = pivots[nxt - 2 : nxt]
            if k0 != k1 and abs(p1 - p0) >= p["leg"] * a:
                way, start, to, at, zone = k1, p0, p1, place, None
                levels = [(share, p1 - share * (p1 - p0)) for share in p["levels"]]
        if not way:
            continue
        if t - at > age:
            way = 0
        elif zone is None:
            if not use and not (low[t] < to if way > 0 else high[t] > to):
                continue
            best, at_share = 0, 0.0
            for share, price in levels:
                if not use or low[t] <= price <= high[t]:
                    near = _others(prices, price, p["near"] * a, (start, to))
                    if near and near + use > best:
                        best, at_share = near + use, share
            if best:
                zone = (high[t] if way > 0 else low[t], best, at_share)
        elif way * (close[t] - zone[0]) > 0:
            edge, factors, at_share = zone
            clean = way * (close[t] - edge) / a
            out.append((t, "long" if way > 0 else "short", factors * clean, None, {"confluence_count": float(factors), "fib_level": at_share, "reclaim_cleanliness": clean}))
            way = 0
        elif (low[t] < start) if way > 0 else (high[t] > start):
            way = 0
    return out


def _flips(p: dict) -> Callable[[dict[str, np.ndarray]], Found]:
    """``level_flips`` with its parameters, marked as one that can go along many tickers at once."""

    def run(bars: dict[str, np.ndarray]) -> Found:
        return level_flips(bars, p)

    run.flips = True
    return run


STATEFUL: dict[str, Callable[[dict[str, np.ndarray]], Found]] = {
    **{n: _flips(p) for n, p in FLIPS.items()},
    **{n: lambda b, p=p: wedges(b, p) for n, p in WEDGES.items()},
    **{n: lambda b, p=p: retracements(b, p) for n, p in RETRACEMENTS.items()},
}


def register_detector(name: str, fn: Callable[[dict[str, np.ndarray]], Found]) -> None:
    """``fn`` gets arrays (open, high, low, close, volume, atr) of one ticker and returns (row, side, strength, kind, figures)
    of its events; the last two may be left out."""
    STATEFUL[name] = fn


#: Tickers and bars that a task takes at once, and the fewest tickers whose books go side by side.
TOGETHER, MOST_BARS, FEWEST = 256, 1 << 18, 8


def _alike(lengths: list[int]) -> Iterator[list[int]]:
    """Places of tickers by length, cut where one is less than half as long as the first of its group."""
    group: list[int] = []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        if group and lengths[k] * 2 < lengths[group[0]]:
            yield group
            group = []
        group.append(k)
    yield group


def found_in(tickers: list[dict[str, np.ndarray]], chosen: dict[str, Callable[[dict[str, np.ndarray]], Found]]) -> Iterator[tuple[int, str, tuple]]:
    """(place of the ticker, detector, event) of many tickers."""
    groups = list(_alike([len(b["close"]) for b in tickers]))
    for name, fn in chosen.items():
        flips = FLIPS.get(name) if getattr(fn, "flips", False) else None
        for group in groups:
            together = flips is not None and len(group) >= FEWEST
            found = level_flips_together([tickers[k] for k in group], flips) if together else [fn(tickers[k]) for k in group]
            yield from ((k, name, event) for k, events in zip(group, found, strict=True) for event in events)


def _true_range(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    before = np.r_[np.nan, close[:-1]]
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


def _trend_of_bars(days: np.ndarray, close: np.ndarray, fast: int = 10, slow: int = 20) -> np.ndarray:
    """What ``weekly_state`` has for each bar of one ticker, by days since 1970 in order; missing values are NaN."""
    week = days + (12 - (days + 4) % 7) % 7
    ends = np.flatnonzero(np.r_[np.diff(week) != 0, True])
    c = close[ends]
    f, s = (np.full(len(c), np.nan) for _ in range(2))
    for out, n in ((f, fast), (s, slow)):
        if len(c) >= n:
            out[n - 1 :] = sum(c[k : len(c) - n + 1 + k] for k in range(n)) / n
    state = np.where(np.isnan(f) | np.isnan(s), np.nan, np.where((c > f) & (f > s), 1.0, np.where((c < f) & (f < s), -1.0, 0.0)))
    return np.r_[np.nan, state[:-1]][np.searchsorted(ends, np.arange(len(close)))]


def detect_universe(df: DataFrame, names: list[str] | None = None, trend: bool = False) -> DataFrame:
    """Events of the detectors with state, all in one pass over each ticker; without ``atr_14`` the pass makes it, and with
    ``trend`` it adds the ``htf`` that ``with_state`` takes from the bars once more.

    A task holds a batch, its longest ticker, and up to ``TOGETHER`` tickers or ``MOST_BARS`` bars with their books.
    """
    ship(df.sparkSession)
    chosen = {n: STATEFUL[n] for n in names or STATEFUL}
    prices, given = ["open", "high", "low", "close", "volume"], ["atr_14"] if "atr_14" in df.columns else []

    def arrays(t: pa.Table, a: int, b: int) -> dict[str, np.ndarray]:
        part = t.slice(a, b - a)
        out = {c: part.column(c).to_numpy().astype(float) for c in prices + given}
        atr = out.pop("atr_14") if given else wilder(_true_range(out["high"], out["low"], out["close"]), 14)
        return out | {"atr": np.nan_to_num(atr)}

    def events(held: list[tuple[str, np.ndarray, dict[str, np.ndarray]]]) -> pa.RecordBatch:
        htf = [_trend_of_bars(days, b["close"]).tolist() for _, days, b in held] if trend else None
        rows = [(held[k][0], held[k][1][e[0]], n, e[1], float(e[2]), *((*e[3:], None, None)[:2]), htf and htf[k][e[0]]) for k, n, e in found_in([b for *_, b in held], chosen)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        columns[1], columns[6] = np.array(columns[1], np.int32), [m if m is None else list(m.items()) for m in columns[6]]
        kinds = (pa.string(), pa.date32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.float64()))
        made = [pa.array(x, kind) if kind != pa.date32() else pa.array(x).cast(kind) for x, kind in zip(columns, kinds, strict=False)]
        made += [pa.array(columns[7], pa.float64(), from_pandas=True)] * trend
        return pa.record_batch(made, names=["ticker", "date", "detector", "side", "strength", "kind", "meta", "htf"][: len(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bars = [], 0
        for t, groups in whole_groups(batches, ["ticker"]):
            for a, b in groups:
                held.append((t.column("ticker")[a].as_py(), t.column("day").slice(a, b - a).to_numpy().astype("datetime64[D]").astype(np.int64), arrays(t, a, b)))
                bars += b - a
                if len(held) == TOGETHER or bars >= MOST_BARS:
                    yield events(held)
                    held, bars = [], 0
        if held:
            yield events(held)

    # The window brings bars to their ticker and in order, unless they are there already.
    placed = df.select("ticker", F.to_date("date").alias("day"), *[F.col(c).cast("double") for c in prices + given], F.row_number().over(per_ticker()).alias("at"))
    return placed.mapInArrow(run, EVENTS + ", htf double" * trend)


def register_sql(spark: SparkSession, name: str = "detect") -> None:
    """Make the detectors that are registered now a table function of SQL: ``SELECT * FROM detect(TABLE(bars), 'a, b')``, or
    of all of them without names. The table has ticker, date, open, high, low, close, volume and atr_14 in any order; it
    is partitioned by ticker and sorted by date by the function itself. Returns (ticker, date, detector, side, strength, kind).
    """
    ship(spark)
    there = dict(STATEFUL)
    columns = ("open", "high", "low", "close", "volume", "atr_14")

    class Detect:
        @staticmethod
        def analyze(bars: AnalyzeArgument, names: AnalyzeArgument | None = None) -> AnalyzeResult:
            have = {f.name for f in bars.dataType.fields}
            if lacking := {"ticker", "date", *columns} - have:
                raise ValueError(f"the table lacks {sorted(lacking)}")
            chosen = [n.strip() for n in names.value.split(",")] if names is not None and names.value else list(there)
            if unknown := set(chosen) - set(there):
                raise ValueError(f"unknown detectors {sorted(unknown)}")
            date = next(f.dataType for f in bars.dataType.fields if f.name == "date")
            out = StructType().add("ticker", "string").add("date", date).add("detector", "string").add("side", "string").add("strength", "double").add("kind", "string")
            # A row costs by its fields: figures are one of them, and a date is its day.
            day = "unix_date(date)" if isinstance(date, DateType) else "date"
            figures = f"array({', '.join(f'CAST({c} AS DOUBLE)' for c in columns)})"
            return AnalyzeResult(out, partitionBy=[PartitioningColumn("ticker")], orderBy=[OrderingColumn("date")], select=[SelectedColumn("ticker"), SelectedColumn(day, "day"), SelectedColumn(figures, "figures")])

        def __init__(self) -> None:
            self.rows: list[Row] = []
            self.names = None

        def eval(self, bars: Row, names: str | None = None) -> None:
            self.rows.append(bars)  # nothing else for each row: fields are taken apart once for a ticker
            self.names = names

        def terminate(self):
            if not self.rows:
                return
            tickers, days, figures = zip(*self.rows, strict=True)
            arrays = dict(zip(columns, np.array(figures, float).T.copy(), strict=True))
            arrays["atr"] = np.nan_to_num(arrays.pop("atr_14"))
            at = lambda t: dt.date(1970, 1, 1) + dt.timedelta(days[t]) if isinstance(days[t], int) else days[t]
            for n in [n.strip() for n in self.names.split(",")] if self.names else there:
                for t, side, strength, *more in there[n](arrays):
                    yield tickers[t], at(t), n, side, float(strength), (more or [None])[0]

    # Rows come pickled: with Arrow, each call of ``eval`` would give a table of its own back, which costs far more than the row.
    spark.udtf.register(name, udtf(Detect, useArrow=False))


#: What each family reads besides the bars: recursive columns, averages' spans, and window blocks.
NEEDS: dict[Callable[[DataFrame], DataFrame], tuple[tuple[str, ...], tuple[int, ...], bool]] = {
    divergences: (("rsi_14",), (), True),
    gaps: (("atr_14",), (), False),
    clouds: (("atr_14",), CLOUD_SPANS, False),
    false_breaks: (("atr_14",), (), False),
    flags: (("atr_14", "momentum_pctile"), (), False),
    squeezes: (("atr_14", "bb_bandwidth_pctile"), (), False),
    detect_universe: ((), (), False),
}


def prepared(bars: DataFrame, *families: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bars with the columns that the families (all, if none is named) read."""
    needs = [NEEDS[f] for f in families or NEEDS]
    want = tuple(sorted({c for n in needs for c in n[0]}))
    spans = tuple(sorted({s for n in needs for s in n[1]}))
    out = T.with_recursions(bars, spans=spans, want=want) if want or spans else bars
    return T.swings(out) if any(n[2] for n in needs) else out


def all_events(bars: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """Events of every detector; ``df`` is what ``prepared`` makes of the bars, if it is there already."""
    df = prepared(bars) if df is None else df
    out = None
    for family in NEEDS:
        found = family(df)
        out = found if out is None else out.unionByName(found)
    return out
