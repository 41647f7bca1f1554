"""Queries over bars: indicators, feature blocks, labels. ``oracle`` SQL restates each from its definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import bars_since, last_value, run_length
from ..operators import bars as B
from ..operators import scans
from ..operators import technicals as T
from .adapters import BARS, bars
from .registry import query, rounded

W = "(PARTITION BY ticker ORDER BY date)"


def _over(n: int, back: int = 0) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1 + back} PRECEDING AND {back} PRECEDING)"


def _roll(fn: str, x: str, n: int, back: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {_over(n, back)} = {n} THEN {fn}({x}) OVER {_over(n, back)} END"


def _since(event: str) -> str:
    return f"rn - last_value(CASE WHEN {event} THEN rn END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _wilder(x: str, n: int, first: int) -> str:
    """The closed form of the recursion: powers of (n - 1) / n over a running sum, seeded at row first + n - 1."""
    a, at = f"(({n}-1)/{n}.0::DOUBLE)", first + n - 1
    run = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    seed = f"avg(CASE WHEN rn BETWEEN {first} AND {at} THEN {x} END) OVER (PARTITION BY ticker)"
    return f"CASE WHEN rn >= {at} THEN pow({a}, rn - {at}) * ({seed} + coalesce(sum(CASE WHEN rn > {at} THEN {x} * pow({a}, {at} - rn) / {n} END) OVER {run}, 0)) END"


def _rank(x: str, n: int) -> str:
    """Mean rank of the last value of the trailing list of n."""
    l = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {_over(n)}"
    return f"CASE WHEN count({x}) OVER {_over(n)} = {n} THEN (len(list_filter({l}, lambda v: v < {x})) + (len(list_filter({l}, lambda v: v = {x})) + 1) / 2.0) / {n} END"


RSI = ", ".join(
    f"CASE WHEN g{p} = 0 AND l{p} = 0 THEN 50 WHEN l{p} = 0 THEN 100 ELSE 100 - 100 / (1 + g{p} / l{p}) END AS rsi_{p}" for p in (2, 7, 14)
)
BASE = f"""{BARS},
i0 AS (SELECT *, row_number() OVER {W} AS rn, lag(close) OVER {W} AS c1, lag(close, 2) OVER {W} AS c2, lag(close, 3) OVER {W} AS c3 FROM bars),
i1 AS (SELECT *, greatest(high - low, abs(high - c1), abs(low - c1)) AS true_range, greatest(close - c1, 0) AS gain, greatest(c1 - close, 0) AS loss,
  {', '.join(f'{_roll("avg", "close", p)} AS sma_{p}' for p in (20, 50, 100, 200))}, {_roll('avg', 'volume', 20)} AS volume_avg_20,
  {_roll('stddev_pop', 'close', 20)} AS sd FROM i0),
i2 AS (SELECT *, sma_20 + 2 * sd AS bb_upper, sma_20 AS bb_middle, sma_20 - 2 * sd AS bb_lower, {_wilder('true_range', 14, 1)} AS atr_14,
  {', '.join(f"{_wilder('gain', p, 2)} AS g{p}, {_wilder('loss', p, 2)} AS l{p}" for p in (2, 7, 14))} FROM i1),
i3 AS (SELECT *, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_percent_b, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_bandwidth, {RSI}
  FROM i2)"""
PCTL = f"""p0 AS (SELECT *, {_rank('bb_bandwidth', 126)} AS bb_bandwidth_pctile FROM i3)"""
SWINGS = "s0 AS (SELECT *, " + ", ".join(
    f"CASE WHEN count(*) OVER c{m} = {2 * m + 1} AND high = max(high) OVER c{m} THEN high END AS swing_high_m{m}, CASE WHEN count(*) OVER c{m} = {2 * m + 1} AND low = min(low) OVER c{m} THEN low END AS swing_low_m{m}"
    for m in (3, 5)
) + """ FROM i3 WINDOW c3 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), c5 AS (PARTITION BY ticker ORDER BY date ROWS
  BETWEEN 5 PRECEDING AND 5 FOLLOWING)),\n""" + (
    "s1 AS (SELECT *, " + ", ".join(f"lag(swing_{s}_m{m}, {m}) OVER {W} AS swing_{s}_m{m}_conf" for m in (3, 5) for s in ("high", "low")) + " FROM s0)"
)
TREND = f"""t0 AS (SELECT *, CASE WHEN sma_50 IS NULL OR sma_100 IS NULL OR sma_200 IS NULL THEN NULL
  WHEN sma_50 > sma_100 AND sma_100 > sma_200 THEN 2.0
  WHEN (sma_50 > sma_100)::INT + (sma_100 > sma_200)::INT + (sma_50 > sma_200)::INT = 2 THEN 1.0
  WHEN sma_50 < sma_100 AND sma_100 < sma_200 THEN -2.0
  WHEN (sma_50 < sma_100)::INT + (sma_100 < sma_200)::INT + (sma_50 < sma_200)::INT = 2 THEN -1.0 ELSE 0.0 END::DOUBLE AS trend_stack_state FROM s1)"""


def _ordered(cte: str, columns: str) -> str:
    """ticker, date and rounded columns of a CTE."""
    named = ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in columns.split(", "))
    return f"SELECT ticker, date, {named} FROM {cte}"


def _pick(df: DataFrame, columns: str) -> DataFrame:
    return df.select("ticker", "date", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in columns.split(", ")])


@query("w27_bars", f"""WITH {BARS} SELECT ticker, date, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close,
  round(volume, 8) AS volume, round(vwap, 8) AS vwap, transactions FROM bars""")
def w27_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(bars(spark, sf_dir), 8)


@query("w26_weekly", f"""WITH {BARS}, w AS (SELECT *, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week FROM bars)
SELECT ticker, CAST(week AS DATE) AS date, round(arg_min(open, date), 8) AS open, round(max(high), 8) AS high, round(min(low), 8) AS low, round(arg_max(close,
  date), 8) AS close, round(sum(volume), 8) AS volume FROM w GROUP BY 1, week""")
def w26_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.weekly(bars(spark, sf_dir)), 8)


SMA = "sma_20, sma_50, sma_100, sma_200, volume_avg_20"


@query("w1_sma", f"WITH {BASE} {_ordered('i3', SMA)}")
def w1_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.moving_averages(bars(spark, sf_dir)), SMA)


BOLL = "bb_upper, bb_middle, bb_lower, bb_percent_b, bb_bandwidth"


@query("w2_w12_bollinger", f"WITH {BASE} {_ordered('i3', BOLL)}")
def w2_bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.bollinger(bars(spark, sf_dir)), BOLL)


@query("w3_true_range", f"WITH {BASE} SELECT ticker, date, round(true_range, 8) AS true_range FROM i3")
def w3_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("ticker", "date", F.round(T.true_range(), 8).alias("true_range"))


REC = "atr_14, rsi_2, rsi_7, rsi_14"


@query("w4_w5_atr_rsi", f"WITH {BASE} {_ordered('i3', REC)}")
def w4_atr_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.with_recursions(bars(spark, sf_dir)), REC)


@query("w4_atr_by_blocks", f"WITH {BASE} SELECT ticker, date, round(true_range, 6) AS true_range, round(atr_14, 6) AS atr_14 FROM i3")
def w4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same average by blocks of a year, as for series that are too long for one task."""
    year = F.year("date")
    ranged = scans.blocked_range(bars(spark, sf_dir), year)
    return rounded(scans.smoothed(ranged, F.col("true_range"), "atr_14", 14, year).select("ticker", "date", "true_range", "atr_14"))


SW = ", ".join(f"swing_{s}_m{m}{c}" for m in (3, 5) for s in ("high", "low") for c in ("", "_conf"))


@query("w6_swings", f"WITH {BASE}, {SWINGS} {_ordered('s1', SW)}")
def w6_swings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.swings(bars(spark, sf_dir)), SW)


@query("w7_w10_w18_levels", f"""WITH {BASE}, {SWINGS}, l AS (SELECT ticker, date, rn,
  last_value(swing_high_m3_conf IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level,
  {_since('swing_high_m3_conf IS NOT NULL')} AS bars_since_level, rn - coalesce(last_value(CASE WHEN NOT coalesce(close > c1, false) THEN rn END IGNORE NULLS)
  OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS up_run FROM s1)
{_ordered('l', 'level, bars_since_level, up_run')}""")
def w7_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = T.swings(bars(spark, sf_dir)).withColumn("c1", T.lag("close"))
    conf = F.col("swing_high_m3_conf")
    return _pick(s.withColumns({"level": last_value(conf), "bars_since_level": bars_since(conf.isNotNull()), "up_run": run_length(F.col("close") > F.col("c1"))}), "level, bars_since_level, up_run")


RANKS = "bb_bandwidth_pctile, rsi_14_pctile, atr_pctile"


@query("w8_percentile_ranks", f"""WITH {BASE}, r AS (SELECT ticker, date, {_rank('bb_bandwidth', 126)} AS bb_bandwidth_pctile,
  {_rank('round(rsi_14, 9)', 252)} AS rsi_14_pctile, {_rank('round(atr_14, 9)', 252)} AS atr_pctile FROM i3) {_ordered('r', RANKS)}""")
def w8_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.with_recursions(T.bollinger(bars(spark, sf_dir))), RANKS)


@query("w11_divergence", f"""WITH {BASE}, {SWINGS}, d AS (SELECT ticker, date, rn, swing_low_m3_conf AS lp, lag(CASE WHEN swing_low_m3 IS NOT NULL THEN rsi_14
  END, 3) OVER {W} AS lr,
  swing_high_m3_conf AS hp, lag(CASE WHEN swing_high_m3 IS NOT NULL THEN rsi_14 END, 3) OVER {W} AS hr FROM s1),
lows AS (SELECT ticker, date, lp < lag(lp) OVER {W} AND lr > lag(lr) OVER {W} AS bull FROM d WHERE lp IS NOT NULL),
highs AS (SELECT ticker, date, hp > lag(hp) OVER {W} AND hr < lag(hr) OVER {W} AS bear FROM d WHERE hp IS NOT NULL)
SELECT d.ticker, d.date, (coalesce(bull, false)::INT - coalesce(bear, false)::INT)::DOUBLE AS rsi_divergence FROM d LEFT JOIN lows USING (ticker, date) LEFT
  JOIN highs USING (ticker, date)""")
def w11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.momentum(T.with_recursions(T.swings(bars(spark, sf_dir)))), "rsi_divergence")


VOL = "atr_normalized, true_range_in_atr, atr_slope"


@query("w13_volatility", f"""WITH {BASE}, v AS (SELECT ticker, date, atr_14 / close AS atr_normalized, true_range / nullif(atr_14, 0) AS true_range_in_atr,
  (atr_14 - lag(atr_14, 20) OVER {W}) / nullif(lag(atr_14, 20) OVER {W}, 0) AS atr_slope FROM i3) {_ordered('v', VOL)}""")
def w13_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.volatility(T.with_recursions(bars(spark, sf_dir))), VOL)


TR = "trend_stack_state, bars_since_stack_change, ma_spread, dist_to_sma20_atr, slope_sma20, dist_to_sma200_atr, slope_sma200"


def _averaged(df: DataFrame, more: T.Rolls | None = None) -> DataFrame:
    """Bars with the range's average, all moving averages and ``more`` rolling columns, from one pass."""
    return T.with_recursions(df, want=("atr_14",), rolls=T.average_rolls() | (more or {}))


@query("w9_w14_trend", f"""WITH {BASE}, {SWINGS}, {TREND}, t1 AS (SELECT *, lag(trend_stack_state) OVER {W} AS before FROM t0),
t2 AS (SELECT ticker, date, trend_stack_state, CASE WHEN trend_stack_state IS NOT NULL
  THEN {_since('trend_stack_state IS NOT NULL AND trend_stack_state IS DISTINCT FROM before')} END AS bars_since_stack_change,
  (sma_50 - sma_200) / close AS ma_spread, (close - sma_20) / nullif(atr_14, 0) AS dist_to_sma20_atr, (sma_20 - lag(sma_20, 20)
  OVER {W}) / close AS slope_sma20,
  (close - sma_200) / nullif(atr_14, 0) AS dist_to_sma200_atr, (sma_200 - lag(sma_200, 20) OVER {W}) / close AS slope_sma200 FROM t1) {_ordered('t2', TR)}""")
def w14_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.trend(_averaged(bars(spark, sf_dir))), TR)


ZO = "zone_50_upper, zone_50_lower, in_zone_50, touch_50, bars_since_touch_50, in_zone_200, touch_200"


@query("w15_zones", f"""WITH {BASE}, {SWINGS}, {TREND}, z AS (SELECT *, sma_50 + 0.5 * atr_14 AS zone_50_upper, sma_50 - 0.5 * atr_14 AS zone_50_lower,
  sma_200 + 0.5 * atr_14 AS far_upper, sma_200 - 0.5 * atr_14 AS far_lower FROM t0),
z1 AS (SELECT *, coalesce(low <= zone_50_upper AND high >= zone_50_lower, false)::INT AS in_zone_50, coalesce(low <= far_upper AND high >= far_lower,
  false)::INT AS in_zone_200 FROM z),
z2 AS (SELECT *, CASE WHEN in_zone_50 = 1 AND trend_stack_state >= 1 THEN 1 WHEN in_zone_50 = 1 AND trend_stack_state <= -1 THEN -1 ELSE 0 END AS touch_50,
  CASE WHEN in_zone_200 = 1 AND trend_stack_state >= 1 THEN 1 WHEN in_zone_200 = 1 AND trend_stack_state <= -1 THEN -1 ELSE 0 END AS touch_200 FROM z1),
z3 AS (SELECT *, {_since('touch_50 <> 0')} AS bars_since_touch_50 FROM z2) {_ordered('z3', ZO)}""")
def w15_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.zones(T.trend(_averaged(bars(spark, sf_dir)))), ZO)


RE = "swing_reclaim, reclaim_penetration_atr, bars_since_reclaim, trend_aligned_reclaim"
_FRESH = "CASE WHEN {since} + 3 <= 60 THEN last_value({x} IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END"


@query("w16_reclaims", f"""WITH {BASE}, {SWINGS}, {TREND}, r0 AS (SELECT *,
  {_FRESH.format(since=_since('swing_low_m3_conf IS NOT NULL'), x='swing_low_m3_conf')} AS lo,
  {_FRESH.format(since=_since('swing_high_m3_conf IS NOT NULL'), x='swing_high_m3_conf')} AS hi,
  {_roll('min', 'low', 5)} AS lo5, {_roll('max', 'high', 5)} AS hi5 FROM t0),
r1 AS (SELECT *, (lo - lo5) / nullif(atr_14, 0) AS down, (hi5 - hi) / nullif(atr_14, 0) AS up FROM r0),
r2 AS (SELECT *, CASE WHEN up BETWEEN 0.1 AND 1.5 AND close < hi AND c1 < hi AND c2 >= hi THEN -1 WHEN down BETWEEN 0.1 AND 1.5 AND close > lo AND c1 > lo
  AND c2 <= lo THEN 1 ELSE 0 END AS swing_reclaim FROM r1),
r3 AS (SELECT ticker, date, swing_reclaim, CASE swing_reclaim WHEN 1 THEN down WHEN -1 THEN up ELSE 0 END AS reclaim_penetration_atr,
  {_since('swing_reclaim <> 0')} AS bars_since_reclaim,
  CASE WHEN swing_reclaim = 1 AND trend_stack_state >= 1 THEN 1 WHEN swing_reclaim = -1 AND trend_stack_state <= -1 THEN -1 ELSE 0
  END AS trend_aligned_reclaim FROM r2) {_ordered('r3', RE)}""")
def w16_reclaims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.reclaims(T.trend(_averaged(T.swings(bars(spark, sf_dir)), T.reach_rolls()))), RE)


BR = "range_breakout, squeeze_intensity, squeeze_duration, breakout_strength_atr, bars_since_breakout"
_ESC = " + ".join(f"coalesce(lag(close, {d}) OVER {W} > ehi OR lag(close, {d}) OVER {W} < elo, false)::INT" for d in range(1, 11))


@query("w17_breakouts", f"""WITH {BASE}, {PCTL}, b0 AS (SELECT *, {_roll('max', 'high', 20, 1)} AS hi, {_roll('min', 'low', 20, 1)} AS lo,
  {_roll('max', 'high', 10, 11)} AS ehi, {_roll('min', 'low', 10, 11)} AS elo,
  lag(atr_14) OVER {W} AS atr1, lag(bb_bandwidth) OVER {W} AS bw1, lag(bb_bandwidth_pctile) OVER {W} AS bp1 FROM p0),
b1 AS (SELECT *, (coalesce(bp1 <= 0.2, false) OR coalesce((hi - lo) / nullif(atr1, 0) < 4, false)) AND ({_ESC}) <= 2 AND hi IS NOT NULL
  AND ehi IS NOT NULL AS compressed,
  coalesce(bb_bandwidth > bw1, false) OR coalesce(atr_14 > atr1, false) AS widening FROM b0),
b2 AS (SELECT *, CASE WHEN compressed AND widening AND close > hi THEN 1 WHEN compressed AND widening AND close < lo THEN -1 ELSE 0 END AS range_breakout
  FROM b1),
b3 AS (SELECT ticker, date, range_breakout, 1 - bb_bandwidth_pctile AS squeeze_intensity, rn - coalesce(last_value(CASE WHEN NOT compressed THEN rn
  END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS squeeze_duration,
  CASE WHEN close > hi THEN (close - hi) / nullif(atr_14, 0) WHEN close < lo THEN (close - lo) / nullif(atr_14, 0) ELSE 0 END AS breakout_strength_atr,
  {_since('range_breakout <> 0')} AS bars_since_breakout FROM b2) {_ordered('b3', BR)}""")
def w17_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.breakouts(T.with_recursions(T.bollinger(bars(spark, sf_dir)))), BR)


FWD = "fwd_1, fwd_2, fwd_3, fwd_5, fwd_10, terminal_return_5, terminal_return_10, terminal_return_21"
_LEAD = ", ".join([*(f"lead(close, {h}) OVER {W} / nullif(close, 0) - 1 AS fwd_{h}" for h in (1, 2, 3, 5, 10)), *(f"lead(close, {h}) OVER {W} / nullif(close, 0) - 1 AS terminal_return_{h}" for h in (5, 10, 21))])


@query("w20_w21_forward_returns", f"WITH {BARS}, f AS (SELECT ticker, date, {_LEAD} FROM bars) {_ordered('f', FWD)}")
def w20_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pick(T.forward_returns(T.forward_returns(bars(spark, sf_dir)), (5, 10, 21), "terminal_return"), FWD)


def _label_sql() -> str:
    hit = {
        "long": "CASE WHEN low_{d} <= close - atr_14 THEN 'stop' WHEN high_{d} >= close + 1.5 * atr_14 THEN 'profit' END",
        "short": "CASE WHEN high_{d} >= close + atr_14 THEN 'stop' WHEN low_{d} <= close - 1.5 * atr_14 THEN 'profit' END",
    }
    leads = ", ".join(f"lead({c}, {d}) OVER {W} AS {c}_{d}" for d in range(1, 11) for c in ("high", "low", "close"))
    hits = ", ".join(f"{hit[s].format(d=d)} AS {s}_{d}" for s in hit for d in range(1, 11))
    parts = []
    for s, sign in (("long", 1), ("short", -1)):
        first = "CASE " + " ".join(f"WHEN {s}_{d} IS NOT NULL THEN {d}" for d in range(1, 11)) + " WHEN close_10 IS NOT NULL THEN 10 END"
        kind = "coalesce(" + ", ".join(f"{s}_{d}" for d in range(1, 11)) + ", CASE WHEN close_10 IS NOT NULL THEN 'timeout' END)"
        at = "CASE " + first + " " + " ".join(f"WHEN {d} THEN close_{d}" for d in range(1, 11)) + " END"
        parts.append(f"{kind} AS label_{s}_barrier, {first} AS label_{s}_bars_to_outcome, {sign} * ({at} / nullif(close, 0) - 1) AS label_{s}_outcome_return")
    return f"h0 AS (SELECT *, {leads} FROM i3), h1 AS (SELECT *, {hits} FROM h0), h2 AS (SELECT *, {', '.join(parts)} FROM h1)"


LABEL = ", ".join(f"label_{s}{x}" for s in ("long", "short") for x in ("", "_bars_to_outcome", "_outcome_return"))
_L01 = ", ".join(f"CASE label_{s}_barrier WHEN 'profit' THEN 1 WHEN 'stop' THEN 0 WHEN 'timeout' THEN (label_{s}_outcome_return > 0)::INT END AS label_{s}" for s in ("long", "short"))
LABELS = f"{_label_sql()}, h3 AS (SELECT *, {_L01} FROM h2)"


@query("w22_barrier_labels", f"WITH {BASE}, {LABELS} SELECT ticker, date, label_long_barrier, label_short_barrier, " + ", ".join(f"round(({c})::DOUBLE, 6) AS {c}" for c in LABEL.split(", ")) + """
  FROM h3""")
def w22_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.barrier_labels(T.with_recursions(bars(spark, sf_dir), want=("atr_14",)))
    return out.select("ticker", "date", "label_long_barrier", "label_short_barrier", *[F.round(c, 6).alias(c) for c in LABEL.split(", ")])


@query("w23_validity", f"""WITH {BASE}, {LABELS} SELECT ticker, count(*) AS n, count(*) FILTER (WHERE rn <= 266) AS n_warmup, count(*)
  FILTER (WHERE label_long IS NOT NULL AND label_short IS NOT NULL) AS n_labelable,
  count(*) FILTER (WHERE rn > 266 AND label_long IS NOT NULL AND label_short IS NOT NULL) AS n_valid FROM h3 GROUP BY 1""")
def w23_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.validity(T.barrier_labels(T.with_recursions(bars(spark, sf_dir), want=("atr_14",))))
    return out.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if("is_warmup").alias("n_warmup"), F.count_if("is_labelable").alias("n_labelable"), F.count_if("is_valid").alias("n_valid"))


LADDER = f"""{BARS}, w AS (SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week, max(high) AS high, min(low) AS low, arg_max(close,
  date) AS close FROM bars GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY week DESC) AS n, lag(close) OVER (PARTITION BY ticker ORDER BY week) AS pc, first_value(close)
  OVER (PARTITION BY ticker ORDER BY week DESC) AS spot, count(*) OVER (PARTITION BY ticker) AS c FROM w),
t AS (SELECT ticker, any_value(spot) AS spot, list(greatest(high - low, abs(high - pc), abs(low - pc)) ORDER BY week) FILTER (WHERE n BETWEEN 2 AND 15
  AND n < least(c, 16)) AS tr FROM n WHERE c >= 8 GROUP BY 1),
s AS (SELECT ticker, spot, tr, len(tr) AS p, CAST(ceil(len(tr) / 2.0) AS INTEGER) AS h FROM t),
a AS (SELECT ticker, spot, list_reduce(list_concat([list_sum(tr[1:h]) / h], tr[h + 1:]), lambda x, y: (x * (p - 1) + y) / p) AS a FROM s)"""


@query("w25_weekly_ladder", f"WITH {LADDER} SELECT ticker, round(spot, 8) AS spot, " + ", ".join(f"round(floor(({x}) * 100 + 0.5) / 100, 6) AS {c}" for c, x in (("atr_w", "a"), ("up05", "spot + 0.5 * a"), ("up1", "spot + a"), ("up2", "spot + 2 * a"), ("dn05", "spot - 0.5 * a"), ("dn1", "spot - a"), ("dn2", "spot - 2 * a"))) + """
  FROM a""")
def w25_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    weeks = B.weekly(bars(spark, sf_dir))
    spots = weeks.groupBy("ticker").agg(F.max_by("close", "date").alias("spot"))
    return rounded(T.weekly_atr_ladder(weeks, spots), 8)
