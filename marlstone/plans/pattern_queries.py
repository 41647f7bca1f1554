"""Queries over whole matrices and chart patterns, with their SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, evaluation
from ..operators import technicals as T
from .adapters import bars
from .registry import query, rounded
from .technical_queries import _ESC, _FRESH, _L01, BASE, PCTL, SWINGS, TREND, W, _label_sql, _rank, _roll, _since

RUN = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

# --- the whole matrix ----------------------------------------------------------------------------------------------

_P0 = f"""p0 AS (SELECT *, {_rank('bb_bandwidth', 126)} AS bb_bandwidth_pctile, {_rank('round(rsi_14, 9)', 252)} AS rsi_14_pctile,
  {_rank('round(atr_14, 9)', 252)} AS atr_pctile FROM i3)"""
_DIVERGENCE = f"""v0 AS (SELECT *, CASE WHEN swing_low_m3_conf IS NOT NULL THEN rn END AS lrn, CASE WHEN swing_high_m3_conf IS NOT NULL THEN rn END AS hrn,
  lag(CASE WHEN swing_low_m3 IS NOT NULL THEN rsi_14 END, 3) OVER {W} AS lr, lag(CASE WHEN swing_high_m3 IS NOT NULL THEN rsi_14 END, 3) OVER {W} AS hr
  FROM t0),
vl AS (SELECT ticker, rn, swing_low_m3_conf < lag(swing_low_m3_conf) OVER {W} AND lr > lag(lr) OVER {W} AS bull FROM v0 WHERE lrn IS NOT NULL),
vh AS (SELECT ticker, rn, swing_high_m3_conf > lag(swing_high_m3_conf) OVER {W} AND hr < lag(hr) OVER {W} AS bear FROM v0 WHERE hrn IS NOT NULL),
v1 AS (SELECT v0.*, coalesce(bull, false)::INT - coalesce(bear, false)::INT AS rsi_divergence FROM v0 LEFT JOIN vl USING (ticker, rn) LEFT JOIN vh
  USING (ticker, rn))"""
_BLOCKS = f"""x0 AS (SELECT *, lag(trend_stack_state) OVER {W} AS state1, lag(atr_14, 20) OVER {W} AS atr20, lag(atr_14) OVER {W} AS atr1, lag(bb_bandwidth)
  OVER {W} AS bw1, lag(bb_bandwidth_pctile) OVER {W} AS bp1,
  {', '.join(f'lag(sma_{p}, 20) OVER {W} AS sma_{p}_20' for p in (20, 50, 100, 200))},
  {', '.join(f'sma_{p} {s} 0.5 * atr_14 AS zone_{p}_{n}' for p in (50, 200) for s, n in (('+', 'upper'), ('-', 'lower')))},
  {_FRESH.format(since=_since('swing_low_m3_conf IS NOT NULL'), x='swing_low_m3_conf')} AS lo,
  {_FRESH.format(since=_since('swing_high_m3_conf IS NOT NULL'), x='swing_high_m3_conf')} AS hi,
  {_roll('min', 'low', 5)} AS lo5, {_roll('max', 'high', 5)} AS hi5, {_roll('max', 'high', 20, 1)} AS rhi, {_roll('min', 'low', 20, 1)} AS rlo,
  {_roll('max', 'high', 10, 11)} AS ehi, {_roll('min', 'low', 10, 11)} AS elo FROM v1),
x1 AS (SELECT *, {', '.join(f'coalesce(low <= zone_{p}_upper AND high >= zone_{p}_lower, false) AS in_zone_{p}' for p in (50, 200))},
  (lo - lo5) / nullif(atr_14, 0) AS down, (hi5 - hi) / nullif(atr_14, 0) AS up,
  (coalesce(bp1 <= 0.2, false) OR coalesce((rhi - rlo) / nullif(atr1, 0) < 4, false)) AND ({_ESC}) <= 2 AND rhi IS NOT NULL AND ehi IS NOT NULL AS compressed,
  coalesce(bb_bandwidth > bw1, false) OR coalesce(atr_14 > atr1, false) AS widening FROM x0),
x2 AS (SELECT *,
  {', '.join(f'CASE WHEN in_zone_{p} AND trend_stack_state >= 1 THEN 1 WHEN in_zone_{p} AND trend_stack_state <= -1 THEN -1 ELSE 0 END AS touch_{p}' for p in (50, 200))},
  CASE WHEN up BETWEEN 0.1 AND 1.5 AND close < hi AND c1 < hi AND c2 >= hi THEN -1 WHEN down BETWEEN 0.1 AND 1.5 AND close > lo AND c1 > lo AND c2 <= lo
  THEN 1 ELSE 0 END AS swing_reclaim,
  CASE WHEN compressed AND widening AND close > rhi THEN 1 WHEN compressed AND widening AND close < rlo THEN -1 ELSE 0 END AS range_breakout FROM x1),
x3 AS (SELECT *, CASE WHEN trend_stack_state IS NOT NULL THEN {_since('trend_stack_state IS NOT NULL AND trend_stack_state IS DISTINCT FROM state1')}
  END AS bars_since_stack_change, (sma_50 - sma_200) / close AS ma_spread,
  {', '.join(f'(close - sma_{p}) / nullif(atr_14, 0) AS dist_to_sma{p}_atr, (sma_{p} - sma_{p}_20) / close AS slope_sma{p}' for p in (20, 50, 100, 200))},
  atr_14 / close AS atr_normalized, true_range / nullif(atr_14, 0) AS true_range_in_atr, (atr_14 - atr20) / nullif(atr20, 0) AS atr_slope,
  {', '.join(f"{_since(f'touch_{p} <> 0')} AS bars_since_touch_{p}" for p in (50, 200))},
  CASE swing_reclaim WHEN 1 THEN down WHEN -1 THEN up ELSE 0 END AS reclaim_penetration_atr, {_since('swing_reclaim <> 0')} AS bars_since_reclaim,
  (close - last_value(CASE swing_reclaim WHEN 1 THEN lo WHEN -1 THEN hi END IGNORE NULLS) OVER {RUN}) / nullif(atr_14, 0) AS reclaim_level_dist_atr,
  CASE WHEN swing_reclaim = 1 AND trend_stack_state >= 1 THEN 1 WHEN swing_reclaim = -1 AND trend_stack_state <= -1 THEN -1 ELSE 0
  END AS trend_aligned_reclaim,
  1 - bb_bandwidth_pctile AS squeeze_intensity, rn - coalesce(last_value(CASE WHEN NOT compressed THEN rn END IGNORE NULLS) OVER {RUN},
  0) AS squeeze_duration,
  CASE WHEN close > rhi THEN (close - rhi) / nullif(atr_14, 0) WHEN close < rlo THEN (close - rlo) / nullif(atr_14, 0) ELSE 0 END AS breakout_strength_atr,
  {_since('range_breakout <> 0')} AS bars_since_breakout,
  {', '.join(f'lead(close, {h}) OVER {W} / nullif(close, 0) - 1 AS terminal_return_{h}' for h in (5, 10, 21))} FROM x2)"""
MATRIX = ",\n".join([BASE, _P0, SWINGS.replace("FROM i3", "FROM p0"), TREND, _DIVERGENCE, _BLOCKS, _label_sql().replace("FROM i3", "FROM x3"), f"""h3 AS (SELECT *,
  {_L01} FROM h2)""",
                     """matrix AS (SELECT *, rn <= 266 AS is_warmup, label_long IS NOT NULL AND label_short IS NOT NULL AS is_labelable, rn > 266
  AND label_long IS NOT NULL AND label_short IS NOT NULL AS is_valid FROM h3)"""])  # fmt: skip

_TA = (
    "atr_pctile rsi_2 rsi_7 rsi_14 rsi_14_pctile bb_bandwidth_pctile bb_percent_b bb_bandwidth rsi_divergence atr_normalized true_range_in_atr atr_slope trend_stack_state bars_since_stack_change ma_spread "
    "dist_to_sma20_atr slope_sma20 dist_to_sma50_atr slope_sma50 dist_to_sma100_atr slope_sma100 dist_to_sma200_atr slope_sma200 in_zone_50 touch_50 bars_since_touch_50 in_zone_200 touch_200 bars_since_touch_200 "
    "swing_reclaim reclaim_penetration_atr bars_since_reclaim reclaim_level_dist_atr trend_aligned_reclaim range_breakout squeeze_intensity squeeze_duration breakout_strength_atr bars_since_breakout"
).split()
_REST = [
    *"open high low close volume vwap true_range atr_14 sma_20 sma_50 sma_100 sma_200 volume_avg_20 bb_upper bb_middle bb_lower zone_50_upper zone_50_lower zone_200_upper zone_200_lower terminal_return_5 terminal_return_10 terminal_return_21".split(),
    *(f"swing_{s}_m{m}{c}" for m in (3, 5) for s in ("high", "low") for c in ("", "_conf")),
    *(f"label_{s}{x}" for s in ("long", "short") for x in ("", "_bars_to_outcome", "_outcome_return")),
]
_FLAGS = ("in_zone_50", "in_zone_200")
#: Prices have more digits than a rounding to six keeps apart.
_PRICES = [c for c in _REST if c.startswith("swing_")] + "open high low close vwap true_range".split()
_NUMBERS = ", ".join(f"round(({c})::DOUBLE, {8 if c in _PRICES else 6}) AS {c}" for c in [*_TA, *_REST] if c not in _FLAGS)


@query("w28_dataset", f"""WITH {MATRIX} SELECT ticker, date, transactions, {', '.join(_FLAGS)}, label_long_barrier, label_short_barrier, is_warmup,
  is_labelable, is_valid, {_NUMBERS} FROM matrix WHERE is_valid""")
def w28_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the whole trimmed matrix of features and labels."""
    b = bars(spark, sf_dir)
    return T.build_dataset(b, digits={c: 8 if c in _PRICES else 6 for c, t in T.build_dataset(b).dtypes if t == "double"})


_STACK = " UNION ALL ".join(f"SELECT 'ta' AS grp, '{c}' AS feature, count(*) AS n, count({c}) AS n_present, round(avg(({c})::DOUBLE), 4) AS mean FROM matrix" for c in _TA)


@query("w29_feature_groups", f"WITH {MATRIX.replace('matrix AS (', 'matrix AS MATERIALIZED (')} {_STACK}")
def w29_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and share of missing values of each feature column, with its group."""
    df = T.build_dataset(bars(spark, sf_dir), trim=False)
    named = [(g, c) for g, cs in T.feature_groups(df).items() for c in cs]
    cells = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for g, c in named])
    stacked = df.select(F.explode(cells).alias("x")).select("x.*")
    return stacked.groupBy("grp", "feature").agg(F.count("*").alias("n"), F.count("v").alias("n_present"), F.round(F.avg("v"), 4).alias("mean"))


def _sweep_sql() -> str:
    """Flags of each pair of parameters on the rows, then all pairs of pairs on the distinct combinations of flags."""
    g = T.GRID
    early = {k: max(1, min(k - 1, round(k * 0.5))) for k in g["range_bars"]}
    swings = ", ".join(f"CASE WHEN count(*) OVER c{m} = {2 * m + 1} AND {s} = {f}({s}) OVER c{m} THEN {s} END AS p{s}{m}" for m in g["swing_m"] for s, f in (("high", "max"), ("low", "min")))
    windows = ", ".join(f"c{m} AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {m} PRECEDING AND {m} FOLLOWING)" for m in g["swing_m"])
    conf = ", ".join(f"lag(p{s}{m}, {m}) OVER {W} AS {s}{m}" for m in g["swing_m"] for s in ("high", "low"))
    fresh = ", ".join(f"CASE WHEN {_since(f'{s}{m} IS NOT NULL')} + {m} <= 60 THEN last_value({s}{m} IGNORE NULLS) OVER {RUN} END AS f{s}{m}" for m in g["swing_m"] for s in ("high", "low"))
    ranges = ", ".join(f"{_roll('max', 'high', k, 1)} AS hi{k}, {_roll('min', 'low', k, 1)} AS lo{k}, {_roll('max', 'high', e, k - e + 1)} AS eh{k}, {_roll('min', 'low', e, k - e + 1)} AS el{k}" for k, e in early.items())
    dips = ", ".join(f"{_roll('min', 'low', n)} AS mn{n}, {_roll('max', 'high', n)} AS mx{n}" for n in g["breach_bars"])
    lags = ", ".join(f"lag(close, {d}) OVER {W} AS k{d}" for d in range(1, max(k - e for k, e in early.items()) + 1))
    breaks, turns = [], []
    for k, e in early.items():
        out = " + ".join(f"coalesce(k{d} > eh{k} OR k{d} < el{k}, false)::INT" for d in range(1, k - e + 1))
        breaks += [f"coalesce(({out}) <= 2 AND hi{k} IS NOT NULL AND eh{k} IS NOT NULL AND wide AND (close > hi{k} OR close < lo{k}) AND (coalesce(bp1 <= 0.2, false) OR coalesce((hi{k} - lo{k}) / nullif(atr1, 0) < {c}, false)), false)" for c in g["tightness"]]
    for m in g["swing_m"]:
        turns += [f"coalesce((flow{m} - mn{n}) / nullif(atr_14, 0) BETWEEN 0.1 AND 1.5 AND close > flow{m} AND c1 > flow{m} AND c2 <= flow{m}, false) OR coalesce((mx{n} - fhigh{m}) / nullif(atr_14, 0) BETWEEN 0.1 AND 1.5 AND close < fhigh{m} AND c1 < fhigh{m} AND c2 >= fhigh{m}, false)" for n in g["breach_bars"]]
    labels = f"{_label_sql().replace('FROM i3', 'FROM g3')}, h3 AS (SELECT *, {_L01} FROM h2)"
    lists = {c: f"[{', '.join(map(str, g[c]))}]" for c in g}
    pairs = lambda a, b, bits: f"list_transform(range(0, {len(g[a]) * len(g[b])}), lambda j: struct_pack({a} := {lists[a]}[CAST(j // {len(g[b])} AS INTEGER) + 1], {b} := {lists[b]}[CAST(j % {len(g[b])} AS INTEGER) + 1], hit := {bits}[CAST(j AS INTEGER) + 1]))"
    return f"""WITH {BASE}, {PCTL}, g0 AS (SELECT *, {swings} FROM p0 WINDOW {windows}), g1 AS (SELECT *, {conf} FROM g0),
g2 AS (SELECT *, {fresh}, {ranges}, {dips}, {lags}, lag(atr_14) OVER {W} AS atr1, lag(bb_bandwidth) OVER {W} AS bw1, lag(bb_bandwidth_pctile) OVER {W} AS bp1
  FROM g1),
g3 AS (SELECT *, coalesce(bb_bandwidth > bw1, false) OR coalesce(atr_14 > atr1, false) AS wide FROM g2), {labels},
m AS (SELECT [{', '.join(breaks)}] AS b, [{', '.join(turns)}] AS r, count(*) AS n, sum(label_long) AS lo, sum(label_short) AS sh FROM h3 WHERE rn > 266
  AND label_long IS NOT NULL AND label_short IS NOT NULL GROUP BY 1, 2),
e AS (SELECT n, lo, sh, r, unnest({pairs('range_bars', 'tightness', 'b')}) AS x FROM m), s AS (SELECT x, r, sum(n) AS n, sum(lo) AS lo, sum(sh) AS sh FROM e
  GROUP BY 1, 2), f AS (SELECT n, lo, sh, x, unnest({pairs('swing_m', 'breach_bars', 'r')}) AS y FROM s)
SELECT CAST(y.swing_m AS INTEGER) AS swing_m, CAST(y.breach_bars AS INTEGER) AS breach_bars, CAST(x.range_bars AS INTEGER) AS range_bars,
  CAST(x.tightness AS DOUBLE) AS tightness, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE x.hit), 0) AS BIGINT) AS n_breakouts,
  CAST(coalesce(sum(n) FILTER (WHERE y.hit), 0) AS BIGINT) AS n_reclaims, CAST(coalesce(sum(n) FILTER (WHERE x.hit OR y.hit), 0) AS BIGINT) AS n_events,
  round(sum(lo) FILTER (WHERE x.hit OR y.hit) / sum(n) FILTER (WHERE x.hit OR y.hit), 6) AS base_long, round(sum(sh) FILTER (WHERE x.hit OR y.hit) / sum(n)
  FILTER (WHERE x.hit OR y.hit), 6) AS base_short
FROM f GROUP BY 1, 2, 3, 4"""


@query("w30_sweep", _sweep_sql())
def w30_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event counts and base rates of all 720 configurations."""
    return rounded(T.sweep(bars(spark, sf_dir)))


# --- chart patterns ------------------------------------------------------------------------------------------------

_LEADING = BASE.index("i0 AS")


STATE = """sw AS (SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week, arg_max(close, date) AS c FROM bars GROUP BY 1, 2),
sm AS (SELECT *, CASE WHEN count(*) OVER f = 10 THEN avg(c) OVER f END AS fast, CASE WHEN count(*) OVER s = 20 THEN avg(c) OVER s END AS slow
  FROM sw WINDOW f AS (PARTITION BY ticker ORDER BY week ROWS 9 PRECEDING), s AS (PARTITION BY ticker ORDER BY week ROWS 19 PRECEDING)),
ss AS (SELECT ticker, week, lag(CASE WHEN slow IS NULL THEN NULL WHEN c > fast AND fast > slow THEN 1 WHEN c < fast AND fast < slow THEN -1 ELSE 0 END)
  OVER (PARTITION BY ticker ORDER BY week) AS htf FROM sm)"""
FIGURES: dict[str, list[str]] = {
    "p1_divergences": [],
    "p2_gaps": ["gap_atr"],
    "p3_clouds": ["slow_slope_atr"],
    "p4_false_breaks": ["overshoot_atr", "level"],
    "p5_flags": ["flag_len", "pole_move_atr"],
    "p6_squeezes": ["squeeze_pctile_prev", "squeeze_run_prev", "expansion_tr_atr"],
    "p7_p8_p9_stateful": ["level_price", "level_touches", "break_age", "touch_count", "convergence", "confluence_count", "fib_level", "reclaim_cleanliness"],
}


def _rows_sql(cte: str, found: list[tuple], figures: dict[str, tuple[str, str]] | None = None) -> str:
    """(name, long, short, strength if long, strength if short[, figures]) -> event rows."""
    parts = []
    for n, a, b, x, y, *own in found:
        for k, (side, c, v) in enumerate((("long", a, x), ("short", b, y))):
            more = "".join(f", round(({both[k]})::DOUBLE, 6) AS {name}" for name, both in (own[0] if own else figures or {}).items())
            parts.append(f"SELECT ticker, date, '{n}' AS detector, '{side}' AS side, round(coalesce(({v})::DOUBLE, 0), 6) AS strength{more} FROM {cte} WHERE {c}")
    return " UNION ALL ".join(parts)


def _stated(sql: str) -> str:
    """An event statement with the weekly trend of each event's day."""
    return f"""WITH e AS ({sql}), {BASE[: BASE.index('i0 AS')].rstrip().rstrip(',')}, {STATE} SELECT e.*, htf::DOUBLE AS htf FROM e LEFT JOIN ss
  ON ss.ticker = e.ticker AND ss.week = e.date + CAST((12 - dayofweek(e.date)) % 7 AS INTEGER)"""


def _event(name: str, family, sql: str | None = None) -> None:
    @query(name, sql and _stated(sql))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = bars(spark, sf_dir)
        stateful = family is detectors.detect_universe
        df = detectors.prepared(b, family)
        out = family(df, trend=True) if stateful else detectors.with_state(family(df), b)
        kind = ["kind"] if stateful else []
        return rounded(out.select("ticker", "date", "detector", "side", "strength", *kind, *[F.col("meta")[c].alias(c) for c in FIGURES[name]], "htf"))


def _divergence_sql() -> str:
    ctes, found = [], []
    for m in (3, 5):
        for side in ("low", "high"):
            own = f"{side}{m}"
            ctes.append(f"""{own}a AS (SELECT ticker, date, swing_{side}_m{m}_conf AS p, lag(CASE WHEN swing_{side}_m{m} IS NOT NULL THEN rsi_14 END, {m})
  OVER {W} AS r FROM s1),
{own} AS (SELECT *, lag(p) OVER {W} AS p0, lag(r) OVER {W} AS r0 FROM {own}a WHERE p IS NOT NULL)""")
    for name, m, extreme in (("rsi_div_m3", 3, ""), ("rsi_div_m5", 5, ""), ("rsi_div_m3_ext", 3, "40")):
        found.append(f"""SELECT ticker, date, '{name}' AS detector, 'long' AS side, round(coalesce(r - r0, 0), 6) AS strength FROM low{m} WHERE p < p0
  AND r - r0 > 0""" + (" AND r0 <= 40" if extreme else ""))
        found.append(f"SELECT ticker, date, '{name}', 'short', round(coalesce(r0 - r, 0), 6) FROM high{m} WHERE p > p0 AND r - r0 < 0" + (" AND r0 >= 60" if extreme else ""))
    return f"WITH {BASE}, {SWINGS}, {', '.join(ctes)} {' UNION ALL '.join(found)}"


_event("p1_divergences", detectors.divergences, _divergence_sql())

_GAPS = []
for _k in ("1.0", "1.5"):
    _GAPS += [(f"gap_go_{_k}", f"g >= {_k} AND close > open", f"g <= -{_k} AND close < open", "abs(g)", "abs(g)"), (f"gap_fade_{_k}", f"g <= -{_k} AND close > open", f"g >= {_k} AND close < open", "abs(g)", "abs(g)")]
_event("p2_gaps", detectors.gaps, f"""WITH {BASE}, g AS (SELECT *, (open - c1) / nullif(lag(atr_14) OVER {W}, 0) AS g
  FROM i3) {_rows_sql('g', _GAPS, {'gap_atr': ('g', 'g')})}""")


def _ema(x: str, span: int) -> str:
    """The closed form of the recursion that starts at the first row."""
    keep = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"CASE WHEN rn >= {span} THEN pow({keep}, rn - 1) * (first_value({x}) OVER {W} + coalesce(sum(CASE WHEN rn > 1 THEN {x} * pow({keep}, 1 - rn) * 2.0::DOUBLE / {span + 1} END) OVER {RUN}, 0)) END"


def _cloud_sql() -> str:
    spans = sorted({s for x in detectors.CLOUDS.values() for s in x})
    one, two, three, found = [], [], [], []
    for name, (a, b, c, d) in detectors.CLOUDS.items():
        one.append(f"greatest(e{a}, e{b}) AS {name}_ft, least(e{a}, e{b}) AS {name}_fb, greatest(e{c}, e{d}) AS {name}_st, least(e{c}, e{d}) AS {name}_sb, (e{c} + e{d}) / 2 AS {name}_mid")
        two.append(f"{name}_mid - lag({name}_mid) OVER {W} AS {name}_s, lag({name}_ft) OVER {W} AS {name}_ft1, lag({name}_fb) OVER {W} AS {name}_fb1, rn > {max(a, b, c, d, 14) + 2} AS {name}_warm")
        three.append(f"lag({name}_s) OVER {W} AS {name}_s1")
        bull, bear = f"close > {name}_st AND {name}_s >= 0", f"close < {name}_sb AND {name}_s <= 0"
        found.append((f"{name}_reclaim", f"{name}_warm AND c1 < {name}_fb1 AND close > {name}_ft AND {bull}", f"{name}_warm AND c1 > {name}_ft1 AND close < {name}_fb AND {bear}", f"greatest((close - {name}_ft) / nullif(atr_14, 0), 0)", f"greatest(({name}_fb - close) / nullif(atr_14, 0), 0)", {"slow_slope_atr": (f"{name}_s / nullif(atr_14, 0)",) * 2}))
        found.append((f"{name}_curl_flip", f"{name}_warm AND {name}_s1 <= 0 AND {name}_s > 0 AND close > {name}_st", f"{name}_warm AND {name}_s1 >= 0 AND {name}_s < 0 AND close < {name}_sb", f"greatest({name}_s / nullif(atr_14, 0), 0)", f"greatest(-{name}_s / nullif(atr_14, 0), 0)", {"slow_slope_atr": (f"{name}_s / nullif(atr_14, 0)",) * 2}))
    emas = ", ".join(f"{_ema('close', s)} AS e{s}" for s in spans)
    return f"""WITH {BASE}, e0 AS (SELECT *, {emas} FROM i3), e1 AS (SELECT *, {', '.join(one)} FROM e0), e2 AS (SELECT *, {', '.join(two)} FROM e1),
  e3 AS (SELECT *, {', '.join(three)} FROM e2) {_rows_sql('e3', found)}"""


_event("p3_clouds", detectors.clouds, _cloud_sql())


def _false_break_sql() -> str:
    cols, found = [], []
    for name, k in (("k20_1bar", 20), ("k55_1bar", 55)):
        cols += [f"{_roll('min', 'low', k, 1)} AS lo{k}", f"{_roll('max', 'high', k, 1)} AS hi{k}"]
        under, over = f"(lo{k} - low) / nullif(atr_14, 0)", f"(high - hi{k}) / nullif(atr_14, 0)"
        found.append((name, f"low < lo{k} AND close > lo{k} AND {under} BETWEEN 0.25 AND 1.5", f"high > hi{k} AND close < hi{k} AND {over} BETWEEN 0.25 AND 1.5", under, over, {"overshoot_atr": (under, over), "level": (f"lo{k}", f"hi{k}")}))
    cols += [f"{_roll('min', 'low', 20, 3)} AS lo", f"{_roll('max', 'high', 20, 3)} AS hi", f"{_roll('min', 'low', 3)} AS dlo", f"{_roll('max', 'high', 3)} AS dhi"]
    under, over = "(lo - dlo) / nullif(atr_14, 0)", "(dhi - hi) / nullif(atr_14, 0)"
    found.append(("k20_2bar", f"c1 < lo AND (c2 >= lo OR (c2 < lo AND c3 >= lo)) AND close > lo AND {under} BETWEEN 0.25 AND 1.5", f"c1 > hi AND (c2 <= hi OR (c2 > hi AND c3 <= hi)) AND close < hi AND {over} BETWEEN 0.25 AND 1.5", under, over, {"overshoot_atr": (under, over), "level": ("lo", "hi")}))
    return f"WITH {BASE}, f AS (SELECT *, {', '.join(cols)} FROM i3) {_rows_sql('f', found)}"


_event("p4_false_breaks", detectors.false_breaks, _false_break_sql())


def _flag_sql() -> str:
    cols, deep = ["lag(atr_14) OVER " + W + " AS atr1"], []
    for f in range(3, 11):
        e = f + 1
        cols += [f"{_roll('max', 'high', f, 1)} AS fh{f}", f"{_roll('min', 'low', f, 1)} AS fl{f}", f"{_roll('avg', 'true_range', f, 1)} AS ftr{f}", f"lag(close, {e}) OVER {W} - lag(close, {e + 5}) OVER {W} AS pm{f}", f"lag(atr_14, {e}) OVER {W} AS pa{f}"]
        cols += [f"{_roll('avg', 'true_range', 5, e)} AS ptr{f}", f"c1 - lag(close, {e}) OVER {W} AS dr{f}", f"{_roll('avg', 'volume', f, 1)} AS fv{f}", f"{_roll('avg', 'volume', 5, e)} AS pv{f}", f"lag(mp, {e}) OVER {W} AS mp{f}"]
    found, sides = [], []
    for name, (least, tight, retrace, contraction, volume) in detectors.FLAGS.items():
        longs, shorts = [], []
        for f in range(3, 11):
            span, move = f"(fh{f} - fl{f}) / nullif(atr1, 0)", f"pm{f} / nullif(pa{f}, 0)"
            common = f"{span} <= {tight} AND ftr{f} <= {contraction} * ptr{f}" + (f" AND fv{f} <= {volume} * pv{f}" if volume else "")
            up, down = (f"{move} >= {least}", f"{move} <= -{least}") if least else (f"mp{f} >= 0.9 AND {move} > 0", f"mp{f} <= 1 - 0.9::DOUBLE AND {move} < 0")
            strength = f"abs({move}) / greatest({span}, 0.25)"
            longs.append(f"CASE WHEN {common} AND {up} AND dr{f} <= 0 AND -dr{f} <= {retrace} * pm{f} AND close > fh{f} THEN {{'s': {strength}, 'len': -{f}, 'move': {move}}} END")
            shorts.append(f"CASE WHEN {common} AND {down} AND dr{f} >= 0 AND dr{f} <= {retrace} * -pm{f} AND close < fl{f} THEN {{'s': {strength}, 'len': -{f}, 'move': {move}}} END")
        sides.append(f"greatest({', '.join(longs)}) AS {name}_a, greatest({', '.join(shorts)}) AS {name}_b")
        found.append((name, f"{name}_a IS NOT NULL AND {name}_b IS NULL", f"{name}_b IS NOT NULL AND {name}_a IS NULL", f"{name}_a.s", f"{name}_b.s", {"flag_len": (f"-{name}_a.len", f"-{name}_b.len"), "pole_move_atr": (f"{name}_a.move", f"{name}_b.move")}))
    return f"""WITH {BASE}, m0 AS (SELECT *, (close - lag(close, 5) OVER {W}) / nullif(atr_14, 0) AS momentum FROM i3), m1 AS (SELECT *,
  {_rank('momentum', 252)} AS mp FROM m0),
m2 AS (SELECT *, {', '.join(cols)} FROM m1), m3 AS (SELECT ticker, date, {', '.join(sides)} FROM m2) {_rows_sql('m3', found)}"""


_event("p5_flags", detectors.flags, _flag_sql())


def _squeeze_sql() -> str:
    cols, more, last, found = [], [], [], []
    for name, (share, n, k, wide, narrow) in detectors.SQUEEZES.items():
        cols += [f"{_roll('max', 'high', k, 1)} AS {name}_hi", f"{_roll('min', 'low', k, 1)} AS {name}_lo", f"rn - coalesce(last_value(CASE WHEN NOT coalesce(bb_bandwidth_pctile <= {share}, false) THEN rn END IGNORE NULLS) OVER {RUN}, 0) AS {name}_run"]
        more.append(f"coalesce(close > {name}_hi OR close < {name}_lo, false) AS {name}_broke, lag({name}_run) OVER {W} AS {name}_run1")
        last.append(f"coalesce(lag({name}_broke) OVER {W}, false) AS {name}_broke1")
        ready = f"{name}_run1 >= {n} AND NOT {name}_broke1 AND true_range / nullif(atr_14, 0) >= {wide}" + (" AND coalesce(nr1, false)" if narrow else "")
        calm = "greatest(1 - bp1, 0)"
        found.append((name, f"{ready} AND close > {name}_hi", f"{ready} AND close < {name}_lo", f"(close - {name}_hi) / nullif(atr_14, 0) * {calm}", f"({name}_lo - close) / nullif(atr_14, 0) * {calm}", {"squeeze_pctile_prev": ("bp1", "bp1"), "squeeze_run_prev": (f"{name}_run1",) * 2, "expansion_tr_atr": ("true_range / nullif(atr_14, 0)",) * 2}))
    return f"""WITH {BASE}, {PCTL}, q0 AS (SELECT *, high - low AS span FROM p0), q1 AS (SELECT *, span <= {_roll('min', 'span', 7)} AS nr, {', '.join(cols)}
  FROM q0),
q2 AS (SELECT *, lag(bb_bandwidth_pctile) OVER {W} AS bp1, lag(nr) OVER {W} AS nr1, {', '.join(more)} FROM q1), q3 AS (SELECT *, {', '.join(last)}
  FROM q2) {_rows_sql('q3', found)}"""


_event("p6_squeezes", detectors.squeezes, _squeeze_sql())
_event("p7_p8_p9_stateful", detectors.detect_universe)


@query("p0_empty_weeks", f"""WITH {BASE[: BASE.index('i0 AS')].rstrip().rstrip(',')}, b AS (SELECT * FROM bars WHERE CAST(substr(ticker,
  2) AS INTEGER) % 2 = 0 OR month(date) NOT IN (7, 8)), w AS (SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week, arg_max(close,
  date) AS c FROM b GROUP BY 1, 2),
sp AS (SELECT ticker, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM w GROUP BY 1), d AS (SELECT sp.ticker, sp.week,
  c FROM sp LEFT JOIN w USING (ticker, week)),
m AS (SELECT *, CASE WHEN count(c) OVER f = 10 THEN avg(c) OVER f END AS fast, CASE WHEN count(c) OVER s = 20 THEN avg(c) OVER s END AS slow
  FROM d WINDOW f AS (PARTITION BY ticker ORDER BY week ROWS 9 PRECEDING), s AS (PARTITION BY ticker ORDER BY week ROWS 19 PRECEDING)),
p AS (SELECT ticker, week, lag(CASE WHEN slow IS NULL THEN NULL WHEN c > fast AND fast > slow THEN 1.0 WHEN c < fast AND fast < slow THEN -1.0 ELSE 0.0 END)
  OVER (PARTITION BY ticker ORDER BY week) AS htf FROM m)
SELECT b.ticker, b.date, coalesce(htf, 0)::DOUBLE AS htf FROM b LEFT JOIN p ON p.ticker = b.ticker
  AND p.week = b.date + CAST((12 - dayofweek(b.date)) % 7 AS INTEGER)""")
def p0_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squeezes' convention, on bars that lack two months of every year for the odd tickers."""
    b = bars(spark, sf_dir).filter((F.substring("ticker", 2, 9).cast("int") % 2 == 0) | ~F.month("date").isin(7, 8))
    return detectors.weekly_state(b, 0.0, empty_weeks=True)

# --- event sets and labels over the matrix -------------------------------------------------------------------------

_SETS = {
    "all": "true",
    "breakout_only": "range_breakout <> 0",
    "reclaim_only": "swing_reclaim <> 0",
    "strict": "range_breakout <> 0 OR swing_reclaim <> 0",
    "broad": "range_breakout <> 0 OR swing_reclaim <> 0 OR touch_50 <> 0 OR touch_200 <> 0",
}
_VALID = MATRIX.replace("matrix AS (", "matrix AS MATERIALIZED (")


@query("e6_event_subsets", f"WITH {_VALID} " + " UNION ALL ".join(f"""SELECT '{n}' AS subset, count(*) AS n, count(DISTINCT date) AS n_dates,
  count(DISTINCT ticker) AS n_tickers, round(avg(label_long), 6) AS base_long, round(avg(label_short), 6) AS base_short FROM matrix WHERE is_valid AND ({c})""" for n, c in _SETS.items()))
def e6_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.event_subsets(T.build_dataset(bars(spark, sf_dir))))


_WAYS = {"all": "range_breakout + swing_reclaim + rsi_divergence", "breakout_only": "range_breakout", "reclaim_only": "swing_reclaim", "strict": "range_breakout + swing_reclaim"}


@query("e7_directional_labels", f"WITH {_VALID} " + " UNION ALL ".join(f"""SELECT '{n}' AS subset, sign({c})::DOUBLE AS direction, count(*) AS n, round(avg(CASE
  WHEN {c} > 0 THEN label_long ELSE label_short END), 6) AS base FROM matrix WHERE is_valid AND sign({c}) <> 0 GROUP BY 1, 2""" for n, c in _WAYS.items()))
def e7_directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the direction of the signals of each event set."""
    m = T.build_dataset(bars(spark, sf_dir))
    sets = {"all": ["range_breakout", "swing_reclaim", "rsi_divergence"], "breakout_only": ["range_breakout"], "reclaim_only": ["swing_reclaim"], "strict": ["range_breakout", "swing_reclaim"]}
    return rounded(evaluation.directional_sets(m, sets).groupBy("subset", "direction").agg(F.count("*").alias("n"), F.avg("label_directional").alias("base")))
