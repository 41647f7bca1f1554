"""Queries over positions, the hit list, folds, event studies and rule grids, with SQL from the definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import js_round
from ..functions.store import written
from ..operators import bars as B
from ..operators import book, detectors, evaluation, flow, gamma, hitlist, patterns
from ..operators import technicals as T
from .adapters import ALERTS, BARS, CALENDAR, alerts, bars, calendar, raw_alerts
from .desk_queries import CELLS, DAY, STRIKES, _cells, _panel, _ranked, _snapshots, _strikes
from .flow_queries import LAST, SESSION
from .pattern_queries import STATE, _divergence_sql, _false_break_sql, _flag_sql, _squeeze_sql
from .registry import query, rounded
from .technical_queries import BASE, LABELS, LADDER, W

# --- gamma ---------------------------------------------------------------------------------------------------------

LEVELS = """c AS (SELECT *, sum(combined) OVER (PARTITION BY ticker, date ORDER BY strike ROWS UNBOUNDED PRECEDING) AS cum,
  abs(strike - spot) <= 0.05 * spot AS near FROM st),
p AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY ticker, date ORDER BY strike), 0) AS prev FROM c),
g AS (SELECT ticker, date, any_value(spot) AS spot, arg_max(strike, combined) FILTER (WHERE near AND strike > spot AND combined > 0) AS cw, arg_min(strike,
  combined) FILTER (WHERE near AND strike < spot AND combined < 0) AS pw, min(strike) FILTER (WHERE near AND prev <> 0 AND sign(prev) <> sign(cum)) AS gf
  FROM p GROUP BY 1, 2),
lv AS (SELECT ticker, date, coalesce(cw, spot) AS call_wall, coalesce(pw, spot) AS put_wall, coalesce(gf, spot) AS gamma_flip FROM g)"""


@query("k4_top_nodes", f"""WITH {STRIKES}, {LEVELS}, n AS (SELECT st.*, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(net_oi) DESC, strike) AS n
  FROM st JOIN lv USING (ticker, date) WHERE abs(strike - spot) <= 0.1 * spot AND strike NOT IN (call_wall, put_wall, gamma_flip))
SELECT ticker, date, strike, net_oi, CAST(n AS INTEGER) AS n FROM n WHERE n <= 5""")
def k4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _strikes(spark, sf_dir)
    return gamma.top_nodes(s, gamma.gex_levels(s, ["ticker", "date"]), ["ticker", "date"])


@query("k5_chart_rows", f"""WITH {STRIKES}, l AS (SELECT * FROM st WHERE abs(strike - spot) <= 0.1 * spot QUALIFY date = max(date)
  OVER (PARTITION BY ticker)), newest AS (SELECT ticker, max(date) AS date FROM st GROUP BY 1),
b AS (SELECT l.*, strike < spot AS under FROM l JOIN newest USING (ticker, date)), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, under
  ORDER BY abs(strike - spot), strike) AS n, count(*) FILTER (WHERE under) OVER (PARTITION BY ticker) AS nb, count(*) FILTER (WHERE NOT under)
  OVER (PARTITION BY ticker) AS na FROM b),
t AS (SELECT *, least(50 + greatest(0, 50 - nb), na) AS ta FROM n) SELECT ticker, date, strike, combined FROM t WHERE CASE WHEN under
  THEN n <= least(50 + greatest(0, 50 - ta), nb) ELSE n <= ta END""")
def k5_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = _strikes(spark, sf_dir).groupBy("ticker", F.col("date").alias("captured_at")).agg(F.max("spot").alias("spot"), F.collect_list(F.struct("strike", "combined")).alias("strikes"))
    return gamma.chart_rows(snaps).select("ticker", F.col("captured_at").alias("date"), "strike", "combined")


@query("a15_heatmap_view", f"""WITH {CELLS}, i AS (SELECT cells.*, CASE ticker WHEN 'U1' THEN 0.25 WHEN 'U2' THEN 0.10 WHEN 'U3' THEN 0.20 ELSE 0.15
  END AS band FROM cells SEMI JOIN ok USING (ticker)), v AS (SELECT * FROM i WHERE abs(strike - spot) <= spot * band),
s AS (SELECT DISTINCT ticker, strike, spot, strike < spot AS b FROM v), n AS (SELECT *, row_number() OVER (PARTITION BY ticker, b ORDER BY abs(strike - spot),
  strike) AS n, count(*) FILTER (WHERE b) OVER (PARTITION BY ticker) AS nb, count(*) FILTER (WHERE NOT b) OVER (PARTITION BY ticker) AS na FROM s),
t AS (SELECT *, least(25 + greatest(0, 25 - nb), na) AS ta FROM n), k AS (SELECT ticker, strike FROM t WHERE CASE WHEN b THEN n <= least(25 + greatest(0,
  25 - ta), nb) ELSE n <= ta END),
w AS (SELECT v.*, CAST(expiry - DATE '{DAY}' AS INTEGER) AS dte, count(*) OVER (PARTITION BY ticker, expiry) AS cells_n FROM v SEMI JOIN k USING (ticker,
  strike)), r AS (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY cells_n < 5, dte, expiry) AS r FROM w)
SELECT ticker, strike, expiry, dte, round(net_oi, 4) AS net_oi FROM r WHERE r <= 5""")
def a15_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = gamma.heatmap_cells(_cells(spark, sf_dir), ["ticker"])
    out = gamma.heatmap_view(cells, ["ticker"], F.lit(DAY).cast("date"), {"U1": 0.25, "U2": 0.10, "U3": 0.20})
    return rounded(out.select("ticker", "strike", "expiry", "dte", "net_oi"), 4)


# --- hit list ------------------------------------------------------------------------------------------------------


def _hit_sql(least: int = 700_000, grades: str = "'HIGH', 'MED'") -> str:
    return f"""q AS (SELECT * FROM alerts WHERE CAST(time - INTERVAL 5 HOUR AS DATE) = DATE '2024-01-16' AND side = 'BUY' AND premium >= {least}
  AND confidence IN ({grades})),
w AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, id) AS n, premium * CASE WHEN strike <= 0 THEN 1.0
  WHEN abs(strike - spot) / spot <= 0.025 THEN 1.0 WHEN (type = 'CALL' AND strike > spot) OR (type = 'PUT' AND strike < spot) THEN 1.5 ELSE 0.75 END AS wp
  FROM q),
g AS (SELECT ticker, sum(premium) AS total_premium, sum(wp) AS weighted_premium, count(*) AS n_alerts, max(CASE confidence WHEN 'HIGH' THEN 3 WHEN 'MED'
  THEN 2 ELSE 1 END) AS grade,
  CASE WHEN count(*) FILTER (WHERE sentiment = 'BEARISH') > count(*) FILTER (WHERE sentiment = 'BULLISH') THEN 'DOWN' ELSE 'UP' END AS direction,
  arg_min(sector, n) AS sector, arg_min(strike, n) AS t_strike, arg_min(type, n) AS t_type, arg_min(expiry, n) AS t_expiry, arg_min(spot, n) AS t_spot FROM w
  GROUP BY 1)"""


HIT = _hit_sql()


@query("h1_ticker_totals", f"""WITH {ALERTS}, {HIT} SELECT ticker, round(total_premium, 4) AS total_premium, round(weighted_premium, 4) AS weighted_premium,
  n_alerts, grade, direction FROM g""")
def h1_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    out = hitlist.by_ticker(hitlist.qualifying(alerts(spark, sf_dir), hitlist.Criteria(), day), day)
    return rounded(out.select("ticker", "total_premium", "weighted_premium", "n_alerts", "grade", "direction"), 4)


@query("f15_criteria", f"""WITH {ALERTS} SELECT id, ticker FROM alerts WHERE CAST(time - INTERVAL 5 HOUR AS DATE) = DATE '2024-01-16' AND side = 'BUY'
  AND premium >= 250000 AND confidence = 'HIGH' AND exec IN ('SWEEP', 'BLOCK') AND sector NOT IN ('sector1', 'sector2')""")
def f15_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = hitlist.Criteria(min_premium=250_000.0, confidence="HIGH", executions=("SWEEP", "BLOCK"), exclude_sectors=("sector1", "sector2"))
    return hitlist.qualifying(alerts(spark, sf_dir), wanted, F.lit(DAY).cast("date")).select("id", "ticker")


def _persistence_sql(least: int) -> str:
    return f"""pf AS (SELECT ticker, CAST(time - INTERVAL 5 HOUR AS DATE) AS d FROM alerts WHERE CAST(time - INTERVAL 5 HOUR AS DATE) >= DATE '2024-01-07'
  AND CAST(time - INTERVAL 5 HOUR AS DATE) < DATE '2024-01-16' GROUP BY 1, 2 HAVING sum(premium) >= {least}
  UNION SELECT ticker, date FROM days WHERE date >= DATE '2024-01-07' AND date < DATE '2024-01-16' AND 20 * (ca + cb + pa + pb) >= 5000
  AND ((ca + cb) / nullif(pa + pb, 0) >= 2 OR (ca + cb) / nullif(pa + pb, 0) <= 0.5)),
persist AS (SELECT ticker, least(count(*), 5) AS days FROM pf GROUP BY 1)"""


@query("h4_persistence", f"WITH {LAST}, {_persistence_sql(300_000)} SELECT ticker, CAST(days AS BIGINT) AS days FROM persist")
def h4_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hitlist.persistence(alerts(spark, sf_dir), _snapshots(spark, sf_dir), F.lit(DAY).cast("date"), 300_000.0)


_MONEY = "CASE WHEN total_premium >= 1e9 THEN printf('$%.1fB', total_premium / 1e9) WHEN total_premium >= 1e6 THEN printf('$%.1fM', total_premium / 1e6) WHEN total_premium >= 1e3 THEN printf('$%.0fK', total_premium / 1e3) ELSE printf('$%.0f', total_premium) END"


def _weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of the hits' tickers: those of the suppliers of the same number."""
    return B.weekly(bars(spark, sf_dir)).withColumn("ticker", F.concat(F.lit("U"), F.substring("ticker", 2, 9)))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two days of quotes of every contract that was traded; some without a bid, some without any price."""
    from ..functions.market import option_symbol

    occ = option_symbol(F.col("ticker"), F.col("expiry"), F.col("type"), F.col("strike"))
    c = alerts(spark, sf_dir).groupBy(occ.alias("occ")).agg(F.max("id").alias("n"))
    day = F.explode(F.sequence(F.lit(0), F.lit(1)))
    bid = F.when(F.col("n") % 3 > 0, F.col("n") % 50 + F.col("d") + 0.25).otherwise(0.0)
    last = F.when(F.col("n") % 4 > 0, F.col("n") % 50 + 0.125).otherwise(0.0)
    return c.withColumn("d", day).select("occ", F.date_add(F.lit("2024-01-15").cast("date"), F.col("d")).alias("date"), bid.alias("bid"), (F.col("n") % 50 + F.col("d") + 0.5).alias("ask"), last.alias("last"))


_TARGETS = ", ".join(f"floor(({x}) * 100 + 0.5) / 100 AS {c}" for c, x in (("atr_w", "a"), ("up05", "t_spot + 0.5 * a"), ("up1", "t_spot + a"), ("up2", "t_spot + 2 * a"), ("dn05", "t_spot - 0.5 * a"), ("dn1", "t_spot - a"), ("dn2", "t_spot - 2 * a")))


@query("h1_hit_list", f"""WITH {LAST}, {HIT}, {_persistence_sql(700_000)},
ld AS (WITH {LADDER} SELECT 'U' || substr(ticker, 2) AS ticker, a FROM a),
qt AS (
  SELECT ticker || strftime(expiry, '%y%m%d') || left(type, 1) || lpad(CAST(CAST(floor(strike * 1000 + 0.5) AS BIGINT) AS VARCHAR), 8, '0') AS occ,
  max(id) AS n FROM alerts GROUP BY 1
), mk AS (SELECT occ, CASE WHEN n % 3 > 0 THEN (n % 50 + 1.25 + n % 50 + 1.5) / 2 WHEN n % 4 > 0 THEN n % 50 + 0.125 END::DOUBLE AS mark FROM qt),
pk AS (SELECT w.ticker, strike, type, expiry FROM w JOIN g USING (ticker) WHERE n <= 5 AND expiry > DATE '{DAY}' AND expiry <= DATE '{DAY}' + 92
  QUALIFY row_number() OVER (PARTITION BY w.ticker ORDER BY type = CASE direction WHEN 'UP' THEN 'CALL' ELSE 'PUT' END DESC, wp DESC, n) = 1),
rk AS (SELECT ticker, time, premium, row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, time DESC, id) AS rank FROM alerts), pr AS (SELECT ticker,
  CAST(min(rank) AS INTEGER) AS print_rank, arg_min(premium, rank) AS print_premium, CASE WHEN arg_min(time, rank) >= TIMESTAMP '{DAY}' - INTERVAL 19 HOUR
  THEN 'today' ELSE 'yesterday' END AS print_age FROM rk WHERE rank <= 200 AND time >= TIMESTAMP '{DAY}' - INTERVAL 48 HOUR GROUP BY 1),
cs AS (SELECT ticker, (ca + cb) / (pa + pb) AS cp FROM days WHERE date = (SELECT max(date) FROM days) AND 20 * (ca + cb + pa + pb) >= 5000 AND pa + pb > 0),
b AS (SELECT g.*, pk.strike, pk.type, pk.expiry, print_rank, print_age, print_premium, cp, days, coalesce(cp >= 2 OR cp <= 0.5, false) AS fires FROM g LEFT
  JOIN pk USING (ticker) LEFT JOIN pr USING (ticker) LEFT JOIN cs USING (ticker) LEFT JOIN persist USING (ticker)),
s AS (SELECT *, 40 * cume_dist() OVER (ORDER BY weighted_premium) * CASE grade WHEN 3 THEN 1.0 WHEN 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS flow, CASE WHEN fires
  THEN greatest(least(25, 25 * (CASE WHEN cp >= 2 THEN cp ELSE 1 / greatest(cp, 0.01) END - 1.5) / 4.5), 6) ELSE 0 END::DOUBLE AS sent,
  CASE WHEN print_rank <= 10 THEN 15.0 WHEN print_rank IS NOT NULL THEN 10.0 ELSE 0.0 END::DOUBLE AS print_pts, least(20, coalesce(days,
  0) * 5)::DOUBLE AS persistence_pts, fires AND CASE WHEN cp >= 1 THEN 'UP' ELSE 'DOWN' END = direction AS agree FROM b),
t AS (SELECT *, (flow + sent + print_pts + persistence_pts) * CASE WHEN agree THEN 1.1 ELSE 1.0 END::DOUBLE AS points, row_number() OVER (PARTITION BY sector
  ORDER BY total_premium DESC, ticker) AS sn, count(*) OVER (PARTITION BY sector) AS sc FROM s),
th AS (SELECT sector, string_agg(ticker, ',' ORDER BY sn) FILTER (WHERE sn <= 6) AS theme_tickers FROM t GROUP BY 1), r AS (SELECT *, row_number()
  OVER (ORDER BY points DESC, total_premium DESC, ticker) AS rank FROM t)
SELECT CAST(rank AS INTEGER) AS rank, ticker, direction, floor(flow * 10 + 0.5) / 10 AS flow_pts, floor(sent * 10 + 0.5) / 10 AS sentiment_pts, print_pts,
  persistence_pts, agree, floor(points * 10 + 0.5) / 10 AS total,
  '$' || regexp_replace(printf('%.4f', coalesce(strike, t_strike)), '\\.?0+$', '') || left(coalesce(type, t_type), 1) || ' ' || strftime(coalesce(expiry,
  t_expiry), '%b %-d') AS contract,
  ticker || strftime(expiry, '%y%m%d') || left(type, 1) || lpad(CAST(CAST(floor(strike * 1000 + 0.5) AS BIGINT) AS VARCHAR), 8, '0') AS contract_occ,
  CAST(least(3, CASE WHEN sn <= 6 THEN least(sc, 6) - 1 ELSE 6 END) AS INTEGER) AS n_peers, theme_tickers,
  ticker || ': ' || {_MONEY} || ' bought in ' || n_alerts || CASE WHEN n_alerts = 1 THEN ' alert' ELSE ' alerts' END || ', ' || CASE direction WHEN 'UP'
  THEN 'bullish' ELSE 'bearish' END || CASE WHEN agree THEN ', chain sentiment agrees' ELSE '' END ||
  CASE WHEN print_rank IS NOT NULL THEN ', ranked print #' || print_rank ELSE '' END || CASE WHEN coalesce(days, 0) > 0
  THEN ', seen on ' || days || ' prior days' ELSE '' END AS thesis,
  print_rank, print_age, round(print_premium, 6) AS print_premium, {_TARGETS}, round(mark, 4) AS entry_price, round(mark, 4) AS last_price
FROM r JOIN th USING (sector) LEFT JOIN ld USING (ticker)
LEFT JOIN mk ON mk.occ = r.ticker || strftime(r.expiry, '%y%m%d') || left(r.type, 1) || lpad(CAST(CAST(floor(r.strike * 1000 + 0.5) AS BIGINT) AS VARCHAR), 8,
  '0')
WHERE rank <= 10""")
def h1_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hitlist.hit_list(alerts(spark, sf_dir), _ranked(spark, sf_dir), _snapshots(spark, sf_dir), hitlist.Criteria(), F.lit(DAY).cast("date"), _weeks(spark, sf_dir), _quotes(spark, sf_dir))
    return rounded(out).select("rank", "ticker", "direction", "flow_pts", "sentiment_pts", "print_pts", "persistence_pts", "agree", "total", "contract", "contract_occ", F.size("peers").alias("n_peers"), F.array_join("theme_tickers", ",").alias("theme_tickers"), "thesis", "print_rank", "print_age", "print_premium", "atr_w", "up05", "up1", "up2", "dn05", "dn1", "dn2", "entry_price", "last_price")


@query("a9_session_meta", f"""WITH {ALERTS}, {HIT}, l AS (SELECT sector, sum(total_premium) AS p FROM g GROUP BY 1) SELECT round(sum(total_premium),
  4) AS total, round(coalesce(sum(total_premium) FILTER (WHERE direction = 'UP'), 0), 4) AS up,
  round(coalesce(sum(total_premium) FILTER (WHERE direction = 'DOWN'), 0), 4) AS down, (SELECT sector FROM l ORDER BY p DESC,
  sector DESC LIMIT 1) AS lead_sector FROM g""")
def a9_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY).cast("date")
    return rounded(hitlist.session_meta(hitlist.by_ticker(hitlist.qualifying(alerts(spark, sf_dir), hitlist.Criteria(), day), day)), 4)


@query("k11_list_of_day", f"""WITH {BARS}, h AS (SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS rank FROM bars)
  SELECT 'there' AS asked, date, ticker, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 10 AND date = DATE '2000-03-01' UNION ALL SELECT 'missing', date,
  ticker, rank FROM h WHERE rank <= 10 AND date = (SELECT max(date) FROM h)""")
def k11_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten busiest tickers of a day stand in for its hits: a day that has some, and one that hasn't."""
    from pyspark.sql import Window

    order = Window.partitionBy("date").orderBy(F.desc("volume"), "ticker")
    hits = bars(spark, sf_dir).withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("date", "ticker", "rank")
    at = lambda d: F.lit(d).cast("date")
    return hitlist.list_of_day(hits, at("2000-03-01")).withColumn("asked", F.lit("there")).unionByName(hitlist.list_of_day(hits, at("2030-01-01")).withColumn("asked", F.lit("missing")))


@query("w25_h_targets", f"""WITH {LADDER}, d AS (SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS way, spot, a
  FROM a),
tt AS (SELECT ticker, {', '.join(f'floor((spot + way * {k} * a) * 100 + 0.5) / 100 AS t{n}' for n, k in (('05', 0.5), ('1', 1), ('2', 2)))} FROM d)
  SELECT ticker, round(t05, 6) AS t05, round(t1, 6) AS t1, round(t2, 6) AS t2 FROM tt WHERE t05 > 0 AND t1 > 0 AND t2 > 0""")
def w25_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets up for the even tickers, and down for the odd ones."""
    weeks = B.weekly(bars(spark, sf_dir))
    ladder = T.weekly_atr_ladder(weeks, weeks.groupBy("ticker").agg(F.max_by("close", "date").alias("spot")))
    even = F.substring("ticker", 2, 9).cast("int") % 2 == 0
    return rounded(hitlist.ladder_overlay(ladder.withColumns({"direction": F.when(even, "UP").otherwise("DOWN"), "date": F.lit(DAY).cast("date")})).withColumn("t05", js_round(F.col("t05"), 2)))


# --- raw alerts ----------------------------------------------------------------------------------------------------

RAW = """rk AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, round(value * 10000, 2) AS prem FROM events WHERE event_id % 50 <> 0
  AND event_id % 41 <> 0),
rw AS (SELECT *, CASE WHEN k % 5 <> 0 THEN prem * 0.6::DOUBLE END AS ask, CASE WHEN k % 3 <> 0 THEN prem * CASE WHEN k % 4 = 1 THEN 0.7::DOUBLE
  ELSE 0.2::DOUBLE END END AS bid, k % 7 <> 0 AS occ FROM rk),
ry AS (SELECT *, CASE WHEN occ AND k % 2 = 1 THEN 'PUT' ELSE 'CALL' END AS type, CASE WHEN coalesce(ask, 0) >= coalesce(bid, 0) THEN 'BUY' ELSE 'SELL'
  END AS side, CASE WHEN occ THEN CAST(ts AS DATE) + k % 30 WHEN k % 2 = 0 THEN CAST(ts AS DATE) + 9 ELSE CAST(ts AS DATE) END AS expiry FROM rw)"""


@query("f1_normalise_alerts", f"""WITH {RAW} SELECT CAST(event_id AS VARCHAR) AS id, 'U' || user_id AS ticker, type, side, CASE
  WHEN (type = 'CALL') = (side = 'BUY') THEN 'BULLISH' ELSE 'BEARISH' END AS sentiment,
  CASE WHEN k % 4 = 0 THEN 'SWEEP' WHEN k % 6 = 0 THEN 'FLOOR' WHEN k % 9 = 0 THEN 'BLOCK' ELSE 'SINGLE' END AS exec, k % 9 = 0 AS multi_leg,
  '$' || k || '.5' || left(type, 1) || ' ' || strftime(expiry, '%b %-d') AS contract, round(k + 0.5, 2)::DOUBLE AS strike, expiry,
  CAST(k * 5 AS BIGINT) AS size, CAST(100 - k AS BIGINT) AS oi, round(prem, 2) AS premium, 100.0::DOUBLE AS spot, CASE WHEN k % 10 <> 0 THEN 'rule' || (k % 5)
  ELSE 'Unusual activity' END AS rule, CASE WHEN k >= 50 THEN 'HIGH' WHEN k >= 10 THEN 'MED' ELSE 'LOW' END AS confidence,
  CASE k % 3 WHEN 0 THEN 'Industrials' ELSE 'Technology' END AS sector, round(ask, 2) AS ask_prem, round(bid, 2) AS bid_prem, CASE WHEN k % 10 <> 9
  THEN k % 2 = 0 END AS all_opening, CASE WHEN k % 4 <> 3 THEN 'Common Stock' END AS issue_type, k % 6 = 0 AS has_floor, CASE WHEN k % 8 <> 0 THEN k % 9 <> 0
  END AS has_single_leg FROM ry""")
def f1_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alerts, normalised, with their sector resolved by name."""
    out = flow.normalise_alerts(raw_alerts(spark, sf_dir))
    none = spark.createDataFrame([], "ticker string, sector string")
    names = spark.range(1).select(F.lit("building").alias("raw"), F.lit("Industrials").alias("sector"))
    out = book.resolve_sector(out.drop("sector"), none, names)
    return out.drop("time", "raw_sector", "unresolved").withColumns({c: F.round(c, 2) for c in ("strike", "premium", "ask_prem", "bid_prem")})


@query("u2_unresolved_and_funds", f"""WITH {ALERTS}, r AS (SELECT ticker, count(*) AS n FROM alerts WHERE CAST(substr(ticker, 2) AS INTEGER) % 3 = 0
  GROUP BY 1 ORDER BY n DESC, ticker LIMIT 30),
f AS (SELECT ticker, issue_type = 'ETF' AS is_etf, CAST(substr(ticker, 2) AS INTEGER) % 5 = 0 AS new FROM alerts) SELECT 'unresolved' AS part, ticker, n
  FROM r UNION ALL SELECT CASE WHEN new THEN 'on' ELSE 'off' END, ticker, count(*) FROM f WHERE is_etf <> new GROUP BY 1, 2""")
def u2_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent tickers without a sector, and rows whose fund flag has to go on or off."""
    a = alerts(spark, sf_dir).withColumn("is_etf", F.col("issue_type") == "ETF")
    n = F.substring("ticker", 2, 9).cast("int")
    open_ = book.unresolved_tickers(a, a.select("ticker", (n % 3 == 0).alias("unresolved")).distinct()).select(F.lit("unresolved").alias("part"), "ticker", F.col("n_rows").alias("n"))
    flips = book.etf_flips(a, a.filter(n % 5 == 0).select("ticker"))
    return open_.unionByName(flips.groupBy(F.when(F.col("new_is_etf"), "on").otherwise("off").alias("part"), "ticker").agg(F.count("*").alias("n")))


# --- folds and event studies ---------------------------------------------------------------------------------------

FOLDS = """d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), o AS (SELECT min(i)
  FILTER (WHERE date >= (SELECT max(date) FROM d) - INTERVAL 12 MONTH) AS oos, max(i) AS last FROM d),
fo AS (SELECT 'cv' || k AS fold, CAST(floor(oos * k / 6.0) AS INTEGER) AS lo, CAST(floor(oos * (k + 1) / 6.0) AS INTEGER) - 1 AS hi FROM o, range(1, 6) t(k)
  UNION ALL SELECT 'oos', oos, last FROM o)"""


@query("e2_fold_roles", f"""WITH {BARS}, {FOLDS}, c AS (SELECT *, lo - 10 AS n, greatest(1, CAST(round_even((lo - 10) * 0.15::DOUBLE, 0) AS INTEGER)) AS tail
  FROM fo), e AS (SELECT *, n - tail AS first, CASE WHEN n - tail - 11 < 0 THEN n - tail - 1 ELSE n - tail - 11 END AS fit_end FROM c),
r AS (SELECT fold, CASE WHEN i >= lo AND i <= hi THEN 'test' WHEN i <= fit_end THEN 'fit' WHEN i >= first AND i <= lo - 11 THEN 'calibrate' END AS role,
  bars.date FROM bars JOIN d USING (date), e) SELECT fold, role, count(*) AS n, min(date) AS first, max(date) AS last FROM r WHERE role IS NOT NULL
  GROUP BY 1, 2""")
def e2_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return evaluation.assign_folds(b, evaluation.folds(b)).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def _study(spark: SparkSession, sf_dir: str, families: list | None, window: str, least: int) -> DataFrame:
    rows = written(patterns.study_rows(bars(spark, sf_dir), families), "study-rows")  # all that a study needs of a bar
    out = rounded(evaluation.event_study_of_rows(rows, written(evaluation.folds(rows), "folds"), least, window))
    return out.withColumn("median_strength", F.round("median_strength", 4))


@query("e5_event_study")
def e5_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors' events against the barrier labels."""
    return _study(spark, sf_dir, None, "folds", 5)


def _study_sql(found: list[str], window: str, least: int) -> str:
    """The same from SQL events. Each source is a whole statement with its own CTEs."""
    inside = "h3.date <= (SELECT max(te) FROM sp)" + (" AND h3.date >= (SELECT min(ts) FROM sp)" if window == "folds" else "")
    med = lambda v, c: f"quantile_cont({v}, 0.5) FILTER (WHERE {c})"
    over = lambda a, b: f"round({a} / nullif({b}, 0), 6)"
    return f"""WITH ev AS ({' UNION ALL '.join(f'SELECT ticker, date, detector, side, strength FROM ({x})' for x in found)}), {BASE}, {LABELS}, {FOLDS},
  sp AS (SELECT fold, (SELECT date FROM d WHERE i = lo) AS ts, (SELECT date FROM d WHERE i = hi) AS te FROM fo WHERE fold <> 'oos'), {STATE},
tr AS (SELECT ticker, date, lead(close, 10) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS tr10 FROM h3),
rw AS (SELECT h3.ticker, h3.date, htf, tr10, label_long, label_long_outcome_return AS ol, label_short, label_short_outcome_return AS os FROM h3 JOIN tr
  ON tr.ticker = h3.ticker AND tr.date = h3.date LEFT JOIN ss ON ss.ticker = h3.ticker AND ss.week = h3.date + CAST((12 - dayofweek(h3.date)) % 7 AS INTEGER)
  WHERE {inside}),
sd AS (SELECT ticker, date, tr10, 'long' AS side, label_long AS label, ol AS outcome, label_short AS other, os AS other_outcome, coalesce(htf = 1,
  false) AS wt, coalesce(htf = -1, false) AS ag FROM rw UNION ALL SELECT ticker, date, tr10, 'short', label_short, os, label_long, ol, coalesce(htf = -1,
  false), coalesce(htf = 1, false) FROM rw),
bs AS (SELECT side, avg(label) AS base, avg(label) FILTER (WHERE wt) AS base_htf, avg(other) AS base_other, count(label) AS n_rows FROM sd GROUP BY 1),
  hi AS (SELECT ev.detector, ev.strength, sd.* FROM ev JOIN sd USING (ticker, date, side) WHERE label IS NOT NULL),
mn AS (SELECT detector, side, count(*) AS n, avg(label) AS hit_rate, quantile_cont(outcome, 0.5) AS median_outcome, quantile_cont(strength,
  0.5) AS median_strength, count(*) FILTER (WHERE wt) AS n_htf, avg(label) FILTER (WHERE wt) AS hit_rate_htf, {med('outcome', 'wt')} AS median_outcome_htf,
  count(*) FILTER (WHERE ag) AS n_opposed, avg(label) FILTER (WHERE ag) AS hit_rate_opposed, avg(other) FILTER (WHERE ag) AS hit_rate_trend,
  {med('outcome', 'ag')} AS median_outcome_opposed, {med('other_outcome', 'ag')} AS median_outcome_trend,
  {med('tr10', 'true')} AS median_terminal_return_10, {med('tr10', 'wt')} AS median_terminal_return_10_htf,
  {med('tr10', 'ag')} AS median_terminal_return_10_opposed FROM hi GROUP BY 1, 2),
fb AS (SELECT fold, side, avg(label) AS b FROM sd JOIN sp ON date BETWEEN ts AND te GROUP BY 1, 2), pf AS (SELECT fold, detector, side, avg(label) AS r
  FROM hi JOIN sp ON date BETWEEN ts AND te GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
lf AS (SELECT detector, side, count(r / nullif(b, 0)) AS n_folds, min(r / nullif(b, 0)) AS min_lift, max(r / nullif(b, 0)) AS max_lift FROM pf JOIN fb
  USING (fold, side) GROUP BY 1, 2)
SELECT detector, side, n, round(median_strength, 4) AS median_strength,
  {', '.join(f'round({c}, 6) AS {c}' for c in 'hit_rate median_outcome hit_rate_htf median_outcome_htf hit_rate_opposed hit_rate_trend median_outcome_opposed median_outcome_trend median_terminal_return_10 median_terminal_return_10_htf median_terminal_return_10_opposed base base_htf min_lift max_lift'.split())},
  n_htf, n_opposed, n_folds,
  {over('hit_rate', 'base')} AS lift, {over('hit_rate_htf', 'base')} AS lift_htf, {over('hit_rate_htf', 'base_htf')} AS lift_htf_base,
  {over('hit_rate_opposed', 'base')} AS lift_opposed, {over('hit_rate_trend', 'base_other')} AS lift_trend, round(n * 1000.0::DOUBLE / greatest(n_rows, 1),
  6) AS events_per_1k
FROM mn JOIN bs USING (side) LEFT JOIN lf USING (detector, side)"""


@query("e5_false_breaks_study", _study_sql([_false_break_sql(), _flag_sql()], "history", 5))
def e5_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False breaks and flags over all history up to the last fold."""
    return _study(spark, sf_dir, [detectors.false_breaks, detectors.flags], "history", 5)


@query("e5_divergence_study", _study_sql([_divergence_sql(), _squeeze_sql()], "folds", 10))
def e5_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences and squeezes over the folds' test parts."""
    return _study(spark, sf_dir, [detectors.divergences, detectors.squeezes], "folds", 10)


@query("e11_between_within", f"""WITH {LAST.split(', i AS')[0]}, s AS (SELECT ticker, date, sum("cA" + "cB") AS v, sum("cA" + "cB") / nullif(sum("pA" + "pB"),
  0) AS x1, sum("cP") - sum("pP") AS x2 FROM chain GROUP BY 1, 2),
f AS (SELECT *, (lead(v) OVER (PARTITION BY ticker ORDER BY date) + 1) / (v + 1) - 1 AS y1, (lead(v, 2) OVER (PARTITION BY ticker
  ORDER BY date) + 1) / (v + 1) - 1 AS y2 FROM s),
p AS ({' UNION ALL '.join(f"SELECT ticker, '{n}' AS signal, 'fwd_{h}' AS horizon, {x}::DOUBLE AS x, y{h}::DOUBLE AS y FROM f WHERE {x} IS NOT NULL AND y{h} IS NOT NULL" for n, x in (('sent_cp_ratio', 'x1'), ('sent_net_dir_prem', 'x2')) for h in (1, 2))}),
m AS (SELECT signal, horizon, ticker, avg(x) AS x, avg(y) AS y FROM p GROUP BY 1, 2, 3), mr AS (SELECT signal, horizon, rank() OVER (PARTITION BY signal,
  horizon ORDER BY x) + (count(*) OVER (PARTITION BY signal, horizon, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY signal, horizon ORDER BY y) + (count(*)
  OVER (PARTITION BY signal, horizon, y) - 1) / 2.0 AS ry FROM m),
b AS (SELECT signal, horizon, corr(rx, ry) AS between_ FROM mr GROUP BY 1, 2), dv AS (SELECT signal, horizon, round(x - avg(x) OVER (PARTITION BY signal,
  horizon, ticker), 9) AS x, round(y - avg(y) OVER (PARTITION BY signal, horizon, ticker), 9) AS y FROM p),
dr AS (SELECT signal, horizon, rank() OVER (PARTITION BY signal, horizon ORDER BY x) + (count(*) OVER (PARTITION BY signal, horizon, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY signal, horizon ORDER BY y) + (count(*) OVER (PARTITION BY signal, horizon, y) - 1) / 2.0 AS ry FROM dv), w AS (SELECT signal,
  horizon, corr(rx, ry) AS within_ FROM dr GROUP BY 1, 2)
SELECT signal, horizon, round(between_, 4) AS "between", round(within_, 4) AS "within", abs(between_) > 0.3 AND abs(between_) > 2 * abs(within_) AS confounded
  FROM b JOIN w USING (signal, horizon)""")
def e11_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.between_within(evaluation.long_form(_panel(spark, sf_dir), ["sent_cp_ratio", "sent_net_dir_prem"], ["fwd_1", "fwd_2"])), 4)


# --- rules ---------------------------------------------------------------------------------------------------------

_RULES = [(k, c, e, p) for k in ("CALL", "PUT") for c in ("HIGH", "MED", "LOW") for e in ("SWEEP", "FLOOR", "BLOCK", "SINGLE", "ANY") for p in (0, 100_000, 500_000)]
_WIDE = ", ".join(f"max(round({c}, 6)) FILTER (WHERE split = '{s}') AS {s}_{c}" if c in ("mean", "t") else f"max({c}) FILTER (WHERE split = '{s}') AS {s}_{c}" for s in ("mine", "holdout") for c in ("n_rows", "n_dates", "mean", "t"))


@query("d4_rule_grid", f"""WITH {ALERTS}, {CALENDAR}, {SESSION}, px AS (SELECT ticker, feature_date AS date, sum(size)::DOUBLE AS close FROM sessions
  WHERE feature_date IS NOT NULL GROUP BY 1, 2),
r AS (SELECT ticker, date, lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM px), a AS (SELECT s.type, s.confidence,
  s.exec, s.premium, s.sentiment, r.date, fwd FROM sessions s JOIN r ON s.ticker = r.ticker AND s.feature_date = r.date),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM a)), v AS (SELECT a.*, CASE sentiment
  WHEN 'BULLISH' THEN fwd ELSE -fwd END AS pnl, CASE WHEN k - 1 < floor(n * (1 - 0.35::DOUBLE)) THEN 'mine' ELSE 'holdout' END AS split FROM a JOIN c
  USING (date) WHERE fwd IS NOT NULL),
x AS (SELECT type || '_' || confidence || '_' || e || '_' || p AS rule, split, date, pnl FROM v, (SELECT unnest([0, 100000, 500000]) AS p),
  (SELECT unnest(['SWEEP', 'FLOOR', 'BLOCK', 'SINGLE', 'ANY']) AS e) WHERE premium >= p AND (e = 'ANY' OR exec = e)),
y AS (SELECT rule, split, date, avg(pnl) AS m, count(*) AS k FROM x GROUP BY 1, 2, 3), z AS (SELECT rule, split, CAST(sum(k) AS BIGINT) AS n_rows,
  count(*) AS n_dates, CASE WHEN count(*) >= 3 THEN avg(m) END AS mean, CASE WHEN count(*) >= 3 THEN avg(m) / nullif(stddev_samp(m) / sqrt(count(*)), 0)
  END AS t FROM y GROUP BY 1, 2),
w AS (SELECT rule, max(mean) FILTER (WHERE split = 'mine') AS a1, max(mean) FILTER (WHERE split = 'holdout') AS a2, max(t)
  FILTER (WHERE split = 'mine') AS t1, max(t) FILTER (WHERE split = 'holdout') AS t2, {_WIDE} FROM z WHERE n_rows >= 150 AND n_dates >= 8 GROUP BY 1)
SELECT * EXCLUDE (a1, a2, t1, t2), coalesce(sign(a1) = sign(a2) AND abs(t1) >= 2 AND abs(t2) >= 2, false) AS survivor FROM w""")
def d4_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of rules on alert characteristics against the signed size of the next day, with the full gates."""
    a, cal = alerts(spark, sf_dir), calendar(spark, sf_dir)
    px = flow.add_feature_date(a, "time", cal).filter("feature_date is not null").groupBy("ticker", F.col("feature_date").alias("date")).agg(F.sum("size").cast("double").alias("close"))
    rows = flow.order_mining_set(a, cal, T.forward_returns(px, (1,)), (1,))
    rules = {f"{k}_{c}_{e}_{p}": (F.col("type") == k) & (F.col("confidence") == c) & (F.lit(e == "ANY") | (F.col("exec") == e)) & (F.col("premium") >= p) for k, c, e, p in _RULES}
    return rounded(evaluation.score_rules(rows, rules, "pnl_1"))


@query("d2_ticker_mining", f"""WITH {LAST.split(', i AS')[0]}, s AS (SELECT ticker, date, sum("cA" + "cB") AS v, sum("cA" + "cB") / nullif(sum("pA" + "pB"),
  0) AS x FROM chain GROUP BY 1, 2), f AS (SELECT *, (lead(v) OVER {W} + 1) / (v + 1) - 1 AS y FROM s),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM f)) SELECT CASE
  WHEN k - 1 < floor(n * (1 - 0.35::DOUBLE)) THEN 'mine' ELSE 'holdout' END AS split, count(*) AS n, count(x) AS n_ratio, round(avg(x), 6) AS mean_ratio,
  round(avg(y), 6) AS mean FROM f JOIN c USING (date) GROUP BY 1""")
def d2_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain features with the next day's return, split by date."""
    rows = flow.split_by_date(_panel(spark, sf_dir))
    return rounded(rows.groupBy("split").agg(F.count("*").alias("n"), F.count("sent_cp_ratio").alias("n_ratio"), F.avg("sent_cp_ratio").alias("mean_ratio"), F.avg("fwd_1").alias("mean")))
