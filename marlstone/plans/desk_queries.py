"""Queries over gamma chains, candles, positions, earnings, the hit list, detectors and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import book, candles, detectors, evaluation, flow, gamma, hitlist, prints
from ..operators import technicals as T
from .adapters import ALERTS, BARS, CHAIN, EARNINGS, TRADES, alerts, bars, chain, earnings, read, trades
from .registry import query, rounded

DAY = "2024-01-17"


def _strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    return c.select("ticker", "date", F.col("k").alias("strike"), "spot", F.round(F.col("cP") + F.col("pP"), 4).alias("combined"), F.round(F.col("cP") - F.col("pP"), 4).alias("net_oi"))


STRIKES = f"{CHAIN}, st AS (SELECT ticker, date, k AS strike, spot, round(\"cP\" + \"pP\", 4) AS combined, round(\"cP\" - \"pP\", 4) AS net_oi FROM chain)"


@query("a11_gex_strikes", f"WITH {CHAIN} SELECT ticker, date, k AS strike, round(\"cA\" + \"pA\", 4) AS net_oi, round(\"cB\" + \"pB\" + \"cP\" + \"pP\", 4) AS net_dv FROM chain")
def a11_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    raw = c.select("ticker", "date", F.col("k").alias("strike"), F.col("cA").alias("call_gamma_oi"), F.col("pA").alias("put_gamma_oi"), F.col("cB").alias("call_gamma_ask"), F.col("pB").alias("call_gamma_bid"), F.col("cP").alias("put_gamma_ask"), F.col("pP").alias("put_gamma_bid"))
    return rounded(gamma.gex_strikes(raw).select("ticker", "date", "strike", "net_oi", "net_dv"), 4)


@query("a12_gex_levels", f"""WITH {STRIKES}, c AS (SELECT *, sum(combined) OVER (PARTITION BY ticker, date ORDER BY strike ROWS UNBOUNDED PRECEDING) AS cum,
  abs(strike - spot) <= 0.05 * spot AS near FROM st),
p AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY ticker, date ORDER BY strike), 0) AS prev FROM c),
g AS (SELECT ticker, date, any_value(spot) AS spot, arg_max(strike, combined) FILTER (WHERE near AND strike > spot AND combined > 0) AS cw, arg_min(strike,
  combined) FILTER (WHERE near AND strike < spot AND combined < 0) AS pw, min(strike) FILTER (WHERE near AND prev <> 0 AND sign(prev) <> sign(cum)) AS gf
  FROM p GROUP BY 1, 2)
SELECT ticker, date, coalesce(cw, spot) AS call_wall, coalesce(pw, spot) AS put_wall, coalesce(gf, spot) AS gamma_flip, CASE WHEN spot > coalesce(gf, spot)
  THEN 'POSITIVE' ELSE 'NEGATIVE' END AS regime FROM g""")
def a12_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gamma.gex_levels(_strikes(spark, sf_dir), ["ticker", "date"]).select("ticker", "date", "call_wall", "put_wall", "gamma_flip", "regime")


@query("k3_nearest_strikes", f"""WITH {STRIKES} SELECT ticker, date, strike, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY ticker,
  date ORDER BY abs(strike - spot), strike) AS n FROM st) WHERE n <= 3""")
def k3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gamma.nearest_strikes(_strikes(spark, sf_dir), ["ticker", "date"], 3).select("ticker", "date", "strike", "n")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    return a.select("ticker", F.lit(100.0).alias("spot"), F.round(F.col("strike") * 100 / F.col("spot"), 6).alias("strike"), "expiry", F.col("id").alias("seq"), F.col("premium").alias("net_oi"), F.col("ask_prem").alias("net_dv"))


CELLS = f"""{ALERTS}, raw AS (SELECT ticker, 100.0::DOUBLE AS spot, round(strike * 100 / spot, 6) AS strike, expiry, id, premium AS net_oi FROM alerts),
cells AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, strike, expiry ORDER BY id DESC) AS n FROM raw) WHERE n = 1),
ok AS (SELECT ticker FROM cells GROUP BY 1 HAVING bool_or(strike >= spot AND strike <= spot * 1.05) AND bool_or(strike <= spot AND strike >= spot * 0.95))"""


@query("a13_heatmap_cells", f"WITH {CELLS} SELECT ticker, strike, expiry, round(net_oi, 4) AS net_oi FROM cells SEMI JOIN ok USING (ticker)")
def a13_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gamma.heatmap_cells(_cells(spark, sf_dir), ["ticker"]).select("ticker", "strike", "expiry", "net_oi"), 4)


@query("a16_heatmap_scale", f"""WITH {CELLS}, r AS (SELECT ticker, strike, net_oi, row_number() OVER (PARTITION BY ticker ORDER BY abs(net_oi) DESC, strike,
  expiry) AS n FROM cells SEMI JOIN ok USING (ticker)) SELECT ticker, max(strike) FILTER (WHERE n = 1) AS max_strike, round(max(abs(net_oi))
  FILTER (WHERE n = 2), 4) AS scale FROM r GROUP BY 1""")
def a16_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gamma.heatmap_scale(gamma.heatmap_cells(_cells(spark, sf_dir), ["ticker"]), ["ticker"]), 4)


@query(
    "a14_expirations",
    f"""WITH {ALERTS}, e AS (SELECT DISTINCT ticker, expiry FROM alerts WHERE expiry >= DATE '{DAY}'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY expiry) AS n, row_number() OVER (PARTITION BY ticker, dayofweek(expiry) = 5 ORDER BY expiry) AS f
  FROM e
) SELECT ticker, expiry, CAST(expiry - DATE '{DAY}' AS INTEGER) AS dte FROM n WHERE n <= 7 OR (dayofweek(expiry) = 5 AND f <= 5)
UNION SELECT ticker, DATE '{DAY}', 0 FROM alerts""",
)
def a14_expirations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gamma.choose_expirations(alerts(spark, sf_dir).select("ticker", "expiry").distinct(), F.lit(DAY).cast("date")).select("ticker", "expiry", "dte")


@query("j8_snapshot_as_of", """WITH s AS (SELECT 'U' || user_id AS ticker, ts AS captured_at, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS n_exp
  FROM events), r AS (SELECT 'U' || user_id AS ticker, ts + INTERVAL 1 HOUR AS at_ts FROM events WHERE event_type = 'purchase'),
g AS (SELECT r.ticker, r.at_ts, max(captured_at) FILTER (WHERE n_exp >= 2 AND captured_at > r.at_ts - INTERVAL 6 HOUR) AS good, max(captured_at) AS any_
  FROM r JOIN s ON s.ticker = r.ticker AND s.captured_at <= r.at_ts GROUP BY 1, 2)
SELECT ticker, epoch_us(at_ts) AS at_us, epoch_us(coalesce(good, any_)) AS captured_us FROM g WHERE coalesce(good, any_) >= at_ts - INTERVAL 72 HOUR""")
def j8_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.col("ts").cast("timestamp").alias("captured_at"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("n_exp"), "event_type")
    requests = e.filter("event_type = 'purchase'").select("ticker", (F.col("captured_at") + F.make_dt_interval(F.lit(0), F.lit(1))).alias("at"))
    return gamma.snapshot_as_of(e, requests).select("ticker", F.unix_micros("at").alias("at_us"), F.unix_micros("captured_at").alias("captured_us"))


@query("j9_reference_price", f"""WITH {CHAIN} SELECT ticker, round(coalesce(sum(k * ("cA" + "cB" + "pA" + "pB")) / nullif(sum("cA" + "cB" + "pA" + "pB"), 0),
  0), 6) AS reference FROM chain GROUP BY 1""")
def j9_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No gamma snapshot and no bar has a chain's ticker here: the weighted strike it is."""
    c = chain(spark, sf_dir).withColumn("volume", F.col("cA") + F.col("cB") + F.col("pA") + F.col("pB"))
    none = bars(spark, sf_dir).withColumns({"captured_at": F.col("date"), "spot": F.col("close")})
    return rounded(gamma.reference_price(c, none, none))


# --- candles -------------------------------------------------------------------------------------------------------


@query("q1_q2_manifest", f"""WITH {BARS}, u AS (SELECT 'S' || s_suppkey AS ticker FROM supplier UNION SELECT 'NONE'), g AS (SELECT ticker, count(*) AS rows,
  min(date) AS first_date, max(date) AS last_date, bool_or(volume <= 0) AS zv FROM bars GROUP BY 1)
SELECT u.ticker, coalesce(rows, 0) AS rows, first_date, last_date, array_to_string(list_filter([CASE WHEN rows IS NULL THEN 'empty' END, CASE
  WHEN first_date > DATE '1995-01-01' + 30 THEN 'short_history' END, CASE WHEN last_date < DATE '2001-11-04' - 10 THEN 'stale' END,
  CASE WHEN rows < 0.95 * greatest(last_date - first_date, 1) * 252 / 365 THEN 'gaps' END, CASE WHEN zv THEN 'zero_volume_rows' END],
  lambda x: x IS NOT NULL), ';') AS flags FROM u LEFT JOIN g USING (ticker)""")
def q1_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker")).union(spark.range(1).select(F.lit("NONE")))
    return candles.build_manifest(bars(spark, sf_dir), names, F.lit("1995-01-01").cast("date"), F.lit("2001-11-04").cast("date"), F.lit("2001-11-05").cast("date")).select("ticker", "rows", "first_date", "last_date", "flags")


@query("q3_new_bars", f"""WITH {BARS}, m AS (SELECT ticker, max(date) AS last FROM bars WHERE date < DATE '2001-06-01' GROUP BY 1) SELECT ticker, count(*) AS n,
  min(date) AS first FROM bars LEFT JOIN m USING (ticker) WHERE date > coalesce(last, DATE '1900-01-01') GROUP BY 1""")
def q3_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    manifest = b.filter("date < '2001-06-01'").groupBy("ticker").agg(F.max("date").alias("last_date"))
    return candles.new_bars_only(manifest, b, F.lit("1995-01-01").cast("date")).groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("q4_q5_trim_reused", f"""WITH {BARS}, g AS (SELECT ticker, date, date - lag(date) OVER (PARTITION BY ticker ORDER BY date) AS gap FROM bars),
  s AS (SELECT ticker, date AS seam, gap FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY gap DESC, date) AS n FROM g WHERE gap IS NOT NULL)
  WHERE n = 1 AND gap >= 25),
c AS (SELECT b.ticker, any_value(seam) AS seam, CAST(any_value(gap) AS INTEGER) AS gap, count(*) FILTER (WHERE date < seam) AS n_pre, count(*)
  FILTER (WHERE date >= seam) AS n_post FROM bars b LEFT JOIN s USING (ticker) GROUP BY 1),
r AS (SELECT *, CASE WHEN seam IS NULL THEN 'no-seam' WHEN n_post > n_pre THEN 'trimmed' ELSE 'refused:tail-seam' END AS status FROM c),
k AS (SELECT b.ticker, count(*) AS n_kept, min(date) AS first_kept, round(sum(close), 4) AS close_kept FROM bars b JOIN r USING (ticker)
  WHERE status <> 'trimmed' OR date >= seam GROUP BY 1) SELECT * FROM r JOIN k USING (ticker)""")
def q5_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report, and what is kept of each ticker."""
    kept, report = candles.trim_reused(bars(spark, sf_dir), 25)
    sums = kept.groupBy("ticker").agg(F.count("*").alias("n_kept"), F.min("date").alias("first_kept"), F.round(F.sum("close"), 4).alias("close_kept"))
    return report.join(sums, "ticker")


@query("q6_stitch", f"""WITH {BARS}, b AS (SELECT * FROM bars WHERE date >= DATE '1998-01-01' OR ticker <> 'S2'), f AS (SELECT min(date) AS start,
  arg_min(close, date) AS after FROM b WHERE ticker = 'S2'), o AS (SELECT max(date) AS last_old, arg_max(close, date) AS before FROM b WHERE ticker = 'S1'
  AND date < (SELECT start FROM f)),
j AS (SELECT CASE WHEN ticker = 'S1' THEN 'S2' ELSE ticker END AS ticker, date, close FROM b WHERE ticker <> 'S1' OR date < (SELECT start FROM f)),
  c AS (SELECT ticker, count(*) AS n, min(date) AS first, round(sum(close), 4) AS total FROM j GROUP BY 1)
SELECT c.*, CASE WHEN ticker = 'S2' THEN round(after / before, 4) END AS ratio, CASE WHEN ticker = 'S2' THEN CAST(start - last_old AS INTEGER)
  END AS gap_days, CASE WHEN ticker = 'S2' THEN round(after / before, 4) BETWEEN 0.67 AND 1.5 AND start - last_old <= 7 END AS clean FROM c, f, o""")
def q6_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seam, and what the stitched table has of each ticker."""
    b = bars(spark, sf_dir).filter("date >= '1998-01-01' or ticker <> 'S2'")
    renames = spark.range(1).select(F.lit("S1").alias("old"), F.lit("S2").alias("new"))
    joined, seams = candles.stitch(b, renames)
    sums = joined.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.round(F.sum("close"), 4).alias("total"))
    return sums.join(seams, "ticker", "left")


@query("q7_drop_tickers", f"""WITH {BARS} SELECT ticker, count(*) AS n FROM bars WHERE ticker NOT IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0)
  GROUP BY 1""")
def q7_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ticker"))
    return candles.drop_tickers(bars(spark, sf_dir), gone).groupBy("ticker").agg(F.count("*").alias("n"))


@query("s3_s4_upsert_bars", f"""WITH {BARS} SELECT count(*) AS n, round(sum(CASE WHEN date >= DATE '2000-01-01' THEN close * 2 ELSE close END), 2) AS total
  FROM bars""")
def s4_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir).select("ticker", "date", "close")
    out = B.upsert(b.filter("date < '2001-01-01'"), b.filter("date >= '2000-01-01'").withColumn("close", F.col("close") * 2), ["ticker", "date"])
    return out.agg(F.count("*").alias("n"), F.round(F.sum("close"), 2).alias("total"))


@query("u4_missing_days", f"""WITH {BARS}, d AS (SELECT CAST(unnest(generate_series(DATE '1999-03-01', DATE '1999-03-31', INTERVAL 1 DAY)) AS DATE) AS date),
  u AS (SELECT DISTINCT ticker FROM bars) SELECT u.ticker, d.date FROM u, d WHERE dayofweek(d.date) NOT IN (0, 6) AND NOT EXISTS (SELECT 1 FROM bars b
  WHERE b.ticker = u.ticker AND b.date = d.date)""")
def u4_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(spark, sf_dir)
    return candles.missing_days(b.select("ticker").distinct(), F.lit("1999-03-01").cast("date"), F.lit("1999-03-31").cast("date"), b)


@query("a17_a27_price_header", f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM bars
  WHERE date <= DATE '2001-10-01'), g AS (SELECT ticker, max(close) FILTER (WHERE n = 1) AS last, max(close) FILTER (WHERE n = 2) AS prev, max(high)
  FILTER (WHERE date > DATE '2001-10-01' - 364) AS high FROM n GROUP BY 1)
SELECT ticker, round(last, 8) AS last, round(last - coalesce(prev, last), 8) AS change, round((last / coalesce(prev, last) - 1) * 100, 5) AS change_pct,
  round((1 - last / high) * 100, 5) AS below_high_pct FROM g""")
def a27_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = candles.price_header(bars(spark, sf_dir), F.lit("2001-10-01").cast("date"))
    return out.withColumns({"last": F.round("last", 8), "change": F.round("change", 8), "change_pct": F.round("change_pct", 5), "below_high_pct": F.round("below_high_pct", 5)})


# --- positions, earnings, metadata ---------------------------------------------------------------------------------


@query("a23_monthly_gains", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS gain FROM orders GROUP BY 1)
  SELECT month, round(gain, 2) AS gain, round(sum(gain) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING), 2) AS cumulative, round(sum(gain) OVER (), 2) AS total
  FROM m""")
def a23_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.monthly_gains(read(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("gain"))), 2)


@query("a18_earnings_rollup", f"""WITH {EARNINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) AS n FROM earnings
  WHERE report_date < DATE '2001-01-01') SELECT ticker, round(avg(abs(move_1d)), 6) AS avg_move, count(*) FILTER (WHERE eps_actual >= eps_estimate) AS beats,
  count(*) AS quarters FROM n WHERE n <= 12 GROUP BY 1""")
def a18_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(book.earnings_rollup(earnings(spark, sf_dir), F.lit("2001-01-01").cast("date")))


@query("a19_earnings_calendar", f"""WITH {EARNINGS}, u AS (SELECT 'C' || c_custkey AS ticker FROM customer WHERE c_acctbal > 0 AND (c_mktsegment = 'BUILDING'
  OR c_nationkey = 3)) SELECT ticker, report_date, CASE WHEN eps_actual > 1 THEN 'post' ELSE 'pre' END AS session FROM earnings SEMI JOIN u USING (ticker)
  WHERE report_date BETWEEN DATE '2000-01-01' AND DATE '2000-03-31'""")
def a19_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = earnings(spark, sf_dir)
    u = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker"), (F.col("c_acctbal") > 0).alias("has_options"), (F.col("c_mktsegment") == "BUILDING").alias("is_index"), (F.col("c_nationkey") == 3).alias("tracked"))
    return book.earnings_calendar(e, e.filter("eps_actual > 1"), u, F.lit("2000-01-01").cast("date"), F.lit("2000-03-31").cast("date")).select("ticker", "report_date", "session").transform(lambda d: d.withColumn("session", F.when(F.col("session") == "post", "post").otherwise("pre")))


@query("a20_earnings_focus", f"""WITH {EARNINGS}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY report_date DESC) AS n FROM earnings
  WHERE report_date < DATE '2000-01-01'), h AS (SELECT ticker, count(*) FILTER (WHERE n <= 16) AS n_history FROM n GROUP BY 1),
f AS (SELECT ticker, min(report_date) FILTER (WHERE report_date >= DATE '2000-01-01') AS nxt, max(report_date)
  FILTER (WHERE report_date < DATE '2000-01-01') AS lst FROM earnings GROUP BY 1) SELECT ticker, coalesce(nxt, lst) AS focus, coalesce(n_history,
  0) AS n_history FROM f LEFT JOIN h USING (ticker)""")
def a20_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.earnings_focus(earnings(spark, sf_dir), F.lit("2000-01-01").cast("date")).select("ticker", "focus", F.coalesce(F.size("history"), F.lit(0)).cast("long").alias("n_history"))


@query("u5_stale_histories", f"""WITH {EARNINGS} SELECT DISTINCT ticker FROM earnings WHERE report_date >= DATE '2001-07-25' - 7
  AND ticker NOT IN (SELECT 'C' || c_custkey FROM customer WHERE c_custkey % 3 = 0) ORDER BY ticker LIMIT 80""")
def u5_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker"), F.lit("2001-07-24").cast("date").alias("refreshed_at"))
    return book.stale_histories(earnings(spark, sf_dir), fresh, F.lit("2001-07-25").cast("date"))


@query("f2_u2_sectors", """WITH r AS (SELECT 'C' || c_custkey AS ticker, c_mktsegment AS raw_sector FROM customer) SELECT ticker, CASE WHEN ticker IN ('C1',
  'C2') THEN 'Energy' WHEN raw_sector = 'BUILDING' THEN 'Industrials' ELSE 'Technology' END AS sector, ticker NOT IN ('C1', 'C2')
  AND raw_sector <> 'BUILDING' AS unresolved FROM r""")
def f2_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ticker"), F.col("c_mktsegment").alias("raw_sector"))
    overrides = spark.createDataFrame([("C1", "Energy"), ("C2", "Energy")], "ticker string, sector string")
    names = spark.createDataFrame([("building", "Industrials")], "raw string, sector string")
    return book.resolve_sector(rows, overrides, names).select("ticker", "sector", "unresolved")


@query("u1_universe", f"""WITH {ALERTS}, {TRADES} SELECT 'W1' AS ticker UNION SELECT ticker FROM alerts WHERE time >= TIMESTAMP '{DAY}' - INTERVAL 7 DAY UNION
  SELECT ticker FROM trades WHERE executed_at >= TIMESTAMP '{DAY}' - INTERVAL 7 DAY""")
def u1_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    watched = spark.range(1).select(F.lit("W1").alias("ticker"))
    return book.ticker_universe(watched, alerts(spark, sf_dir), trades(spark, sf_dir), F.lit(DAY).cast("date"))


@query("k9_latest_sector", f"WITH {ALERTS} SELECT ticker, arg_max(sector, id) AS sector FROM alerts GROUP BY 1")
def k9_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return book.latest_sector(alerts(spark, sf_dir))


# --- hit list ------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain volumes scaled so that some trade enough."""
    s = flow.chain_minute(chain(spark, sf_dir))
    return s.withColumns({"call_vol": F.col("call_vol") * 20, "put_vol": F.col("put_vol") * 20})


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir).select("id", "ticker", F.col("time").alias("executed_at"), F.lit(1.0).alias("price"), F.col("premium").alias("size"), "premium")
    return prints.rerank(a)


@query("f6_option_marks", f"""WITH {ALERTS}, q AS (SELECT ticker AS occ, arg_max(bid_prem, id) AS bid, arg_max(ask_prem, id) AS ask, arg_max(premium,
  id) AS last FROM alerts GROUP BY 1) SELECT occ, round(CASE WHEN bid > 0 AND ask > 0 THEN (bid + ask) / 2 WHEN last > 0 THEN last END, 4) AS mark FROM q""")
def f6_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = alerts(spark, sf_dir).select(F.col("ticker").alias("occ"), F.col("id").alias("date"), F.col("bid_prem").alias("bid"), F.col("ask_prem").alias("ask"), F.col("premium").alias("last"))
    return rounded(hitlist.option_marks(q), 4)


# --- detectors and statistics --------------------------------------------------------------------------------------


@query("p0_weekly_state", f"""WITH {BARS}, w AS (SELECT ticker, date + CAST((12 - dayofweek(date)) % 7 AS INTEGER) AS week, arg_max(close, date) AS c
  FROM bars GROUP BY 1, 2),
m AS (SELECT *, CASE WHEN count(*) OVER f = 10 THEN avg(c) OVER f END AS fast, CASE WHEN count(*) OVER s = 20 THEN avg(c) OVER s END AS slow
  FROM w WINDOW f AS (PARTITION BY ticker ORDER BY week ROWS 9 PRECEDING), s AS (PARTITION BY ticker ORDER BY week ROWS 19 PRECEDING)),
t AS (SELECT *, CASE WHEN slow IS NULL THEN NULL WHEN c > fast AND fast > slow THEN 1.0 WHEN c < fast AND fast < slow THEN -1.0 ELSE 0.0 END::DOUBLE AS state
  FROM m), p AS (SELECT ticker, week, lag(state) OVER (PARTITION BY ticker ORDER BY week) AS htf FROM t)
SELECT b.ticker, b.date, htf FROM bars b JOIN p ON p.ticker = b.ticker AND p.week = b.date + CAST((12 - dayofweek(b.date)) % 7 AS INTEGER)""")
def p0_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detectors.weekly_state(bars(spark, sf_dir))


@query("e1_folds", f"""WITH {BARS}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)), o AS (SELECT min(i)
  FILTER (WHERE date >= (SELECT max(date) FROM d) - INTERVAL 12 MONTH) AS oos, max(i) AS last FROM d),
f AS (SELECT 'cv' || k AS fold, CAST(floor(oos * k / 6.0) AS INTEGER) AS lo, CAST(floor(oos * (k + 1) / 6.0) AS INTEGER) - 1 AS hi, false AS is_oos FROM o,
  range(1, 6) t(k) UNION ALL SELECT 'oos', oos, last, true FROM o)
SELECT fold, (SELECT date FROM d WHERE i = 0) AS train_start, (SELECT date FROM d WHERE i = lo - 11) AS train_end, (SELECT date FROM d
  WHERE i = lo) AS test_start, (SELECT date FROM d WHERE i = hi) AS test_end, is_oos FROM f""")
def e1_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.folds(bars(spark, sf_dir))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain features with the ratio of the day to come as the return."""
    s = flow.aggregate_sentiment(chain(spark, sf_dir))
    px = s.select("ticker", "date", (F.col("sent_call_vol") + 1).alias("close"))
    return s.join(T.forward_returns(px, (1, 2)).drop("close"), ["ticker", "date"])


PANEL = f"""{CHAIN}, s AS (SELECT ticker, date, sum("cA" + "cB") AS v, sum("cA" + "cB") / nullif(sum("pA" + "pB"), 0) AS x FROM chain GROUP BY 1, 2),
  f AS (SELECT *, lead(v) OVER (PARTITION BY ticker ORDER BY date) AS nv FROM s),
r AS (SELECT ticker, date, x, (nv + 1) / (v + 1) - 1 AS y FROM f)"""


@query("e9_fama_macbeth", f"""WITH {PANEL}, k AS (SELECT *, count(x) OVER (PARTITION BY date) AS n FROM r), z AS (SELECT date, rank() OVER (PARTITION BY date
  ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date,
  y) - 1) / 2.0 AS ry FROM k WHERE n >= 20 AND x IS NOT NULL AND y IS NOT NULL),
d AS (SELECT date, corr(rx, ry) AS c FROM z GROUP BY 1 HAVING count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0)
SELECT 'sent_cp_ratio' AS signal, 'fwd_1' AS horizon, count(*) AS n_dates, round(avg(c), 6) AS mean_corr, round(avg(c) / (stddev_samp(c) / sqrt(count(*))),
  6) AS t FROM d HAVING count(*) > 0""")
def e9_fama(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.fama_macbeth(evaluation.long_form(_panel(spark, sf_dir), ["sent_cp_ratio"], ["fwd_1"])))


@query("e10_quintile_spread", f"""WITH {PANEL}, q AS (SELECT date, count(*) AS n, quantile_cont(x, 0.2) AS lo, quantile_cont(x, 0.8) AS hi FROM r
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 20),
d AS (SELECT date, avg(y) FILTER (WHERE x >= hi) - avg(y) FILTER (WHERE x <= lo) AS s FROM r JOIN q USING (date) WHERE x IS NOT NULL AND y IS NOT NULL
  GROUP BY 1)
SELECT 'sent_cp_ratio' AS signal, 'fwd_1' AS horizon, count(*) AS n_dates, round(avg(s), 6) AS mean_spread, round(avg(s) / (stddev_samp(s) / sqrt(count(*))),
  6) AS t FROM d WHERE s IS NOT NULL HAVING count(*) > 0""")
def e10_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.quintile_spread(evaluation.long_form(_panel(spark, sf_dir), ["sent_cp_ratio"], ["fwd_1"])))


SCORED = """sc AS (SELECT 'long' AS side, CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'oos' ELSE 'cv' END AS segment,
  (l_returnflag = 'R')::INT::DOUBLE AS y, l_discount + round(l_tax, 2) / 10 AS p FROM lineitem)"""


@query("e4_metrics", f"""WITH {SCORED}, g AS (SELECT side, segment, round(p, 6) AS p, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1, 2, 3), c AS (SELECT *,
  sum(pos) OVER d AS tp, sum(n) OVER d AS cn, sum(pos) OVER (PARTITION BY side, segment) AS ap, sum(n) OVER (PARTITION BY side, segment) AS an
  FROM g WINDOW d AS (PARTITION BY side, segment ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
k AS (SELECT side, segment, sum((n - pos) * (tp - pos / 2)) / (any_value(ap) * (any_value(an) - any_value(ap))) AS roc_auc,
  sum(pos * tp / cn) / any_value(ap) AS pr_auc FROM c GROUP BY 1, 2), b AS (SELECT side, segment, count(*) AS n, avg(y) AS base_rate, avg(pow(round(p, 6) - y,
  2)) AS brier FROM sc GROUP BY 1, 2),
q AS (SELECT side, segment, quantile_cont(round(p, 6), 0.9) AS cut FROM sc GROUP BY 1, 2), t AS (SELECT side, segment, avg(y) FILTER (WHERE round(p,
  6) >= cut) AS tdp, sum(y) FILTER (WHERE round(p, 6) >= cut) / sum(y) AS tdr FROM sc JOIN q USING (side, segment) GROUP BY 1, 2)
SELECT side, segment, n, round(base_rate, 6) AS base_rate, round(brier, 6) AS brier, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
  round(pr_auc / base_rate, 6) AS pr_auc_lift, round(tdp, 6) AS top_decile_precision, round(tdr, 6) AS top_decile_recall FROM b JOIN k USING (side, segment)
  JOIN t USING (side, segment)""")
def e4_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "lineitem").select(F.lit("long").alias("side"), F.when(F.col("l_shipdate") >= "2001-01-01", "oos").otherwise("cv").alias("segment"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.round(F.col("l_discount") + F.round("l_tax", 2) / 10, 6).alias("p"))
    return rounded(evaluation.metrics(s).select("side", "segment", "n", "base_rate", "brier", "roc_auc", "pr_auc", "pr_auc_lift", "top_decile_precision", "top_decile_recall"))


