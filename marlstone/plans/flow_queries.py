"""Queries over alerts, chains and prints. Events of the driver lie in January: New York is 5 hours behind in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import flow as O
from ..operators import prints as P
from ..operators import technicals as T
from .adapters import ALERTS, BARS, CALENDAR, CHAIN, TRADES, alerts, bars, calendar, chain, trades
from .registry import query, rounded

LOCAL = "(time - INTERVAL 5 HOUR)"
SESSION = f"""sessions AS (
  SELECT a.*, (SELECT min(date) FROM calendar WHERE date >= CAST({LOCAL} AS DATE) + (date_part('hour', {LOCAL}) * 3600 + date_part('minute',
  {LOCAL}) * 60 + floor(date_part('second', {LOCAL})) > 57600)::INT) AS feature_date FROM alerts a)"""


@query("j1_sessionise", f"WITH {ALERTS}, {CALENDAR}, {SESSION} SELECT id, feature_date FROM sessions")
def j1_sessionise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.add_feature_date(alerts(spark, sf_dir), "time", calendar(spark, sf_dir)).select("id", "feature_date")


FLOW = """SELECT ticker, feature_date AS date, count(*) AS flow_alert_count, round(sum(premium), 4) AS flow_total_premium, round(sum(CASE WHEN type = 'CALL'
  THEN premium ELSE 0 END), 4) AS flow_call_premium, round(sum(CASE WHEN type = 'PUT' THEN premium ELSE 0 END), 4) AS flow_put_premium,
  round(sum(CASE WHEN sentiment = 'BULLISH' THEN premium ELSE 0 END), 4) AS flow_bullish_premium, round(sum(CASE WHEN sentiment = 'BEARISH' THEN premium
  ELSE 0 END), 4) AS flow_bearish_premium, count(*) FILTER (WHERE exec = 'SWEEP') AS flow_sweep_count,
  round(sum(CASE WHEN exec = 'SWEEP' THEN premium ELSE 0 END), 4) AS flow_sweep_premium, CAST(sum(size) AS BIGINT) AS flow_total_size,
  round(avg(expiry - feature_date), 4) AS flow_avg_dte, count(*) FILTER (WHERE confidence = 'HIGH') AS flow_high_conf_count,
  round(avg(all_opening::INT), 4) AS flow_opening_frac, round(sum(CASE WHEN type = 'CALL' THEN premium ELSE -premium END), 4) AS flow_net_call_premium,
  round(sum(CASE WHEN sentiment = 'BULLISH' THEN premium ELSE -premium END), 4) AS flow_net_sentiment_premium
  FROM sessions WHERE feature_date IS NOT NULL GROUP BY 1, 2"""


@query("a1_flow_features", f"WITH {ALERTS}, {CALENDAR}, {SESSION} {FLOW}")
def a1_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.aggregate_flow(alerts(spark, sf_dir), calendar(spark, sf_dir)), 4)


@query("a2_print_features", f"""WITH {TRADES} SELECT ticker, CAST(executed_at AS DATE) AS date, count(*) AS dp_print_count, round(sum(premium),
  4) AS dp_total_premium, round(sum(size), 4) AS dp_total_size, round(max(premium), 4) AS dp_max_premium FROM trades GROUP BY 1, 2""")
def a2_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prints stamped at noon UTC; every day that has one is a trading day here."""
    t = trades(spark, sf_dir).withColumn("executed_at", F.col("executed_at") + F.make_dt_interval(F.lit(0), F.lit(12)))
    return rounded(O.aggregate_prints(t, t.select(F.to_date("executed_at").alias("date")).distinct()), 4)


@query("j2_w19_print_join", f"""WITH {BARS}, d AS (SELECT b.ticker, b.date, b.close, b.volume, p.n, coalesce(p.premium, 0) AS premium FROM bars b LEFT JOIN
  (SELECT ticker, CAST(executed_at AS DATE) AS date, count(*) AS n, sum(premium) AS premium FROM trades WHERE size >= 30 GROUP BY 1, 2) p USING (ticker,
  date)),
x AS (SELECT *, round(coalesce(premium / nullif(close * volume, 0), 0), 9) AS share FROM d),
y AS (SELECT *, list(share) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS l FROM x)
SELECT ticker, date, coalesce(n, 0)::DOUBLE AS dp_print_count, round(premium, 4) AS dp_total_premium, (n IS NOT NULL)::INT AS has_dp, round(share,
  6) AS dp_premium_to_dollar_vol,
  CASE WHEN len(l) = 126 THEN round((len(list_filter(l, lambda v: v < share)) + (len(list_filter(l, lambda v: v = share)) + 1) / 2.0) / 126, 6)
  END AS dp_premium_pctile FROM y""")
def j2_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = trades(spark, sf_dir).filter("size >= 30").groupBy("ticker", F.to_date("executed_at").alias("date")).agg(F.count("*").alias("dp_print_count"), F.sum("premium").alias("dp_total_premium"))
    out = O.print_intensity(O.join_daily(bars(spark, sf_dir), large, "has_dp"))
    return out.select("ticker", "date", "dp_print_count", F.round("dp_total_premium", 4).alias("dp_total_premium"), "has_dp", F.round("dp_premium_to_dollar_vol", 6).alias("dp_premium_to_dollar_vol"), F.round("dp_premium_pctile", 6).alias("dp_premium_pctile"))


SENT = """SELECT ticker, date, sum("cA" + "cB") AS sent_call_vol, sum("pA" + "pB") AS sent_put_vol, round(sum("cP"), 4) AS sent_net_call_prem,
  round(sum("pP"), 4) AS sent_net_put_prem, round(sum("cP") - sum("pP"), 4) AS sent_net_dir_prem, count(DISTINCT k) AS sent_strike_count,
  round(sum("cA" + "cB") / nullif(sum("pA" + "pB"), 0), 6) AS sent_cp_ratio, round(sum("cA") / nullif(sum("cA" + "cB"), 0), 6) AS sent_call_buy_frac,
  round(sum("pA") / nullif(sum("pA" + "pB"), 0), 6) AS sent_put_buy_frac,
  round((sum("cP") - sum("pP")) / nullif(sum(abs("cP") + abs("pP")), 0), 6) AS sent_dir_prem_score,
  round(sum(CASE WHEN near THEN "cA" - "cB" ELSE 0 END) / nullif(sum(CASE WHEN near THEN "cA" + "cB" ELSE 0 END), 0), 6) AS sent_atm_call_imb, round(sum(CASE
  WHEN near THEN "pA" - "pB" ELSE 0 END) / nullif(sum(CASE WHEN near THEN "pA" + "pB" ELSE 0 END), 0), 6) AS sent_atm_put_imb,
  round(sum(CASE WHEN k > spot * 1.05 THEN "cA" ELSE 0 END) / nullif(sum("cA"), 0), 6) AS sent_otm_call_buy_frac, round(sum(CASE WHEN k < spot * 0.95
  THEN "pA" ELSE 0 END) / nullif(sum("pA"), 0), 6) AS sent_otm_put_buy_frac
  FROM (SELECT *, abs(k - spot) <= 0.025 * spot AS near FROM chain) GROUP BY 1, 2"""


@query("a3_chain_sentiment", f"WITH {CHAIN} {SENT}")
def a3_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.aggregate_sentiment(chain(spark, sf_dir))
    money = {"sent_net_call_prem", "sent_net_put_prem", "sent_net_dir_prem"}
    return out.select(*[F.round(c, 4 if c in money else 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("j3_join_sentiment", f"""WITH {CHAIN}, {BARS}, m AS (SELECT 'U' || s_suppkey AS ticker, date FROM supplier, (SELECT DISTINCT date FROM chain)),
  s AS ({SENT})
SELECT m.ticker, m.date, coalesce(sent_call_vol, 0) AS sent_call_vol, sent_cp_ratio, (s.ticker IS NOT NULL)::INT AS has_sentiment FROM m LEFT JOIN s
  USING (ticker, date)""")
def j3_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("U"), F.col("s_suppkey")).alias("ticker"))
    matrix = names.crossJoin(F.broadcast(c.select("date").distinct()))  # a calendar of some days for each ticker
    return O.join_sentiment(matrix, O.aggregate_sentiment(c)).select("ticker", "date", "sent_call_vol", F.round("sent_cp_ratio", 6).alias("sent_cp_ratio"), "has_sentiment")


@query("a4_chain_minute", f"""WITH {CHAIN}, i AS (SELECT *, abs(k - spot) <= spot * 0.12 AS inside FROM chain), j AS (SELECT *, bool_or(inside)
  OVER (PARTITION BY ticker, date) AS any_in FROM i),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(k - spot), k) AS n FROM j WHERE inside OR NOT any_in),
g AS (SELECT ticker, date, sum("cA" + "cB") AS call_vol, sum("pA" + "pB") AS put_vol, round(sum("cP" - "pP"), 4) AS net, round(sum(abs("cP") + abs("pP")),
  4) AS abs_prem, count(*) AS n_strikes FROM n WHERE n <= 60 GROUP BY 1, 2)
SELECT ticker, date, call_vol, put_vol, n_strikes, round(CASE WHEN put_vol > 0 THEN call_vol / put_vol ELSE 0 END, 6) AS cp_ratio, CASE WHEN abs_prem > 0
  AND abs(net) < 0.1 * abs_prem THEN 'NEUTRAL' WHEN net >= 0 THEN 'BULLISH' ELSE 'BEARISH' END AS sentiment FROM g""")
def a4_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.chain_minute(chain(spark, sf_dir)).select("ticker", "date", "call_vol", "put_vol", F.size("strikes").cast("long").alias("n_strikes"), F.round("cp_ratio", 6).alias("cp_ratio"), "sentiment")


LAST = f"""{CHAIN}, i AS (SELECT *, abs(k - spot) <= spot * 0.12 AS inside FROM chain), j AS (SELECT *, bool_or(inside) OVER (PARTITION BY ticker,
  date) AS any_in FROM i),
near AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY abs(k - spot), k) AS n FROM j WHERE inside OR NOT any_in),
days AS (SELECT ticker, date, any_value(spot) AS spot, sum("cA") AS ca, sum("cB") AS cb, sum("pA") AS pa, sum("pB") AS pb, sum("cPA") AS cpa,
  sum("cPB") AS cpb, sum("pPA") AS ppa, sum("pPB") AS ppb FROM near WHERE n <= 60 GROUP BY 1, 2),
summary AS (SELECT *, ca + cb AS call_vol, pa + pb AS put_vol FROM days WHERE date = (SELECT max(date) FROM days))"""


def _capped(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN least({a} / {b}, 99) WHEN {a} > 0 THEN 99 ELSE 0 END::DOUBLE"


def _legs(ask: str, bid: str, mode: str) -> str:
    return f"({ask} + {bid})" if mode == "all" else f"({ask})" if mode == "ask" else f"({ask} - {bid})"


LEGS = "round(ca, 4) AS \"cA\", round(cb, 4) AS \"cB\", round(pa, 4) AS \"pA\", round(pb, 4) AS \"pB\", round(cpa, 4) AS \"cPA\", round(cpb, 4) AS \"cPB\", round(ppa, 4) AS \"pPA\", round(ppb, 4) AS \"pPB\""


#: Contracts of these chains stand for so many, so that the surveyed gate of 5,000 parts tickers.
BUSY = 10
#: The same for the boards, which rank every ticker of 200 contracts or more.
LED = 25


def _busy(spark: SparkSession, sf_dir: str, times: int = BUSY) -> DataFrame:
    return chain(spark, sf_dir).withColumns({c: F.col(c) * times for c in ("cA", "cB", "pA", "pB")})


@query("a5_market_sentiment", f"""WITH {LAST} SELECT ticker, call_vol, put_vol, round({_capped('call_vol', 'put_vol')}, 4) AS cp, round({_capped('cpa', 'cpb')},
  4) AS call_bs, round({_capped('ppa', 'ppb')}, 4) AS put_bs, call_vol + put_vol >= 5000 AS liquid, {LEGS}
  FROM (SELECT * REPLACE ({', '.join(f'{BUSY} * {c} AS {c}' for c in ('call_vol', 'put_vol', 'ca', 'cb', 'pa', 'pb'))}) FROM summary)""")
def a5_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.market_sentiment(O.chain_minute(_busy(spark, sf_dir))).drop("sentiment"), 4)


def _leaders_sql(mode: str) -> str:
    cp = f"greatest(-99, least({_legs('cpa', 'cpb', mode)} / nullif({_legs('ppa', 'ppb', mode)}, 0), 99))"
    return f"SELECT '{mode}' AS mode, ticker, {cp} AS cp FROM summary WHERE {LED} * (call_vol + put_vol) >= 5000"


@query("a6_sentiment_leaders", f"""WITH {LAST}, r AS ({' UNION ALL '.join(map(_leaders_sql, ('all', 'ask', 'net')))}), b AS (SELECT *, CASE WHEN cp > 2
  THEN 'bull' WHEN cp < 0.5 THEN 'bear' END AS board FROM r)
SELECT mode, board, CAST(rank AS INTEGER) AS rank, ticker, round(cp, 6) AS cp FROM (SELECT *, row_number() OVER (PARTITION BY mode, board ORDER BY CASE
  WHEN board = 'bull' THEN -cp ELSE cp END, ticker) AS rank FROM b WHERE board IS NOT NULL) WHERE rank <= 20""")
def a6_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards of all three side modes."""
    summary = O.market_sentiment(O.chain_minute(_busy(spark, sf_dir, LED)))
    boards = [O.sentiment_leaders(summary, m).withColumn("mode", F.lit(m)) for m in ("all", "ask", "net")]
    return rounded(boards[0].unionByName(boards[1]).unionByName(boards[2]))


def _totals_sql(mode: str) -> str:
    cp = f"greatest(-99, least({_legs('cpa', 'cpb', mode)} / nullif({_legs('ppa', 'ppb', mode)}, 0), 99))"
    return f"SELECT '{mode}' AS mode, ticker, date, {_legs('ca', 'cb', mode)} AS call, {_legs('pa', 'pb', mode)} AS put, round({cp}, 6) AS cp FROM days"


@query("a28_k2_chain_totals", f"""WITH {LAST}, w AS ({' UNION ALL '.join(map(_totals_sql, ('all', 'ask', 'net')))}),
p AS (SELECT *, k < spot AS b FROM near WHERE n <= 60), q AS (SELECT *, row_number() OVER (PARTITION BY ticker, date, b ORDER BY abs(k - spot), k) AS m,
  count(*) FILTER (WHERE b) OVER (PARTITION BY ticker, date) AS nb, count(*) FILTER (WHERE NOT b) OVER (PARTITION BY ticker, date) AS na FROM p),
t AS (SELECT *, least(10 + greatest(0, 10 - nb), na) AS ta FROM q), s AS (SELECT ticker, date, sum("cA") AS buy_call, sum("cB") AS sell_call,
  sum("pA") AS buy_put, sum("pB") AS sell_put FROM t WHERE CASE WHEN b THEN m <= least(10 + greatest(0, 10 - ta), nb) ELSE m <= ta END GROUP BY 1, 2)
SELECT w.*, buy_call, sell_call, buy_put, sell_put, round(CASE WHEN sell_call > 0 THEN buy_call / sell_call ELSE 0 END, 6)::DOUBLE AS call_bs, round(CASE
  WHEN sell_put > 0 THEN buy_put / sell_put ELSE 0 END, 6)::DOUBLE AS put_bs FROM w JOIN s USING (ticker, date)""")
def a28_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of every snapshot by all three side modes."""
    days = O.chain_minute(chain(spark, sf_dir))
    parts = [O.chain_totals(days, m).withColumn("mode", F.lit(m)) for m in ("all", "ask", "net")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("k2_centred_strikes", f"""WITH {CHAIN}, r AS (SELECT ticker, date, k AS strike, spot, k < spot AS b FROM chain), n AS (SELECT *, row_number()
  OVER (PARTITION BY ticker, date, b ORDER BY abs(strike - spot), strike) AS n, count(*) FILTER (WHERE b) OVER (PARTITION BY ticker, date) AS nb, count(*)
  FILTER (WHERE NOT b) OVER (PARTITION BY ticker, date) AS na FROM r),
t AS (SELECT *, least(3 + greatest(0, 3 - nb), na) AS ta FROM n) SELECT ticker, date, strike FROM t WHERE CASE WHEN b THEN n <= least(3 + greatest(0, 3 - ta),
  nb) ELSE n <= ta END""")
def k2_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chain(spark, sf_dir).select("ticker", "date", F.col("k").alias("strike"), "spot")
    return O.centred_strikes(c, ["ticker", "date"], 6).select("ticker", "date", "strike")


@query("f16_side_mode", f"""WITH {CHAIN} SELECT ticker, date, k, greatest("cA" - "cB", 0) AS "call", greatest("pA" - "pB", 0) AS put, greatest("cB" - "cA",
  0) AS call_sold, greatest("pB" - "pA", 0) AS put_sold,
  round(CASE WHEN "cB" > 0 THEN "cA" / "cB" WHEN "cA" > 0 THEN -1 END, 6) AS call_bs, round(CASE WHEN "pB" > 0 THEN "pA" / "pB" WHEN "pA" > 0 THEN -1 END,
  6) AS put_bs FROM chain""")
def f16_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An infinite ratio is shown as -1."""
    finite = lambda c: F.round(F.when(F.col(c) == float("inf"), -1.0).otherwise(F.col(c)), 6).alias(c)
    return O.side_mode(chain(spark, sf_dir), "net").select("ticker", "date", "k", "call", "put", "call_sold", "put_sold", finite("call_bs"), finite("put_bs"))


AS_OF = "2024-01-10"
OTM = "CASE WHEN type = 'CALL' THEN (strike - spot) / spot ELSE (spot - strike) / spot END"
DTE = f"(expiry - CAST({LOCAL} AS DATE))"
LOTTO = ["type IN ('CALL', 'PUT')", "issue_type = 'Common Stock'", "NOT multi_leg", "premium >= 1000", "size > oi", "ask_prem >= bid_prem AND ask_prem > 0", f"{DTE} BETWEEN 0 AND 14", f"expiry >= DATE '{AS_OF}'", f"{OTM} > 0 AND {OTM} BETWEEN 0.2 AND 1.0"]
SWEEPER = ["type IN ('CALL', 'PUT')", "issue_type = 'Common Stock'", "NOT multi_leg", "exec = 'SWEEP'", "premium >= 100000", "spot <= 13", "oi > 0 AND size >= 3 * oi", "ask_prem / nullif(premium, 0) BETWEEN 0.73 AND 1.0", f"{DTE} BETWEEN 0 AND 14", f"expiry >= DATE '{AS_OF}'", f"{OTM} > 0 AND {OTM} BETWEEN 0.0 AND 0.12"]


def _funnel(conditions: list[str], names: list[str]) -> str:
    return ", ".join(["count(*) AS \"all\"", *(f"count(*) FILTER (WHERE {' AND '.join(f'({c})' for c in conditions[: k + 1])}) AS {n}" for k, n in enumerate(names))])


@query("f9_lottos", f"""WITH {ALERTS} SELECT id, ticker, type, round(strike, 6) AS strike, round(premium, 4) AS premium FROM alerts
  WHERE {' AND '.join(f'({c})' for c in LOTTO)} ORDER BY time DESC, id LIMIT 200""")
def f9_lottos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.screen(alerts(spark, sf_dir), F.lit(AS_OF).cast("date"), "lotto").select("id", "ticker", "type", "strike", "premium"))


TAGGED = "CASE WHEN id % 97 = 0 THEN CAST(time - INTERVAL 5 HOUR AS DATE) END"


@query("f9_exact_lottos", f"""WITH {ALERTS}, t AS (SELECT * REPLACE (CASE WHEN id % 3 = 0 THEN 0 ELSE bid_prem END AS bid_prem, CASE WHEN id % 3 = 0
  THEN premium ELSE ask_prem END AS ask_prem), {TAGGED} AS tag FROM alerts) SELECT id, ticker, type FROM t
  WHERE ({' AND '.join(f'({c})' for c in [*LOTTO[:5], 'bid_prem = 0 AND ask_prem >= premium - 1', *LOTTO[6:]])}) OR tag = CAST({LOCAL} AS DATE)
  ORDER BY time DESC, id LIMIT 200""")
def f9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact form, on alerts of which a third is all on the ask side, with some tagged by hand."""
    third = F.col("id") % 3 == 0
    a = alerts(spark, sf_dir).withColumns({"bid_prem": F.when(third, 0.0).otherwise(F.col("bid_prem")), "ask_prem": F.when(third, F.col("premium")).otherwise(F.col("ask_prem")), "manual_lotto_date": F.when(F.col("id") % 97 == 0, M.local_date(F.col("time")))})
    return O.screen(a, F.lit(AS_OF).cast("date"), "lotto", exact=True).select("id", "ticker", "type")


@query("f10_sweepers", f"""WITH {ALERTS} SELECT id, ticker, type, round(strike, 6) AS strike, round(premium, 4) AS premium FROM alerts
  WHERE {' AND '.join(f'({c})' for c in SWEEPER)} ORDER BY time DESC, id LIMIT 200""")
def f10_sweepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.screen(alerts(spark, sf_dir), F.lit(AS_OF).cast("date"), "sweeper").select("id", "ticker", "type", "strike", "premium"))


def _relaxed(conditions: list[str], left_out: int) -> str:
    return f"count(*) FILTER (WHERE {' AND '.join(f'({c})' for k, c in enumerate(conditions) if k != left_out)})"


@query("f11_funnel", f"""WITH {ALERTS} SELECT {_funnel(LOTTO, ['type', 'common', 'single_leg', 'premium', 'size_over_oi', 'exec', 'dte', 'alive', 'otm'])},
  {_relaxed(LOTTO, 4)} AS alt_no_size_over_oi, {_relaxed(LOTTO, 8)} AS alt_no_otm FROM alerts""")
def f11_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.screen_funnel(alerts(spark, sf_dir), F.lit(AS_OF).cast("date"), "lotto")


@query("f7_f8_feed", f"""WITH {ALERTS} SELECT id, ticker, exec, round(premium, 4) AS premium FROM alerts WHERE side = 'BUY' AND exec = 'SWEEP'
  AND premium >= 50000 AND {OTM} > 0 AND rule LIKE 'rule%' AND {DTE} BETWEEN 0 AND 21""")
def f7_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.flow_feed(alerts(spark, sf_dir), side="BUY", min_premium=50_000, sweep_only=True, otm_only=True, rule_prefix="rule", dte=21).select("id", "ticker", "exec", "premium"))


SHAPE = f"issue_type = 'Common Stock' AND NOT multi_leg AND {DTE} <= 14 AND coalesce(all_opening, false) AND size > oi AND ask_prem >= bid_prem"


@query("f13_preset_shape", f"""WITH {ALERTS} SELECT 'lotto' AS preset, id FROM alerts WHERE {SHAPE} AND {OTM} BETWEEN 0.2 AND 1.0 AND premium >= 1000 UNION ALL
  SELECT 'sweeper', id FROM alerts WHERE {SHAPE} AND {OTM} BETWEEN 0.0 AND 0.12 AND premium >= 100000""")
def f13_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    return O.preset_shape(a, "lotto").select(F.lit("lotto").alias("preset"), "id").unionByName(O.preset_shape(a, "sweeper").select(F.lit("sweeper").alias("preset"), "id"))


@query("f4_f14_predicates", f"""WITH {ALERTS} SELECT id, CAST({LOCAL} AS DATE) AS et_date, dayofweek({LOCAL}) BETWEEN 1 AND 5
  AND CAST({LOCAL} AS TIME) >= TIME '09:30:00' AND CAST({LOCAL} AS TIME) < TIME '16:00:00' AS intraday,
  CASE WHEN abs(strike - spot) / spot <= 0.025 THEN 1.0 WHEN {OTM} > 0 THEN 1.5 ELSE 0.75 END::DOUBLE AS weight FROM alerts WHERE strike > 0""")
def f4_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir).filter("strike > 0")
    return a.select("id", M.local_date(F.col("time")).alias("et_date"), M.is_intraday(F.col("time")).alias("intraday"), M.moneyness_weight(F.col("type"), F.col("strike"), F.col("spot")).alias("weight"))


@query("f5_option_symbols", f"""WITH {ALERTS} SELECT id, ticker || strftime(expiry, '%y%m%d') || left(type,
  1) || lpad(CAST(CAST(floor(strike * 1000 + 0.5) AS BIGINT) AS VARCHAR), 8, '0') AS occ FROM alerts""")
def f5_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts(spark, sf_dir).select("id", M.option_symbol(F.col("ticker"), F.col("expiry"), F.col("type"), F.col("strike")).alias("occ"))


@query("a7_flow_stats", f"""WITH {ALERTS}, r AS (SELECT rule, count(*) AS n FROM alerts GROUP BY 1) SELECT count(*) AS n_alerts, count(*)
  FILTER (WHERE type = 'CALL') AS calls, count(*) FILTER (WHERE type = 'PUT') AS puts, round(sum(premium), 4) AS premium,
  round(count(*) FILTER (WHERE type = 'CALL') / count(*) FILTER (WHERE type = 'PUT'), 6) AS cp_ratio, (SELECT rule FROM r ORDER BY n DESC,
  rule DESC LIMIT 1) AS top_rule, CAST(floor((SELECT max(n) FROM r) * 100 / count(*) + 0.5) AS BIGINT) AS top_rule_pct FROM alerts""")
def a7_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.flow_stats(alerts(spark, sf_dir))
    return out.withColumns({"calls": F.col("calls").cast("long"), "puts": F.col("puts").cast("long"), "premium": F.round("premium", 4), "cp_ratio": F.round("cp_ratio", 6)})


@query("a8_sector_flow", f"""WITH {ALERTS} SELECT sector, round(sum(CASE WHEN sentiment = 'BEARISH' THEN -premium ELSE premium END), 4) AS net_premium,
  CAST(floor(sum(CASE WHEN type = 'CALL' THEN premium ELSE 0 END) * 100 / sum(premium) + 0.5) AS BIGINT) AS call_pct FROM alerts GROUP BY 1""")
def a8_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.sector_flow(alerts(spark, sf_dir)), 4)


@query("a10_net_impact", f"""WITH {ALERTS}, d AS (SELECT CAST({LOCAL} AS DATE) AS date, ticker, round(sum(CASE WHEN type = 'CALL' THEN ask_prem - bid_prem
  ELSE bid_prem - ask_prem END), 6) AS net FROM alerts GROUP BY 1, 2)
SELECT date, ticker, round(net, 4) AS net FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(net) DESC, ticker) AS n FROM d) WHERE n <= 10""")
def a10_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(O.net_impact(alerts(spark, sf_dir)), 4)


@query("d1_order_mining", f"""WITH {ALERTS}, {CALENDAR}, {SESSION}, px AS (SELECT ticker, feature_date AS date, arg_max(strike, id) AS close FROM sessions
  WHERE feature_date IS NOT NULL GROUP BY 1, 2),
r AS (SELECT ticker, date, lead(close, 1) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1 AS fwd_1 FROM px), a AS (SELECT s.*, fwd_1
  FROM sessions s JOIN r ON s.ticker = r.ticker AND s.feature_date = r.date),
c AS (SELECT date, row_number() OVER (ORDER BY date) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT feature_date AS date FROM a))
SELECT id, a.ticker, feature_date AS date, CAST(expiry - feature_date AS INTEGER) AS dte, round({OTM}, 6) AS otm_pct, round(size / greatest(oi, 1),
  6) AS vol_oi, round(ask_prem / nullif(ask_prem + bid_prem, 0), 6) AS ask_frac, round(log10(greatest(premium, 1)), 6) AS log_premium,
  round(CASE sentiment WHEN 'BULLISH' THEN fwd_1 ELSE -fwd_1 END, 6) + 0.0 AS pnl_1, coalesce(CASE sentiment WHEN 'BULLISH' THEN fwd_1 ELSE -fwd_1 END > 0,
  false)::INT AS win_1, CASE WHEN c.r - 1 < floor(c.n * (1 - 0.35::DOUBLE)) THEN 'mine' ELSE 'holdout' END AS split FROM a JOIN c ON a.feature_date = c.date""")
def d1_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, cal = alerts(spark, sf_dir), calendar(spark, sf_dir)
    px = O.add_feature_date(a, "time", cal).filter("feature_date is not null").groupBy("ticker", F.col("feature_date").alias("date")).agg(F.max_by("strike", "id").alias("close"))
    out = O.order_mining_set(a, cal, T.forward_returns(px, (1,)), (1,))
    return rounded(out.select("id", "ticker", "date", "dte", "otm_pct", "vol_oi", "ask_frac", "log_premium", "pnl_1", "win_1", "split"))


# --- prints --------------------------------------------------------------------------------------------------------

THRESHOLD = f"""{TRADES}, thr AS (SELECT ticker, premium AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, id) AS n
  FROM trades) WHERE n = 50)"""
KEPT = f"""{THRESHOLD}, kept AS (SELECT t.ticker, price, size, arg_min(id, seq + epoch(executed_at)::BIGINT * 1000000000) AS id FROM trades t JOIN thr
  USING (ticker) WHERE price * size >= threshold GROUP BY 1, 2, 3)"""


@query("a25_thresholds", f"WITH {THRESHOLD} SELECT ticker, round(threshold, 4) AS threshold FROM thr")
def a25_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.notional_thresholds(trades(spark, sf_dir)), 4)


@query("k1_trade_dedup", f"WITH {KEPT} SELECT ticker, id, round(price, 8) AS price, size FROM kept")
def k1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return P.filter_trades(t, P.notional_thresholds(t)).select("ticker", "id", F.round("price", 8).alias("price"), "size")


@query("a26_filter_stats", f"""WITH {KEPT} SELECT t.ticker, count(*) AS n_raw, count(threshold) AS n_known, count(*)
  FILTER (WHERE price * size >= threshold) AS n_large, coalesce(any_value(n), 0) AS n_unique
FROM trades t LEFT JOIN thr USING (ticker) LEFT JOIN (SELECT ticker, count(*) AS n FROM kept GROUP BY 1) u USING (ticker) GROUP BY 1""")
def a26_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return P.filter_stats(t, P.notional_thresholds(t))


@query("w24_rerank", f"""WITH {TRADES}, r AS (SELECT id, row_number() OVER (PARTITION BY ticker ORDER BY price * size DESC, executed_at DESC, id) AS rank
  FROM trades) SELECT id, CASE WHEN rank <= 200 THEN CAST(rank AS INTEGER) END AS rank, CASE WHEN rank <= 200 THEN round((201 - rank) / 2.0, 2)::DOUBLE
  END AS percentile FROM r""")
def w24_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.rerank(trades(spark, sf_dir)).select("id", "rank", F.col("percentile").cast("double").alias("percentile"))


@query("f12_print_feed", f"""WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY price * size DESC, executed_at DESC, id) AS rank
  FROM trades) SELECT id, ticker, CAST(rank AS INTEGER) AS rank FROM r WHERE rank BETWEEN 1 AND 5 AND ticker LIKE 'S1%' ORDER BY rank, executed_at DESC,
  id LIMIT 500""")
def f12_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.print_feed(P.rerank(trades(spark, sf_dir)), last=5, prefix="S1").select("id", "ticker", "rank")


@query("j11_insert_new", f"WITH {TRADES} SELECT count(*) AS n, count(DISTINCT id) AS n_ids FROM trades")
def j11_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    both = P.insert_new(t.filter("size < 30"), t.filter("size >= 20").unionByName(t.filter("size = 50")), "id")
    return both.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("j13_nearest_bar", f"""WITH {TRADES}, b AS (SELECT DISTINCT ticker, date_trunc('week', executed_at) AS bar_time FROM trades), p AS (SELECT id,
  t.ticker, executed_at, bar_time, abs(epoch(executed_at) - epoch(bar_time)) AS d FROM trades t JOIN b USING (ticker))
SELECT ticker, id, CAST(bar_time AS DATE) AS bar_date FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, bar_time) AS n FROM p) WHERE n = 1""")
def j13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    b = t.select("ticker", F.date_trunc("week", "executed_at").alias("bar_time")).distinct()
    return P.nearest_bar(t, b).select("ticker", "id", F.to_date("bar_time").alias("bar_date"))


@query("u3_retention", f"""WITH {TRADES}, {ALERTS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY price * size DESC, executed_at DESC,
  id) AS rank FROM trades), c AS (SELECT 'prints' AS sweep, executed_at >= TIMESTAMP '2001-10-05' OR rank <= 200 AS stay FROM r
UNION ALL SELECT 'flow', time >= TIMESTAMP '2024-01-01' FROM alerts UNION ALL SELECT 'heatmap', time >= TIMESTAMP '2024-01-31' FROM alerts)
SELECT sweep, count(*) FILTER (WHERE stay) AS n_kept, count(*) FILTER (WHERE NOT stay) AS n_deleted FROM c GROUP BY 1""")
def u3_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sweeps of prints, flow and heatmaps keep and delete."""
    at = lambda d: F.lit(d).cast("timestamp")
    ranked, a = P.rerank(trades(spark, sf_dir)), alerts(spark, sf_dir)
    out = P.sweep_counts(ranked, "executed_at", at("2001-11-04"), P.RETENTION["prints"], F.col("rank").isNotNull()).withColumn("sweep", F.lit("prints"))
    for name in ("flow", "heatmap"):
        out = out.unionByName(P.sweep_counts(a, "time", at("2024-03-01"), P.RETENTION[name]).withColumn("sweep", F.lit(name)))
    return out


@query("a24_corpus_stats", f"""WITH {TRADES} SELECT count(*) AS n_rows, CAST(min(executed_at) AS DATE) AS first, CAST(max(executed_at) AS DATE) AS last,
  count(DISTINCT ticker) AS n_tickers, count(DISTINCT CAST(executed_at AS DATE)) AS n_dates FROM trades""")
def a24_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.corpus_stats(trades(spark, sf_dir), "executed_at").withColumns({"first": F.to_date("first"), "last": F.to_date("last")})


@query("f3_normalise_prints", f"""WITH {TRADES} SELECT 'tape:' || ticker || ':' || CAST(CAST(executed_at AS DATE) AS VARCHAR) || ':' || id AS print_id,
  round(premium, 4) AS premium, ticker IN ('S1', 'S2') AS is_etf FROM trades""")
def f3_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.normalise_prints(trades(spark, sf_dir), ["S1", "S2"]).select("print_id", F.round("premium", 4).alias("premium"), "is_etf")
