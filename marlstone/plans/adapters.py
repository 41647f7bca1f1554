"""Domain tables from the driver's tables, in DataFrame form and as SQL for the oracle.

Both forms state the same mapping: trades are line items, bars are their daily aggregates, alerts are events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPOT = 100.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ticker, executed_at, price, size, premium; ``seq`` breaks ties of one day."""
    return read(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("id"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ticker"),
        F.col("l_shipdate").cast("timestamp").alias("executed_at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        F.col("l_extendedprice").alias("premium"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"),
    )


TRADES = """trades AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS id,
  'S' || l_suppkey AS ticker, l_shipdate AS executed_at,
    l_extendedprice / l_quantity AS price, l_quantity AS size, l_extendedprice AS premium, l_orderkey * 100 + l_linenumber AS seq
  FROM lineitem)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (ticker, date, open, high, low, close, volume, vwap, transactions)."""
    from ..operators.bars import bars_from_trades

    return bars_from_trades(trades(spark, sf_dir), F.to_date("executed_at"), by_ticker=True)


BARS = f"""{TRADES}, bars AS (
  SELECT ticker, CAST(executed_at AS DATE) AS date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, seq) AS close, sum(size) AS volume, sum(price * size) / sum(size) AS vwap, count(*) AS transactions
  FROM trades GROUP BY 1, 2)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option-flow alerts from events; all values follow from the event's type, value and k."""
    kind, k, v = F.col("event_type"), F.get_json_object("props", "$.k").cast("int"), F.col("value")
    base = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), kind.alias("kind"), k.alias("k"), v.alias("v"), F.col("user_id"))
    call, buy = F.col("kind").isin("signup", "view", "purchase"), F.col("kind").isin("signup", "click", "purchase")
    premium = F.round(F.col("v") * 10000, 2)
    ask = F.when(buy, premium * 0.8).otherwise(premium * 0.2)
    return base.select(
        "id",
        "time",
        "ticker",
        F.when(call, "CALL").otherwise("PUT").alias("type"),
        F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.when(call == buy, "BULLISH").otherwise("BEARISH").alias("sentiment"),
        F.when(F.col("k") % 4 == 0, "SWEEP").when(F.col("k") % 4 == 1, "FLOOR").when(F.col("k") % 4 == 2, "BLOCK").otherwise("SINGLE").alias("exec"),
        F.when(F.col("k") >= 70, "HIGH").when(F.col("k") >= 30, "MED").otherwise("LOW").alias("confidence"),
        premium.alias("premium"),
        ask.alias("ask_prem"),
        (premium - ask).alias("bid_prem"),
        F.when(F.col("k") % 3 == 0, 10.0).otherwise(SPOT).alias("spot"),
        (F.when(F.col("k") % 3 == 0, 10.0).otherwise(SPOT) * (1 + (F.col("k") - 50) / 100.0)).alias("strike"),
        F.date_add(F.to_date("time"), F.col("k") % 30).alias("expiry"),
        (F.col("k") * 5 + 1).cast("long").alias("size"),
        (100 - F.col("k")).cast("long").alias("oi"),
        F.concat(F.lit("sector"), F.col("user_id") % 11).alias("sector"),
        F.concat(F.lit("rule"), F.col("k") % 5).alias("rule"),
        F.when(F.col("k") % 10 != 9, F.col("k") % 2 == 0).alias("all_opening"),
        (F.col("k") % 7 == 0).alias("multi_leg"),
        F.when(F.col("k") % 5 == 0, "ETF").otherwise("Common Stock").alias("issue_type"),
    )


ALERTS = """events_k AS (
  SELECT event_id AS id, ts AS time, 'U' || user_id AS ticker, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    event_type IN ('signup', 'view', 'purchase') AS is_call, event_type IN ('signup', 'click', 'purchase') AS is_buy, round(value * 10000, 2) AS premium,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 3 = 0 THEN 10.0::DOUBLE ELSE 100.0::DOUBLE END AS spot
  FROM events),
alerts AS (
  SELECT id, time, ticker, CASE WHEN is_call THEN 'CALL' ELSE 'PUT' END AS type, CASE WHEN is_buy THEN 'BUY' ELSE 'SELL' END AS side,
    CASE WHEN is_call = is_buy THEN 'BULLISH' ELSE 'BEARISH' END AS sentiment,
    CASE k % 4 WHEN 0 THEN 'SWEEP' WHEN 1 THEN 'FLOOR' WHEN 2 THEN 'BLOCK' ELSE 'SINGLE' END AS exec,
    CASE WHEN k >= 70 THEN 'HIGH' WHEN k >= 30 THEN 'MED' ELSE 'LOW' END AS confidence, premium,
    CASE WHEN is_buy THEN premium * 0.8::DOUBLE ELSE premium * 0.2::DOUBLE END AS ask_prem,
    premium - CASE WHEN is_buy THEN premium * 0.8::DOUBLE ELSE premium * 0.2::DOUBLE END AS bid_prem,
    spot, spot * (1 + (k - 50) / 100.0::DOUBLE) AS strike, CAST(time AS DATE) + k % 30 AS expiry, CAST(k * 5 + 1 AS BIGINT) AS size,
  CAST(100 - k AS BIGINT) AS oi,
    'sector' || (user_id % 11) AS sector, 'rule' || (k % 5) AS rule, CASE WHEN k % 10 <> 9 THEN k % 2 = 0 END AS all_opening, k % 7 = 0 AS multi_leg,
    CASE WHEN k % 5 = 0 THEN 'ETF' ELSE 'Common Stock' END AS issue_type
  FROM events_k)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-strike option volumes, net premiums and premiums by side: (ticker, date, spot, k, cA, cB, pA, pB, cP, pP, cPA, ...)."""
    a = alerts(spark, sf_dir).withColumn("date", F.to_date("time")).withColumn("k", F.round(SPOT * F.col("strike") / F.col("spot"), 6))
    call, buy = F.col("type") == "CALL", F.col("side") == "BUY"
    pick = lambda c, x: F.sum(F.when(c, x).otherwise(0.0))
    size, signed = F.col("size").cast("double"), F.when(buy, F.col("premium")).otherwise(-F.col("premium"))
    return a.groupBy("ticker", "date", "k").agg(
        F.lit(SPOT).alias("spot"), pick(call & buy, size).alias("cA"), pick(call & ~buy, size).alias("cB"), pick(~call & buy, size).alias("pA"), pick(~call & ~buy, size).alias("pB"), pick(call, signed).alias("cP"), pick(~call, signed).alias("pP"),
        pick(call & buy, F.col("premium")).alias("cPA"), pick(call & ~buy, F.col("premium")).alias("cPB"), pick(~call & buy, F.col("premium")).alias("pPA"), pick(~call & ~buy, F.col("premium")).alias("pPB"),
    )


CHAIN = f"""{ALERTS}, chain AS (
  SELECT ticker, CAST(time AS DATE) AS date, 100.0::DOUBLE AS spot, round(100.0::DOUBLE * strike / spot, 6) AS k,
    sum(CASE WHEN type = 'CALL' AND side = 'BUY' THEN size::DOUBLE ELSE 0 END) AS "cA", sum(CASE WHEN type = 'CALL' AND side = 'SELL' THEN size::DOUBLE ELSE 0
  END) AS "cB",
    sum(CASE WHEN type = 'PUT' AND side = 'BUY' THEN size::DOUBLE ELSE 0 END) AS "pA", sum(CASE WHEN type = 'PUT' AND side = 'SELL' THEN size::DOUBLE ELSE 0
  END) AS "pB",
    sum(CASE WHEN type = 'CALL' THEN CASE side WHEN 'BUY' THEN premium ELSE -premium END ELSE 0 END) AS "cP",
    sum(CASE WHEN type = 'PUT' THEN CASE side WHEN 'BUY' THEN premium ELSE -premium END ELSE 0 END) AS "pP",
    sum(CASE WHEN type = 'CALL' AND side = 'BUY' THEN premium ELSE 0 END) AS "cPA", sum(CASE WHEN type = 'CALL' AND side = 'SELL' THEN premium ELSE 0
  END) AS "cPB",
    sum(CASE WHEN type = 'PUT' AND side = 'BUY' THEN premium ELSE 0 END) AS "pPA", sum(CASE WHEN type = 'PUT' AND side = 'SELL' THEN premium ELSE 0
  END) AS "pPB"
  FROM alerts GROUP BY 1, 2, 4)"""


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading days (date): the weekdays from the first to the last event."""
    span = read(spark, sf_dir, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("date")).filter(~F.dayofweek("date").isin(1, 7))


CALENDAR = """calendar AS (
  SELECT date FROM (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS DATE) AS date FROM events)
  WHERE dayofweek(date) NOT IN (0, 6))"""


def position_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open, add, trim and close messages of a (moderator, contract) key; errors aren't messages."""
    return read(spark, sf_dir, "events").filter("event_type <> 'error'").select(
        F.concat(F.lit("m"), F.col("user_id")).alias("key"),
        F.col("event_id").alias("message_id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.expr("CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'add' WHEN 'click' THEN 'trim' ELSE 'close' END").alias("action"),
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") - 50).alias("pct"),
        F.expr("CASE CAST(get_json_object(props, '$.k') AS INT) % 4 WHEN 1 THEN 0.25D WHEN 2 THEN 0.75D END").alias("frac_hint"),
        F.expr("CASE CAST(get_json_object(props, '$.k') AS INT) % 4 WHEN 0 THEN 'Large' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Lotto' ELSE 'Small' END").alias("size_label"),
        F.concat(F.lit("m"), F.col("user_id")).alias("ticker"),
        F.expr("CASE WHEN user_id % 3 = 0 THEN 'equity' ELSE 'option' END").alias("asset_type"),
        F.expr("CASE user_id % 3 WHEN 0 THEN 'LONG' WHEN 1 THEN 'CALL' ELSE 'PUT' END").alias("side"),
        F.expr("CASE WHEN user_id % 3 <> 0 THEN user_id % 40 + 0.5D END").alias("strike"),
        F.expr("CASE WHEN user_id % 3 <> 0 THEN '3/15' END").alias("expiry_label"),
        F.expr("CASE WHEN user_id % 3 <> 0 THEN DATE '2024-03-15' END").alias("expiry"),
        F.concat(F.lit("mod"), F.col("user_id") % 4).alias("moderator"),
        (F.col("event_id") % 7 == 0).alias("hidden"),
    )


MESSAGES = """msg AS (
  SELECT 'm' || user_id AS key, event_id AS message_id, ts AS t_,
    CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'add' WHEN 'click' THEN 'trim' ELSE 'close' END AS action, value AS price,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50 AS pct,
    CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 END::DOUBLE AS hint,
    CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'Large' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Lotto' ELSE 'Small' END AS size_label,
    CASE WHEN user_id % 3 = 0 THEN 'equity' ELSE 'option' END AS asset_type, event_id % 7 = 0 AS hidden,
    CASE WHEN user_id % 3 = 0 THEN 'm' || user_id ELSE '$' || (user_id % 40 + 0.5) || CASE WHEN user_id % 3 = 2 THEN 'P' ELSE 'C' END || ' 3/15'
  END AS contract,
    'mod' || (user_id % 4) AS moderator
  FROM events WHERE event_type <> 'error')"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a chat would bring them: titles, contracts, prices, per cents and labels as text, some of them odd."""
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    e = read(spark, sf_dir, "events")
    pick = lambda n, *values: F.expr(f"CASE {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END")
    return e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"),
        F.expr("CASE event_type WHEN 'signup' THEN '** BUY TO OPEN **' WHEN 'view' THEN 'ADD to it' WHEN 'click' THEN 'SCALE OUT half' WHEN 'purchase' THEN 'SELL TO CLOSE' ELSE 'good morning' END").alias("title"),
        pick(f"{k} % 7", "'spy 400c'", "' QQQ  350.5 P '", "'AMD'", "'SPY 400 calendar'", "'BRK.B 10p'", "'$TSLA 200c'", "'LONGNAME 5c'").alias("contract"),
        pick(f"{k} % 6", "'7/20'", "'1/3'", "'2/30'", "'12/19/25'", "'next week'", "''").alias("expiration"),
        pick(f"{k} % 5", "concat('$1,0', event_id % 90 + 10)", "'.85'", "'$.85'", "'n/a'", "'12.'").alias("entry_price"),
        pick(f"{k} % 4", "'2.50'", "'$0.05 each'", "NULL", "'1e1'").alias("exit_price"),
        pick(f"{k} % 3", "'+12.5%'", "'- 3 %'", "NULL").alias("pct"), pick(f"{k} % 6", "' large '", "'L'", "'med'", "'Medium'", "'lotto ticket'", "NULL").alias("size"),
        pick(f"{k} % 5", "'25 % off'", "'a third of it'", "NULL", "'150%'", "'QUARTER'").alias("notes"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'option' ELSE 'equity' END").alias("asset_type"), F.expr("CASE WHEN user_id % 5 > 0 THEN concat(' mod', user_id % 5, ' ') END").alias("moderator"),
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, report_date, eps_estimate, eps_actual, move_1d, market_cap) from orders."""
    return read(spark, sf_dir, "orders").groupBy(F.concat(F.lit("C"), F.col("o_custkey")).alias("ticker"), F.to_date("o_orderdate").alias("report_date")).agg(
        F.round(F.min("o_totalprice") / 1e5, 4).alias("eps_estimate"), F.round(F.avg("o_totalprice") / 1e5, 4).alias("eps_actual"), F.round(F.max("o_totalprice") % 17 - 8, 4).alias("move_1d"), F.sum("o_totalprice").alias("market_cap")
    )


EARNINGS = """earnings AS (
  SELECT 'C' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS report_date, round(min(o_totalprice) / 1e5, 4) AS eps_estimate,
  round(avg(o_totalprice) / 1e5, 4) AS eps_actual,
    round(max(o_totalprice) % 17 - 8, 4) AS move_1d, sum(o_totalprice) AS market_cap
  FROM orders GROUP BY 1, 2)"""


def raw_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as a provider would send them: text and flags, some of them missing."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    premium = F.round(F.col("value") * 10000, 2)
    symbol = F.concat(F.upper(F.concat(F.lit("u"), F.col("user_id"))), F.date_format(F.date_add(F.to_date("ts"), k % 30), "yyMMdd"), F.when(k % 2 == 0, "C").otherwise("P"), F.lpad((k * 1000 + 500).cast("string"), 8, "0"))
    return e.select(
        F.when(F.col("event_id") % 50 != 0, F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 41 != 0, F.concat(F.lit(" u"), F.col("user_id"))).alias("ticker"), F.col("ts").cast("timestamp").alias("created_at"),
        F.when(k % 7 != 0, symbol).alias("option_chain"), F.when(k % 2 == 0, F.date_add(F.to_date("ts"), 9).cast("string")).alias("expiry"), (k + 0.5).cast("string").alias("strike"),
        F.when(k % 5 != 0, (premium * 0.6).cast("string")).alias("total_ask_side_prem"), F.when(k % 3 != 0, (premium * F.when(k % 4 == 1, 0.7).otherwise(0.2)).cast("string")).alias("total_bid_side_prem"), premium.cast("string").alias("total_premium"),
        (k % 4 == 0).alias("has_sweep"), (k % 6 == 0).alias("has_floor"), (k % 9 == 0).alias("has_multileg"), F.when(k % 8 != 0, k % 9 != 0).alias("has_singleleg"), (k / 10.0).cast("string").alias("volume_oi_ratio"),
        (k * 5).cast("string").alias("volume"), (100 - k).cast("string").alias("open_interest"), F.lit("100.0").alias("underlying_price"), F.when(k % 10 != 0, F.concat(F.lit("rule"), k % 5)).alias("alert_rule"),
        F.when(k % 10 != 9, k % 2 == 0).alias("all_opening_trades"), F.when(k % 4 != 3, "Common Stock").alias("issue_type"), F.when(k % 3 == 0, " Building ").when(k % 3 == 1, "mining").alias("sector"),
    )
