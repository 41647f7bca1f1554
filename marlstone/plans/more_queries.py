"""Further queries: predictions, overlaps, sessions, marks, live aggregates and extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import book, candles, evaluation, hitlist, prints
from ..operators import technicals as T
from ..sources import io
from ..streaming import streams
from .adapters import ALERTS, BARS, EARNINGS, TRADES, alerts, bars, earnings, read, trades
from .registry import query, rounded
from .technical_queries import BASE


@query("j12_drop_overlap", f"""WITH {TRADES} SELECT ticker, count(*) AS n FROM trades WHERE NOT (size < 25 AND executed_at >= TIMESTAMP '1998-01-01'
  AND executed_at < TIMESTAMP '1999-01-01') GROUP BY 1""")
def j12_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small trades count as another source here."""
    t = trades(spark, sf_dir).withColumn("print_id", F.when(F.col("size") >= 25, F.concat(F.lit("tape:"), F.col("id"))).otherwise(F.col("id")))
    at = lambda d: F.lit(d).cast("timestamp")
    return prints.drop_overlap(t, at("1998-01-01"), at("1999-01-01")).groupBy("ticker").agg(F.count("*").alias("n"))


@query("k6_k13_ranked_prints", f"""WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY price * size DESC, executed_at DESC,
  id) AS rank FROM trades) SELECT ticker, CAST(rank AS INTEGER) AS rank, id FROM r WHERE rank <= 10 AND executed_at >= TIMESTAMP '2000-01-01'""")
def k6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.rerank(trades(spark, sf_dir)).filter((F.col("rank") <= 10) & (F.col("executed_at") >= F.lit("2000-01-01").cast("timestamp"))).select("ticker", "rank", "id")


@query("k8_latest_session", f"""WITH {ALERTS}, n AS (SELECT ticker, time, id, row_number() OVER (PARTITION BY ticker ORDER BY time DESC) AS n FROM alerts)
  SELECT ticker, id FROM n WHERE n <= 200 QUALIFY CAST(time AS DATE) = max(CAST(time AS DATE)) OVER (PARTITION BY ticker)""")
def k8_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.latest_session(alerts(spark, sf_dir).withColumnRenamed("time", "bar_time")).select("ticker", "id")


@query("k11_available_dates", f"WITH {BARS} SELECT DISTINCT date FROM bars ORDER BY date DESC LIMIT 30")
def k11_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hitlist.available_dates(bars(spark, sf_dir))


@query("h9_update_marks", f"""WITH {ALERTS}, q AS (SELECT ticker, arg_max(premium, id) AS mark FROM alerts GROUP BY 1)
  SELECT 'U' || s_suppkey AS contract_occ, round(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE mark END, 4) AS entry_price, round(coalesce(mark, s_acctbal),
  4) AS last_price FROM supplier LEFT JOIN q ON q.ticker = 'U' || s_suppkey""")
def h9_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = alerts(spark, sf_dir).groupBy(F.col("ticker").alias("occ")).agg(F.max_by("premium", "id").alias("mark"))
    hits = read(spark, sf_dir, "supplier").select(F.concat(F.lit("U"), F.col("s_suppkey")).alias("contract_occ"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("entry_price"), F.col("s_acctbal").alias("last_price"))
    return rounded(hitlist.update_marks(hits, marks), 4)


@query("j5_k7_predictions", f"""WITH {BASE}, p AS (SELECT ticker, date, volume / 100 AS p_long, close, atr_14 FROM i3 WHERE date >= DATE '2001-01-01'
  ORDER BY p_long DESC, ticker, date LIMIT 50) SELECT ticker, date, round(p_long, 6) AS p_long, round(close, 8) AS entry,
  round(close + 1.5 * atr_14, 4) AS long_target, round(close - atr_14, 4) AS long_stop, round(close - 1.5 * atr_14, 4) AS short_target, round(close + atr_14,
  4) AS short_stop FROM p""")
def j5_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume stands in for a score."""
    b = bars(spark, sf_dir)
    p = b.select("ticker", "date", (F.col("volume") / 100).alias("p_long"), (F.col("date") >= "2001-01-01").alias("is_oos"))
    out = evaluation.predictions_table(evaluation.top_entries(p, "long", 50), T.with_recursions(b, want=("atr_14",)))
    levels = [F.round(c, 4).alias(c) for c in ("long_target", "long_stop", "short_target", "short_stop")]
    return out.select("ticker", "date", F.round("p_long", 6).alias("p_long"), F.round("entry", 8).alias("entry"), *levels)


@query(
    "j6_events_with_labels",
    f"""WITH {BARS}, f AS (
  SELECT ticker, date, lead(close) OVER (PARTITION BY ticker ORDER BY date) > close AS up, coalesce(close > open, false) AS ev, coalesce(close < open,
  false) AS dn FROM bars
) SELECT ev AS rise_long, dn AS rise_short, count(*) AS n, count(*) FILTER (WHERE up) AS n_up FROM f GROUP BY 1, 2""",
)
def j6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises and falls within a day as a detector's events, on all bars with the next one's direction."""
    b = bars(spark, sf_dir)
    way = F.when(F.col("close") > F.col("open"), "long").when(F.col("close") < F.col("open"), "short")
    events = b.select("ticker", "date", F.lit("rise").alias("detector"), way.alias("side")).filter("side is not null")
    out = evaluation.join_events(T.forward_returns(b, (1,)), events, ["rise"])
    return out.groupBy("rise_long", "rise_short").agg(F.count("*").alias("n"), F.count_if(F.col("fwd_1") > 0).alias("n_up"))


@query("r3_tide_buckets", """WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, arg_max(value,
  CAST(epoch_us(ts) AS HUGEINT) * 100000000 + event_id) AS net_premium, count(*) AS n FROM events GROUP BY 1) SELECT epoch_us(bucket) AS bucket_us,
  round(net_premium, 4) AS net_premium, n FROM b""")
def r3_tide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("net_premium"), F.col("value").alias("volume"))
    return streams.tide_buckets(e).select(F.unix_micros("bucket").alias("bucket_us"), F.round("net_premium", 4).alias("net_premium"), "n")


@query("r9_live_flow", f"""WITH {ALERTS} SELECT CAST(time - INTERVAL 5 HOUR AS DATE) AS date, ticker, count(*) AS n, round(sum(premium), 4) AS premium
  FROM alerts GROUP BY 1, 2""")
def r9_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(streams.live_flow(alerts(spark, sf_dir)), 4)


@query("r4_snapshots", f"""WITH {ALERTS}, m AS (SELECT ticker, CAST(time AS DATE) AS date, strftime(time, '%H:%M') AS t, max(id) AS id FROM alerts GROUP BY 1,
  2, 3) SELECT ticker, date, count(*) AS n_minutes, max(id) AS last_id FROM m GROUP BY 1, 2""")
def r4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir).groupBy("ticker", F.to_date("time").alias("date"), F.date_format("time", "HH:mm").alias("t")).agg(F.max("id").alias("id"))
    out = io.append_snapshot(a.filter("id % 2 = 0"), a)
    return out.select("ticker", "date", F.size("minutes").cast("long").alias("n_minutes"), F.array_max(F.transform("minutes", lambda m: m["id"])).alias("last_id"))


@query("s8_extract_table", """SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, round(l_extendedprice, 4) AS l_extendedprice,
  TRY_CAST(l_returnflag AS BIGINT) AS l_returnflag FROM lineitem""")
def s8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(io.extract_table(read(spark, sf_dir, "lineitem"), {"l_orderkey": "bigint", "l_shipdate": "date", "l_extendedprice": "double", "l_returnflag": "bigint"}), 4)


@query("k10_screener_order", f"""WITH {EARNINGS}, w AS (SELECT ticker, report_date, market_cap, CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 5 > 0
  THEN 's' || (CAST(substr(ticker, 2) AS INTEGER) % 5) END AS sector, CASE WHEN eps_actual > 1 THEN move_1d END AS implied_move, CAST(substr(ticker,
  2) AS INTEGER) % 7 = 0 AS watched FROM earnings WHERE report_date BETWEEN DATE '2001-01-01' AND DATE '2001-01-31')
SELECT ticker, report_date, round(market_cap, 2) AS market_cap, row_number() OVER (ORDER BY report_date, market_cap DESC, ticker) AS by_date, row_number()
  OVER (ORDER BY coalesce(sector, 'z'), ticker, report_date) AS by_sector, row_number() OVER (ORDER BY coalesce(implied_move, -1) DESC, ticker,
  report_date) AS by_move, row_number() OVER (ORDER BY watched DESC, report_date, ticker) AS by_watched FROM w""")
def k10_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's reports with their places in all four orders."""
    n = F.substring("ticker", 2, 9).cast("int")
    window = earnings(spark, sf_dir).filter("report_date between '2001-01-01' and '2001-01-31'").withColumns({"sector": F.when(n % 5 > 0, F.concat(F.lit("s"), n % 5)), "implied_move": F.when(F.col("eps_actual") > 1, F.col("move_1d")), "watched": n % 7 == 0})
    return rounded(book.screener_places(window).select("ticker", "report_date", "market_cap", "by_date", "by_sector", "by_move", "by_watched"), 2)


@query("u2_retag", f"WITH {ALERTS} SELECT ticker, count(*) AS n FROM alerts WHERE sector <> 'sector1' AND CAST(substr(ticker, 2) AS INTEGER) % 2 = 0 GROUP BY 1")
def u2_retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = alerts(spark, sf_dir)
    resolved = a.select("ticker").distinct().filter(F.substring("ticker", 2, 9).cast("int") % 2 == 0).withColumn("sector", F.lit("sector1"))
    return book.retag(a, resolved).groupBy("ticker").agg(F.count("*").alias("n"))


@query("s5_timeframe_bars", """WITH e AS (SELECT 'U' || user_id AS ticker, ts, event_id, value FROM events), f AS (SELECT ticker, ts, event_id, value,
  '5m' AS timeframe, time_bucket(INTERVAL 5 MINUTE, ts) AS bar_time FROM e UNION ALL SELECT ticker, ts, event_id, value, '1h', time_bucket(INTERVAL 1 HOUR,
  ts) FROM e UNION ALL SELECT ticker, ts, event_id, value, '1d', time_bucket(INTERVAL 1 DAY, ts) FROM e)
SELECT ticker, timeframe, epoch_us(bar_time) AS bar_us, round(arg_min(value, event_id), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low,
  round(arg_max(value, event_id), 6) AS close, count(*) AS n FROM f GROUP BY 1, 2, 3""")
def s5_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of three widths, stored up to some moment within one of each; the bars since, the forming ones anew, replace them."""
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.col("ts").cast("timestamp").alias("time"), "event_id", "value")

    def made(rows: DataFrame) -> DataFrame:
        parts = [rows.groupBy("ticker", F.lit(n).alias("timeframe"), F.window("time", w)["start"].alias("bar_time")).agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("n")) for n, w in (("5m", "5 minutes"), ("1h", "1 hour"), ("1d", "1 day"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    moment = F.lit("2024-01-15 10:17:00").cast("timestamp")
    out = B.upsert(made(e.filter(F.col("time") < moment)), made(e.filter(F.col("time") >= F.date_trunc("day", moment))), ["ticker", "timeframe", "bar_time"])
    return rounded(out.select("ticker", "timeframe", F.unix_micros("bar_time").alias("bar_us"), "open", "high", "low", "close", "n"))


@query("s3_normalise_bars", f"""WITH {TRADES}, d AS (SELECT ticker, CAST(executed_at AS DATE) AS date, price, seq FROM trades) SELECT ticker, date,
  round(arg_max(price, seq), 8) AS close FROM d GROUP BY 1, 2""")
def s3_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades stand in for a provider's bars: several a day, stamped in milliseconds, of which the last to arrive is kept."""
    raw = trades(spark, sf_dir).select("ticker", (F.unix_millis("executed_at") + 3_600_000).alias("t"), F.col("seq").alias("n"), F.round("price", 8).alias("close"))
    return B.normalise_bars(raw).select("ticker", "date", "close")


@query("s10_wide_integers", "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey FROM lineitem")
def s10_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return io.wide_integers(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_partkey"])
