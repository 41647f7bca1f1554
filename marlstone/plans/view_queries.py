"""Queries of views, extracts and sinks that read back what they wrote, and of detectors called from SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.store import fresh_path
from ..operators import detectors, flow, gamma, hitlist
from ..sources import io, stored, tape
from .adapters import ALERTS, BARS, CALENDAR, CHAIN, alerts, bars, calendar, chain, read
from .desk_queries import CELLS, DAY, _cells, _ranked
from .flow_queries import SESSION
from .registry import query, rounded


@query(
    "s1_load_candles",
    f"""WITH {BARS} SELECT ticker, date, round(close, 6) AS close, volume FROM bars WHERE ticker IN ('S1', 'S7', 'S40') AND date BETWEEN DATE '1998-03-01'
  AND DATE '1999-02-28'""",
)
def s1_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written by ticker, and read for some tickers and a span of dates."""
    path = fresh_path(spark, "candles")
    io.write_candles(bars(spark, sf_dir), path)
    return rounded(io.load_candles(spark, path, ["S1", "S7", "S40"], "1998-03-01", "1999-02-28").select("ticker", "date", "close", "volume"))


@query(
    "s6_tape_cursor",
    """WITH t AS (SELECT 'U' || user_id AS ticker, event_id AS id, ts, value, event_type FROM events WHERE CAST(ts AS DATE) <> DATE '2024-01-13'),
c AS (
  SELECT ticker, greatest(coalesce(max(ts) FILTER (event_type = 'purchase' AND ts <= TIMESTAMP '2024-01-14 15:00:00'), TIMESTAMP '2024-01-12'), TIMESTAMP '2024-01-12 18:00:00') AS since
  FROM t GROUP BY 1
) SELECT ticker, count(*) AS n, round(sum(value), 4) AS total, min(id) AS first FROM t JOIN c USING (ticker)
WHERE ts BETWEEN since AND TIMESTAMP '2024-01-14 18:00:00' AND ts >= TIMESTAMP '2024-01-12 18:00:00' AND value IS NOT NULL GROUP BY 1""",
)
def s6_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trades in daily files, of which one day has none; purchases up to an afternoon are stored, and the tape is
    read on from there, 48 hours back at most."""
    root, at = fresh_path(spark, "tape-days"), F.col("ts").cast("timestamp")
    e = read(spark, sf_dir, "events").withColumn("ticker", F.concat(F.lit("U"), F.col("user_id")))
    t = e.select(F.lit("").alias("conditions"), "ticker", F.lit(7).alias("trf_id"), F.unix_micros(at).alias("us"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.9).alias("size"), F.to_date("ts").alias("day"))
    t = t.withColumn("sip_timestamp", F.col("us") * 1000 + 999).drop("us")
    for k in (10, 11, 12, 14, 15):
        day = dt.date(2024, 1, k)
        t.filter(F.col("day") == F.lit(day)).drop("day").write.option("header", True).csv(tape.day_file(root, day), compression="gzip")
    now, cut = dt.datetime(2024, 1, 14, 18, tzinfo=dt.UTC), F.lit("2024-01-14 15:00:00").cast("timestamp")
    stored_ = e.filter((F.col("event_type") == "purchase") & (at <= cut) & (F.to_date("ts") != F.lit("2024-01-13").cast("date"))).select("ticker", at.alias("executed_at"))
    new = tape.tape_since(spark, root, stored_, e, now, most_hours=48)
    return rounded(new.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.min(F.col("id").cast("long")).alias("first")), 4)


@query(
    "s9_day_archive",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS value FROM events
WHERE CAST(ts AS DATE) < DATE '2024-01-25' AND CAST(ts AS DATE) >= DATE '2024-01-15' AND CAST(ts AS DATE) <> DATE '2024-01-20' GROUP BY 1""",
)
def s9_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten days as gzipped JSON lines, of which one is there already; archived twice, and read back."""
    root = fresh_path(spark, "archive")
    e, there = read(spark, sf_dir, "events").select("event_id", "ts", "value"), spark.sql("SELECT DATE '2024-01-20' AS day")
    days = io.archive_days(e, "ts", root, F.lit("2024-01-25").cast("date"), existing=there)
    io.archive_days(e, "ts", root, F.lit("2024-01-25").cast("date"), existing=there.union(spark.read.json(root).select(F.col("day").cast("date")).distinct()))
    back = spark.read.json(root).groupBy(F.col("day").cast("date").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rounded(back.join(days, "day", "left_semi"), 2)


@query(
    "s10_artifacts",
    """SELECT o_orderpriority AS priority, fmt, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('parquet'), ('csv'), ('json')) f(fmt)
  GROUP BY 1, 2""",
)
def s10_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an artifact of each format, read back with the types of the extract."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = None
    for fmt in ("parquet", "csv", "json"):
        path = fresh_path(spark, f"artifact-{fmt}")
        io.write_artifacts(o, path, fmt)
        back = io.extract_table(spark.read.format(fmt).option("header", "true").load(path), {"o_orderkey": "long", "o_orderpriority": "string", "o_totalprice": "double"})
        g = back.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).withColumn("fmt", F.lit(fmt))
        out = g if out is None else out.unionByName(g)
    return rounded(out, 2)


@query(
    "j2_flow_features",
    f"""WITH {ALERTS}, {CALENDAR}, {SESSION}, m AS (SELECT t.ticker, c.date FROM (SELECT DISTINCT ticker FROM alerts) t, calendar c),
f AS (
  SELECT ticker, feature_date AS date, count(*) AS n, sum(premium) AS p, avg(CAST(expiry - feature_date AS INTEGER)) AS dte, avg(all_opening::INT) AS opening
  FROM sessions WHERE feature_date IS NOT NULL GROUP BY 1, 2
), d AS (SELECT ticker, feature_date AS date, count(*) AS n, max(premium) AS p FROM sessions WHERE feature_date IS NOT NULL AND premium >= 400000 GROUP BY 1, 2)
SELECT ticker, date, coalesce(f.n, 0)::DOUBLE AS flow_alert_count, round(coalesce(f.p, 0), 4) AS flow_total_premium, round(f.dte, 6) AS flow_avg_dte,
  round(f.opening, 6) AS flow_opening_frac, CAST(f.n IS NOT NULL AS INTEGER) AS has_flow, coalesce(d.n, 0)::DOUBLE AS dp_print_count,
  round(coalesce(d.p, 0), 4) AS dp_max_premium, CAST(d.n IS NOT NULL AS INTEGER) AS has_dp
FROM m LEFT JOIN f USING (ticker, date) LEFT JOIN d USING (ticker, date)""",
)
def j2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ticker on every session, with its flow and block prints: counts and sums without a row are 0, means stay null."""
    a, cal = alerts(spark, sf_dir), calendar(spark, sf_dir)
    m = a.select("ticker").distinct().withColumn("all", F.lit(1)).join(cal.withColumn("all", F.lit(1)), "all").drop("all")
    prints = a.filter("premium >= 400000").withColumn("executed_at", F.col("time"))
    out = flow.join_flow_features(m, flow.aggregate_flow(a, cal), flow.aggregate_prints(prints, cal))
    out = out.withColumns({"flow_total_premium": F.round("flow_total_premium", 4), "dp_max_premium": F.round("dp_max_premium", 4)})
    return rounded(out.select("ticker", "date", "flow_alert_count", "flow_total_premium", "flow_avg_dte", "flow_opening_frac", "has_flow", "dp_print_count", "dp_max_premium", "has_dp"))


@query(
    "a13_heatmap_rows",
    f"""WITH {CELLS}, c AS (SELECT * FROM cells SEMI JOIN ok USING (ticker))
SELECT ticker, strike, CAST(count(*) AS INTEGER) AS n, min(CAST(expiry AS VARCHAR)) AS first, round(arg_min(net_oi, expiry), 4) AS net_first,
  round(arg_max(net_oi, expiry), 4) AS net_last
FROM c GROUP BY 1, 2""",
)
def a13_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pivoted form: a strike's cells by expiry in a map."""
    cells = gamma.heatmap_cells(_cells(spark, sf_dir), ["ticker"])
    rows = gamma.heatmap_rows(cells.withColumn("net_dv", F.lit(0.0)) if "net_dv" not in cells.columns else cells, ["ticker"])
    keys = F.sort_array(F.map_keys("by_exp"))
    at = lambda k: F.element_at("by_exp", F.element_at(keys, k))["net_oi"]
    return rounded(rows.select("ticker", "strike", F.size("by_exp").alias("n"), F.element_at(keys, 1).alias("first"), at(1).alias("net_first"), at(-1).alias("net_last")), 4)


@query(
    "a28_chosen_minute",
    f"""WITH {CHAIN}, m AS (SELECT *, '09:31' AS t FROM chain UNION ALL SELECT * REPLACE ("cA" * 2 AS "cA"), '15:59' AS t FROM chain WHERE k >= 90),
p AS (SELECT DISTINCT ticker, date, CASE WHEN CAST(substr(ticker, 2) AS INTEGER) % 2 = 0 THEN '09:31' ELSE '12:00' END AS ask FROM chain),
l AS (SELECT ticker, date, max(t) AS last FROM m GROUP BY 1, 2)
SELECT ticker, date, m.t AS t, sum("cA" + "cB") AS call, sum("pA" + "pB") AS put FROM m JOIN p USING (ticker, date) JOIN l USING (ticker, date)
WHERE m.t = CASE WHEN ask = '09:31' THEN ask ELSE last END GROUP BY 1, 2, 3""",
)
def a28_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals at a minute that half of the tickers ask for; the others ask for one that isn't there and get the last."""
    c = chain(spark, sf_dir)
    m = c.withColumn("t", F.lit("09:31")).unionByName(c.filter("k >= 90").withColumns({"cA": F.col("cA") * 2, "t": F.lit("15:59")}))
    strikes = F.collect_list(F.struct("k", "cA", "cB", "pA", "pB", "cPA", "cPB", "pPA", "pPB")).alias("strikes")
    minutes = m.groupBy("ticker", "date", "t").agg(F.max("spot").alias("spot"), strikes)
    days = minutes.groupBy("ticker", "date").agg(F.sort_array(F.collect_list(F.struct("t", "spot", "strikes"))).alias("minutes"))
    even = F.substring("ticker", 2, 9).cast("int") % 2 == 0
    parts = [flow.minute_of(days.filter(even), F.lit("09:31")), flow.minute_of(days.filter(~even), F.lit("12:00"))]
    shown = parts[0].unionByName(parts[1])
    return flow.chain_totals(shown.drop("t")).select("ticker", "date", "call", "put").join(shown.select("ticker", "date", "t"), ["ticker", "date"])


@query(
    "d3_stored_days",
    f"""WITH {CHAIN}, s AS (
  SELECT ticker, date, sum("cA" + "cB") AS call, sum("pA" + "pB") AS put, sum("cPA" + "cPB") AS cp, sum("pPA" + "pPB") AS pp FROM chain GROUP BY 1, 2
), r AS (SELECT *, CASE WHEN date >= DATE '2024-01-15' THEN cp / nullif(pp, 0) ELSE call / nullif(put, 0) END AS ratio FROM s)
SELECT ticker, date, '15:59' AS t, call, put, round(greatest(-99, least(99, ratio)), 6) AS cp FROM r""",
)
def d3_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days stored as variants, of which those before the 15th have no premiums by side: ratios go by volume there."""
    path, old = fresh_path(spark, "stored-days"), F.col("date") < F.lit("2024-01-15")
    c = chain(spark, sf_dir)
    strike = F.struct("k", "cA", "cB", "pA", "pB", "cP", "pP", *[F.when(~old, F.col(p)).alias(p) for p in ("cPA", "cPB", "pPA", "pPB")])
    days = c.groupBy("ticker", "date").agg(F.max("spot").alias("spot"), F.collect_list(strike).alias("strikes"))
    first = F.struct(F.lit("09:31").alias("t"), F.slice("strikes", 1, 1).alias("strikes"))
    minutes = F.to_json(F.array(first, F.struct(F.lit("15:59").alias("t"), F.col("strikes"))))
    broken = days.limit(1).select(F.lit("BAD").alias("ticker"), "date", "spot", F.lit("[{").alias("minutes"))
    stored.write_whole(stored.as_variant(days.select("ticker", "date", "spot", minutes.alias("minutes")).unionByName(broken), "minutes"), path)
    last = stored.stored_minute(spark.read.parquet(path))
    return rounded(flow.chain_totals(last.drop("t")).select("ticker", "date", "call", "put", "cp").join(last.select("ticker", "date", "t"), ["ticker", "date"]))


@query(
    "a13_stored_heatmaps",
    f"""WITH {CELLS} SELECT ticker, strike, expiry, round(net_oi, 4) AS net_oi, CAST(count(*) OVER (PARTITION BY ticker, strike) AS INTEGER) AS n FROM cells
  SEMI JOIN ok USING (ticker)""",
)
def a13_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heatmaps stored as variants, strikes with maps by expiry, and their cells again."""
    path = fresh_path(spark, "heatmaps")
    cells = gamma.heatmap_cells(_cells(spark, sf_dir), ["ticker"]).withColumn("net_dv", F.lit(0.0))
    rows = gamma.heatmap_rows(cells, ["ticker"])
    by = F.transform_values("by_exp", lambda _, c: F.struct(c["net_oi"].alias("netOI"), c["net_dv"].alias("netDV")))
    snaps = rows.groupBy("ticker", "spot").agg(F.collect_list(F.struct("strike", by.alias("byExp"))).alias("strikes"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit("2024-01-19").alias("date"), F.lit(2).alias("dte"))).alias("expirations"), "strikes"))
    stored.write_whole(stored.as_variant(snaps.select("ticker", "spot", F.lit(DAY).cast("timestamp").alias("captured_at"), text.alias("cells")), "cells"), path)
    back = stored.stored_cells(spark.read.parquet(path)).filter("n_exp = 1 and v_oi is null")
    again = gamma.heatmap_rows(back, ["ticker"]).select("ticker", "strike", F.size("by_exp").alias("n"), F.explode("by_exp").alias("expiry", "c"))
    return rounded(again.select("ticker", "strike", F.col("expiry").cast("date").alias("expiry"), F.col("c.net_oi").alias("net_oi"), "n"), 4)


@query(
    "j7_best_print",
    f"""WITH {ALERTS}, r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY premium DESC, time DESC, id) AS rank FROM alerts),
b AS (
  SELECT ticker, min(rank) AS rank, arg_min(time, rank) AS time, arg_min(premium, rank) AS premium FROM r
  WHERE rank <= 200 AND time >= TIMESTAMP '{DAY}' + INTERVAL 15 HOUR - INTERVAL 48 HOUR GROUP BY 1
) SELECT ticker, CAST(rank AS INTEGER) AS print_rank, CASE WHEN time >= TIMESTAMP '{DAY}' + INTERVAL 5 HOUR THEN 'today' ELSE 'yesterday' END AS print_age,
  round(premium, 4) AS print_premium FROM b""",
)
def j7_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ticker's best ranked print of the 48 hours before a morning."""
    return rounded(hitlist.best_print(_ranked(spark, sf_dir), F.lit(f"{DAY} 15:00:00").cast("timestamp")), 4)


@query(
    "j8_live_snapshot",
    """WITH s AS (SELECT 'U' || user_id AS ticker, ts AS t, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS n_exp FROM events),
g AS (
  SELECT ticker, max(t) FILTER (WHERE n_exp >= 2 AND t > TIMESTAMP '2024-01-20' - INTERVAL 24 HOUR) AS good, max(t) AS last
  FROM s WHERE t <= TIMESTAMP '2024-01-20' GROUP BY 1
) SELECT ticker, epoch_us(coalesce(good, last)) AS captured_us FROM g WHERE coalesce(good, last) >= TIMESTAMP '2024-01-20' - INTERVAL 72 HOUR""",
)
def j8_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that every ticker shows without a chosen time, as it was on the 20th."""
    kind = F.get_json_object("props", "$.k").cast("int") % 4
    e = read(spark, sf_dir, "events").select(F.concat(F.lit("U"), F.col("user_id")).alias("ticker"), F.col("ts").cast("timestamp").alias("captured_at"), kind.alias("n_exp"))
    requests = e.select("ticker", F.lit(None).cast("timestamp").alias("at")).distinct()
    return gamma.snapshot_as_of(e, requests, F.lit("2024-01-20").cast("timestamp")).select("ticker", F.unix_micros("captured_at").alias("captured_us"))


def _outside(bars: dict) -> list[tuple]:
    """Bars that reach over the one before at both ends, by their close: a detector of two lines."""
    high, low, close = bars["high"], bars["low"], bars["close"]
    return [(t, "long" if close[t] > close[t - 1] else "short", high[t] - low[t]) for t in range(1, len(close)) if high[t] > high[t - 1] and low[t] < low[t - 1]]


@query(
    "p10_sql_detector",
    f"""WITH {BARS}, p AS (
  SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)
) SELECT ticker, date, 'outside' AS detector, CASE WHEN close > pc THEN 'long' ELSE 'short' END AS side, round(high - low, 6) AS strength FROM p
  WHERE high > ph AND low < pl""",
)
def p10_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector of one's own, registered and called from SQL as a table function."""
    detectors.register_detector("outside", _outside)
    try:
        detectors.register_sql(spark, "detect_events")
    finally:
        del detectors.STATEFUL["outside"]
    needed = bars(spark, sf_dir).select("ticker", "date", "open", "high", "low", "close", "volume", F.lit(1.0).alias("atr_14"))
    needed.createOrReplaceTempView("detector_bars")
    found = spark.sql("SELECT * FROM detect_events(TABLE(detector_bars), 'outside')")
    return rounded(found.select("ticker", "date", "detector", "side", "strength"))
