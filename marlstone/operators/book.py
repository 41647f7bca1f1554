"""Gains, earnings and ticker metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import newest_per_key

def monthly_gains(rows: DataFrame) -> DataFrame:
    """Sum of each month, the running sum, and the total."""
    m = rows.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.sum("gain").alias("gain"))
    return m.withColumns({"cumulative": F.sum("gain").over(W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("gain").over(W.partitionBy())})


# --- earnings ------------------------------------------------------------------------------------------------------


def earnings_rollup(history: DataFrame, as_of: Column, quarters: int = 12) -> DataFrame:
    """Of a ticker's last completed quarters: mean absolute move, beats and their number."""
    done = history.filter((F.col("report_date") < as_of) & F.col("eps_actual").isNotNull())
    last = done.withColumn("n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("report_date")))).filter(F.col("n") <= quarters)
    return last.groupBy("ticker").agg(F.avg(F.abs("move_1d")).alias("avg_move"), F.count_if(F.col("eps_actual") >= F.col("eps_estimate")).alias("beats"), F.count("*").alias("quarters"))


def earnings_calendar(pre: DataFrame, post: DataFrame, universe: DataFrame, first: Column, last: Column) -> DataFrame:
    """Reports of both sweeps in the window for tickers of the universe with options; one row for each key, post wins."""
    both = pre.withColumn("session", F.lit("pre")).unionByName(post.withColumn("session", F.lit("post")))
    able = universe.filter(F.col("has_options") & (F.col("is_index") | F.col("tracked"))).select("ticker")
    rows = both.filter(F.col("report_date").between(first, last)).join(able, "ticker", "left_semi")
    return newest_per_key(rows, ["ticker", "report_date"], F.col("session")).orderBy("report_date", F.desc("market_cap"))


def earnings_focus(history: DataFrame, as_of: Column, most: int = 16) -> DataFrame:
    """The next report of each ticker, or else the last one, and its recent history, newest first."""
    ahead = F.col("report_date") >= as_of
    focus = history.groupBy("ticker").agg(F.min(F.when(ahead, F.col("report_date"))).alias("next"), F.max(F.when(~ahead, F.col("report_date"))).alias("last"))
    recent = history.filter(~ahead).withColumn("n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("report_date")))).filter(F.col("n") <= most)
    rows = recent.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("report_date", "eps_actual")), asc=False).alias("history"))
    return focus.join(rows, "ticker", "left").withColumn("focus", F.coalesce("next", "last"))


def _screener_keys(by: str) -> list[Column]:
    keys = {"date": [F.col("report_date"), F.desc("market_cap")], "sector": [F.coalesce("sector", F.lit("z"))], "move": [F.desc(F.coalesce("implied_move", F.lit(-1.0)))], "watched": [F.desc("watched"), F.col("report_date")]}
    return [*keys[by], F.col("ticker"), F.col("report_date")]


def earnings_order(events: DataFrame, by: str) -> DataFrame:
    """Screener order: by date and size, sector (none last), implied move (none last), watched first."""
    return events.orderBy(*_screener_keys(by))


def screener_places(events: DataFrame) -> DataFrame:
    """The place of each event of a screen in all four orders; a screen shows some hundred events."""
    return events.withColumns({f"by_{k}": F.row_number().over(W.orderBy(*_screener_keys(k))).cast("long") for k in ("date", "sector", "move", "watched")})


def stale_histories(events: DataFrame, refreshed: DataFrame, as_of: Column, most: int = 80) -> DataFrame:
    """Tickers with a report of the last 7 days or to come, not refreshed for 5 days; the first ``most`` by name."""
    fresh = refreshed.filter(F.col("refreshed_at") > F.date_sub(as_of, 5)).select("ticker")
    return events.filter(F.col("report_date") >= F.date_sub(as_of, 7)).select("ticker").distinct().join(fresh, "ticker", "left_anti").orderBy("ticker").limit(most)


# --- metadata ------------------------------------------------------------------------------------------------------


def resolve_sector(rows: DataFrame, overrides: DataFrame, names: DataFrame) -> DataFrame:
    """Sector by override, or by the normalised raw name, or Technology, marked as unresolved."""
    out = rows.join(overrides.select("ticker", F.col("sector").alias("_o")), "ticker", "left")
    out = out.join(names.select(F.col("raw").alias("_raw"), F.col("sector").alias("_n")), F.lower(F.trim(F.col("raw_sector"))) == F.col("_raw"), "left")
    out = out.withColumn("unresolved", F.col("_o").isNull() & F.col("_n").isNull())
    return out.withColumn("sector", F.coalesce("_o", "_n", F.lit("Technology"))).drop("_o", "_n", "_raw")


def retag(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Stored rows whose resolved sector isn't theirs."""
    new = resolved.select("ticker", F.col("sector").alias("new_sector")).distinct()
    return stored.join(new, "ticker").filter(~F.col("sector").eqNullSafe(F.col("new_sector")))


def unresolved_tickers(stored: DataFrame, resolved: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` tickers of unresolved sector with the most stored rows: (ticker, n_rows)."""
    open_ = resolved.filter("unresolved").select("ticker").distinct()
    return stored.join(open_, "ticker", "left_semi").groupBy("ticker").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "ticker").limit(n)


def etf_flips(stored: DataFrame, etfs: DataFrame) -> DataFrame:
    """Stored rows whose ``is_etf`` isn't what the list of funds says, with the flag they should have."""
    known = etfs.select("ticker").distinct().withColumn("_etf", F.lit(True))
    out = stored.join(known, "ticker", "left").withColumn("new_is_etf", F.coalesce("_etf", F.lit(False))).drop("_etf")
    return out.filter(~F.col("is_etf").eqNullSafe(F.col("new_is_etf")))


def ticker_universe(watched: DataFrame, alerts: DataFrame, prints: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Distinct tickers that are watched or were seen in the last days."""
    recent = lambda df, ts: df.filter(F.col(ts) >= F.date_sub(as_of, days)).select("ticker")
    return watched.select("ticker").union(recent(alerts, "time")).union(recent(prints, "executed_at")).distinct()


def latest_sector(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("ticker").agg(F.max_by("sector", F.struct("time", "id")).alias("sector"))
