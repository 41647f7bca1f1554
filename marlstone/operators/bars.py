"""Bars: from trades, by week, and how they are normalised and upserted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import week_end


def bars_from_trades(trades: DataFrame, period: Column, by_ticker: bool = False) -> DataFrame:
    """(ticker, executed_at, price, size, seq) -> one bar for each ticker and period, in one pass with partial aggregation.

    ``by_ticker`` is for trades of which few make a bar, so that partial sums save nothing: they are brought to their ticker
    once, and the bars and the windows and grouped passes over a ticker that follow need no other shuffle or sort.
    """
    order = F.struct("executed_at", "seq")
    rows = trades.select("ticker", period.alias("date"), "executed_at", "price", "size", "seq")
    rows = rows.repartition("ticker").sortWithinPartitions("ticker", "date") if by_ticker else rows
    return rows.groupBy("ticker", "date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("size").alias("volume"), (F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"), F.count("*").alias("transactions"),
    )


def weekly(bars: DataFrame) -> DataFrame:
    """Daily bars -> weeks that end on Friday, dated by it."""
    return bars.groupBy("ticker", week_end(F.col("date")).alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume")
    )


def newest_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the first in the given order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both tables' rows by key; a new row replaces the old one. Keys must be unique in ``new``."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    return newest_per_key(both, keys, F.desc("_p")).drop("_p")


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Provider bars (ticker, t in epoch ms, n for the order of arrival, ...) -> dated bars, the last of a date kept."""
    dated = raw.withColumn("date", F.to_date(F.timestamp_millis("t")))
    return newest_per_key(dated, ["ticker", "date"], F.desc("n")).drop("t", "n")


def latest_per_ticker(rows: DataFrame, value: Column, by: Column) -> DataFrame:
    return rows.groupBy("ticker").agg(F.max_by(value, by).alias("value"))
