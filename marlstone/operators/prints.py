"""Block prints: from the trade tape to a ranked corpus, its feed, clean-up and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.market import is_intraday, local_date
from .bars import newest_per_key

TOP = 200


def notional_thresholds(prints: DataFrame, k: int = 50) -> DataFrame:
    """The ``k``-th largest premium of each ticker; tickers with fewer prints have none."""
    order = W.partitionBy("ticker").orderBy(F.desc("premium"), "id")
    return prints.withColumn("n", F.row_number().over(order)).filter(F.col("n") == k).select("ticker", F.col("premium").alias("threshold"))


def filter_trades(trades: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Trades of known tickers at or over their threshold, the earliest of each (ticker, price, size).

    The thresholds are one row for each ticker of the universe: Spark broadcasts them by their size, so that the tape
    is filtered before any shuffle. ``min_by`` aggregates partially, so that a busy round lot is no hot key.
    """
    kept = trades.join(thresholds, "ticker").filter(F.col("price") * F.col("size") >= F.col("threshold"))
    columns = [c for c in trades.columns if c not in ("ticker", "price", "size")]
    first = F.min_by(F.struct(*columns), F.struct("executed_at", "seq")).alias("x")
    return kept.groupBy("ticker", "price", "size").agg(first).select("ticker", "price", "size", "x.*")


def filter_stats(trades: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Rows of each ticker after every stage of ``filter_trades``."""
    seen = trades.join(thresholds, "ticker", "left")
    known, large = F.col("threshold").isNotNull(), F.col("price") * F.col("size") >= F.col("threshold")
    counts = seen.groupBy("ticker").agg(F.count("*").alias("n_raw"), F.count_if(known).alias("n_known"), F.count_if(large).alias("n_large"))
    unique = filter_trades(trades, thresholds).groupBy("ticker").agg(F.count("*").alias("n_unique"))
    return counts.join(unique, "ticker", "left").na.fill(0, ["n_unique"])


def normalise_prints(raw: DataFrame, etfs: list[str] = ()) -> DataFrame:
    """Prints with premium (price times size unless given), session and ETF flags, and an id that holds for one UTC day."""
    premium = F.coalesce(F.col("premium"), F.col("price") * F.col("size"))
    inside = is_intraday(F.col("executed_at"))
    key = F.concat_ws(":", F.lit("tape"), "ticker", F.to_date("executed_at").cast("string"), F.col("id").cast("string"))
    return raw.withColumns({"premium": premium, "is_intraday": inside, "is_extended": ~inside, "is_etf": F.col("ticker").isin(list(etfs)), "print_id": key})


def rerank(prints: DataFrame, top: int = TOP) -> DataFrame:
    """rank by price times size (then the newer first) and its percentile for the first ``top`` of a ticker; null beyond.
    One shuffle: the window carries every row."""
    order = W.partitionBy("ticker").orderBy(F.desc(F.col("price") * F.col("size")), F.desc("executed_at"), "id")
    n = prints.drop("rank", "percentile").withColumn("rank", F.row_number().over(order))
    n = n.withColumn("rank", F.when(F.col("rank") <= top, F.col("rank")))
    return n.withColumn("percentile", F.round((top + 1 - F.col("rank")) / 2.0, 2))


def rank_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose rank or percentile isn't what it was."""
    old = before.select("id", F.col("rank").alias("rank_0"), F.col("percentile").alias("percentile_0"))
    return after.join(old, "id", "left").filter(~(F.col("rank").eqNullSafe(F.col("rank_0")) & F.col("percentile").eqNullSafe(F.col("percentile_0")))).drop("rank_0", "percentile_0")


def print_feed(prints: DataFrame, first: int = 1, last: int = 100, prefix: str | None = None, hide_etf: bool = False, session: str = "all", by: str = "rank", limit: int = 500) -> DataFrame:
    """Ranked prints of a rank window, by rank or newest first. ``session`` is regular or extended, as the client reads it."""
    out = prints.filter(F.col("rank").between(first, last))
    if prefix:
        out = out.filter(F.col("ticker").startswith(prefix.upper()))
    if hide_etf:
        out = out.filter(~F.col("is_etf"))
    if session != "all":
        inside = is_intraday(F.col("executed_at"))
        out = out.filter(inside if session == "regular" else ~inside)
    order = ["rank", F.desc("executed_at"), "id"] if by == "rank" else [F.desc("executed_at"), "id"]
    return out.orderBy(*order).limit(limit)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """``existing`` and the first incoming row of each key that it hasn't."""
    fresh = newest_per_key(incoming, [key], F.col(key)).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def drop_overlap(prints: DataFrame, start: Column, end: Column, source: str = "tape:") -> DataFrame:
    """Without rows of other sources inside the span that the canonical one covers; a null id is of another source."""
    other = ~F.coalesce(F.col("print_id").startswith(source), F.lit(False))
    covered = F.coalesce((F.col("executed_at") >= start) & (F.col("executed_at") < end), F.lit(False))
    return prints.filter(~(other & covered))


def nearest_bar(prints: DataFrame, bars: DataFrame) -> DataFrame:
    """The bar of the ticker closest in time to each print, the earlier one on ties: one sort of both, no range join."""
    p = prints.select("ticker", F.col("executed_at").alias("t"), "id", F.lit(None).cast("timestamp").alias("bar"))
    b = bars.select("ticker", F.col("bar_time").alias("t"), F.lit(None).cast(dict(prints.dtypes)["id"]).alias("id"), F.col("bar_time").alias("bar"))
    order = W.partitionBy("ticker").orderBy("t", F.col("bar").isNull())
    back, ahead = F.last("bar", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)), F.first("bar", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    both = p.unionByName(b).withColumns({"prev": back, "next": ahead}).filter("id is not null")
    us = lambda a, b: F.unix_micros(a) - F.unix_micros(b)
    closer = F.when(F.col("prev").isNull(), F.col("next")).when(F.col("next").isNull(), F.col("prev")).when(us(F.col("t"), F.col("prev")) <= us(F.col("next"), F.col("t")), F.col("prev")).otherwise(F.col("next"))
    return both.select("ticker", "id", closer.alias("bar_time"))


def keep_recent(rows: DataFrame, ts_col: str, as_of: Column, days: int, exempt: Column | None = None) -> DataFrame:
    """Rows not older than ``days`` days at ``as_of``, and the exempt ones."""
    stay = F.col(ts_col) >= as_of - F.make_dt_interval(F.lit(days))
    return rows.filter(stay if exempt is None else stay | F.coalesce(exempt, F.lit(False)))


#: Days that each table keeps.
RETENTION = {"flow": 60, "prints": 30, "heatmap": 30, "sentiment": 30, "hits": 30}


def sweep_counts(rows: DataFrame, ts_col: str, as_of: Column, days: int, exempt: Column | None = None) -> DataFrame:
    """(n_kept, n_deleted) of a retention sweep."""
    stay = F.coalesce(F.col(ts_col) >= as_of - F.make_dt_interval(F.lit(days)), F.lit(False))
    stay = stay if exempt is None else stay | F.coalesce(exempt, F.lit(False))
    return rows.agg(F.count_if(stay).alias("n_kept"), F.count_if(~stay).alias("n_deleted"))


def corpus_stats(rows: DataFrame, ts_col: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.min(ts_col).alias("first"), F.max(ts_col).alias("last"), F.count_distinct("ticker").alias("n_tickers"), F.count_distinct(F.to_date(ts_col)).alias("n_dates"))


def check_modelable(matrix: DataFrame, min_rows: int = 10_000, min_dates: int = 60) -> DataFrame:
    """Whether a matrix has the rows and dates that a model needs."""
    s = matrix.agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"))
    return s.withColumn("passed", (F.col("n_rows") >= min_rows) & (F.col("n_dates") >= min_dates))


def sessions_of(prints: DataFrame) -> DataFrame:
    """Prints and premium of each New York day by session."""
    return prints.groupBy(local_date(F.col("executed_at")).alias("date"), is_intraday(F.col("executed_at")).alias("regular")).agg(F.count("*").alias("n"), F.sum("premium").alias("premium"))
