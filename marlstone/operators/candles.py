"""Candle quality and repair, and what an incremental load still needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import per_ticker
from .bars import newest_per_key


def quality_flags(bars: DataFrame, universe: DataFrame, start: Column, end: Column) -> DataFrame:
    """Rows, span and problems of every ticker of the universe, also of those without a bar."""
    bad_volume = F.coalesce(F.col("volume") <= 0, F.lit(True))
    bad_price = F.coalesce(F.least("open", "high", "low", "close") <= 0, F.lit(True)) | F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    g = bars.groupBy("ticker").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max(bad_volume).alias("zv"), F.max(bad_price).alias("zp"))
    out = universe.select("ticker").distinct().join(g, "ticker", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    span = F.greatest(F.datediff("last_date", "first_date"), F.lit(1))
    have = F.col("rows") > 0
    marks = [("empty", ~have), ("short_history", have & (F.col("first_date") > F.date_add(start, 30))), ("stale", have & (F.col("last_date") < F.date_sub(end, 10))), ("gaps", have & (F.col("rows") < 0.95 * span * 252 / 365)), ("zero_volume_rows", F.coalesce("zv", F.lit(False))), ("zero_price_rows", F.coalesce("zp", F.lit(False)))]
    flags = F.array_compact(F.array(*[F.when(c, n) for n, c in marks]))
    return out.select("ticker", "rows", "first_date", "last_date", flags.alias("flags"))


def build_manifest(bars: DataFrame, universe: DataFrame, start: Column, end: Column, as_of: Column) -> DataFrame:
    return quality_flags(bars, universe, start, end).withColumns({"flags": F.array_join("flags", ";"), "last_updated": as_of}).orderBy("ticker")


def new_bars_only(manifest: DataFrame, incoming: DataFrame, full_start: Column) -> DataFrame:
    """Incoming bars from the day after a ticker's last one on; from ``full_start`` for tickers without bars."""
    cut = manifest.select("ticker", F.coalesce(F.date_add("last_date", 1), full_start).alias("cut"))
    return incoming.join(cut, "ticker", "left").filter(F.col("date") >= F.coalesce("cut", full_start)).drop("cut")


def split_at_largest_gap(bars: DataFrame, min_gap_days: int = 45) -> DataFrame:
    """Adds the segment (pre or post) on either side of a ticker's largest gap, the first of equal ones; null without
    a gap of ``min_gap_days``."""
    gap = F.datediff("date", F.lag("date").over(per_ticker()))
    seams = newest_per_key(bars.select("ticker", "date", gap.alias("gap")).filter("gap is not null"), ["ticker"], F.desc("gap"), F.col("date"))
    seams = seams.filter(F.col("gap") >= min_gap_days).select("ticker", F.col("date").alias("seam"), "gap")
    return bars.join(seams, "ticker", "left").withColumn("segment", F.when(F.col("date") >= F.col("seam"), "post").when(F.col("seam").isNotNull(), "pre"))


def trim_reused(bars: DataFrame, min_gap_days: int = 45) -> tuple[DataFrame, DataFrame]:
    """Reused symbols keep what follows the gap, if that is the longer part; and a report of what was done."""
    split = split_at_largest_gap(bars, min_gap_days)
    key = W.partitionBy("ticker")
    split = split.withColumns({"n_pre": F.count_if(F.col("segment") == "pre").over(key), "n_post": F.count_if(F.col("segment") == "post").over(key)})
    trim = F.col("seam").isNotNull() & (F.col("n_post") > F.col("n_pre"))
    report = split.groupBy("ticker").agg(F.first("seam").alias("seam"), F.first("gap").alias("gap"), F.first("n_pre").alias("n_pre"), F.first("n_post").alias("n_post"))
    status = F.when(F.col("seam").isNull(), "no-seam").when(F.col("n_post") > F.col("n_pre"), "trimmed").otherwise("refused:tail-seam")
    return split.filter(~trim | (F.col("segment") == "post")).select(*bars.columns), report.withColumn("status", status)


def stitch(bars: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) symbols: the old one's bars before the new one's first are relabelled; and a report of each seam.

    A seam is clean if the prices' ratio lies between 0.67 and 1.5 and the gap is at most 7 days.
    """
    first = bars.groupBy(F.col("ticker").alias("new")).agg(F.min("date").alias("start"), F.min_by("close", "date").alias("after"))
    old = bars.join(renames.select(F.col("old").alias("ticker"), "new"), "ticker").join(first, "new").filter(F.col("date") < F.col("start"))
    seams = old.groupBy("new").agg(F.max("date").alias("last_old"), F.max_by("close", "date").alias("before"), F.first("start").alias("start"), F.first("after").alias("after"))
    ratio = F.round(F.col("after") / F.col("before"), 4)
    seams = seams.select(F.col("new").alias("ticker"), ratio.alias("ratio"), F.datediff("start", "last_old").alias("gap_days"))
    seams = seams.withColumn("clean", F.col("ratio").between(0.67, 1.5) & (F.col("gap_days") <= 7))
    kept = bars.join(renames.select(F.col("old").alias("ticker")), "ticker", "left_anti")
    moved = old.withColumn("ticker", F.col("new")).select(*bars.columns)
    return kept.unionByName(moved), seams


def drop_tickers(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    return rows.join(tickers.select("ticker"), "ticker", "left_anti")


def missing_days(universe: DataFrame, first: Column, last: Column, existing: DataFrame) -> DataFrame:
    """(ticker, date) pairs of weekdays that ``existing`` lacks. Each ticker makes its own days: no join of all with all."""
    days = F.filter(F.sequence(first, last), lambda d: ~F.dayofweek(d).isin(1, 7))
    return universe.select("ticker", F.explode(days).alias("date")).join(existing.select("ticker", "date"), ["ticker", "date"], "left_anti")


def high_52w(bars: DataFrame, as_of: Column) -> DataFrame:
    return bars.filter((F.col("date") > F.date_sub(as_of, 364)) & (F.col("date") <= as_of)).groupBy("ticker").agg(F.max("high").alias("high_52w"))


def price_header(bars: DataFrame, as_of: Column) -> DataFrame:
    """Last close, change from the one before (0 if there is none), distance under the 52-week high in per cent."""
    recent = bars.filter(F.col("date") <= as_of).withColumn("n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("date"))))
    g = recent.groupBy("ticker").agg(F.max(F.when(F.col("n") == 1, F.col("close"))).alias("last"), F.max(F.when(F.col("n") == 2, F.col("close"))).alias("prev"), F.max(F.when(F.col("date") > F.date_sub(as_of, 364), F.col("high"))).alias("high_52w"))
    prev = F.coalesce("prev", "last")
    return g.select("ticker", "last", (F.col("last") - prev).alias("change"), ((F.col("last") / prev - 1) * 100).alias("change_pct"), ((1 - F.col("last") / F.col("high_52w")) * 100).alias("below_high_pct"))


def latest_session(bars: DataFrame, last: int = 200) -> DataFrame:
    """Of the newest ``last`` rows of a ticker, those on the newest one's day."""
    n = bars.withColumn("_n", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("bar_time")))).filter(F.col("_n") <= last)
    newest = F.max(F.to_date("bar_time")).over(W.partitionBy("ticker"))
    return n.withColumn("_d", newest).filter(F.to_date("bar_time") == F.col("_d")).drop("_n", "_d")
