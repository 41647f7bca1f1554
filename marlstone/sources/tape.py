"""The trade tape by days, read on from where each ticker's stored prints end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import read_trades

#: A cursor goes back so far at most: longer gaps are filled from the daily files as a whole.
MOST_HOURS = 24


def day_file(root: str, day: dt.date) -> str:
    """``<root>/2024/01/2024-01-05.csv.gz``"""
    return f"{root.rstrip('/')}/{day:%Y}/{day:%m}/{day:%Y-%m-%d}.csv.gz"


def day_files(spark: SparkSession, root: str, first: dt.date, last: dt.date) -> list[str]:
    """The files of a span of days that are there; days without trading have none."""
    paths = [day_file(root, first + dt.timedelta(days=k)) for k in range((last - first).days + 1)]
    conf, make = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    return [p for p in paths if (at := make(p)).getFileSystem(conf).exists(at)]


def read_days(spark: SparkSession, root: str, first: dt.date, last: dt.date, partitions: int | None = None) -> DataFrame | None:
    """Trades of a span of days; None if no day has a file."""
    paths = day_files(spark, root, first, last)
    return read_trades(spark, paths, partitions) if paths else None


def cursors(stored: DataFrame, universe: DataFrame, now: dt.datetime, most_hours: int = MOST_HOURS) -> DataFrame:
    """(ticker, since) for the universe: each ticker's last stored print, but ``most_hours`` before ``now`` at the earliest,
    which is also where a ticker without prints begins."""
    floor = F.lit(now - dt.timedelta(hours=most_hours)).cast("timestamp")
    last = stored.groupBy("ticker").agg(F.max("executed_at").alias("last"))
    return universe.select("ticker").distinct().join(last, "ticker", "left").select("ticker", F.greatest(F.coalesce("last", floor), floor).alias("since"))


def tape_since(spark: SparkSession, root: str, stored: DataFrame, universe: DataFrame, now: dt.datetime, most_hours: int = MOST_HOURS, partitions: int | None = None) -> DataFrame | None:
    """Trades of the universe from each ticker's cursor up to ``now`` (in UTC). Only the days since the earliest possible cursor are
    opened; a trade at the cursor itself comes again, and the sink passes it over. None if there are no files."""
    days = read_days(spark, root, (now - dt.timedelta(hours=most_hours)).date(), now.date(), partitions)
    if days is None:
        return None
    wanted = days.join(cursors(stored, universe, now, most_hours), "ticker")
    return wanted.filter((F.col("executed_at") >= F.col("since")) & (F.col("executed_at") <= F.lit(now).cast("timestamp"))).drop("since")
