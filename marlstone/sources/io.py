"""Sources and sinks: candles, trade files, ranked corpora, relational extracts, day archives, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_SCHEMA = "ticker string, id string, price double, size double, sip_timestamp long, conditions string, exchange int, trf_id int"


def write_candles(bars: DataFrame, path: str) -> None:
    """Bars as Parquet in the order of ticker and date: a ticker lies in one file, and each file's statistics say which
    tickers and dates are where. There is no folder for a ticker, as files would then grow with tickers times tasks."""
    bars.repartition("ticker").sortWithinPartitions("ticker", "date").write.parquet(path)


def load_candles(spark: SparkSession, path: str, tickers: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the given tickers and dates (both ends included); the filters reach the Parquet scan."""
    out = spark.read.parquet(path)
    if tickers is not None:
        out = out.filter(F.col("ticker").isin(*tickers))
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Tickers of a text file, one or more a line by commas; blanks, comments and the heading are passed over."""
    words = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(F.explode(F.split("value", ",")).alias("w"))
    return words.select(F.upper(F.trim("w")).alias("ticker")).filter("ticker <> '' and ticker <> 'TICKER'").distinct()


def read_trades(spark: SparkSession, path: str | list[str], partitions: int | None = None) -> DataFrame:
    """Daily trade files (.csv.gz), whose columns are told by their headings. A gzip file is one task; ``partitions`` deals
    its rows on.

    Rows without ticker, id, finite price and size, or whole timestamp are left out; sizes are whole, times are micros from
    nanos. Only the columns that are used are parsed.
    """
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    one = lambda f: (F.col(f.split()[0]).try_cast(f.split()[1]) if f.split()[0] in raw.columns else F.lit(None).cast(f.split()[1])).alias(f.split()[0])
    raw = raw.select(*[one(f) for f in TRADE_SCHEMA.split(", ")])
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    out = raw.filter(F.col("ticker").isNotNull() & (F.col("ticker") != "") & F.col("id").isNotNull() & finite("price") & finite("size") & F.col("sip_timestamp").isNotNull())
    out = out.withColumns({"executed_at": F.timestamp_micros(F.expr("sip_timestamp div 1000")), "size": F.floor("size").cast("double"), "seq": F.col("sip_timestamp")})
    return out.repartition(partitions) if partitions else out


def write_ranked_corpus(prints: DataFrame, path: str) -> None:
    """Ranked prints as Parquet in the order of ticker and rank, as ``write_candles`` has bars: no folder for a ticker, as
    folders and files would then grow with the tickers, and each costs far more than the 200 rows in it."""
    prints.repartition("ticker").sortWithinPartitions("ticker", "rank").write.parquet(path)


def read_ranked_corpus(spark: SparkSession, root: str, top: int = 200) -> DataFrame:
    """``write_ranked_corpus``'s files, or ``<TICKER>/top200.parquet`` files, whose ticker is that of the path; the premium from
    price and size, the percentile from the rank."""
    raw = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(root)
    named = raw if "ticker" in raw.columns else raw.withColumn("ticker", F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]+\.parquet(?:/[^/]*)?$", 1))
    premium = F.coalesce(F.col("premium"), F.col("price") * F.col("size")) if "premium" in raw.columns else F.col("price") * F.col("size")
    return named.withColumns({"premium": premium, "percentile": F.round((top + 1 - F.col("rank")) / 2.0, 2)})


def extract_table(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The named columns, each cast to its type; what doesn't parse becomes null."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def wide_integers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Integers beyond 53 bits as text, so that JSON readers keep them."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def archive_days(df: DataFrame, ts_col: str, root: str, as_of: Column, lookback: int = 10, existing: DataFrame | None = None) -> DataFrame:
    """Write the complete UTC days of the last ``lookback`` that ``existing`` (day) hasn't, as gzipped JSON lines under
    ``day=``; returns the days. Days that are there already are never written again."""
    dated = df.withColumn("day", F.to_date(ts_col)).filter((F.col("day") < as_of) & (F.col("day") >= F.date_sub(as_of, lookback)))
    if existing is not None:
        dated = dated.join(existing.select("day"), "day", "left_anti")
    dated.repartition("day").write.mode("append").partitionBy("day").json(root, compression="gzip")
    return dated.select("day").distinct()


def write_artifacts(df: DataFrame, path: str, fmt: str) -> None:
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else getattr(writer, fmt)(path)


def replace_days(df: DataFrame, path: str, day_col: str) -> None:
    """Replace exactly the days that ``df`` holds: a dynamic overwrite of date partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day_col).parquet(path)


def append_snapshot(minutes: DataFrame, new: DataFrame) -> DataFrame:
    """(ticker, date, t, ...) snapshots: a later one of the same minute replaces the earlier; minutes sorted into an array."""
    from ..operators.bars import upsert

    value = F.struct("t", *[c for c in minutes.columns if c not in ("ticker", "date", "t")])
    return upsert(minutes, new, ["ticker", "date", "t"]).groupBy("ticker", "date").agg(F.sort_array(F.collect_list(value)).alias("minutes"))


def last_snapshot(days: DataFrame, schema: str) -> DataFrame:
    """Chain rows of the last minute in each day's JSON array; only that element is parsed out and exploded."""
    parsed = days.select("ticker", "date", F.try_element_at(F.from_json("minutes", schema), F.lit(-1)).alias("m"))
    rows = parsed.select("ticker", "date", F.col("m.spot").alias("spot"), F.explode("m.strikes").alias("s")).select("ticker", "date", "spot", "s.*")
    return rows.filter(F.col("k") > 0).na.fill(0.0)
