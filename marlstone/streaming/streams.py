"""Structured Streaming: ingest, trade filter, tide buckets and live aggregates. Sinks replace the partitions a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import newest_per_key, upsert
from ..operators.flow import largest_nets, net_premium
from ..operators.prints import TOP, filter_trades, insert_new, rerank


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    """New files of a folder, at most ``files`` in a batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).load(path)


def distinct_alerts(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each alert id once within the watermark."""
    return alerts.withWatermark("time", delay).dropDuplicatesWithinWatermark(["id"])


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _parts(spark: SparkSession, path: str, by: str, values: list) -> DataFrame | None:
    """Rows of the given partitions of a table, null among them; None while there is no table."""
    if not exists(spark, path):
        return None
    is_one = F.col(by).isin(*[v for v in values if v is not None])
    return spark.read.parquet(path).filter(is_one | F.col(by).isNull() if None in values else is_one)


def _values(df: DataFrame, column: str) -> list:
    """The partitions of one batch."""
    return [r[0] for r in df.select(column).distinct().collect()]


class Stage:
    """A folder for the rows of one batch, as a table can't be overwritten while it is read; it goes when the batch is done."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int) -> None:
        self.spark, self.path, self.n = spark, f"{path.rstrip('/')}_staged/batch={batch_id}", 0

    def keep(self, rows: DataFrame) -> DataFrame:
        self.n += 1
        rows.write.mode("overwrite").parquet(f"{self.path}/{self.n}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{self.n}")

    def replace(self, rows: DataFrame, path: str, by: str, touched: list = ()) -> None:
        """Overwrite exactly the partitions that ``rows`` holds; those of ``touched`` that it doesn't hold any more go."""
        staged = self.keep(rows)
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
        for value in set(touched) - set(_values(staged, by)) if touched else ():
            remove(self.spark, f"{path}/{by}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}")

    def done(self) -> None:
        remove(self.spark, self.path)


def upsert_into(path: str, keys: list[str], order: str | None = None, time_col: str = "time", buckets: int = 64):
    """A ``foreachBatch`` sink: rows replace those of their keys, in a table partitioned by the UTC day of ``time_col``.

    ``{path}_keys`` says on which day a key is, by hash buckets; with it a key whose time has moved to another day leaves
    the old one. Only days and buckets that a batch touches are read and written again, and a batch that runs again
    changes nothing. Rows without a time have a partition of their own; rows without a key are passed over.
    """
    index = f"{path.rstrip('/')}_keys"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, stage = batch.sparkSession, Stage(batch.sparkSession, path, batch_id)
        new = batch.dropna(subset=keys).withColumn("day", F.to_date(time_col))
        new = stage.keep(newest_per_key(new, keys, F.desc(order)) if order else new.dropDuplicates(keys))
        if not (days := set(_values(new, "day"))):
            stage.done()
            return
        placed = new.select(*keys, "day", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("key_bucket"))
        was = _parts(spark, index, "key_bucket", _values(placed, "key_bucket"))
        if was is not None:
            was = stage.keep(was)
            days |= set(_values(was.join(placed, keys, "left_semi"), "day"))
        old = _parts(spark, path, "day", list(days))
        rows = new if old is None else old.select(*new.columns).join(new, keys, "left_anti").unionByName(new)
        stage.replace(rows, path, "day", list(days))
        stage.replace(placed if was is None else was.select(*placed.columns).join(placed, keys, "left_anti").unionByName(placed), index, "key_bucket")
        stage.done()

    return run


def insert_trades_into(path: str, thresholds: DataFrame, top: int = TOP, lookback_hours: int = 24, unit: str = "day", buckets: int = 64):
    """A ``foreachBatch`` sink of the trade tape: trades at or over their ticker's threshold that aren't there already, in a
    table partitioned by day (or another ``unit`` of ``date_trunc``) at ``path``; and the ``top`` prints of each ticker with
    their ranks at ``{path}_ranks``, partitioned by hash buckets of the ticker: a folder for each ticker would cost far more than
    the ``top`` rows in it.

    A batch is compared with the days from its first trade less the look-back on. Ranks are kept as a state that merges:
    the first ``top`` of a ticker are those of its first ``top`` so far and the batch's rows, so that a batch reads the
    ranks of the buckets whose tickers it holds, and neither other buckets' nor the corpus.
    """
    ranks = f"{path.rstrip('/')}_ranks"
    part = lambda c: F.to_date(F.date_trunc(unit, c))
    bucket = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, stage = batch.sparkSession, Stage(batch.sparkSession, path, batch_id)
        kept = stage.keep(filter_trades(batch.filter("executed_at is not null"), thresholds).withColumn("day", part("executed_at")))
        span = kept.agg(F.min(F.col("executed_at") - F.make_dt_interval(F.lit(0), F.lit(lookback_hours))).alias("a"), F.max("day").alias("b"))
        days = _values(span.select(F.explode(F.sequence(F.to_date("a"), F.col("b"))).alias("d")).select(part("d").alias("day")), "day")
        if not days:
            stage.done()
            return
        old = _parts(spark, path, "day", days)
        rows = kept if old is None else insert_new(old.select(*kept.columns), kept, "id")
        stage.replace(rows, path, "day")
        # The days just written, not the batch: what a run that failed half-way had inserted is ranked as well.
        new = _parts(spark, path, "day", _values(kept, "day")).select(*kept.columns).join(kept.select("ticker", "id"), ["ticker", "id"], "left_semi")
        had = _parts(spark, ranks, "ticker_bucket", _values(kept.select(bucket.alias("b")), "b"))
        if had is not None:
            new = new.unionByName(had.select(*kept.columns)).dropDuplicates(["ticker", "id"])
        ranked = rerank(new, top).filter("rank is not null").withColumn("ticker_bucket", bucket)
        stage.replace(ranked.repartition("ticker_bucket"), ranks, "ticker_bucket")
        stage.done()

    return run


def live_net(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Net premium by ticker and New York day, kept current (update mode): call ask - bid + put bid - ask."""
    local = alerts.withColumn("_local", F.from_utc_timestamp("time", "America/New_York"))
    held = local.withWatermark("_local", delay) if alerts.isStreaming else local
    g = held.groupBy(F.window("_local", "1 day"), "ticker").agg(F.sum(net_premium()).alias("net"))
    return g.select(F.to_date("window.start").alias("date"), "ticker", F.round("net", 6).alias("net"))


def net_impact_into(path: str, n: int = 10):
    """A ``foreachBatch`` sink of ``live_net``: nets by (date, ticker), a later one in place of the earlier, at ``path``; and
    each touched day's ``n`` tickers with the largest net either way at ``{path}_top``. Both are partitioned by date.

    The first step's state is the stream's, the second's is the table of the day: the watermark ends the first, and a day
    that gets no more rows is never read again.
    """
    top = f"{path.rstrip('/')}_top"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, stage = batch.sparkSession, Stage(batch.sparkSession, path, batch_id)
        new = stage.keep(batch)
        days = _values(new, "date")
        if days:
            old = _parts(spark, path, "date", days)
            rows = stage.keep(new if old is None else upsert(old.select(*new.columns), new, ["date", "ticker"]))
            stage.replace(rows, path, "date")
            stage.replace(largest_nets(rows, n), top, "date")
        stage.done()

    return run


def append_minutes_into(path: str, order: str | None = None):
    """A ``foreachBatch`` sink of snapshots (ticker, date, t, values...): one row for each ticker and date with an array of
    its minutes in order, in a table partitioned by date.

    A later snapshot of a minute replaces the earlier one, a late minute is sorted in; within a batch the largest ``order``
    counts. The stored array and the batch's are merged as maps from the minute; a batch that runs again changes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, stage = batch.sparkSession, Stage(batch.sparkSession, path, batch_id)
        key = ["ticker", "date"]
        once = newest_per_key(batch, [*key, "t"], F.desc(order)) if order else batch.dropDuplicates([*key, "t"])
        value = F.struct("t", *[c for c in batch.columns if c not in (*key, "t", order)])
        new = stage.keep(once.groupBy(*key).agg(F.collect_list(value).alias("minutes")))
        days = _values(new, "date")
        if days:
            old = _parts(spark, path, "date", days)
            none = F.array().cast(new.schema["minutes"].dataType)
            by_minute = lambda c: F.map_from_entries(F.transform(F.coalesce(c, none), lambda m: F.struct(m["t"].alias("k"), m.alias("v"))))
            had = (new.limit(0) if old is None else old).select(*key, F.col("minutes").alias("had"))
            both = had.join(new, key, "full").withColumn("merged", F.map_zip_with(by_minute(F.col("had")), by_minute(F.col("minutes")), lambda _, a, b: F.coalesce(b, a)))
            stage.replace(both.select("ticker", F.sort_array(F.map_values("merged")).alias("minutes"), "date"), path, "date")
        stage.done()

    return run


def drain(writer, checkpoint: str) -> None:
    """Run a stream's writer over what there is, and wait for its end."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()


def tide_buckets(rows: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Last premium and volume of each tumbling bucket; works on batches and streams."""
    held = rows.withWatermark("time", delay) if rows.isStreaming else rows
    g = held.groupBy(F.window("time", width)).agg(F.max_by("net_premium", F.struct("time", "id")).alias("net_premium"), F.max_by("volume", F.struct("time", "id")).alias("volume"), F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("bucket"), "net_premium", "volume", "n")


def live_flow(alerts: DataFrame, delay: str = "1 day") -> DataFrame:
    """Premium by ticker and New York day, kept current (update mode); a day's state goes once the watermark passes it."""
    local = alerts.withColumn("_local", F.from_utc_timestamp("time", "America/New_York"))
    held = local.withWatermark("_local", delay) if alerts.isStreaming else local
    g = held.groupBy(F.window("_local", "1 day"), "ticker").agg(F.count("*").alias("n"), F.sum("premium").alias("premium"))
    return g.select(F.to_date("window.start").alias("date"), "ticker", "n", "premium")
