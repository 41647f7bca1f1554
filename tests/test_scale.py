"""Forms that keep time and memory in proportion to the input."""

from __future__ import annotations

import glob

import pyarrow.parquet as pq
from conftest import SF
from pyspark.sql import functions as F

from marlstone.functions.exprs import lag
from marlstone.functions.store import written
from marlstone.operators import evaluation, flow
from marlstone.operators.bars import bars_from_trades
from marlstone.plans import flow_queries
from marlstone.sources import io, stored


def test_documents_are_stored_whole(spark, tmp_path):
    """No columns are split off a variant, neither by the writer nor beside the generator that reads it back."""
    text = '{"expirations": [1], "strikes": [{"strike": 1.5, "byExp": {"2024-01-19": {"netOI": 2.0}}}, {"strike": 2.5, "byExp": {"2024-01-26": {"netOI": 3.0}}}]}'
    rows = spark.range(40).select(F.concat(F.lit("T"), "id").alias("ticker"), F.lit(1.0).alias("spot"), F.current_timestamp().alias("captured_at"), F.lit(text).alias("cells"))
    before = spark.conf.get(stored.SHREDDING)
    stored.write_whole(stored.as_variant(rows, "cells"), str(tmp_path / "v"))
    assert spark.conf.get(stored.SHREDDING) == before
    for file in glob.glob(str(tmp_path / "v" / "*.parquet")):
        assert {p.path for p in pq.ParquetFile(file).schema} - {"ticker", "spot", "captured_at"} == {"cells.value", "cells.metadata"}
    back = stored.stored_cells(spark.read.parquet(str(tmp_path / "v")))
    assert back.count() == 80 and back.filter("n_exp = 1 and net_oi = 2").count() == 40
    plan = back._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.rindex("Generate")]
    assert "try_variant_get" not in top, plan


def test_candles_have_no_folder_for_each_ticker(spark, tmp_path):
    path = str(tmp_path / "candles")
    rows = spark.range(3000).select(F.concat(F.lit("S"), F.col("id") % 300).alias("ticker"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") / 300).cast("int")).alias("date"), F.lit(1.0).alias("close"))
    io.write_candles(rows, path)
    files = glob.glob(f"{path}/**/*.parquet", recursive=True)
    assert len(files) <= 4 and sum(pq.read_metadata(f).num_rows for f in files) == 3000
    assert io.load_candles(spark, path, ["S7"], "2026-01-02", "2026-01-04").count() == 3


def test_bars_by_ticker_need_one_shuffle(spark):
    """The bars of scattered trades, and a window over their ticker, share a shuffle and a sort; values are those of the plain way."""
    t = spark.range(4000).select(F.concat(F.lit("S"), F.col("id") % 13).alias("ticker"), F.timestamp_seconds(F.col("id") * 9000).alias("executed_at"), (F.col("id") * 37 % 101 + 1.0).alias("price"), (F.col("id") % 5 + 1.0).alias("size"), F.col("id").alias("seq"))
    day = F.to_date("executed_at")
    near, plain = bars_from_trades(t, day, by_ticker=True), bars_from_trades(t, day)
    assert near.exceptAll(plain).isEmpty() and plain.exceptAll(near).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = near.withColumn("before", lag("close"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange ") == 1 and plan.count(" Sort [") == 1, plan


def test_boards_rank_every_ticker_of_200_contracts(spark):
    days = flow.chain_minute(flow_queries.chain(spark, SF))
    last = days.join(days.agg(F.max("date").alias("date")), "date")
    liquid = flow.market_sentiment(flow.chain_minute(flow_queries._busy(spark, SF, flow_queries.LED))).filter("liquid")
    want = last.filter("call_vol + put_vol >= 200").select("ticker")
    assert 0 < last.filter("call_vol + put_vol >= 500").count() < want.count()
    assert sorted(liquid.select("ticker").collect()) == sorted(want.collect())


def test_study_works_its_rows_out_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(evaluation, "written", lambda df, name: kept.append(name) or written(df, name))
    days = spark.range(400).select(F.lit("S").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 5).cast("int")).alias("date"))
    labels = days.withColumns({f"label_{s}{c}": F.lit(1.0) for s in ("long", "short") for c in ("", "_outcome_return")})
    events = days.select("*", F.lit("d").alias("detector"), F.lit("long").alias("side"), F.lit(1.0).alias("strength"))
    out = evaluation.event_study(events, labels, evaluation.folds(days))
    assert kept == ["study-rows", "study-hits"] and out.first()["hit_rate"] == 1.0
