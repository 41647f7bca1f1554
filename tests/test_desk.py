"""Sessions, joins, sentiment, prints, repair, folds, positions, sources and streams on small literals."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from marlstone.functions import market as M
from marlstone.operators import boosting, candles, evaluation, flow, hitlist, positions, prints
from marlstone.sources import io, tape
from marlstone.streaming import streams

D = dt.date


def utc(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture(scope="module")
def calendar(spark):
    days = [D(2026, 5, 4) + dt.timedelta(days=k) for k in range(12)]
    return spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "date date")


@pytest.mark.parametrize(
    ("at", "want"),
    [
        ("2026-05-05T14:00:00", D(2026, 5, 5)),
        ("2026-05-05T20:00:00", D(2026, 5, 5)),  # 16:00:00 in New York
        ("2026-05-05T20:00:00.900000", D(2026, 5, 5)),
        ("2026-05-05T20:00:01", D(2026, 5, 6)),
        ("2026-05-06T02:00:00", D(2026, 5, 6)),
        ("2026-05-08T21:00:00", D(2026, 5, 11)),
        ("2026-05-09T15:00:00", D(2026, 5, 11)),
        ("2026-05-15T21:00:00", None),
        ("2026-05-01T12:00:00", D(2026, 5, 4)),
    ],
)
def test_sessions(spark, calendar, at, want):
    events = spark.sql(f"SELECT TIMESTAMP '{at.replace('T', ' ')}' AS time")
    assert flow.add_feature_date(events, "time", calendar).first().feature_date == want


def test_clock_changes(spark):
    rows = spark.sql("SELECT explode(array(DATE '2026-03-08', DATE '2026-11-01', DATE '2026-06-01')) AS d")
    start, end = M.day_bounds(F.col("d"))
    assert [r.h for r in rows.select(((F.unix_seconds(end) - F.unix_seconds(start)) / 3600).alias("h")).collect()] == [23, 25, 24]


def test_option_symbols(spark):
    row = spark.sql("SELECT 'ABC' AS t, '$202.5C Jul 20' AS l, '$15P Jan 3' AS m, 'x' AS bad, DATE '2026-06-30' AS d")
    got = row.select(M.symbol_from_label(F.col("t"), F.col("l"), F.col("d")), M.symbol_from_label(F.col("t"), F.col("m"), F.col("d")), M.symbol_from_label(F.col("t"), F.col("bad"), F.col("d"))).first()
    assert tuple(got) == ("ABC260720C00202500", "ABC270103P00015000", None)


def test_alerts_are_normalised(spark):
    fields = "id ticker option_chain expiry created_at total_ask_side_prem total_bid_side_prem volume open_interest volume_oi_ratio has_sweep has_floor has_multileg strike total_premium"
    rows = [
        ("1", "abc", "ABC260720P00202500", None, "2026-05-05", "80", "20", "50", "10", "7.5", True, True, False, "202.5", "1e3"),
        (None, "x", None, None, "2026-05-05", None, None, None, None, None, False, False, False, None, None),
        ("2", " ", None, None, "2026-05-05", None, None, None, None, None, False, False, False, None, None),
        ("3", "x", "", "2026-06-19", "2026-05-05", "1", "9", "5.9", "many", None, None, False, True, "7", None),
        ("4", "y", None, None, "2026-05-05", None, None, None, None, "1", False, False, False, None, "5"),
    ]
    kinds = ", ".join(f"{f} {'boolean' if f.startswith('has_') else 'string'}" for f in fields.split())
    a, b, c = sorted(flow.normalise_alerts(spark.createDataFrame(rows, kinds)).collect(), key=lambda r: r.id)
    assert (a.ticker, a.type, a.expiry, a.strike, a.side, a.sentiment, a.exec, a.confidence, a.contract, a.premium) == ("ABC", "PUT", D(2026, 7, 20), 202.5, "BUY", "BEARISH", "SWEEP", "HIGH", "$202.5P Jul 20", 1000.0)
    assert (b.type, b.expiry, b.side, b.sentiment, b.exec, b.confidence, b.size, b.oi) == ("CALL", D(2026, 6, 19), "SELL", "BEARISH", "BLOCK", "LOW", 5, 0)
    assert (c.ask_prem, c.bid_prem, c.all_opening, c.issue_type, c.has_single_leg, c.side, c.confidence, c.expiry, c.rule) == (None, None, None, None, None, "BUY", "MED", D(2026, 5, 5), "Unusual activity")
    # Nothing known of the ask side: the exact screen must not take nulls for zeros.
    held = flow.normalise_alerts(spark.createDataFrame(rows, kinds)).withColumn("issue_type", F.lit("Common Stock"))
    assert flow.screen(held, F.lit(D(2026, 5, 5)), "lotto", exact=True).count() == 0


def test_exits_of_stored_positions(spark):
    fields = "key string, remaining double, realized double, status string, seen_ids array<bigint>, frozen boolean"
    stored = spark.createDataFrame([("a", 0.5, 20.0, "OPEN", [1], False), ("b", 1.0, 0.0, "OPEN", None, True), ("c", 0.0, 5.0, "CLOSED", None, False), ("d", 0.4, 1.0, "OPEN", None, False)], fields)
    rows = [("a", "trim", 1, 1, 99.0, None), ("a", "trim", 2, 2, 40.0, 0.5), ("a", "trim", 3, 3, 80.0, None), ("a", "trim", 3, 3, 80.0, None), ("a", "close", 4, 4, 10.0, None), ("a", "trim", 5, 5, 70.0, None), ("b", "trim", 6, 6, 50.0, None), ("c", "close", 7, 7, 50.0, None)]
    exits = spark.createDataFrame([(k, a, utc("2026-05-05T10:00:00") + dt.timedelta(minutes=t), i, p, h, 2.0) for k, a, t, i, p, h in rows], "key string, action string, at timestamp, message_id long, pct double, frac_hint double, price double")
    got = {r.key: r for r in positions.apply_orphan_exits(stored, exits).collect()}
    assert (got["a"].remaining, got["a"].realized, got["a"].status) == (0.0, 20 + 0.25 * 40 + 0.125 * 80 + 0.125 * 10, "CLOSED") and got["a"].seen_ids == [1, 2, 3, 4, 5]
    # A row that was corrected by hand takes a trim as any other does.
    assert [(got[k].remaining, got[k].realized, got[k].status) for k in "bcd"] == [(0.5, 25.0, "OPEN"), (0.0, 5.0, "CLOSED"), (0.4, 1.0, "OPEN")]
    late = exits.withColumn("action", F.lit("close"))
    priced = stored.withColumns({"mark": F.lit(1.0), "live_pct": F.lit(3.0), "size_label": F.lit("Large")})
    closed = {r.key: r for r in positions.apply_orphan_exits(priced, late).collect()}
    assert (closed["b"].status, closed["b"].mark, closed["b"].live_pct, closed["b"].book_delta) == ("CLOSED", 2.0, None, 5.0)
    assert (closed["d"].mark, closed["d"].live_pct) == (1.0, 3.0)


def test_daily_join_fills(spark):
    m = spark.createDataFrame([("A", D(2026, 5, 4)), ("A", D(2026, 5, 5))], "ticker string, date date")
    daily = spark.createDataFrame([("A", D(2026, 5, 4), 3, 2.5)], "ticker string, date date, n long, avg double")
    got = flow.join_daily(m, daily, "has", ("avg",)).orderBy("date").collect()
    assert [tuple(r)[2:] for r in got] == [(3.0, 2.5, 1), (0.0, None, 0)]
    with pytest.raises(Exception, match="repeat"):
        flow.join_daily(m, daily.union(daily), "has").collect()


def test_repair(spark):
    days = [D(2020, 1, 1), D(2020, 1, 2), D(2020, 6, 1), D(2020, 6, 2), D(2020, 6, 3)]
    b = spark.createDataFrame([("R", d, 10.0) for d in days] + [("OLD", d, 9.0) for d in days[:2]] + [("NEW", days[2], 10.0)], "ticker string, date date, close double")
    kept, report = candles.trim_reused(b)
    assert kept.filter("ticker = 'R'").count() == 3 and report.filter("status = 'trimmed'").count() == 1
    joined, seams = candles.stitch(b, spark.createDataFrame([("OLD", "NEW")], "old string, new string"))
    assert joined.filter("ticker = 'NEW'").count() == 3 and joined.filter("ticker = 'OLD'").count() == 0
    assert tuple(seams.first()) == ("NEW", 1.1111, 151, False)


def test_prints(spark):
    rows = [("a", "T", utc("2026-05-05T15:00:00"), 10.0, 100.0, 1000.0, 1), ("b", "T", utc("2026-05-05T15:00:01"), 10.0, 100.0, 1000.0, 2), ("c", "T", utc("2026-05-05T15:00:02"), 11.0, 100.0, 1100.0, 3), ("d", "U", utc("2026-05-05T15:00:02"), 11.0, 100.0, 1100.0, 4)]
    t = spark.createDataFrame(rows, "id string, ticker string, executed_at timestamp, price double, size double, premium double, seq long")
    thr = spark.createDataFrame([("T", 900.0)], "ticker string, threshold double")
    assert sorted(r.id for r in prints.filter_trades(t, thr).collect()) == ["a", "c"]
    assert {r.id: r.rank for r in prints.rerank(t, 2).collect()} == {"a": None, "b": 2, "c": 1, "d": 1}
    assert prints.insert_new(t.filter("id = 'a'"), t, "id").count() == 4
    changed = prints.rank_changes(prints.rerank(t, 2), prints.rerank(t, 1))
    assert {r.id for r in changed.collect()} == {"b", "c", "d"}


def test_positions(spark):
    schema = "key string, message_id long, at timestamp, action string, price double, pct double, frac_hint double, size_label string"
    rows = [("k", 1, "open", None, None), ("k", 2, "trim", 40.0, None), ("k", 8, "add", None, None), ("k", 9, "trim", 20.0, 0.5), ("k", 14, "close", 10.0, None), ("k", 15, "trim", 1.0, None), ("j", 6, "open", None, None), ("j", 7, "open", None, None)]
    made = [(k, i, utc("2026-05-05T10:00:00") + dt.timedelta(minutes=i), a, 2.0, p, f, "Large") for k, i, a, p, f in rows]
    messages = spark.createDataFrame(made, schema)
    found = positions.stitch_positions(messages)
    got = {(r.key, r.open_id): r for r in found.collect()}
    assert (got["k", 1].remaining, got["k", 1].realized, got["k", 1].status) == (0.0, 0.5 * 40 + 0.25 * 20 + 0.25 * 10, "CLOSED")
    assert [(e.action, e.frac_closed, e.pct, e.message_id) for e in got["k", 1].events] == [("open", None, None, 1), ("trim", 0.5, 40.0, 2), ("add", None, None, 8), ("trim", 0.25, 20.0, 9), ("close", 0.25, 10.0, 14)]
    assert {k: r.status for k, r in got.items() if k[0] == "j"} == {("j", 6): "OPEN", ("j", 7): "OPEN"} and got["k", 1].n_orphans == 1
    assert [r.message_id for r in positions.orphan_exits(messages, found).collect()] == [15]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [(k % 7, utc("2026-05-05T10:00:00") + dt.timedelta(minutes=k), float(k), k * 10.0) for k in range(20)]
    df = spark.createDataFrame(rows, "id long, time timestamp, net_premium double, volume double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    source = streams.file_stream(spark, str(tmp_path / "in"), df.schema)
    q = streams.tide_buckets(source).writeStream.format("memory").queryName("tide").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("tide").collect())) == sorted(map(tuple, streams.tide_buckets(df).collect()))
    path = str(tmp_path / "up")
    q = source.writeStream.foreachBatch(streams.upsert_into(path, ["id"], "time")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.net_premium for r in spark.read.parquet(path).collect()} == {k % 7: float(k) for k in range(20)}


def test_sinks_replace_touched_days_only(spark, tmp_path):
    path = str(tmp_path / "alerts")
    put = streams.upsert_into(path, ["id"], "time")
    rows = lambda *x: spark.createDataFrame([(i, utc(t), v) for i, t, v in x], "id long, time timestamp, v double")
    put(rows(), 9)  # a batch without rows leaves no table
    put(rows((1, "2026-05-05T10:00:00", 1.0), (2, "2026-05-06T10:00:00", 2.0)), 0)
    other = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "alerts/day=2026-05-05").glob("*.parquet")}
    more = rows((2, "2026-05-06T11:00:00", 3.0), (3, "2026-05-06T12:00:00", 4.0), (2, "2026-05-06T10:30:00", 9.0))
    for _ in range(2):  # a batch that runs again changes nothing
        put(more, 1)
        assert sorted((r.id, r.v) for r in spark.read.parquet(path).collect()) == [(1, 1.0), (2, 3.0), (3, 4.0)]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "alerts/day=2026-05-05").glob("*.parquet")} == other

    # A row without a time stays, one whose time moves leaves its old day, and a day that loses its last row goes.
    put(rows((7, "2026-05-05T12:00:00", 7.0)).withColumn("time", F.lit(None).cast("timestamp")), 2)
    put(rows((8, "2026-05-05T12:00:00", 8.0)).withColumn("time", F.lit(None).cast("timestamp")), 3)
    for _ in range(2):
        put(rows((1, "2026-05-09T10:00:00", 1.5), (8, "2026-05-06T10:00:00", 8.5)), 4)
    got = sorted((r.id, r.v, str(r.day)) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1.5, "2026-05-09"), (2, 3.0, "2026-05-06"), (3, 4.0, "2026-05-06"), (7, 7.0, "None"), (8, 8.5, "2026-05-06")]
    assert not (tmp_path / "alerts/day=2026-05-05").exists() and not list((tmp_path / "alerts_staged").glob("*"))
    with pytest.raises(AnalysisException):  # another schema is an error, not an empty table
        put(rows((9, "2026-05-06T10:00:00", 1.0)).withColumn("more", F.lit(1)), 5)
    assert spark.read.parquet(path).count() == 5

    tape = str(tmp_path / "tape")
    thresholds = spark.createDataFrame([("T", 100.0), ("U", 100.0)], "ticker string, threshold double")
    take = streams.insert_trades_into(tape, thresholds, top=2)
    trades = lambda *x: spark.createDataFrame([(i, k, utc(t), p, 10.0, p * 10, n) for n, (i, k, t, p) in enumerate(x)], "id string, ticker string, executed_at timestamp, price double, size double, premium double, seq long")
    take(trades(("a", "T", "2026-05-05T23:00:00", 20.0), ("b", "T", "2026-05-06T00:30:00", 30.0), ("c", "U", "2026-05-06T00:30:00", 11.0), ("d", "T", "2026-05-06T00:31:00", 1.0)), 0)
    take(trades(("b", "T", "2026-05-06T00:30:00", 30.0), ("e", "T", "2026-05-06T09:00:00", 40.0)), 1)
    assert sorted(r.id for r in spark.read.parquet(tape).collect()) == ["a", "b", "c", "e"]
    ranks = spark.read.parquet(f"{tape}_ranks")
    assert sorted((r.ticker, r["rank"], r.id) for r in ranks.collect()) == [("T", 1, "e"), ("T", 2, "b"), ("U", 1, "c")]
    other = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tape_ranks/ticker=U").glob("*.parquet")}
    for _ in range(2):
        take(trades(("f", "T", "2026-05-06T10:00:00", 35.0)), 2)
        assert sorted((r["rank"], r.id) for r in spark.read.parquet(f"{tape}_ranks").filter("ticker = 'T'").collect()) == [(1, "e"), (2, "f")]
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "tape_ranks/ticker=U").glob("*.parquet")} == other
    # A run that ended after the trades were inserted is made up for by the next run of its batch.
    new = trades(("g", "U", "2026-05-06T10:00:00", 50.0)).withColumn("day", F.to_date("executed_at"))
    new.write.mode("append").partitionBy("day").parquet(tape)
    take(new.drop("day"), 3)
    assert [r.id for r in spark.read.parquet(f"{tape}_ranks").filter("ticker = 'U'").orderBy("rank").collect()] == ["g", "c"]


def test_minutes_and_nets_are_kept_current(spark, tmp_path):
    path = str(tmp_path / "minutes")
    put = streams.append_minutes_into(path, "seq")
    batch = lambda *x: spark.createDataFrame([("A", D(2026, 5, d), t, s, float(s)) for d, t, s in x], "ticker string, date date, t string, seq int, spot double")
    put(batch((5, "09:31", 1), (5, "09:33", 2), (5, "09:33", 3), (6, "10:00", 4)), 0)
    for _ in range(2):
        put(batch((5, "09:32", 5), (5, "09:31", 6)), 1)
        got = {r.date.day: [tuple(m) for m in r.minutes] for r in spark.read.parquet(path).collect()}
        assert got == {5: [("09:31", 6.0), ("09:32", 5.0), ("09:33", 3.0)], 6: [("10:00", 4.0)]}
    nets = str(tmp_path / "nets")
    keep = streams.net_impact_into(nets, 2)
    rows = lambda *x: spark.createDataFrame([(D(2026, 5, d), t, n) for d, t, n in x], "date date, ticker string, net double")
    keep(rows((5, "A", 1.0), (5, "B", -3.0), (5, "C", 2.0), (6, "A", 1.0)), 0)
    keep(rows((5, "A", 9.0)), 1)
    assert sorted((r.date.day, r.ticker, r.net) for r in spark.read.parquet(f"{nets}_top").collect()) == [(5, "A", 9.0), (5, "B", -3.0), (6, "A", 1.0)]
    assert spark.read.parquet(nets).count() == 4


def test_sources(spark, tmp_path):
    (tmp_path / "u.txt").write_text("ticker\n# note\naa, bb\n\nAA\n")
    assert sorted(r.ticker for r in io.read_universe(spark, str(tmp_path / "u.txt")).collect()) == ["AA", "BB"]
    (tmp_path / "t.csv").write_text("ticker,id,price,size,sip_timestamp,conditions,exchange\nAA,1,10.5,3.9,1700000000123456789,,4\n,2,1,1,1,,\nBB,3,NaN,1,5,,\n")
    t = io.read_trades(spark, str(tmp_path / "t.csv"), 2).collect()
    assert [(r.ticker, r.size, r.executed_at.microsecond) for r in t] == [("AA", 3.0, 123456)]
    (tmp_path / "order.csv").write_text("conditions,sip_timestamp,ticker,trf_id,size,price,id\n12,1700000000000000001,AA,4,2,1e1,x\n,soon,AA,4,2,1,y\n")
    assert [tuple(r)[:5] + (r.trf_id, r.exchange) for r in io.read_trades(spark, str(tmp_path / "order.csv")).collect()] == [("AA", "x", 10.0, 2.0, 1700000000000000001, 4, None)]
    day = lambda k: tape.day_file(str(tmp_path / "days"), D(2026, 5, k))
    row = lambda i, t, at: (i, t, 10.0, 5.0, int(utc(at).timestamp()) * 10**9)
    for k, rows in ((4, [row("old", "A", "2026-05-04T09:00:00")]), (5, [row("a", "A", "2026-05-05T20:00:00"), row("b", "A", "2026-05-05T21:00:00"), row("c", "B", "2026-05-05T15:00:00"), row("d", "B", "2026-05-05T17:00:00")]), (6, [row("e", "A", "2026-05-06T10:00:00"), row("f", "A", "2026-05-06T17:00:00"), row("g", "Z", "2026-05-06T10:00:00")])):
        spark.createDataFrame(rows, "id string, ticker string, price double, size double, sip_timestamp long").coalesce(1).write.option("header", True).csv(day(k), compression="gzip")
    held = spark.createDataFrame([("A", utc("2026-05-05T21:00:00")), ("A", utc("2026-05-01T21:00:00"))], "ticker string, executed_at timestamp")
    universe = spark.createDataFrame([("A",), ("B",), ("B",)], "ticker string")
    now = utc("2026-05-06T16:00:00")
    assert sorted(r.id for r in tape.tape_since(spark, str(tmp_path / "days"), held, universe, now).collect()) == ["b", "d", "e"]
    assert tape.tape_since(spark, str(tmp_path / "nothing"), held, universe, now) is None
    df = spark.createDataFrame([(utc("2026-05-05T10:00:00"), 1), (utc("2026-05-06T10:00:00"), 2), (utc("2026-05-07T10:00:00"), 3)], "ts timestamp, v long")
    root = str(tmp_path / "arc")
    io.archive_days(df, "ts", root, F.lit("2026-05-07").cast("date"), existing=spark.createDataFrame([(D(2026, 5, 5),)], "day date"))
    assert [r.v for r in spark.read.json(root).collect()] == [2]
    df.select(F.lit("AA").alias("ticker"), F.to_date("ts").alias("date"), "v").write.parquet(str(tmp_path / "c"))
    assert io.load_candles(spark, str(tmp_path / "c"), ["AA"], "2026-05-06", "2026-05-07").count() == 2
    spark.createDataFrame([(1, 2.0, 3.0)], "rank int, price double, size double").write.parquet(str(tmp_path / "corp/XYZ/top200.parquet"))
    r = io.read_ranked_corpus(spark, str(tmp_path / "corp")).first()
    assert (r.ticker, r.premium, r.percentile) == ("XYZ", 6.0, 100.0)
    days = spark.createDataFrame([("A", D(2026, 5, 5), '[{"spot": 1.0, "strikes": []}, {"spot": 9.0, "strikes": [{"k": 5.0, "cA": 1.0}, {"k": 0.0, "cA": 2.0}]}]')], "ticker string, date date, minutes string")
    got = io.last_snapshot(days, "array<struct<spot: double, strikes: array<struct<k: double, cA: double, cB: double>>>>").collect()
    assert [tuple(r)[2:] for r in got] == [(9.0, 5.0, 1.0, 0.0)]


def test_messages(spark):
    fields = "id long, title string, contract string, expiration string, entry_price string, exit_price string, pct string, size string, notes string, asset_type string"
    rows = [
        (1, "BUY TO OPEN", "abc 202.5c", "7/20", "$1,001.25", "9", None, " large ", None, "option"),
        (2, "SCALE OUT half", "ABC 202.5C", "7/20/27", "1", "2.50", "+ 100%", "Small", None, "option"),
        (3, "SELL TO CLOSE", "XYZ", None, None, "11", "-3.5%", None, "75 % now", "equity"),
        (4, "SELL TO CLOSE", "XYZ", None, None, "11", None, None, None, "option"),
        (5, "chatter", "ABC 1C", "1/2", "1", "1", None, None, None, "option"),
        (6, "ADD", "ABC 15P", "1/3", "n/a", "1", None, None, None, "option"),
        (7, "ADD", "ABC 15P", "1/3", "2", None, None, "x", "a third", "option"),
        (8, "ADD", "abc 15 p ", "2/30", "$.85", None, None, "x", None, "option"),
        (9, "ADD", "SPY 400 calendar", "1/3", "2", None, None, "x", None, "option"),
        (10, "TRIM", "ABC 15P", "1/3", "2", "2", None, "x", None, "option"),
        (11, "add", "ABC 15P", "1/3", "2", "2", None, "x", None, "option"),
        (12, "BUY TO OPEN", "BRK.B", "13/1/26", "1e1", None, None, "m", None, "equity"),
    ]
    raw = spark.createDataFrame(rows, fields).withColumn("at", F.lit("2026-06-30 12:00:00").cast("timestamp"))
    got = {r.id: r for r in positions.parse_messages(raw).collect()}
    assert sorted(got) == [1, 2, 3, 7, 8, 12]
    a, b, c, d = (got[k] for k in (1, 2, 3, 7))
    assert (a.action, a.ticker, a.strike, a.side, a.expiry, a.price, a.size_label, a.frac_hint) == ("open", "ABC", 202.5, "CALL", D(2026, 7, 20), 1001.25, "Large", None)
    assert (b.action, b.price, b.pct, b.frac_hint, b.expiry, b.size_label) == ("trim", 2.5, 100.0, 0.5, D(2027, 7, 20), None)
    assert (c.side, c.strike, c.ticker, c.price, c.pct, c.frac_hint) == ("LONG", None, "XYZ", 11.0, -3.5, 0.75)
    assert (d.side, d.expiry, d.price, round(d.frac_hint, 3)) == ("PUT", D(2027, 1, 3), 2.0, 0.333)
    assert (got[8].price, got[8].ticker, got[8].strike, got[8].expiry, got[8].size_label) == (0.85, "ABC", 15.0, D(2027, 3, 2), None)
    assert (got[12].ticker, got[12].price, got[12].size_label, got[12].expiry, got[12].key) == ("BRK.B", 10.0, "Medium", D(2027, 1, 1), "unknown|BRK.B|LONG||13/1/26")


def test_folds_are_ordered_and_embargoed(spark):
    m = spark.sql("SELECT explode(sequence(DATE '2018-01-01', DATE '2023-12-31')) AS date").filter("dayofweek(date) between 2 and 6")
    f = evaluation.folds(m).orderBy("test_start").collect()
    assert [r.fold for r in f] == ["cv1", "cv2", "cv3", "cv4", "cv5", "oos"] and f[-1].is_oos and f[-1].test_end == D(2023, 12, 29)
    for r in f:
        assert (r.test_start - r.train_end).days >= 10 and r.train_start == D(2018, 1, 1)
    assert all(a.test_end < b.test_start for a, b in zip(f, f[1:]))


def test_fold_roles_have_an_inner_embargo(spark):
    m = spark.sql("SELECT explode(sequence(DATE '2018-01-01', DATE '2023-12-31')) AS date").filter("dayofweek(date) between 2 and 6")
    days = sorted(r.date for r in m.collect())
    got = evaluation.assign_folds(m, evaluation.folds(m)).collect()
    for f in evaluation.folds(m).collect():
        own = {role: sorted(r.date for r in got if r.fold == f.fold and r.role == role) for role in ("fit", "calibrate", "test")}
        train = [d for d in days if d <= f.train_end]
        n = max(1, round(len(train) * 0.15))
        assert own["calibrate"] == train[len(train) - n :] and own["fit"] == train[: len(train) - n - 10] and own["test"][0] == f.test_start


def test_ranks_in_ranges_are_the_plain_ones(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), F.floor(F.pow(F.col("id") % 700, 2) / 7).cast("double").alias("x"))
    wide = evaluation._wide_ranks(rows, "x", "r", ["g"], parts=16).groupBy("g", "x").agg(F.first("r").alias("r"), F.count("*").alias("n"))
    plain = rows.withColumn("r", evaluation.mean_rank(F.col("x"), "g")).groupBy("g", "x").agg(F.first("r").alias("r"), F.count("*").alias("n"))
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.collect()))


def test_ablation_sees_what_a_feature_adds(spark):
    n = 900
    day = F.expr("date_add(DATE '2018-01-01', CAST(id AS INT))")
    m = spark.range(n).select(F.lit("A").alias("ticker"), day.alias("date"), (F.hash("id") % 2 == 0).cast("double").alias("label_long"), (F.hash("id", F.lit(1)) % 2 == 0).cast("double").alias("label_short"), F.rand(3).alias("noise"))
    m = m.withColumns({"dp_signal": F.col("label_long") * 2 - 1 + F.col("noise") / 10, "dp_other": F.when(F.col("noise") > 0.1, F.col("noise"))})
    sets = {"ta": ["noise"], "dp": ["dp_signal"], "ta+dp": ["noise", "dp_signal", "dp_other"]}
    report, delta = evaluation.ablation(m, lambda w: evaluation.folds(w, n=1), sets, F.lit(D(2018, 2, 1)), ("ta", "ta+dp"), boosting.Settings(trees=3, depth=2, min_child=20, columns=1.0))
    got = {(r.feature_set, r.side, r.segment): r.roc_auc for r in report.collect()}
    assert len(got) == 12 and got["dp", "long", "oos"] > 0.95 and 0.3 < got["ta", "long", "oos"] < 0.7
    added = {r.side: r.delta_roc_auc for r in delta.collect()}
    assert added["long"] > 0.3 and abs(added["short"]) < 0.3


def test_metrics_of_signal_and_noise(spark):
    df = spark.range(4000).select(F.lit("long").alias("side"), F.lit("cv").alias("segment"), (F.col("id") % 2).cast("double").alias("y"), F.when(F.col("id") % 2 == 1, 0.6).otherwise(0.4).alias("p"))
    r = evaluation.metrics(df.union(df.withColumns({"side": F.lit("short"), "p": F.lit(0.5)}))).collect()
    by = {x.side: x for x in r}
    assert by["long"].roc_auc == 1 and by["long"].pr_auc == 1 and by["short"].roc_auc == 0.5
    one = evaluation.metrics(df.withColumn("y", F.lit(1.0))).first()
    assert (one.n, one.base_rate) == (4000, 1.0) and one.brier is None and one.pr_auc is None and one.top_decile_precision is None


def test_criteria():
    with pytest.raises(ValueError):
        hitlist.Criteria(confidence="SOME")
    with pytest.raises(ValueError):
        hitlist.Criteria(max_alerts=0)


def test_ranked_corpus_has_no_folder_for_a_ticker(spark, tmp_path):
    rows = [(f"T{t}", r, f"{t}-{r}", 2.0 * t, 3.0) for t in range(60) for r in (2, 1)]
    path = str(tmp_path / "corpus")
    io.write_ranked_corpus(spark.createDataFrame(rows, "ticker string, rank int, id string, price double, size double"), path)
    assert len(list((tmp_path / "corpus").rglob("*.parquet"))) <= 4 and not [p for p in (tmp_path / "corpus").iterdir() if p.is_dir()]
    got = io.read_ranked_corpus(spark, path).collect()
    assert sorted((r.ticker, r["rank"], r.id, r.premium, r.percentile) for r in got) == sorted((t, r, i, p * s, (201 - r) / 2) for t, r, i, p, s in rows)


def test_ranks_of_the_tape_lie_in_buckets(spark, tmp_path):
    tape, names = str(tmp_path / "tape"), [f"T{k}" for k in range(40)]
    thresholds = spark.createDataFrame([(n, 1.0) for n in names], "ticker string, threshold double")
    take = streams.insert_trades_into(tape, thresholds, top=2, buckets=4)
    trades = lambda *x: spark.createDataFrame([(i, n, utc("2026-05-06T10:00:00"), p, 1.0, p, k) for k, (i, n, p) in enumerate(x)], "id string, ticker string, executed_at timestamp, price double, size double, premium double, seq long")
    take(trades(*[(f"{n}-{p}", n, float(p)) for n in names for p in (5, 6, 7)]), 0)
    folders = sorted((tmp_path / "tape_ranks").glob("ticker_bucket=*"))
    assert 1 < len(folders) <= 4
    stamps = {p: p.stat().st_mtime_ns for f in folders for p in f.glob("*.parquet")}
    take(trades(("new", "T7", 9.0)), 1)
    now = {p: p.stat().st_mtime_ns for f in folders for p in f.glob("*.parquet")}
    assert len({p.parent for p, _ in stamps.items() - now.items()}) == 1  # one bucket is written again
    want = [(n, r, i) for n in names for r, i in enumerate(("new", f"{n}-7") if n == "T7" else (f"{n}-7", f"{n}-6"), 1)]
    assert sorted((r.ticker, r["rank"], r.id) for r in spark.read.parquet(f"{tape}_ranks").collect()) == sorted(want)
