"""The book of positions as a stream: its rules, and a run that stops and starts again."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.operators import positions
from marlstone.streaming import streams
from marlstone.streaming.book_stream import DAY, Book, book_stream

T0 = dt.datetime(2026, 5, 5, 10, tzinfo=dt.UTC)


def row(open_id, at=0, left=1.0, frozen=False, shadow=None, current=True, moderator="m", label="7/20", mark=None):
    return {"open_id": open_id, "moderator": moderator, "expiry_label": label, "size_label": "Large", "entry_price": 2.0, "entry_at": at, "remaining": left, "realized": 0.0, "frozen": frozen, "shadow": shadow, "current": current, "mark": mark, "live_pct": None, "events": []}


def send(book, action, at, message_id, price=3.0, pct=None, hint=None, moderator="m", label="7/20"):
    book.take(action, at, message_id, price, pct, hint, "Small", moderator, label)


def test_exits_go_to_the_current_row():
    book = Book([row(1)])
    send(book, "trim", DAY, 5, pct=40.0)
    send(book, "trim", DAY, 6, pct=20.0, hint=0.25, moderator="other")  # no row of that moderator, and none that is stored only
    r = book.rows[0]
    assert (r["remaining"], r["realized"], r["mark"]) == (0.5, 20.0, None)
    send(book, "open", DAY, 7)
    send(book, "close", DAY, 8, pct=10.0)
    assert [(x["open_id"], x["remaining"]) for x in book.rows] == [(1, 0.5)] and book.touched[7]["realized"] == 10.0
    send(book, "close", 2 * DAY, 9, pct=10.0)  # the older row isn't current any more
    assert book.rows[0]["remaining"] == 0.5


def test_frozen_rows_take_a_close_and_old_exits():
    book = Book([row(1, left=0.25, frozen=True, shadow=1.0)])
    send(book, "trim", DAY, 5, pct=40.0)
    assert (book.rows[0]["remaining"], book.rows[0]["shadow"]) == (0.25, 0.5) and not book.touched
    send(book, "close", DAY, 6, price=9.0, pct=300.0)
    assert not book.rows and (book.touched[1]["realized"], book.touched[1]["mark"], book.touched[1]["live_pct"]) == (75.0, 9.0, None)
    book = Book([row(1, left=0.5, frozen=True, shadow=0.25)])
    send(book, "trim", DAY, 7, pct=50.0, hint=1.0)  # trims alone close the shadow: what is left counts as nothing gained
    assert not book.rows and book.touched[1]["realized"] == 0.0
    book = Book([row(1, left=0.5, frozen=True, shadow=0.5), row(2, at=5)])
    send(book, "trim", 31 * DAY + 10, 8, price=4.0, pct=50.0)  # beyond the look-back of both: the older stored row
    send(book, "trim", 31 * DAY + 11, 8, price=4.0, pct=50.0)  # seen before there, so the next row takes it
    assert [(r["open_id"], r["remaining"], r["realized"], r["mark"]) for r in book.rows] == [(1, 0.25, 12.5, 4.0), (2, 0.5, 25.0, 4.0)]


def test_marks_and_expiry():
    book = Book([row(1), row(2, left=0.5, current=False)])
    send(book, "mark", DAY, 0, price=3.0)
    assert [r["live_pct"] for r in book.rows] == [50.0, 50.0]
    book.settle(3 * DAY)
    assert not book.rows and [book.touched[k]["realized"] for k in (1, 2)] == [50.0, 25.0]
    book = Book([row(1)])
    book.settle(3 * DAY)
    assert book.touched[1]["realized"] == -100.0 and book.touched[1]["events"][-1][5] == -1


FIELDS = "asset_type string, ticker string, side string, strike double, expiry date, moderator string, expiry_label string, message_id long, at timestamp, action string, price double, pct double, frac_hint double, size_label string"


def message(ticker, k, action, pct=None, hint=None, price=2.0, strike=10.0, expiry=dt.date(2026, 6, 19)):
    return ("option", ticker, "CALL", strike, expiry, "m", "6/19", k, T0 + dt.timedelta(hours=k), action, price, pct, hint, "Large")


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    """Two runs over one checkpoint: stored rows and the first messages, then the rest and a late one that passes the expiry."""
    top = tmp_path_factory.mktemp("book")
    stored = [("option", "OLD", "CALL", 10.0, dt.date(2026, 6, 19), "m", "6/19", 1, "Small", 2.0, T0 - dt.timedelta(days=40), 0.5, 10.0, "OPEN", False, None, 2.5, 25.0), ("option", "HAND", "CALL", 10.0, dt.date(2026, 6, 19), "m", "6/19", 2, "Small", 2.0, T0 - dt.timedelta(days=4), 0.25, 30.0, "OPEN", True, 1.0, None, None)]
    schema = "asset_type string, ticker string, side string, strike double, expiry date, moderator string, expiry_label string, open_id long, size_label string, entry_price double, entry_at timestamp, remaining double, realized double, status string, frozen boolean, derived_remaining double, mark double, live_pct double"
    kind = f"array<struct<{', '.join(f.replace(' ', ': ') for f in positions.EVENT.split(', '))}>>"
    first = spark.createDataFrame(stored, schema).withColumn("events", F.array().cast(kind))
    parts = [
        [message("NEW", 10, "open"), message("NEW", 11, "trim", 40.0), message("OLD", 12, "trim", 60.0), message("HAND", 13, "trim", 50.0)],
        [message("NEW", 30, "trim", 20.0, 0.5), message("NEW", 31, "mark", price=3.0), message("HAND", 32, "close", 100.0, price=4.0)],
        [message("LATE", 24 * 60, "open", expiry=dt.date(2027, 1, 1)), message("LATE", 24 * 60 + 2, "add", expiry=dt.date(2027, 1, 1))],
        [message("LATE", 24 * 61, "add", expiry=dt.date(2027, 1, 1))],
    ]
    put = streams.upsert_into(str(top / "out"), ["open_id"], "n_events", "entry_at")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(str(top / "in"))
        if k in (0, 3):
            source = streams.file_stream(spark, str(top / "in"), spark.createDataFrame(rows, FIELDS).schema, files=1)
            streams.drain(book_stream(source, first).writeStream.outputMode("update").foreachBatch(put), str(top / "checkpoint"))
    return {r.ticker: r for r in spark.read.parquet(str(top / "out")).collect()}


def test_stream_over_a_restart(result):
    old, hand, late = (result[k] for k in ("OLD", "HAND", "LATE"))
    assert (hand.status, hand.realized, hand.mark) == ("CLOSED", 30.0 + 0.25 * 100.0, 4.0)
    assert (late.status, late.n_events) == ("OPEN", 3)
    # The stored row took an exit although it is older than the look-back, and settled at that exit's price.
    assert old.status == "CLOSED" and old.realized == 10.0 + 0.25 * 60.0 + 0.25 * 0.0


def test_stream_settles_at_the_mark_after_expiry(result):
    new = result["NEW"]
    assert (new.status, new.remaining) == ("CLOSED", 0.0)
    assert new.realized == pytest.approx(0.5 * 40 + 0.25 * 20 + 0.25 * 50)
    assert [e.action for e in new.events] == ["open", "trim", "trim", "close"] and new.events[-1].message_id == -10


class Handle:
    """A state handle that counts what crosses to the state store."""

    def __init__(self):
        self.held, self.calls = None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, at):
        self.calls.append(at)


def test_a_contract_costs_one_read_and_one_write_of_its_state_a_batch():
    from pyspark.sql import Row

    from marlstone.streaming.book_stream import BookProcessor

    handle, processor = Handle(), BookProcessor()
    processor.init(handle)
    key = ("option", "A", "CALL", 1.0, dt.date(1970, 1, 2))
    line = lambda action, k, pct=None: Row(action=action, micros=k, message_id=k, price=2.0, pct=pct, frac_hint=None, size_label="Large", moderator="m", expiry_label="7/20")
    held = Row(open_id=1, moderator="x", expiry_label=None, size_label="Small", entry_price=1.0, entry_at=0, remaining=1.0, realized=0.0, frozen=False, derived_remaining=None, mark=None, live_pct=None, events=[], current=True)
    processor.handleInitialState(key, Row(stored=[held, held]), None)
    assert handle.calls == ["get", "update", 2 * DAY // 1000] and len(handle.held[0]) == 2
    handle.calls.clear()
    got = list(processor.handleInputRows(key, iter([line("trim", 8, 40.0), line("open", 7)]), None))
    assert handle.calls == ["get", "update"]  # the timer is there already
    assert [(r.open_id, r.status, r.remaining, r.realized, r.n_events) for r in got] == [(7, "OPEN", 0.5, 20.0, 2)]
    assert [r.open_id for r in processor.handleExpiredTimer(key, None, None)] == [1, 7] and handle.held is None


def test_positions_are_folded_as_a_partition_passes(spark):
    rows = [(f"k{k}", k * 10 + j, T0 + dt.timedelta(hours=j), a, 2.0, p, None, "Small") for k in range(3) for j, (a, p) in enumerate([("trim", 1.0), ("open", None), ("trim", 40.0), ("add", None), ("close", 10.0), ("open", None), ("close", float("nan"))])]
    messages = spark.createDataFrame(rows[::-1], "key string, message_id long, at timestamp, action string, price double, pct double, frac_hint double, size_label string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")  # a key goes over several batches
    try:
        out = positions.stitch_positions(messages)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()  # no call of its own for each key
        got = {(r.key, r.open_id): r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(got) == [(f"k{k}", k * 10 + j) for k in range(3) for j in (1, 5)]
    for (key, open_id), r in got.items():
        first = open_id % 10 == 1
        assert (r.status, r.remaining, r.realized, r.n_orphans, r.n_events) == ("CLOSED", 0.0, 0.5 * 40 + 0.5 * 10 if first else 0.0, 1, 4 if first else 2)
        assert [e.message_id for e in r.events] == ([open_id + j for j in range(4)] if first else [open_id, open_id + 1])
