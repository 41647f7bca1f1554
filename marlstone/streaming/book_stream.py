"""The book of positions as a stream: messages and marks of a contract in, its changed positions out."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.ship import ship
from ..operators.positions import CONTRACT, EVENT, NOTHING, OTHER_WEIGHT, SIZE_WEIGHT, exit_share, known

#: Exits of positions older than this are applied to the stored row, as their opening message isn't read again.
LOOKBACK_DAYS = 30
DAY = 86_400_000_000  # in micros
#: Where a state store is needed that keeps timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

KEYS = "asset_type string, ticker string, side string, strike double, expiry date"
ROW = "open_id long, moderator string, expiry_label string, size_label string, entry_price double, entry_at long, remaining double, realized double, frozen boolean, shadow double, current boolean, mark double, live_pct double"
LINE = "action string, price double, frac_closed double, pct double, at long, message_id long"


def _struct(fields: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ': ', 1) for f in fields.split(', '))}>"


#: A contract's open rows, each with its events, as one value: read and written once for each batch that touches it.
STATE = f"rows array<{_struct(ROW)[:-1]}, events: array<{_struct(LINE)}>>>"
#: What the processor gives: times in micros, which Spark turns into those of the book (``_dated``).
OUT = f"{KEYS}, open_id long, moderator string, expiry_label string, size_label string, entry_price double, entry_at long, remaining double, realized double, status string, frozen boolean, mark double, live_pct double, book_delta double, n_events int, events array<{_struct(LINE)}>"
OUT_NAMES = [f.split()[0] for f in OUT.split(", events")[0].split(", ")] + ["events"]
LINE_NAMES = [f.split()[0] for f in LINE.split(", ")]
NAMES = [f.split()[0] for f in ROW.split(", ")]


class Book:
    """The open positions of one contract. ``rows`` are dicts by ``ROW`` with their ``events``; ``touched`` are the changed
    ones, and ``had`` says whether there were any to begin with."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows, self.touched = rows, {}
        self.had = bool(rows)

    def take(self, action: str, at: int, message_id: int, price: float, pct: float | None, hint: float | None, size: str | None, moderator: str, label: str) -> None:
        """One message in its order of time.

        An open starts a row; the one before of the same moderator and label stays open, but gets no more messages. An
        exit goes to the current row. A row corrected by hand is frozen: within the look-back its exits only move a
        shadow of it, and when that closes, all that the row holds closes at the closing exit's per cent. Exits that
        find no row within the look-back go to the oldest open row that is frozen or beyond it, each message once.
        """
        if action == "mark":
            for r in self.rows:
                if r["entry_price"]:
                    r["mark"], r["live_pct"] = price, (price - r["entry_price"]) / r["entry_price"] * 100
                    self.touched[r["open_id"]] = r
            return
        if action == "open":
            for r in self.rows:
                r["current"] = r["current"] and (r["moderator"], r["expiry_label"]) != (moderator, label)
            row = {"open_id": message_id, "moderator": moderator, "expiry_label": label, "size_label": size, "entry_price": price, "entry_at": at, "remaining": 1.0, "realized": 0.0, "frozen": False, "shadow": None, "current": True, "mark": None, "live_pct": None, "events": [("open", price, None, None, at, message_id)]}
            self.rows.append(row)
            self.touched[message_id] = row
            return
        mine = next((r for r in self.rows if r["current"] and (r["moderator"], r["expiry_label"]) == (moderator, label) and at - r["entry_at"] <= LOOKBACK_DAYS * DAY), None)
        if action == "add":
            if mine:
                self._note(mine, ("add", price, None, None, at, message_id))
            return
        pct = pct if known(pct) else 0.0
        if mine and not mine["frozen"]:
            self._exit(mine, exit_share(action, hint), action, price, pct, at, message_id)
        elif mine:
            mine["shadow"] -= exit_share(action, hint) * mine["shadow"]
            if mine["shadow"] < NOTHING:
                closes = action == "close"
                self._exit(mine, 1.0, "close", price if closes else None, pct if closes else 0.0, at, message_id)
        else:
            old = [r for r in self.rows if (r["frozen"] or at - r["entry_at"] > LOOKBACK_DAYS * DAY) and all(e[5] != message_id for e in r["events"])]
            if old:
                self._exit(min(old, key=lambda r: (r["entry_at"], r["open_id"])), exit_share(action, hint), action, price, pct, at, message_id)

    def settle(self, at: int) -> None:
        """The contract has expired: what is still open settles at the last mark, or at nothing."""
        for r in list(self.rows):
            price = r["mark"] if known(r["mark"]) else 0.0
            pct = (price - r["entry_price"]) / r["entry_price"] * 100 if r["entry_price"] else 0.0
            self._exit(r, 1.0, "close", price, pct, at, -r["open_id"])

    def _note(self, r: dict, event: tuple) -> None:
        r["events"].append(event)
        self.touched[r["open_id"]] = r

    def _exit(self, r: dict, share: float, action: str, price: float | None, pct: float, at: int, message_id: int) -> None:
        part = share * r["remaining"]
        r["realized"] += part * pct
        r["remaining"] = 0.0 if action == "close" else max(0.0, r["remaining"] - part)
        if r["frozen"] or at - r["entry_at"] > LOOKBACK_DAYS * DAY:  # a stored row shows the exit's price as its mark
            r["mark"] = price if known(price) else r["mark"]
        self._note(r, (action, price, part, pct, at, message_id))
        if r["remaining"] < NOTHING:
            r["remaining"], r["live_pct"], r["current"] = 0.0, None, False
            self.rows = [x for x in self.rows if x is not r]


def _expires(expiry: dt.date) -> int:
    """The day after a contract's expiry, in micros."""
    return ((expiry - dt.date(1970, 1, 1)).days + 1) * DAY


def _plain(x):
    """Numbers that are none as None."""
    return x if known(x) else None


class BookProcessor(StatefulProcessor):
    """State: the open rows of a contract with their events, one value. Timer: the day after its expiry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("book", STATE)

    def _load(self) -> Book:
        held = self.state.get()
        rows = [] if held is None else [dict(zip(NAMES, tuple(r), strict=False)) | {"events": [tuple(e) for e in r[len(NAMES)]]} for r in held[0]]
        return Book(rows)

    def _store(self, key: tuple, book: Book) -> Iterator[Row]:
        if book.rows:
            self.state.update(([(*(r[c] for c in NAMES), r["events"]) for r in book.rows],))
        elif book.had:
            self.state.clear()
        if book.rows and not book.had and key[4] is not None:  # a contract that had open rows has its timer
            self.handle.registerTimer(_expires(key[4]) // 1000)
        for r in book.touched.values():
            delta = SIZE_WEIGHT.get(r["size_label"], OTHER_WEIGHT) * (r["realized"] + r["remaining"] * (r["live_pct"] or 0.0))
            status = "OPEN" if any(x is r for x in book.rows) else "CLOSED"
            events = [dict(zip(LINE_NAMES, e, strict=True)) for e in r["events"]]
            out = (*key, r["open_id"], r["moderator"], r["expiry_label"], r["size_label"], r["entry_price"], r["entry_at"], r["remaining"], r["realized"], status, r["frozen"], r["mark"], r["live_pct"], delta, len(events), events)
            yield Row(**dict(zip(OUT_NAMES, out, strict=True)))

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        book = self._load()
        for r in initialState["stored"]:
            frozen, left = bool(r["frozen"]), float(r["remaining"])
            # A frozen row's shadow is what its messages alone have left of it.
            shadow = float(r["derived_remaining"]) if frozen and _plain(r["derived_remaining"]) is not None else left if frozen else None
            events = [(e["action"], _plain(e["price"]), _plain(e["frac_closed"]), _plain(e["pct"]), e["at"], e["message_id"]) for e in r["events"]]
            book.rows.append({"open_id": r["open_id"], "moderator": r["moderator"], "expiry_label": r["expiry_label"] or "", "size_label": r["size_label"], "entry_price": float(r["entry_price"]), "entry_at": r["entry_at"], "remaining": left, "realized": float(r["realized"]), "frozen": frozen, "shadow": shadow, "current": bool(r["current"]), "mark": _plain(r["mark"]), "live_pct": _plain(r["live_pct"]), "events": events})
        for _ in self._store(key, book):
            pass

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        book = self._load()
        for m in sorted(rows, key=lambda m: (m["micros"], m["message_id"])):
            book.take(m["action"], m["micros"], m["message_id"], _plain(m["price"]), _plain(m["pct"]), _plain(m["frac_hint"]), m["size_label"], m["moderator"] or "unknown", m["expiry_label"] or "")
        yield from self._store(key, book)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        book = self._load()
        book.settle(_expires(key[4]) - DAY)
        yield from self._store(key, book)

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Timers and initial states need the state store that keeps them off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


MESSAGES = ["action", "at", "message_id", "price", "pct", "frac_hint", "size_label", "moderator", "expiry_label"]
STORED = ["open_id", "moderator", "expiry_label", "size_label", "entry_price", "entry_at", "remaining", "realized", "frozen", "derived_remaining", "mark", "live_pct", "events", "current"]


def book_stream(messages: DataFrame, stored: DataFrame | None = None, delay: str = "1 hour") -> DataFrame:
    """Changed positions (``BOOK``, update mode) of a stream of parsed messages, and of marks of contracts (action ``mark``).

    ``stored`` has the positions to begin with, closed ones too: of a moderator's positions in a contract and label only
    the last one opened takes more messages. State is keyed by contract; one without an open position has none. Expired options settle once the watermark passes the day after their expiry. Rows of one ``open_id`` replace
    each other.
    """
    spark = messages.sparkSession
    ship(spark)
    use_rocks(spark)
    grouped = messages.select(*CONTRACT, *MESSAGES, F.unix_micros("at").alias("micros")).withWatermark("at", delay).groupBy(*CONTRACT)
    first = None
    if stored is not None:
        last = W.partitionBy(*CONTRACT, "moderator", "expiry_label").orderBy(F.desc("entry_at"), F.desc("open_id"))
        held = stored.withColumn("current", F.row_number().over(last) == 1).filter("status = 'OPEN'").select(*CONTRACT, *STORED)
        held = held.withColumns({"entry_at": F.unix_micros("entry_at"), "events": _lines(F.unix_micros)})
        # One row for each contract: its state is written once.
        first = held.groupBy(*CONTRACT).agg(F.collect_list(F.struct(*STORED)).alias("stored")).groupBy(*CONTRACT)
    changed = grouped.transformWithState(BookProcessor(), OUT, "Update", "EventTime", first)
    return changed.withColumns({"entry_at": F.timestamp_micros("entry_at"), "events": _lines(F.timestamp_micros)})


def _lines(time: Callable[[Column], Column]) -> Column:
    """``events`` with their times turned into others."""
    return F.transform("events", lambda e: F.struct(*[(time(e[c]) if c == "at" else e[c]).alias(c) for c in LINE_NAMES]))
