"""Positions from chat messages: parsing, stitching, pricing, statistics, and exits of stored positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship

# Weight of a position by its size label, the share a trim closes without a hint, and what counts as nothing.
SIZE_WEIGHT = {"Large": 0.1, "Medium": 0.05, "Small": 0.01, "Lotto": 0.005}
OTHER_WEIGHT, TRIM_SHARE, NOTHING = 0.01, 0.5, 1e-6
#: What titles say of an action, the first that fits; what sizes start with, or are in short.
TITLES = (("BUY TO OPEN", "open"), ("ADD", "add"), ("SCALE OUT", "trim"), ("SELL TO CLOSE", "close"))
SIZES = (("large", "l", "Large"), ("medium", "m", "Medium"), ("lotto", "lotto", "Lotto"))
SHARES = (("half", 0.5), ("quarter", 0.25), ("third", 1 / 3))

DIGITS, LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BLANKS = "\t\n\x0b\x0c\r "
CONTRACT = ["asset_type", "ticker", "side", "strike", "expiry"]
MESSAGE = ["action", "at", "message_id", "price", "pct", "frac_hint", "size_label"]
EVENT = "action string, price double, frac_closed double, pct double, at timestamp, message_id long"
STAMP = pa.timestamp("us", "UTC")
POSITION = f"key string, open_id long, size_label string, entry_price double, entry_at timestamp, remaining double, realized double, status string, n_events int, n_orphans int, events array<struct<{EVENT.replace(' ', ': ').replace(',:', ',')}>>"


# --- messages ------------------------------------------------------------------------------------------------------


def _clean(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.btrim(F.translate(F.coalesce(c, F.lit("")), BLANKS, " " * len(BLANKS)))


def _made_of(text: Column, allowed: str, least: int, most: int) -> Column:
    """Whether a text has only the allowed characters, and so many of them."""
    return (F.length(F.translate(text, allowed, "")) == 0) & F.length(text).between(least, most)


def _is_ticker(word: Column) -> Column:
    return _made_of(word, LETTERS + ".", 1, 6)


def _is_strike(word: Column) -> Column:
    halves = F.split(word, "[.]")
    return (F.size(halves) <= 2) & F.forall(halves, lambda h: _made_of(h, DIGITS, 1, 99))


def _number(text: Column) -> Column:
    """The number that a text starts with; null if there is none."""
    return F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1).try_cast("double")


def option_words(contract: Column) -> tuple[Column, Column, Column, Column]:
    """Whether a contract reads ``TICKER STRIKE C`` or ``P`` to its end, and the ticker, strike and side it names."""
    text = _clean(contract)
    side, words = F.upper(F.right(text, F.lit(1))), F.filter(F.split(F.left(text, F.length(text) - 1), " "), lambda w: w != "")
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit(""))
    fits = side.isin("C", "P") & (F.size(words) == 2) & _is_ticker(word(0)) & _is_strike(word(1))
    return fits, F.upper(word(0)), word(1).try_cast("double"), F.when(side == "C", "CALL").otherwise("PUT")


def expiry_of(label: Column, at: Column) -> Column:
    """``month/day`` with a year of two to four digits, or without: then that of the message, or the next if the day was
    over a week before it. Months and days beyond their ends run on; other labels give null."""
    parts = F.transform(F.split(_clean(label), "/"), lambda p: F.btrim(p))
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    fits = F.size(parts).isin(2, 3) & _made_of(part(0), DIGITS, 1, 2) & _made_of(part(1), DIGITS, 1, 2) & ((F.size(parts) == 2) | _made_of(part(2), DIGITS, 2, 4))
    number = lambda k: part(k).try_cast("int")
    on = lambda year: F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), number(0) - 1), number(1) - 1)
    this = on(F.year(at))
    given = F.when(F.length(part(2)) == 2, number(2) + 2000).otherwise(number(2))
    passed = this.cast("timestamp") < at - F.make_dt_interval(F.lit(7))
    return F.when(fits, F.when(F.size(parts) == 3, on(given)).when(passed, on(F.year(at) + 1)).otherwise(this))


def size_label(text: Column) -> Column:
    low = F.lower(_clean(text))
    out = F.when(F.lit(False), "")
    for start, short, label in SIZES:
        out = out.when(low.startswith(start) | (low == short), label)
    return out.otherwise("Small")


def parse_messages(raw: DataFrame) -> DataFrame:
    """Chat messages (id, at, title, contract, expiration, entry_price, exit_price, pct, size, notes, and asset_type and
    moderator if there are any) -> events with action, contract parts, price, per cent, share and ``key``.

    The title names the action in capitals. A contract is an option, or a ticker alone that is held long, but for
    ``asset_type`` option. Opens and adds have the entry's price, exits the exit's. Opens alone have a size. Messages
    without action, contract or price are no events. ``key`` joins moderator, ticker, side, strike and expiry label.
    """
    has = lambda name, other: F.col(name) if name in raw.columns else F.lit(other)
    title = F.coalesce("title", F.lit(""))
    action = F.coalesce(*(F.when(title.contains(words), name) for words, name in TITLES))
    is_option, ticker, strike, side = option_words(F.col("contract"))
    kind = F.coalesce(has("asset_type", None).cast("string"), F.when(is_option, "option").otherwise("equity"))
    stock = _is_ticker(_clean("contract")) & (kind != "option")
    hay = F.lower(F.concat_ws(" ", title, F.coalesce("notes", F.lit(""))))
    per_cent = F.regexp_extract(hay, r"\b(25|50|75)\s*%", 1).try_cast("double") / 100
    share = F.coalesce(per_cent, *(F.when(hay.rlike(rf"\b{word}\b"), value) for word, value in SHARES))
    paid = F.when(F.col("action").isin("open", "add"), F.col("entry_price")).otherwise(F.col("exit_price"))
    label = F.nullif(F.coalesce("expiration", F.lit("")), F.lit(""))
    out = raw.withColumn("action", action).filter("action is not null").withColumns({
        "fits": is_option | stock, "asset_type": kind, "ticker": F.when(is_option, ticker).otherwise(F.upper(_clean("contract"))), "strike": F.when(is_option, strike), "side": F.when(is_option, side).otherwise("LONG"),
        "expiry_label": label, "expiry": expiry_of(F.col("expiration"), F.col("at")), "price": _number(F.translate(F.coalesce(paid, F.lit("")), "$,", "")), "pct": _number(F.regexp_replace(F.coalesce("pct", F.lit("")), r"[%+\s]", "")),
        "size_label": F.when(F.col("action") == "open", size_label(F.col("size"))), "frac_hint": share, "moderator": F.coalesce(F.nullif(_clean(has("moderator", None).cast("string")), F.lit("")), F.lit("unknown")),
    })
    out = out.filter(F.col("fits") & F.col("price").isNotNull()).drop("fits")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return out.withColumn("key", F.concat_ws("|", "moderator", "ticker", "side", blank("strike"), blank("expiry_label")))


# --- stitching -----------------------------------------------------------------------------------------------------


def known(x: float | None) -> bool:
    return x is not None and x == x


def exit_share(action: str, hint: float | None) -> float:
    """The share of what remains that an exit closes."""
    return 1.0 if action == "close" else hint if known(hint) else TRIM_SHARE


def opened(at, message_id: int, price: float, size: str | None) -> dict:
    return {"id": message_id, "size": size, "price": price, "at": at, "left": 1.0, "sum": 0.0, "status": "OPEN", "events": [("open", price, None, None, at, message_id)]}


def exited(p: dict, action: str, at, message_id: int, price: float, pct: float | None, hint: float | None) -> None:
    """An exit of a position: its share of what remains is banked at its per cent (0 without one)."""
    part, gain = exit_share(action, hint) * p["left"], pct if known(pct) else 0.0
    p["sum"] += part * gain
    p["left"] = 0.0 if action == "close" else max(0.0, p["left"] - part)
    p["events"].append((action, price, part, gain, at, message_id))
    if p["left"] < NOTHING:
        p["left"], p["status"] = 0.0, "CLOSED"


def fold(messages: list[tuple], state: dict | None = None) -> tuple[list[dict], dict]:
    """Messages (action, at, message_id, price, pct, frac_hint, size_label) of a key in time order -> its positions.

    An open starts a position, and leaves an earlier one as it is; adds are noted; exits close their share; exits
    without an open position are orphans. ``state`` carries the open position over batches.
    """
    state = state or {"open": None, "orphans": 0}
    done = []
    for action, at, message_id, price, pct, hint, size in messages:
        p = state["open"]
        if action == "open":
            if p:
                done.append(p)
            state["open"] = opened(at, message_id, price, size)
        elif p is None:
            state["orphans"] += action in ("trim", "close")
        elif action == "add":
            p["events"].append((action, price, None, None, at, message_id))
        elif action in ("trim", "close"):
            exited(p, action, at, message_id, price, pct, hint)
            if p["status"] == "CLOSED":
                done.append(p)
                state["open"] = None
    return [*done, *([state["open"]] if state["open"] else [])], state


class Folded:
    """Positions of whole keys, gathered by column: one Arrow batch of ``POSITION``."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.events: list[tuple] = []
        self.ends = [0]

    def add(self, key: str, found: list[dict], orphans: int) -> None:
        for p in found:
            self.rows.append((key, p["id"], p["size"], p["price"], p["at"], p["left"], p["sum"], p["status"], len(p["events"]), orphans))
            self.events += p["events"]
            self.ends.append(len(self.events))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.float64(), STAMP, pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.int32())
        columns = [pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), kinds, strict=True)]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.float64(), STAMP, pa.int64())
        events = [pa.array(c, t) for c, t in zip(zip(*self.events, strict=True), kinds, strict=True)]
        of = pa.StructArray.from_arrays(events, names=[f.split()[0] for f in EVENT.split(", ")])
        names = [f.split()[0] for f in POSITION.split(", events")[0].split(", ")]
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), of)], names=[*names, "events"])


def stitch_positions(messages: DataFrame) -> DataFrame:
    """Fold of every key's messages: one row for each position with its events; ``n_orphans`` is the key's count of exits
    without one. Contract columns of the messages are those of the opening one.

    A partition is sorted by key and time and folded as it passes, so that a key costs its messages and no call of its own.
    """
    ship(messages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, state, done, started = Folded(), None, None, [], False

        def end() -> None:
            out.add(str(key), [*done, *([state["open"]] if state["open"] else [])], state["orphans"])

        for batch in batches:
            columns = {c: batch.column(c) for c in ("key", *MESSAGE)}
            columns["at"] = columns["at"].cast(pa.int64())
            keys = columns.pop("key").to_pylist()
            rows, at = list(zip(*(c.to_pylist() for c in columns.values()), strict=True)), 0
            for own, run_ in groupby(keys):
                n = sum(1 for _ in run_)
                if not started or own != key:
                    if started:
                        end()
                    key, state, done, started = own, None, [], True
                found, state = fold(rows[at : at + n], state)
                done += found[:-1] if state["open"] else found
                at += n
                if len(out.events) > 10_000:
                    yield out.batch()
                    out = Folded()
        if started:
            end()
        if out.rows:
            yield out.batch()

    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    rows = messages.select("key", *[number(c) if c in ("price", "pct", "frac_hint") else c for c in MESSAGE])
    ordered = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_last("at"), F.asc_nulls_last("message_id"))
    out = ordered.mapInArrow(run, POSITION)
    more = [c for c in ("moderator", *CONTRACT, "expiry_label", "hidden") if c in messages.columns]
    return out.join(messages.select(F.col("message_id").alias("open_id"), *more), "open_id") if more else out


def orphan_exits(messages: DataFrame, positions: DataFrame) -> DataFrame:
    """Exits that no position has among its events: their opening message is older than what was read."""
    taken = positions.select(F.explode("events.message_id").alias("message_id"))
    return messages.filter(F.col("action").isin("trim", "close")).join(taken, "message_id", "left_anti")


# --- figures -------------------------------------------------------------------------------------------------------


def weight() -> Column:
    out = F.when(F.col("size_label").isNull(), OTHER_WEIGHT)
    for label, w in SIZE_WEIGHT.items():
        out = out.when(F.col("size_label") == label, w)
    return out.otherwise(OTHER_WEIGHT)


def price_positions(positions: DataFrame, marks: DataFrame, as_of: Column) -> DataFrame:
    """Live per cent of open positions by their marks; expired ones settle at the last mark (0 without one)."""
    p = positions.join(marks.select("key", "mark", "expiry"), "key", "left")
    open_ = F.col("status") == "OPEN"
    expired = open_ & F.coalesce(F.col("expiry") < as_of, F.lit(False))
    mark = F.when(expired, F.coalesce("mark", F.lit(0.0))).otherwise(F.col("mark"))
    p = p.withColumn("live_pct", F.when(open_, (mark - F.col("entry_price")) / F.nullif("entry_price", F.lit(0.0)) * 100))
    p = p.withColumns({"realized": F.when(expired, F.col("realized") + F.col("remaining") * F.coalesce("live_pct", F.lit(0.0))).otherwise(F.col("realized")), "remaining": F.when(expired, 0.0).otherwise(F.col("remaining")), "status": F.when(expired, "CLOSED").otherwise(F.col("status"))})
    return p.withColumn("book_delta", book_delta())


def book_delta() -> Column:
    """What a position adds to the book, in per cent."""
    return weight() * (F.col("realized") + F.col("remaining") * F.coalesce("live_pct", F.lit(0.0)))


def shown(positions: DataFrame) -> DataFrame:
    """Positions that aren't hidden by hand."""
    return positions.filter(~F.coalesce("hidden", F.lit(False))) if "hidden" in positions.columns else positions


def _kinds(positions: DataFrame) -> list[str]:
    return [c for c in ("asset_type",) if c in positions.columns]


def position_stats(positions: DataFrame) -> DataFrame:
    """Open book, mean live per cent, win rate and counts of each asset type (if there is the column), hidden ones left out."""
    open_, closed = F.col("status") == "OPEN", F.col("status") == "CLOSED"
    return shown(positions).groupBy(*_kinds(positions)).agg(
        F.coalesce(F.sum(F.when(open_, F.col("book_delta"))), F.lit(0.0)).alias("open_book_pct"), F.coalesce(F.avg(F.when(open_, F.col("live_pct"))), F.lit(0.0)).alias("mean_live_pct"),
        F.coalesce(F.avg(F.when(closed, (F.col("realized") > 0).cast("double"))), F.lit(0.0)).alias("win_rate"), F.count_if(open_).alias("n_open"), F.count_if(closed).alias("n_closed"),
    )


def equity_curve(positions: DataFrame) -> DataFrame:
    """Running weighted result of each asset type's closed positions in the order of entry, to 3 digits, hidden ones left out.

    Results are taken to 6 digits and summed as decimals, so that the order of addition doesn't matter: within each day
    of entry, on top of the days before (one row a day).
    """
    kinds = _kinds(positions)
    gain = weight().cast("decimal(4,3)") * F.round("realized", 6).cast("decimal(18,6)")
    closed = shown(positions).filter("status = 'CLOSED'").select(*kinds, "entry_at", "key", "open_id", F.to_date("entry_at").alias("day"), gain.alias("gain"))
    days = closed.groupBy(*kinds, "day").agg(F.sum("gain").alias("gain"))
    before = days.select(*kinds, "day", F.coalesce(F.sum("gain").over(W.partitionBy(*kinds).orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("gain").over(W.partitionBy(*kinds, "day").orderBy("entry_at", "key", "open_id").rowsBetween(W.unboundedPreceding, 0))
    cum = F.round(F.col("before") + F.col("own"), 3).cast("double").alias("cum")
    return closed.withColumn("own", own).join(before, [*kinds, "day"]).select(*kinds, "entry_at", "key", "open_id", cum)


def apply_orphan_exits(stored: DataFrame, exits: DataFrame) -> DataFrame:
    """Exits (key, action, at, message_id, pct, frac_hint, and price if there is one) of stored positions, in time order.

    Open positions take them, those corrected by hand as well, each message once. A trim closes its hinted share (or
    half) of what then remains, a close all of it; what comes after the last share finds nothing left. The mark follows the last exit's price.
    """
    none = F.array().cast("array<bigint>")
    open_ = stored.filter("status = 'OPEN'").select("key", F.coalesce("seen_ids", none).alias("_seen"))
    new = exits.filter(F.col("action").isin("trim", "close")).dropDuplicates(["key", "message_id"]).join(open_, "key")
    new = new.filter(~F.array_contains("_seen", F.col("message_id")))
    share = F.when(F.col("action") == "close", 1.0).otherwise(F.coalesce("frac_hint", F.lit(TRIM_SHARE)))
    price = F.col("price") if "price" in exits.columns else F.lit(None).cast("double")
    steps = new.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "message_id", share.alias("share"), F.coalesce("pct", F.lit(0.0)).alias("pct"), price.alias("price")))).alias("_steps"))
    out = stored.join(steps, "key", "left")
    start = F.struct(F.col("remaining").cast("double").alias("left"), F.col("realized").cast("double").alias("sum"))
    # An exit that meets nothing isn't applied: the position is closed by then.
    took = lambda a, x: F.when(a["left"] < NOTHING, a).otherwise(F.struct((a["left"] * (1 - x["share"])).alias("left"), (a["sum"] + a["left"] * x["share"] * x["pct"]).alias("sum")))
    out = out.withColumn("_end", F.when(F.col("_steps").isNotNull(), F.aggregate("_steps", start, took)))
    left = F.coalesce("_end.left", "remaining")
    closed = F.col("_end").isNotNull() & (left < NOTHING)
    more = {"mark": F.coalesce(F.try_element_at(F.filter(F.transform("_steps", lambda x: x["price"]), lambda p: p.isNotNull()), F.lit(-1)), "mark")} if "mark" in stored.columns else {}
    more |= {"live_pct": F.when(~closed, F.col("live_pct"))} if "live_pct" in stored.columns else {}
    out = out.withColumns({
        "realized": F.coalesce("_end.sum", "realized"), "remaining": F.when(left < NOTHING, 0.0).otherwise(left), "status": F.when(closed, "CLOSED").otherwise(F.col("status")),
        "seen_ids": F.array_union(F.coalesce("seen_ids", none), F.coalesce(F.transform("_steps", lambda x: x["message_id"]), none)),
    } | more).drop("_steps", "_end")
    return out.withColumn("book_delta", book_delta()) if "live_pct" in stored.columns else out


def merge_derived(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Positions that were derived anew (open_id, ..., mark, live_pct, occ, events) put onto the stored ones.

    A row that wasn't corrected by hand takes the derived one's fields; its mark and live per cent only if there is a new
    mark or the position closed, else the last good ones stay. A frozen row takes two things: a derived close, which
    closes all that the corrected row still holds at the close's per cent (0 if trims closed it); and, while it is open,
    the mark, if both name the same contract. Its book is then worked out from its own fields.
    """
    d = derived.select("open_id", F.struct(*[c for c in derived.columns if c != "open_id"]).alias("d"))
    both = stored.join(d, "open_id", "full")
    frozen = F.coalesce("frozen", F.lit(False))
    close = F.try_element_at(F.filter("d.events", lambda e: e["action"] == "close"), F.lit(-1))
    ends = frozen & (F.col("status") == "OPEN") & F.coalesce(F.col("d.status") == "CLOSED", F.lit(False))
    marks = frozen & (F.col("status") == "OPEN") & ~ends & F.col("d.mark").isNotNull() & F.col("d.live_pct").isNotNull() & F.col("d.occ").eqNullSafe(F.col("occ"))
    taken = ~frozen & F.col("d").isNotNull()
    fresh = taken & ((F.col("d.status") == "CLOSED") | F.col("d.mark").isNotNull() | F.col("status").isNull())
    gain = F.coalesce(close["pct"], F.lit(0.0))
    new = {
        "status": F.when(ends, "CLOSED").when(taken, F.col("d.status")).otherwise(F.col("status")), "remaining": F.when(ends, 0.0).when(taken, F.col("d.remaining")).otherwise(F.col("remaining")),
        "realized": F.when(ends, F.col("realized") + F.col("remaining") * gain).when(taken, F.col("d.realized")).otherwise(F.col("realized")),
        "mark": F.when(ends, F.coalesce(close["price"], F.col("mark"))).when(marks | fresh, F.col("d.mark")).otherwise(F.col("mark")),
        "live_pct": F.when(ends, None).when(marks | fresh, F.col("d.live_pct")).otherwise(F.col("live_pct")),
        "events": F.when(ends, F.concat("events", F.array(F.struct(F.lit("close").alias("action"), close["price"].alias("price"), F.col("remaining").alias("frac_closed"), gain.alias("pct"), close["at"].alias("at"), close["message_id"].alias("message_id"))))).when(taken, F.col("d.events")).otherwise(F.col("events")),
        "frozen": frozen,
    }
    same = [c for c in stored.columns if c not in new and c not in ("open_id", "book_delta") and c in derived.columns]
    out = both.select("open_id", *[F.when(taken, F.col(f"d.{c}")).otherwise(F.col(c)).alias(c) for c in same], *[v.alias(c) for c, v in new.items()], (ends | marks | fresh).alias("_touched"), *(["book_delta"] if "book_delta" in stored.columns else []))
    kept = F.col("book_delta") if "book_delta" in stored.columns else F.lit(None).cast("double")
    return out.withColumn("book_delta", F.when(F.col("_touched") | kept.isNull(), book_delta()).otherwise(kept)).drop("_touched")
