"""The daily hit list: the prior day's bought flow, scored by how many independent signals agree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import js_round
from ..functions.market import contract_label, day_bounds, local_date, money_label, moneyness_weight, option_symbol, prior_weekday
from .positions import shown
from .technicals import weekly_atr_ladder

# Fixed values of the score.
BULL_CP, BEAR_CP, LEAST_VOLUME = 2.0, 0.5, 5000
PRINT_HOURS, LOOKBACK_DAYS, PERSIST_DAYS, PER_DAY, PERSIST_MOST = 48, 9, 5, 5, 20
CONTRACT_DAYS = 92
CONFIDENCE = {"HIGH": ("HIGH",), "HIGH_MED": ("HIGH", "MED"), "ALL": ("HIGH", "MED", "LOW")}
EXECUTIONS = ("SWEEP", "BLOCK", "FLOOR", "SINGLE")


@dataclass(frozen=True)
class Criteria:
    """What qualifies; values out of range are refused."""

    min_premium: float = 700_000.0
    confidence: str = "HIGH_MED"
    executions: tuple[str, ...] = EXECUTIONS
    max_alerts: int = 10
    exclude_sectors: tuple[str, ...] = ()
    require_print: bool = False

    def __post_init__(self) -> None:
        if self.min_premium < 0 or not 1 <= self.max_alerts <= 100:
            raise ValueError("min_premium must be 0 or more and max_alerts from 1 to 100")
        if self.confidence not in CONFIDENCE or not set(self.executions) <= set(EXECUTIONS) or not self.executions:
            raise ValueError("unknown confidence or execution types")


def qualifying(alerts: DataFrame, criteria: Criteria, day: Column) -> DataFrame:
    """Alerts of the New York day before ``day`` (no holidays) that were bought and meet the criteria."""
    start, end = day_bounds(prior_weekday(day))
    out = alerts.filter((F.col("time") >= start) & (F.col("time") < end) & (F.col("side") == "BUY") & (F.col("premium") >= criteria.min_premium))
    out = out.filter(F.col("confidence").isin(*CONFIDENCE[criteria.confidence]) & F.col("exec").isin(*criteria.executions))
    return out.filter(~F.col("sector").isin(*criteria.exclude_sectors)) if criteria.exclude_sectors else out


def by_ticker(alerts: DataFrame, day: Column) -> DataFrame:
    """Totals, best confidence, majority direction (a tie is up), top alert and contract to watch of each ticker."""
    weighted = F.col("premium") * moneyness_weight(F.col("type"), F.col("strike"), F.col("spot"))
    grade = F.when(F.col("confidence") == "HIGH", 3).when(F.col("confidence") == "MED", 2).otherwise(1)
    order = W.partitionBy("ticker").orderBy(F.desc("premium"), "id")
    a = alerts.withColumns({"w": weighted, "grade": grade, "n": F.row_number().over(order)})
    top = F.min_by(F.struct("strike", "type", "expiry", "spot", "premium", "sector"), "n")
    g = a.groupBy("ticker").agg(
        F.sum("premium").alias("total_premium"), F.sum("w").alias("weighted_premium"), F.count("*").alias("n_alerts"), F.max("grade").alias("grade"), F.count_if(F.col("sentiment") == "BULLISH").alias("bull"), F.count_if(F.col("sentiment") == "BEARISH").alias("bear"),
        top.alias("top"), F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", "strike", "type", "expiry", "w")))).alias("contracts"),
    )
    g = g.withColumn("direction", F.when(F.col("bear") > F.col("bull"), "DOWN").otherwise("UP")).withColumn("sector", F.col("top.sector"))
    want = F.when(F.col("direction") == "UP", "CALL").otherwise("PUT")
    alive = F.filter("contracts", lambda c: (c["expiry"] > day) & (c["expiry"] <= F.date_add(day, CONTRACT_DAYS)))
    g = g.withColumn("alive", alive).withColumn("sided", F.filter("alive", lambda c: c["type"] == want))
    pool = F.when(F.size("sided") > 0, F.col("sided")).otherwise(F.col("alive"))
    best = F.try_element_at(F.array_sort(pool, lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).otherwise(a["n"] - b["n"])), F.lit(1))
    g = g.withColumn("pick", best)
    use = F.coalesce("pick.strike", "top.strike"), F.coalesce("pick.type", "top.type"), F.coalesce("pick.expiry", "top.expiry")
    g = g.withColumns({"contract": contract_label(*use), "contract_occ": F.when(F.col("pick").isNotNull(), option_symbol(F.col("ticker"), F.col("pick.expiry"), F.col("pick.type"), F.col("pick.strike"))), "spot": F.col("top.spot")})
    return g.drop("alive", "sided", "pick", "top", "bull", "bear")


def latest_sentiment(snapshots: DataFrame) -> DataFrame:
    """Call to put ratio of each ticker's snapshot on the newest date, where it traded enough."""
    newest = snapshots.agg(F.max("date").alias("date"))
    s = snapshots.join(F.broadcast(newest), "date").filter((F.col("call_vol") + F.col("put_vol") >= LEAST_VOLUME) & (F.col("put_vol") > 0))
    return s.select("ticker", (F.col("call_vol") / F.col("put_vol")).alias("cp"))


def persistence(alerts: DataFrame, snapshots: DataFrame, day: Column, min_premium: float) -> DataFrame:
    """Distinct days before the flow day on which a ticker had the premium or an extreme ratio, at most five."""
    end = prior_weekday(day)
    start = F.date_sub(end, LOOKBACK_DAYS)
    local = local_date(F.col("time"))
    flow = alerts.filter((local >= start) & (local < end)).groupBy("ticker", local.alias("d")).agg(F.sum("premium").alias("p")).filter(F.col("p") >= min_premium).select("ticker", "d")
    cp = F.col("call_vol") / F.nullif("put_vol", F.lit(0.0))
    extreme = snapshots.filter((F.col("date") >= start) & (F.col("date") < end) & (F.col("call_vol") + F.col("put_vol") >= LEAST_VOLUME) & ((cp >= BULL_CP) | (cp <= BEAR_CP))).select("ticker", F.col("date").alias("d"))
    return flow.union(extreme).distinct().groupBy("ticker").agg(F.least(F.count("*"), F.lit(PERSIST_DAYS)).alias("days"))


def best_print(prints: DataFrame, as_of: Column) -> DataFrame:
    """The best ranked print of each ticker in the 48 hours before ``as_of``: rank, premium, and whether it is of that New
    York day or older."""
    recent = prints.filter(F.col("rank").isNotNull() & (F.col("executed_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(PRINT_HOURS))))
    g = recent.groupBy("ticker").agg(F.min_by(F.struct("rank", "executed_at", "premium"), F.struct("rank", "executed_at")).alias("x"))
    start, _ = day_bounds(local_date(as_of))
    return g.select("ticker", F.col("x.rank").alias("print_rank"), F.when(F.col("x.executed_at") >= start, "today").otherwise("yesterday").alias("print_age"), F.col("x.premium").alias("print_premium"))


def score(candidates: DataFrame) -> DataFrame:
    """Flow (40), sentiment (25), print (15), persistence (20) points; a tenth more if flow and sentiment agree.

    The percentile ranks all candidates of a day against each other: some hundred rows.
    """
    share = F.cume_dist().over(W.orderBy("weighted_premium"))
    grade = F.when(F.col("grade") == 3, 1.0).when(F.col("grade") == 2, 0.8).otherwise(0.6)
    cp = F.col("cp")
    fires = F.coalesce((cp >= BULL_CP) | (cp <= BEAR_CP), F.lit(False))
    extreme = F.when(cp >= BULL_CP, cp).otherwise(1 / F.greatest(cp, F.lit(0.01)))
    sentiment = F.when(fires, F.greatest(F.least(F.lit(25.0), 25 * (extreme - 1.5) / 4.5), F.lit(6.0))).otherwise(0.0)
    out = candidates.withColumns({"flow_pts": 40 * share * grade, "sentiment_pts": sentiment, "print_pts": F.when(F.col("print_rank") <= 10, 15.0).when(F.col("print_rank").isNotNull(), 10.0).otherwise(0.0), "persistence_pts": F.least(F.lit(float(PERSIST_MOST)), F.coalesce("days", F.lit(0)) * float(PER_DAY))})
    agree = fires & (F.when(cp >= 1, "UP").otherwise("DOWN") == F.col("direction"))
    total = F.col("flow_pts") + F.col("sentiment_pts") + F.col("print_pts") + F.col("persistence_pts")
    return out.withColumns({"agree": agree, "total": total * F.when(agree, 1.1).otherwise(1.0)})


def peers_and_theme(candidates: DataFrame, peers: int = 3, names: int = 6) -> DataFrame:
    """Of each ticker's sector: the other leaders, the theme's tickers and total. Only the leaders are collected."""
    order = W.partitionBy("sector").orderBy(F.desc("total_premium"), "ticker")
    ranked = candidates.select("sector", "ticker", "total_premium", "direction", F.row_number().over(order).alias("n"))
    lead = ranked.groupBy("sector").agg(F.sort_array(F.collect_list(F.when(F.col("n") <= max(names, peers + 1), F.struct("n", "ticker", "total_premium", "direction")))).alias("lead"), F.sum("total_premium").alias("theme_premium"))
    out = candidates.select("ticker", "sector").join(lead, "sector")
    mine = F.slice(F.filter("lead", lambda x: x["ticker"] != F.col("ticker")), 1, peers)
    return out.select("ticker", mine.alias("peers"), F.transform(F.slice("lead", 1, names), lambda x: x["ticker"]).alias("theme_tickers"), "theme_premium")


def thesis(hits: DataFrame) -> DataFrame:
    """One sentence of why the ticker is on the list."""
    words = F.concat(
        F.col("ticker"), F.lit(": "), money_label(F.col("total_premium")), F.lit(" bought in "), F.col("n_alerts").cast("string"), F.when(F.col("n_alerts") == 1, " alert").otherwise(" alerts"), F.lit(", "), F.when(F.col("direction") == "UP", "bullish").otherwise("bearish"),
        F.when(F.col("agree"), ", chain sentiment agrees").otherwise(""), F.when(F.col("print_rank").isNotNull(), F.concat(F.lit(", ranked print #"), F.col("print_rank").cast("string"))).otherwise(""), F.when(F.coalesce("days", F.lit(0)) > 0, F.concat(F.lit(", seen on "), F.col("days").cast("string"), F.lit(" prior days"))).otherwise(""),
    )
    return hits.withColumn("thesis", words)


def hit_list(alerts: DataFrame, prints: DataFrame, snapshots: DataFrame, criteria: Criteria, day: Column, weeks: DataFrame | None = None, quotes: DataFrame | None = None) -> DataFrame:
    """The day's list: (rank, ticker, points, contract, print, peers, theme, thesis), best first.

    With ``weeks`` (weekly bars, the one in progress too) each row has its weekly range and targets (null without enough
    weeks), by the spot of the top alert; with ``quotes`` of contracts the entry and last price, which are the
    mark of the suggested contract at the time of the list.
    """
    base = by_ticker(qualifying(alerts, criteria, day), day)
    near = best_print(prints, day.cast("timestamp"))
    base = base.join(near, "ticker", "inner" if criteria.require_print else "left").join(latest_sentiment(snapshots), "ticker", "left").join(persistence(alerts, snapshots, day, criteria.min_premium), "ticker", "left")
    best = score(base).withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), F.desc("total_premium"), "ticker"))).filter(F.col("rank") <= criteria.max_alerts)
    out = thesis(best.join(peers_and_theme(base), "ticker"))
    if weeks is not None:
        out = out.join(weekly_atr_ladder(weeks, best.select("ticker", "spot")).drop("spot"), "ticker", "left")
    if quotes is not None:
        mark = option_marks(quotes).select(F.col("occ").alias("contract_occ"), F.round("mark", 4).alias("entry_price"))
        out = out.join(mark, "contract_occ", "left").withColumn("last_price", F.col("entry_price"))
    rounded = {c: js_round(F.col(c), 1) for c in ("flow_pts", "sentiment_pts", "total")}
    return out.withColumns(rounded)


def session_meta(hits: DataFrame) -> DataFrame:
    """Total premium, that of either direction, and the leading sector."""
    lead = hits.groupBy("sector").agg(F.sum("total_premium").alias("p")).agg(F.max_by("sector", F.struct("p", "sector")).alias("lead_sector"))
    up = F.sum(F.when(F.col("direction") == "UP", F.col("total_premium")).otherwise(0.0))
    return hits.agg(F.sum("total_premium").alias("total"), up.alias("up"), (F.sum("total_premium") - up).alias("down")).join(F.broadcast(lead))


def option_marks(quotes: DataFrame) -> DataFrame:
    """Of each contract's latest quote: the middle of bid and ask if both are positive, or else a positive last price."""
    q = quotes.groupBy("occ").agg(F.max_by(F.struct("bid", "ask", "last"), "date").alias("q"))
    return q.select("occ", F.when((F.col("q.bid") > 0) & (F.col("q.ask") > 0), (F.col("q.bid") + F.col("q.ask")) / 2).when(F.col("q.last") > 0, F.col("q.last")).alias("mark"))


def update_marks(hits: DataFrame, marks: DataFrame) -> DataFrame:
    """last_price follows the mark; entry_price is filled only where it is null."""
    m = hits.join(marks.withColumnRenamed("occ", "contract_occ"), "contract_occ", "left")
    return m.withColumns({"last_price": F.coalesce("mark", "last_price"), "entry_price": F.coalesce("entry_price", "mark")}).drop("mark")


def available_dates(hits: DataFrame, n: int = 30) -> DataFrame:
    return hits.select("date").distinct().orderBy(F.desc("date")).limit(n)


def list_of_day(hits: DataFrame, day: Column) -> DataFrame:
    """The hits of a day, or of the latest one where that day has none, by rank."""
    which = hits.agg(F.coalesce(F.max(F.when(F.col("date") == day, F.col("date"))), F.max("date")).alias("date"))
    return hits.join(F.broadcast(which), "date").orderBy("rank")


def attach_positions(hits: DataFrame, positions: DataFrame) -> DataFrame:
    """Open positions of each hit's ticker, the newest entry first, but for those hidden by hand: contract (strike, side and
    expiry label of an option, else the ticker), side, live per cent and moderator."""
    digits = F.regexp_replace(F.format_string("%.4f", "strike"), r"\.?0+$", "")
    label = F.concat(F.lit("$"), digits, F.when(F.col("side") == "PUT", "P").otherwise("C"), F.coalesce(F.concat(F.lit(" "), "expiry_label"), F.lit("")))
    contract = F.when(F.col("strike").isNotNull(), label).otherwise(F.col("ticker")).alias("contract")
    open_ = shown(positions).filter("status = 'OPEN'").groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("entry_at", "open_id", contract, "side", "live_pct", "moderator")), asc=False).alias("open_positions"))
    return hits.join(open_, "ticker", "left")


def ladder_overlay(hits: DataFrame) -> DataFrame:
    """The latest row with targets of each ticker, those of its direction, all positive."""
    last = hits.filter(F.col("up1").isNotNull()).groupBy("ticker").agg(F.max_by(F.struct("direction", "up05", "up1", "up2", "dn05", "dn1", "dn2"), "date").alias("x"))
    up = F.col("x.direction") == "UP"
    out = last.select("ticker", *[F.when(up, F.col(f"x.up{k}")).otherwise(F.col(f"x.dn{k}")).alias(f"t{k}") for k in ("05", "1", "2")])
    return out.filter("t05 > 0 and t1 > 0 and t2 > 0")
