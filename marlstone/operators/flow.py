"""Option-flow operators: sessions, daily aggregates, screens, feeds, chain sentiment and leaderboards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.exprs import js_round, ratio
from ..functions.kernels import percentile_rank
from ..functions.market import contract_label, local_date, otm_share, second_of_day
from ..functions.ship import ship

CLOSE_SECOND = 57600
#: Events up to so many days before the first trading day move forward to it.
BEFORE = 3660


def add_feature_date(events: DataFrame, ts_col: str, calendar: DataFrame) -> DataFrame:
    """feature_date: the first trading day whose close at 16:00:00 New York the event doesn't come after.

    After the close counts for the next day; weekends and holidays move forward; past the calendar's end it is null.
    A dense map of days (a few thousand rows, one for each calendar day) makes it an equi-join.
    """
    span = calendar.agg(F.date_sub(F.min("date"), BEFORE).alias("a"), F.max("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    marked = days.join(calendar.select(F.col("date").alias("day"), F.col("date").alias("open")), "day", "left")
    ahead = W.orderBy("day").rowsBetween(0, W.unboundedFollowing)
    dense = marked.select("day", F.first("open", ignorenulls=True).over(ahead).alias("feature_date"))
    day = F.date_add(local_date(F.col(ts_col)), F.when(second_of_day(F.col(ts_col)) > CLOSE_SECOND, 1).otherwise(0))
    out = events.withColumn("_day", day)
    return out.join(F.broadcast(dense), out["_day"] == dense["day"], "left").drop("_day", "day")


def aggregate_flow(alerts: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row for each (ticker, date) with alerts: counts, premiums by type and sentiment, sweeps, size, days to expiry."""
    a = add_feature_date(alerts, "time", calendar).filter("feature_date is not null")
    part = lambda c: F.sum(F.when(c, F.col("premium")).otherwise(0.0))
    call, put, sweep = F.col("type") == "CALL", F.col("type") == "PUT", F.col("exec") == "SWEEP"
    bull, bear = F.col("sentiment") == "BULLISH", F.col("sentiment") == "BEARISH"
    out = a.groupBy("ticker", F.col("feature_date").alias("date")).agg(
        F.count("*").alias("flow_alert_count"), F.sum("premium").alias("flow_total_premium"), part(call).alias("flow_call_premium"), part(put).alias("flow_put_premium"),
        part(bull).alias("flow_bullish_premium"), part(bear).alias("flow_bearish_premium"), F.count_if(sweep).alias("flow_sweep_count"), part(sweep).alias("flow_sweep_premium"),
        F.sum("size").alias("flow_total_size"), F.avg(F.datediff("expiry", "feature_date")).alias("flow_avg_dte"), F.count_if(F.col("confidence") == "HIGH").alias("flow_high_conf_count"),
        F.avg(F.col("all_opening").cast("double")).alias("flow_opening_frac"),
    )
    return out.withColumns({"flow_net_call_premium": F.col("flow_call_premium") - F.col("flow_put_premium"), "flow_net_sentiment_premium": F.col("flow_bullish_premium") - F.col("flow_bearish_premium")})


def aggregate_prints(prints: DataFrame, calendar: DataFrame) -> DataFrame:
    p = add_feature_date(prints, "executed_at", calendar).filter("feature_date is not null")
    return p.groupBy("ticker", F.col("feature_date").alias("date")).agg(F.count("*").alias("dp_print_count"), F.sum("premium").alias("dp_total_premium"), F.sum("size").alias("dp_total_size"), F.max("premium").alias("dp_max_premium"))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; running it fails where a key repeats. The check travels with the rows, without a job of its own."""
    n = F.count("*").over(W.partitionBy(*keys))
    return df.withColumn("_ok", F.assert_true(n == 1, F.lit(f"{keys} repeat"))).filter(F.col("_ok").isNull()).drop("_ok")


def join_daily(matrix: DataFrame, daily: DataFrame, has: str, keep_null: tuple[str, ...] = ()) -> DataFrame:
    """Left join on (ticker, date), one to one: counts and sums become 0 without a row, ``keep_null`` stays null."""
    values = [c for c in daily.columns if c not in ("ticker", "date")]
    out = matrix.join(assert_unique(daily, ["ticker", "date"]).withColumn(has, F.lit(1)), ["ticker", "date"], "left")
    filled = [F.col(c) if c in keep_null else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in values]
    return out.select(*matrix.columns, *filled, F.coalesce(has, F.lit(0)).alias(has))


def join_flow_features(matrix: DataFrame, flow: DataFrame, prints: DataFrame) -> DataFrame:
    return join_daily(join_daily(matrix, prints, "has_dp"), flow, "has_flow", ("flow_avg_dte", "flow_opening_frac"))


def print_intensity(matrix: DataFrame, window: int = 126) -> DataFrame:
    """Block premium over dollar volume (0 without volume; to nine digits, so that equal days tie), and its trailing percentile.

    The percentile is a pass over each ticker's dates and shares alone."""
    ship(matrix.sparkSession)
    share = F.round(F.coalesce(ratio(F.col("dp_total_premium"), F.col("close") * F.col("volume")), F.lit(0.0)), 9)
    out = matrix.withColumn("dp_premium_to_dollar_vol", share)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", kind="stable")
        return pdf[["ticker", "date"]].assign(dp_premium_pctile=percentile_rank(pdf["x"].to_numpy(float), window))

    ranks = out.select("ticker", "date", F.col("dp_premium_to_dollar_vol").alias("x")).groupBy("ticker").applyInPandas(run, "ticker string, date date, dp_premium_pctile double")
    return out.join(ranks.withColumn("dp_premium_pctile", F.when(~F.isnan("dp_premium_pctile"), F.col("dp_premium_pctile"))), ["ticker", "date"], "left")


# --- screens and feeds ---------------------------------------------------------------------------------------------


def screen_predicates(as_of: Column, kind: str, exact: bool = False) -> list[tuple[str, Column]]:
    """The named conditions of the lotto or sweeper screen, in order."""
    dte = F.datediff("expiry", local_date(F.col("time")))
    alive = F.col("expiry") >= as_of
    otm = otm_share(F.col("type"), F.col("strike"), F.col("spot"))
    out = [("type", F.col("type").isin("CALL", "PUT")), ("common", F.col("issue_type") == "Common Stock"), ("single_leg", ~F.col("multi_leg"))]
    if kind == "lotto":
        match = (F.col("bid_prem") == 0) & (F.col("ask_prem") >= F.col("premium") - 1) if exact else (F.col("ask_prem") >= F.col("bid_prem")) & (F.col("ask_prem") > 0)
        out += [("premium", F.col("premium") >= 1000), ("size_over_oi", F.col("size") > F.col("oi")), ("exec", match), ("dte", dte.between(0, 14)), ("alive", alive), ("otm", (otm > 0) & otm.between(0.2, 1.0))]
    else:
        share = ratio(F.col("ask_prem"), F.col("premium"))
        out += [("sweep", F.col("exec") == "SWEEP"), ("premium", F.col("premium") >= 100_000), ("spot", F.col("spot") <= 13), ("size_over_oi", (F.col("oi") > 0) & (F.col("size") >= 3 * F.col("oi"))), ("ask_share", share.between(0.73, 1.0)), ("dte", dte.between(0, 14)), ("alive", alive), ("otm", (otm > 0) & otm.between(0.0, 0.12))]
    return out


def screen(alerts: DataFrame, as_of: Column, kind: str, exact: bool = False, limit: int = 200) -> DataFrame:
    """The newest alerts that pass the screen; rows tagged for their own day pass it too, where the tag exists."""
    passed = F.lit(True)
    for _, c in screen_predicates(as_of, kind, exact):
        passed = passed & c
    if kind == "lotto" and "manual_lotto_date" in alerts.columns:
        passed = passed | (F.col("manual_lotto_date") == local_date(F.col("time")))
    return alerts.filter(passed).orderBy(F.desc("time"), "id").limit(limit)


def screen_funnel(alerts: DataFrame, as_of: Column, kind: str, relaxed: tuple[str, ...] = ("size_over_oi", "otm")) -> DataFrame:
    """How many alerts survive each further condition, and how many pass the screen without one of the relaxed
    conditions (``alt_no_*``): which of them cuts most. One pass."""
    named = screen_predicates(as_of, kind)
    counts, passed = [F.count("*").alias("all")], F.lit(True)
    for name, c in named:
        passed = passed & c
        counts.append(F.count_if(passed).alias(name))
    for name in relaxed:
        others = F.lit(True)
        for n, c in named:
            others = others if n == name else others & c
        counts.append(F.count_if(others).alias(f"alt_no_{name}"))
    return alerts.agg(*counts)


def flow_feed(alerts: DataFrame, *, kind=None, side=None, exec_=None, confidence=None, min_premium=None, max_premium=None, ticker=None, sector=None, day=None, sentiment=None, sweep_only=False, otm_only=False, size_over_oi=False, rule_prefix=None, dte=None, sort="time") -> DataFrame:
    """Alerts by the given filters only; newest first, or by premium or size."""
    out = alerts
    for c, v in (("type", kind), ("side", side), ("exec", exec_), ("confidence", confidence), ("ticker", ticker), ("sector", sector), ("sentiment", sentiment)):
        if v is not None:
            out = out.filter(F.col(c) == v)
    if min_premium is not None:
        out = out.filter(F.col("premium") >= min_premium)
    if max_premium is not None:
        out = out.filter(F.col("premium") <= max_premium)
    if day is not None:
        out = out.filter(local_date(F.col("time")) == F.lit(day).cast("date"))
    if sweep_only:
        out = out.filter(F.col("exec") == "SWEEP")
    if otm_only:
        out = out.filter(otm_share(F.col("type"), F.col("strike"), F.col("spot")) > 0)
    if size_over_oi:
        out = out.filter(F.col("size") > F.col("oi"))
    if rule_prefix:
        out = out.filter(F.col("rule").startswith(rule_prefix))
    if dte is not None:
        left = F.datediff("expiry", local_date(F.col("time")))
        out = out.filter(left == 0 if dte == 0 else left.between(0, dte))
    return out.orderBy(F.desc({"time": "time", "premium": "premium", "size": "size"}[sort]), "id")


#: Least and most distance out of the money and least premium of the provider's two presets.
PRESETS = {"lotto": (0.2, 1.0, 1_000.0), "sweeper": (0.0, 0.12, 100_000.0)}


def preset_shape(alerts: DataFrame, preset: str = "lotto", max_dte: int = 14) -> DataFrame:
    """Coarse filter of a preset: single-leg common stock, days left, distance band, all opening, size over open
    interest, ask side, premium."""
    low, high, premium = PRESETS[preset]
    otm = otm_share(F.col("type"), F.col("strike"), F.col("spot"))
    shape = (F.col("issue_type") == "Common Stock") & ~F.col("multi_leg") & F.coalesce("all_opening", F.lit(False)) & (F.col("size") > F.col("oi")) & (F.col("ask_prem") >= F.col("bid_prem"))
    return alerts.filter(shape & (F.datediff("expiry", local_date(F.col("time"))) <= max_dte) & otm.between(low, high) & (F.col("premium") >= premium))


def flow_stats(alerts: DataFrame) -> DataFrame:
    """Count, calls, puts, premium, call to put ratio (0 without calls and puts, infinite without puts), top rule and its per cent."""
    by_rule = alerts.groupBy("rule").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "CALL").alias("calls"), F.count_if(F.col("type") == "PUT").alias("puts"), F.sum("premium").alias("premium"))
    total = by_rule.agg(F.sum("n").alias("n_alerts"), F.sum("calls").alias("calls"), F.sum("puts").alias("puts"), F.sum("premium").alias("premium"), F.max_by("rule", F.struct("n", "rule")).alias("top_rule"), F.max("n").alias("top"))
    cp = F.when(F.col("puts") > 0, F.col("calls") / F.col("puts")).when(F.col("calls") > 0, F.lit(float("inf"))).otherwise(0.0)
    return total.select("n_alerts", "calls", "puts", "premium", cp.alias("cp_ratio"), "top_rule", js_round(F.col("top") * 100 / F.col("n_alerts")).cast("long").alias("top_rule_pct"))


def sector_flow(alerts: DataFrame) -> DataFrame:
    """Signed premium by sector (bearish counts against), with the calls' per cent of the premium."""
    signed = F.when(F.col("sentiment") == "BEARISH", -F.col("premium")).otherwise(F.col("premium"))
    calls = F.sum(F.when(F.col("type") == "CALL", F.col("premium")).otherwise(0.0))
    return alerts.groupBy("sector").agg(F.sum(signed).alias("net_premium"), js_round(calls * 100 / F.sum("premium")).cast("long").alias("call_pct")).orderBy(F.desc("net_premium"))


def net_premium() -> Column:
    """An alert's net premium: ask - bid of a call, bid - ask of a put."""
    return F.when(F.col("type") == "CALL", F.col("ask_prem") - F.col("bid_prem")).otherwise(F.col("bid_prem") - F.col("ask_prem"))


def largest_nets(daily: DataFrame, n: int) -> DataFrame:
    """Of (date, ticker, net) each day's ``n`` tickers with the largest net either way."""
    order = W.partitionBy("date").orderBy(F.desc(F.abs("net")), "ticker")
    return daily.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).drop("n")


def net_impact(alerts: DataFrame, n: int = 10) -> DataFrame:
    """For each New York day the ``n`` tickers with the largest net premium either way."""
    return largest_nets(alerts.groupBy(local_date(F.col("time")).alias("date"), "ticker").agg(F.round(F.sum(net_premium()), 6).alias("net")), n)


# --- chain sentiment -----------------------------------------------------------------------------------------------


def aggregate_sentiment(chain: DataFrame) -> DataFrame:
    """Sums and ratios of a ticker's chain for a day: whole, at the money (2.5 %), far out of it (5 %)."""
    near = F.abs(F.col("k") - F.col("spot")) <= 0.025 * F.col("spot")
    far_call, far_put = F.col("k") > F.col("spot") * 1.05, F.col("k") < F.col("spot") * 0.95
    part = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0.0))
    g = chain.groupBy("ticker", "date").agg(
        *[F.sum(c).alias(f"_{c}") for c in ("cA", "cB", "pA", "pB", "cP", "pP")], F.sum(F.abs("cP") + F.abs("pP")).alias("_abs"), *[part(near, c).alias(f"_n{c}") for c in ("cA", "cB", "pA", "pB")],
        part(far_call, "cA").alias("_fc"), part(far_put, "pA").alias("_fp"), F.count_distinct("k").alias("sent_strike_count"),
    )
    c = F.col
    return g.select(
        "ticker", "date", (c("_cA") + c("_cB")).alias("sent_call_vol"), (c("_pA") + c("_pB")).alias("sent_put_vol"), c("_cP").alias("sent_net_call_prem"), c("_pP").alias("sent_net_put_prem"), (c("_cP") - c("_pP")).alias("sent_net_dir_prem"), "sent_strike_count",
        ratio(c("_cA") + c("_cB"), c("_pA") + c("_pB")).alias("sent_cp_ratio"), ratio(c("_cA"), c("_cA") + c("_cB")).alias("sent_call_buy_frac"), ratio(c("_pA"), c("_pA") + c("_pB")).alias("sent_put_buy_frac"), ratio(c("_cP") - c("_pP"), c("_abs")).alias("sent_dir_prem_score"),
        ratio(c("_ncA") - c("_ncB"), c("_ncA") + c("_ncB")).alias("sent_atm_call_imb"), ratio(c("_npA") - c("_npB"), c("_npA") + c("_npB")).alias("sent_atm_put_imb"), ratio(c("_fc"), c("_cA")).alias("sent_otm_call_buy_frac"), ratio(c("_fp"), c("_pA")).alias("sent_otm_put_buy_frac"),
    )


def join_sentiment(matrix: DataFrame, sentiment: DataFrame) -> DataFrame:
    ratios = tuple(c for c in sentiment.columns if c.endswith(("_ratio", "_frac", "_score", "_imb")))
    return join_daily(matrix, sentiment, "has_sentiment", ratios)


SIDES = ("cA", "cB", "pA", "pB")
PREMIUMS = ("cPA", "cPB", "pPA", "pPB")


def chain_minute(chain: DataFrame, band: float = 0.12, most: int = 60) -> DataFrame:
    """A chain within 12 % of the reference (all strikes if none is), its 60 nearest strikes, as one snapshot row.

    Premiums by side are carried along where the chain has them.
    """
    inside = F.abs(F.col("k") - F.col("spot")) <= F.col("spot") * band
    key = W.partitionBy("ticker", "date")
    some = chain.withColumn("_in", inside).withColumn("_any", F.max("_in").over(key)).filter("_in or not _any")
    near = some.withColumn("_n", F.row_number().over(key.orderBy(F.abs(F.col("k") - F.col("spot")), "k"))).filter(F.col("_n") <= most)
    held = ["k", *SIDES, "cP", "pP", *[c for c in PREMIUMS if c in chain.columns]]
    g = near.groupBy("ticker", "date").agg(
        F.max("spot").alias("spot"), F.sum(F.col("cA") + F.col("cB")).alias("call_vol"), F.sum(F.col("pA") + F.col("pB")).alias("put_vol"), F.sum(F.col("cP") - F.col("pP")).alias("net"), F.sum(F.abs("cP") + F.abs("pP")).alias("abs_prem"),
        F.sort_array(F.collect_list(F.struct(*held))).alias("strikes"),
    )
    mood = F.when((F.col("abs_prem") > 0) & (F.abs("net") < 0.1 * F.col("abs_prem")), "NEUTRAL").when(F.col("net") >= 0, "BULLISH").otherwise("BEARISH")
    return g.withColumns({"cp_ratio": F.when(F.col("put_vol") > 0, F.col("call_vol") / F.col("put_vol")).otherwise(0.0), "sentiment": mood})


def capped_ratio(a: Column, b: Column, cap: float = 99.0) -> Column:
    """a / b up to the cap, which also stands in for a positive a over nothing; 0 for nothing over nothing."""
    return F.when(b > 0, F.least(a / b, F.lit(cap))).when(a > 0, cap).otherwise(0.0)


def mode_legs(ask: Column, bid: Column, mode: str) -> Column:
    """A side's volume or premium: all of it, the ask side only, or ask less bid with its sign."""
    return ask + bid if mode == "all" else ask if mode == "ask" else ask - bid


def mode_ratio(calls: tuple[Column, Column], puts: tuple[Column, Column], mode: str, cap: float = 99.0) -> Column:
    """Calls over puts, signed in net mode, within the cap either way; null without puts."""
    c, p = mode_legs(*calls, mode), mode_legs(*puts, mode)
    return F.greatest(F.lit(-cap), F.least(c / F.nullif(p, F.lit(0.0)), F.lit(cap)))


def _strike_sums(snapshots: DataFrame) -> tuple[DataFrame, bool]:
    """Snapshots with the sum of each side over their strikes, and whether the schema has premiums by side. A snapshot of
    which no strike has them, as on old days, has its volumes in their place."""
    fields = snapshots.schema["strikes"].dataType.elementType.fieldNames()
    some = all(c in fields for c in PREMIUMS)
    add = lambda c: F.aggregate("strikes", F.lit(0.0), lambda acc, s: acc + F.coalesce(s[c], F.lit(0.0)))
    known = F.exists("strikes", lambda s: s[PREMIUMS[0]].isNotNull()) if some else None
    rated = {p: F.when(known, add(p)).otherwise(add(c)) for c, p in zip(SIDES, PREMIUMS, strict=True)} if some else {}
    return snapshots.withColumns({c: add(c) for c in SIDES} | rated), some


def market_sentiment(snapshots: DataFrame, day: Column | None = None, least: float = 5000.0) -> DataFrame:
    """The last snapshot of each ticker of one day, the newest by default: volumes, ratios capped at 99, and whether it
    trades enough. Buy to sell ratios go by premium where it is known by side, else by volume."""
    of_day = snapshots.filter(F.col("date") == day) if day is not None else snapshots.join(F.broadcast(snapshots.agg(F.max("date").alias("date"))), "date")
    last = of_day.groupBy("ticker").agg(F.max_by(F.struct("call_vol", "put_vol", "strikes", "sentiment"), "date").alias("x")).select("ticker", "x.*")
    out, premium = _strike_sums(last)
    ca, cb, pa, pb = (F.col(c) for c in (PREMIUMS if premium else SIDES))
    legs = [c for c in (*SIDES, *(PREMIUMS if premium else ()))]
    return out.select(
        "ticker", "sentiment", "call_vol", "put_vol", capped_ratio(F.col("call_vol"), F.col("put_vol")).alias("cp"), capped_ratio(ca, cb).alias("call_bs"), capped_ratio(pa, pb).alias("put_bs"),
        (F.col("call_vol") + F.col("put_vol") >= least).alias("liquid"), *legs,
    )


def sentiment_leaders(summary: DataFrame, mode: str = "all", n: int = 20) -> DataFrame:
    """Of the tickers that trade enough, the ``n`` most bullish (ratio over 2, high first) and bearish (under 0.5, low
    first) by the ratio of a side mode; those without one are left out."""
    ca, cb, pa, pb = (F.col(c) for c in (PREMIUMS if "cPA" in summary.columns else SIDES))
    rated = summary.filter("liquid").select("ticker", mode_ratio((ca, cb), (pa, pb), mode).alias("cp"))
    cp = F.col("cp")
    sided = rated.withColumn("board", F.when(cp > 2, "bull").when(cp < 0.5, "bear")).filter("board is not null")
    order = W.partitionBy("board").orderBy(F.when(F.col("board") == "bull", -cp).otherwise(cp), "ticker")
    return sided.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("board", "rank", "ticker", "cp")


def side_mode(strikes: DataFrame, mode: str) -> DataFrame:
    """Per-strike volumes for all sides, the ask side only, or net (positive legs of ask less bid), and the buy to sell
    ratio of either side (infinite without sales, null without any flow)."""
    c = F.col
    bs = lambda a, b: F.when(b > 0, a / b).when(a > 0, F.lit(float("inf")))
    out = strikes.withColumns({"call_bs": bs(c("cA"), c("cB")), "put_bs": bs(c("pA"), c("pB"))})
    if mode == "ask":
        return out.withColumns({"call": c("cA"), "put": c("pA")})
    if mode == "net":
        return out.withColumns({"call": F.greatest(c("cA") - c("cB"), F.lit(0.0)), "put": F.greatest(c("pA") - c("pB"), F.lit(0.0)), "call_sold": F.greatest(c("cB") - c("cA"), F.lit(0.0)), "put_sold": F.greatest(c("pB") - c("pA"), F.lit(0.0))})
    return out.withColumns({"call": c("cA") + c("cB"), "put": c("pA") + c("pB")})


def minute_of(days: DataFrame, minute: Column | None = None) -> DataFrame:
    """(ticker, date, spot, strikes) of a minute ``t`` of each day's array, or of its last one where that minute is missing."""
    last = F.try_element_at("minutes", F.lit(-1))
    at = F.lit(None) if minute is None else F.try_element_at(F.filter("minutes", lambda m: m["t"] == minute), F.lit(1))
    picked = last if minute is None else F.coalesce(at, last)
    return days.select("ticker", "date", picked.alias("m")).select("ticker", "date", F.col("m.t").alias("t"), F.col("m.spot").alias("spot"), F.col("m.strikes").alias("strikes"))


def chain_totals(snapshots: DataFrame, mode: str = "all", n: int = 20) -> DataFrame:
    """(ticker, date, call, put, cp, and buys, sales and their ratio of either side over the ``n`` strikes around spot).

    Call and put totals are over the snapshot's whole chain by side mode, signed in net mode; ``cp`` goes by premium where
    it is known by side. Ratios of the shown strikes don't depend on the mode; they are 0 without sales.
    """
    sums, premium = _strike_sums(snapshots)
    ca, cb, pa, pb = (F.col(c) for c in SIDES)
    rated = [F.col(c) for c in (PREMIUMS if premium else SIDES)]
    whole = sums.select("ticker", "date", mode_legs(ca, cb, mode).alias("call"), mode_legs(pa, pb, mode).alias("put"), mode_ratio((rated[0], rated[1]), (rated[2], rated[3]), mode).alias("cp"))
    rows = snapshots.select("ticker", "date", "spot", F.explode("strikes").alias("s")).select("ticker", "date", "spot", F.col("s.k").alias("strike"), *[F.col(f"s.{c}").alias(c) for c in SIDES])
    shown = centred_strikes(rows, ["ticker", "date"], n).groupBy("ticker", "date").agg(F.sum("cA").alias("buy_call"), F.sum("cB").alias("sell_call"), F.sum("pA").alias("buy_put"), F.sum("pB").alias("sell_put"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return whole.join(shown, ["ticker", "date"], "left").withColumns({"call_bs": rate("buy_call", "sell_call"), "put_bs": rate("buy_put", "sell_put")})


def centred_strikes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """floor(n / 2) strikes below spot and the rest at or above it, the nearest of each; a short side is made up by the other."""
    below = F.col("strike") < F.col("spot")
    side = W.partitionBy(*keys, "_below")
    out = rows.withColumn("_below", below).withColumn("_n", F.row_number().over(side.orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")))
    counts = W.partitionBy(*keys)
    nb, na = F.count_if("_below").over(counts), F.count_if(~F.col("_below")).over(counts)
    want = n // 2
    out = out.withColumns({"_nb": nb, "_na": na})
    above = F.least((n - want) + F.greatest(F.lit(0), want - F.col("_nb")), F.col("_na"))
    under = F.least(want + F.greatest(F.lit(0), (n - want) - above), F.col("_nb"))
    return out.filter(F.when(F.col("_below"), F.col("_n") <= under).otherwise(F.col("_n") <= above)).drop("_below", "_n", "_nb", "_na")


def order_mining_set(alerts: DataFrame, calendar: DataFrame, returns: DataFrame, horizons: tuple[int, ...] = (1, 2, 3, 5, 10), holdout: float = 0.35) -> DataFrame:
    """Alerts with their characteristics, forward returns signed by the thesis, and the split by date."""
    a = add_feature_date(alerts, "time", calendar).filter("feature_date is not null").withColumnRenamed("feature_date", "date")
    thesis = F.when(F.col("sentiment") == "BULLISH", 1.0).when(F.col("sentiment") == "BEARISH", -1.0).otherwise(0.0)
    a = a.withColumns({
        "dte": F.datediff("expiry", "date"), "is_call": (F.col("type") == "CALL").cast("int"), "otm_pct": otm_share(F.col("type"), F.col("strike"), F.col("spot")), "vol_oi": F.col("size") / F.greatest(F.col("oi"), F.lit(1)),
        "ask_frac": ratio(F.col("ask_prem"), F.col("ask_prem") + F.col("bid_prem")), "log_premium": F.log10(F.greatest("premium", F.lit(1.0))), "thesis_dir": thesis,
    })
    a = a.join(returns.select("ticker", "date", *[f"fwd_{h}" for h in horizons]), ["ticker", "date"])
    a = a.withColumns({f"pnl_{h}": F.col("thesis_dir") * F.col(f"fwd_{h}") for h in horizons})
    a = a.withColumns({f"win_{h}": F.coalesce(F.col(f"pnl_{h}") > 0, F.lit(False)).cast("int") for h in horizons})
    return split_by_date(a, holdout)


def split_by_date(df: DataFrame, holdout: float = 0.35) -> DataFrame:
    """mine or holdout: the last share of the distinct dates is held out."""
    dates = df.select("date").distinct()
    n = F.count("*").over(W.partitionBy())
    ranked = dates.select("date", F.row_number().over(W.orderBy("date")).alias("r"), n.alias("n"))
    return df.join(F.broadcast(ranked.select("date", F.when(F.col("r") - 1 < F.floor(F.col("n") * (1 - holdout)), "mine").otherwise("holdout").alias("split"))), "date")


def normalise_alerts(raw: DataFrame) -> DataFrame:
    """Raw provider alerts, all fields as text or flags -> alerts; rows without id or ticker are left out.

    Type, expiry and strike come from the option symbol where it has them; side, sentiment, execution, confidence (by the
    provider's volume to open interest) and label are derived. Ask and bid premium, the opening, floor and single-leg flags
    and the issue type stay null where they are missing, so that screens don't pass on absent data; other numbers are 0.
    ``raw_sector`` is what ``resolve_sector`` works on.
    """
    have = set(raw.columns)
    text = lambda *names: F.coalesce(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    number = lambda *names: F.coalesce(*[F.col(n).try_cast("double") for n in names if n in have], F.lit(None).cast("double"))
    whole = lambda *names: F.coalesce(number(*names), F.lit(0.0)).cast("long")
    flag = lambda name: F.col(name).cast("boolean") if name in have else F.lit(None).cast("boolean")
    tail = lambda k: F.nullif(F.regexp_extract(text("option_chain"), r"(\d{6})([CP])(\d{8})$", k), F.lit(""))
    out = raw.filter((F.coalesce(text("id"), F.lit("")) != "") & (F.trim(F.coalesce(text("ticker"), F.lit(""))) != ""))
    time = F.coalesce(*[F.col(c).cast("timestamp") for c in ("created_at", "executed_at", "time") if c in have])
    kind = F.when(tail(2) == "P", "PUT").otherwise("CALL")
    expiry = F.coalesce(F.try_to_date(tail(1), "yyMMdd"), text("expiry").try_cast("date"), text("expiration").try_cast("date"), F.to_date(time))
    ask, bid = number("total_ask_side_prem"), number("total_bid_side_prem")
    buy = F.coalesce(ask, F.lit(0.0)) >= F.coalesce(bid, F.lit(0.0))
    ratio_ = F.coalesce(number("volume_oi_ratio"), F.lit(0.0))
    strike = F.coalesce(number("strike"), F.lit(0.0))
    sure = lambda name: F.coalesce(flag(name), F.lit(False))
    return out.select(
        text("id").alias("id"), time.alias("time"), F.upper(F.trim(text("ticker"))).alias("ticker"), kind.alias("type"), F.when(buy, "BUY").otherwise("SELL").alias("side"),
        F.when((kind == "CALL") == buy, "BULLISH").otherwise("BEARISH").alias("sentiment"), F.when(sure("has_sweep"), "SWEEP").when(sure("has_floor"), "FLOOR").when(sure("has_multileg"), "BLOCK").otherwise("SINGLE").alias("exec"),
        sure("has_multileg").alias("multi_leg"), contract_label(strike, kind, expiry).alias("contract"), strike.alias("strike"), expiry.alias("expiry"), whole("volume", "size").alias("size"), whole("open_interest").alias("oi"),
        F.coalesce(number("total_premium", "premium"), F.lit(0.0)).alias("premium"), F.coalesce(number("underlying_price", "spot"), F.lit(0.0)).alias("spot"), F.coalesce(text("alert_rule", "rule"), F.lit("Unusual activity")).alias("rule"),
        F.when(ratio_ >= 5, "HIGH").when(ratio_ >= 1, "MED").otherwise("LOW").alias("confidence"), text("sector").alias("raw_sector"), ask.alias("ask_prem"), bid.alias("bid_prem"),
        flag("all_opening_trades").alias("all_opening"), text("issue_type").alias("issue_type"), flag("has_floor").alias("has_floor"), flag("has_singleleg").alias("has_single_leg"),
    )
