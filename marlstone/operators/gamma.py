"""Option-gamma operators: netting, key levels, heatmaps and snapshots as of a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .flow import centred_strikes


def gex_strikes(raw: DataFrame) -> DataFrame:
    """Open-interest and volume gamma of a strike, netted: puts come with their sign."""
    c = F.col
    out = raw.withColumns({"net_oi": c("call_gamma_oi") + c("put_gamma_oi"), "net_dv": c("call_gamma_ask") + c("call_gamma_bid") + c("put_gamma_ask") + c("put_gamma_bid")})
    return out.withColumn("combined", c("net_oi") + c("net_dv"))


def gex_levels(strikes: DataFrame, keys: list[str], band: float = 0.05) -> DataFrame:
    """Call wall, put wall, flip and regime of each chain (keys, strike, spot, combined).

    Walls are the most positive strike within 5 % above and the most negative within 5 % below spot. The flip is
    the first strike within 5 % at which the running sum over the whole chain changes its sign from non-zero. Spot
    stands in for each that isn't there.
    """
    c, k = F.col, W.partitionBy(*keys).orderBy("strike")
    run = F.sum("combined").over(k.rowsBetween(W.unboundedPreceding, 0))
    out = strikes.withColumn("_cum", run).withColumn("_prev", F.coalesce(F.lag("_cum").over(k), F.lit(0.0)))
    near = F.abs(c("strike") - c("spot")) <= band * c("spot")
    flips = near & (c("_prev") != 0) & (F.signum("_prev") != F.signum("_cum"))
    above = near & (c("strike") > c("spot")) & (c("combined") > 0)
    below = near & (c("strike") < c("spot")) & (c("combined") < 0)
    out = out.groupBy(*keys, "spot").agg(
        F.max_by(F.when(above, c("strike")), F.when(above, F.struct(c("combined"), c("strike")))).alias("call_wall"),
        F.min_by(F.when(below, c("strike")), F.when(below, F.struct(c("combined"), -c("strike")))).alias("put_wall"),
        F.min(F.when(flips, c("strike"))).alias("gamma_flip"),
    )
    out = out.withColumns({x: F.coalesce(x, "spot") for x in ("call_wall", "put_wall", "gamma_flip")})
    return out.withColumn("regime", F.when(c("spot") > c("gamma_flip"), "POSITIVE").otherwise("NEGATIVE"))


def heatmap_cells(rows: DataFrame, keys: list[str], band: float = 0.05) -> DataFrame:
    """(keys, spot, strike, expiry, seq, values...) -> one cell for each strike and expiry, the last one; chains without
    a strike within 5 % on both sides of spot are left out."""
    cells = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "strike", "expiry").orderBy(F.desc("seq")))).filter("_n = 1").drop("_n", "seq")
    k = W.partitionBy(*keys)
    up = F.max((F.col("strike") >= F.col("spot")) & (F.col("strike") <= F.col("spot") * (1 + band))).over(k)
    down = F.max((F.col("strike") <= F.col("spot")) & (F.col("strike") >= F.col("spot") * (1 - band))).over(k)
    return cells.withColumn("_ok", up & down).filter("_ok").drop("_ok")


def heatmap_rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The pivoted form: one row for each strike, its cells in a map by expiry."""
    entry = F.struct(F.col("expiry").cast("string").alias("k"), F.struct("net_oi", "net_dv").alias("v"))
    return cells.groupBy(*keys, "spot", "strike").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_exp"))


def choose_expirations(expirations: DataFrame, as_of: Column, nearest: int = 7, fridays: int = 5) -> DataFrame:
    """The nearest expirations, the next Fridays among them, and today, listed or not: on its last day an expiration isn't."""
    alive = expirations.filter(F.col("expiry") >= as_of).withColumn("dte", F.datediff("expiry", as_of))
    by = lambda cond: F.row_number().over(W.partitionBy("ticker", cond).orderBy("expiry"))
    friday = F.dayofweek("expiry") == 6
    out = alive.withColumns({"_n": F.row_number().over(W.partitionBy("ticker").orderBy("expiry")), "_f": by(friday)})
    out = out.filter((F.col("_n") <= nearest) | (friday & (F.col("_f") <= fridays))).drop("_n", "_f")
    today = expirations.select("ticker").distinct().select("ticker", as_of.alias("expiry"), F.lit(0).alias("dte"))
    return out.filter("dte > 0").select("ticker", "expiry", "dte").unionByName(today)


#: The share of spot within which a ticker's strikes are shown, and that of all others.
BANDS = {"SPY": 0.10, "QQQ": 0.10, "SPX": 0.10, "META": 0.15, "AMZN": 0.15, "GOOGL": 0.15, "MSFT": 0.15, "TSLA": 0.25, "NVDA": 0.25, "NFLX": 0.25, "AMD": 0.20}
OTHER_BAND = 0.15


def strike_band(ticker: Column, bands: dict[str, float] = BANDS) -> Column:
    out = F.when(ticker.isNull(), OTHER_BAND)
    for name, share in bands.items():
        out = out.when(ticker == name, share)
    return out.otherwise(OTHER_BAND)


def chart_rows(snapshots: DataFrame, n: int = 100, band: float = 0.10) -> DataFrame:
    """Of each ticker's latest snapshot (ticker, captured_at, spot, strikes with a ``strike``) the ``n`` (1 to 200) strikes
    around spot within 10 % of it."""
    last = snapshots.groupBy("ticker").agg(F.max_by(F.struct("captured_at", "spot", "strikes"), "captured_at").alias("x")).select("ticker", "x.*")
    rows = last.select("ticker", "captured_at", "spot", F.explode("strikes").alias("s")).select("ticker", "captured_at", "spot", "s.*")
    near = rows.filter(F.col("strike").isNotNull() & (F.abs(F.col("strike") - F.col("spot")) <= band * F.col("spot")))
    return centred_strikes(near, ["ticker"], max(1, min(200, n)))


def heatmap_view(cells: DataFrame, keys: list[str], as_of: Column, bands: dict[str, float] = BANDS, strikes: int = 50, dense: int = 5, columns: int = 5, fridays_only: bool = False) -> DataFrame:
    """Cells of the strikes around spot within the ticker's band, for at most ``columns`` expirations: those with ``dense`` or
    more cells by days left first, then the sparser ones."""
    inside = cells.filter(F.abs(F.col("strike") - F.col("spot")) <= F.col("spot") * strike_band(F.col("ticker"), bands))
    picked = centred_strikes(inside.select(*keys, "strike", "spot").distinct(), keys, strikes).select(*keys, "strike")
    shown = inside.join(picked, [*keys, "strike"])
    if fridays_only:
        shown = shown.filter(F.dayofweek("expiry") == 6)
    counted = shown.withColumn("_cells", F.count("*").over(W.partitionBy(*keys, "expiry"))).withColumn("dte", F.datediff("expiry", as_of))
    order = W.partitionBy(*keys).orderBy(F.col("_cells") < dense, "dte", "expiry")
    return counted.withColumn("_r", F.dense_rank().over(order)).filter(F.col("_r") <= columns).drop("_r", "_cells")


def heatmap_scale(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Strike of the largest absolute value, and the second largest as the colour scale."""
    order = W.partitionBy(*keys).orderBy(F.desc(F.abs("net_oi")), "strike", "expiry")
    ranked = cells.withColumn("n", F.row_number().over(order)).filter("n <= 2")
    return ranked.groupBy(*keys).agg(F.max(F.when(F.col("n") == 1, F.col("strike"))).alias("max_strike"), F.max(F.when(F.col("n") == 2, F.abs("net_oi"))).alias("scale"))


def snapshot_as_of(snaps: DataFrame, requests: DataFrame, now: Column | None = None) -> DataFrame:
    """(ticker, at) -> the snapshot to show: the newest with two or more expirations of the six hours up to ``at``, or
    else the newest up to ``at``; nothing if that is over 72 hours old. A request without ``at`` is live: it takes the
    good ones of the 24 hours up to ``now``, and is told by ``live``.

    Both sides are sorted together once; no range join.
    """
    when = F.coalesce("at", now if now is not None else F.current_timestamp())
    s = snaps.select("ticker", F.col("captured_at").alias("t"), F.struct("captured_at", "n_exp").alias("snap"), F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("boolean").alias("live"))
    r = requests.select("ticker", when.alias("t"), F.lit(None).cast(s.schema["snap"].dataType).alias("snap"), when.alias("at"), F.col("at").isNull().alias("live"))
    order = W.partitionBy("ticker").orderBy("t", F.col("snap").isNull()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last("snap", ignorenulls=True).over(order)
    good = F.last(F.when(F.col("snap.n_exp") >= 2, F.col("snap")), ignorenulls=True).over(order)
    out = s.unionByName(r).withColumns({"good": good, "last": last}).filter("at is not null")
    hours = lambda c: (F.unix_micros("at") - F.unix_micros(c)) / 3.6e9
    pick = F.when(hours(F.col("good.captured_at")) < F.when(F.col("live"), 24).otherwise(6), F.col("good")).otherwise(F.col("last"))
    out = out.select("ticker", "at", "live", pick.alias("x")).select("ticker", "at", "live", "x.*")
    return out.filter((F.unix_micros("at") - F.unix_micros("captured_at")) / 3.6e9 <= 72)


def top_nodes(strikes: DataFrame, levels: DataFrame, keys: list[str], n: int = 5, band: float = 0.10) -> DataFrame:
    """The largest absolute open-interest gammas within 10 % of spot that aren't a named level."""
    named = strikes.join(levels.select(*keys, "call_wall", "put_wall", "gamma_flip"), keys)
    free = named.filter((F.abs(F.col("strike") - F.col("spot")) <= band * F.col("spot")) & ~F.col("strike").isin(F.col("call_wall"), F.col("put_wall"), F.col("gamma_flip")))
    order = W.partitionBy(*keys).orderBy(F.desc(F.abs("net_oi")), "strike")
    return free.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n).select(*keys, "strike", "net_oi", "n")


def nearest_strikes(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.abs(F.col("strike") - F.col("spot")), "strike")
    return rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= n)


def reference_price(chains: DataFrame, gex: DataFrame, bars: DataFrame) -> DataFrame:
    """Latest gamma spot, or latest close, or the volume-weighted strike of the chain."""
    weighted = chains.groupBy("ticker").agg((F.sum(F.col("k") * F.col("volume")) / F.nullif(F.sum("volume"), F.lit(0.0))).alias("weighted"))
    spot = gex.groupBy("ticker").agg(F.max_by("spot", "captured_at").alias("spot"))
    close = bars.groupBy("ticker").agg(F.max_by("close", "date").alias("close"))
    return weighted.join(spot, "ticker", "left").join(close, "ticker", "left").select("ticker", F.coalesce("spot", "close", "weighted", F.lit(0.0)).alias("reference"))
