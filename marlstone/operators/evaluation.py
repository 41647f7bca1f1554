"""Folds, event studies, cross-sectional statistics, metrics and rule grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import written
from .boosting import Settings, out_of_fold


def folds(matrix: DataFrame, n: int = 5, oos_months: int = 12, embargo: int = 10) -> DataFrame:
    """Expanding walk-forward folds over the distinct dates: (fold, train_start, train_end, test_start, test_end, is_oos).

    The last ``oos_months`` are held out; the dates before are cut into n + 1 equal parts, part k is tested after
    training on the parts before it, less an embargo. All of it is arithmetic on a table of dates.
    """
    order = W.orderBy("date")
    dates = matrix.select("date").distinct().withColumn("i", F.row_number().over(order) - 1)
    span = dates.agg(F.max("date").alias("last"))
    cut = dates.join(F.broadcast(span)).agg(F.min(F.when(F.col("date") >= F.add_months("last", -oos_months), F.col("i"))).alias("oos"), F.max("i").alias("last_i"))
    bound = lambda k: F.floor(F.col("oos") * k / (n + 1)).cast("int")
    rows = [F.struct(F.lit(f"cv{k}").alias("fold"), bound(k).alias("lo"), (bound(k + 1) - 1).alias("hi"), F.lit(False).alias("is_oos")) for k in range(1, n + 1)]
    rows.append(F.struct(F.lit("oos").alias("fold"), F.col("oos").cast("int").alias("lo"), F.col("last_i").cast("int").alias("hi"), F.lit(True).alias("is_oos")))
    plan = cut.select(F.explode(F.array(*rows)).alias("f")).select("f.*").withColumn("te", F.col("lo") - 1 - embargo)
    at = lambda c, name: dates.select(F.col("i").alias(c), F.col("date").alias(name))
    out = plan.join(at("lo", "test_start"), "lo").join(at("hi", "test_end"), "hi").join(at("te", "train_end"), "te")
    first = dates.filter("i = 0").select(F.col("date").alias("train_start"))
    return out.join(F.broadcast(first)).select("fold", "train_start", "train_end", "test_start", "test_end", "is_oos")


def assign_folds(matrix: DataFrame, plan: DataFrame, calibration: float = 0.15, embargo: int = 10) -> DataFrame:
    """Rows of each fold as fit, calibrate or test.

    The last share of a training span's distinct dates calibrates; the embargo's dates before it belong to neither (a fold
    too short for that has no inner embargo). Cuts are made on the small table of dates; the rows meet the handful of
    folds in an interval join.
    """
    dates = matrix.select("date").distinct()
    f = plan.select("fold", "train_start", "train_end", "test_start", "test_end", "is_oos")
    own = dates.join(F.broadcast(f), (dates["date"] >= f["train_start"]) & (dates["date"] <= f["train_end"]))
    key = W.partitionBy("fold")
    ranked = own.select("fold", "date", (F.row_number().over(key.orderBy("date")) - 1).alias("i"), F.count("*").over(key).alias("n"))
    first = F.col("n") - F.greatest(F.lit(1), F.rint(F.col("n") * calibration).cast("int"))
    last = F.when(first - 1 - embargo < 0, first - 1).otherwise(first - 1 - embargo)
    cuts = ranked.groupBy("fold").agg(F.max(F.when(F.col("i") == last, F.col("date"))).alias("fit_end"), F.max(F.when(F.col("i") == first, F.col("date"))).alias("calibrate_start"))
    f = F.broadcast(f.join(cuts, "fold"))
    out = matrix.join(f, (matrix["date"] >= f["train_start"]) & (matrix["date"] <= f["test_end"]))
    role = F.when(F.col("date") >= F.col("test_start"), "test").when(F.col("date") <= F.col("fit_end"), "fit").when(F.col("date").between(F.col("calibrate_start"), F.col("train_end")), "calibrate")
    return out.withColumn("role", role).filter("role is not null").drop("fit_end", "calibrate_start")


def join_events(matrix: DataFrame, events: DataFrame, detectors: list[str]) -> DataFrame:
    """``matrix`` with a flag for each detector and side, ``<detector>_long`` and ``_short``: whether the row has its event."""
    kinds = F.concat_ws("_", "detector", "side")
    held = events.filter(F.col("detector").isin(*detectors)).groupBy("ticker", "date").agg(F.collect_set(kinds).alias("_events"))
    flags = {f"{d}_{side}": F.coalesce(F.array_contains("_events", f"{d}_{side}"), F.lit(False)) for d in detectors for side in ("long", "short")}
    return matrix.join(held, ["ticker", "date"], "left").withColumns(flags).drop("_events")


def event_study(events: DataFrame, labels: DataFrame, plan: DataFrame, state: DataFrame | None = None, min_fold_events: int = 5, window: str = "folds") -> DataFrame:
    """(detector, side) -> how the label does on event rows against all rows of the cross-validation window.

    ``events``: (ticker, date, detector, side, strength); ``labels``: (ticker, date, label_*, label_*_outcome_return, and
    terminal_return_10, whose medians are given where it is there);
    ``state``: (ticker, date, htf), the weekly trend of every row. The window is the span of the folds' test parts, or with
    ``window="history"`` all that is not after it; the held-out year never counts. Blocks: all events; those with the
    weekly trend (also against the base of such rows); those against it, following either the event or the trend; and
    the lift's range over the folds with enough events.
    """
    rows = _inside(labels, plan, window)
    rows = rows.join(state.select("ticker", "date", "htf"), ["ticker", "date"], "left") if state is not None else rows.withColumn("htf", F.lit(None).cast("double"))
    # Labels, states and events are long window plans; each is worked out once for the bases, the folds and the hits.
    used = [f"label_{s}{c}" for s in ("long", "short") for c in ("", "_outcome_return")] + [c for c in ("terminal_return_10",) if c in labels.columns]
    rows = written(rows.select("ticker", "date", "htf", *used), "study-rows")
    sides = _sides(rows)
    hit = written(events.select("ticker", "date", "detector", "side", "strength").join(sides.filter("label is not null"), ["ticker", "date", "side"]), "study-hits")
    return _study_figures(sides, hit, plan, min_fold_events)


def event_study_of_rows(rows: DataFrame, plan: DataFrame, min_fold_events: int = 5, window: str = "folds") -> DataFrame:
    """``event_study`` of rows that hold their labels, weekly trend and events (``patterns.study_rows``): nothing is joined."""
    rows = _inside(rows, plan, window)
    own = rows.filter("size(events) > 0").withColumn("e", F.explode("events")).withColumns({c: F.col("e")[c] for c in ("detector", "side", "strength")})
    pick = lambda a, b: F.when(F.col("side") == "long", F.col(a)).otherwise(F.col(b))
    both = {"label": pick("label_long", "label_short"), "other": pick("label_short", "label_long")}
    both |= {"outcome": pick("label_long_outcome_return", "label_short_outcome_return"), "other_outcome": pick("label_short_outcome_return", "label_long_outcome_return")}
    return _study_figures(_sides(rows), _with_trend(own.withColumns(both)).filter("label is not null"), plan, min_fold_events)


def _inside(rows: DataFrame, plan: DataFrame, window: str) -> DataFrame:
    span = F.broadcast(plan.filter("not is_oos").agg(F.min("test_start").alias("_from"), F.max("test_end").alias("_to")))
    inside = (F.col("date") <= F.col("_to")) & (F.col("date") >= F.col("_from") if window == "folds" else F.lit(True))
    return rows.join(span).filter(inside).drop("_from", "_to")


def _with_trend(rows: DataFrame) -> DataFrame:
    way = F.when(F.col("side") == "long", F.col("htf")).otherwise(-F.col("htf"))
    return rows.withColumns({"with_trend": F.coalesce(way == 1, F.lit(False)), "against": F.coalesce(way == -1, F.lit(False))})


def _sides(rows: DataFrame) -> DataFrame:
    """Each row twice: as a long and as a short one."""
    ends = ["terminal_return_10"] if "terminal_return_10" in rows.columns else []
    each = [F.struct(F.lit(s).alias("side"), F.col(f"label_{s}").alias("label"), F.col(f"label_{s}_outcome_return").alias("outcome"), F.col(f"label_{o}").alias("other"), F.col(f"label_{o}_outcome_return").alias("other_outcome")) for s, o in (("long", "short"), ("short", "long"))]
    return _with_trend(rows.select("ticker", "date", "htf", *ends, F.explode(F.array(*each)).alias("x")).select("ticker", "date", "htf", *ends, "x.*"))


def _study_figures(sides: DataFrame, hit: DataFrame, plan: DataFrame, min_fold_events: int) -> DataFrame:
    """What ``event_study`` gives, from the rows by side and the hits. Rows and hits meet the folds as sums by date."""
    f = F.broadcast(plan.filter("not is_oos").select("fold", "test_start", "test_end"))
    ends = ["terminal_return_10"] if "terminal_return_10" in sides.columns else []
    on = lambda c, v: F.when(F.col(c), F.col(v))
    mean = lambda s, n: F.sum(s) / F.nullif(F.sum(n), F.lit(0))
    whole = {"label": F.col("label"), "htf": on("with_trend", "label"), "other": F.col("other")}
    daily = sides.groupBy("date", "side").agg(*[x for c, v in whole.items() for x in (F.sum(v).alias(f"sum_{c}"), F.count(v).alias(f"n_{c}"))])
    base = daily.groupBy("side").agg(mean("sum_label", "n_label").alias("base"), mean("sum_htf", "n_htf").alias("base_htf"), mean("sum_other", "n_other").alias("base_other"), F.sum("n_label").alias("n_rows"))
    main = hit.groupBy("detector", "side").agg(
        F.count("*").alias("n"), F.avg("label").alias("hit_rate"), F.percentile("outcome", 0.5).alias("median_outcome"), F.percentile("strength", 0.5).alias("median_strength"),
        F.count_if("with_trend").alias("n_htf"), F.avg(on("with_trend", "label")).alias("hit_rate_htf"), F.percentile(on("with_trend", "outcome"), 0.5).alias("median_outcome_htf"),
        F.count_if("against").alias("n_opposed"), F.avg(on("against", "label")).alias("hit_rate_opposed"), F.avg(on("against", "other")).alias("hit_rate_trend"),
        F.percentile(on("against", "outcome"), 0.5).alias("median_outcome_opposed"), F.percentile(on("against", "other_outcome"), 0.5).alias("median_outcome_trend"),
        *[F.percentile(x, 0.5).alias(f"median_{c}{n}") for c in ends for x, n in ((F.col(c), ""), (on("with_trend", c), "_htf"), (on("against", c), "_opposed"))],
    )
    in_fold = lambda df: df.join(f, (df["date"] >= f["test_start"]) & (df["date"] <= f["test_end"]))
    fold_base = in_fold(daily).groupBy("fold", "side").agg(mean("sum_label", "n_label").alias("fold_base"))
    hits = hit.groupBy("date", "detector", "side").agg(F.count("*").alias("k"), F.sum("label").alias("s"))
    per = in_fold(hits).groupBy("fold", "detector", "side").agg(F.sum("k").alias("k"), mean("s", "k").alias("rate")).filter(F.col("k") >= min_fold_events)
    lift = F.col("rate") / F.nullif("fold_base", F.lit(0.0))
    lifts = per.join(fold_base, ["fold", "side"]).withColumn("l", lift).groupBy("detector", "side").agg(F.count("l").alias("n_folds"), F.min("l").alias("min_lift"), F.max("l").alias("max_lift"))
    out = main.join(F.broadcast(base), "side").join(lifts, ["detector", "side"], "left")
    over = lambda a, b: F.col(a) / F.nullif(b, F.lit(0.0))
    return out.withColumns({
        "lift": over("hit_rate", "base"), "lift_htf": over("hit_rate_htf", "base"), "lift_htf_base": over("hit_rate_htf", "base_htf"), "lift_opposed": over("hit_rate_opposed", "base"),
        "lift_trend": over("hit_rate_trend", "base_other"), "events_per_1k": F.col("n") * 1000.0 / F.greatest("n_rows", F.lit(1)),
    }).drop("n_rows", "base_other")


def long_form(panel: DataFrame, signals: list[str], returns: list[str]) -> DataFrame:
    """(ticker, date, signal, horizon, x, y) of every pair of a signal and a return."""
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(r).alias("horizon"), F.col(s).cast("double").alias("x"), F.col(r).alias("y")) for s in signals for r in returns])
    return panel.select("ticker", "date", F.explode(pairs).alias("p")).select("ticker", "date", "p.*")


def mean_rank(column: Column, *keys: str) -> Column:
    """Rank within the keys, ties at their mean; for keys whose rows fit one task, such as a date's tickers."""
    w = W.partitionBy(*keys)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(W.partitionBy(*keys, column)) - 1) / 2


def _ranked(pairs: DataFrame, *keys: str) -> DataFrame:
    whole = pairs.filter("x is not null and y is not null")
    return whole.withColumns({"rx": mean_rank(F.col("x"), *keys), "ry": mean_rank(F.col("y"), *keys)})


def _wide_ranks(rows: DataFrame, value: str, name: str, keys: list[str], parts: int = 256) -> DataFrame:
    """Mean ranks within few keys of very many rows. Approximate quantiles cut the values into ranges; distinct values are
    counted, ranked within their range, and moved up by the counts of the ranges below. The cuts balance the ranges and
    decide nothing else."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    cuts = counts.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, [k / parts for k in range(1, parts)])).alias("_cuts"))
    placed = counts.join(F.broadcast(cuts), keys).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    sums = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    below = sums.withColumn("_below", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    own = F.coalesce(F.sum("_n").over(W.partitionBy(*keys, "_part").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = placed.withColumn("_own", own).join(F.broadcast(below), [*keys, "_part"]).select(*keys, value, (F.col("_below") + F.col("_own") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def fama_macbeth(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Spearman correlation of each date with enough signals, its mean over the dates and t."""
    keys = ("signal", "horizon", "date")
    enough = pairs.withColumn("n", F.count("x").over(W.partitionBy(*keys))).filter(F.col("n") >= least)
    corr = F.when((F.count("*") >= 3) & (F.stddev_pop("rx") > 0) & (F.stddev_pop("ry") > 0), F.corr("rx", "ry"))
    daily = _ranked(enough, *keys).groupBy(*keys).agg(corr.alias("c")).filter("c is not null")
    return daily.groupBy("signal", "horizon").agg(F.count("*").alias("n_dates"), *_mean_t("c", "mean_corr"))


def _mean_t(c: str, name: str) -> list[Column]:
    enough = F.count(c) >= 3
    t = F.avg(c) / F.nullif(F.stddev_samp(c) / F.sqrt(F.count(c)), F.lit(0.0))
    return [F.when(enough, F.avg(c)).alias(name), F.when(enough, t).alias("t")]


def quintile_spread(pairs: DataFrame, least: int = 20) -> DataFrame:
    """Mean return at or over the signal's 80 % quantile of a date less that at or under its 20 % one; mean and t."""
    keys = ("signal", "horizon", "date")
    whole = pairs.filter("x is not null and y is not null")
    cuts = whole.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("x", 0.2).alias("lo"), F.percentile("x", 0.8).alias("hi")).filter(F.col("n") >= least)
    met = whole.join(cuts, list(keys)).groupBy(*keys).agg((F.avg(F.when(F.col("x") >= F.col("hi"), F.col("y"))) - F.avg(F.when(F.col("x") <= F.col("lo"), F.col("y")))).alias("s")).filter("s is not null")
    return met.groupBy("signal", "horizon").agg(F.count("*").alias("n_dates"), *_mean_t("s", "mean_spread"))


def between_within(pairs: DataFrame) -> DataFrame:
    """Spearman of ticker means (a row for each ticker) and of deviations from them (all rows); confounded if the first is large and over twice the second."""
    whole = pairs.filter("x is not null and y is not null")
    keys = ("signal", "horizon")
    means = whole.groupBy(*keys, "ticker").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    between = _ranked(means, *keys).groupBy(*keys).agg(F.corr("rx", "ry").alias("between"))
    own = W.partitionBy(*keys, "ticker")
    moved = whole.withColumns({"x": F.round(F.col("x") - F.avg("x").over(own), 9), "y": F.round(F.col("y") - F.avg("y").over(own), 9)})
    ranked = _wide_ranks(_wide_ranks(moved.select(*keys, "x", "y"), "x", "rx", list(keys)), "y", "ry", list(keys))
    within = ranked.groupBy(*keys).agg(F.corr("rx", "ry").alias("within"))
    return between.join(within, list(keys)).withColumn("confounded", (F.abs("between") > 0.3) & (F.abs("between") > 2 * F.abs("within")))


def metrics(scored: DataFrame) -> DataFrame:
    """(side, segment, y, p) -> n, base rate, PR-AUC, lift, ROC-AUC, Brier score, precision and recall of the top tenth.

    Distinct scores are summed up within 1,024 ranges of a side and segment, on top of the ranges above them. Where all
    labels are one class there is nothing to rank: only rows and base rate are given.
    """
    keys = ["side", "segment"]
    g = scored.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).withColumn("part", F.floor(F.col("p") * 1024))
    down = W.partitionBy(*keys, "part").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    sums = g.groupBy(*keys, "part").agg(F.sum("pos").alias("tp0"), F.sum("n").alias("cn0"))
    above, whole = W.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*keys)
    sums = sums.select(*keys, "part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("tp0", "cn0")], F.sum("tp0").over(whole).alias("all_pos"), F.sum("cn0").over(whole).alias("all_n"))
    g = g.withColumns({"tp": F.sum("pos").over(down), "cn": F.sum("n").over(down)}).join(F.broadcast(sums), [*keys, "part"])
    g = g.withColumns({"tp": F.col("tp") + F.col("tp0_above"), "cn": F.col("cn") + F.col("cn0_above")})
    neg = F.col("n") - F.col("pos")
    auc = F.sum(neg * (F.col("tp") - F.col("pos") / 2)) / F.nullif(F.first("all_pos") * (F.first("all_n") - F.first("all_pos")), F.lit(0.0))
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("cn")) / F.nullif(F.first("all_pos"), F.lit(0.0))
    curves = g.groupBy(*keys).agg(auc.alias("roc_auc"), ap.alias("pr_auc"))
    cut = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("base_rate"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.percentile("p", 0.9).alias("cut"))
    top = scored.join(F.broadcast(cut.select(*keys, "cut")), keys).groupBy(*keys).agg(F.avg(F.when(F.col("p") >= F.col("cut"), F.col("y"))).alias("top_decile_precision"), (F.sum(F.when(F.col("p") >= F.col("cut"), F.col("y"))) / F.nullif(F.sum("y"), F.lit(0.0))).alias("top_decile_recall"))
    out = cut.drop("cut").join(curves, keys).join(top, keys).withColumn("pr_auc_lift", F.col("pr_auc") / F.nullif("base_rate", F.lit(0.0)))
    both = (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    return out.withColumns({c: F.when(both, F.col(c)) for c in out.columns if c not in (*keys, "n", "base_rate")})


def score_rules(rows: DataFrame, rules: dict[str, Column], value: str, batch: int = 64, min_rows: int = 150, min_dates: int = 8) -> DataFrame:
    """For each rule and split: rows, dates, mean over dates of the daily mean, its t; and whether the rule survives.

    Rules are conditions: a batch of them is one array of flags on each row, of which only the true ones are exploded,
    so that rows and rules are never crossed.
    """
    names = list(rules)
    parts = []
    for k in range(0, len(names), batch):
        held = F.array_compact(F.array(*[F.when(F.coalesce(rules[n], F.lit(False)), F.lit(n)) for n in names[k : k + batch]]))
        parts.append(rows.select("date", "split", F.col(value).alias("v"), F.explode(held).alias("rule")).filter("v is not null"))
    daily = reduce(DataFrame.unionByName, parts).groupBy("rule", "split", "date").agg(F.avg("v").alias("m"), F.count("*").alias("k"))
    out = daily.groupBy("rule", "split").agg(F.sum("k").alias("n_rows"), F.count("*").alias("n_dates"), *_mean_t("m", "mean"))
    ok = (F.col("n_rows") >= min_rows) & (F.col("n_dates") >= min_dates)
    wide = out.filter(ok).groupBy("rule").agg(*[F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}") for s in ("mine", "holdout") for c in ("n_rows", "n_dates", "mean", "t")])
    alive = (F.signum("mine_mean") == F.signum("holdout_mean")) & (F.abs("mine_t") >= 2) & (F.abs("holdout_t") >= 2)
    return wide.withColumn("survivor", F.coalesce(alive, F.lit(False)))


def directional_labels(df: DataFrame, signals: list[str]) -> DataFrame:
    """Direction of the summed signals (none: dropped), and the label of that side."""
    way = F.signum(sum((F.coalesce(c, F.lit(0.0)) for c in signals), F.lit(0.0)))
    out = df.withColumn("direction", way).filter("direction <> 0")
    return out.withColumn("label_directional", F.when(F.col("direction") > 0, F.col("label_long")).otherwise(F.col("label_short")))


def directional_sets(df: DataFrame, sets: dict[str, list[str]]) -> DataFrame:
    """(subset, ticker, date, direction, label_directional): ``directional_labels`` by the signals of each event set."""
    way = lambda signals: F.signum(sum((F.coalesce(c, F.lit(0.0)) for c in signals), F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(n).alias("subset"), way(signals).alias("direction")) for n, signals in sets.items()])
    out = df.select("ticker", "date", "label_long", "label_short", F.explode(rows).alias("x")).select("*", "x.*").filter("direction <> 0")
    return out.select("subset", "ticker", "date", "direction", F.when(F.col("direction") > 0, F.col("label_long")).otherwise(F.col("label_short")).alias("label_directional"))


def event_subsets(df: DataFrame) -> DataFrame:
    """Sizes and base rates of all rows and of the event sets: breakouts, reclaims, either of them (strict), and these or
    touches of the 50 or 200 average (broad)."""
    b, r = F.col("range_breakout") != 0, F.col("swing_reclaim") != 0
    touch = (F.col("touch_50") != 0) | (F.col("touch_200") != 0)
    sets = F.array_compact(F.array(F.lit("all"), F.when(b, "breakout_only"), F.when(r, "reclaim_only"), F.when(b | r, "strict"), F.when(b | r | touch, "broad")))
    long = df.select("ticker", "date", "label_long", "label_short", F.explode(sets).alias("subset"))
    return long.groupBy("subset").agg(F.count("*").alias("n"), F.count_distinct("date").alias("n_dates"), F.count_distinct("ticker").alias("n_tickers"), F.avg("label_long").alias("base_long"), F.avg("label_short").alias("base_short"))


def predictions_table(predictions: DataFrame, matrix: DataFrame, profit: float = 1.5, stop: float = 1.0) -> DataFrame:
    """Predictions with entry, target and stop levels of both sides."""
    out = predictions.join(matrix.select("ticker", "date", F.col("close").alias("entry"), "atr_14"), ["ticker", "date"], "left")
    e, a = F.col("entry"), F.col("atr_14")
    return out.withColumns({"long_target": e + profit * a, "long_stop": e - stop * a, "short_target": e - profit * a, "short_stop": e + stop * a})


def top_entries(predictions: DataFrame, side: str, n: int, oos_only: bool = True) -> DataFrame:
    out = predictions.filter("is_oos") if oos_only else predictions
    return out.orderBy(F.desc(f"p_{side}"), "ticker", "date").limit(n)


def score_both_sides(matrix: DataFrame, plan: DataFrame, features: list[str], settings: Settings | None = None) -> DataFrame:
    """Out-of-fold scores of both sides in one row for each test row: (ticker, date, fold, is_oos, label_*, p_*)."""
    return out_of_fold(matrix, plan, {"all": features}, settings=settings).drop("feature_set")


def report_of(scored: DataFrame) -> DataFrame:
    """Metrics by feature set, side and segment (cv or oos) of scores with ``feature_set``."""
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(f"label_{side}").alias("y"), F.col(f"p_{side}").alias("p")) for side in ("long", "short")]))
    flat = scored.select("feature_set", F.when(F.col("is_oos"), "oos").otherwise("cv").alias("segment"), sides.alias("x")).select("feature_set", "segment", "x.*")
    flat = flat.filter("y is not null and p is not null").withColumn("side", F.concat_ws("/", "feature_set", "side")).drop("feature_set")
    out = metrics(flat)
    return out.withColumns({"feature_set": F.substring_index("side", "/", 1), "side": F.substring_index("side", "/", -1)})


def ablation(matrix: DataFrame, plan_of, sets: dict[str, list[str]], start, against: tuple[str, str], settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """Metrics of models on feature sets over one window of dates, and what the second named set adds over the first.

    ``start``: the window's first date (a column), as what only later rows have can't be compared on earlier ones;
    ``plan_of`` makes the folds of the windowed matrix. All sets' models are boosted together. Returns (feature_set,
    side, segment, metrics...) and (side, delta_roc_auc, delta_pr_auc) on the held-out rows.
    """
    window = written(matrix.filter(F.col("date") >= start), "window")
    report = written(report_of(out_of_fold(window, plan_of(window), sets, settings=settings)), "report")
    first, second = against
    pick = lambda n, c: F.max(F.when(F.col("feature_set") == n, F.col(c)))
    delta = report.filter("segment = 'oos'").groupBy("side").agg(*[(pick(second, c) - pick(first, c)).alias(f"delta_{c}") for c in ("roc_auc", "pr_auc")])
    return report, delta
