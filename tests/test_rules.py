"""The rule search against plain loops over all conjunctions, and detectors called from SQL."""

from __future__ import annotations

import datetime as dt
from itertools import combinations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from marlstone.operators import detectors, rules
from marlstone.operators import technicals as T
from marlstone.plans.adapters import bars

CONDITIONS = {"a": {"a0": "x = 0", "a1": "x = 1"}, "b": {"b>2": "y > 2", "b>5": "y > 5"}, "c": {"c": "z"}, "d": {"d": "w < 0.4", "never": "w > 9"}}


def plain(rows, longest, least_rows, least_dates):
    test = {"a0": lambda r: r.x == 0, "a1": lambda r: r.x == 1, "b>2": lambda r: r.y > 2, "b>5": lambda r: r.y > 5, "c": lambda r: bool(r.z), "d": lambda r: r.w < 0.4, "never": lambda r: r.w > 9}
    names = [(g, n) for g, own in CONDITIONS.items() for n in own]
    out = {}
    for length in range(1, longest + 1):
        for rule in combinations(names, length):
            if len({g for g, _ in rule}) < length:
                continue
            for value in ("p", "q"):
                got = {}
                for split in ("mine", "holdout"):
                    days: dict = {}
                    for r in rows:
                        if r.split == split and r[value] is not None and all(test[n](r) for _, n in rule):
                            days.setdefault(r.date, []).append(r[value])
                    means = np.array([np.mean(v) for v in days.values()])
                    n, k = sum(map(len, days.values())), len(days)
                    mean = float(means.mean()) if k >= 3 else None
                    t = float(means.mean() / (means.std(ddof=1) / np.sqrt(k))) if k >= 3 else None
                    if split == "holdout" and (n < least_rows or k < rules.HOLD_DATES):
                        mean = t = None
                    got[split] = (n, k, mean, t)
                if got["mine"][0] >= least_rows and got["mine"][1] >= least_dates:
                    out[" & ".join(n for _, n in rule), value] = got["mine"] + tuple(x if x else None for x in got["holdout"][:2]) + got["holdout"][2:]
    return out


@pytest.mark.parametrize("block", [512, 3])
def test_rules_against_plain_loops(spark, monkeypatch, block):
    monkeypatch.setattr(rules, "BLOCK", block)
    monkeypatch.setattr(rules, "ROWS", 37)
    rng = np.random.default_rng(3)
    # One date holds a third of the rows, so that ranges split it.
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=int(k)) for k in np.where(rng.random(1500) < 0.33, 4, rng.integers(0, 24, 1500))]
    made = [(k, d, "mine" if d < dt.date(2026, 1, 16) else "holdout", int(rng.integers(0, 3)), float(rng.integers(0, 9)), None if rng.random() < 0.1 else bool(rng.random() < 0.5), float(rng.random()), None if rng.random() < 0.2 else float(rng.normal()), float(rng.normal())) for k, d in enumerate(days)]
    df = spark.createDataFrame(made, "id long, date date, split string, x int, y double, z boolean, w double, p double, q double").repartition(5)
    conditions = {g: {n: F.expr(e) for n, e in own.items()} for g, own in CONDITIONS.items()}
    got = {(r.rule, r.value): r for r in rules.mine_rules(df, conditions, ["p", "q"], min_rows=20, min_dates=4).collect()}
    want = plain(df.collect(), 3, 20, 4)
    assert set(got) == set(want) and len(want) > 30
    for key, row in want.items():
        r = got[key]
        have = (r.mine_n_rows, r.mine_n_dates, r.mine_mean, r.mine_t, r.holdout_n_rows, r.holdout_n_dates, r.holdout_mean, r.holdout_t)
        assert all(a == b if a is None or b is None else a == pytest.approx(b, abs=1e-9) for a, b in zip(have, row, strict=True)), (key, have, row)


def test_longer_rules_have_all_their_parts():
    group = [0, 0, 1, 2]
    assert rules.longer([(0,), (1,), (2,)], group) == [(0, 2), (1, 2)]
    assert rules.longer([(0, 2), (0, 3), (2, 3), (1, 2)], group) == [(0, 2, 3)]


def test_candidates_are_the_largest_of_a_family(spark):
    df = spark.createDataFrame([("f", "a", "v", -3.0), ("f", "b", "v", 2.0), ("f", "c", "v", None), ("g", "a", "v", 0.1)], "family string, rule string, value string, mine_t double")
    assert [(r.family, r.rule, r.place) for r in rules.candidates(df, top=1).orderBy("family").collect()] == [("f", "a", 1), ("g", "a", 1)]


def test_detectors_from_sql(spark):
    b = T.with_recursions(bars(spark, SF).filter("ticker in ('S1', 'S2')"), want=("atr_14",))
    detectors.register_sql(spark, "detect_test")
    b.select("close", "date", "ticker", "open", "high", "low", "volume", "atr_14").createOrReplaceTempView("some_bars")
    got = spark.sql("SELECT * FROM detect_test(TABLE(some_bars), 'fib_base, fib_loose')").collect()
    want = detectors.detect_universe(b, ["fib_base", "fib_loose"]).select("ticker", "date", "detector", "side", "strength", "kind").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str) and got
    with pytest.raises(Exception, match="unknown detectors"):
        spark.sql("SELECT * FROM detect_test(TABLE(some_bars), 'nothing')").collect()
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM detect_test(TABLE(SELECT ticker, date FROM some_bars))").collect()


def test_detectors_from_sql_take_narrow_rows(spark):
    b = T.with_recursions(bars(spark, SF).filter("ticker in ('S1', 'S2')"), want=("atr_14",)).drop("true_range")
    b = b.withColumn("volume", F.when(F.col("ticker") == "S1", F.col("volume")))
    detectors.register_sql(spark, "detect_narrow")
    got = {}
    for kind in ("date", "timestamp"):
        b.withColumn("date", F.col("date").cast(kind)).createOrReplaceTempView("narrow_bars")
        found = spark.sql("SELECT * FROM detect_narrow(TABLE(narrow_bars), 'fib_base')")
        assert found.schema["date"].dataType.typeName() == kind
        got[kind] = sorted((r.ticker, str(r.date)[:10], r.side, r.strength) for r in found.collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "figures, array(" in plan
    want = sorted((r.ticker, str(r.date), r.side, r.strength) for r in detectors.detect_universe(b.na.fill(0.0, ["volume"]), ["fib_base"]).collect())
    assert got["date"] == got["timestamp"] == want and want
