"""Studies' rows in one pass: the events, labels and trends of the windows, and the figures of the joined study."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from test_features import walk

from marlstone.functions.store import written
from marlstone.operators import detectors, evaluation, patterns
from marlstone.operators import technicals as T
from marlstone.plans import audit_queries


@pytest.fixture(scope="module")
def odd(spark):
    parts = [walk(420, "A", 1), walk(300, "B", 2), walk(9, "C", 3), walk(1, "D", 4), walk(330, "E", 5)]
    parts[4].loc[100:103, ["close", "volume"]] = np.nan
    parts[4].loc[200:203, ["open", "high", "low", "close"]] = 30.0
    return spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=1)).na.replace(float("nan"), None).repartition(5)


@pytest.fixture(scope="module")
def rows(spark, odd):
    return written(patterns.study_rows(odd), "test-rows")


def pairs(df, *columns):
    return {tuple(r)[:-1]: r[-1] for r in df.select(*columns).collect()}


def test_events_are_those_of_the_windows(spark, odd, rows):
    names = ("ticker", "date", "detector", "side", "strength")
    got, want = pairs(rows.selectExpr("ticker", "date", "inline(events)"), *names), pairs(detectors.all_events(odd), *names)
    assert set(got) == set(want) and len({k[2] for k in got}) > 25
    assert all(np.isclose(got[k], want[k]) for k in got)
    own = patterns.study_rows(odd, [detectors.gaps, detectors.squeezes]).selectExpr("ticker", "date", "inline(events)")
    assert set(pairs(own, *names)) == {k for k in want if k[2].startswith("gap") or "squeeze" in k[2]}


def test_labels_and_trends_are_those_of_the_windows(spark, odd, rows):
    made = T.barrier_labels(T.with_recursions(odd, want=("atr_14",))).select("ticker", "date", *patterns.LABELS)
    want = made.join(detectors.weekly_state(odd), ["ticker", "date"], "left").select("ticker", "date", "htf", *patterns.LABELS)
    a, b = (df.drop("events").toPandas().sort_values(["ticker", "date"]) for df in (rows, want))
    assert len(a) == len(b) == 420 + 300 + 9 + 1 + 330
    for c in ("htf", *patterns.LABELS):
        assert np.allclose(a[c], b[c], equal_nan=True), c


def test_a_study_of_rows_is_the_joined_study(spark, odd, rows):
    plan = written(evaluation.folds(rows, n=3, oos_months=3), "folds")
    events, labels = rows.selectExpr("ticker", "date", "inline(events)"), rows.select("ticker", "date", *patterns.LABELS)
    for window in ("folds", "history"):
        one = evaluation.event_study_of_rows(rows, plan, 2, window).toPandas()
        two = evaluation.event_study(events, labels, plan, rows, 2, window).toPandas()[list(one.columns)]
        one, two = (df.sort_values(["detector", "side"]).reset_index(drop=True) for df in (one, two))
        pd.testing.assert_frame_equal(one, two)
        assert len(one) > 20 and one["n_folds"].max() == 3


def test_a_study_writes_its_rows_alone(spark, monkeypatch):
    kept = []
    for module in (evaluation, audit_queries):
        monkeypatch.setattr(module, "written", lambda df, name: kept.append(name) or written(df, name))
    assert audit_queries.e5_folds(spark, SF).count() > 0 and kept == ["study-rows", "folds"]
