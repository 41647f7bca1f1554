"""Detectors with state against slow restatements on real bars: everything is looked up anew at every bar."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF

from marlstone.operators import detectors
from marlstone.operators import technicals as T
from marlstone.plans.adapters import bars


@pytest.fixture(scope="module")
def tickers(spark):
    pdf = T.with_recursions(bars(spark, SF.replace("sf0.001", "sf0.01")).filter("ticker in ('S1', 'S2', 'S7', 'S40')"), want=("atr_14",)).toPandas()
    out = []
    for _, g in pdf.sort_values("date").groupby("ticker"):
        arrays = {c: g[c].to_numpy(float) for c in ("open", "high", "low", "close", "volume")}
        out.append(arrays | {"atr": np.nan_to_num(g["atr_14"].to_numpy(float))})
    return out


def pivots_before(b, t, m):
    """(bar, +1 or -1, price) of all pivots that are confirmed at bar t; of one bar the high comes first."""
    found = []
    for k in range(m, t - m + 1):
        for way, x, best in ((1, b["high"], max), (-1, b["low"], min)):
            if x[k] == best(x[k - m : k + m + 1]):
                found.append((k, way, x[k]))
    return sorted(found, key=lambda r: r[0])


def pulled_back(b, p):
    events, leg = [], None
    for t in range(len(b["close"])):
        a = b["atr"][t]
        if a <= 0:
            continue
        known = pivots_before(b, t, p["m"])
        if known != pivots_before(b, t - 1, p["m"]) and len(known) > 1:
            (_, w0, p0), (k1, w1, p1) = known[-2:]
            if w0 != w1 and abs(p1 - p0) >= p["leg"] * a:
                leg = [w1, p0, p1, k1, None]
        if leg is None:
            continue
        way, start, end, at, zone = leg
        if t - at > p["age"]:
            leg = None
        elif zone is None:
            counts = {}
            for share in p["levels"]:
                price = end + share * (start - end)
                inside = b["low"][t] <= price <= b["high"][t] if p["use"] else (b["low"][t] < end if way > 0 else b["high"][t] > end)
                near = [x for _, _, x in known if abs(x - price) <= p["near"] * a and min(abs(x - start), abs(x - end)) > 1e-9]
                if inside and near:
                    counts[share] = len(near) + p["use"]
            if counts:
                leg[4] = (b["high"][t] if way > 0 else b["low"][t], max(counts.values()))
        elif way * (b["close"][t] - zone[0]) > 0:
            events.append((t, "long" if way > 0 else "short", zone[1] * way * (b["close"][t] - zone[0]) / a))
            leg = None
        elif way * (start - (b["low"][t] if way > 0 else b["high"][t])) > 0:
            leg = None
    return events


def test_bars_that_are_both_pivots_end_a_leg_with_their_low(tickers):
    """Such bars are in the data that the restatement is compared on, and their high comes before their low."""
    n, m = 0, 3
    for b in tickers:
        for k in set(detectors._pivots(dict(b), m, True)) & set(detectors._pivots(dict(b), m, False)):
            assert pivots_before(b, int(k) + m, m)[-2:] == [(k, 1, b["high"][k]), (k, -1, b["low"][k])]
            n += k < 260
    assert n > 0


@pytest.mark.parametrize("name", ["fib_base", "fib_tight", "fib_loose_nofib"])
def test_retracements(tickers, name):
    n = 0
    for b in tickers:
        short = {k: v[:260] for k, v in b.items()}
        got = detectors.retracements(dict(short), detectors.RETRACEMENTS[name])
        want = pulled_back(short, detectors.RETRACEMENTS[name])
        assert [(t, s) for t, s, *_ in got] == [(t, s) for t, s, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])
        n += len(got)
    assert n > 0


def converged(b, p):
    events, fit = [], None
    for t in range(len(b["close"])):
        a, m = b["atr"][t], p["m"]
        known = pivots_before(b, t, m)
        if any(k + m == t for k, _, _ in known):
            fit = None
            tops, bottoms = ([(k, x) for k, w, x in [q for q in known if q[1] == way][-12:] if k >= t - p["back"]][-p["most"] :] for way in (1, -1))
            if a > 0 and len(tops) > 1 and len(bottoms) > 1:
                (u, v), (r, s) = (np.polyfit(*zip(*side, strict=True), 1) for side in (tops, bottoms))
                off = max(np.mean([abs(x - u * k - v) for k, x in tops]), np.mean([abs(x - r * k - s) for k, x in bottoms]))
                start, f = min(tops[0][0], bottoms[0][0]), p["flat"] * a
                then, now = (u - r) * start + v - s, (u - r) * t + v - s
                if u > f and r > f:
                    ways = {-1}
                elif u < -f and r < -f:
                    ways = {1}
                else:
                    ways = {1, -1} if (abs(u) <= f < r) or (u < -f and abs(r) <= f) or (u < -f and r > f) else set()
                slack = p["margin"] * a
                if ways and off <= p["fit"] * a and r - u >= p["converge"] * a and then > 0 < now and 1 - now / then >= p["shrink"] and r * t + s - slack <= b["close"][t] <= u * t + v + slack:
                    fit = (u, v, r, s, then, ways, len(tops) + len(bottoms), t)
        if fit is None:
            continue
        u, v, r, s, then, ways, touches, made = fit
        top, bottom, slack = u * t + v, r * t + s, p["margin"] * a
        if t - made > p["age"] or top <= bottom or a <= 0:
            fit = None
            continue
        way = 1 if b["close"][t] > top + slack else -1 if b["close"][t] < bottom - slack else 0
        if way:
            fit = None
            if way in ways:
                events.append((t, "long" if way > 0 else "short", touches * min(max(1 - (top - bottom) / then, 0), 1)))
    return events


@pytest.mark.parametrize("name", ["wedge_base", "wedge_loose"])
def test_wedges(tickers, name):
    n = 0
    for b in tickers:
        got = detectors.wedges(dict(b), detectors.WEDGES[name])
        want = converged(b, detectors.WEDGES[name])
        assert [(t, s) for t, s, *_ in got] == [(t, s) for t, s, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-6)
        n += len(got)
    assert n > 0


def flipped(b, p, m=3):
    """Levels as lists of what they went through: the prices absorbed, and the bars at which the close changed sides."""
    levels, events = [], []
    for t in range(len(b["close"])):
        a, c = b["atr"][t], b["close"]
        if a <= 0:
            continue
        fired = {}
        for lv in levels:
            mean = float(np.cumsum(lv["prices"])[-1] / len(lv["prices"]))
            if not lv["waits"] or t - lv["broke"] < p["soonest"]:
                continue
            way, depth = lv["waits"], lv["waits"] * (mean - (b["low"][t] if lv["waits"] > 0 else b["high"][t]))
            if t - lv["broke"] > p["latest"]:
                lv["waits"] = 0
            elif depth >= -p["zone"] * a:
                lv["waits"] = 0
                if depth <= p["pierce"] * a and way * (c[t] - mean) > p["hold"] * a and way * (c[t - 1] - mean) > 0 and len(lv["prices"]) >= p["touches"]:
                    fired.setdefault(way, []).append(len(lv["prices"]) * (1 - 0.75 * min(max(depth, 0) / (p["pierce"] * a), 1)))
        events += [(t, "long" if w > 0 else "short", max(fired[w])) for w in (1, -1) if w in fired]
        for lv in levels:
            mean = float(np.cumsum(lv["prices"])[-1] / len(lv["prices"]))
            now = 1 if c[t] - mean > p["margin"] * a else -1 if c[t] - mean < -p["margin"] * a else lv["side"]
            if now != lv["side"]:
                if t - lv["since"] >= p["held"]:
                    lv |= {"waits": now, "broke": t}
                lv |= {"side": now, "since": t, "last": t}
        new = [(k, x) for k, w, x in pivots_before(b, t, m) if k + m == t and w > 0] + [(k, x) for k, w, x in pivots_before(b, t, m) if k + m == t and w < 0]
        for _, x in new:
            means = [(abs(float(np.cumsum(lv["prices"])[-1] / len(lv["prices"])) - x), -i) for i, lv in enumerate(levels)]
            near = min((d for d in means if d[0] <= p["cluster"] * a), default=None)
            if near:
                levels[-near[1]]["prices"].append(x)
                levels[-near[1]]["last"] = t
            else:
                levels.append({"prices": [x], "side": 1 if c[t] > x else -1, "since": t, "waits": 0, "broke": -1, "last": t})
        levels = [lv for lv in levels if t - lv["last"] <= p["age"]]
    return events


@pytest.mark.parametrize("name", ["srflip_base", "srflip_loose"])
def test_level_flips(tickers, name):
    n = 0
    for b in tickers:
        short = {k: v[:300] for k, v in b.items()}
        got = detectors.level_flips(dict(short), detectors.FLIPS[name])
        want = flipped(short, detectors.FLIPS[name])
        assert [(t, s) for t, s, *_ in got] == [(t, s) for t, s, _ in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])
        n += len(got)
    assert n > 0


@pytest.mark.parametrize("name", list(detectors.FLIPS))
def test_level_flips_of_many_tickers_at_once(tickers, name):
    """The same events as one ticker at a time: with bars that have no atr, short tickers, and more levels than places."""
    many = [dict(b) for b in tickers] + [{k: v[:n].copy() for k, v in b.items()} for b in tickers for n in (0, 3, 90, 300)]
    for k, b in enumerate(many):
        b["atr"] = np.where(np.arange(len(b["atr"])) % 37 == k, 0.0, b["atr"])
    want = [detectors.level_flips(dict(b), detectors.FLIPS[name]) for b in many]
    assert detectors.level_flips_together([dict(b) for b in many], detectors.FLIPS[name]) == want
    assert sum(map(len, want)) > 0
    got = [[] for _ in many]
    for k, detector, event in detectors.found_in(many, {name: detectors.STATEFUL[name]}):
        got[k].append(event)
        assert detector == name
    assert got == want


def test_events_need_no_atr_from_before(spark):
    """The pass makes it where the bars don't have it, and the events are the same."""
    b = bars(spark, SF.replace("sf0.001", "sf0.01")).filter("ticker < 'S3'")
    got, want = (detectors.detect_universe(x).toPandas().sort_values(["ticker", "detector", "date", "side"], ignore_index=True) for x in (b, T.with_recursions(b, want=("atr_14",))))
    assert len(got) > 100 and got.equals(want)


def test_the_pass_adds_the_weekly_trend(spark):
    b = bars(spark, SF.replace("sf0.001", "sf0.01")).filter("ticker < 'S3'")
    key = ["ticker", "detector", "date", "side"]
    got, want = (x.toPandas().sort_values(key, ignore_index=True) for x in (detectors.detect_universe(b, trend=True), detectors.with_state(detectors.detect_universe(b), b)))
    assert got["htf"].isna().any() and set(got["htf"].dropna()) == {-1.0, 0.0, 1.0}
    assert got.equals(want[got.columns])
