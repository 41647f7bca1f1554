"""The recursions that window functions can't express, over numpy arrays of one ticker."""

from __future__ import annotations

import numpy as np
import pandas as pd


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's moving average: the mean of the first ``n`` valid values, then (prev * (n - 1) + x) / n."""
    out = np.full(len(x), np.nan)
    valid = np.flatnonzero(~np.isnan(x))
    if len(valid) < n or valid[0] + n > len(x):
        return out
    at = int(valid[0]) + n - 1
    value = float(np.nanmean(x[valid[0] : at + 1]))
    out[at] = value
    for k, v in enumerate(x[at + 1 :].tolist(), at + 1):
        value = (value * (n - 1) + v) / n
        out[k] = value
    return out


def exponential(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential average that starts at the first value; missing until ``span`` values are in."""
    share, out = 2.0 / (span + 1), np.empty(len(x))
    value = np.nan
    for k, v in enumerate(x.tolist()):
        value = v if k == 0 else share * v + (1 - share) * value
        out[k] = value
    out[: span - 1] = np.nan
    return out


def relative_strength(close: np.ndarray, n: int) -> np.ndarray:
    """Wilder's index: 50 on a flat stretch, 100 without losses."""
    step = np.diff(close, prepend=np.nan)
    up, down = wilder(np.where(np.isnan(step), np.nan, np.maximum(step, 0)), n), wilder(np.where(np.isnan(step), np.nan, np.maximum(-step, 0)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100 - 100 / (1 + up / down)
    return np.where((up == 0) & (down == 0), 50.0, out)


def percentile_rank(x: np.ndarray, window: int) -> np.ndarray:
    """Rank of each value in its trailing window over the window's size; ties get their mean rank; no partial windows."""
    return pd.Series(x).rolling(window, min_periods=window).rank(pct=True).to_numpy()


def rolled(kind: str, x: np.ndarray, n: int, back: int = 0) -> np.ndarray:
    """A window's mean, std (of the population), min or max over the ``n`` values that end ``back`` before each; missing
    where the window isn't full or has a missing value."""
    out = np.full(len(x), np.nan)
    if len(x) >= n + back:
        values = getattr(np.lib.stride_tricks.sliding_window_view(x, n), kind)(axis=1)
        out[n - 1 + back :] = values[: len(values) - back]
    return out
