"""Column helpers: windows per ticker, full-window gates, null-safe events."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def per_ticker(*keys: str) -> WindowSpec:
    """Rows of a ticker in date order; every window of the feature blocks shares this partitioning and order."""
    return W.partitionBy(*(keys or ("ticker",))).orderBy("date")


def trailing(n: int, back: int = 0) -> WindowSpec:
    """The ``n`` rows that end ``back`` rows before the current one."""
    return per_ticker().rowsBetween(-(n - 1) - back, -back)


def full(n: int, value: Column, counted: Column, frame: WindowSpec) -> Column:
    """``value`` only where all ``n`` rows of the frame have ``counted``."""
    return F.when(F.count(counted).over(frame) == n, value)


def rolling(kind, column: Column | str, n: int, back: int = 0) -> Column:
    """A windowed aggregate without partial windows."""
    c = F.col(column) if isinstance(column, str) else column
    frame = trailing(n, back)
    return full(n, kind(c).over(frame), c, frame)


def lag(column: Column | str, n: int = 1) -> Column:
    return F.lag(column, n).over(per_ticker())


def flag(condition: Column) -> Column:
    """A condition that is false, not null, where something in it is missing."""
    return F.coalesce(condition, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def last_value(column: Column) -> Column:
    """The last non-null value up to the current row."""
    return F.last(column, ignorenulls=True).over(per_ticker().rowsBetween(W.unboundedPreceding, 0))


def bars_since(event: Column) -> Column:
    """Rows since the event last held; 0 on it, null before the first."""
    n = F.row_number().over(per_ticker())
    return (n - last_value(F.when(flag(event), n))).cast("double")


def run_length(event: Column) -> Column:
    """Length of the run of true rows that ends here; 0 where false."""
    n = F.row_number().over(per_ticker())
    return n - F.coalesce(last_value(F.when(~flag(event), n)), F.lit(0))


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up, as floor(x + 0.5)."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale
