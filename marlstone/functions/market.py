"""Market clock, option symbols and alert predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def local_time(ts: Column) -> Column:
    """New York wall clock of a UTC timestamp."""
    return F.from_utc_timestamp(ts, ZONE)


def local_date(ts: Column) -> Column:
    return F.to_date(local_time(ts))


def second_of_day(ts: Column) -> Column:
    local = local_time(ts)
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def is_weekday(day: Column) -> Column:
    return ~F.dayofweek(day).isin(1, 7)


def is_intraday(ts: Column) -> Column:
    """From 09:30 to before 16:00 New York time on weekdays."""
    s = second_of_day(ts)
    return is_weekday(local_time(ts)) & (s >= 34200) & (s < 57600)


def day_bounds(day: Column) -> tuple[Column, Column]:
    """UTC instants of New York midnight of the day and of the next one, whatever the clock change."""
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), ZONE)
    return at(day), at(F.date_add(day, 1))


def prior_weekday(day: Column) -> Column:
    """The weekday before; holidays aren't known."""
    return F.date_sub(day, F.when(F.dayofweek(day) == 2, 3).when(F.dayofweek(day) == 1, 2).otherwise(1))


def week_end(day: Column) -> Column:
    """The Friday that ends the day's week, the day itself if it is one."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def option_symbol(ticker: Column, expiry: Column, kind: Column, strike: Column) -> Column:
    """Ticker, yymmdd, C or P, strike in thousandths with 8 digits."""
    thousandths = F.floor(strike * 1000 + 0.5).cast("long").cast("string")
    return F.concat(ticker, F.date_format(expiry, "yyMMdd"), F.when(kind == "PUT", "P").otherwise("C"), F.lpad(thousandths, 8, "0"))


def symbol_from_label(ticker: Column, label: Column, as_of: Column) -> Column:
    """`$202.5C Jul 20` -> option symbol; a date over 7 days past belongs to the next year; null if it doesn't parse."""
    part = lambda k: F.regexp_extract(label, r"^\$(\d+(?:\.\d+)?)([CP])\s+([A-Z][a-z]{2})\s+(\d{1,2})$", k)
    months = F.array(*[F.lit(m) for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()])
    month, strike = F.array_position(months, part(3)).cast("int"), part(1)
    made = lambda year: F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(4), 2, "0")), "yyyy-MM-dd")
    this = made(F.year(as_of))
    expiry = F.when(this < F.date_sub(as_of, 7), made(F.year(as_of) + 1)).otherwise(this)
    symbol = option_symbol(ticker, expiry, F.when(part(2) == "P", "PUT").otherwise("CALL"), F.when(strike != "", strike).cast("double"))
    return F.when(label.rlike(r"^\$\d+(?:\.\d+)?[CP]\s+[A-Z][a-z]{2}\s+\d{1,2}$"), symbol)


def plain_number(x: Column) -> Column:
    """A number without trailing zeros: 202.5, 100."""
    return F.regexp_replace(F.format_string("%.4f", x.cast("double")), r"\.?0+$", "")


def contract_label(strike: Column, kind: Column, expiry: Column) -> Column:
    return F.concat(F.lit("$"), plain_number(strike), F.when(kind == "PUT", "P").otherwise("C"), F.lit(" "), F.date_format(expiry, "MMM d"))


def moneyness_weight(kind: Column, strike: Column, spot: Column) -> Column:
    """1.0 within 2.5 % of spot, 1.5 out of the money, 0.75 in it; 1.0 for bad inputs."""
    far = F.abs(strike - spot) / F.nullif(spot, F.lit(0.0)) > 0.025
    out = F.when(kind == "CALL", strike > spot).otherwise(strike < spot)
    bad = strike.isNull() | spot.isNull() | (strike <= 0) | (spot <= 0)
    return F.when(bad | ~far, 1.0).when(out, 1.5).otherwise(0.75)


def otm_share(kind: Column, strike: Column, spot: Column) -> Column:
    """Distance out of the money as a share of spot; negative in the money."""
    return F.when(kind == "CALL", (strike - spot) / spot).otherwise((spot - strike) / spot)


def money_label(x: Column) -> Column:
    """$1.2M, $340K, $900."""
    return (
        F.when(x >= 1e9, F.format_string("$%.1fB", x / 1e9))
        .when(x >= 1e6, F.format_string("$%.1fM", x / 1e6))
        .when(x >= 1e3, F.format_string("$%.0fK", x / 1e3))
        .otherwise(F.format_string("$%.0f", x))
    )
