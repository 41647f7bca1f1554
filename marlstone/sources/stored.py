"""Snapshots as they are stored: documents whose fields have changed over time, as ``VARIANT`` columns.

The text is parsed once, when it is stored; what is read back are paths of it, so that a day that lacks a field gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRIKE = ", ".join(f"{c} double" for c in ("k", "cA", "cB", "pA", "pB", "cP", "pP", "cPA", "cPB", "pPA", "pPB"))
CELL = "netOI double, netDV double, vOI double, vDV double"


def as_variant(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a text column parsed; what isn't JSON becomes null."""
    return rows.withColumn(column, F.try_parse_json(column))


#: By it the Parquet writer holds thousands of documents to split them into columns, hundreds where the keys are dates or prices.
SHREDDING = "spark.sql.variant.inferShreddingSchema"


def write_whole(rows: DataFrame, path: str) -> None:
    """Write rows with variants to a new folder as Parquet, each document in one piece, so that a writer holds one at a time."""
    conf = rows.sparkSession.conf
    before = conf.get(SHREDDING, None)
    conf.set(SHREDDING, "false")
    try:
        rows.write.parquet(path)
    finally:
        conf.unset(SHREDDING) if before is None else conf.set(SHREDDING, before)


def stored_minute(days: DataFrame, minute: Column | None = None) -> DataFrame:
    """(ticker, date, t, spot, strikes) of (ticker, date, spot, minutes): a minute of each day's variant array, the last one
    by default and where that minute isn't there. Only that element's strikes are unpacked; days without one are left out."""
    all_ = F.col("minutes").cast("array<variant>")
    last = F.try_element_at(all_, F.lit(-1))
    at = last if minute is None else F.coalesce(F.try_element_at(F.filter(all_, lambda m: F.try_variant_get(m, "$.t", "string") == minute), F.lit(1)), last)
    picked = days.withColumn("m", at).filter("m is not null")
    strikes = F.try_variant_get("m", "$.strikes", f"array<struct<{STRIKE}>>")
    rows = picked.select("ticker", "date", F.try_variant_get("m", "$.t", "string").alias("t"), F.col("spot").cast("double").alias("spot"), strikes.alias("strikes"))
    return rows.withColumn("strikes", F.filter("strikes", lambda s: s["k"] > 0))


def stored_cells(snapshots: DataFrame) -> DataFrame:
    """(ticker, captured_at, spot, n_exp, strike, expiry, net_oi, net_dv, v_oi, v_dv) of heatmap snapshots (ticker, captured_at,
    spot, cells): one row for each strike and expiry."""
    strikes = F.try_variant_get("cells", "$.strikes", f"array<struct<strike double, byExp map<string, struct<{CELL}>>>>")
    n = F.coalesce(F.size(F.try_variant_get("cells", "$.expirations", "array<variant>")), F.lit(0))
    # Both paths are read before the rows are multiplied: beside a generator the document would be copied for each strike.
    read = snapshots.select("ticker", "captured_at", F.col("spot").cast("double").alias("spot"), n.alias("n_exp"), strikes.alias("strikes"))
    rows = read.select("ticker", "captured_at", "spot", "n_exp", F.explode("strikes").alias("s"))
    rows = rows.select("ticker", "captured_at", "spot", "n_exp", F.col("s.strike").alias("strike"), F.explode("s.byExp").alias("expiry", "c"))
    return rows.select("ticker", "captured_at", "spot", "n_exp", "strike", F.col("expiry").cast("date").alias("expiry"), F.col("c.netOI").alias("net_oi"), F.col("c.netDV").alias("net_dv"), F.col("c.vOI").alias("v_oi"), F.col("c.vDV").alias("v_dv"))
