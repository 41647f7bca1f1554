"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("s")).first()
    return row["n"], row["x"], row["s"]


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b). Partial aggregation finds each centre's minimum; the join back is salted, as one
    centre may have most of the pairs."""
    if large:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = salted_join(both.filter("v > u"), low, ["u"], ["v"]).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        out = salted_join(down, low, ["u"], ["v"]).select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) of any order -> (node, root): root is the smallest node that can be reached.

    Only nodes that have an edge appear. Each round is written to the shared folder, so that the plan stays
    short and a lost executor repeats one round at most.
    """
    pairs = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(pairs)
    for _ in range(MAX_ROUNDS):
        pairs = written(_star(_star(pairs, large=True), large=False), "stars")
        now = _state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
