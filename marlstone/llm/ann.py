"""Nearest neighbours by collision counting over query-centred windows.

Vectors are dealt into blocks. A block keeps, for each of ``PROJECTIONS`` random directions, the array of its
vectors sorted by their projection. A query opens a window around its own projection in every array; a vector
collides wherever it lies in the window. Virtual rehashing widens the windows until they suit the distance of the
k-th best vector found; vectors with enough collisions are verified by their exact inner product. A vector no
farther than the k-th best then reaches the threshold with a probability of about 0.95. Largest inner product
becomes least distance by one more component, which gives all vectors the same length.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ship import ship
from .common import broadcast_if_small, written

PROJECTIONS, SEED = 64, 20
#: Share of the directions in which a vector must collide, half window over distance at the end, growth of windows.
THRESHOLD, WIDTH, GROWTH, FIRST = 0.58, 1.0, 1.25, 0.9
#: Vectors of a data block and queries of a query block; memory of a task goes by these alone.
DATA_BLOCK, QUERY_BLOCK = 16384, 1024


class Block:
    """Sorted projections of a block of vectors (rows of ``data``, lengths up to ``longest``)."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, longest: float):
        self.ids, self.data, self.single, self.longest = ids, data, data.astype(np.float32), longest
        rest = np.sqrt(np.maximum(0.0, longest**2 - (data**2).sum(axis=1)))
        self.way = np.random.default_rng(SEED).normal(size=(PROJECTIONS, data.shape[1] + 1))
        shade = self.way @ np.column_stack([data, rest]).T
        order = np.argsort(shade, axis=1, kind="stable")
        self.sorted = np.take_along_axis(shade, order, axis=1)
        self.rank = np.empty(order.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None], axis=1)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies in the window [low, high)."""
        inside = (self.rank - low.astype(np.uint16)[:, None]) < (high - low).astype(np.uint16)[:, None]
        return inside.view(np.uint8).sum(axis=0, dtype=np.uint8)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best rows (places in the block) and their inner products, best first."""
        size = np.sqrt((queries**2).sum(axis=1))
        shade = (queries * (self.longest / size)[:, None]) @ self.way[:, :-1].T
        need, n = math.ceil(THRESHOLD * PROJECTIONS), len(self.ids)
        half = np.full(len(queries), FIRST * self.longest)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, int), np.empty(0))] * len(queries)
        live = np.arange(len(queries))
        while len(live):
            low, high = np.empty((len(live), PROJECTIONS), np.int64), np.empty((len(live), PROJECTIONS), np.int64)
            for j in range(PROJECTIONS):
                low[:, j] = np.searchsorted(self.sorted[j], shade[live, j] - half[live], "left")
                high[:, j] = np.searchsorted(self.sorted[j], shade[live, j] + half[live], "right")
            again = []
            for at, q in enumerate(live.tolist()):
                near = np.flatnonzero((self.collisions(low[at], high[at]) >= need) & (self.ids != query_ids[q]))
                if len(near) > 2 * k:  # single precision rules out most; its error is far below the slack
                    rough = self.single[near] @ queries[q].astype(np.float32)
                    near = near[rough >= np.partition(rough, len(near) - k)[len(near) - k] - 1e-4 * self.longest * size[q]]
                score = (self.data[near] * queries[q]).sum(axis=1)
                best = np.lexsort((self.ids[near], -score))[:k]
                out[q] = (near[best], score[best])
                if (high[at] - low[at]).min() >= n:
                    continue
                if len(best) < k:
                    half[q] *= GROWTH
                else:
                    far = math.sqrt(max(0.0, 2 * self.longest**2 - 2 * self.longest * score[best[-1]] / size[q]))
                    if half[q] >= WIDTH * far:
                        continue
                    half[q] = max(min(half[q] * GROWTH**2, WIDTH * far), half[q] * 1.02)
                again.append(q)
            live = np.array(again, int)
        return out


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>, dim, len) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (
        rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
        .filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & whole)
        .withColumn("len", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
        .filter("len > 0")
        .withColumn("dim", F.size("v"))
    )


def nearest(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row whose id is divisible by ``every``.

    Candidates are all rows of the query's dimension but those with its id; all of them if they are fewer than ``k``.
    Ties go to the smaller id. Rows with a null id, and vectors that are null, empty, zero or hold a null or
    non-finite component take no part. Repeated candidates are each returned; repeated queries count once. Other
    columns are ignored. Empty in, empty out.

    The stated query set meets all rows in blocks of fixed size: every (data block, query block) is one group.
    """
    ship(rows.sparkSession)
    good = written(usable(rows, id_col, vector_col), "vectors")
    sizes = good.groupBy("dim").agg(F.max("len").alias("longest"), F.ceil(F.count("*") / DATA_BLOCK).alias("nd"), F.ceil(F.count(F.when(F.col("id") % every == 0, 1)) / QUERY_BLOCK).alias("nq")).filter("nq > 0")
    good = good.join(broadcast_if_small(written(sizes, "sizes"), 10_000), "dim")
    places = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    data = good.select("dim", "longest", "id", "v", F.pmod(F.xxhash64("id", "v"), F.col("nd")).alias("d"), places("nq").alias("q"))
    asked = good.filter(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = asked.select(F.col("dim").alias("qdim"), F.col("id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("v", "id"), F.col("nq")).alias("qq"), places("nd").alias("qd"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            queries = np.stack(right["qv"].to_numpy())
            for k0 in range(0, len(left), 60_000):  # ranks are 16 bits wide
                part = left.iloc[k0 : k0 + 60_000]
                block = Block(part["id"].to_numpy(), np.stack(part["v"].to_numpy()), float(part["longest"].iloc[0]))
                for qid, (near, score) in zip(right["qid"], block.search(right["qid"].to_numpy(), queries, k), strict=True):
                    found.append(pd.DataFrame({"query_id": np.full(len(near), qid), "vec_id": block.ids[near], "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    met = data.groupBy("dim", "d", "q").cogroup(asked.groupBy("qdim", "qd", "qq")).applyInPandas(run, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
